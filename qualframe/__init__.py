"""qualframe: describe, profile, validate and ingest tabular datasets on Spark."""

from qualframe.document import Document, FieldSpec, Rule, TableSpec
from qualframe.session import configure, materialize

__all__ = ["Document", "FieldSpec", "Rule", "TableSpec", "configure", "materialize"]
