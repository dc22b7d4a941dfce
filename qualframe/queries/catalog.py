"""All registered queries."""

from __future__ import annotations

from qualframe.queries import registry
from qualframe.queries import charts, datasets, profiles, validation  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
