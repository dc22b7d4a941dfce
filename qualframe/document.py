"""The schema document: what a dataset should look like.

A document is small driver-side configuration, like a Spark ``StructType``. Its JSON layout is the
exchange format (`dataset`, `model.fields[].{status,names,types,flags,constraints}`); catalogs with many documents are
read as DataFrames with ``DOCUMENT_DDL`` (see ``sources/catalog.py``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

# The section members of the document format.
NAME_KEYS = ("uid", "raw_name", "display_name", "description_short", "description_long")
TYPE_KEYS = ("pq_type", "logical_type", "arrow_type", "representation", "units")
FLAG_KEYS = (
    "is_raw", "is_pii", "is_standardised", "is_transformed", "is_inherited", "is_join",
    "is_key", "is_synthetic", "is_backfilled", "is_categorical", "is_numeric",
)
LEVELS = {"warning": 1, "error": 2}

_RULE_DDL = "STRUCT<name: STRING, `values`: MAP<STRING, STRING>, enabled: BOOLEAN>"


def _members(keys, kind: str) -> str:
    return ", ".join(f"{key}: {kind}" for key in keys)


FIELD_DDL = (
    "STRUCT<status: STRUCT<status: STRING>, "
    f"names: STRUCT<{_members(NAME_KEYS, 'STRING')}>, "
    f"types: STRUCT<{_members(TYPE_KEYS, 'STRING')}>, "
    f"flags: STRUCT<{_members(FLAG_KEYS, 'BOOLEAN')}>, "
    f"constraints: ARRAY<{_RULE_DDL}>>"
)
TABLE_DDL = (
    "status: STRUCT<status: STRING>, table_data: STRUCT<name: STRING, uid: STRING>, "
    f"fields: ARRAY<{FIELD_DDL}>, table_constraints: ARRAY<{_RULE_DDL}>"
)
DOCUMENT_DDL = (
    "dataset STRUCT<name: STRING, datatype: STRING, uid: STRING>, "
    f"model STRUCT<{TABLE_DDL}, relational: ARRAY<STRUCT<{TABLE_DDL}>>>"
)


class DocumentError(ValueError):
    """A schema document, or a constraint in it, cannot be used."""


@dataclass(frozen=True)
class Rule:
    """One constraint with a value per severity level; a blank value skips its level."""

    name: str
    values: dict[str, Any]
    enabled: bool = True

    def levels(self) -> list[tuple[str, Any]]:
        if not self.enabled:
            return []
        return [(level, value) for level, value in self.values.items() if value not in ("", None)]

    def to_dict(self) -> dict:
        return {"name": self.name, "values": dict(self.values), "enabled": self.enabled}

    @staticmethod
    def from_dict(data: dict) -> "Rule":
        try:
            return Rule(data["name"], dict(data["values"]), bool(data["enabled"]))
        except KeyError as missing:
            raise DocumentError(f"constraint {data.get('name')!r} lacks {missing}") from missing


@dataclass(frozen=True)
class FieldSpec:
    raw_name: str
    pq_type: str
    logical_type: str = "none"
    uid: str = ""
    flags: dict[str, bool] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    names: dict[str, Any] = field(default_factory=dict)
    types: dict[str, Any] = field(default_factory=dict)
    status: str | None = None

    def flag(self, name: str) -> bool | None:
        return self.flags.get(name)

    def with_rules(self, *rules: Rule) -> "FieldSpec":
        return replace(self, rules=tuple(rules))

    def with_flags(self, **flags: bool) -> "FieldSpec":
        return replace(self, flags={**self.flags, **flags})

    def to_dict(self) -> dict:
        names = {"uid": self.uid, "raw_name": self.raw_name, **self.names}
        types = {"pq_type": self.pq_type, "logical_type": self.logical_type, **self.types}
        out = {"names": names, "types": types, "flags": dict(self.flags),
               "constraints": [rule.to_dict() for rule in self.rules]}
        return {"status": {"status": self.status}, **out} if self.status else out

    @staticmethod
    def from_dict(data: dict) -> "FieldSpec":
        names, types = dict(data.get("names") or {}), dict(data.get("types") or {})
        for section, keys in ((names, ("uid", "raw_name")), (types, ("pq_type",))):
            for key in keys:
                if section.get(key) is None:
                    raise DocumentError(f"field {names.get('raw_name')!r} lacks {key}")
        return FieldSpec(
            raw_name=names.pop("raw_name"),
            uid=names.pop("uid"),
            pq_type=types.pop("pq_type"),
            logical_type=types.pop("logical_type", None) or "none",
            flags={k: v for k, v in (data.get("flags") or {}).items() if v is not None},
            rules=tuple(Rule.from_dict(rule) for rule in data.get("constraints") or ()),
            names=names,
            types=types,
            status=(data.get("status") or {}).get("status"),
        )


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[FieldSpec, ...]
    uid: str = ""
    table_rules: tuple[Rule, ...] = ()
    status: str | None = None

    @property
    def columns(self) -> list[str]:
        return [spec.raw_name for spec in self.fields]

    def field(self, raw_name: str) -> FieldSpec:
        for spec in self.fields:
            if spec.raw_name == raw_name:
                return spec
        raise DocumentError(f"table {self.name!r} has no field {raw_name!r}")

    def keys(self) -> list[str]:
        return [spec.raw_name for spec in self.fields if spec.flag("is_key")]

    def replace_field(self, spec: FieldSpec) -> "TableSpec":
        self.field(spec.raw_name)
        return replace(self, fields=tuple(spec if f.raw_name == spec.raw_name else f for f in self.fields))

    def with_rules(self, **rules) -> "TableSpec":
        """Set the constraints of several fields: ``with_rules(qty=[Rule(...)])``."""
        table = self
        for column, column_rules in rules.items():
            table = table.replace_field(table.field(column).with_rules(*column_rules))
        return table

    def to_dict(self) -> dict:
        out = {"table_data": {"name": self.name, "uid": self.uid},
               "fields": [spec.to_dict() for spec in self.fields],
               "table_constraints": [rule.to_dict() for rule in self.table_rules]}
        return {"status": {"status": self.status}, **out} if self.status else out

    @staticmethod
    def from_dict(data: dict, default_name: str = "") -> "TableSpec":
        table_data = data.get("table_data") or {}
        return TableSpec(
            name=table_data.get("name") or default_name,
            uid=table_data.get("uid") or "",
            fields=tuple(FieldSpec.from_dict(item) for item in data.get("fields") or ()),
            table_rules=tuple(Rule.from_dict(item) for item in data.get("table_constraints") or ()),
            status=(data.get("status") or {}).get("status"),
        )


@dataclass(frozen=True)
class Document:
    """A dataset: one table (``Tabular``) or several that refer to each other (``Relational``)."""

    name: str
    uid: str
    tables: tuple[TableSpec, ...]
    datatype: str = "Tabular"

    @property
    def table(self) -> TableSpec:
        if self.datatype != "Tabular" or len(self.tables) != 1:
            raise DocumentError(f"dataset {self.name!r} is {self.datatype}, not a single table")
        return self.tables[0]

    def to_dict(self) -> dict:
        dataset = {"name": self.name, "datatype": self.datatype, "uid": self.uid}
        if self.datatype == "Relational":
            return {"dataset": dataset, "model": {"relational": [table.to_dict() for table in self.tables]}}
        return {"dataset": dataset, "model": self.table.to_dict()}

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str)

    @staticmethod
    def from_dict(data: dict) -> "Document":
        dataset, model = data.get("dataset") or {}, data.get("model") or {}
        for key in ("name", "datatype", "uid"):
            if dataset.get(key) is None:
                raise DocumentError(f"dataset lacks {key}")
        datatype = dataset["datatype"]
        if datatype == "Tabular":
            tables = (TableSpec.from_dict(model, dataset["name"]),)
        elif datatype == "Relational":
            tables = tuple(TableSpec.from_dict(item) for item in model.get("relational") or ())
        else:
            raise DocumentError(f"datatype {datatype!r} is not supported")
        return Document(dataset["name"], dataset["uid"], tables, datatype)

    @staticmethod
    def from_json(text: str) -> "Document":
        return Document.from_dict(json.loads(text))
