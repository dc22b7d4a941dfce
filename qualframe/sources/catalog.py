"""Catalogs of schema documents: reading many, and finding what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe.document import DOCUMENT_DDL, FLAG_KEYS, NAME_KEYS, TYPE_KEYS
from qualframe.functions.predicates import APPLICABLE

DATATYPES = ("Tabular", "Relational")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``document, text``: one row per JSON file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("document"), F.col("value").alias("text"))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Add ``dataset`` and ``model`` parsed by the fixed layout; ``_broken`` keeps text that is no such JSON."""
    parsed = F.from_json("text", f"{DOCUMENT_DDL}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    return documents.withColumn("_p", parsed).select("*", "_p.dataset", "_p.model", "_p._broken").drop("_p")


_ISSUES = "array<struct<table:string,field:string,issue:string,detail:string>>"


def _text(value: str | Column | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def _issues(*cases: tuple[Column, str, str | Column | None], table: Column | None = None, field: Column | None = None) -> Column:
    """The cases ``(condition, issue, detail)`` that hold."""
    return F.array_compact(F.array(*[
        F.when(when, F.struct(_text(table).alias("table"), _text(field).alias("field"),
                              F.lit(issue).alias("issue"), _text(detail).alias("detail")))
        for when, issue, detail in cases
    ]))


def _each(items: Column, issues_of) -> Column:
    """Issues of every member of a list that may be null."""
    return F.coalesce(F.flatten(F.transform(items, issues_of)), F.array().cast(_ISSUES))


# Paths whose JSON type is fixed, with the start of its name: in a document, and in each field.
_PATHS = {"dataset": "OBJECT", "dataset.name": "STRING", "dataset.datatype": "STRING", "dataset.uid": "STRING", "model": "OBJECT",
          "model.table_data": "OBJECT", "model.table_data.name": "STRING", "model.table_data.uid": "STRING", "model.status": "OBJECT",
          "model.status.status": "STRING", "model.fields": "ARRAY", "model.relational": "ARRAY"}
_FIELD_PATHS = {"names": "OBJECT", "types": "OBJECT", "flags": "OBJECT", "constraints": "ARRAY",
                **{f"names.{key}": "STRING" for key in NAME_KEYS}, **{f"types.{key}": "STRING" for key in TYPE_KEYS},
                **{f"flags.{key}": "BOOLEAN" for key in FLAG_KEYS}}


def _wrong_types() -> Column:
    """For text that is JSON but not of the fixed layout: the paths of another type."""
    def misfits(value: str, paths: dict[str, str], prefix: Column) -> Column:
        cases = []
        for path, wanted in paths.items():
            kind = F.expr(f"schema_of_variant(try_variant_get({value}, '$.{path}', 'variant'))")
            cases.append((kind.isNotNull() & (kind != "VOID") & ~kind.startswith(wanted), "wrong_type", F.concat(prefix, F.lit(path))))
        return _issues(*cases)

    fields = F.expr("try_variant_get(_json, '$.model.fields', 'array<variant>')")
    of_fields = F.transform(fields, lambda f, i: F.struct(f.alias("f"), i.alias("i")))
    each = F.flatten(F.transform(of_fields, lambda x: F.filter(F.array(*[
        F.struct(F.call_function("schema_of_variant", F.try_variant_get(x["f"], f"$.{path}", "variant")).alias("kind"), F.lit(wanted).alias("wanted"),
                 F.concat(F.lit("model.fields["), x["i"].cast("string"), F.lit(f"].{path}")).alias("path"))
        for path, wanted in _FIELD_PATHS.items()]), lambda k: k["kind"].isNotNull() & (k["kind"] != "VOID") & ~k["kind"].startswith(k["wanted"]))))
    in_fields = F.transform(each, lambda k: F.struct(F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("field"),
                                                     F.lit("wrong_type").alias("issue"), k["path"].alias("detail")))
    found = F.concat(misfits("_json", _PATHS, F.lit("")), F.coalesce(in_fields, F.array().cast(_ISSUES)))
    return found


def _table_required(table: Column, path: str) -> list[tuple[Column, str, str]]:
    """What a table must state: its name and identifier, its status, at least one field."""
    return [(table["table_data"]["name"].isNull(), "missing", f"{path}.table_data.name"),
            (table["table_data"]["uid"].isNull(), "missing", f"{path}.table_data.uid"),
            (table["status"]["status"].isNull(), "missing", f"{path}.status.status"),
            (table["fields"].isNull() | (F.size(table["fields"]) == 0), "missing", f"{path}.fields")]


def _document_issues() -> Column:
    datatype = F.col("dataset.datatype")
    tabular = F.col("model").isNotNull() & (F.coalesce(datatype, F.lit("Tabular")) != "Relational")
    return _issues(
        (F.col("_broken").isNotNull(), "not_readable", None),
        *[(tabular & missing, issue, path) for missing, issue, path in _table_required(F.col("model"), "model")],
        *[(F.col(f"dataset.{key}").isNull(), "missing", f"dataset.{key}") for key in ("name", "datatype", "uid")],
        (~datatype.isin(*DATATYPES), "unknown_datatype", datatype),
        (F.col("model").isNull(), "missing", "model"),
        ((datatype == "Relational") & F.col("model.relational").isNull(), "missing", "model.relational"),
    )


def _rule_issues(table: Column, field: Column, rule: Column) -> Column:
    types, flags = field["types"], field["flags"]
    names = F.array_compact(F.array(
        types["pq_type"], types["logical_type"], F.when(flags["is_numeric"], F.lit("is_numeric")),
        F.when(flags["is_categorical"], F.lit("is_categorical"))))
    known = rule["name"].isin(*APPLICABLE)
    applicable = F.create_map(*[x for rule_name, wanted in APPLICABLE.items()
                                for x in (F.lit(rule_name), F.array(*[F.lit(t) for t in wanted]))])
    fits = F.arrays_overlap(names, F.try_element_at(applicable, rule["name"]))
    return _issues(
        *[(rule[key].isNull(), "missing", f"constraints.{key}") for key in ("name", "values", "enabled")],
        (~known, "unknown_constraint", rule["name"]),
        (known & types["pq_type"].isNotNull() & ~fits, "constraint_not_applicable", rule["name"]),
        table=table, field=field["names"]["raw_name"])


def _field_issues(table: Column, field: Column) -> Column:
    required = _issues(
        *[(field[section][key].isNull(), "missing", f"{section}.{key}")
          for section, key in (("names", "uid"), ("names", "raw_name"), ("types", "pq_type"))],
        table=table, field=field["names"]["raw_name"])
    return F.concat(required, _each(field["constraints"], lambda rule: _rule_issues(table, field, rule)))


def _table_issues(name: Column, fields: Column) -> Column:
    def repeats(key: str) -> Column:
        present = F.filter(F.transform(fields, lambda f: f["names"][key]), lambda value: value.isNotNull())
        return F.size(present) > F.size(F.array_distinct(present))

    repeated = _issues((repeats("uid"), "duplicate_field_uid", None), (repeats("raw_name"), "duplicate_raw_name", None), table=name)
    return F.concat(repeated, _each(fields, lambda field: _field_issues(name, field)))


def lint_documents(documents: DataFrame) -> DataFrame:
    """``document, table, field, issue, detail``: everything that breaks the rules of the format.

    Each document is parsed once and judged by itself, without a shuffle; a second pass counts dataset
    identifiers over the whole catalog.
    """
    parsed = parse_documents(documents)
    name = F.coalesce(F.col("model.table_data.name"), F.col("dataset.name"))
    own = _table_issues(name, F.col("model.fields"))
    related = _each(F.col("model.relational"), lambda t: F.concat(
        _issues(*_table_required(t, "model.relational"), table=t["table_data"]["name"]), _table_issues(t["table_data"]["name"], t["fields"])))
    issues = F.concat(_document_issues(), F.coalesce(own, F.array().cast(_ISSUES)), related)
    found = parsed.select("document", F.explode(issues).alias("i")).select("document", "i.*")
    # Documents that do not fit the layout, but are JSON, are looked at path by path.
    odd = parsed.where("_broken IS NOT NULL").withColumn("_json", F.expr("try_parse_json(text)")).where("_json IS NOT NULL")
    wrong = odd.select("document", F.explode(_wrong_types()).alias("i")).select("document", "i.*")
    return found.unionByName(wrong).unionByName(repeated_datasets(documents))


def repeated_datasets(documents: DataFrame) -> DataFrame:
    """Dataset identifiers that several documents use; the first document names the finding, ``detail`` the identifier.

    Documents are counted per identifier, so one identifier that a third of a catalog shares is one row.
    """
    shared = documents.groupBy(F.get_json_object("text", "$.dataset.uid").alias("detail")).agg(
        F.count("*").alias("n"), F.min("document").alias("document"))
    none = F.lit(None).cast("string")
    return shared.where("n > 1 AND detail IS NOT NULL").select(
        "document", none.alias("table"), none.alias("field"), F.lit("duplicate_dataset_uid").alias("issue"), "detail")
