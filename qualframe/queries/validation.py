"""Constraints, validation reports, relations."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe.document import Document, Rule
from qualframe.operators.checks import result_columns, rule_checks, run_checks
from qualframe.operators.relational import orphan_keys, reference_check, validate_relational
from qualframe.operators.uniqueness import key_counts, repeated_keys
from qualframe.operators.validate import column_levels, column_summary, findings, mark_rows, split_rows, table_level, validate
from qualframe.plans.statistics import validate_files
from qualframe.queries.registry import base_rows, check_row, query, report_of, rule_row, spec_of, table
from qualframe.session import scratch_path

LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def rule(name: str, warning=None, error=None, enabled: bool = True) -> Rule:
    return Rule(name, {"warning": warning, "error": error}, enabled)


LINEITEM_RULES = {
    "l_quantity": [rule("greater_equal", "1", "0"), rule("less_equal", "45", "50")],
    "l_extendedprice": [rule("greater", "1000.0", "0"), rule("less", "104000.0", "1000000.0")],
    "l_discount": [rule("less_equal", 0.09, 0.1)],
    "l_tax": [rule("less", "0.08")],
    "l_returnflag": [rule("allowed_values", "A,N", "A,N,R")],
    "l_linestatus": [rule("allowed_values", error="O,F")],
    "l_shipdate": [rule("greater_equal", "1995-06-30T00:00:00"), rule("less", "2001-10-01T00:00:00", "2002-01-01T00:00:00")],
    "l_orderkey": [rule("greater_equal", error=0)],
    "l_partkey": [rule("not_equal", "0")],
    "l_suppkey": [rule("greater_equal", error="0")],
    "l_linenumber": [rule("less_equal", "6", "7")],
}


def lineitem_rule_rows(by: str | None = None) -> list[str]:
    row = lambda *a, **k: rule_row("lineitem", *a, by=by, **k)
    return [
        row("l_quantity", "greater_equal", "warning", "1", "l_quantity < 1"),
        row("l_quantity", "greater_equal", "error", "0", "l_quantity < 0"),
        row("l_quantity", "less_equal", "warning", "45", "l_quantity > 45"),
        row("l_quantity", "less_equal", "error", "50", "l_quantity > 50"),
        row("l_extendedprice", "greater", "warning", "1000.0", "l_extendedprice <= 1000"),
        row("l_extendedprice", "greater", "error", "0", "l_extendedprice <= 0"),
        row("l_extendedprice", "less", "warning", "104000.0", "l_extendedprice >= 104000"),
        row("l_extendedprice", "less", "error", "1000000.0", "l_extendedprice >= 1000000"),
        row("l_discount", "less_equal", "warning", "0.09", "l_discount > CAST(0.09 AS DOUBLE)"),
        row("l_discount", "less_equal", "error", "0.1", "l_discount > CAST(0.1 AS DOUBLE)"),
        row("l_tax", "less", "warning", "0.08", "l_tax >= CAST(0.08 AS DOUBLE)"),
        row("l_returnflag", "allowed_values", "warning", "A,N", "l_returnflag NOT IN ('A', 'N')"),
        row("l_returnflag", "allowed_values", "error", "A,N,R", "l_returnflag NOT IN ('A', 'N', 'R')"),
        row("l_linestatus", "allowed_values", "error", "O,F", "l_linestatus NOT IN ('O', 'F')"),
        row("l_shipdate", "greater_equal", "warning", "1995-06-30T00:00:00", "l_shipdate < TIMESTAMP '1995-06-30 00:00:00'"),
        row("l_shipdate", "less", "warning", "2001-10-01T00:00:00", "l_shipdate >= TIMESTAMP '2001-10-01 00:00:00'"),
        row("l_shipdate", "less", "error", "2002-01-01T00:00:00", "l_shipdate >= TIMESTAMP '2002-01-01 00:00:00'"),
        row("l_orderkey", "greater_equal", "error", "0", "l_orderkey < 0"),
        row("l_partkey", "not_equal", "warning", "0", "l_partkey = 0"),
        row("l_suppkey", "greater_equal", "error", "0", "l_suppkey < 0"),
        row("l_linenumber", "less_equal", "warning", "6", "l_linenumber > 6"),
        row("l_linenumber", "less_equal", "error", "7", "l_linenumber > 7"),
    ]


LINEITEM_REPORT = report_of(base_rows("lineitem", LINEITEM) + lineitem_rule_rows())
_MONTH = "strftime(l_shipdate, '%Y-%m')"
MONTHLY_REPORT = report_of(base_rows("lineitem", LINEITEM, by=_MONTH) + lineitem_rule_rows(_MONTH), by=True)


def lineitem_spec(df: DataFrame):
    return spec_of(df, "lineitem", ["ingestion"]).with_rules(**LINEITEM_RULES)


def by_month(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("ingestion", F.date_format("l_shipdate", "yyyy-MM"))


@query("validate_lineitem", LINEITEM_REPORT)
def validate_lineitem(spark, d):
    df = table(spark, d, "lineitem")
    return validate(df, lineitem_spec(df))


@query("validate_files", LINEITEM_REPORT)
def files_report(spark, d):
    """The same report from footers first; only what they leave open is scanned."""
    return validate_files(spark, f"{d}/lineitem.parquet", lineitem_spec(table(spark, d, "lineitem")))


_RANGED = ("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
_LAST_KEYS = "(SELECT max(l_orderkey) - 5 FROM lineitem)"
# Files laid out by key, at least; rows of one of them, which a task sorts in memory.
RANGES, RANGE_ROWS = 8, 1_000_000


@query("validate_open_files", 'SELECT "column", "check", "constraint", "level", severity, status, evaluated, failed, percent FROM (' + report_of(
    base_rows("lineitem", _RANGED) + [
        rule_row("lineitem", "l_orderkey", "greater_equal", "error", "0", "l_orderkey < 0"),
        rule_row("lineitem", "l_orderkey", "less_equal", "warning", "last", f"l_orderkey > {_LAST_KEYS}"),
        rule_row("lineitem", "l_linenumber", "less", "error", "8", "l_linenumber >= 8"),
        rule_row("lineitem", "l_linenumber", "greater", "warning", "7", "l_linenumber <= 7"),
        check_row("lineitem", None, "table_constraint", "count(*)", "0", 1, "min_rows", "warning", "1")]) + ")")
def validate_open_files(spark, d):
    """Files laid out by key: footers settle all but the last, which alone is read."""
    df, path = table(spark, d, "lineitem").select(*_RANGED), scratch_path(spark, "ranged")
    rows, greatest = df.agg(F.count("*"), F.max("l_orderkey")).first()
    ranges, last = max(RANGES, -(-rows // RANGE_ROWS)), greatest - 5
    df.repartitionByRange(ranges, "l_orderkey").sortWithinPartitions("l_orderkey").write.parquet(path)
    spec = spec_of(df, "lineitem").with_rules(
        l_orderkey=[rule("greater_equal", error="0"), rule("less_equal", str(last))], l_linenumber=[rule("less", error="8"), rule("greater", "7")])
    report = validate_files(spark, path, replace(spec, table_rules=(rule("min_rows", "1"),)))
    return report.drop("value")


@query("validate_by_month", MONTHLY_REPORT)
def validate_by_month(spark, d):
    df = by_month(spark, d)
    return validate(df, lineitem_spec(df), by=["ingestion"])


def constraint_report(spark, d, name: str, rules: dict[str, list[Rule]], change=None) -> DataFrame:
    """The rows a report has for the constraints alone."""
    df = table(spark, d, name)
    df = change(df) if change else df
    spec = spec_of(df, name).with_rules(**rules)
    return run_checks(df, [check for field in spec.fields for check in rule_checks(df, field)])


def constraint_query(label: str, name: str, rules: dict[str, list[Rule]], rows: list[str]) -> None:
    @query(f"constraint_{label}", report_of(rows))
    def run(spark, d):
        return constraint_report(spark, d, name, rules)


constraint_query("greater", "lineitem", {
    "l_quantity": [rule("greater", "1", "0")], "l_returnflag": [rule("greater", "A")],
    "l_shipdate": [rule("greater", "1995-01-31T00:00:00")],
}, [
    rule_row("lineitem", "l_quantity", "greater", "warning", "1", "l_quantity <= 1"),
    rule_row("lineitem", "l_quantity", "greater", "error", "0", "l_quantity <= 0"),
    rule_row("lineitem", "l_returnflag", "greater", "warning", "A", "l_returnflag <= 'A'"),
    rule_row("lineitem", "l_shipdate", "greater", "warning", "1995-01-31T00:00:00", "l_shipdate <= TIMESTAMP '1995-01-31'"),
])
constraint_query("greater_equal", "customer", {
    "c_acctbal": [rule("greater_equal", "0", "-999.99")], "c_nationkey": [rule("greater_equal", 1, 0)],
}, [
    rule_row("customer", "c_acctbal", "greater_equal", "warning", "0", "c_acctbal < 0"),
    rule_row("customer", "c_acctbal", "greater_equal", "error", "-999.99", "c_acctbal < CAST(-999.99 AS DOUBLE)"),
    rule_row("customer", "c_nationkey", "greater_equal", "warning", "1", "c_nationkey < 1"),
    rule_row("customer", "c_nationkey", "greater_equal", "error", "0", "c_nationkey < 0"),
])
constraint_query("less", "events", {
    "value": [rule("less", "100", "1000000")], "ts": [rule("less", "2024-01-20T00:00:00")], "user_id": [rule("less", "50")],
}, [
    rule_row("events", "value", "less", "warning", "100", "value >= 100"),
    rule_row("events", "value", "less", "error", "1000000", "value >= 1000000"),
    rule_row("events", "ts", "less", "warning", "2024-01-20T00:00:00", "ts >= TIMESTAMP '2024-01-20'"),
    rule_row("events", "user_id", "less", "warning", "50", "user_id >= 50"),
])
constraint_query("less_equal", "orders", {
    "o_totalprice": [rule("less_equal", "250000.5", "600000")], "o_orderpriority": [rule("less_equal", "4-NOT SPECIFIED")],
}, [
    rule_row("orders", "o_totalprice", "less_equal", "warning", "250000.5", "o_totalprice > CAST(250000.5 AS DOUBLE)"),
    rule_row("orders", "o_totalprice", "less_equal", "error", "600000", "o_totalprice > 600000"),
    rule_row("orders", "o_orderpriority", "less_equal", "warning", "4-NOT SPECIFIED", "o_orderpriority > '4-NOT SPECIFIED'"),
])
constraint_query("not_equal", "orders", {
    "o_orderstatus": [rule("not_equal", "P", "X")], "o_custkey": [rule("not_equal", "1")],
}, [
    rule_row("orders", "o_orderstatus", "not_equal", "warning", "P", "o_orderstatus = 'P'"),
    rule_row("orders", "o_orderstatus", "not_equal", "error", "X", "o_orderstatus = 'X'"),
    rule_row("orders", "o_custkey", "not_equal", "warning", "1", "o_custkey = 1"),
])
constraint_query("multiple_of", "lineitem", {
    "l_orderkey": [rule("multiple_of", "3", "1")], "l_discount": [rule("multiple_of", "0.02", "0.01")],
    "l_extendedprice": [rule("multiple_of", 0.05)],
}, [
    rule_row("lineitem", "l_orderkey", "multiple_of", "warning", "3", "l_orderkey % 3 <> 0"),
    rule_row("lineitem", "l_orderkey", "multiple_of", "error", "1", "l_orderkey % 1 <> 0"),
    *[rule_row("lineitem", c, "multiple_of", level, v,
               f"NOT abs({c} - round_even({c} / CAST({v} AS DOUBLE), 0) * CAST({v} AS DOUBLE)) <= CAST(1e-9 AS DOUBLE) * greatest(1.0, abs({c}))")
      for c, level, v in (("l_discount", "warning", "0.02"), ("l_discount", "error", "0.01"), ("l_extendedprice", "warning", "0.05"))],
])
constraint_query("min_length", "documents", {
    "text": [rule("min_length", "100", "1")], "lang": [rule("min_length", error=2)],
}, [
    rule_row("documents", "text", "min_length", "warning", "100", "length(text) < 100"),
    rule_row("documents", "text", "min_length", "error", "1", "length(text) < 1"),
    rule_row("documents", "lang", "min_length", "error", "2", "length(lang) < 2"),
])
constraint_query("max_length", "documents", {"text": [rule("max_length", "1000", "100000")]}, [
    rule_row("documents", "text", "max_length", "warning", "1000", "length(text) > 1000"),
    rule_row("documents", "text", "max_length", "error", "100000", "length(text) > 100000"),
])
constraint_query("format", "pages", {"url": [rule("format", "uri", "hostname")], "html": [rule("format", "email")]}, [
    rule_row("pages", "url", "format", "warning", "uri", r"NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$')"),
    rule_row("pages", "url", "format", "error", "hostname",
             r"NOT regexp_matches(url, '^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)*$')"),
    rule_row("pages", "html", "format", "warning", "email", r"NOT regexp_matches(html, '^[^@\s]+@[^@\s]+\.[^@\s]+$')"),
])
constraint_query("regex", "customer", {
    "c_name": [rule("regex", "0{4}", "^Customer#[0-9]{9}$")], "c_mktsegment": [rule("regex", "E$")],
}, [
    rule_row("customer", "c_name", "regex", "warning", "0{4}", "NOT regexp_matches(c_name, '0{4}')"),
    rule_row("customer", "c_name", "regex", "error", "^Customer#[0-9]{9}$", "NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')"),
    rule_row("customer", "c_mktsegment", "regex", "warning", "E$", "NOT regexp_matches(c_mktsegment, 'E$')"),
])
constraint_query("allowed_values", "events", {
    "event_type": [rule("allowed_values", "click,view", "click,view,purchase,error,signup")], "user_id": [rule("allowed_values", "1,2,3")],
}, [
    rule_row("events", "event_type", "allowed_values", "warning", "click,view", "event_type NOT IN ('click', 'view')"),
    rule_row("events", "event_type", "allowed_values", "error", "click,view,purchase,error,signup",
             "event_type NOT IN ('click', 'view', 'purchase', 'error', 'signup')"),
    rule_row("events", "user_id", "allowed_values", "warning", "1,2,3", "user_id NOT IN (1, 2, 3)"),
])


def unique_row(source: str, column: str, level: str, severity: int) -> str:
    counted = f"(SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)"
    return check_row(counted, column, "constraint", "coalesce(sum(n), 0)", "coalesce(sum(n) FILTER (WHERE n > 1), 0)",
                     severity, "unique", level, "true")


@query("constraint_unique", report_of([
    unique_row("orders", "o_orderkey", "error", 2), unique_row("orders", "o_custkey", "warning", 1),
    unique_row("orders", "o_orderdate", "warning", 1), unique_row("orders", "o_totalprice", "warning", 1),
]))
def constraint_unique(spark, d):
    df = table(spark, d, "orders")
    spec = spec_of(df, "orders").with_rules(
        o_orderkey=[rule("unique", error="true")], o_custkey=[rule("unique", "true")],
        o_orderdate=[rule("unique", "true")], o_totalprice=[rule("unique", "true")])
    return validate(df, spec).where("constraint = 'unique'")


@query("unique_texts", report_of([unique_row("documents", "text", "warning", 1), unique_row("documents", "lang", "warning", 1)]))
def unique_texts(spark, d):
    """Whole documents are compared, digests of them are shuffled."""
    df = table(spark, d, "documents")
    spec = spec_of(df, "documents").with_rules(text=[rule("unique", "true")], lang=[rule("unique", "true")])
    return validate(df, spec).where("constraint = 'unique'")


INJECTED = """(SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'R') AS l_returnflag,
  CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS l_quantity,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  CAST(NULL AS BIGINT) AS l_empty FROM lineitem) AS t"""


def injected(df: DataFrame) -> DataFrame:
    """Nulls, NaN and an all-null column, which the given tables lack."""
    return df.select(
        "l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.lit(None).cast("bigint").alias("l_empty"),
    )


_nan = "isnan(l_quantity)"


@query("constraint_nan_null", report_of([
    rule_row(INJECTED, "l_quantity", "greater", "warning", "0", f"l_quantity <= 0 OR {_nan}"),
    rule_row(INJECTED, "l_quantity", "greater_equal", "error", "1", f"l_quantity < 1 OR {_nan}"),
    rule_row(INJECTED, "l_quantity", "less", "warning", "51", f"l_quantity >= 51 OR {_nan}"),
    rule_row(INJECTED, "l_quantity", "less_equal", "error", "50", f"l_quantity > 50 OR {_nan}"),
    rule_row(INJECTED, "l_quantity", "not_equal", "warning", "5", f"l_quantity = 5 AND NOT {_nan}"),
    rule_row(INJECTED, "l_extendedprice", "greater", "error", "2000", "l_extendedprice <= 2000"),
    rule_row(INJECTED, "l_returnflag", "allowed_values", "warning", "A,N",
             "coalesce(l_returnflag NOT IN ('A', 'N'), true)", evaluated="count(*)"),
    rule_row(INJECTED, "l_returnflag", "regex", "warning", "A", "NOT regexp_matches(l_returnflag, 'A')"),
    rule_row(INJECTED, "l_empty", "greater", "error", "10", "l_empty <= 10"),
    rule_row(INJECTED, "l_empty", "allowed_values", "error", "1,2", "coalesce(l_empty NOT IN (1, 2), true)", evaluated="count(*)"),
]))
def constraint_nan_null(spark, d):
    return constraint_report(spark, d, "lineitem", {
        "l_quantity": [rule("greater", "0"), rule("greater_equal", error="1"), rule("less", "51"),
                       rule("less_equal", error="50"), rule("not_equal", "5")],
        "l_extendedprice": [rule("greater", error="2000")],
        "l_returnflag": [rule("allowed_values", "A,N"), rule("regex", "A")],
        "l_empty": [rule("greater", error="10"), rule("allowed_values", error="1,2")],
    }, injected)


@query("constraint_nulls_allowed", report_of([
    rule_row(INJECTED, "l_returnflag", "allowed_values", "warning", "A", "l_returnflag <> 'A'"),
]))
def constraint_nulls_allowed(spark, d):
    df = injected(table(spark, d, "lineitem"))
    spec = spec_of(df, "lineitem").with_rules(l_returnflag=[rule("allowed_values", "A")])
    return run_checks(df, rule_checks(df, spec.field("l_returnflag"), nulls_allowed=True))


@query("constraint_disabled_blank", report_of([
    rule_row("lineitem", "l_quantity", "less_equal", "error", "49", "l_quantity > 49"),
    rule_row("lineitem", "l_tax", "greater", "warning", "0.01", "l_tax <= CAST(0.01 AS DOUBLE)"),
]))
def constraint_disabled_blank(spark, d):
    return constraint_report(spark, d, "lineitem", {
        "l_quantity": [rule("greater", "40", "45", enabled=False), rule("less_equal", "", "49"), rule("less", "", "")],
        "l_tax": [rule("greater", "0.01", "")],
        "l_orderkey": [],
    })


_TYPED = """(SELECT o_custkey, CAST(o_orderdate AS DATE) AS o_day, o_orderstatus = 'F' AS o_done,
  CAST(o_totalprice AS DECIMAL(18,2)) AS o_price, CAST(o_custkey % 100 AS SMALLINT) AS o_small, o_orderdate FROM orders) AS t"""


@query("constraint_literals", report_of([
    rule_row(_TYPED, "o_day", "greater", "warning", "1996-03-01", "o_day <= DATE '1996-03-01'"),
    rule_row(_TYPED, "o_done", "allowed_values", "warning", "true", "NOT o_done", evaluated="count(*)"),
    rule_row(_TYPED, "o_price", "less_equal", "warning", "250000.25", "o_price > 250000.25"),
    rule_row(_TYPED, "o_small", "multiple_of", "error", "10", "o_small % 10 <> 0"),
    rule_row(_TYPED, "o_small", "allowed_values", "warning", "1,2,3", "o_small NOT IN (1, 2, 3)", evaluated="count(*)"),
    rule_row(_TYPED, "o_orderdate", "not_equal", "warning", "1997-05-28T00:00:00", "o_orderdate = TIMESTAMP '1997-05-28'"),
]))
def constraint_literals(spark, d):
    return constraint_report(spark, d, "orders", {
        "o_day": [rule("greater", "1996-03-01")], "o_done": [rule("allowed_values", "true")],
        "o_price": [rule("less_equal", "250000.25")],
        "o_small": [rule("multiple_of", error="10"), rule("allowed_values", "1,2,3")],
        "o_orderdate": [rule("not_equal", "1997-05-28T00:00:00")],
    }, lambda df: df.select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("o_day"), (F.col("o_orderstatus") == "F").alias("o_done"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("o_price"), (F.col("o_custkey") % 100).cast("smallint").alias("o_small"),
        "o_orderdate"))


_LISTS = "(SELECT vec_id, embedding, list_min(embedding) AS lo, list_max(embedding) AS hi FROM embeddings)"


@query("list_elements", report_of(base_rows(_LISTS, ["vec_id", "embedding.list.element"], nulls={"embedding.list.element": "embedding"}) + [
    rule_row(_LISTS, "vec_id", "greater_equal", "error", "0", "vec_id < 0"),
    rule_row(_LISTS, "embedding", "less", "warning", "0.25", "hi >= CAST(0.25 AS FLOAT)").replace("'embedding' AS", "'embedding.list.element' AS"),
    rule_row(_LISTS, "embedding", "greater_equal", "error", "-1", "lo < -1").replace("'embedding' AS", "'embedding.list.element' AS"),
]))
def list_elements(spark, d):
    """Constraints on the values of a list hold if every value passes."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    spec = spec_of(df, "embeddings")
    return validate(df, spec.replace_field(spec.field("embedding.list.element").with_rules(
        rule("less", "0.25"), rule("greater_equal", error="-1"))).with_rules(vec_id=[rule("greater_equal", error="0")]))


# ---- column names, types, nulls -------------------------------------------------------------------

def names_query(label: str, change, present: tuple[str, ...], outcome: dict[str, tuple[int, str | None]], extra_null=None) -> None:
    @query(f"names_{label}", report_of(base_rows("orders", present, outcome)))
    def run(spark, d):
        df = table(spark, d, "orders")
        return validate(change(df), spec_of(df, "orders"))


_kept = tuple(c for c in ORDERS if c not in ("o_orderstatus", "o_totalprice"))
names_query("ok", lambda df: df, ORDERS, {"columns_validated": (0, None)})
names_query("order", lambda df: df.select(*reversed(df.columns)), ORDERS, {"column_order": (1, ",".join(reversed(ORDERS)))})
names_query("extra", lambda df: df.withColumn("more", F.lit(1)), ORDERS, {"extra_columns": (1, "more")})
names_query("missing", lambda df: df.select(*_kept), _kept, {"missing_columns": (2, "o_orderstatus,o_totalprice")})
names_query("different", lambda df: df.withColumnRenamed("o_totalprice", "price"),
            tuple(c for c in ORDERS if c != "o_totalprice"),
            {"different_columns": (2, "o_orderkey,o_custkey,o_orderstatus,price,o_orderdate,o_orderpriority"),
             "missing_columns": (2, "o_totalprice"), "extra_columns": (1, "price")})
names_query("mixed", lambda df: df.drop("o_totalprice").withColumns({"x1": F.lit(1), "x2": F.lit(2)}),
            tuple(c for c in ORDERS if c != "o_totalprice"),
            {"missing_columns": (2, "o_totalprice"), "extra_columns": (1, "x1,x2")})


@query("type_check", report_of(base_rows(
    "(SELECT *, CAST(NULL AS VARCHAR) AS dummy FROM orders)", ORDERS, types={
        "o_custkey": [("parquet_type", "int32:int64")], "o_orderdate": [("logical_type", "none:timestamp")],
        "o_orderstatus": [("parquet_type", "int64:byte_array"), ("logical_type", "none:string")]})))
def type_check(spark, d):
    df = table(spark, d, "orders")
    spec = spec_of(df, "orders")
    for column, pq_type, logical in (("o_custkey", "int32", "none"), ("o_orderdate", "int64", "none"), ("o_orderstatus", "int64", "none")):
        spec = spec.replace_field(replace(spec.field(column), pq_type=pq_type, logical_type=logical))
    return validate(df, spec)


_NULL_COLUMNS = ("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_empty")


@query("null_check", report_of(base_rows(INJECTED, _NULL_COLUMNS)))
def null_check(spark, d):
    df = injected(table(spark, d, "lineitem"))
    return validate(df, spec_of(df, "lineitem"))


# ---- roll-ups -------------------------------------------------------------------------------------

@query("report_rollup", f'SELECT "column", CAST(max(severity) AS INTEGER) AS column_level FROM ({LINEITEM_REPORT}) WHERE "column" IS NOT NULL GROUP BY 1')
def report_rollup(spark, d):
    return column_levels(validate_lineitem(spark, d))


@query("table_rollup", f"SELECT ingestion, CAST(max(severity) AS INTEGER) AS validated FROM ({MONTHLY_REPORT}) GROUP BY 1")
def table_rollup(spark, d):
    return table_level(validate_by_month(spark, d), ["ingestion"])


@query("findings", f"""SELECT "column", "check", "constraint", "level", "value", severity, status, evaluated,
  CASE WHEN status = 'Fail' THEN failed END AS failed, CASE WHEN status = 'Fail' THEN percent END AS percent
  FROM ({LINEITEM_REPORT}) WHERE "constraint" IS NOT NULL""")
def findings_table(spark, d):
    return findings(validate_lineitem(spark, d))


_INJECTED_REPORT = report_of(base_rows(INJECTED, _NULL_COLUMNS) + [
    rule_row(INJECTED, "l_quantity", "less", "warning", "51", f"l_quantity >= 51 OR {_nan}"),
    rule_row(INJECTED, "l_quantity", "less", "error", "40", f"l_quantity >= 40 OR {_nan}")])


@query("column_summary", f"""SELECT "column", CAST(max(severity) AS INTEGER) AS column_level,
  max(percent) FILTER (WHERE "check" = 'nulls') AS null_percent,
  count(*) FILTER (WHERE "check" = 'constraint' AND status = 'Fail') AS failed_constraints,
  max(CASE WHEN "column" IN ('l_orderkey', 'l_empty') THEN 'int64' WHEN "column" = 'l_linenumber' THEN 'int32'
       WHEN "column" = 'l_returnflag' THEN 'byte_array' ELSE 'double' END) AS pq_type,
  max(CASE WHEN "column" = 'l_returnflag' THEN 'string' ELSE 'none' END) AS logical_type
  FROM ({_INJECTED_REPORT}) WHERE "column" IS NOT NULL GROUP BY 1""")
def summary(spark, d):
    df = injected(table(spark, d, "lineitem"))
    spec = spec_of(df, "lineitem").with_rules(l_quantity=[rule("less", "51", "40")])
    return column_summary(validate(df, spec), spec)


# ---- tables and relations -------------------------------------------------------------------------

@query("table_constraints", report_of([
    check_row("orders", None, "table_constraint", "count(*)", "count(*) FILTER (WHERE NOT (o_totalprice > 1000 OR o_orderstatus <> 'O'))", 1,
              "expression", "warning", "o_totalprice > 1000 OR o_orderstatus <> 'O'"),
    check_row("orders", None, "table_constraint", "count(*)", "greatest(1000000000 - count(*), 0)", 1, "min_rows", "warning", "1000000000"),
    check_row("orders", None, "table_constraint", "count(*)", "greatest(count(*) - 10, 0)", 2, "max_rows", "error", "10"),
    check_row("(SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate)", None, "table_constraint",
              "sum(n)", "coalesce(sum(n) FILTER (WHERE n > 1), 0)", 2, "unique", "error", "o_custkey,o_orderdate"),
]))
def table_constraints(spark, d):
    df = table(spark, d, "orders")
    spec = replace(spec_of(df, "orders"), table_rules=(
        rule("expression", "o_totalprice > 1000 OR o_orderstatus <> 'O'"), rule("min_rows", "1000000000"),
        rule("max_rows", error=10), rule("unique", error="o_custkey,o_orderdate")))
    return validate(df, spec).where("check = 'table_constraint'")


@query("key_unique", """SELECT CAST(sum(n) AS BIGINT) AS evaluated, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS failed,
  count(*) FILTER (WHERE n > 1) AS repeated_values FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def key_unique(spark, d):
    return key_counts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated(spark, d):
    return repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_ORPHANED = "(SELECT CASE WHEN l_linenumber = 7 THEN l_orderkey + 1000000000 WHEN l_linenumber = 6 THEN NULL ELSE l_orderkey END AS k FROM lineitem)"


def _orphaned(df: DataFrame) -> DataFrame:
    line = F.col("l_linenumber")
    return df.withColumn("l_orderkey", F.when(line == 7, F.col("l_orderkey") + 1000000000).when(line != 6, F.col("l_orderkey")))


@query("referential_integrity", f"""SELECT count(k) AS evaluated,
  count(*) FILTER (WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = k)) AS failed,
  count(DISTINCT k) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = k)) AS orphan_keys FROM {_ORPHANED} AS t""")
def referential_integrity(spark, d):
    return reference_check(_orphaned(table(spark, d, "lineitem")), ["l_orderkey"], table(spark, d, "orders"), ["o_orderkey"])


@query("orphan_keys", f"SELECT k AS l_orderkey, count(*) AS rows FROM {_ORPHANED} AS t WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = k) GROUP BY 1")
def orphans(spark, d):
    return orphan_keys(_orphaned(table(spark, d, "lineitem")), ["l_orderkey"], table(spark, d, "orders"), ["o_orderkey"])


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_NATION = ("n_nationkey", "n_name", "n_regionkey")


def _tabled(name: str, rows: list[str]) -> list[str]:
    return [row.replace("SELECT ", f"SELECT '{name}' AS \"table\", ", 1) for row in rows]


def _key_row(name: str, key: str) -> str:
    counted = f"(SELECT count(*) AS n FROM {name} GROUP BY {key})"
    return check_row(counted, key, "key_unique", "sum(n)", "coalesce(sum(n) FILTER (WHERE n > 1), 0)", 2, level="error")


def _link_row(child: str, column: str, parent: str, key: str) -> str:
    missing = f"count(*) FILTER (WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {key} = {column}))"
    return check_row(child, column, "reference", f"count({column})", missing, 2, level="error", value=f"{parent}.{key}")


@query("relational_validate", report_of(
    _tabled("orders", base_rows("orders", ORDERS) + [_key_row("orders", "o_orderkey"), _link_row("orders", "o_custkey", "customer", "c_custkey")])
    + _tabled("customer", base_rows("customer", _CUSTOMER) + [
        rule_row("customer", "c_acctbal", "greater_equal", "warning", "0", "c_acctbal < 0"),
        _key_row("customer", "c_custkey"), _link_row("customer", "c_nationkey", "nation", "n_nationkey")])
    + _tabled("nation", base_rows("nation", _NATION) + [_key_row("nation", "n_nationkey")]), columns=["table"]))
def relational_validate(spark, d):
    frames = {name: table(spark, d, name) for name in ("orders", "customer", "nation")}
    specs = {name: spec_of(df, name) for name, df in frames.items()}
    specs["customer"] = specs["customer"].with_rules(c_acctbal=[rule("greater_equal", "0")])
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("nation", "n_nationkey")):
        specs[name] = specs[name].replace_field(specs[name].field(key).with_flags(is_key=True))
    document = Document("sales", "sales001", tuple(specs.values()), "Relational")
    return validate_relational(frames, document, {
        ("orders", "o_custkey"): ("customer", "c_custkey"), ("customer", "c_nationkey"): ("nation", "n_nationkey")})


_GOOD = "coalesce(l_quantity <= 49 AND NOT isnan(l_quantity), true) AND coalesce(l_returnflag IN ('A', 'N'), false) AND coalesce(l_extendedprice > 1000, true)"


@query("quarantine_split", f"""SELECT CASE WHEN {_GOOD} THEN 'accepted' ELSE 'rejected' END AS side, l_orderkey, l_linenumber, count(*) AS rows
  FROM {INJECTED} GROUP BY 1, 2, 3""")
def quarantine_split(spark, d):
    df = injected(table(spark, d, "lineitem"))
    spec = spec_of(df, "lineitem").with_rules(
        l_quantity=[rule("less_equal", "10", "49")], l_returnflag=[rule("allowed_values", error="A,N")],
        l_extendedprice=[rule("greater", error="1000")])
    accepted, rejected = split_rows(df, spec)
    both = accepted.withColumn("side", F.lit("accepted")).unionByName(rejected.withColumn("side", F.lit("rejected")))
    return both.groupBy("side", "l_orderkey", "l_linenumber").agg(F.count("*").alias("rows"))


@query("quarantine_mark", f"""SELECT {_GOOD} AS accepted, l_linenumber, count(*) AS rows FROM {INJECTED} GROUP BY 1, 2""")
def quarantine_mark(spark, d):
    df = injected(table(spark, d, "lineitem"))
    spec = spec_of(df, "lineitem").with_rules(
        l_quantity=[rule("less_equal", "10", "49")], l_returnflag=[rule("allowed_values", error="A,N")],
        l_extendedprice=[rule("greater", error="1000")])
    return mark_rows(df, spec).groupBy("accepted", "l_linenumber").agg(F.count("*").alias("rows"))


@query("unique_by_month", """SELECT ingestion, l_key AS "column", CAST(sum(n) AS BIGINT) AS evaluated,
  CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS failed FROM (
   SELECT strftime(l_shipdate, '%Y-%m') AS ingestion, 'l_orderkey' AS l_key, count(*) AS n FROM lineitem GROUP BY 1, 2, l_orderkey
   UNION ALL SELECT strftime(l_shipdate, '%Y-%m'), 'l_extendedprice', count(*) FROM lineitem GROUP BY 1, 2, l_extendedprice)
  GROUP BY 1, 2""")
def unique_by_month(spark, d):
    df = by_month(spark, d)
    spec = spec_of(df, "lineitem", ["ingestion"]).with_rules(
        l_orderkey=[rule("unique", "true")], l_extendedprice=[rule("unique", "true")])
    return validate(df, spec, by=["ingestion"]).where("constraint = 'unique'").select("ingestion", "column", "evaluated", "failed")
