"""Sources, schema documents, identifiers, deliveries."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.document import Document
from qualframe.functions.fingerprint import row_fingerprint
from qualframe.functions.transforms import FIRST_NAMES, LAST_NAMES, latlon_to_cell, miles_to_km, str_to_date, synthetic_name
from qualframe.functions.uid import DIGITS, decode_uid, encode_uid, uid_collisions, with_uid
from qualframe.functions.columns import clock_today, part_number
from qualframe.operators.profile import distinct_counts
from qualframe.operators.validate import NAME_SEVERITY, validate
from qualframe.plans.ingest import Dataset, row_counts, row_trend
from qualframe.plans.keys import KeyIndex
from qualframe.plans.relational_ingest import RelationalDataset
from qualframe.plans.sketches import DISTINCT_ERROR, RANK_ERROR, SketchHistory
from qualframe.queries.registry import query, spec_of, table
from qualframe.queries.validation import LINEITEM, MONTHLY_REPORT, by_month, lineitem_spec, rule
from qualframe.session import scratch_path
from qualframe.sources import catalog, files, footers, hashes, inference, metadata, reports
from qualframe.streaming.incremental import ingest_incremental, ingest_new_files, new_files
from qualframe.streaming.pieces import ingest_whole_deliveries


# ---- scans, sources, sinks ------------------------------------------------------------------------

@query("scan_schema_order", "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders")
def scan_schema_order(spark, d):
    return files.project(table(spark, d, "orders"), ["o_orderstatus", "o_orderkey", "o_totalprice"])


@query("preview20", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def preview20(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return files.preview(df, 20, [F.desc("o_totalprice"), "o_orderkey"])


_CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("csv_round_trip", _CUSTOMER)
def csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "customer").write.option("header", True).csv(path)
    return files.read_csv(spark, path)


@query("csv_to_parquet", _CUSTOMER)
def csv_to_parquet(spark, d):
    path = scratch_path(spark, "csv") + ".csv"
    table(spark, d, "customer").write.option("header", True).csv(path)
    return files.load_data(spark, path, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query("json_round_trip", _CUSTOMER)
def json_round_trip(spark, d):
    path = scratch_path(spark, "json")
    df = table(spark, d, "customer")
    df.write.json(path)
    return files.widened(files.read_json(spark, path, df.schema))


@query("xml_round_trip", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def xml_round_trip(spark, d):
    path = scratch_path(spark, "xml")
    files.write_xml(table(spark, d, "part"), path, "part", "parts")
    return files.read_xml(spark, path, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("publish_partitions", "SELECT strftime(o_orderdate, '%Y') AS ingestion, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def publish_partitions(spark, d):
    """Written twice, the second time only one year: dynamic overwrite keeps the others."""
    path = scratch_path(spark, "parts")
    df = table(spark, d, "orders").withColumn("ingestion", F.date_format("o_orderdate", "yyyy"))
    files.write_partitions(df, path)
    files.write_partitions(df.where("ingestion = '1997'"), path)
    back = spark.read.parquet(path).withColumn("ingestion", F.col("ingestion").cast("string"))
    return back.groupBy("ingestion").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("footprint")
def footprint(spark, d):
    return files.footprint(spark, {"parquet": f"{d}/lineitem.parquet"}, table(spark, d, "lineitem"))


@query("footprint_memory", "SELECT 'memory' AS kind, count(*) AS rows, CAST(11 AS INTEGER) AS columns FROM lineitem")
def footprint_memory(spark, d):
    found = files.footprint(spark, {"parquet": f"{d}/lineitem.parquet"}, table(spark, d, "lineitem"))
    return found.where("kind = 'memory' AND megabytes > 0").select("kind", "rows", "columns")


def _footer_sql(types: dict[str, tuple[str, str]]) -> str:
    def bound(side: str, column: str, pq: str, logical: str, slot: str) -> str:
        value = f"epoch_us({side}({column}))" if logical == "timestamp" else f"{side}({column})"
        kind = {"long": "BIGINT", "double": "DOUBLE", "text": "VARCHAR"}[slot]
        fits = slot == ("text" if pq == "byte_array" else "double" if pq == "double" else "long")
        return f"CAST({value if fits else 'NULL'} AS {kind}) AS {side}_{slot}"

    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({i} AS INTEGER) AS position, '{pq}' AS physical, '{logical}' AS logical, "
        f"CAST(1 AS BIGINT) AS types, count(*) AS rows, count(*) - count({c}) AS nulls, true AS complete, '{_ARROW[pq, logical]}' AS arrow_type, "
        + ", ".join(bound(side, c, pq, logical, slot) for slot in ("long", "double", "text") for side in ("min", "max"))
        + " FROM lineitem" for i, (c, (pq, logical)) in enumerate(types.items()))


_LINEITEM_TYPES = dict(zip(LINEITEM, [
    ("int64", "none"), ("int64", "none"), ("int64", "none"), ("int32", "none"), ("double", "none"), ("double", "none"),
    ("double", "none"), ("double", "none"), ("byte_array", "string"), ("byte_array", "string"), ("int64", "timestamp")]))


_ARROW = {("int64", "none"): "int64", ("int32", "none"): "int32", ("double", "none"): "double", ("byte_array", "string"): "string",
          ("int64", "timestamp"): "timestamp[us]"}


@query("footer_profile", _footer_sql(_LINEITEM_TYPES))
def footer_profile(spark, d):
    return footers.footer_profile(footers.footer_rows(spark, f"{d}/lineitem.parquet")).drop("row_groups")


@query("footer_profile_many_files", _footer_sql(_LINEITEM_TYPES))
def footer_profile_many_files(spark, d):
    """Several files with several row groups each give the same profile as one file with one."""
    path = scratch_path(spark, "rowgroups")
    table(spark, d, "lineitem").repartition("l_orderkey").write.option("parquet.block.size", 65536).parquet(path)
    return footers.footer_profile(footers.footer_rows(spark, path)).drop("row_groups")


_NUMERIC = [c for c, (pq, _) in _LINEITEM_TYPES.items() if pq in ("int64", "double")]


@query("minimal_schema", " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS raw_name, '{c}' AS display_name, '{pq}' AS pq_type, '{logical}' AS logical_type, "
    f"'raw' AS status, true AS is_raw, {str(pq in ('int64', 'double')).lower()} AS is_numeric" for i, (c, (pq, logical)) in enumerate(_LINEITEM_TYPES.items())))
def minimal_schema(spark, d):
    return inference.minimal_fields(footers.footer_profile(footers.footer_rows(spark, f"{d}/lineitem.parquet")), "lineitem").drop("uid")


def _bound_text(side: str, column: str) -> str:
    if column == "l_shipdate":
        return f"strftime({side}({column}), '%Y-%m-%dT%H:%M:%S')"
    zero = " + CAST(0 AS DOUBLE)" if _LINEITEM_TYPES[column][0] == "double" else ""  # -0.0 is written 0.0
    return f"CAST({side}({column}){zero} AS VARCHAR)"


_DEFAULTS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{name}' AS \"constraint\", 'warning' AS level, {_bound_text(side, c)} AS value, false AS enabled FROM lineitem"
    for c in _NUMERIC for name, side in (("greater_equal", "min"), ("less_equal", "max")))


@query("default_constraints", _DEFAULTS)
def default_constraints(spark, d):
    profile = footers.with_bounds(footers.footer_profile(footers.footer_rows(spark, f"{d}/lineitem.parquet")))
    return inference.default_constraints(profile)


@query("default_constraints_from_data", _DEFAULTS)
def default_constraints_from_data(spark, d):
    return inference.default_constraints(inference.data_bounds(table(spark, d, "lineitem")))


def _part(c: str) -> str:
    """A part of a hashed key: its length, a colon, its text."""
    return f"CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR)"


_PARTS = " || ".join(map(_part, ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))


@query("row_fingerprint", f"""SELECT strftime(o_orderdate, '%Y') AS ingestion, count(*) AS rows,
  CAST(sum(CAST(CAST('0x' || substr(md5({_PARTS}), 1, 15) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR) AS fingerprint
  FROM orders GROUP BY 1""")
def fingerprint(spark, d):
    df = table(spark, d, "orders").withColumn("ingestion", F.date_format("o_orderdate", "yyyy"))
    return row_fingerprint(df, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ["ingestion"], "md5")


@query("content_hash")
def content_hash(spark, d):
    return hashes.content_hashes(spark, d)


# ---- identifiers, transforms ----------------------------------------------------------------------

def _encoded(n: str) -> str:
    return " || ".join(f"substr('{DIGITS}', CAST(({n} // {62 ** k}) % 62 AS INTEGER) + 1, 1)" for k in range(7, -1, -1))


_WIDE = "(o_orderkey * 6661333777)"


@query("uid_encode", f"""SELECT o_orderkey, CASE WHEN {_WIDE} <= 99999999999999 THEN {_encoded(_WIDE)} END AS uid FROM orders""")
def uid_encode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", encode_uid(F.col("o_orderkey") * 6661333777).alias("uid"))


_TEXT = "CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority WHEN o_orderkey % 5 = 1 THEN 'zzzzzzzz' ELSE CAST(o_custkey AS VARCHAR) || o_orderstatus END"
_DECODED = " + ".join(f"(strpos('{DIGITS}', substr(lpad(t, 8, '1'), {i + 1}, 1)) - 1) * {62 ** (7 - i)}" for i in range(8))


@query("uid_decode", f"""SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[0-9A-Za-z]{{0,8}}') AND v <= 99999999999999 THEN v END AS number
  FROM (SELECT o_orderkey, t, CAST({_DECODED} AS BIGINT) AS v FROM (SELECT o_orderkey, {_TEXT} AS t FROM orders))""")
def uid_decode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", decode_uid(F.expr(_TEXT.replace("VARCHAR", "STRING"))).alias("number"))


_HASHED = f"(CAST('0x' || substr(md5({_part('o_orderkey')} || {_part('o_custkey')}), 1, 15) AS BIGINT) % 100000000000000)"


@query("uid_assign", f"SELECT o_orderkey, {_encoded('h')} AS uid FROM (SELECT o_orderkey, {_HASHED} AS h FROM orders)")
def uid_assign(spark, d):
    return with_uid(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], algorithm="md5").select("o_orderkey", "uid")


@query("uid_collisions", f"SELECT uid, count(*) AS keys FROM (SELECT DISTINCT o_custkey, {_encoded('o_custkey % 1000')} AS uid FROM orders) GROUP BY 1 HAVING count(*) > 1")
def collisions(spark, d):
    return uid_collisions(table(spark, d, "orders").withColumn("uid", encode_uid(F.col("o_custkey") % 1000)), ["o_custkey"])


_FIRST = "[" + ", ".join(f"'{n}'" for n in FIRST_NAMES) + "]"
_LAST = "[" + ", ".join(f"'{n}'" for n in LAST_NAMES) + "]"


@query("synthetic_names", f"""SELECT c_custkey, {_FIRST}[h % 20 + 1] || ' ' || {_LAST}[(h // 20) % 20 + 1] AS name FROM
  (SELECT c_custkey, CAST('0x' || substr(md5('1:7' || {_part('c_custkey')}), 1, 15) AS BIGINT) AS h FROM customer)""")
def synthetic_names(spark, d):
    """Names for every customer, through a Parquet file and back."""
    path = scratch_path(spark, "names")
    table(spark, d, "customer").select("c_custkey", synthetic_name(F.col("c_custkey"), 7, "md5").alias("name")).write.parquet(path)
    return spark.read.parquet(path)


@query("str_to_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def parse_dates(spark, d):
    as_text = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    day = F.date_format(str_to_date(as_text, "dd/MM/yyyy"), "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"))


@query("miles_to_km", "SELECT event_id, value * CAST(1.609344 AS DOUBLE) AS km FROM events")
def kilometres(spark, d):
    return table(spark, d, "events").select("event_id", miles_to_km(F.col("value")).alias("km"))


@query("grid_cell", """SELECT cell, count(*) AS rows FROM (SELECT CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN
  CAST(CAST(floor((lat + 90.0::DOUBLE) / 5.0::DOUBLE) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor((lon + 180.0::DOUBLE) / 5.0::DOUBLE) AS BIGINT) AS VARCHAR) END AS cell
  FROM (SELECT c_acctbal / 100.0::DOUBLE AS lat, CAST(c_custkey % 400 - 200 AS DOUBLE) AS lon FROM customer)) GROUP BY 1""")
def grid_cell(spark, d):
    cell = latlon_to_cell(F.col("c_acctbal") / 100.0, (F.col("c_custkey") % 400 - 200).cast("double"), 5.0)
    return table(spark, d, "customer").groupBy(cell.alias("cell")).agg(F.count("*").alias("rows"))


@query("text_helpers", """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_partkey < 1000 THEN lpad(CAST(l_partkey AS VARCHAR), 4, '0') ELSE CAST(l_partkey AS VARCHAR) END AS part, true AS clock FROM lineitem""")
def text_helpers(spark, d):
    clock = F.concat_ws(":", F.col("l_linenumber"), F.lit("05"), F.lit("9"))
    fits = F.date_format(clock_today(clock), "H:mm:s") == F.concat_ws(":", F.col("l_linenumber"), F.lit("05"), F.lit("9"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", part_number(F.col("l_partkey")).alias("part"), fits.alias("clock"))


# ---- schema documents, metadata -------------------------------------------------------------------

def part_documents(spark, d) -> DataFrame:
    """One small schema document per part, some with faults that follow from the part's columns."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rules = F.array(F.struct(
        F.when(size % 6 == 0, F.lit("is_nice")).when(size % 6 == 1, F.lit("regex")).otherwise(F.lit("less")).alias("name"),
        F.create_map(F.lit("warning"), F.lit("5")).alias("values"), F.when(size % 9 != 0, F.lit(True)).alias("enabled")))
    pq_type = F.when(size % 4 == 0, F.lit("byte_array")).when(size % 4 == 1, F.lit("boolean")).otherwise(F.lit("int64"))
    field = lambda uid: F.struct(
        F.struct(uid.alias("uid"), F.when(size % 10 != 3, F.col("p_name")).alias("raw_name")).alias("names"),
        F.struct(pq_type.alias("pq_type"), F.lit("none").alias("logical_type")).alias("types"), rules.alias("constraints"))
    same = F.lit("aaaaaaaa")
    dataset = F.struct(
        F.when(size % 7 != 0, F.col("p_brand")).alias("name"),
        F.when(size % 11 == 0, F.lit("Cube")).otherwise(F.lit("Tabular")).alias("datatype"),
        F.concat_ws("-", F.col("p_brand"), F.col("p_type")).alias("uid"))
    table_data = F.struct(F.when(size % 13 != 0, F.col("p_brand")).alias("name"), F.lit("cccccccc").alias("uid"))
    status = F.struct(F.when(size % 8 != 0, F.lit("raw")).alias("status"))
    model = F.struct(status.alias("status"), table_data.alias("table_data"), F.array(field(same), field(F.when(size % 5 == 0, same).otherwise(F.lit("bbbbbbbb")))).alias("fields"))
    text = F.to_json(F.struct(dataset.alias("dataset"), model.alias("model")))
    broken = F.when(k % 50 == 0, F.lit("{not json")).otherwise(text)
    return table(spark, d, "part").select(k.cast("string").alias("document"), broken.alias("text"))


_OK = "p_partkey % 50 <> 0"
_BROKEN_DOCUMENTS = f"""
  SELECT 'not_readable' AS issue, NULL AS detail, 1 AS times FROM part WHERE NOT ({_OK})
  UNION ALL SELECT 'missing', 'dataset.' || u, 1 FROM part, (VALUES ('name'), ('datatype'), ('uid')) AS v(u) WHERE NOT ({_OK})
  UNION ALL SELECT 'missing', 'model', 1 FROM part WHERE NOT ({_OK})
  UNION ALL SELECT 'missing', 'dataset.name', 1 FROM part WHERE {_OK} AND p_size % 7 = 0
  UNION ALL SELECT 'missing', 'model.table_data.name', 1 FROM part WHERE {_OK} AND p_size % 13 = 0
  UNION ALL SELECT 'missing', 'model.status.status', 1 FROM part WHERE {_OK} AND p_size % 8 = 0
  UNION ALL SELECT 'unknown_datatype', 'Cube', 1 FROM part WHERE {_OK} AND p_size % 11 = 0
  UNION ALL SELECT 'duplicate_field_uid', NULL, 1 FROM part WHERE {_OK} AND p_size % 5 = 0
  UNION ALL SELECT 'duplicate_raw_name', NULL, 1 FROM part WHERE {_OK} AND p_size % 10 <> 3
  UNION ALL SELECT 'missing', 'names.raw_name', 2 FROM part WHERE {_OK} AND p_size % 10 = 3
  UNION ALL SELECT 'missing', 'constraints.enabled', 2 FROM part WHERE {_OK} AND p_size % 9 = 0
  UNION ALL SELECT 'unknown_constraint', 'is_nice', 2 FROM part WHERE {_OK} AND p_size % 6 = 0
  UNION ALL SELECT 'constraint_not_applicable', 'regex', 2 FROM part WHERE {_OK} AND p_size % 6 = 1 AND p_size % 4 <> 0
  UNION ALL SELECT 'constraint_not_applicable', 'less', 2 FROM part WHERE {_OK} AND p_size % 6 > 1 AND p_size % 4 = 1
  UNION ALL SELECT 'duplicate_dataset_uid', p_brand || '-' || p_type, 1 FROM part WHERE {_OK} GROUP BY p_brand, p_type HAVING count(*) > 1"""


@query("catalog_lint", f"SELECT issue, detail, CAST(sum(times) AS BIGINT) AS findings FROM ({_BROKEN_DOCUMENTS}) GROUP BY 1, 2")
def catalog_lint(spark, d):
    found = catalog.lint_documents(part_documents(spark, d))
    return found.groupBy("issue", "detail").agg(F.count("*").alias("findings"))


_REGISTRY = {
    "int64": "greater greater_equal less less_equal not_equal multiple_of unique", "date": "",
    "byte_array": "greater greater_equal less less_equal not_equal multiple_of unique min_length max_length format regex allowed_values",
}
_TYPE_OF = "CASE p_size % 3 WHEN 0 THEN 'int64' WHEN 1 THEN 'byte_array' ELSE 'date' END"
_APPLIES = " UNION ALL ".join(f"SELECT '{t}' AS pq_type, '{c}' AS constraint" for t, cs in _REGISTRY.items() for c in cs.split())


@query("type_constraints", f"""SELECT "constraint", count(*) AS parts FROM (
   SELECT p_partkey, "constraint" FROM part JOIN ({_APPLIES.replace(' AS constraint', ' AS "constraint"')}) ON pq_type = {_TYPE_OF}
   UNION SELECT p_partkey, 'allowed_values' FROM part WHERE p_size % 2 = 0) GROUP BY 1""")
def type_constraints(spark, d):
    fields = table(spark, d, "part").select(
        "p_partkey", F.expr(_TYPE_OF).alias("pq_type"), F.when(F.col("p_size") % 2 == 0, F.lit("is_categorical")).alias("flag"))
    return inference.type_constraints(fields, ["pq_type", "flag"], ["p_partkey"]).groupBy("constraint").agg(F.count("*").alias("parts"))


def described_orders(spark, d) -> DataFrame:
    df = table(spark, d, "orders")
    df = metadata.set_column_metadata(df, "o_totalprice", "names", {"description_short": "first"})
    df = metadata.set_column_metadata(df, "o_totalprice", "names", {"description_short": "price", "description_long": "price in full"})
    df = metadata.set_column_metadata(df, "o_totalprice", "constraints", [{"name": "less"}])
    return metadata.set_column_metadata(df, "o_custkey", "flags", {"is_join": True})


_DESCRIBED = """SELECT * FROM (VALUES ('o_totalprice', 'names', '{"description_long": "price in full", "description_short": "price"}'),
  ('o_totalprice', 'constraints', '[{"name": "less"}]'), ('o_custkey', 'flags', '{"is_join": true}')) AS v("column", section, json)"""


@query("metadata_round_trip", f"SELECT count(*) AS rows, round(avg(o_totalprice), 4) AS price, 'price' AS short, 'price in full' AS long FROM orders")
def metadata_round_trip(spark, d):
    path = scratch_path(spark, "described")
    described_orders(spark, d).write.parquet(path)
    back = spark.read.parquet(path)
    names = metadata.read_column_metadata(back, "o_totalprice", "names")
    return back.agg(F.count("*").alias("rows"), F.round(F.avg("o_totalprice"), 4).alias("price"),
                    F.lit(names["description_short"]).alias("short"), F.lit(names["description_long"]).alias("long"))


@query("metadata_harvest", f"""SELECT v.*, r.rows FROM ({_DESCRIBED}) AS v, (SELECT count(*) AS rows FROM (SELECT DISTINCT strftime(o_orderdate, '%Y') FROM orders)) AS r""")
def metadata_harvest(spark, d):
    """One file per order year; every file's footer gives its column metadata."""
    path = scratch_path(spark, "harvest")
    df = described_orders(spark, d)
    df = metadata.keep_metadata(df.withColumn("year", F.date_format("o_orderdate", "yyyy")), df)
    df.write.partitionBy("year").parquet(path)
    found = footers.harvest_metadata(spark, path)
    year = F.regexp_extract("path", "/year=([0-9]+)/", 1)
    return found.groupBy("column", "section", "json").agg(F.count_distinct(year).alias("rows"))


@query("harvested_documents", """SELECT strftime(o_orderdate, '%Y') AS year, CAST(2 AS BIGINT) AS columns, 'o_custkey,o_totalprice' AS names
  FROM orders GROUP BY 1""")
def harvested(spark, d):
    """The documents put together from the footers of one folder per order year; every file of a folder says the same."""
    path = scratch_path(spark, "harvest")
    df = described_orders(spark, d)
    df = metadata.keep_metadata(df.withColumn("year", F.date_format("o_orderdate", "yyyy")), df)
    df.write.partitionBy("year").parquet(path)
    found = footers.harvested_documents(footers.harvest_metadata(spark, path))
    names = F.from_json("fields", "array<struct<column: string>>")
    return found.select(F.regexp_extract("path", "/year=([0-9]+)/", 1).alias("year"), "columns",
                        F.array_join(F.transform(names, lambda f: f["column"]), ",").alias("names")).distinct()


# ---- deliveries -----------------------------------------------------------------------------------

def month_dataset(spark, d) -> tuple[Dataset, DataFrame]:
    """Every February with a line of 50 pieces breaks a rule at error level; the other months pass with warnings."""
    df = by_month(spark, d)
    spec = replace(lineitem_spec(df), table_rules=(rule("expression", error="month(l_shipdate) <> 2 OR l_quantity < 50"),))
    document = Document("lineitem", "lineitm1", (spec,))
    return Dataset(spark, scratch_path(spark, "lineitem"), document), df


_LEVELS = """SELECT strftime(l_shipdate, '%Y-%m') AS ingestion, count(*) AS rows,
  CASE WHEN count(*) FILTER (WHERE month(l_shipdate) = 2 AND l_quantity >= 50) > 0 THEN 'rejected' ELSE 'accepted' END AS status FROM lineitem GROUP BY 1"""


@query("ingest_batch", f"""SELECT ingestion, rows, status, CASE WHEN status = 'accepted'
  THEN 10 * row_number() OVER (PARTITION BY status ORDER BY ingestion) END AS part_no, CAST(11 AS INTEGER) AS columns,
  CASE WHEN status = 'accepted' THEN 'part_' || lpad(CAST(10 * row_number() OVER (PARTITION BY status ORDER BY ingestion) AS VARCHAR), 4, '0') || '_' || ingestion || '_lineitm1_' END AS part_name
  FROM ({_LEVELS})""")
def ingest_batch(spark, d):
    dataset, df = month_dataset(spark, d)
    added = dataset.ingest(df)
    return added.select("ingestion", "rows", "status", "part_no", "columns", F.regexp_replace("part_name", "_[^_]*$", "_").alias("part_name"))


@query("gate", f"""SELECT l.ingestion, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM
  (SELECT *, strftime(l_shipdate, '%Y-%m') AS ingestion FROM lineitem) AS l JOIN ({_LEVELS}) AS s ON l.ingestion = s.ingestion AND status = 'accepted' GROUP BY 1""")
def gate(spark, d):
    """What a reader of the dataset finds: the accepted deliveries and nothing else."""
    dataset, df = month_dataset(spark, d)
    dataset.ingest(df)
    return dataset.read().groupBy("ingestion").agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("keys"))


@query("history_latest", f"SELECT ingestion, rows, status, CAST(CASE WHEN status = 'accepted' AND ingestion LIKE '1995%' THEN 2 ELSE 1 END AS BIGINT) AS attempt FROM ({_LEVELS})")
def history_latest(spark, d):
    """The accepted months of 1995 are delivered again; of every month the newest attempt counts."""
    dataset, df = month_dataset(spark, d)
    first = dataset.ingest(df, time="2026-01-01 00:00:00")
    again = [r.ingestion for r in first.where("status = 'accepted' AND ingestion LIKE '1995%'").select("ingestion").collect()]
    dataset.ingest(df, only=again, time="2026-01-02 00:00:00")
    attempt = F.when(F.col("ingest_time") == "2026-01-02 00:00:00", 2).otherwise(1).cast("bigint")
    return dataset.history().select("ingestion", "rows", "status", attempt.alias("attempt"))


@query("listing", f"SELECT ingestion, CAST(CASE WHEN status = 'rejected' THEN 2 ELSE 1 END AS INTEGER) AS validated, status, rows, CAST(11 AS INTEGER) AS columns FROM ({_LEVELS})")
def listing(spark, d):
    dataset, df = month_dataset(spark, d)
    dataset.ingest(df)
    return dataset.listing().drop("uid", "ingest_time")


@query("row_trend", """SELECT row_number() OVER (ORDER BY ingestion) AS x, ingestion, rows, rows - lag(rows) OVER (ORDER BY ingestion) AS change
  FROM (SELECT strftime(l_shipdate, '%Y-%m') AS ingestion, count(*) AS rows FROM lineitem GROUP BY 1)""")
def trend(spark, d):
    return row_trend(row_counts(by_month(spark, d)))


@query("report_history", f"""SELECT ingestion, CAST(max(severity) AS INTEGER) AS validated, count(*) AS checks, CAST(sum(failed) AS BIGINT) AS failed FROM ({MONTHLY_REPORT}) GROUP BY 1""")
def report_history(spark, d):
    """Reports as they are kept and read back."""
    df = by_month(spark, d)
    dataset = Dataset(spark, scratch_path(spark, "reports"), Document("lineitem", "lineitm1", (lineitem_spec(df),)))
    dataset.ingest(df)
    return dataset.reports().groupBy("ingestion").agg(
        F.max("severity").alias("validated"), F.count("*").alias("checks"), F.sum("failed").alias("failed"))


_FAULTS = """SELECT event_id % 5 AS k, count(*) AS n FROM events GROUP BY 1"""


@query("ingest_checked_files", f"""SELECT 'events_' || k AS ingestion, n AS rows, CASE WHEN k IN (1, 3) THEN 'rejected' ELSE 'accepted' END AS status,
  CASE k WHEN 1 THEN 'missing_columns' WHEN 2 THEN 'extra_columns' WHEN 4 THEN 'column_order' ELSE 'columns_validated' END AS names,
  CASE k WHEN 3 THEN 1 ELSE 0 END::BIGINT AS wrong_types, CASE WHEN k IN (1, 3) THEN 0 ELSE n END::BIGINT AS published FROM ({_FAULTS})""")
def checked_files(spark, d):
    """Deliveries of several files each: fine, without a column, with one more, with another type, in another order."""
    dataset, source = _faulty_deliveries(spark, d)
    dataset.ingest_files(source, r"^(\w+)-")
    return _delivered(dataset)


@query("stream_checked_files", f"""SELECT 'events_' || k AS ingestion, n AS rows, CASE WHEN k IN (1, 3) THEN 'rejected' ELSE 'accepted' END AS status,
  CASE k WHEN 1 THEN 'missing_columns' WHEN 2 THEN 'extra_columns' WHEN 4 THEN 'column_order' ELSE 'columns_validated' END AS names,
  CASE k WHEN 3 THEN 1 ELSE 0 END::BIGINT AS wrong_types, CASE WHEN k IN (1, 3) THEN 0 ELSE n END::BIGINT AS published FROM ({_FAULTS})""")
def streamed_files(spark, d):
    """The same as they arrive, in batches that cut deliveries in two."""
    dataset, source = _faulty_deliveries(spark, d)
    ingest_new_files(dataset, source, scratch_path(spark, "stream"), r"^(\w+)-", files_per_batch=7).awaitTermination()
    return _delivered(dataset)


def _faulty_deliveries(spark, d):
    events = table(spark, d, "events")
    source = scratch_path(spark, "deliveries")
    spec = spec_of(events, "events")
    for k in range(5):
        part = events.where(F.col("event_id") % 5 == k)
        part = {1: part.drop("value"), 2: part.withColumn("x", F.lit(1)), 3: part.withColumn("user_id", F.col("user_id").cast("int")),
                4: part.select(*reversed(part.columns))}.get(k, part)
        folder = scratch_path(spark, "staging")
        part.repartition(2, "event_id").write.parquet(folder)
        for i, row in enumerate(files.list_files(spark, folder, "*.parquet").orderBy("path").collect()):  # two files
            copy_file(spark, row.path, f"{source}/events_{k}-{i}.parquet")
    return Dataset(spark, scratch_path(spark, "events"), Document("events", "events01", (spec,))), source


def _delivered(dataset):
    history = dataset.history().select("ingestion", "uid", "rows", "status")
    report = dataset.reports().join(history.select("uid"), "uid", "left_semi")
    named = report.where(F.col("check").isin(*NAME_SEVERITY)).select("ingestion", F.col("check").alias("names"))
    wrong = report.groupBy("ingestion").agg(F.count_if(F.col("check") == "parquet_type").alias("wrong_types"))
    read = dataset.read().groupBy("ingestion").agg(F.count("*").alias("n"))
    return history.join(named, "ingestion").join(wrong, "ingestion").join(read, "ingestion", "left").select(
        "ingestion", "rows", "status", "names", "wrong_types", F.coalesce("n", F.lit(0)).alias("published"))


_SHOP = """WITH o AS (SELECT CASE WHEN o_orderkey % 97 = 0 AND o_custkey % 4 = 2 THEN o_custkey + 100000000 ELSE o_custkey END AS o_custkey,
    CAST(CASE WHEN o_custkey % 4 = 3 THEN 4 + o_orderkey % 2 ELSE o_custkey % 4 END AS VARCHAR) AS ingestion, o_orderkey % 2 AS late FROM orders),
  c AS (SELECT c_custkey, CAST(c_custkey % 4 AS VARCHAR) AS ingestion FROM customer),
  first AS (SELECT ingestion, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.c_custkey = o.o_custkey AND c.ingestion = o.ingestion)) AS failed
    FROM o WHERE ingestion IN ('0', '1', '2') GROUP BY 1),
  own AS (SELECT ingestion, count(*) AS n FROM (SELECT ingestion FROM c UNION ALL SELECT ingestion FROM o) GROUP BY 1)"""


@query("ingest_relational", f"""{_SHOP} SELECT own.ingestion, own.n AS rows, CASE WHEN own.ingestion IN ('3', '4') THEN 'accepted'
    WHEN own.ingestion = '5' THEN 'rejected' WHEN coalesce(failed, 0) > 0 THEN 'rejected' ELSE 'accepted' END AS status,
  CASE WHEN own.ingestion = '5' THEN (SELECT count(*) FROM o WHERE ingestion = '5') ELSE coalesce(failed, 0) END::BIGINT AS orphans,
  CASE WHEN own.ingestion = '5' OR coalesce(failed, 0) > 0 THEN 0 ELSE own.n END::BIGINT AS visible FROM own LEFT JOIN first USING (ingestion)""")
def ingest_relational(spark, d):
    """Customers and orders in deliveries: some with an orphan, one that refers to published customers, one to customers that were refused."""
    customer = table(spark, d, "customer").select("c_custkey", "c_name").withColumn("ingestion", (F.col("c_custkey") % 4).cast("string"))
    key = F.when((F.col("o_orderkey") % 97 == 0) & (F.col("o_custkey") % 4 == 2), F.col("o_custkey") + 100_000_000).otherwise(F.col("o_custkey"))
    late = 4 + F.col("o_orderkey") % 2
    orders = table(spark, d, "orders").select(
        "o_orderkey", key.alias("o_custkey"), F.when(F.col("o_custkey") % 4 == 3, late).otherwise(F.col("o_custkey") % 4).cast("string").alias("ingestion"))
    dataset = RelationalDataset(spark, scratch_path(spark, "shop"), Document("shop", "shop0001", (
        spec_of(customer, "customer", ["ingestion"]), spec_of(orders, "orders", ["ingestion"])), "Relational"),
        links={("orders", "o_custkey"): ("customer", "c_custkey")})
    dataset.ingest_tables({"customer": customer, "orders": orders.where("ingestion IN ('0', '1', '2')")})
    # Delivery 4 refers to the customers of 3. Of 5 all keys are moved to customers nobody has.
    moved = F.when(F.col("ingestion") == "5", F.col("o_custkey") + 200_000_000).otherwise(F.col("o_custkey"))
    dataset.ingest_tables({"customer": customer.limit(0), "orders": orders.where("ingestion IN ('4', '5')").withColumn("o_custkey", moved)})
    seen = dataset.read_table("customer").select("ingestion").unionAll(dataset.read_table("orders").select("ingestion"))
    orphans = dataset.reports().where("check = 'reference'").groupBy("ingestion").agg(F.sum("failed").alias("orphans"))
    return dataset.history().select("ingestion", "rows", "status").join(orphans, "ingestion", "left").join(
        seen.groupBy("ingestion").agg(F.count("*").alias("visible")), "ingestion", "left").select(
        "ingestion", "rows", "status", F.coalesce("orphans", F.lit(0)).alias("orphans"), F.coalesce("visible", F.lit(0)).alias("visible"))


_TWICE = """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS ingestion FROM orders),
  all_ AS (SELECT * FROM o UNION ALL SELECT o_orderkey, CAST(CAST(ingestion AS INTEGER) + 3 AS VARCHAR) FROM o WHERE o_orderkey % 50 = 0 AND ingestion <= '1995')"""


@query("keys_across_deliveries", f"""{_TWICE} SELECT o_orderkey, ingestion, count(*) AS rows,
    CAST(sum(count(*)) OVER (PARTITION BY o_orderkey) - count(*) AS BIGINT) AS elsewhere FROM all_ GROUP BY 1, 2
  QUALIFY ingestion > '1995' AND sum(count(*)) OVER (PARTITION BY o_orderkey) > 1""")
def keys_across_deliveries(spark, d):
    """Orders up to 1995 are published; some of them come again three years later, and the index of keys finds them."""
    dataset, first, second = _orders_twice(spark, d)
    dataset.ingest(first)
    index = KeyIndex(dataset, ["o_orderkey"])
    index.refresh()
    return index.repeated(second)


@query("ingest_unique_keys", f"""{_TWICE}, n AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS copies FROM all_)
  SELECT ingestion, count(*) AS rows, CASE WHEN ingestion > '1995' AND max(copies) > 1 THEN 'rejected' ELSE 'accepted' END AS status FROM n GROUP BY 1""")
def ingest_unique_keys(spark, d):
    """A delivery with a key that is published already is refused."""
    dataset, first, second = _orders_twice(spark, d)
    dataset.ingest(first)
    dataset.ingest(second)
    return dataset.history().select("ingestion", "rows", "status")


def _orders_twice(spark, d):
    orders = table(spark, d, "orders").withColumn("ingestion", F.date_format("o_orderdate", "yyyy"))
    copies = orders.where("o_orderkey % 50 = 0 AND ingestion <= '1995'").withColumn("ingestion", (F.col("ingestion").cast("int") + 3).cast("string"))
    whole = orders.unionByName(copies)
    spec = spec_of(orders, "orders", ["ingestion"])
    spec = spec.replace_field(spec.field("o_orderkey").with_flags(is_key=True))
    dataset = Dataset(spark, scratch_path(spark, "orders"), Document("orders", "orders01", (spec,)), unique_keys=True)
    return dataset, orders.where("ingestion <= '1995'"), whole.where("ingestion > '1995'")


_SKETCHED = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")


@query("history_sketches", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS \"distinct\", true AS distinct_within, true AS ranks_within FROM lineitem" for c in _SKETCHED))
def history_sketches(spark, d):
    """Sketches of monthly deliveries, united: whether distinct values and quantiles are within the stated error of exact figures."""
    df = by_month(spark, d).select("ingestion", *_SKETCHED)
    dataset = Dataset(spark, scratch_path(spark, "lineitem"), Document("lineitem", "lineitm1", (spec_of(df, "lineitem", ["ingestion"]),)))
    dataset.ingest(df)
    history = SketchHistory(dataset)
    history.refresh()
    found = history.profile([0.25, 0.5, 0.9])
    exact = distinct_counts(df, list(_SKETCHED))
    asked = {row["column"]: row.quantiles for row in found.collect() if row.quantiles}  # a row per column
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if c == "l_shipdate" else F.col(c).cast("double")
    # The rank of a quantile is anywhere between the rows below it and those up to it.
    near = [F.struct(F.lit(c).alias("c"), reduce(lambda a, b: a & b, [
        (F.count_if(number(c) < v) / F.count("*") <= q + 2 * RANK_ERROR) & (F.count_if(number(c) <= v) / F.count("*") >= q - 2 * RANK_ERROR)
        for q, v in quantiles.items()]).alias("ok")) for c, quantiles in asked.items()]
    ranks = df.agg(F.array(*near).alias("r")).select(F.inline("r"))
    off = F.abs(found["distinct"] - exact["distinct"]) <= 4 * DISTINCT_ERROR * exact["distinct"]
    return found.join(exact, "column").join(ranks, F.col("column") == F.col("c"), "left").select(
        "column", found["rows"], exact["distinct"], off.alias("distinct_within"), F.coalesce("ok", F.lit(True)).alias("ranks_within"))


@query("report_json", f"""SELECT ingestion, CAST(max(severity) AS INTEGER) AS validated, CAST(count(DISTINCT coalesce("column", '-')) AS INTEGER) AS columns,
  CAST(sum(failed) AS BIGINT) AS failed FROM ({MONTHLY_REPORT}) GROUP BY 1""")
def report_json(spark, d):
    """The JSON texts, written, read and parsed again."""
    df = by_month(spark, d)
    path = scratch_path(spark, "json")
    reports.write_report_json(validate(df, lineitem_spec(df), by=["ingestion"]), path)
    ddl = "validated INT, columns ARRAY<STRUCT<column: STRING, checks: ARRAY<STRUCT<failed: BIGINT>>>>"
    parsed = spark.read.text(path).select(F.col("ingestion").cast("string"), F.from_json("value", ddl).alias("r"))
    failed = F.aggregate("r.columns", F.lit(0).cast("bigint"), lambda total, c: total + F.aggregate(
        c["checks"], F.lit(0).cast("bigint"), lambda t, check: t + check["failed"]))
    return parsed.select("ingestion", "r.validated", F.size("r.columns").alias("columns"), failed.alias("failed"))


@query("ingest_incremental", """SELECT 'events_' || CAST(event_id % 3 AS VARCHAR) AS ingestion, count(*) AS rows, 'accepted' AS status,
  CAST(CASE WHEN max(value) > 100 THEN 1 ELSE 0 END AS INTEGER) AS validated FROM events GROUP BY event_id % 3""")
def incremental(spark, d):
    """Two files arrive and are taken in, then a third; the stream's checkpoint knows the first two."""
    events = table(spark, d, "events")
    source, state = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    spec = spec_of(events, "events").with_rules(value=[rule("less_equal", "100")])
    dataset = Dataset(spark, scratch_path(spark, "events"), Document("events", "events01", (spec,)))

    def arrive(number: int) -> None:
        part = events.where(F.col("event_id") % 3 == number)
        folder = f"{scratch_path(spark, 'staging')}/events_{number}.parquet"
        part.write.parquet(folder)
        for i, row in enumerate(files.list_files(spark, folder, "*.parquet").orderBy("path").collect()):
            copy_file(spark, row.path, f"{source}/events_{number}-{i}.parquet")

    for arrivals in ((0, 1), (2,)):
        for number in arrivals:
            arrive(number)
        stream = new_files(dataset, source, events.schema, r"^(\w+)-")
        ingest_incremental(dataset, stream, state).awaitTermination()
    return dataset.history().select("ingestion", "rows", "status", "validated")


@query("ingest_in_pieces", """SELECT 'events_' || CAST(event_id % 3 AS VARCHAR) AS ingestion, count(*) AS rows, 'accepted' AS status, CAST(1 AS BIGINT) AS attempts
  FROM events WHERE event_id % 3 < 2 GROUP BY event_id % 3""")
def ingest_in_pieces(spark, d):
    """Three deliveries of three files each arrive over three triggers; the last file of one of them never comes."""
    events = table(spark, d, "events")
    source, state = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    dataset = Dataset(spark, scratch_path(spark, "events"), Document("events", "events01", (spec_of(events, "events"),)))
    staged = scratch_path(spark, "staging")
    piece = F.struct((F.col("event_id") % 3).alias("k"), (F.floor(F.col("event_id") / 3) % 3).alias("i"))
    events.withColumn("p", piece).select("*", "p.*").drop("p").repartition(9, "k", "i").write.partitionBy("i", "k").parquet(staged)
    for i in range(3):
        for k in range(3 if i < 2 else 2):
            (row,) = files.list_files(spark, f"{staged}/i={i}/k={k}", "*.parquet").collect()
            copy_file(spark, row.path, f"{source}/events_{k}-{i}-of-3.parquet")
        ingest_whole_deliveries(dataset, source, state, r"^(\w+)-", r"-of-(\d+)").awaitTermination()
    return dataset.manifest().groupBy("ingestion", "rows", "status").agg(F.count("*").alias("attempts"))


def copy_file(spark, old: str, new: str) -> None:
    """Put one file where a stream looks for it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    a, b = hadoop.Path(old), hadoop.Path(new)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
