"""Every stage of the pipeline against plain Python over its own input; the registered queries of this part."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from check_queries import compare, connection
from qualframe.llm import packing, quality, queries, toxicity
from test_line_dedup import brute as line_classes
from test_near_dedup import brute as near_components
from test_quality import expected as measures


@pytest.fixture(scope="module")
def stages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], data).cache())
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "line_dedup", "minhash_dedup", "packing"]
    for before, after in zip(stages, stages[1:-1]):
        assert after.schema.names == before.schema.names and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_quality_stage(stages):
    kept = set(texts(stages[1]))
    for doc, text in texts(stages[0]).items():
        words, chars, symbols, _, _, repeated = measures(text)
        good = words >= 50 and 100 * repeated <= 50 * words and chars <= 12 * words and 10 * symbols <= words
        assert (doc in kept) == good


def test_toxicity_stage(spark, data, stages):
    model = queries.toxicity_model(spark, data)
    scores = {r.doc_id: r.score for r in toxicity.score(stages[1], model).collect()}
    assert set(texts(stages[2])) == {d for d, s in scores.items() if s < toxicity.THRESHOLD}


def test_line_stage(stages):
    rows = sorted(texts(stages[2]).items())
    first = line_classes(rows)
    wanted = {}
    for doc, text in rows:
        lines = text.split("\n")
        rest = "\n".join(line for at, line in enumerate(lines) if first.get((doc, at), (doc, at)) == (doc, at))
        if measures(rest)[0] >= 50:
            wanted[doc] = rest
    assert texts(stages[3]) == wanted
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_near_stage(stages):
    rows = list(texts(stages[3]).items())
    components = near_components(rows)
    assert set(texts(stages[4])) == {d for d, c in components.items() if d == c}


def test_near_stage_keeps_repeated_rows_and_rows_without_id_once(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (2, text(3)), (3, text(3)), (None, text(3)), (None, text(4)), (None, text(4)), (None, text(5)),
            (4, text(4)), (5, text(6)), (5, text(6)), (6, None), (6, None), (7, ""), (8, text(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    found = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(
        [(1, text(1)), (1, text(2)), (2, text(3)), (4, text(4)), (None, text(5)), (5, text(6)), (6, None), (7, ""), (8, text(7))], key=str)


def test_near_copies_go_before_they_are_packed(spark):
    """Copies with some edited words: what the line stage leaves of them is too little to stay."""
    line = lambda i, k: " ".join(f"w{i}n{k}v{j}" for j in range(9)) + "."
    whole = [[line(i, k) for k in range(20)] for i in range(10)]
    copies = [[*lines[:3], lines[3] + " and something more than an edit here", *lines[4:]] for lines in whole]
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "s", 0) for i, t in enumerate(whole + copies)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rest = corpus_pipeline.without_near_copies(spark, corpus_pipeline.without_repeated_lines(spark, docs, ""), "")
    assert sorted(r.doc_id for r in rest.select("doc_id").collect()) == list(range(10))


def test_packing_stage(stages):
    assert sum(r.length for r in stages[5].collect()) == sum(r.doc_tokens for r in stages[5].where("start = 0").collect())
    assert {r.doc_id for r in stages[5].collect()} == set(texts(stages[4]))


def test_run_gives_what_the_stages_give(spark, data, stages):
    columns = ["doc_id", "start", "length", "ids_crc32"]
    found = corpus_pipeline.run(spark, data).select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stages[5].select(*columns).collect()))


def test_stages_take_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0


def test_registered_queries(spark, data):
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_points.queries()
    documents = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op2_byte_bpe", "op4_minhash_dedup", "op5_license_scan", "op6_toxicity", "op9_language_id", "op10_byte_shards"):
        assert entry_points.queries()[name](spark, data).count() == documents
    assert quality.DEFAULT_POLICY in quality.POLICIES and packing.WINDOW == 2048


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    matches, message = compare(spark, connection(data), data, name)
    assert matches, message


def test_pipeline_keeps_clean_documents(spark, stages, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1 AND toxic = 0")
    clean = stages[1].join(labels, "doc_id")
    assert clean.join(stages[2].select("doc_id"), "doc_id", "left_anti").count() <= 0.02 * clean.count()
    assert stages[0].where(F.col("text").isNull()).count() == 0
