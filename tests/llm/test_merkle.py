"""The manifest against a tree of hashes built row by row in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from qualframe.llm import merkle, queries

DDL = "doc_id bigint, lang string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    """A tree from its leaves up."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    found = []
    for nodes in tree[:-1]:
        other = at ^ 1
        found.append(("R" if other > at else "L", nodes[other]) if other < len(nodes) else None)
        at //= 2
    return found


def expected(rows):
    groups = {}
    for doc_id, lang, text in rows:
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, digest(field(doc_id) + field(lang) + field(text)), doc_id))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda r: r[:3])]) for g in langs}
    top, out = levels([trees[g][-1][0] for g in langs]), []
    for i, g in enumerate(langs):
        for at, (_, _, leaf, doc_id) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            out.append((doc_id, g, leaf, siblings(trees[g], at) + siblings(top, i), trees[g][-1][0], top[-1][0]))
    return out


def plain(found):
    side = lambda s: (chr(s[0]), s[1:].hex()) if s else None
    return [(r.doc_id, r.lang, r.leaf.hex(), [side(s) for s in r.segment], r.subroot.hex(), r.root.hex()) for r in found]


def check(spark, rows, ddl=DDL):
    frame = spark.createDataFrame(rows, ddl).repartition(3)
    found = merkle.manifest(frame, ["doc_id", "lang", "text"])
    assert sorted(map(repr, plain(found.collect()))) == sorted(map(repr, expected([r[:3] for r in rows])))
    assert found.where(merkle.fold(F.col("leaf"), F.col("segment")) != F.col("root")).count() == 0


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (5, 1, 2), (257, 256, 255), (700, 9, 1, 64)])
def test_trees_of_any_size(spark, sizes):
    check(spark, [(i * 37 % 1_009, f"l{g}", f"text {i} ü") for g, n in enumerate(sizes) for i in range(n)])


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, None, None), (None, None, "x"), (None, "", ""), (1, "", "b"), (1, "", "b"), (1, "", "a"), (5, "é", "x" * 300_000), (5, "z", "ü"), (6, "Z", None)]
    check(spark, [r + ("t", 3, ["p"]) for r in rows], DDL + ", tree string, at int, segment array<string>")
    assert merkle.manifest(spark.createDataFrame([], DDL), ["doc_id", "text"]).count() == 0


def test_many_groups_and_one_that_holds_most_rows(spark):
    check(spark, [(i, f"g{i % 90:02}", "t") for i in range(180)] + [(i, "hot", "same") for i in range(3_000)])


def test_ancestors_may_be_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SENT_BYTES", -1)
    monkeypatch.setattr(merkle, "SENT", -1)
    check(spark, [(i, (None, "a", "b")[i % 3], f"{i}") for i in range(1_000)])


def test_a_changed_row_or_sibling_does_not_verify(spark):
    found = merkle.manifest(spark.createDataFrame([(i, "en", f"{i}") for i in range(50)], DDL), ["doc_id", "text"], carry=["text"])
    changed = merkle.leaf([F.col("doc_id"), F.concat("text", F.lit("!"))])
    assert found.where(merkle.fold(changed, F.col("segment")) == F.col("root")).count() == 0
    shifted = F.concat(F.slice("segment", 2, 100), F.slice("segment", 1, 1))
    assert found.where(merkle.fold(F.col("leaf"), shifted) == F.col("root")).count() == 0


def test_query_changes_rows_whose_checksum_seven_divides(spark, data):
    import zlib

    found = queries.op11_merkle_manifest(spark, data).collect()
    assert {r.doc_id: r.verified for r in found} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 != 0 for r in found}
    rows = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(r.leaf == digest("".join(field(rows[r.doc_id][c]) for c in queries.LEAF)) for r in found) and len(found) == len(rows)
