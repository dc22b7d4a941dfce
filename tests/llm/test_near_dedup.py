"""Near duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest

from qualframe.llm import near_dedup
from qualframe.llm.components import components


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def closure(nodes, links):
    group = {n: n for n in nodes}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        group[high] = low
    return {n: root(n) for n in nodes}


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return closure({i for i, _ in sets}, links)


def families(seed, groups, copies, words=60, edits=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, groups, copies", [(1, 40, 3), (2, 2, 60), (3, 1, 150)])
def test_components_match_brute_force(spark, seed, groups, copies):
    rows = families(seed, groups, copies)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    wanted = brute(rows)
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert all(r.kept == (r.component_id == r.doc_id) and r.n_shingles == len(shingle_set(dict(rows)[r.doc_id])) for r in found)


def test_edges(spark):
    text = "One two THREE four five six seven"
    rows = [(9, text), (3, text.lower()), (5, None), (6, ""), (7, " \n\t"), (8, "a b"), (2, "A  B"), (4, "b a"), (11, "é b"), (12, "É b"),
            (None, text), (9, text), (20, "w " * 40_000), (21, "w " * 30_000), (30, "alpha beta gamma delta epsilon zeta"), (9, "other words than above here now")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, component string, n int")
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    wanted = brute(rows)
    for r in found:
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (wanted[r.doc_id], wanted[r.doc_id] == r.doc_id))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_shingles_do_not_depend_on_the_words_seen_before():
    known = near_dedup.Words()
    a = near_dedup.shingles("a b c d e f", known)
    near_dedup.shingles("z y x w v", known)
    assert (a == near_dedup.shingles("A B\tc d e  f", near_dedup.Words())).all() and len(a) == 2
    assert len(near_dedup.shingles("w " * 5_000, known)) == 1


def test_subkeys_agree_with_a_plain_minimum():
    found = near_dedup.shingles(" ".join(map(str, range(3_000))), near_dedup.Words())
    least = ((found[:, None] ^ near_dedup._MASKS) * near_dedup._FACTORS).min(axis=0)
    folded = np.zeros(2 * near_dedup.SUBKEYS, np.uint64)
    for hashes in least.reshape(-1, near_dedup.HASHES).T:
        folded = near_dedup._mixed(folded * np.uint64(31) + hashes)
    assert (near_dedup.subkeys(found).view(np.uint64) == folded + np.arange(len(folded), dtype=np.uint64)).all()


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i, 99) for i in range(50)],
                                   [(5, 3), (3, 5), (9, 8), (8, 7), (7, 5), (20, 21)]])
def test_components_of_chains_and_stars(spark, links):
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.id: r.component for r in components(frame).collect()} == closure(nodes, [(a, b) for a, b in links if a != b])
