"""Language identification, toxicity and licences against plain Python, and by held-out accuracy."""

import math
import re
from decimal import Decimal
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from qualframe.llm import language, licenses, toxicity

PIECES = language.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


# ---- language ------------------------------------------------------------------------------------------

PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
NAMES = {PROCESSOR.id_to_piece(i).lower() for i in range(PROCESSOR.get_piece_size())
         if not (PROCESSOR.is_control(i) or PROCESSOR.is_unknown(i) or PROCESSOR.is_byte(i))}
LONG = ["▁universidad", "▁representation", "▁agriculture", "▁" + "donaudampfschifffahrtsgesellschaftskapitän" * 2, "▁" + "x" * 200, "▁" + "the北京representation" * 40]


def number(piece):
    """The piece's own number; that of the unknown for a character that is none; nothing for other strings."""
    if piece in NAMES:
        return int(PIECES.pieces(language._codes([piece]))[len(piece) - 1][0, 0])
    return PIECES.size if len(piece) == 1 else None


def summed(word, weight):
    """Sums over the segmentations of every beginning of a word, in numbers that do not underflow."""
    sums = [Decimal(1)]
    for end in range(1, len(word) + 1):
        found = [(k, number(word[k:end])) for k in range(end)]
        sums.append(sum((sums[k] * Decimal(float(weight[i])) for k, i in found if i is not None), Decimal(0)))
    return sums


def test_every_piece_of_the_vocabulary_is_used():
    assert PIECES.size == len(NAMES) and PIECES.longest == max(map(len, NAMES)) > 10
    assert all(number(piece) >= 0 for piece in NAMES if len(piece) > 10)


@pytest.mark.parametrize("word", ["a", "▁the", "▁house", "▁zqx", "▁naïve", "北京", *LONG])
def test_sums_count_all_segmentations(word):
    weights = np.random.default_rng(1).random((PIECES.size + 1, 2)) / 100
    before = [summed(word, weights[:, column]) for column in (0, 1)]
    codes, ends = language._codes([word.ljust(len(word) + 5, "\0")]), np.array([len(word)])
    pieces = PIECES.pieces(codes)
    assert np.allclose(language.scores_of(pieces, weights, ends)[0], [float(b[-1].ln()) for b in before])
    after = [Decimal(0)] * len(word) + [Decimal(1)]
    for start in range(len(word) - 1, -1, -1):
        found = [(end, number(word[start:end])) for end in range(start + 1, len(word) + 1)]
        after[start] = sum((Decimal(float(weights[i, 0])) * after[end] for end, i in found if i is not None), Decimal(0))
    wanted = np.zeros(PIECES.size + 1)
    for start in range(len(word)):
        for end in range(start + 1, len(word) + 1):
            if (i := number(word[start:end])) is not None:
                wanted[i] += float(before[0][start] * Decimal(float(weights[i, 0])) * after[end] / after[0])
    assert np.allclose(language.expected(pieces, weights[:, :1], np.ones((1, 1)), ends)[:, 0], wanted)


def test_lots_of_words_are_scored_as_each_alone():
    weights = np.random.default_rng(2).random((PIECES.size + 1, 3)) / 50
    words = [w[1:] for w in LONG] + ["a", "bc", "representations", "x" * 24, "y" * 23, "z" * 25, "a" * 31, "b" * 32, "c" * 33]
    found = np.zeros((len(words), 3))
    for owners, codes, ends in language._by_length(words):
        found[owners] = language.scores_of(PIECES.pieces(codes), weights, ends)
    alone = [language.scores_of(PIECES.pieces(language._codes(["▁" + w])), weights, np.array([len(w) + 1]))[0] for w in words]
    assert np.allclose(found, alone)


def test_languages_of_held_out_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = language.identify(docs, language.learn(docs.where(~language.in_part(docs["doc_id"], 5, 0))))
    held_out = docs.where(language.in_part(docs["doc_id"], 5, 0)).join(found, "doc_id")
    row = held_out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score"), F.max("score")).first()
    assert row.right >= 0.95 and 0 <= row[1] <= row[2] <= 1


def test_texts_without_letters_and_without_training(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 ... \n", None), (None, "hello there", "en"), (5, "guten tag " * 20_000, "de"),
            (5, "guten tag " * 20_000, "de"), (6, "x" * 5_000, "en"), (7, "²", None)]
    docs = spark.createDataFrame([(i, t, g, 0.0) for i, t, g in rows], "doc_id bigint, text string, lang string, score double")
    found = sorted(map(tuple, language.identify(docs, language.learn(docs)).collect()), key=str)
    assert len(found) == len(rows)
    assert [r[1] for r in found if r[0] in (1, 2, 3, 7)] == ["und"] * 4 and [r[1] for r in found if r[0] == 5] == ["de", "de"]
    assert all(math.isfinite(r[2]) for r in found)
    model = language.learn(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(docs.limit(0), language.learn(docs)).count() == 0


def test_equal_scores_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "b"), (2, "alpha beta", "a")], "doc_id bigint, text string, lang string")
    found = language.identify(docs, language.learn(docs)).collect()
    assert [(r.lang_pred, round(r.score, 6)) for r in found] == [("a", 0.5)] * 2


# ---- toxicity ------------------------------------------------------------------------------------------

def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    return docs, labels


def corpus(biased=False):
    rng = np.random.default_rng(5)
    words = [f"word{i:03}" for i in range(300)]
    rows = []
    for k in range(600):
        text, toxic = list(rng.choice(words, 20)), k % 5 == 0
        if toxic:
            text[3] = rng.choice(["horrid", "vile", "nasty"])
        if biased and (toxic or k % 5 == 1 and k % 10 == 1):
            text[7] = "muslims" if toxic else "christians"
        rows.append((" ".join(text), int(toxic)))
    return rows


def test_learns_what_marks_toxic_texts(spark):
    docs, labels = labelled(spark, corpus())
    model = toxicity.fit(*toxicity.sample_features(docs, labels.where("doc_id % 4 <> 2")))
    scored = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in scored if r.doc_id % 4 == 2)


def test_swapped_identities_score_alike(spark, monkeypatch):
    docs, labels = labelled(spark, corpus(biased=True))
    neutral = spark.createDataFrame([(0, "muslims met at the market"), (1, "christians met at the market")], "doc_id bigint, text string")

    def gap(strength):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", strength)
        scores = {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.fit(*toxicity.sample_features(docs, labels))).collect()}
        return abs(scores[0] - scores[1]), max(scores.values())

    loose, held = gap(0.0), gap(5.0)
    assert held[0] < loose[0] / 3 and held[1] < toxicity.THRESHOLD


def test_swapping():
    assert toxicity.swapped({"the", "women"}) == {"the", "men"}
    assert toxicity.swapped({"nothing", "here"}) is None


def test_toxicity_edges(spark):
    rows = [(1, None), (2, ""), (None, "vile"), (3, "vile " * 50_000), (3, "vile")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string")
    train, labels = labelled(spark, corpus())
    found = toxicity.score(docs, toxicity.fit(*toxicity.sample_features(train, labels))).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert {r.score >= toxicity.THRESHOLD for r in found if r.text and "vile" in r.text} == {True}
    for kept in (labels.limit(0), labels.where("toxic = 0"), labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(*toxicity.sample_features(train, kept))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.Model({}, -1.0)).count() == 0


# ---- licences ------------------------------------------------------------------------------------------

def brute_licences(rows):
    """Own licence of each text by cosine with every notice, line by line."""
    split = lambda t: re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", (t or "").lower())
    vocabulary = {t for _, n in licenses.NOTICES for t in split(n)}
    df = {t: sum(t in split(x) for _, x, _ in rows) for t in vocabulary}
    idf = lambda t: math.log((1 + len(rows)) / (1 + df.get(t, 0))) + 1

    def vector(text):
        words = split(text)
        found = {t: words.count(t) * idf(t) for t in words}
        norm = math.sqrt(sum(v * v for v in found.values()))
        return {t: v / norm for t, v in found.items()}

    notices = [(name, vector(n)) for name, n in licenses.NOTICES]
    out = {}
    for key, text, _ in rows:
        best = None
        for at, line in enumerate((text or "").split("\n")):
            v = vector(line) if split(line) else {}
            for name, notice in notices:
                score = round(sum(v.get(t, 0) * w for t, w in notice.items()), 6)
                if score >= licenses.SIMILAR and (best is None or (-score, at, name) < best):
                    best = (-score, at, name)
        out[key] = best and (best[2], best[1], -best[0])
    return out


ROWS = [(1, "Released under the MIT License.", "a"), (2, "plain prose about nothing", "a/b/c"), (3, "text\nLicensed under the Apache License, Version 2.0.\n" + "w " * 40, "a"),
        (4, "licensed under the apache license version 2.0 today", "z"), (5, None, "a/b"), (6, "", None), (7, "All rights reserved.", "a/b"),
        (8, "all public code is in the form of a version", "a"), (9, "more prose", "ab"), (10, "Licensed under CC BY-SA 4.0.\nx", "q"),
        (11, "no\n" * 30_000 + "All rights reserved", "z")]


def test_own_licences_match_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id bigint, text string, dir string, license string")
    found = {r.doc_id: r for r in licenses.scan(docs, F.col("dir")).collect()}
    wanted = brute_licences(ROWS)
    assert set(found) == {r[0] for r in ROWS}
    for key, best in wanted.items():
        row = found[key]
        assert (row.origin == "own") == bool(best)
        if best:
            assert (row.license, row.line) == best[:2] and row.score == pytest.approx(best[2], abs=2e-6)


def test_licences_come_from_the_nearest_directory(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, dir string")
    found = {r.doc_id: (r.license, r.origin, r.from_directory) for r in licenses.scan(docs, F.col("dir")).collect()}
    assert found[2] == ("proprietary", "inherited", "a/b") and found[5] == ("proprietary", "inherited", "a/b")
    assert found[8] == ("MIT", "inherited", "a") and found[9] == (None, "none", None) and found[6] == (None, "none", None)
    root = docs.unionByName(spark.createDataFrame([(20, "Released under the MIT License.", None)], docs.schema))
    assert {r.doc_id: r.license for r in licenses.scan(root, F.col("dir")).collect()}[9] == "MIT"
    twice = licenses.scan(docs.unionByName(docs), F.col("dir")).collect()
    assert len(twice) == 2 * len(ROWS) and licenses.scan(docs.limit(0), F.col("dir")).count() == 0


GPL = ("/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
       " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main() {}")
INSIDE = [(1, "Copyright (c) 2020 Acme Inc. All rights reserved.", ("proprietary", 0)),
          (2, "intro\nThis file is part of Foo. Released under the MIT License.", ("MIT", 1)),
          (3, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ("Apache-2.0", 0)),
          (4, "The text of this page was written by the project team and is Licensed under CC BY 4.0.", ("CC-BY-4.0", 0)),
          (5, GPL, ("GPL-3.0", 0)), (6, GPL.replace("3", "2"), ("GPL-2.0", 0)),
          (7, "some words first, then Released under\nthe MIT\nLicense and many more words after it in the line", ("MIT", 0)),
          (8, "we all have rights and a version of a free licence, reserved for later", None), (None, "It is long. " * 500 + "All rights reserved. " + "So it is. " * 500, ("proprietary", 0))]


def test_notices_inside_lines_and_across_them_are_found(spark):
    docs = spark.createDataFrame([(d, t, f"d{i}") for i, (d, t, _) in enumerate(INSIDE)], "doc_id bigint, text string, dir string")
    found = {r.doc_id: r for r in licenses.scan(docs.repartition(3), F.col("dir")).collect()}
    for doc, _, wanted in INSIDE:
        assert (found[doc].license, found[doc].line) == (wanted or (None, None))
        assert found[doc].origin == ("own" if wanted else "none")
    assert all(found[d].score == 1 for d in (1, 2, 3, 4, 5, 6, 7, None))


MIT_TEXT = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""


def test_full_texts_are_licence_files(spark):
    folder = Path(licenses.__file__).with_name("texts")
    files = [("m", MIT_TEXT)] + [(f.stem, f.read_text()) for f in sorted(folder.glob("*.txt"))]
    rows = [(i, t, d) for i, (d, t) in enumerate(files)] + [(100 + i, "plain prose about nothing", f"{d}/src") for i, (d, _) in enumerate(files)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string, dir string").repartition(3), F.col("dir")).collect()}
    for i, (d, _) in enumerate(files):
        wanted = "MIT" if d == "m" else d
        assert (found[i].license, found[i].origin, found[i].line) == (wanted, "own", 0)
        assert (found[100 + i].license, found[100 + i].origin, found[100 + i].from_directory) == (wanted, "inherited", d)


def test_cues_are_enough():
    vectors = [(0, "x", {"a": 0.9, "b": math.sqrt(1 - 0.81)}), (1, "y", {"c": math.sqrt(0.5), "d": math.sqrt(0.5)})]
    assert licenses.cues(vectors, 0.75) == ["a", "c"]
    assert licenses.cues(vectors, 0.5) == ["a", "c", "d"]


def test_features_of_lists():
    lists = pa.chunked_array([pa.array([[1, 2], [], [3]])]).combine_chunks()
    at, owner = toxicity._flat(lists)
    assert at.tolist() == [1, 2, 3] and owner.tolist() == [0, 0, 2]
