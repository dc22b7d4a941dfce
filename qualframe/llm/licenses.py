"""Licence scans: TF-IDF cosine of lines and passages to licence notices, and inheritance along directories.

The weight of a notice's terms comes from the number of documents that have them, over all documents. A line is compared with every
notice by the cosine of their sparse vectors; words no notice has count as the rarest. Only lines that can reach ``SIMILAR`` are
compared: of each notice the heaviest terms are cues, as many as it takes that a line without any of them cannot reach it.

A notice inside a longer line, or broken over lines, is found in a passage: as many terms as the notice has, across line breaks, around one of
its cues and beginning with one of its terms. Terms count at least once each in a passage's length, which bounds the cosine from above;
passages that pass the bound are compared exactly. A line that matches as a whole is one notice, whatever passages lie inside it.

Documents are compared as a whole with the full texts of licences (``texts/``), by the same cosine with weights of their own terms. Creative
Commons texts besides CC0 are not among them.

A document whose whole text is that of a licence has that licence, at line 0, and is a licence file. Otherwise a document's own licence is its
best line or passage, at the line where that begins. A document of which at least half the terms are those of
licence lines or notice terms of passages is a licence file of its directory. Others take
the licence of the nearest directory above them that has such a file: each distinct directory is joined by path with the directories
that have one, so a directory with a third of all documents is one row there.

Defined results: a null text has no licence; a null path is the root; ties go to the first line, then to the first identifier; of several
files in one directory the best score counts, then the first identifier; rows with the same key and text are one document, given
once for each row; an empty table gives no rows; other columns are dropped.
DataFrame and SQL functions only.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.llm.common import let, stored

SIMILAR = 0.75
FILE_SHARE = 0.5
TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"

# Notices as licences ask for them in the header of a work. Fixed values.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _notice_terms(text: str) -> Counter:
    return Counter(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower()))


def weights(docs: DataFrame, text: str = "text") -> tuple[dict[str, float], float]:
    """Inverse document frequency of each notice term, and that of a term nobody has. As many numbers as notices have terms."""
    vocabulary = sorted({t for _, notice in NOTICES for t in _notice_terms(notice)})
    found = F.array_intersect(terms_of(docs[f"`{text}`"]), F.array(*[F.lit(t) for t in vocabulary]))
    counted = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    df = {r["term"]: r["n"] for r in counted}
    total = df.get("", 0)  # the empty term stands for every document
    return {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in vocabulary}, math.log(1 + total) + 1


def _vectors(idf: dict[str, float]) -> list[tuple[int, str, dict[str, float]]]:
    """Notices as unit vectors."""
    out = []
    for number, (licence, notice) in enumerate(NOTICES):
        vector = {t: n * idf[t] for t, n in _notice_terms(notice).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        out.append((number, licence, {t: v / norm for t, v in vector.items()}))
    return out


def cues(vectors: list[tuple[int, str, dict[str, float]]], similar: float = SIMILAR) -> list[str]:
    """Terms of which a line must have one: without a notice's cues, the rest of its unit vector is shorter than ``similar``."""
    out = set()
    for _, _, vector in vectors:
        left = 1.0
        for term, weight in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if left < similar ** 2 * (1 - 1e-9):
                break
            out.add(term)
            left -= weight * weight
    return sorted(out)


def _hits(docs: DataFrame, key: str, text: str, cue: Column) -> DataFrame:
    body = docs[f"`{text}`"]
    return docs.select(docs[f"`{key}`"].alias("key"), F.xxhash64(body).alias("body"), body.alias("text"), F.size(terms_of(body)).alias("n_terms")).where(F.arrays_overlap(terms_of(body), cue))


def _map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[x for t in sorted(pairs) for x in (F.lit(t), pairs[t] if isinstance(pairs[t], Column) else F.lit(pairs[t]))])


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR,
             known: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """Passages with a licence: ``key``, ``body``, ``n_terms``, ``line`` and ``last_line``, ``license``, ``score`` and ``spots`` (place and line of
    each notice term)."""
    idf, rarest = known or weights(docs, text)
    vectors = _vectors(idf)
    length = {number: sum(_notice_terms(NOTICES[number][1]).values()) for number, _, _ in vectors}
    longest = max(length.values())
    own = {number: cues([(number, licence, v)], similar) for number, licence, v in vectors}
    asked = {t: F.array(*[F.struct(F.lit(number).alias("number"), F.lit(length[number]).alias("length")) for number in sorted(own) if t in own[number]])
             for t in cues(vectors, similar)}
    cue = F.array(*[F.lit(t) for t in sorted(asked)])
    idf_of, of_notice = _map(idf), F.array(*[_map(v) for _, _, v in vectors])
    zero = F.lit(0.0)
    at = F.flatten(F.transform(F.split("text", "\n", -1), lambda body, line: F.transform(terms_of(body), lambda t: F.struct(line.alias("line"), t.alias("term")))))

    def around(at: Column) -> Column:
        """Each cue with the terms that a passage with it can have; ``left`` of them before it."""
        places = F.filter(F.transform(at, lambda x, i: F.struct(i.alias("place"), x["term"].alias("term"))), lambda x: F.array_contains(cue, x["term"]))
        first = lambda x: F.greatest(x["place"] - (longest - 1), F.lit(0))
        return F.transform(places, lambda x: F.struct(
            x["place"].alias("place"), x["term"].alias("term"), (x["place"] - first(x)).alias("left"),
            F.slice(at, first(x) + 1, F.lit(2 * longest - 1)).alias("near")))

    found = _hits(docs, key, text, cue).select("key", "body", "n_terms", F.inline(let(at, around)))
    each = found.select("key", "body", "n_terms", "place", "left", "near", F.inline(F.element_at(_map(asked), F.col("term"))))
    before = F.least(F.col("left"), F.col("length") - 1)
    each = each.select("key", "body", "n_terms", "number", "length", before.alias("before"), (F.col("place") - before).alias("from"),
                       F.slice("near", F.col("left") - before + 1, before + F.col("length")).alias("near"))

    def weighed(x: Column, place: Column) -> Column:
        w = F.coalesce(F.try_element_at(idf_of, x["term"]), F.lit(rarest))
        return F.struct((F.col("from") + place).alias("place"), x["line"].alias("line"), x["term"].alias("term"), (w * w).alias("square"),
                        F.coalesce(w * F.try_element_at(F.element_at(of_notice, F.col("number") + 1), x["term"]), zero).alias("dot"))

    def total(rows: Column, of) -> Column:
        return F.aggregate(rows, zero, lambda sofar, x: sofar + of(x))

    def likely(near: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.col("before")), lambda s: F.get(near, s)["dot"] > 0)
        cut = F.transform(starts, lambda s: F.slice(near, s + 1, F.col("length")))
        return F.filter(cut, lambda p: F.pow(total(p, lambda x: x["dot"]), F.lit(2.0)) >= similar ** 2 * (1 - 1e-6) * total(p, lambda x: x["square"]))

    cut = each.select("key", "body", "n_terms", "number", F.explode(let(F.transform("near", weighed), likely)).alias("p"))
    norm = total(F.col("p"), lambda x: x["square"] * F.size(F.filter("p", lambda y: y["term"] == x["term"])))
    license_of = F.element_at(F.array(*[F.lit(licence) for _, licence, _ in vectors]), F.col("number") + 1)
    spots = F.transform(F.filter("p", lambda x: x["dot"] > 0), lambda x: F.struct(x["place"].alias("place"), x["line"].alias("line")))
    scored = cut.select("key", "body", "n_terms", F.element_at("p", 1)["line"].alias("line"), F.element_at("p", -1)["line"].alias("last_line"),
                        license_of.alias("license"), F.round(total(F.col("p"), lambda x: x["dot"]) / F.sqrt(norm), 6).alias("score"), spots.alias("spots"))
    return scored.where(F.col("score") >= similar)


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR,
            known: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """Lines with a licence: ``key``, ``body`` (hash of the text), ``n_terms`` (of the text), ``line`` (from 0), ``words``,
    ``license`` and ``score``."""
    idf, rarest = known or weights(docs, text)
    vectors = _vectors(idf)
    cue = F.array(*[F.lit(t) for t in cues(vectors, similar)])
    hit = _hits(docs, key, text, cue)
    lines = hit.select("key", "body", "n_terms", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("terms", terms_of(F.col("text")))
    words = lines.where(F.arrays_overlap("terms", cue)).select("key", "body", "n_terms", "line", F.explode("terms").alias("term"))
    counted = words.groupBy("key", "body", "n_terms", "line", "term").agg(F.count("*").alias("n"))
    # As many entries as notices have terms.
    idf_of = F.create_map(*[F.lit(x) for pair in sorted(idf.items()) for x in pair])
    entries = {t: [F.struct(F.lit(number).alias("number"), F.lit(v[t]).alias("w")) for number, _, v in vectors if t in v] for t in idf}
    postings = F.create_map(*[x for t in sorted(entries) for x in (F.lit(t), F.array(*entries[t]))])
    weighted = counted.withColumn("weight", F.col("n") * F.coalesce(F.try_element_at(idf_of, F.col("term")), F.lit(rarest)))
    lengths = weighted.groupBy("key", "body", "n_terms", "line").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"), F.sum("n").alias("words"),
                                                          F.collect_list(F.struct("term", "weight")).alias("vector"))
    products = lengths.select("key", "body", "n_terms", "line", "norm", "words", F.explode("vector").alias("x")).select(
        "key", "body", "n_terms", "line", "norm", "words", "x.weight", F.inline(F.try_element_at(postings, F.col("x.term"))))
    scores = products.groupBy("key", "body", "n_terms", "line", "norm", "words", "number").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    license_of = F.element_at(F.array(*[F.lit(licence) for _, licence, _ in vectors]), F.col("number") + 1)
    scored = scores.select("key", "body", "n_terms", "line", "words", license_of.alias("license"), F.round(F.col("dot") / F.sqrt("norm"), 6).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("down"), "license"))
    return scored.where(F.col("score") >= similar).groupBy("key", "body", "n_terms", "line", "words").agg(best.alias("b")).select(
        "key", "body", "n_terms", "line", "words", "b.license", (-F.col("b.down")).alias("score"))


def full_texts() -> list[tuple[str, Counter]]:
    """Licences by name, with the terms of their texts."""
    return [(file.stem, _notice_terms(file.read_text(encoding="utf-8"))) for file in sorted(Path(__file__).with_name("texts").glob("*.txt"))]


def _rows(docs: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table, from one literal."""
    return docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def whole_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, rarest: float | None = None) -> DataFrame:
    """Documents that are a licence's full text: ``key``, ``body``, ``n_terms``, ``license`` and ``score``."""
    rarest = rarest or weights(docs, text)[1]
    texts = full_texts()
    vocabulary = sorted({t for _, terms in texts for t in terms})
    known = F.broadcast(_rows(docs, [{"term": t} for t in vocabulary], "term: string"))
    counted = docs.select(F.explode(F.array_distinct(terms_of(docs[f"`{text}`"]))).alias("term")).join(known, "term").groupBy("term").agg(
        F.count("*").alias("n")).collect()
    df = {r["term"]: r["n"] for r in counted}
    idf = {t: rarest - math.log(1 + df.get(t, 0)) for t in vocabulary}
    vectors = []
    for number, (licence, terms) in enumerate(texts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in terms.items()))
        vectors.append((number, licence, {t: n * idf[t] / norm for t, n in terms.items()}))
    hit = _hits(docs, key, text, F.array(*[F.lit(t) for t in cues(vectors, similar)]))
    # A document's cosine is at most the length of the part of a text's unit vector whose terms it has; its words are counted if that can do.
    squares = F.broadcast(_rows(docs, [{"term": t, "of": [{"number": i, "w": v[t] ** 2} for i, _, v in vectors if t in v]} for t in vocabulary],
                                "term: string, of: array<struct<number: int, w: double>>"))
    reach = hit.select("key", "body", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).join(squares, "term").select(
        "key", "body", "term", F.inline("of")).groupBy("key", "body", "number").agg(F.sum("w").alias("share"))
    able = stored(reach.where(F.col("share") >= similar ** 2 * (1 - 1e-6)).select(F.col("key").alias("k"), F.col("body").alias("b")).distinct(), "able")
    hit = hit.join(able, hit["key"].eqNullSafe(able["k"]) & (hit["body"] == able["b"]), "left_semi")
    words = hit.select("key", "body", "n_terms", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("key", "body", "n_terms", "term").agg(
        F.count("*").alias("n"))
    entry = "term: string, idf: double, of: array<struct<number: int, w: double>>"
    entries = _rows(docs, [{"term": t, "idf": idf[t], "of": [{"number": i, "w": v[t]} for i, _, v in vectors if t in v]} for t in vocabulary], entry)
    weighted = words.join(F.broadcast(entries), "term", "left").withColumn("weight", F.col("n") * F.coalesce("idf", F.lit(rarest)))
    # Number -1 stands for the length of the document.
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("number"), F.col("weight").alias("w"))), F.coalesce("of", F.array().cast("array<struct<number:int,w:double>>")))
    sums = weighted.select("key", "body", "n_terms", "weight", F.inline(parts)).groupBy("key", "body", "n_terms", "number").agg(
        F.sum(F.col("weight") * F.col("w")).alias("dot"))
    names = F.array(*[F.lit(licence) for licence, _ in texts])
    best = F.max(F.when(F.col("number") >= 0, F.struct("dot", (-F.col("number")).alias("up"))))
    found = sums.groupBy("key", "body", "n_terms").agg(best.alias("best"), F.max(F.when(F.col("number") < 0, F.col("dot"))).alias("norm"))
    return found.select("key", "body", "n_terms", F.element_at(names, 1 - F.col("best.up")).alias("license"),
                        F.round(F.col("best.dot") / F.sqrt("norm"), 6).alias("score")).where(F.col("score") >= similar)


def scan(docs: DataFrame, directory: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``license``, ``score``, ``line``, ``origin`` (own, inherited, none) and ``from_directory``."""
    body = docs[f"`{text}`"]
    files = docs.select(docs[f"`{key}`"].alias("key"), F.xxhash64(body).alias("body"), F.coalesce(directory, F.lit("")).alias("directory"))
    known = weights(docs, text)
    lines = stored(matches(docs, key, text, known=known), "licences")
    inside = stored(passages(docs, key, text, known=known), "passages")
    whole = lines.select(F.col("key").alias("k"), F.col("body").alias("b"), F.col("line").alias("l")).distinct()
    same = lambda rows: rows["key"].eqNullSafe(whole["k"]) & (rows["body"] == whole["b"]) & (rows["line"] == whole["l"])
    across = inside.join(whole, same(inside) & (inside["last_line"] == whole["l"]), "left_anti")
    spots = across.select("key", "body", "n_terms", F.inline("spots")).distinct()
    beside = spots.join(whole, same(spots), "left_anti")
    complete = stored(whole_texts(docs, key, text, rarest=known[1]), "texts")
    nothing = F.lit(0).cast("bigint")
    # Full texts come before what lies inside them.
    best = F.struct(F.lit(1).alias("rank"), (-F.col("score")).alias("down"), F.col("line"), F.col("license"))
    text_best = F.struct(F.lit(0).alias("rank"), (-F.col("score")).alias("down"), F.lit(0).alias("line"), F.col("license"))
    found = lines.select("key", "body", "n_terms", best.alias("best"), F.col("words").alias("licensed")).unionByName(
        across.select("key", "body", "n_terms", best.alias("best"), nothing.alias("licensed"))).unionByName(
        beside.select("key", "body", "n_terms", F.lit(None).alias("best"), F.lit(1).cast("bigint").alias("licensed"))).unionByName(
        complete.select("key", "body", "n_terms", text_best.alias("best"), F.col("n_terms").cast("bigint").alias("licensed")))
    own = found.groupBy("key", "body", "n_terms").agg(F.min("best").alias("own"), F.sum("licensed").alias("licensed")).select(
        F.col("key").alias("k"), F.col("body").alias("b"), "n_terms", "own", "licensed")
    placed = files.join(own, files["key"].eqNullSafe(own["k"]) & (files["body"] == own["b"]), "left").drop("k", "b")
    # Directories with a licence file, and for every directory the nearest of those above it.
    at = placed.where(F.col("licensed") >= FILE_SHARE * F.col("n_terms")).groupBy(F.col("directory").alias("above")).agg(
        F.min(F.struct("own.down", "own.license")).alias("given"))
    parts = F.split("directory", "/")
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    nearest = files.select("directory").distinct().select("directory", F.inline(paths)).join(at, "above").groupBy("directory").agg(
        F.max(F.struct("depth", "above", "given")).alias("from"))
    whole = placed.join(nearest, "directory", "left")
    mine, theirs = F.col("own").isNotNull(), F.col("from").isNotNull()
    return whole.select(
        F.col("key").alias(key), F.coalesce("own.license", "from.given.license").alias("license"),
        F.coalesce(-F.col("own.down"), -F.col("from.given.down")).alias("score"), F.col("own.line").cast("bigint").alias("line"),
        F.when(mine, "own").when(theirs, "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("from.above")).alias("from_directory"))
