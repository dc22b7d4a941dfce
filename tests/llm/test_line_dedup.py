"""Line classes against brute force over all pairs, and the edit distance against its definition."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qualframe.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def distance(a, b):
    same = len(os.path.commonprefix([a, b]))  # equal beginnings change nothing, and spare time on long texts
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(text, times, rng, alphabet="abé😀 "):
    text = list(text)
    for _ in range(times):
        at, what = rng.randint(0, len(text)), rng.random()
        if what < 0.4:
            text.insert(at, rng.choice(alphabet))
        elif what < 0.7 and at < len(text):
            text[at] = rng.choice(alphabet)
        elif at < len(text):
            del text[at]
    return "".join(text)


def brute(rows, edits=line_dedup.EDITS, shortest=line_dedup.SHORTEST):
    """(key, at) -> (key, at) of the first line of its class; one text per key."""
    order = lambda place: (place[0] is not None, place[0] or 0, place[1])
    places = {}
    for key, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(BLANKS):
                places.setdefault(line.strip(BLANKS), set()).add((key, at))
    lines, group = list(places), {line: line for line in places}

    def root(line):
        while group[line] != line:
            line = group[line]
        return line

    counts = {line: Counter(line) for line in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) < shortest or abs(len(a) - len(b)) > edits:
                continue
            # Each edit changes the counts of characters by two at most.
            if ((counts[a] - counts[b]) + (counts[b] - counts[a])).total() <= 2 * edits and distance(a, b) <= edits:
                group[root(a)] = root(b)
    first = {}
    for line in lines:
        first.setdefault(root(line), []).extend(places[line])
    return {place: min(first[root(line)], key=order) for line in lines for place in places[line]}


def found(frame):
    return {(r.key, r.at): (r["first"].key, r["first"].at) for r in frame.collect()}


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_within_is_the_edit_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 14)))
        rows.append((a, edited(a, rng.randint(0, edits + 2), rng)))
    rows += [("", ""), ("", "abc"), ("x" * 70_000 + "a" + "y" * 70_000, "x" * 70_000 + "bc" + "y" * 70_000)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    assert all(r.w == (distance(r.a, r.b) <= edits) for r in got[:-1])
    assert got[-1].w == (edits >= 2)


@pytest.mark.parametrize("crowded", [2, line_dedup.CROWDED])
def test_links_lose_no_pair(spark, crowded):
    """Families of edited copies, with crowded segments at every level."""
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcde ") for _ in range(rng.randint(24, 60))).strip() for _ in range(4)]
    lines = sorted({edited(b, rng.randint(0, 5), rng).strip() for b in bases for _ in range(25)})
    lines = [line for line in lines if len(line) >= 24]
    frame = spark.createDataFrame(list(enumerate(lines)) + [(0, lines[0])], "id bigint, line string")
    got = {(r.a, r.b) for r in line_dedup.links(frame, crowded=crowded).collect()}
    assert got == {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= 2}
    assert len(got) > 30


def test_classes_match_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefg ") for _ in range(n)) for n in (10, 30, 31, 45, 60, 200)]
    rows = [(None, base[1] + "\n\n  " + base[0])]
    for key in range(60):
        rows.append((key, "\n".join(edited(rng.choice(base), rng.choice([0, 0, 0, 1, 2, 4]), rng) for _ in range(rng.randint(0, 5)))))
    rows += [(100, None), (101, ""), (102, " \t\n\x0b \n"), (103, "x" * 50_000), (104, "x" * 50_001), (105, "short"), (106, "short  "), (107, "shore")]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, line int, id int").repartition(4)
    assert found(line_dedup.classes(docs)) == brute(rows)


def test_texts_lose_later_lines_and_keep_columns(spark):
    long = "a line that is long enough to be compared"
    rows = [(2, f"{long}\nnew\n\n tail", "k"), (1, f"{long}s\n{long}!", "k"), (3, None, "k"), (2, f"{long}\nnew\n\n tail", "k"), (4, "new", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone string")
    out = line_dedup.without_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, "-" if r.text is None else r.text, r._gone) for r in out.collect()) == [
        (1, f"{long}s", "k"), (2, "new\n\n tail", "k"), (2, "new\n\n tail", "k"), (3, "-", "k"), (4, "", "k")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.classes(docs).count() == 0 and line_dedup.without_duplicates(docs).count() == 0
