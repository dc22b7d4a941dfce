"""Duplicate lines across documents: equal lines, and lines within a few edits, by a segment-partition join.

A line of n characters is cut into ``EDITS`` + 1 segments. If another line is within ``EDITS`` edits, one segment of the shorter line
is found unchanged in the longer one, near its place; how near follows from the difference in length and from the segment's number,
so only a few substrings of a line are looked up, under (length, segment, content). An edit takes away and
adds four pairs of neighbouring characters at most, so candidates must agree in all but a few parities of the numbers of
pairs; they are verified on their full text by a banded bit-parallel automaton: one bit per diagonal of the band and number of edits, all in one
integer, one step per character.

Segments shared by many lines (``CROWDED``) are not joined by that segment alone: what is left of the lines outside it must again
share a segment, so the join goes on with both, up to ``DEEPER`` times, which loses no pair. Everything is DataFrame and SQL functions.

Lines are classes under chains of links. The first line of a class, by document and place, is kept.

Defined results: lines are compared without blanks at their ends; lines without a word are never duplicates; lines shorter
than ``SHORTEST`` characters match only equal lines; a null text has no lines; an empty table gives no rows; equal rows (same key,
same text) are one document; a null key comes first. Columns of the input are kept by ``without_duplicates``, dropped by ``classes``.
Lines travel as 64-bit hashes; two different lines with the same hash are found out by a second one and then only match equal lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.llm.common import among, let, stored
from qualframe.llm.components import components

EDITS = 2
SHORTEST = 24
# Lines that share a segment, from which more segments are asked for; how many more.
CROWDED, DEEPER = 64, 2
# Pairs of neighbouring characters that an edit changes at most.
PAIRS = 4
# Characters after which a candidate is looked at again.
HEAD = 12
BLANKS = " \t\n\x0b\x0c\r"


def _wide(text: Column) -> Column:
    """Four bytes for each character, so that a part is cut out without counting characters from the start."""
    return F.encode(text, "UTF-32")


def _lookups(rows: DataFrame, edits: int) -> DataFrame:
    """``rows`` (with ``rest`` and ``below``, the key of the level above) once per substring to look up.

    Adds ``key``, the substring's place (``start``, ``size``), how much ``shorter`` the other line is, and whether it is the line's
    ``own`` segment, which others look for.
    """
    wanted = [(i, shift, shorter) for shorter in range(edits + 1) for i in range(edits + 1)
              for shift in range(-i, i + 1) if abs(shift - shorter) <= edits - i]
    specs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("i", "shift", "shorter"), spec)]) for spec in wanted])
    each = rows.withColumn("wide", _wide(F.col("rest"))).withColumn("n", F.call_function("div", F.octet_length("wide"), F.lit(4)).cast("int"))
    each = each.select("*", F.inline(specs))
    parts = edits + 1
    other = F.col("n") - F.col("shorter")
    base = F.call_function("div", other, F.lit(parts)).cast("int")
    # The last (length mod parts) segments are one character longer.
    first_long = parts - (other - base * parts)
    sized = each.withColumn("size", base + (F.col("i") >= first_long).cast("int")).withColumn(
        "start", 1 + base * F.col("i") + F.greatest(F.lit(0), F.col("i") - first_long) + F.col("shift"))
    fits = (F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")) & (other >= parts)
    part = F.substring("wide", 4 * F.col("start") - 3, 4 * F.col("size"))
    return sized.where(fits).withColumn("key", F.xxhash64("below", other, "i", part)).withColumn(
        "own", F.expr("shift = 0 AND shorter = 0")).drop("i", "shift", "n", "wide")


def _parities(text: Column) -> Column:
    """Pairs of neighbouring characters fall into 64 classes; a bit says whether a class has an odd number of them. An edit changes
    ``PAIRS`` bits at most: a replaced character is in two pairs before and in two after."""
    def bits(codes: Column) -> Column:
        classes = F.zip_with(codes, F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.pmod(a * 31 + b, F.lit(64)))
        return F.aggregate(classes, F.lit(0).cast("bigint"), lambda bits, c: F.when(c.isNull(), bits).otherwise(
            bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c))))

    return let(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.ascii), bits)


def _strip(a: Column, b: Column) -> Column:
    """Both texts without their common beginning and end."""
    steps = F.array(*[F.lit(1 << k) for k in range(27, -1, -1)])

    def same(most: Column, part) -> Column:
        """The longest stretch that is equal, found by halving."""
        return F.aggregate(steps, F.lit(0), lambda done, step: F.when(
            (step <= most - done) & part(done, step), done + step).otherwise(done))

    def stripped(x: Column, y: Column, m: Column, n: Column) -> Column:
        shorter = F.least(m, n)
        begins = lambda done, step: F.substring(x, 4 * done + 1, 4 * step) == F.substring(y, 4 * done + 1, 4 * step)
        ends = lambda done, step: F.substring(x, 4 * (m - done - step) + 1, 4 * step) == F.substring(y, 4 * (n - done - step) + 1, 4 * step)
        return let(same(shorter, begins), lambda p: let(same(shorter - p, ends), lambda s: F.struct(
            F.substring(a, p + 1, m - p - s).alias("a"), F.substring(b, p + 1, n - p - s).alias("b"))))

    return let(_wide(a), lambda x: let(_wide(b), lambda y: let(F.length(a), lambda m: let(F.length(b), lambda n: stripped(x, y, m, n)))))


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two texts are within ``edits`` insertions, deletions and replacements of characters (``edits`` at most 4).

    State: for each number of edits a field of one bit per diagonal of the band, set if the beginnings read so far
    meet on that diagonal with so many edits. A character of ``a`` moves all fields at once.
    """
    diagonals, width = 2 * edits + 1, 2 * edits + 2
    fields = [d * width for d in range(edits + 1)]
    band = sum(((1 << diagonals) - 1) << f for f in fields)
    spread = sum(1 << f for f in fields)
    number = lambda n: F.lit(n).cast("bigint")
    both = lambda x, mask: x.bitwiseAND(number(mask))

    def inserted(state: Column) -> Column:
        # one more character of b: the next diagonal of the next field
        for _ in range(edits):
            state = let(state, lambda s: s.bitwiseOR(both(F.shiftleft(s, width + 1), band)))
        return state

    start = 1 << edits
    for _ in range(edits):
        start |= (start << (width + 1)) & band

    def state_after(x: Column, y: Column) -> Column:
        """The state when all of ``x`` is read; ``y`` is padded in front, places after its end match nothing."""
        def step(state: Column, i: Column) -> Column:
            matches = F.lit(0).cast("bigint")
            for d in range(diagonals):
                matches = matches + F.when(F.get(y, i + d) == F.get(x, i), number(spread << d)).otherwise(number(0))
            moved = lambda m: state.bitwiseAND(m).bitwiseOR(both(F.shiftleft(state, width), band)).bitwiseOR(
                both(F.shiftleft(F.shiftright(both(state, band & ~spread), 1), width), band))
            return F.when(state == 0, state).otherwise(inserted(let(matches, moved)))

        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), number(start), step)

    characters = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    padding = F.array_repeat(F.lit(""), edits)

    def state_of(x: Column, y: Column) -> Column:
        return let(characters(x), lambda p: let(F.concat(padding, characters(y)), lambda q: state_after(p, q)))

    def compared(m: Column) -> Column:
        x, y = m["a"], m["b"]
        shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
        # Most candidates are beyond the limit after a few characters, so those are read first.
        begins = state_of(F.substring(x, 1, HEAD), F.substring(y, 1, HEAD + edits)) != 0
        last = F.length(y) - F.length(x) + edits  # the diagonal on which both texts end
        ends = let(state_of(x, y), lambda s: F.call_function("shiftright", s, last).bitwiseAND(number(spread)) != 0)
        return F.when(shorter == 0, longer <= edits).otherwise(begins & ends)

    return F.when(F.abs(F.length(a) - F.length(b)) > edits, F.lit(False)).otherwise(let(_strip(a, b), compared))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with a word: the document's key and a hash of its text, the place, the trimmed line and two hashes of it."""
    body = docs[f"`{text}`"].cast("string")
    each = docs.select(docs[f"`{key}`"].alias("key"), F.xxhash64(body).alias("body"), F.posexplode(F.split(body, "\n", -1)).alias("at", "line"))
    # Spaces are quickly taken off; the other blanks only where there are any.
    spaced = F.trim("line")
    others = reduce(Column.__or__, [spaced.startswith(b) | spaced.endswith(b) for b in BLANKS if b != " "])
    line = F.when(others, F.call_function("btrim", F.col("line"), F.lit(BLANKS))).otherwise(spaced)
    return each.withColumn("line", line).where("line <> ''").withColumns({
        "id": F.xxhash64("line"), "check": F.xxhash64(F.lit(1), "line")})


def shared_segments(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Lookups of ``lines`` (id, line) that meet the segment of another line: ``id``, ``key``, ``start``, ``size``, ``shorter``, ``own``.

    Keys are first reduced to the smallest and largest id that has them, combined before the shuffle; nearly all belong to one line alone.
    """
    keyed = _lookups(lines.select("id", F.col("line").alias("rest"), F.lit(0).cast("bigint").alias("below")), edits)
    met = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("own").alias("own"))
    keys = stored(met.where("low <> high AND own").select("key"), "met-keys")
    return among(keyed, keys, "key").select("id", "key", "start", "size", "shorter", "own").distinct()


def links(lines: DataFrame, edits: int = EDITS, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b) of ids of ``lines`` (id, line; copies are welcome) that are within ``edits`` edits."""
    rows = stored(shared_segments(lines, edits), "shared-segments")
    ids = stored(rows.select("id").distinct(), "candidates")
    texts = among(lines.select("id", "line"), ids, "id").groupBy("id").agg(F.first("line").alias("line"))
    texts = stored(texts.withColumn("parities", _parities(F.col("line"))), "candidate-lines")
    rows, found = rows.join(texts.select("id", "parities"), "id"), []
    alike = F.bit_count(F.col("s.parities").bitwiseXOR(F.col("p.parities"))) <= PAIRS * edits
    for level in range(DEEPER + 1):
        segments = rows.where("own")
        full = segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("key")
        single = segments if level == DEEPER else segments.join(full, "key", "left_anti")
        met = (F.col("s.key") == F.col("p.key")) & (F.col("s.id") != F.col("p.id")) & alike
        pairs = single.alias("s").join(rows.alias("p"), met).select(
            F.least("s.id", "p.id").alias("a"), F.greatest("s.id", "p.id").alias("b"))
        found.append(stored(pairs.distinct(), "pairs"))
        if level == DEEPER:
            break
        # Lines under a crowded key go on with what they have outside of it, a line break for the gap.
        busy = rows.join(full, "key", "left_semi")
        busy = busy if level else busy.join(texts.select("id", F.col("line").alias("rest")), "id")
        line = F.col("rest")
        outside = F.concat(line.substr(F.lit(1), F.col("start") - 1), F.lit("\n"), line.substr(F.col("start") + F.col("size"), F.length(line)))
        left = busy.select("id", "parities", F.col("key").alias("below"), F.col("shorter").alias("fixed"), F.col("own").alias("was_own"), outside.alias("rest"))
        if not busy.take(1):
            break
        rows = stored(_lookups(left, edits).where("shorter = fixed").withColumn("own", F.expr("own AND was_own")).select(
            "id", "key", "start", "size", "shorter", "own", "rest", "parities").distinct(), "crowded-segments")
    one = reduce(DataFrame.union, found).distinct().join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    return both.where(within(F.col("line_a"), F.col("line_b"), edits)).select("a", "b")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """Every line with a word: ``key``, ``body`` (hash of the text), ``at``, and ``first``, the first line of its class (key, at, body)."""
    lines = _lines(docs, key, text)
    linked = components(links(lines.where(F.length("line") >= shortest).select("id", "line"), edits))
    firsts = lines.groupBy("id", "check").agg(F.min(F.struct("key", "at", "body")).alias("first"))
    # Only lines that have a link to a different one look further than their own copies.
    clashes = firsts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    joined = stored(firsts.join(linked, "id").join(clashes, "id", "left_anti"), "linked")
    first_of = joined.groupBy("component").agg(F.min("first").alias("class_first"))
    moved = joined.join(first_of, "component").select("id", "check", "class_first")
    known = firsts.join(moved, ["id", "check"], "left").select("id", "check", F.coalesce("class_first", "first").alias("first"))
    return lines.select("key", "body", "at", "id", "check").join(known, ["id", "check"]).select("key", "body", "at", "first")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with the lines that an earlier line stands for taken out of the text; lines without a word stay."""
    later = classes(docs, key, text, edits, shortest).where("NOT (first.key <=> key AND first.at = at AND first.body = body)")
    gone = later.groupBy("key", "body").agg(F.collect_set("at").alias("_gone"))
    body = docs[f"`{text}`"].cast("string")
    marked = docs.join(gone, docs[f"`{key}`"].eqNullSafe(gone["key"]) & (F.xxhash64(body) == gone["body"]), "left")
    lines = F.split(body, "\n", -1)
    rest = F.when(gone["_gone"].isNull(), body).otherwise(
        F.array_join(F.filter(lines, lambda line, at: ~F.array_contains(gone["_gone"], at)), "\n"))
    return marked.select(*[rest.alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns])
