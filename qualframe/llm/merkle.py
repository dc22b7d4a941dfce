"""A manifest of a dataset as a tree of hashes, with a proof for every row.

Every row is a leaf, the SHA-256 of its fields. Leaves of one group (a language, say) follow each other by key and are hashed in pairs, level by level,
up to the root of the group; the roots of the groups, in order, are the leaves of one more tree, whose root stands for the dataset.

* **Places** come from one global sort by group and key (``with_index``), so a group that holds most rows is no single task.
* **Levels** are built eight at a time: 256 aligned nodes meet in one group of an aggregate and bring forth all nodes above them.
* **Proofs** by pointer jumping: every node holds the segment of siblings on the way to an ancestor, first to its parent. In each round nodes join
  their ancestors, take over the segment held there, and so double the distance; after about log2(height) self-joins every leaf has reached the root.
  In the round of distance d only nodes on levels that are multiples of d are met, and only those on multiples of 2 d and the leaves go on.

The joins are even: on level l a node has at most 2^l leaves below it. Ancestors are sent to every task only where their counted bytes are
few. Rounds are written to the shared scratch folder, so lost executors cost one round at most.

Defined results: a null field counts as ``-``; an empty text is a field of 0 bytes; null groups and null keys come first; rows of equal key follow
by their leaf, so repeated rows are leaves side by side; an empty table gives no rows; the names of the table cannot clash with those made here.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.llm.common import SENT, stored
from qualframe.operators.ordering import rank_groups, with_index

# Levels that are built at a time, and the bytes of ancestors that may be sent to every task.
STEP = 8
SENT_BYTES = 8 << 20
LEFT, RIGHT = bytearray(b"L"), bytearray(b"R")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: of every field its bytes in UTF-8, a colon and the value, or a dash for null."""
    text = lambda f: F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))
    return digest_of(F.concat(*[F.coalesce(text(f), F.lit("-")) for f in fields]))


def height(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def fold(start: Column, segment: Column) -> Column:
    """The digest a leaf leads to along its siblings. An element names the sibling's side and digest; an empty one stands for a node without."""
    step = lambda own, s: F.when(F.length(s) == 0, as_hex(own)).when(
        F.substring(s, 1, 1) == F.lit(LEFT), F.concat(as_hex(F.substring(s, 2, 32)), as_hex(own))).otherwise(
        F.concat(as_hex(own), as_hex(F.substring(s, 2, 32))))
    return F.aggregate(segment, start, lambda own, s: digest_of(step(own, s)))


def proof_digest(segment: Column) -> Column:
    """The digest of all siblings, from the leaf to the root."""
    return digest_of(F.array_join(F.transform(segment, lambda s: as_hex(F.substring(s, 2, 32))), ""))


def _above(nodes: Column) -> Column:
    """The level above some nodes: every two of them, and a last one alone."""
    pair = lambda i: F.concat(as_hex(F.get(nodes, 2 * i)), F.coalesce(as_hex(F.get(nodes, 2 * i + 1)), F.lit("")))
    last = F.call_function("div", F.size(nodes) - 1, F.lit(2)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest_of(pair(i)))


def _grown(leaves: DataFrame, highest: int) -> list[DataFrame]:
    """All nodes of all trees, in one stored frame for every ``STEP`` levels.

    ``leaves`` has ``tree, n, at, digest, held``. A node also has its ``level``, the ``top`` of its tree, and ``mark``, its sibling (null for nodes that the next
    frame has again, and for roots); only leaves hold something.
    """
    frames, current = [], leaves
    for base in range(0, max(highest, 1), STEP):
        block = F.call_function("shiftright", F.col("at"), F.lit(STEP))
        met = current.groupBy("tree", "n", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "digest", "held"))).alias("own"))
        top = height(F.col("n"))
        rise = F.least(top - base, F.lit(STEP))
        levels = F.when(rise > 0, F.aggregate(
            F.sequence(F.lit(1), F.greatest(rise, F.lit(1))), F.array(F.col("own.digest")),
            lambda grown, _: F.concat(grown, F.array(_above(F.element_at(grown, -1)))))).otherwise(F.array(F.col("own.digest")))
        built = met.select("tree", "n", "block", "own.held", top.alias("top"), rise.alias("rise"), levels.alias("levels"))

        def node(nodes: Column, level: Column, digest: Column, i: Column) -> Column:
            other = F.get(nodes, i.bitwiseXOR(F.lit(1)))
            sibling = F.when(other.isNull(), F.lit(bytearray())).otherwise(
                F.concat(F.when(i % 2 == 0, F.lit(RIGHT)).otherwise(F.lit(LEFT)), other))
            return F.struct(
                (level + base).alias("level"), (F.call_function("shiftleft", F.col("block"), F.lit(STEP) - level) + i).alias("at"), digest.alias("digest"),
                F.when(level < F.col("rise"), sibling).alias("mark"), F.when(level == 0, F.get("held", i)).alias("held"))

        flat = F.flatten(F.transform("levels", lambda nodes, level: F.transform(nodes, lambda digest, i: node(nodes, level, digest, i))))
        frames.append(stored(built.select("tree", "n", "top", F.inline(flat)), f"nodes-{base}"))
        current = frames[-1].where((F.col("level") == base + STEP) & (F.col("level") < F.col("top"))).select("tree", "n", "at", "digest", "held")
    return frames


def _jumped(nodes: DataFrame, highest: int) -> DataFrame:
    """Leaves with the whole segment to the root of their tree. ``nodes`` hold a segment towards level ``reach``."""
    done, distance = [], 1
    columns = ["tree", "top", "level", "at", "digest", "held", "segment", "reach"]
    while distance < highest:
        done.append(nodes.where((F.col("level") == 0) & (F.col("reach") == F.col("top"))))
        goes_on = F.col("level") % (2 * distance) == 0
        up = F.call_function("shiftright", F.col("at"), F.col("reach") - F.col("level"))
        jumping = nodes.where(goes_on & (F.col("reach") < F.col("top"))).withColumn("up", up)
        met = nodes.where(F.col("level") % (2 * distance) == distance).select(
            "tree", F.col("level").alias("reach"), F.col("at").alias("up"), F.col("segment").alias("_segment"), F.col("reach").alias("_reach"))
        if met.count() * 64 * (distance + 1) <= SENT_BYTES:
            met = F.broadcast(met)
        further = jumping.join(met, ["tree", "reach", "up"]).select(
            *columns[:-2], F.concat("segment", "_segment").alias("segment"), F.col("_reach").alias("reach"))
        resting = nodes.where(goes_on & (F.col("level") > 0) & (F.col("reach") == F.col("top"))).select(*columns)
        nodes = stored(further.unionByName(resting), f"jump-{distance}")
        distance *= 2
    found = nodes.where("level = 0")
    for frame in done:
        found = found.unionByName(frame.select(*found.columns))
    return found


def proofs(leaves: DataFrame, highest: int) -> tuple[DataFrame, DataFrame]:
    """Leaves with their segments, and the root of every tree.

    ``leaves`` has ``tree``, ``n`` (leaves of the tree), ``at`` (from 0), ``digest`` and ``held`` (a struct that comes along); ``highest`` is the height of the highest tree.
    """
    frames = _grown(leaves, highest)
    roots = [f.where("level = top").select("tree", "digest") for f in frames]
    nodes = []
    for frame in frames:
        # The highest level of a frame is the lowest of the next, where its nodes have siblings; a root stays where it is.
        own = frame.where(F.col("mark").isNotNull() | (F.col("level") == F.col("top")))
        nodes.append(own.select(
            "tree", "top", "level", "at", "digest", "held",
            F.when(F.col("mark").isNull(), F.array().cast("array<binary>")).otherwise(F.array("mark")).alias("segment"),
            F.least(F.col("level") + 1, F.col("top")).alias("reach")))
    whole, ends = nodes[0], roots[0]
    for more in nodes[1:]:
        whole = whole.unionByName(more)
    for more in roots[1:]:
        ends = ends.unionByName(more)
    return _jumped(whole, highest).select("tree", "digest", "held", "segment"), ends


def _height_of(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def manifest(docs: DataFrame, fields: Sequence[str], group: str = "lang", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``group``, the columns in ``carry``, and ``leaf``, ``segment``, ``subroot`` and ``root`` (binary).

    ``segment`` holds the siblings from the leaf to the root of all, as ``fold`` takes them.
    """
    named = docs.select(docs[f"`{group}`"].alias("lane"), docs[f"`{key}`"].alias("key"), leaf([docs[f"`{f}`"] for f in fields]).alias("leaf"),
                        F.struct(F.lit(0).alias("_"), *[docs[f"`{c}`"] for c in carry]).alias("carried"))
    placed = with_index(named, [F.col("lane").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf").asc()], "place")
    # The first place of a group names its tree; trees in order of that number are groups in order.
    lanes = stored(placed.groupBy("lane").agg(F.min("place").alias("tree"), F.count("*").alias("n")), "lanes")
    known = lanes.agg(F.count("*").alias("lanes"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    few = known["lanes"] <= SENT // 100  # groups whose names may be sent to every task
    sent = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    trees = lanes.withColumnRenamed("lane", "_lane")
    rows = placed.join(sent(trees), F.col("lane").eqNullSafe(F.col("_lane"))).select(
        "tree", "n", (F.col("place") - F.col("tree")).alias("at"), F.col("leaf").alias("digest"), F.struct("lane", "key", "carried").alias("held"))
    own, subroots = proofs(rows, _height_of(known["most"]))

    ranked = rank_groups(subroots, [F.col("tree").asc()], "at")
    above, root = proofs(ranked.select(F.lit(0).cast("bigint").alias("tree"), F.lit(known["lanes"]).cast("bigint").alias("n"), "at", "digest", F.struct("tree").alias("held")),
                         _height_of(known["lanes"]))
    tops = above.join(F.broadcast(root.select("tree", F.col("digest").alias("root"))), "tree").select(  # one row is sent
        F.col("held.tree").alias("tree"), F.col("digest").alias("subroot"), F.col("segment").alias("_more"), "root")
    return own.join(sent(tops), "tree").select(
        F.col("held.key").alias(key), F.col("held.lane").alias(group), *[F.col(f"held.carried.`{c}`") for c in carry],
        F.col("digest").alias("leaf"), F.concat("segment", "_more").alias("segment"), "subroot", "root")
