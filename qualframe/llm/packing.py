"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Documents longer than a window are cut into full windows first; those need no packing. What remains of each document goes,
longest first, to the open window with the least room that still holds it, which a segment tree over remaining
capacities finds in log2(window) steps. Every task packs the documents it reads, in lots of bounded size: no shuffle, no
global state, and windows carry the number of their task, so they are unique without any coordination.

Ids come from a file of ranks; ``added`` gives tokens that a text may hold literally and that are one id each, such as those of a
tokenizer's JSON file. Without it such strings are ordinary text.

Defined results: a null or empty text is one end mark; repeated rows are packed each for itself; an empty table gives no
rows; a document of any length is cut, never dropped. The input should be a table or a checkpoint (a retried
task must see the same rows in the same order).
"""

from __future__ import annotations

import base64
import json
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

import public_tokenizers
from qualframe.llm.common import once, travels

travels(__name__)

WINDOW = 2048
END_MARK = 1
# Remainders packed together; more only improve the fill by a hair, at a few bytes each.
LOT = 65_536

SCHEMA = "{key} bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def added_tokens(path: str) -> dict[str, int]:
    """Tokens a tokenizer's JSON file adds to its vocabulary, which texts are cut at before anything else."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    for token in found:
        if any(token[flag] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']!r} is not matched literally")
    return {token["content"]: token["id"] for token in found}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN, added: dict[str, int] | None = None) -> tiktoken.Encoding:
    """A tokenizer from a file of ranks; one per worker process."""
    return once(f"encoder {path} {pattern} {sorted((added or {}).items())}", lambda: tiktoken.Encoding(
        path, pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens=added or {}))


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree that finds the tightest one that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.filled = [0] * (2 * self.leaves)  # open windows at or below each node; leaf c: those with capacity c
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.filled[node] += change
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``length``, removed; None if nothing fits."""
        node = self.leaves + length
        if not self.filled[node]:
            while node > 1 and not (node & 1 == 0 and self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each length (all at most ``window``), and the number of windows."""
    order = np.argsort(-lengths, kind="stable")
    places, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, opened = OpenWindows(window), 0
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        found = windows.take(length)
        if found is None:
            found, opened = (opened, window), opened + 1
        places[item], offsets[item] = found[0], window - found[1]
        windows.put(found[0], found[1] - length)
    return places, offsets, opened


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, window: int = WINDOW,
         lot: int = LOT, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: ``key``, where it starts in its document and how long it is, the CRC of its ids, and its place."""
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, whole, base, used = encoder(ranks, added=added), set(added or {}), TaskContext.get().partitionId() << 40, 0
        rest: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal used, rest
            places, offsets, opened = best_fit_decreasing(np.array([r[2] for r in rest], np.int64), window)
            out = frame([(*r, base + used + p, o) for r, p, o in zip(rest, places.tolist(), offsets.tolist())])
            used, rest = used + opened, []
            return out

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip(names, zip(*rows) if rows else [()] * 7)})

        for batch in batches:
            full: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*tokenizer.encode(body.as_py() or "", allowed_special=whole, disallowed_special=()), END_MARK], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                    if len(piece) == window:
                        full.append((*row, base + used, 0))
                        used += 1
                    else:
                        rest.append(row)
                if len(rest) >= lot:
                    yield flush()
            if full:
                yield frame(full)
        if rest:
            yield flush()

    return docs.select(docs[f"`{key}`"].cast("bigint"), docs[f"`{text}`"].cast("string")).mapInArrow(packed, SCHEMA.format(key=f"`{key}`"))
