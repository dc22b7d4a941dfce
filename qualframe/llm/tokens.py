"""Byte-level BPE by a global shuffle of distinct words, and decoding by the table of token bytes.

Encoding: every task cuts its texts into words by the tokenizer's pattern and numbers the distinct ones of a block of texts;
a text is then a run of numbers. The distinct words of a block are dealt out by hash, so equal words of all blocks
meet in one task, which encodes each once; words and ids travel together, many to a row. The ids return to their block, whose
texts are put together again by position. A frequent word is one entry per block, however often it occurs.

Decoding: ids are joined with the table of token bytes (as large as the vocabulary, a fixed file, in every task).

Defined results: null and empty texts have no ids; null document ids stay null; repeated rows are encoded each for
itself; an empty table gives no rows; texts of any length are encoded whole (a block holds at least one); other columns are
dropped. The input should be a table or a checkpoint, since blocks are numbered by task.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import public_tokenizers
from qualframe.llm.common import once, shuffle_width, travels
from qualframe.llm.packing import encoder, ranks_of

travels(__name__)

# Characters of text in a block; a block is what one task puts together at a time.
BLOCK_CHARS = 12_000_000
# Words a task remembers before it starts anew (forgotten words are encoded again, with equal results).
REMEMBERED = 300_000
# Words whose ids are laid out at a time.
PUT_TOGETHER = 1 << 17
# Stands for a null document id inside a block.
NO_KEY = -(1 << 63)
BLOCKS = "block bigint, bucket int, places binary, words binary"
ENCODED = "{key} bigint, n_tokens bigint, ids array<int>"


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def _loosen(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# Numbers below this are one byte in a row of numbers; others have a byte for their 65,536s and two for the rest.
_SMALL = 192


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers, small ones in one byte; the bytes of larger ones apart by place, which compresses better."""
    large = numbers[numbers >= _SMALL] - _SMALL
    first = numbers.astype(np.uint8)
    first[numbers >= _SMALL] = np.minimum(_SMALL + (large >> 16), 255)
    huge = large[large >> 16 >= 255 - _SMALL].astype("<u4")
    planes = np.ascontiguousarray((large & 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2).T)
    return _squeeze(len(numbers).to_bytes(8, "little") + first.tobytes() + planes.tobytes() + huge.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    body = _loosen(data)
    n = int.from_bytes(body[:8], "little")
    first = np.frombuffer(body, np.uint8, n, 8)
    numbers, large = first.astype(np.int64), first >= _SMALL
    count = int(large.sum())
    low = np.ascontiguousarray(np.frombuffer(body, np.uint8, 2 * count, 8 + n).reshape(2, count).T).view("<u2").ravel()
    values = ((first[large].astype(np.int64) - _SMALL) << 16) + low
    huge = first[large] == 255
    values[huge] = np.frombuffer(body, "<u4", -1, 8 + n + 2 * count)
    numbers[large] = values + _SMALL
    return numbers


class _Numbers(dict):
    """Numbers new words in the order they are seen."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _cut(pattern: str, buckets: int, block_chars: int):
    """Blocks of documents as rows: one with the runs of word numbers (bucket -1), one for each bucket of distinct words."""

    def rows(block: int, keys: list, lengths: list, runs: list, numbers: _Numbers) -> pa.RecordBatch:
        words = list(numbers)
        run = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        counts = np.bincount(run, minlength=len(words))
        rank = np.empty(len(words), np.int64)  # frequent words get small numbers
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        header = np.array(keys, np.int64).tobytes() + np.array(lengths, np.int64).tobytes()
        out = [(block, -1, _packed(rank[run]), _squeeze(len(keys).to_bytes(8, "little") + header))]
        raw = [w.encode() for w in words]
        bucket = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % buckets
        order = np.lexsort((rank, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            members = order[edges[b]:edges[b + 1]]
            if len(members):
                sizes = np.fromiter((len(raw[m]) for m in members), np.uint32, len(members))
                body = len(members).to_bytes(8, "little") + sizes.tobytes() + b"".join(raw[m] for m in members)
                out.append((block, b, _packed(rank[members]), _squeeze(body)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                          ["block", "bucket", "places", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, block = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        keys, lengths, runs, numbers, chars = [], [], [], _Numbers(), 0
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = body.as_py() or ""
                words = find(text)
                keys.append(NO_KEY if key is None else key)
                lengths.append(len(words))
                runs.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                chars += len(text)
                if chars >= block_chars:
                    yield rows(block, keys, lengths, runs, numbers)
                    keys, lengths, runs, numbers, chars, block = [], [], [], _Numbers(), 0, block + 1
        if keys:
            yield rows(block, keys, lengths, runs, numbers)

    return cut


def _encode_words(ranks: str):
    """Replaces the words of a row by their ids; each distinct word of the task is encoded once. Runs pass unchanged."""

    class Encoded(dict):
        def __missing__(self, word):
            if len(self) >= REMEMBERED:
                self.clear()
            ids = self[word] = np.array(single.encode_ordinary(word.decode()), "<i4").tobytes()
            return ids

    # One word at a time is encoded, so the pattern takes it as a whole.
    single = encoder(ranks, r"(?s:.+)")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Encoded()
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if bucket >= 0:
                    body = _loosen(data)
                    n = int.from_bytes(body[:8], "little")
                    ends = 8 + 4 * n + np.cumsum(np.frombuffer(body, np.uint32, n, 8), dtype=np.int64)
                    starts = [8 + 4 * n, *ends[:-1].tolist()]
                    ids = [known[body[a:b]] for a, b in zip(starts, ends.tolist())]
                    sizes = np.fromiter(map(len, ids), np.uint32, n) // 4
                    data = _squeeze(n.to_bytes(8, "little") + sizes.astype(np.uint32).tobytes() + b"".join(ids))
                out.append(data)
            yield batch.set_column(3, "words", pa.array(out, pa.binary()))

    return encode


def _put_together(key: str):
    """The documents of one block, from its runs and the ids of its words."""

    def joined(rows: pa.Table) -> pa.Table:
        run, head, places, sizes, parts = None, b"", [], [], []
        for bucket, where, data in zip(*(rows[c].to_pylist() for c in ("bucket", "places", "words"))):
            if bucket < 0:
                run, head = _unpacked(where), _loosen(data)
                continue
            body = _loosen(data)
            n = int.from_bytes(body[:8], "little")
            places.append(_unpacked(where))
            sizes.append(np.frombuffer(body, np.uint32, n, 8).astype(np.int64))
            parts.append(np.frombuffer(body, np.int32, -1, 8 + 4 * n))
        n = int.from_bytes(head[:8], "little")
        keys, lengths = np.frombuffer(head, np.int64, n, 8), np.frombuffer(head, np.int64, n, 8 + 8 * n)
        length = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begin = np.cumsum(length) - length
        at = np.empty(len(length), np.int64)  # by word number: which entry
        at[np.concatenate(places) if places else np.zeros(0, np.int64)] = np.arange(len(length))
        ends = np.concatenate([[0], np.cumsum(length[at[run]], dtype=np.int64)])  # ids before each word
        edges = ends[np.concatenate([[0], np.cumsum(lengths)])]
        ids = np.empty(int(ends[-1]), np.int32)
        for first in range(0, len(run), PUT_TOGETHER):
            entry = at[run[first:first + PUT_TOGETHER]]
            low, high = ends[first], ends[min(first + PUT_TOGETHER, len(run))]
            ids[low:high] = flat[np.repeat(begin[entry] - ends[first:first + len(entry)], length[entry]) + np.arange(low, high)]
        return pa.table({key: pa.array(keys, mask=keys == NO_KEY), "n_tokens": pa.array(np.diff(edges)),
                         "ids": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))})

    return joined


def _blocks(docs: DataFrame, key: str, text: str, ranks: str, pattern: str, block_chars: int) -> DataFrame:
    buckets = shuffle_width(docs.sparkSession)
    cut = docs.select(docs[f"`{key}`"].cast("bigint"), docs[f"`{text}`"].cast("string")).mapInArrow(
        _cut(pattern, buckets, block_chars), BLOCKS)
    where = F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.col("bucket").cast("bigint"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode_words(ranks)(batches)

    return cut.repartition(buckets, where).mapInArrow(encode, BLOCKS)


def token_bytes(ranks: str) -> list[bytes]:
    """The table of token bytes, by id."""
    def made() -> list[bytes]:
        table = ranks_of(ranks)
        out = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            out[rank] = token
        return out

    return once(f"bytes {ranks}", made)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: ``key``, ``n_tokens`` and ``ids`` (array of int)."""
    ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return _blocks(docs, key, text, ranks, pattern, block_chars).groupBy("block").applyInArrow(
        _put_together(key), ENCODED.format(key=f"`{key}`"))


def decode(encoded: DataFrame, ids: str = "ids", ranks: str | None = None, to: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes its ids stand for."""
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("binary")
    def joined(column: pd.Series) -> pd.Series:
        table = token_bytes(ranks)
        return column.map(lambda run: None if run is None else b"".join([table[i] for i in run]))

    return encoded.withColumn(to, joined(F.col(f"`{ids}`")))


def ids_digest(ids: Column) -> Column:
    """SHA-256, in lowercase hex, of the decimal ids joined by one space."""

    @F.pandas_udf("string")
    def digest(column: pd.Series) -> pd.Series:
        return column.map(lambda run: None if run is None else hashlib.sha256(" ".join(map(str, run.tolist())).encode()).hexdigest())

    return digest(ids)
