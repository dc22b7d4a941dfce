"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is fixed and public (the pieces of a published tokenizer, in lower case). A language is a probability for
each piece; a word is scored by the forward algorithm, which adds up the probabilities of every way to cut it into pieces, and
a text by the product over its words. Learning is one expectation step over all labelled texts: from equal piece weights,
forward and backward sums give the expected number of times each piece is used, counted per language by the tasks
and added up in a shuffle of at most (languages x pieces) rows per task.

Both passes work on distinct words of a lot of texts, many words at a time, with every piece of the vocabulary, however long. Words are never cut:
in long runs of letters the sums are scaled every ``RESCALE`` characters and the logarithms of the scales go along, so nothing underflows
and every segmentation counts. Short words meet in lots of one length, long ones in lots of similar length, filled up at the end.

Defined results: null texts and texts without a letter give ``und`` and score 0; without labelled texts everything is
``und``; equal scores go to the first language in alphabetical order; rows without a language are not learned from; repeated
rows count each; an empty table gives no rows; columns of the input other than key and text are dropped.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import public_tokenizers
from qualframe.llm.common import once, travels

travels(__name__)

# Characters after which sums are scaled; words longer than this share lots by steps of ``FILL`` characters.
RESCALE, FILL = 24, 8
START = "▁"  # the vocabulary's mark for the start of a word
LETTERS = r"\p{L}+"
# Added to every expected count.
SMOOTHING = 0.1
# Characters of text whose words are counted, or scored, together; words a task remembers before it starts anew.
COUNTED_CHARS, LOT_CHARS = 12_000_000, 2_000_000
REMEMBERED = 400_000
UNKNOWN = "und"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hashed(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For lengths 1, 2, ... ``longest``: the hash of the substring of that length that starts at each place (columns)."""
    codes = codes.astype(np.uint64) + np.uint64(1)
    value = np.zeros_like(codes)
    for length in range(1, min(longest, codes.shape[1]) + 1):
        value = value[:, :codes.shape[1] - length + 1] * _PRIME + codes[:, length - 1:]
        yield (value ^ (value >> np.uint64(29))) * _PRIME


class Vocabulary:
    """Pieces by the hash of their characters; number ``size`` stands for any character that is no piece."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not special(i)}
        self.longest = max(map(len, pieces))
        keys = np.array([list(_hashed(_codes([p]), self.longest))[-1][0, 0] for p in sorted(pieces) if p], np.uint64)
        self.keys = np.unique(keys)
        self.size = len(self.keys)
        self.filled = np.zeros(1 << 20, bool)  # by the first bits of a hash: whether any piece has them
        self.filled[self.keys >> np.uint64(44)] = True

    def pieces(self, codes: np.ndarray) -> list[np.ndarray]:
        """By length - 1: the piece that starts at each place, or -1."""
        out = []
        for length, value in enumerate(_hashed(codes, self.longest), 1):
            found = np.full(value.shape, self.size if length == 1 else -1, np.int32)
            likely = self.filled[value >> np.uint64(44)]
            some = value[likely]
            at = np.minimum(np.searchsorted(self.keys, some), self.size - 1)
            found[likely] = np.where(self.keys[at] == some, at, found[likely])
            out.append(found)
        return out


def _codes(words: list[str]) -> np.ndarray:
    """Characters of equally long words, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def vocabulary(path: str) -> Vocabulary:
    return once(f"vocabulary {path}", lambda: Vocabulary(path))


def scores_of(pieces: list[np.ndarray], weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of whole words, by language."""
    sums, scales = forward(pieces, weights)
    out = np.empty((len(ends), weights.shape[1]))
    for end in np.unique(ends):
        own = ends == end
        scale = scales[end]
        out[own] = np.log(sums[end][own]) + (scale if np.isscalar(scale) else scale[own])
    return out


def _scaled(recent: list[np.ndarray], scale: np.ndarray | float) -> tuple[list[np.ndarray], np.ndarray]:
    """The same sums, the greatest of each word and language being 1, and the logarithm of what they were divided by."""
    top = np.maximum.reduce(recent)
    top = np.where(top > 0, top, 1.0)
    return [r / top for r in recent], scale + np.log(top)


def forward(pieces: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], list]:
    """Sums over all segmentations of the first 0, 1, ... characters, and the logarithms of their scales; ``weights`` by piece and language."""
    n, length = pieces[0].shape
    recent, scale = [np.ones((n, weights.shape[1]))], 0.0
    sums, scales = [recent[0]], [scale]
    for end in range(1, length + 1):
        total = np.zeros_like(sums[0])
        for size in range(1, min(end, len(pieces)) + 1):
            used = pieces[size - 1][:, end - size]
            hit = np.flatnonzero(used >= 0)
            total[hit] += recent[-size][hit] * weights[used[hit]]
        recent = [*recent[1 - len(pieces):], total] if len(pieces) > 1 else [total]
        if end % RESCALE == 0:
            recent, scale = _scaled(recent, scale)
        sums.append(recent[-1])
        scales.append(scale)
    return sums, scales


def backward(pieces: list[np.ndarray], weights: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list]:
    """The same over all segmentations from a place to the end of each word; 0 beyond it."""
    n, length = pieces[0].shape
    recent, scale = [(ends == length).astype(float)[:, None]], 0.0
    sums, scales = [recent[0]], [scale]
    for start in range(length - 1, -1, -1):
        total = np.zeros((n, 1))
        for size in range(1, min(length - start, len(pieces)) + 1):
            used = pieces[size - 1][:, start]
            hit = np.flatnonzero(used >= 0)
            total[hit] += recent[-size][hit] * weights[used[hit]]
        total[ends == start] = 1.0
        recent = [*recent[1 - len(pieces):], total] if len(pieces) > 1 else [total]
        if (length - start) % RESCALE == 0:
            recent, scale = _scaled(recent, scale)
        sums.append(recent[-1])
        scales.append(scale)
    return sums[::-1], scales[::-1]


def expected(pieces: list[np.ndarray], weights: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, by language, in words that occur ``counts`` (word x language) times; one weight column."""
    n, length = pieces[0].shape
    before, before_scales = forward(pieces, weights)
    after, after_scales = backward(pieces, weights, ends)
    whole, whole_scale = after[0], after_scales[0]
    out = np.zeros((len(weights), counts.shape[1]))
    for size in range(1, len(pieces) + 1):
        for start in range(length - size + 1):
            used = pieces[size - 1][:, start]
            hit = np.flatnonzero((used >= 0) & (ends >= start + size))
            share = before[start][hit] * weights[used[hit]] * after[start + size][hit] / whole[hit]
            scales = before_scales[start] + after_scales[start + size] - whole_scale
            if not np.isscalar(scales):
                share = share * np.exp(scales[hit])
            for language in range(counts.shape[1]):
                out[:, language] += np.bincount(used[hit], share[:, 0] * counts[hit, language], minlength=len(weights))
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of about one length each: their numbers, their characters and where they end."""
    lengths: dict[int, list[int]] = {}
    for number, word in enumerate(words):
        n = len(word) + 1
        lengths.setdefault(n if n <= RESCALE else -(-n // FILL) * FILL, []).append(number)
    for length, numbers in lengths.items():
        step = max(1, 50_000 * RESCALE // max(length, RESCALE))
        for i in range(0, len(numbers), step):
            some = numbers[i:i + step]
            yield (np.array(some), _codes([(START + words[k]).ljust(length, "\0") for k in some]), np.array([len(words[k]) + 1 for k in some]))


def in_part(key: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of a key, as text, leaves the remainder ``part``; a null key counts as empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % parts == part


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities (pieces x languages). On the driver: languages x vocabulary numbers."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    known = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, find = vocabulary(path), regex.compile(LETTERS).findall
        weights = np.full((pieces.size + 1, 1), 1.0 / (pieces.size + 1))
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, dict[str, int]] = {}
        chars = 0

        def add() -> None:
            for language, words in seen.items():
                total = totals.setdefault(language, np.zeros(pieces.size + 1))
                times = np.fromiter(words.values(), np.float64, len(words))
                for owners, codes, ends in _by_length(list(words)):
                    total += expected(pieces.pieces(codes), weights, times[owners][:, None], ends)[:, 0]
            seen.clear()

        for batch in batches:
            for body, language in zip(batch.column(0), batch.column(1).to_pylist()):
                lower = body.as_py().lower()
                words = seen.setdefault(language, {})
                for word in find(lower):
                    words[word] = words.get(word, 0) + 1
                chars += len(lower)
                if chars >= COUNTED_CHARS:
                    add()
                    chars = 0
        add()
        for language, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([language] * len(used)), "piece": pa.array(used, pa.int32()),
                                              "n": pa.array(total[used])})

    rows = (known.select(known[f"`{text}`"].cast("string"), known[f"`{lang}`"].cast("string"))
            .mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.full((vocabulary(path).size + 1, len(langs)), SMOOTHING)
    column = np.array([langs.index(x) for x in rows["lang"].to_pylist()], np.int64)
    counts[rows["piece"].to_numpy(), column] += rows["n"].to_numpy()
    return langs, counts / counts.sum(axis=0) if langs else counts


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text",
             path: str | None = None) -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (the posterior under equal priors) of every row."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    langs, probabilities = model
    shared = docs.sparkSession.sparkContext.broadcast(probabilities)  # languages x vocabulary numbers

    class Scores(dict):
        """Number of each word, and its logarithmic score by language."""

        def __init__(self):
            self.table = np.zeros((0, len(langs)))

        def __missing__(self, word):
            number = self[word] = len(self)
            return number

        def complete(self) -> None:
            new = list(self)[len(self.table):]
            table = np.zeros((len(new), len(langs)))
            for owners, codes, ends in _by_length(new):
                table[owners] = scores_of(vocabulary(path).pieces(codes), shared.value, ends)
            self.table = np.concatenate([self.table, table])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, scores = regex.compile(LETTERS).findall, Scores()

        def lot(keys: list, runs: list) -> pa.RecordBatch:
            scores.complete()
            found, sure = [], []
            for run in runs:
                if not len(run) or not langs:
                    found.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                total = scores.table[run].sum(axis=0)
                best = int(np.argmax(total))
                found.append(langs[best])
                sure.append(float(1.0 / np.exp(total - total[best]).sum()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string()), pa.array(sure, pa.float64())],
                                              [key, "lang_pred", "score"])

        for batch in batches:
            keys, runs, chars = [], [], 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                lower = (body.as_py() or "").lower()
                words = find(lower)
                keys.append(doc)
                runs.append(np.fromiter(map(scores.__getitem__, words), np.int32, len(words)))
                chars += len(lower)
                if chars >= LOT_CHARS:
                    yield lot(keys, runs)
                    keys, runs, chars = [], [], 0
                    if len(scores) > REMEMBERED:
                        scores = Scores()
            if keys:
                yield lot(keys, runs)

    return docs.select(docs[f"`{key}`"].cast("bigint"), docs[f"`{text}`"].cast("string")).mapInArrow(
        predict, f"`{key}` bigint, lang_pred string, score double")
