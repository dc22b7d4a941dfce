"""Toxicity by a sparse logistic model that is held to equal scores when identity terms are swapped.

Features are the distinct words of a text and their beginnings of four and five letters (so that inflected forms
share what they have learned). The model is fitted on a bounded sample of labelled documents (``SAMPLE`` of them at most, those with
the smallest hash of their id): features that go with the label are kept, then logistic loss is minimised together with an L1
term and the counterfactual term: for each labelled document that names a group, identity terms are swapped for others
of their list, and the squared change of the score is penalised. A term of identity can so never carry weight that its siblings don't.

Scoring reads whole texts, without a shuffle; the model is a few thousand weights at most (``FEATURES``).

Defined results: null and empty texts get the score of a text without features; without labelled rows of both kinds
every score is 0; documents labelled twice count by their larger label; repeated rows are scored alike; an empty table gives no rows;
labels, language, source and id are no features. All columns are kept by ``score``, but for one of its own name.
"""

from __future__ import annotations

import re
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.llm.common import stored, travels

travels(__name__)

# Documents the model is fitted on, at most.
SAMPLE = 16_000
# Features kept for fitting, at most; each must occur in so many sampled documents and differ by so many standard errors.
FEATURES, LEAST_DOCS, LEAST_Z = 4_000, 4, 4.5
# The L1 term is L1 / sqrt(documents), as the noise of a weight is.
L1, COUNTERFACTUAL, STEPS, RATE = 6e-3, 1.0, 300, 0.1
THRESHOLD = 0.3
REMEMBERED = 500_000

# Identity terms, by lists within which a term can stand for another. Fixed values.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrants", "refugees", "migrants", "foreigners", "citizens"), ("immigrant", "refugee", "migrant", "foreigner", "citizen"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_words = re.compile(r"[^\W\d_]+").findall


class Model(NamedTuple):
    weights: dict[int, float]
    bias: float


def _hash(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) - (1 << 63)


class Features(dict):
    """Features of a word, as 64-bit hashes: the word, and its beginnings if it is longer."""

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = (_hash(word), *(_hash(f"{word[:n]}-") for n in (4, 5) if len(word) >= n))
        return found


def swapped(words: set[str], turn: int = 1) -> set[str] | None:
    """The words with every identity term exchanged for the one ``turn`` places further in its list; None without any."""
    siblings = {term: terms[(k + turn) % len(terms)] for terms in IDENTITY for k, term in enumerate(terms)}
    return {siblings.get(w, w) for w in words} if any(w in siblings for w in words) else None


def _bags(column: pa.Array) -> list[set[str]]:
    return [set(_words((t.as_py() or "").lower())) for t in column]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, and labelled ones, with each feature."""
    features = Features()
    for batch in batches:
        counts: dict[int, list[int]] = {}
        for bag, label in zip(_bags(batch.column(0)), batch.column(1).to_pylist()):
            for f in {f for w in bag for f in features[w]}:
                count = counts.setdefault(f, [0, 0])
                count[0] += 1
                count[1] += label
        seen, marked = zip(*counts.values()) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(seen, pa.int64()), pa.array(marked, pa.int64())],
                                         ["feature", "seen", "marked"])


def sample_features(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE):
    """Of the sampled labelled documents, on the driver: the features that go with the label (``FEATURES`` at most, sorted), and by document
    its label, which of them it has, and which it has with its identity terms swapped (null without any)."""
    known = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_id")).agg(
        F.max(F.when(F.col(f"`{label}`") > 0, 1).otherwise(0)).alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].cast("string").alias("text"))
    # Copies of an id in ``docs`` are one labelled text.
    joined = stored(texts.join(chosen, texts["_key"] == chosen["_id"]).groupBy("_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
                    .select("text", "label"), "labelled")
    total = joined.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("marked")).first()
    n, rate = total["n"], total["marked"] / max(total["n"], 1)
    if not 0 < rate < 1:
        return np.zeros(0, np.int64), joined.limit(0).selectExpr("label", "array(1) AS has", "array(1) AS swapped").toArrow(), rate
    counted = joined.mapInArrow(_counted, "feature bigint, seen bigint, marked bigint").groupBy("feature").agg(
        F.sum("seen").alias("seen"), F.sum("marked").alias("marked"))
    spread = F.sqrt(F.col("seen") * rate * (1 - rate) * F.greatest(1 - F.col("seen") / n, F.lit(1e-9)))
    strong = counted.withColumn("z", F.abs(F.col("marked") - F.col("seen") * rate) / spread).where((F.col("seen") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z))
    picked = sorted(r["feature"] for r in strong.orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect())
    places = {f: k for k, f in enumerate(picked)}

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        has = lambda words: sorted({places[f] for w in words for f in features[w] if f in places})
        for batch in batches:
            bags = _bags(batch.column(0))
            pairs = [swapped(b) for b in bags]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array([has(b) for b in bags], pa.list_(pa.int32())),
                pa.array([None if p is None else has(p) for p in pairs], pa.list_(pa.int32()))], ["label", "has", "swapped"])

    return np.array(picked, np.int64), joined.mapInArrow(shown, "label int, has array<int>, swapped array<int>").toArrow(), rate


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the lists, and the list of each."""
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def fit(known: np.ndarray, rows: pa.Table, rate: float) -> Model:
    """Logistic loss, an L1 term and the counterfactual term, minimised by Adam with soft thresholds."""
    if not 0 < rate < 1:
        return Model({}, float("-inf"))
    label, n, size = rows["label"].to_numpy().astype(np.float64), len(rows), len(known)
    at, owner = _flat(rows["has"].combine_chunks())
    swaps = rows["swapped"].combine_chunks()
    origin = np.flatnonzero(~swaps.is_null().to_numpy(zero_copy_only=False))
    at_pair, pair = _flat(swaps.drop_null())
    weights, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    weights[-1] = np.log(rate / (1 - rate))
    dot = lambda a, o, count: np.bincount(o, weights[a], minlength=count)
    for step in range(1, STEPS + 1):
        score = dot(at, owner, n)
        error = (1 / (1 + np.exp(-np.clip(score + weights[-1], -30, 30))) - label) / n
        back, change = error.copy(), None
        if len(origin):
            change = COUNTERFACTUAL * 2 * (score[origin] - dot(at_pair, pair, len(origin))) / len(origin)
            np.add.at(back, origin, change)
        gradient = np.append(np.bincount(at, back[owner], minlength=size), error.sum())
        if change is not None:
            gradient[:-1] -= np.bincount(at_pair, change[pair], minlength=size)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient ** 2
        scale = RATE / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
        weights -= scale * first / (1 - 0.9 ** step)
        weights[:-1] = np.sign(weights[:-1]) * np.maximum(np.abs(weights[:-1]) - scale[:-1] * L1 / np.sqrt(n), 0)
    return Model({int(f): float(w) for f, w in zip(known, weights) if w}, float(weights[-1]))


def scorer(model: Model):
    """A function of a text column: its score, from 0 to 1."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        class Weighty(dict):
            """Of each word, the features that have a weight."""

            def __missing__(self, word):
                if len(self) >= REMEMBERED:
                    self.clear()
                found = self[word] = tuple(f for f in features[word] if f in model.weights)
                return found

        features, weighty = Features(), Weighty()
        for batch in batches:
            totals = np.empty(len(batch))
            for k, text in enumerate(batch):
                used = {f for w in set(_words((text or "").lower())) for f in weighty[w]}
                totals[k] = model.bias + sum(sorted(model.weights[f] for f in used))
            yield pd.Series(1 / (1 + np.exp(-np.clip(totals, -700, 700))))

    return scored


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score of each row; a column of that name is replaced."""
    if not np.isfinite(model.bias):
        return docs.withColumn(to, F.lit(0.0))
    return docs.withColumn(to, scorer(model)(docs[f"`{text}`"].cast("string")))
