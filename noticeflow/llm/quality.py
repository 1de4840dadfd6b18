"""Quality grades of documents from an ordinal regression on hashed words, trained on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import chunks, words

#: Bytes that part words: ASCII that is neither letter nor digit.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWERED = np.frombuffer(words.LOWER_TABLE, dtype=np.uint8)
SYMBOL = GAP & ~words.SPACE
BITS = 18


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features and the thresholds between ``len(thresholds) + 1`` grades, in ascending order."""

    index: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def features(data: np.ndarray) -> np.ndarray:
    """Hashed features that a text has: its words, and ranges of what its form measures."""
    data = LOWERED[data]
    starts, ends = words.spans(data, GAP)
    found, counts = np.unique(words.word_hashes(data, starts, ends), return_counts=True)
    n = max(len(starts), 1)
    spaces = int(np.count_nonzero(words.SPACE[data]))
    form = (
        np.log2(n),
        40 * np.count_nonzero(SYMBOL[data]) / max(len(data), 1),
        20 * len(found) / n,
        20 * (counts.max() if len(counts) else 0) / n,
        (ends - starts).sum() / n,
        10 * (spaces + 1) / n,
        40 * np.count_nonzero((data >= 0x30) & (data <= 0x39)) / max(len(data), 1),
    )
    ranges = np.array([(i + 1) << 20 | int(x) for i, x in enumerate(form)], dtype=np.uint64)
    return np.unique(np.concatenate([found, words.mix(ranges)]) >> np.uint64(64 - BITS)).astype(np.int32)


def _featured(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = chunks.text_bytes(batch.column("text"))
    for at, to in zip(offsets[:-1], offsets[1:], strict=True):
        yield features(data[at:to])


def train(
    documents: DataFrame,
    ratings: DataFrame,
    id_col: str,
    text_col: str,
    rating_col: str,
    grades: int,
    most_ratings: int = 20_000,
    passes: int = 8,
    rate: float = 1.0,
    l1: float = 8.0,
    seed: int = 42,
) -> Model:
    """Cumulative-link model: one weight per feature, P(grade <= k) = sigmoid(threshold k - score).

    ``ratings``: (id, grade from 0). It is fitted on at most ``most_ratings`` of them, chosen by a hash of the id, which
    one task holds; ratings that are null or out of range, and ratings without a document, take no part. Weights follow
    the proximal gradient with an L1 bound, which leaves most words at zero, so that long texts gather no noise.
    Without any ratings all grades are equally likely.
    """
    chosen = (
        ratings.select(F.col(id_col).alias("id"), F.col(rating_col).cast("int").alias("grade"))
        .where(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1))
        .orderBy(F.xxhash64(F.lit(seed), "id"), "grade")
        .limit(most_ratings)
    )
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rated = texts.join(F.broadcast(chosen), "id")  # at most ``most_ratings`` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in _featured(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("grade"), pa.array(found, pa.binary())],
                ["id", "grade", "found"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["id"], r["grade"], r["found"]))
        sets = [np.frombuffer(r["found"], dtype=np.int32) for r in rows]
        weights, thresholds = _fit(sets, [r["grade"] for r in rows], grades, passes, rate, l1, seed)
        index = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (index.astype(np.int32), weights[index], thresholds)],
            ["index", "weights", "thresholds"],
        )

    one = rated.mapInArrow(extract, "id string, grade int, found binary").repartition(1)
    row = one.mapInArrow(fit, "index binary, weights binary, thresholds binary").first()
    if row is None:
        return Model(np.empty(0, np.int32), np.empty(0), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    return Model(
        np.frombuffer(row["index"], np.int32), np.frombuffer(row["weights"]), np.frombuffer(row["thresholds"])
    )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(sets, labels, grades: int, passes: int, rate: float, l1: float, seed: int):
    """FTRL-proximal over the rated texts in random order; thresholds move with a gradient of their own."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = (np.cumsum(np.bincount(labels, minlength=grades))[:-1] + 1) / (len(labels) + grades)
    thresholds = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    squares = np.ones(grades - 1)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(labels)):
            at, k = sets[i], labels[i]
            zi, root = z[at], np.sqrt(n[at])
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1 + root) / rate))
            score = w.sum()
            below = _sigmoid(thresholds - score)
            low = below[k - 1] if k else 0.0
            high = below[k] if k < grades - 1 else 1.0
            gradient = 1 - low - high
            new = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(new) - root) / rate * w
            n[at] = new
            p = max(high - low, 1e-6)
            for t, sign in ((k - 1, 1.0), (k, -1.0)):
                if 0 <= t < grades - 1:
                    step = sign * below[t] * (1 - below[t]) / p
                    squares[t] += step * step
                    thresholds[t] -= rate * step / np.sqrt(squares[t])
            thresholds = np.maximum.accumulate(thresholds + 0)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / rate))
    return w, thresholds


def grade(documents: DataFrame, model: Model, text_col: str, name: str = "quality") -> DataFrame:
    """All columns and a struct ``name``: ``expected`` grade, and ``at_least``, the probabilities of grades from 1 up.

    Null and empty texts are graded by their form alone. A column that already has that name is replaced. Rows stay as
    they are, repeated or not.
    """
    # the text goes along in a column of its own, and the other columns as they are
    kept = [c for c in documents.columns if c != name]
    own = "_score"
    while own in kept or own == name:
        own += "_"
    score = _scorer(model)(F.coalesce(F.col(text_col), F.lit("")))
    at_least = F.transform(
        F.array(*[F.lit(float(t)) for t in model.thresholds]), lambda t: 1 / (1 + F.exp(t - F.col(own)))
    )
    graded = documents.select(*[F.col(f"`{c}`") for c in kept], score.alias(own))
    expected = F.aggregate(at_least, F.lit(0.0), lambda a, x: a + x)
    return graded.withColumn(name, F.struct(expected.alias("expected"), at_least.alias("at_least"))).drop(own)


def _scorer(model: Model):
    index, weights = model.index, model.weights

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << BITS)
        table[index] = weights
        for texts in batches:
            data, offsets = chunks.text_bytes(texts)
            spans = zip(offsets[:-1], offsets[1:], strict=True)
            yield pa.array([float(table[features(data[a:b])].sum()) for a, b in spans], pa.float64())

    return score
