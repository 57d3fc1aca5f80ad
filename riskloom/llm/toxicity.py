"""Toxicity as a severity grade, by cumulative-link ordinal regression on sparse text features.

Grades: 0 for documents labelled clean; toxic ones are 1, or 2 where they have more marked words than the
median toxic one, where marked words are those that toxic documents use far more often. One weight vector serves both
thresholds: P(grade > k) = sigmoid(w x - t_k), t_0 < t_1. Features are hashed words and word beginnings, each
counted once; those that do not mark toxicity have no weight. The output is the expected severity, the sum of both tails.

``fit`` uses at most about ``BOUND`` labelled documents chosen by a hash of the id; counts, grades and weights come from them.
Defined results: null or empty text has severity of its bias alone; without both labels the model says 0 everywhere; a
document labelled twice counts twice; labels other than 0 and 1 are left out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import in_parts, in_share, kind_of, sample_share, written

BOUND, ROUNDS, RATE, DECAY, STRENGTH, LEAST, MARK = 8_000, 1_000, 0.5, 1e-4, 6.0, 8, 12.0
#: Everything below the letters of ASCII, and its other signs, separates words.
_FOLD = {i: " " for i in range(128) if not chr(i).isalnum()}


def features(text: str | None) -> np.ndarray:
    """Distinct hashed words and their beginnings of 4 to 6 characters, which inflected words share."""
    words = set((text or "").lower().translate(_FOLD).split())
    parts = words | {f"{w[:n]}*" for w in words for n in (4, 5, 6) if len(w) >= n}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 for w in parts), np.int64, len(parts)))


class Ordinal:
    """Cumulative links with shared weights: ``weights`` of the features ``marks``, in sorted order, and two thresholds."""

    def __init__(self, marks: np.ndarray | None = None) -> None:
        self.marks = np.zeros(0, np.int64) if marks is None else marks
        self.weights, self.cuts = np.zeros(len(self.marks)), np.array([50.0, 51.0])

    def places(self, words: np.ndarray) -> np.ndarray:
        """Places of a text's features among the marks."""
        at = np.minimum(np.searchsorted(self.marks, words), max(len(self.marks) - 1, 0))
        return at[self.marks[at] == words] if len(self.marks) else at[:0]

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > 0) and P(grade > 1) for each row of places."""
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        score = np.bincount(owner, self.weights[flat], len(rows))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -50, 50)))

    def train(self, rows: list[np.ndarray], grades: np.ndarray) -> None:
        """Full-batch gradient of the cumulative log likelihood with adaptive steps."""
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        self.cuts = np.array([1.0, 2.0])
        gather, past = np.zeros_like(self.weights), np.zeros(2)
        weight = np.where(grades > 0, 3.0, 1.0) / len(rows)
        for _ in range(ROUNDS):
            up = self.tails(rows)
            lower, upper = np.column_stack([np.ones(len(rows)), up])[np.arange(len(rows)), grades], np.column_stack([up, np.zeros(len(rows))])[np.arange(len(rows)), grades]
            chance = np.maximum(lower - upper, 1e-9)
            d_low, d_up = lower * (1 - lower) / chance * weight, upper * (1 - upper) / chance * weight
            slope = d_up - d_low
            step = np.bincount(flat, slope[owner], len(self.weights)) + DECAY * self.weights / len(rows)
            gather += step**2
            self.weights -= RATE * step / (np.sqrt(gather) + 1e-8)
            cut = np.array([d_low[grades == k + 1].sum() - d_up[grades == k].sum() for k in (0, 1)])
            past += cut**2
            self.cuts -= RATE * cut / (np.sqrt(past) + 1e-8)
            self.cuts[1] = max(self.cuts[1], self.cuts[0] + 0.1)


def marked_words(sample: DataFrame) -> np.ndarray:
    """The features that toxic documents have ``MARK`` times as often, by more than ``STRENGTH`` standard errors; sorted.

    sample: toxic, words. Only the marks reach the driver; there are at most sample words / LEAST of them."""
    n0, n1 = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    counts = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    toxic, clean, pooled = F.col("k") / n1, (F.col("n") - F.col("k")) / n0, F.col("n") / (n0 + n1)
    z = (toxic - clean) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    marks = counts.where((F.col("n") >= LEAST) & (toxic > MARK * clean) & (z > STRENGTH)).select("word").toArrow()
    return np.sort(marks.column("word").to_numpy())


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int = BOUND) -> Ordinal:
    """Trained on labelled documents."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("_toxic"))
    share = {row[0]: sample_share(row[1], bound // 2) for row in known.groupBy("_toxic").count().collect()}
    model = Ordinal()
    if len(share) < 2:
        return model
    # the sample has about ``bound`` ids at any size of the tables, so it can be sent to all tasks
    chosen = known.where(F.when(F.col("_toxic") == 1, in_share(id_col, share[1], 41)).otherwise(in_share(id_col, share[0], 41)))
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).dropDuplicates([text_col, "_toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["toxic", "words"])

    held = written(sample.select(F.col("_toxic").cast("int"), text_col).mapInArrow(run, "toxic int, words array<bigint>"), "toxic")
    if held.select("toxic").distinct().count() < 2:
        return model
    model = Ordinal(marked_words(held))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [sent.value.places(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int64()))], names=["toxic", "places"])

    got = held.mapInArrow(place, "toxic int, places array<bigint>").toArrow()
    rows = sorted((t, x) for t, x in zip(got.column("toxic").to_pylist(), got.column("places").to_pylist()))
    toxic, places = np.array([t for t, _ in rows]), [np.array(x, np.int64) for _, x in rows]
    marked = np.array([len(x) for x in places])
    grades = np.where(toxic == 1, 1 + (marked > np.median(marked[toxic == 1])), 0)
    model.train(places, grades)
    return model


def predict(docs: DataFrame, id_col: str, text_col: str, model: Ordinal) -> DataFrame:
    """id, ``severity`` (0 to 2), ``grade`` and ``toxic`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in in_parts(batch, 1, 4_000_000):
                tails = model.tails([model.places(features(x)) for x in part.column(1).to_pylist()]).round(6)
                columns = [pa.array(tails.sum(1).round(6)), pa.array((tails >= 0.5).sum(1).astype(np.int32)), pa.array(tails[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, "severity", "grade", "toxic"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind_of(docs, id_col)}, severity double, grade int, toxic boolean")
