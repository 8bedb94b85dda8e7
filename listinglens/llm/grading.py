"""Quality grades by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.common import held_out, sampled, small_batches
from listinglens.llm.hashed import SIZE, minimise, word_slots

#: Fold that is never learned from, of FOLDS; rated rows, and bytes of them, that the model is fitted on, in expectation.
FOLDS, HELD_OUT, FIT_ROWS, FIT_BYTES = 5, 0, 12_000, 100_000_000
#: Weight of the squared norm of the weights; the grade a kept text reaches more likely than not.
RIDGE, KEEP_GRADE = 2.0, 1


@dataclass
class Grader:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . features), thresholds in order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        slots, values = features(text)
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - self.weights[slots] @ values, -40, 40)))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of words and word shapes: square roots of counts, scaled to unit length times two."""
    slots, counts = word_slots(text, shapes=True)
    values = np.sqrt(counts)
    return slots, 2.0 * values / max(1e-9, float(np.sqrt((values**2).sum())))


@dataclass
class Sparse:
    """Features of n texts: parallel arrays of text, slot and value."""

    n: int
    row: np.ndarray
    slot: np.ndarray
    value: np.ndarray


def cuts_of(x: np.ndarray, n: int) -> np.ndarray:
    """The ordered thresholds behind n weights in a parameter vector: the first, and the logarithms of the gaps."""
    return np.concatenate(([x[n]], x[n] + np.cumsum(np.exp(np.clip(x[n + 1 :], -10, 5)))))


def ordinal_loss(data: Sparse, grades: np.ndarray, n_slots: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Negative log-likelihood of the cumulative-link model with ridge, and its gradient, over n_slots weights and cuts_of."""
    top = int(grades.max())

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, cuts = x[:n_slots], cuts_of(x, n_slots)
        score = np.bincount(data.row, weights[data.slot] * data.value, data.n)
        upper = np.where(grades < top, cuts[np.minimum(grades, top - 1)] - score, 40.0)
        lower = np.where(grades > 0, cuts[np.maximum(grades - 1, 0)] - score, -40.0)
        high, low = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
        mass = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / mass * (grades < top), low * (1 - low) / mass * (grades > 0)
        gcut = np.zeros(top)
        np.add.at(gcut, np.minimum(grades, top - 1), -dh)
        np.add.at(gcut, np.maximum(grades - 1, 0), dl)
        tail = np.cumsum(gcut[::-1])[::-1]  # a gap moves every threshold from its own on
        slopes = np.bincount(data.slot, (dh - dl)[data.row] * data.value, n_slots) + RIDGE * weights
        return float(-np.log(mass).sum() + RIDGE / 2 * (weights @ weights)), np.concatenate((slopes, [tail[0]], tail[1:] * np.diff(cuts)))

    return loss


def fit_sparse(data: Sparse, grades: np.ndarray) -> Grader:
    """Maximum likelihood of the cumulative-link model with ridge; thresholds are a first one and positive gaps."""
    top = int(grades.max(initial=0))
    if top == 0 or not data.n:
        return Grader(np.zeros(SIZE), np.zeros(max(1, top)))
    used, col = np.unique(data.slot, return_inverse=True)
    dense = Sparse(data.n, data.row, col.astype(np.int32), data.value)
    share = np.cumsum(np.bincount(grades, minlength=top + 1))[:top] / len(grades)
    cuts = np.log(np.clip(share, 0.001, 0.999) / (1 - np.clip(share, 0.001, 0.999)))
    start = np.concatenate((np.zeros(len(used)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))))
    x = minimise(ordinal_loss(dense, grades, len(used)), start)
    full = np.zeros(SIZE)
    full[used] = x[: len(used)]
    return Grader(full, cuts_of(x, len(used)))


def fit_rows(texts: list[str], grades: np.ndarray) -> Grader:
    """fit_sparse of the features of some texts."""
    parts = [features(t) for t in texts]
    row = np.repeat(np.arange(len(parts)), [len(s) for s, _ in parts])
    slot, value = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int) for i in (0, 1))
    return fit_sparse(Sparse(len(parts), row, slot, value), grades)


def graded(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, grade): 0 low quality, 1 good but toxic, 2 good; the lowest of a document's ratings."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame) -> Grader:
    """Fit on about FIT_ROWS rated rows outside the held-out fold; ratings has doc_id and grade 0, 1, ...

    Of a document's ratings the lowest counts, and null ids, texts and grades
    are left out. Rows are sampled after the join, so an id that repeats
    brings in no more; equal rows count once. Features are made in the tasks:
    the driver gathers slots and values, not texts.
    """
    small_batches(docs.sparkSession)
    rated = ratings.where("doc_id is not null and grade is not null").where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    rated = rated.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    few = sampled(rated.withColumn("text", F.lit("")), FIT_ROWS, FIT_BYTES).drop("text")  # about FIT_ROWS ids
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id")
    rows = sampled(rows, FIT_ROWS, FIT_BYTES).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "grade").distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            slots, values = pa.array([s for s, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), slots, values], ["doc_id", "mark", "grade", "slots", "values"])

    told = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"), "grade")
    table = told.mapInArrow(read, "doc_id long, mark long, grade int, slots array<int>, values array<float>").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    lengths = table["slots"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    slot, value = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("slots", "values"))
    data = Sparse(len(table), np.repeat(np.arange(len(table), dtype=np.int32), lengths), slot, value)
    return fit_sparse(data, table["grade"].to_numpy().astype(int))


def grade(docs: DataFrame, grader: Grader) -> DataFrame:
    """Rows (doc_id, held_out, expected_grade, tail_probability, kept), one per input row.

    expected_grade sums P(grade > k); tail_probability is that of the highest
    grade; kept: KEEP_GRADE or more is likelier than not. Null and empty texts
    have no features and get the thresholds' own odds; a null id stays null
    and is not held out; repeated rows are each graded; only the text is read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = [shared.value.tails(t) for t in batch.column(1).to_pylist()]
            cells = [
                pa.array([float(t.sum()) for t in tails], pa.float64()),
                pa.array([float(t[-1]) for t in tails], pa.float64()),
                pa.array([bool(t[min(KEEP_GRADE, len(t)) - 1] >= 0.5) for t in tails], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["doc_id", "expected_grade", "tail_probability", "kept"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = narrow.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
    held = held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out")
    return found.select("doc_id", held, "expected_grade", "tail_probability", "kept")
