"""Hard negatives: for each anchor and positive the best rows of other labels that score just under the positive.

An anchor's positives limit windows of scores from above. Their limits split
the scores into disjoint slots, so that a row is looked at for one slot only,
not for every window that holds it. Tasks keep the best rows of each slot, a
window function keeps those of all tasks, and merges from the lowest slot
upwards answer every window: its rows are those of its slot and all below.

The query set is stated (the anchors), and meets all rows: blocks of anchors
of bounded bytes go to the tasks, which pass over the rows twice, once for the
positives and once for the slots.

Rows with a null id, label, vector or component, or a component that is not
finite, take no part. Vectors of different lengths do not meet. A row with the
anchor's id is no positive of it; an id that repeats stands for as many rows.
Scores are exact: where 64-bit floats cannot hold them, integers do. A score
beyond LAST counts as LAST, on either side. Tables without rows or anchors give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.llm.common import fresh_path, remove, small_batches, stage_table

#: Bytes of the anchors that tasks get at a time.
BLOCK_BYTES = 16 << 20
#: Components of one product's left side, and anchors of its right.
CHUNK, ANCHORS = 1 << 19, 256
#: A component x becomes floor(SCALE * x).
SCALE = 256
#: The largest score.
LAST = (1 << 63) - 1


def quantised(rows: DataFrame, vec_id: str, label: Column, vector: str) -> DataFrame:
    """Rows (id, label, q) of those that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    there = F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & sound
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.where(there).select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by smaller id, in this order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        want = k - len(above)
        if len(equal) > want:
            equal = equal[np.argpartition(ids[equal], want - 1)[:want]]
        some = np.concatenate([above, equal])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, up to LAST."""
    bound = int(np.abs(x.astype(float)).max(initial=0)) * int(np.abs(y.astype(float)).max(initial=0)) * max(1, x.shape[1])
    if bound < 1 << 53:
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    if bound < 1 << 62:
        return x @ y.T
    return np.clip(x.astype(object) @ y.T.astype(object), -LAST, LAST).astype(np.int64)


def slots(scores: list[int], least: int) -> list[tuple[int, int, int]]:
    """Disjoint (slot, low, high), both ends inclusive, of the windows under positives' scores; highest first.

    A window reaches from `least` per cent of the score to the score, so under
    a negative score there is none. Slots hold no scores that no window holds.
    """
    limits = sorted({s for s in scores if s >= 0}, reverse=True)
    under = [*limits[1:], -1]
    return [(j, max(-(-least * high // 100), below + 1), high) for j, (high, below) in enumerate(zip(limits, under, strict=False))]


class Block:
    """A block of anchors, by vector length and label."""

    def __init__(self, rows: pa.Table):
        self.number, self.ids, self.labels = (rows.column(c).to_numpy() for c in ("a", "id", "label"))
        vectors = rows.column("q").to_pylist()
        sizes = np.array([len(v) for v in vectors])
        self.groups = []
        for size in np.unique(sizes):
            for label in np.unique(self.labels[sizes == size]):
                some = np.flatnonzero((sizes == size) & (self.labels == label))
                self.groups.append((int(size), label, some, np.array([vectors[i] for i in some], np.int64).reshape(len(some), size)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors of one length) of about CHUNK components."""
    held: dict[int, list] = {}

    def joined(size: int) -> tuple:
        ids, labels, x = zip(*held.pop(size), strict=True)
        return np.concatenate(ids), np.concatenate(labels), np.concatenate(x)

    for batch in batches:
        ids, labels, q = (batch.column(i) for i in range(3))
        sizes = np.diff(q.offsets.to_numpy())
        cells, starts = q.values.to_numpy(), q.offsets.to_numpy()[:-1]
        for size in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == size)
            x = cells[starts[some][:, None] + np.arange(size)]
            held.setdefault(size, []).append((ids.to_numpy()[some], labels.to_numpy()[some], x))
            if sum(part[2].size for part in held[size]) >= CHUNK or sum(len(part[0]) for part in held[size]) >= CHUNK // 16:
                yield joined(size)
    for size in list(held):
        yield joined(size)


def _scored(block: Block, batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, ids, scores) of the rows with the anchor's label, or with another, chunk by chunk."""
    for ids, labels, x in _chunks(batches):
        for size, label, some, vectors in block.groups:
            if size != x.shape[1]:
                continue
            rows = np.flatnonzero((labels == label) == same)
            if not len(rows):
                continue
            part, own = x[rows], ids[rows]
            for at in range(0, len(some), ANCHORS):
                scores = products(vectors[at : at + ANCHORS], part)
                for i, row in zip(some[at : at + ANCHORS], scores, strict=True):
                    yield i, own, row


def _merged(kept: dict, key: tuple, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    if key in kept:
        ids, scores = np.concatenate([kept[key][0], ids]), np.concatenate([kept[key][1], scores])
    top = best(scores, ids, k)
    kept[key] = ids[top], scores[top]


def _emitted(kept: dict, block: Block) -> Iterator[pa.RecordBatch]:
    rows = [(int(block.number[i]), int(block.ids[i]), slot, int(x), int(s)) for (i, slot), (ids, scores) in kept.items() for x, s in zip(ids, scores, strict=True)]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "anchor_id", "slot", "id", "score"])


def _positives(block, k: int):
    """mapInArrow's function: each task's k best rows of the anchors' labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for i, ids, scores in _scored(block.value, batches, True):
            other = ids != block.value.ids[i]
            _merged(kept, (i, 0), ids[other], scores[other], k)
        yield from _emitted(kept, block.value)

    return run


def _negatives(block, windows, k: int):
    """mapInArrow's function: each task's k best rows of other labels in every slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for i, ids, scores in _scored(block.value, batches, False):
            for slot, low, high in windows.value.get(int(block.value.number[i]), ()):
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                if len(inside):
                    _merged(kept, (i, slot), ids[inside], scores[inside], k)
        yield from _emitted(kept, block.value)

    return run


#: Room for a score in per cent.
WIDE = "decimal(30,0)"
_ROWS = "a long, anchor_id long, slot int, id long, score long"


def _suffixes(kept: DataFrame, k: int) -> DataFrame:
    """Rows (a, suffixes): for each slot the k best rows of it and all lower ones, by merges from the lowest slot upwards."""
    rows = kept.groupBy("a").agg(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "id")).alias("rows"), F.max("slot").alias("last"))  # k for each slot
    none = F.expr("cast(array() as array<array<struct<minus:bigint,id:bigint>>>)")

    def merge(done: Column, slot: Column) -> Column:
        own = F.transform(F.filter("rows", lambda r: r["slot"] == slot), lambda r: F.struct(r["minus"].alias("minus"), r["id"].alias("id")))
        below = F.coalesce(F.get(done, 0), F.expr("cast(array() as array<struct<minus:bigint,id:bigint>>)"))
        return F.concat(F.array(F.slice(F.array_sort(F.concat(own, below)), 1, k)), done)

    return rows.select("a", F.aggregate(F.sequence("last", F.lit(0), F.lit(-1)), none, merge).alias("suffixes"))


def _mined(rows: DataFrame, anchors: pa.Table, positives: int, negatives: int, least: int) -> DataFrame:
    """The result for one block of anchors."""
    spark = rows.sparkSession
    block = spark.sparkContext.broadcast(Block(anchors))
    order = [F.desc("score"), "id"]
    rank = F.row_number().over(Window.partitionBy("a").orderBy(*order))
    first = rows.mapInArrow(_positives(block, positives), _ROWS).withColumn("r", rank).where(F.col("r") <= positives)
    first = stage_table(first.drop("slot", "r"), "hard-positives")
    scores: dict[int, list[int]] = {}
    for a, score in first.select("a", "score").toLocalIterator():  # `positives` for each anchor of the block
        scores.setdefault(a, []).append(score)
    windows = spark.sparkContext.broadcast({a: slots(s, least) for a, s in scores.items()})
    rank = F.row_number().over(Window.partitionBy("a", "slot").orderBy(*order))
    kept = rows.mapInArrow(_negatives(block, windows, negatives), _ROWS).withColumn("r", rank).where(F.col("r") <= negatives)
    slot = F.dense_rank().over(Window.partitionBy("a").orderBy(F.desc("score"))) - 1  # negative scores have no slot and come last
    asked = first.withColumn("slot", slot).join(_suffixes(kept, negatives), "a")
    held = F.filter(F.get("suffixes", F.col("slot")), lambda n: least * F.col("score").cast(WIDE) <= -100 * n["minus"].cast(WIDE))
    found = asked.where("score >= 0").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(held).alias("i", "n"))
    return found.select(
        "anchor_id", "positive_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.minus")).alias("negative_score")
    )


def mine(vectors: DataFrame, vec_id: str, label: Column, vector: str, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors is a condition on `id`. An anchor's positives are its first other
    rows of the same label, by inner product and then id; a positive's
    negatives the first rows of other labels that score at least `least` per
    cent of the positive's score and not more than it.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    path, asked_path = fresh_path(spark, "hard-rows"), fresh_path(spark, "hard-anchors")
    rows = stage_table(quantised(vectors, vec_id, label, vector), "", path)
    asked = stage_table(rows.where(anchors).withColumn("a", F.monotonically_increasing_id()), "", asked_path)
    held = asked.agg(F.coalesce(F.sum(8 * (F.size("q") + 3)), F.lit(0))).first()[0]
    blocks = max(1, -(-held // BLOCK_BYTES))
    out = fresh_path(spark, "hard-negatives")
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == b).toArrow()  # about BLOCK_BYTES
        _mined(rows, part, positives, negatives, least).write.mode("append").parquet(out)
    remove(spark, path)
    remove(spark, asked_path)
    return spark.read.parquet(out)


#: op12 in DuckDB's SQL.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, row_number() OVER () AS rid
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q)),
p AS (
  SELECT *, row_number() OVER (ORDER BY rid) AS pid
  FROM (SELECT * FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) <= 5)),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.pid ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
