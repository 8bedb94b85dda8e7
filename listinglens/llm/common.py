"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: texts are long, and a worker holds one batch at a time.
ARROW_ROWS, ARROW_BYTES = 500, 32 << 20
#: A key is hot if it has over 1 / HOT of all rows: fewer than HOT keys are, so what joins them can be broadcast.
HOT = 1000
#: Bits of a Bloom filter for each key at least, while it has fewer than BLOOM_MOST (16 MB), and places that a key sets.
BLOOM_BITS, BLOOM_MOST, PLACES = 16, 1 << 27, 4


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table under sf_dir; with columns, only those are scanned."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches at ARROW_ROWS and ARROW_BYTES, so that a batch of long texts fits a Python worker.

    Spark reads both settings when a plan runs, so they stay set afterwards.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset on one machine (tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(found)
    return found


def stage_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends at files that every executor can reach."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """left joined with right on key, where a key may have a large share of left's `total` rows.

    right has at most a few rows for each key, and in `count` how many rows of
    left have that key; the column is dropped. Rows of right for hot keys,
    fewer than HOT keys, are broadcast; the other keys meet in a shuffle.
    """
    if total <= HOT:
        return left.join(right.drop(count), key)
    hot = stage_table(right.where(F.col(count) * HOT > F.lit(max(total, HOT * HOT))).drop(count), "hot-keys")
    rest = right.drop(count)
    if hot.isEmpty():
        return left.join(rest, key)
    keys = F.broadcast(hot.select(key).distinct())
    return left.join(F.broadcast(hot), key).unionByName(left.join(keys, key, "left_anti").join(rest, key))


def _hashes(key: str) -> list:
    return [F.xxhash64(F.lit(i), key) for i in range(PLACES)]


def bloom(keys: DataFrame, key: str) -> np.ndarray:
    """The bytes of a Bloom filter of the keys; a power of two, BLOOM_MOST bits at most, so very many keys let more others through."""
    bits = min(BLOOM_MOST, 1 << (BLOOM_BITS * max(keys.count(), 4096)).bit_length())
    at = keys.select(F.explode(F.array(*[F.pmod(h, F.lit(bits)) + 1 for h in _hashes(key)])).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    table = np.zeros(bits // 8, np.uint8)
    for r in parts.toArrow().to_pylist():  # 4096 bytes each
        table[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return table


def _may_hold(table: np.ndarray, hashes: tuple[pd.Series, ...]) -> np.ndarray:
    """False where the filter has no such key."""
    found = np.ones(len(hashes[0]), bool)
    for h in hashes:
        at = h.to_numpy(np.int64) & (8 * len(table) - 1)
        found &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def without_keys(rows: DataFrame, keys: DataFrame, key: str, every: DataFrame) -> DataFrame:
    """The rows whose key is not in keys, or null: an exact anti-join in which keys are shuffled, and no rows unless very many keys fill the filters.

    keys and every have the column key alone, keys no nulls; every has the keys
    of all rows, or more. A Bloom filter holds keys, a second one what the
    first takes for one of them, and the keys that the second one takes for
    such, few if any, are joined.
    """
    small_batches(rows.sparkSession)
    context = rows.sparkSession.sparkContext

    def held_by(table: np.ndarray):
        shared = context.broadcast(table)

        @F.pandas_udf("boolean")
        def test(*hashes: pd.Series) -> pd.Series:
            return pd.Series(_may_hold(shared.value, hashes))

        return test(*_hashes(key))

    first = held_by(bloom(keys, key))
    path = fresh_path(rows.sparkSession, "taken-for-keys")
    wrong = stage_table(every.where(first).distinct().join(keys, key, "left_anti"), "taken-for-keys", path)
    second = held_by(bloom(wrong, key))
    remove(rows.sparkSession, path)
    kept, back = rows.where(~first | second), keys.where(second)
    n = back.count()
    return kept.join(F.broadcast(back) if n <= HOT else back, key, "left_anti") if n else kept


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id as decimal text, modulo modulus: the fixed fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id, modulus: int, fold: int):
    """Whether a document is of the fold that is never learned from; a null id is of none."""
    return F.coalesce(crc_bucket(doc_id, modulus) == fold, F.lit(False))


def sampled(rows: DataFrame, bound: int, most_bytes: int, text: str = "text") -> DataFrame:
    """About `bound` rows that hold about `most_bytes` of text, or all if there are fewer; chosen by a hash of doc_id and text."""
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
    n, held = rows.agg(F.count("*"), size).first()
    share = min(1.0, bound / max(1, n), most_bytes / max(1, held))
    return rows.where(F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 40)) < int(share * (1 << 40)))
