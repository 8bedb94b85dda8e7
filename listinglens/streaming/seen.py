"""Keys that are taken up once, over restarts and without a state that grows: recent ones in keyed state, older ones in a table behind a Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter and places that a key sets. The filter has this size however many keys there are.
BLOOM_BITS, PLACES = 1 << 23, 5
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows (word, bits) that the keys set in the filter."""
    places = [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(PLACES)]
    at = keys.select(F.explode(F.array(*places)).alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    return at.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def may_hold(rows: DataFrame, key: str, words: DataFrame, bits: int) -> DataFrame:
    """rows with `_may`: false only if the key is not in the filter."""
    table, found = np.zeros(bits // 64, np.int64), words.toPandas()  # bits / 64 rows at most
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    held = rows.sparkSession.sparkContext.broadcast(table)
    places = [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(PLACES)]

    @F.pandas_udf("boolean")
    def test(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            out = np.ones(len(columns[0]), bool)
            for at in columns:
                x = at.to_numpy(np.int64)
                out &= (held.value[x // 64] >> (x % 64)) & 1 == 1
            yield pd.Series(out)

    return rows.withColumn("_may", test(*places))


class SeenTable:
    """What each batch took up, in folders by batch number, and the filter after it. A batch that is replayed replaces its own."""

    def __init__(self, spark: SparkSession, path: str, key: str, bits: int = BLOOM_BITS):
        self.spark, self.path, self.key, self.bits = spark, path, key, bits

    def rows(self, before: int | None = None) -> DataFrame | None:
        """The rows of all batches, or of those with a smaller number; None if there are none."""
        try:
            held = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        except AnalysisException:
            return None
        return held if before is None else held.where(F.col("batch") < before)

    def _filter(self, number: int) -> DataFrame | None:
        """The filter of all batches under number: as the batch before left it, or made anew from the rows."""
        try:
            return self.spark.read.schema("word long, bits long").parquet(f"{self.path}/filter/batch={number - 1}")
        except AnalysisException:
            held = self.rows(number)
            return None if held is None else _words(held, self.key, self.bits)

    def take(self, batch: DataFrame, number: int) -> None:
        """Keep the batch's first row of each key that no earlier batch has; exact, whatever the filter says."""
        batch = batch.dropDuplicates([self.key]).persist()
        held, words = self.rows(number), self._filter(number)
        if held is None or words is None:
            fresh = batch
        else:
            told = may_hold(batch, self.key, words, self.bits)
            known = held.select(F.col(self.key).alias("_known"))
            doubtful = told.where("_may").drop("_may")
            fresh = told.where("not _may").drop("_may").unionByName(doubtful.join(known, F.col(self.key).eqNullSafe(F.col("_known")), "left_anti"))
        target = f"{self.path}/rows/batch={number}"
        fresh.write.mode("overwrite").parquet(target)
        new = _words(self.spark.read.schema(fresh.schema).parquet(target), self.key, self.bits)
        if words is not None:
            new = new.unionByName(words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        new.write.mode("overwrite").parquet(f"{self.path}/filter/batch={number}")
        batch.unpersist()


def take_unseen(stream: DataFrame, path: str, key: str, checkpoint: str, within: str = "1 day", bits: int = BLOOM_BITS) -> SeenTable:
    """Run the stream over what is there now and keep the first row of each key at path, over all runs with this checkpoint.

    Keys that came within the given time are dropped by keyed state, which
    forgets them afterwards; it counts from arrival, so no row is ever late.
    What passes is looked up in the filter, and in the table only if it may be
    there. A null is a key.
    """
    spark = stream.sparkSession
    seen = SeenTable(spark, path, key, bits)
    recent = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within).dropDuplicatesWithinWatermark([key]).drop("_arrived")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, ROCKSDB)  # a query keeps the settings that it begins with
    try:
        recent.writeStream.foreachBatch(seen.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    return seen
