"""Session and schema helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that the operators rely on: UTC times, adaptive plans, the last of repeated map keys.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(name: str = "listinglens", **settings: str) -> SparkSession:
    """A session with SETTINGS; further settings override them."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df, or a ValueError that lists the missing columns in order; no job runs."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """df with NaN as null in every floating-point column."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def rounded(value: Column, digits: int = 4) -> Column:
    """value as a double with so many digits."""
    return F.round(value.cast("double"), digits)


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


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends at files that every executor can reach."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables that one computation needs until its result is staged."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, name))
        return stage_table(df, name, self.paths[-1])

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df staged for good; the tables it came from are removed."""
        done = stage_table(df, name)
        self.clear()
        return done

    def clear(self) -> None:
        for path in self.paths:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self.paths = []
