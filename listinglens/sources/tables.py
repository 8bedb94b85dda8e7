"""Reading and writing tables: scans, upserts, event logs, state lines, JSON, exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglens.session import require_columns


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A Parquet table; columns are pruned in the scan, and a limit follows a stated order."""
    reader = spark.read.schema(schema) if schema else spark.read
    table = reader.parquet(path)
    if columns:
        table = require_columns(table, columns).select(*columns)
    if limit is not None:
        table = table.orderBy(*(order or table.columns)).limit(limit)
    return table


def list_files(spark: SparkSession, root: str, suffix: str = ".parquet") -> list[str]:
    """Paths under root that end in suffix, tables as folders included, from the file system that Spark uses."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, open_ = [], [path]
    while open_:
        for status in system.listStatus(open_.pop()):
            name = str(status.getPath())
            if name.endswith(suffix):
                found.append(name)
            elif status.isDirectory():
                open_.append(status.getPath())
    return sorted(found)


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Rows (name, n_rows, n_cols, error): every table under root; one that cannot be read has an error and no counts.

    A table's columns and its files are metadata. The rows of all tables are
    counted together, in one job that reads nothing but the files' footers.
    """
    counts, facts = [], []
    for path in list_files(spark, root):
        name = path.rsplit("/", 1)[-1]
        try:
            table = spark.read.parquet(path)
        except PySparkException as e:
            facts.append((name, None, str(e).splitlines()[0][:200]))
            continue
        facts.append((name, len(table.columns), None))
        counts.append(table.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows"))
    known = spark.createDataFrame(facts, "name string, n_cols int, error string")
    rows = reduce(DataFrame.unionAll, counts) if counts else spark.createDataFrame([], "name string, n_rows long")
    return known.join(rows, "name", "left").select("name", "n_rows", "n_cols", "error")


def append_events(df: DataFrame, path: str) -> None:
    """Append to an event log; columns may grow from one append to the next."""
    df.write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def read_payloads(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON records under a schema; what does not parse is kept in _corrupt_record."""
    whole = f"{schema}, _corrupt_record string"
    return spark.read.schema(whole).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def write_json_metadata(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def export_tables(spark: SparkSession, root: str, names: Sequence[str], out: str, kind: str = "csv") -> list[str]:
    """Write each known table to out; missing ones are left out. Returns the names written."""
    there = {p.rsplit("/", 1)[-1].removesuffix(".parquet"): p for p in list_files(spark, root)}
    for name in (done := [n for n in names if n in there]):
        spark.read.parquet(there[name]).write.mode("overwrite").format(kind).option("header", True).save(f"{out}/{name}")
    return done


def write_vectors(df: DataFrame, column: str, path: str) -> None:
    df.withColumn(column, F.transform(column, lambda x: x.cast("float"))).write.mode("overwrite").parquet(path)


def materialize_train_ready(listings: DataFrame, validation: DataFrame, images: DataFrame, key: str, flag: str, paths: Column) -> DataFrame:
    """Listings that the validation table flags as ready, with the sorted paths of their valid images."""
    ready = listings.join(validation.where(flag).select(key), key, "left_semi")
    shown = images.where("is_valid").groupBy(key).agg(F.array_sort(F.collect_list(paths)).alias("valid_image_paths"))
    return ready.join(shown, key, "left").withColumn("valid_image_count", F.coalesce(F.size("valid_image_paths"), F.lit(0)))
