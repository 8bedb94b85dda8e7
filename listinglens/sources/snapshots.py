"""Tables of immutable snapshots behind one pointer, and upserts into them.

A table is a folder:

    data/<version>-<id>/...   files that a version wrote, never changed again
    versions/<name>.json      a manifest: schema, partition column, and the folder of each partition
    current                   the name of the manifest that counts

A writer adds data, then a manifest, and last swaps the pointer by one rename,
so a run that ends at any step leaves the table as it was or as it should be.
What such a run left behind is never read, and `vacuum` removes it. Readers
follow the pointer; the folders of the versions before stay for those that
began earlier. Each table has one writer at a time: a second one that swapped
the pointer meanwhile is noticed and the later writer fails.

Partition values stand in the files with their own type; folders are named by
a hash of the value, so "01" and "1" differ, and null is a partition too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglens.operators.relate import dedup_last
from listinglens.session import require_columns

#: The column that names a partition's folder.
SLOT = "listinglens_slot"
#: The folder of a table without partitions.
WHOLE = "all"


class Files:
    """The few calls that a table needs of the file system that Spark uses for its path."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root, spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.path().getFileSystem(self.conf)

    def path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def read(self, *names: str) -> str | None:
        path = self.path(*names)
        if not self.system.exists(path):
            return None
        stream = self.system.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str, *names: str) -> None:
        """A new file; one that is there already is an error."""
        stream = self.system.create(self.path(*names), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def swap(self, text: str, name: str) -> None:
        """Replace a file as a whole: readers see the old text or the new one."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        self.write(text, fresh)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.makeQualified(self.path()).toUri(), self.conf).rename(
            self.system.makeQualified(self.path(fresh)), self.system.makeQualified(self.path(name)), options
        )

    def names(self, *names: str) -> list[str]:
        path = self.path(*names)
        return sorted(s.getPath().getName() for s in self.system.listStatus(path)) if self.system.exists(path) else []

    def delete(self, *names: str) -> None:
        self.system.delete(self.path(*names), True)


class Manifest:
    """What a version consists of."""

    def __init__(self, schema: T.StructType, partition: str | None, folders: dict[str, str], number: int = 0, before: str | None = None, name: str | None = None):
        self.schema, self.partition, self.folders, self.number, self.before, self.name = schema, partition, folders, number, before, name

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "partition": self.partition, "folders": self.folders, "number": self.number, "before": self.before})

    @staticmethod
    def load(files: Files, name: str | None = None) -> Manifest | None:
        """The manifest of that name, or the current one; None where there is no table."""
        name = name or files.read("current")
        if name is None:
            return None
        text = files.read("versions", name)
        if text is None:
            raise ValueError(f"{files.root} has no version {name}")
        held = json.loads(text)
        return Manifest(T.StructType.fromJson(held["schema"]), held["partition"], held["folders"], held["number"], held["before"], name)


def _slot(partition: str | None) -> Column:
    return F.lit(WHOLE) if partition is None else F.md5(F.coalesce(F.concat(F.lit("="), F.col(f"`{partition}`").cast("string")), F.lit("")))


def _rows(spark: SparkSession, files: Files, manifest: Manifest, slots: Iterable[str] | None = None) -> DataFrame:
    folders = [str(files.path(f)) for s, f in manifest.folders.items() if slots is None or s in set(slots)]
    return spark.read.schema(manifest.schema).parquet(*folders) if folders else spark.createDataFrame([], manifest.schema)


def read_snapshot(spark: SparkSession, path: str, version: str | None = None, values: Sequence | None = None) -> DataFrame:
    """The table's rows in the current version, or in the named one; with values, only those partitions are read."""
    files = Files(spark, path)
    manifest = Manifest.load(files, version)
    if manifest is None:
        raise ValueError(f"no table at {path}")
    if values is None:
        return _rows(spark, files, manifest)
    kind = manifest.schema[manifest.partition].dataType
    asked = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(manifest.partition, kind)]))
    return _rows(spark, files, manifest, {r[0] for r in asked.select(_slot(manifest.partition)).collect()})


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that can be read, newest first."""
    files = Files(spark, path)
    there, out, name = set(files.names("versions")), [], files.read("current")
    while name and name in there:
        out.append(name)
        name = Manifest.load(files, name).before
    return out


def commit(spark: SparkSession, path: str, rows: DataFrame, partition: str | None, base: Manifest | None, slots: Iterable[str]) -> str:
    """A version in which rows take the place of the partitions `slots` of the base; its name."""
    files = Files(spark, path)
    number, mark = (base.number + 1 if base else 0), uuid.uuid4().hex
    folder = f"data/{number:08d}-{mark}"
    rows.withColumn(SLOT, _slot(partition)).write.partitionBy(SLOT).parquet(str(files.path(folder)))
    new = {n.split("=", 1)[1]: f"{folder}/{n}" for n in files.names(folder) if n.startswith(f"{SLOT}=")}
    kept = {s: f for s, f in base.folders.items() if s not in set(slots)} if base else {}
    name = f"{number:08d}-{mark}.json"
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    files.write(Manifest(schema, partition, kept | new, number, base.name if base else None).text(), "versions", name)
    if files.read("current") != (base.name if base else None):
        raise RuntimeError(f"another writer changed {path}")
    files.swap(name, "current")
    return name


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove what none of the newest `keep` versions holds. Only while nobody writes."""
    files = Files(spark, path)
    stay = versions(spark, path)[:keep]
    used = {f.split("/")[1] for name in stay for f in Manifest.load(files, name).folders.values()}
    for name in set(files.names("versions")) - set(stay):
        files.delete("versions", name)
    for name in set(files.names("data")) - used:
        files.delete("data", name)
    for name in files.names():
        if name.startswith(("current.", ".current.")):
            files.delete(name)


def upserted(old: DataFrame | None, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Old and new rows, the last of each key in the given order; columns that one side lacks are null there."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return dedup_last(rows, key, order)


def upsert(df: DataFrame, path: str, key: str, order: Sequence[str], partition: str | None = None, moving: bool = False, keep: int = 2) -> str:
    """Upsert df into the table at path, which is made if there is none; the new version's name.

    With a partition column only the partitions that df touches are read and
    written. The key has to fix the partition, unless `moving` says that a key
    may change it: then the partitions that hold a key of df are looked up by a
    scan of the key column. A batch may be repeated: the rows stay the same.
    """
    spark = df.sparkSession
    require_columns(df, [key, *order, *([partition] if partition else [])])
    files = Files(spark, path)
    base = Manifest.load(files)
    if base is None:
        name = commit(spark, path, upserted(None, df, key, order), partition, None, ())
    else:
        if base.partition != partition:
            raise ValueError(f"{path} is partitioned by {base.partition}, not by {partition}")
        slots = {r[0] for r in df.select(_slot(partition)).distinct().collect()}  # one for each partition of the batch
        if moving and partition:
            held = _rows(spark, files, base).select(key, _slot(partition).alias(SLOT)).join(df.select(key), key, "left_semi")
            slots |= {r[0] for r in held.select(SLOT).distinct().collect()}
        name = commit(spark, path, upserted(_rows(spark, files, base, slots), df, key, order), partition, base, slots)
    vacuum(spark, path, keep)
    return name
