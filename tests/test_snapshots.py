"""Upserts into snapshot tables: what stays when a run ends at any step, typed partitions, versions."""

import pytest
from pyspark.sql import functions as F

from listinglens.sources import snapshots as N

SCHEMA = "k long, v string, n int, part string"


def rows(spark, *given, schema=SCHEMA):
    return spark.createDataFrame(list(given), schema)


def found(spark, path, **how):
    return sorted((tuple(r) for r in N.read_snapshot(spark, path, **how).collect()), key=repr)


def test_upsert_twice_is_upsert_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in ([(1, "a", 0, "x"), (2, "b", 0, "x")], [(2, "c", 1, "x"), (3, "d", 1, "x")], [(2, "c", 1, "x"), (3, "d", 1, "x")]):
        N.upsert(rows(spark, *batch), path, "k", ["n"])
    assert found(spark, path) == [(1, "a", 0, "x"), (2, "c", 1, "x"), (3, "d", 1, "x")]


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    N.upsert(rows(spark, (1, "x", 0, "1"), (2, "y", 0, "2")), path, "k", ["n"], "part")
    files = lambda: {r.k: r.f for r in N.read_snapshot(spark, path).select("k", F.input_file_name().alias("f")).collect()}
    before = files()
    N.upsert(rows(spark, (1, "z", 1, "1")), path, "k", ["n"], "part")
    after = files()
    assert before[2] == after[2] and before[1] != after[1]
    assert found(spark, path, values=["1"]) == [(1, "z", 1, "1")]


def test_partition_values_keep_their_type(spark, tmp_path):
    path = str(tmp_path / "t")
    N.upsert(rows(spark, (1, "a", 0, "01"), (2, "a", 0, "1"), (3, "a", 0, None), (4, "a", 0, "")), path, "k", ["n"], "part")
    N.upsert(rows(spark, (1, "b", 1, "01"), (3, "b", 1, None), (5, "b", 1, "a/b=c d")), path, "k", ["n"], "part")
    assert found(spark, path) == [(1, "b", 1, "01"), (2, "a", 0, "1"), (3, "b", 1, None), (4, "a", 0, ""), (5, "b", 1, "a/b=c d")]
    assert found(spark, path, values=["01", None]) == [(1, "b", 1, "01"), (3, "b", 1, None)]


def test_keys_may_move_between_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    N.upsert(rows(spark, (1, "a", 0, "x"), (2, "a", 0, "x"), (3, "a", 0, "y")), path, "k", ["n"], "part")
    N.upsert(rows(spark, (1, "b", 1, "y"), (4, "b", 1, "z")), path, "k", ["n"], "part", moving=True)
    assert found(spark, path) == [(1, "b", 1, "y"), (2, "a", 0, "x"), (3, "a", 0, "y"), (4, "b", 1, "z")]


class Ended(Exception):
    pass


@pytest.mark.parametrize("partition", [None, "part"])
@pytest.mark.parametrize("step", ["data", "manifest", "pointer file", "swap", "vacuum"])
def test_a_run_that_ends_at_any_step(spark, tmp_path, monkeypatch, partition, step):
    path = str(tmp_path / "t")
    first = [(i, "a", 0, f"{i % 2:02d}") for i in range(100)]
    N.upsert(rows(spark, *first), path, "k", ["n"], partition)
    batch = rows(spark, (7, "b", 1, "01"), (200, "b", 1, "01"))
    wanted = sorted([r for r in first if r[0] != 7] + [(7, "b", 1, "01"), (200, "b", 1, "01")], key=repr)

    def ends(*args, **kwargs):
        raise Ended

    with monkeypatch.context() as m:
        if step == "data":  # written in part, nothing refers to it
            m.setattr(N.Files, "names", ends)
        elif step == "manifest":
            m.setattr(N.Files, "write", ends)
        elif step == "pointer file":
            write = N.Files.write
            m.setattr(N.Files, "write", lambda self, text, *names: ends() if names[0].startswith("current") else write(self, text, *names))
        elif step == "swap":
            m.setattr(N.Files, "swap", ends)
        else:
            m.setattr(N, "vacuum", ends)
        with pytest.raises(Ended):
            N.upsert(batch, path, "k", ["n"], partition)
    assert found(spark, path) == (wanted if step == "vacuum" else sorted(first, key=repr))
    N.upsert(batch, path, "k", ["n"], partition)
    assert found(spark, path) == wanted
    N.vacuum(spark, path, 1)
    assert found(spark, path) == wanted
    assert len(list((tmp_path / "t" / "data").iterdir())) == (2 if partition and step != "vacuum" else len({f.split("/")[1] for f in N.Manifest.load(N.Files(spark, path)).folders.values()}))
    assert {p.name for p in (tmp_path / "t").iterdir() if not p.name.endswith(".crc")} == {"data", "versions", "current"}


def test_versions_can_be_read_until_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    names = [N.upsert(rows(spark, (1, str(i), i, "x")), path, "k", ["n"], keep=10) for i in range(3)]
    assert N.versions(spark, path) == names[::-1]
    assert found(spark, path, version=names[0]) == [(1, "0", 0, "x")]
    N.vacuum(spark, path, 1)
    assert N.versions(spark, path) == names[2:]
    with pytest.raises(ValueError, match="no version"):
        N.read_snapshot(spark, path, names[0])


def test_a_second_writer_is_noticed(spark, tmp_path):
    path = str(tmp_path / "t")
    N.upsert(rows(spark, (1, "a", 0, "x")), path, "k", ["n"])
    base = N.Manifest.load(N.Files(spark, path))
    N.upsert(rows(spark, (2, "a", 0, "x")), path, "k", ["n"])
    with pytest.raises(RuntimeError, match="another writer"):
        N.commit(spark, path, rows(spark, (3, "a", 0, "x")), None, base, {N.WHOLE})
    assert [r[0] for r in found(spark, path)] == [1, 2]


def test_columns_grow_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    N.upsert(rows(spark), path, "k", ["n"], "part")
    assert found(spark, path) == []
    N.upsert(rows(spark, (1, "a", 0, "x"), (2, "a", 0, "y")), path, "k", ["n"], "part")
    N.upsert(rows(spark, (1, 1, "x", 2.5), schema="k long, n int, part string, w double"), path, "k", ["n"], "part")
    N.upsert(rows(spark), path, "k", ["n"], "part")
    held = {r.k: (r.v, r.w) for r in N.read_snapshot(spark, path).collect()}
    assert held == {1: (None, 2.5), 2: ("a", None)}
    with pytest.raises(ValueError, match="partitioned by"):
        N.upsert(rows(spark), path, "k", ["n"])
    with pytest.raises(ValueError, match="no table"):
        N.read_snapshot(spark, str(tmp_path / "none"))
