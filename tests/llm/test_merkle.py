"""The manifest, its versions and its SQL twin against a plain tree."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from listinglens.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, at long, block long, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    cells = [row[0], row[1], row[2], row[3], text]
    return sha("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def plain_tree(nodes):
    """Levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_climb(levels, at, node, proof):
    for level in levels[:-1]:
        first = at - at % 3
        left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 3])
        node, proof, at = sha(left + node + right), proof + left + right, at // 3
    return node, proof


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row, plain_leaf(row, row[4])))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = plain_tree([leaf for _, leaf in by_source[s]])
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for at, (row, leaf) in enumerate(by_source[s]):
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node, proof = plain_climb(trees[s], at, plain_leaf(row, text), "")
            node, proof = plain_climb(top, i, node, proof)
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = [None, "", "one\ntwo", "plain", "é\n\n" * 5][i % 5]
            rows.append((i if i % 17 else None, source, None if i % 3 else "de", i % 4 or None, text))
            i += 1
    rows += [(5, "b", "x", 1, "same\n")] * 4 + [(6, "b", "x", 1, "one"), (6, "b", "x", 1, "two")]
    rows.append((7, "long", "x", 1, "line\n" * 200_000))
    return rows


def found(docs):
    rows = M.verified(M.manifest(docs, M.tampered_text(F.col("doc_id"), F.col("text"))))
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    rows = rows_of({"a": 1, "b": 40, None: 3, "": 2, "É": 28, "z": 9})
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], SCHEMA).repartition(5)
    assert found(docs) == plain(rows)


def test_a_source_over_one_block(spark):
    rows = rows_of({"a": 1500})
    assert found(spark.createDataFrame(rows, SCHEMA.split(", tree")[0])) == plain(rows)


def test_single_row_and_no_rows(spark):
    schema = SCHEMA.split(", tree")[0]
    row = (4, None, None, None, None)
    assert found(spark.createDataFrame([row], schema)) == plain([row])
    assert found(spark.createDataFrame([], schema)) == []


def test_versions_share_all_but_their_path(spark):
    rows = [r for r in rows_of({"a": 30}) if r[1] == "a"]
    docs = spark.createDataFrame(rows, SCHEMA.split(", tree")[0])
    same = M.manifest(docs).collect()
    levels = plain_tree([leaf for _, leaf in sorted((((r[0] is not None, r[0] or 0), plain_leaf(r, r[4])) for r in rows), key=lambda x: x)])
    base = {node for level in levels for node in level}
    assert all(set(r["version"]) <= base and r["version"][-1] == r["root"] for r in same)
    forged = M.manifest(docs, F.lit("other")).collect()
    assert all(len(r["version"]) == len(levels) and not set(r["version"]) & base for r in forged)


def test_sql_twin(spark, sf):
    from listinglens.llm import queries as K

    path = f"{sf}/documents.parquet"
    with duckdb.connect() as sql:
        sql.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        theirs = sql.sql(M.oracle()).fetchall()
    mine = K.op11_merkle_manifest(spark, sf).collect()
    assert sorted(map(tuple, mine), key=repr) == sorted(theirs, key=repr)
    assert {r["verified"] for r in mine} == {True, False}
