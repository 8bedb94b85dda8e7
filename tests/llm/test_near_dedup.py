"""SimHash, the index, components and the operator against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listinglens.llm import near_dedup as N
from listinglens.llm import queries as K


def plain_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, codes, distance=4):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (codes[x] ^ codes[y]).bit_count() <= distance:
                a, b = find(ids[x]), find(ids[y])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ \n\t .,", max_size=60))
def test_simhash(text):
    assert N.simhash(text) == plain_simhash(text)


def test_simhash_of_nothing():
    assert N.simhash(None) == N.simhash("") == N.simhash(" \n") == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 300), st.integers(1, 64))
def test_index_finds_the_components(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = np.array([sum(1 << b for b in set(rng.integers(0, spread, rng.integers(0, 7)).tolist())) for _ in range(n)], dtype=np.uint64)
    codes = np.unique(centres[rng.integers(0, 4, n)] ^ flips)
    leaves, roots = N.index_links(codes)
    ids = list(range(len(leaves)))
    expected = plain_components(ids, [int(x) for x in leaves])
    assert [expected[i] for i in ids] == roots.tolist()


def test_gray_order_is_a_bijection():
    ranks = N.gray_rank(np.arange(256, dtype=np.uint64))
    assert sorted(ranks.tolist()) == list(range(256))
    order = np.argsort(ranks)
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(order, order[1:]))


def test_components_of_links(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    found = {r.node: r.root for r in N.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 150: 100, 200: 100}


def test_no_links(spark):
    assert N.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_operator_against_brute_force(spark, sf):
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in K.op7_simhash_near_dedup(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    codes = {i: plain_simhash(t) for i, t in texts.items()}
    ids = sorted(codes)
    expected = plain_components(ids, [codes[i] for i in ids])
    assert rows == {i: (f"{codes[i]:016x}", expected[i]) for i in ids}


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_large_groups_are_split(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(N, "GROUP_MOST", 20)
    monkeypatch.setattr(N, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(N, "HOT", 15)  # of 750 rows, groups of over 50 are hot
    rng = np.random.default_rng(5)
    codes = np.unique(np.array([sum(1 << int(b) for b in rng.integers(0, 40, 5)) for _ in range(150)], dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in N.connected(N.similar_links(df, len(codes))).collect()}
    mine = {int(x): roots.get(int(x), int(x)) for x in codes.view(np.int64)}
    expected = plain_components([int(x) for x in codes], [int(x) for x in codes])
    pairs = {(a, b): (mine[a] == mine[b]) == (expected[a] == expected[b]) for a in mine for b in mine}
    assert all(pairs.values())


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b c d e", "z"), (3, "a b c d e", "z"), (4, "a", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # fp clashes with the operator's own name
    out = sorted((r.doc_id, r.component_id) for r in N.near_duplicates(docs).collect())
    assert out == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 4)]
    kept = N.one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bits", [1, 12, 13, 20, 24, 32])
def test_tables_let_no_link_escape(bits):
    tables = N.block_tables(bits)
    rng = np.random.default_rng(bits)
    assert all(sum(w for _, w in parts) >= min(bits, 32) for parts in tables)
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a ^ sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        same = [all((a ^ b) >> (64 - at - w) & ((1 << w) - 1) == 0 for at, w in parts) for parts in tables]
        assert any(same)


def test_many_tables_give_the_same_links(spark):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for _ in range(200)], dtype=np.uint64)
    codes = np.unique(centres[rng.integers(0, 6, 200)] ^ flips).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in codes], "fp long")
    one, many = ({r.node: r.root for r in N.connected(N.similar_links(df, n)).collect()} for n in (len(codes), 2**31))
    assert one == many


def test_one_of_each_with_null_and_repeated_ids(spark):
    long = "one two three four five six seven eight nine ten"
    other = "red orange yellow green blue indigo violet black white grey"
    third = "north south east west up down left right in out"
    rows = [(None, long, 1), (None, other, 2), (None, other, 3), (5, other, 4), (7, third, 5), (7, "p q r s t u v w x y", 6), (8, third, 7), (None, None, 8), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = sorted((r.doc_id or 0, r.text or "") for r in N.one_of_each(docs).collect())
    # a null id stays where its component has no other; of the repeated id 7 both texts stay
    assert kept == [(0, ""), (0, long), (5, other), (7, third), (7, "p q r s t u v w x y")]


def test_hot_keys_meet_in_a_broadcast(spark, monkeypatch):
    from listinglens.llm import common as M

    monkeypatch.setattr(M, "HOT", 3)
    left = spark.createDataFrame([(i % 40 if i % 2 else 7, i) for i in range(400)] + [(None, -1)], "k long, i long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    found = M.join_hot(left, right, "k", "n", 401)
    assert "Broadcast" in found._jdf.queryExecution().executedPlan().toString() and found.columns == ["k", "i", "v"]
    assert sorted(tuple(r) for r in found.collect()) == sorted((k, i, k * 10) for k, i in left.collect() if k is not None)
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 60)], "a long, b long")
    assert {r.root for r in N.connected(edges).collect()} == {0}


def test_helper_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6)], "doc_id long, text string, row int")
    for name in ("doc", "order", "fp", "component_id", "_row", "copies"):
        docs = docs.withColumn(name, F.lit(9))
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 5, *[9] * 6)]


def test_one_of_each_of_nothing(spark):
    assert N.one_of_each(spark.createDataFrame([], "doc_id long, text string, x int")).columns == ["doc_id", "text", "x"]
    assert N.one_of_each(spark.createDataFrame([], "doc_id long, text string, x int")).count() == 0
