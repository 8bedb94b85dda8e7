"""Packing: exact round trips."""

import functools
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from listinglens.llm import packing as P
from listinglens.llm import queries as K


VOCABULARY = "byte_bpe_50k.json"


@functools.cache
def reference_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def tokenizer():
    return reference_tokenizer()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 200_000))
def test_lengths_are_powers_of_two(n):
    lengths = P.piece_lengths(n)
    assert sum(lengths) == n
    assert all(x & (x - 1) == 0 and 0 < x <= P.MAX_TOKENS for x in lengths)
    assert sorted(lengths, reverse=True) == lengths


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n"])), max_size=8).map("".join))
def test_both_vocabularies_give_the_same_ids(text):
    assert P.encode(text, VOCABULARY) == reference_tokenizer().encode(text, add_special_tokens=False).ids


def test_round_trip(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = {}
    for r in P.pack(docs).collect():
        parts.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4"), r.length, r.doc_tokens))
    for row in docs.collect():
        want = [*tokenizer.encode(row.text, add_special_tokens=False).ids, 1]
        mine = sorted(parts[row.doc_id], key=lambda p: p[0])
        assert [p[0] for p in mine] == [sum(p[2] for p in mine[:i]) for i in range(len(mine))]
        assert np.concatenate([p[1] for p in mine]).tolist() == want
        assert all(len(p[1]) == p[2] and p[3] == len(want) for p in mine)


def test_query_digests(spark, sf, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = K.op4_packing(spark, sf).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.offset == 0


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "<|endoftext|>", 5), (3, "<|endoftext|>", 5), (4, "word " * 60_000, 5)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string, start int")).collect()
    assert [(r.length, r.doc_tokens) for r in out if r.doc_id in (1, 2)] == [(1, 1), (1, 1)]
    assert sum(r.length for r in out if r.doc_id == 4) == [r.doc_tokens for r in out if r.doc_id == 4][0]
    assert len({r.sequence_id for r in out}) == len(out)
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    ids = P.pack(spark.createDataFrame([(None, "a"), (2**53 + 1, "b")], "doc_id long, text string").coalesce(1)).collect()
    assert [r.doc_id for r in ids] == [None, 2**53 + 1]
    special = [r for r in out if r.doc_id == 3]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in special] == [[50256, 1]] * 2


def test_batches_hold_one_length(spark, sf):
    rows = P.pack(spark.read.parquet(f"{sf}/documents.parquet").repartition(3)).select("length", "batch_id").collect()
    held = {}
    for r in rows:
        held.setdefault(r.batch_id, []).append(r.length)
    assert all(len(set(x)) == 1 and sum(x) <= P.BATCH_TOKENS for x in held.values())
    assert len(held) <= 3 * 12 + sum(sum(x) for x in held.values()) // P.BATCH_TOKENS


def test_long_documents_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "FLUSH", 100)
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b c " * 500, None, "d e " * 90])], ["doc_id", "text"])
    monkeypatch.setattr(P.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    parts = list(P._pieces(VOCABULARY, 64)(iter([docs])))
    assert [sorted(set(p.column(0).to_pylist())) for p in parts] == [[1], [2, 3]]
    assert sum(sum(p.column(2).to_pylist()) for p in parts) == sum(len(P.encode(t, VOCABULARY)) + 1 for t in ("a b c " * 500, "", "d e " * 90))


@pytest.mark.parametrize("text", [" " * 1_000_001, "a <|endoftext|>" + "\n" * 1_000_001 + "b", "x " * 60_000 + "\u3000" * 1_100_000 + " y"])
def test_very_long_blanks(tokenizer, text):
    assert P.encode(text, VOCABULARY) == tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_blanks_are_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_001), (2, "a b")], "doc_id long, text string")
    out = P.pack(docs).select("doc_id", "length", "doc_tokens").collect()
    assert {r.doc_id: r.doc_tokens for r in out} == {1: 1_000_002, 2: 3}
    assert sum(r.length for r in out) == 1_000_005
