"""Repeated strings against sets of all windows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listinglens.llm import queries as K
from listinglens.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, rid long, h long, spans string, body string, row string"


def plain_removed(texts, length):
    """For each text the mask of bytes that a repeated window covers."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    masks = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        masks.append(mask)
    return masks


def plain_row(doc_id, text, mask):
    kept = bytes(np.frombuffer(text, np.uint8)[~mask])
    starts = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
    return doc_id, len(text), int(mask.sum()), starts, hashlib.sha256(kept).hexdigest()


def plain(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    return sorted((plain_row(i, t, m) for (i, _), t, m in zip(rows, texts, plain_removed(texts, length), strict=True)), key=repr)


def found(spark, rows, parts=3, length=200):
    docs = spark.createDataFrame([(*r, 1, 2, "a", "b", "c") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, S.removal_digests(S.remove_repeats(docs, length=length)).collect()), key=repr)


def family(seed=3):
    """Copies, near copies, shared passages of many lengths, runs and periods."""
    rng = np.random.default_rng(seed)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(n))

    base, passage, phrase = prose(300), prose(60), prose(18)
    texts = [base] * 4 + [prose(150) for _ in range(10)] + [None, "", "short", "x" * 199, "x" * 200, "x" * 700, "ab" * 400, "é" * 300]
    for _ in range(30):
        words = base.split(" ")
        for at in rng.integers(0, len(words), rng.integers(1, 9)):
            words[at] = prose(1)
        texts.append(" ".join(words))
    texts += [prose(int(rng.integers(0, 60))) + passage + prose(int(rng.integers(0, 60))) for _ in range(20)]
    texts += [prose(20) + phrase + prose(20) for _ in range(20)]
    texts += [passage[int(rng.integers(0, 50)) :] + prose(30) + passage[: int(rng.integers(150, 300))] for _ in range(10)]
    texts += [prose(30) * 2, prose(3000) + base]
    return [(None if i % 13 == 5 else i // 2, t) for i, t in enumerate(texts)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=300), max_size=5))
@example(["a" * 300, "a" * 70, "a" * 69])
def test_every_window_has_one_anchor_and_equal_windows_the_same(texts):
    texts = [t.encode() for t in texts]
    length = 70
    offsets = np.cumsum([0] + [len(t) for t in texts])
    first, last, place, h = S._joined(S.anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, length))
    whole, owned = b"".join(texts), {}
    for a, b, p, x in zip(first.tolist(), last.tolist(), place.tolist(), h.tolist(), strict=True):
        for i in range(a, b + 1):
            assert i not in owned and i <= p <= i + length - 64
            owned[i] = p - i, x
    starts = [int(o) + i for o, t in zip(offsets, texts, strict=False) for i in range(len(t) - length + 1)]
    assert sorted(owned) == starts
    same = defaultdict(set)
    for i in starts:
        same[whole[i : i + length]].add(owned[i])
    assert all(len(x) == 1 for x in same.values())


def test_anchors_over_segments(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 10, 10, 2500, 2800, 5000])
    once = S._joined(S.anchors(data, offsets))
    monkeypatch.setattr(S, "SEGMENT", 512)
    parts = S._joined(S.anchors(data, offsets))
    assert all((a == b).all() for a, b in zip(once, parts, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", max_size=6), st.text(alphabet="ab", min_size=1, max_size=6)), min_size=1, max_size=8, unique=True), st.integers(1, 6))
def test_maximal_repeats(pairs, length):
    contexts, places = [(a + b).encode() for a, b in pairs], [len(a) for a, _ in pairs]
    mine = {(left, right, tuple(sorted(m))) for left, right, m in S.maximal_repeats(contexts, places, [1] * len(pairs), length)}

    def reach(i, j):
        left = S.common(contexts[i][: places[i]][::-1], contexts[j][: places[j]][::-1])
        return left, S.common(contexts[i][places[i] :], contexts[j][places[j] :])

    expected = set()
    for i in range(len(pairs)):
        for j in range(i):
            left, right = reach(i, j)
            if left + right >= length and right:
                members = [k for k in range(len(pairs)) if k == i or (reach(i, k)[0] >= left and reach(i, k)[1] >= right)]
                expected.add((left, right, tuple(members)))
    assert {m for m in mine if m[1]} == expected


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_parts_hold_every_window(data):
    length = 80
    left, right = data.draw(st.integers(0, 16)), data.draw(st.integers(64, 80))
    size = max(length, left + right)
    place = min(left, size - 64)
    context = bytes(range(97, 97 + size))
    for shift in (4, 2, 0):
        windows = []
        for _, _, start, at, part in S.parted(context, place, shift, length):
            assert part == context[start : start + len(part)] and start + at == place
            windows += range(start, start + len(part) - length + 1)
        assert windows[::-1] == sorted(windows, reverse=True) or sorted(windows) == list(range(size - length + 1))
        assert sorted(windows) == list(range(size - length + 1))


def test_removal(spark):
    rows = family()
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, 1) == plain(rows)


def test_other_lengths(spark):
    rows = family(9)[:60]
    assert found(spark, rows, length=90) == plain(rows, 90)


@pytest.mark.parametrize("limit", [1, 5])
def test_large_buckets_are_parted(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "LIMIT", limit)
    monkeypatch.setattr(S, "SURE", 4)
    monkeypatch.setattr(S, "HOT", 100)
    rows = family(4)
    assert found(spark, rows) == plain(rows)


def test_groups(spark):
    rows = [(i, t) for i, (_, t) in enumerate(family(6))]
    texts = [(t or "").encode() for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(set)
    for r in S.repeat_groups(docs).collect():
        groups[r["repeat"]].add((r["doc_id"], r["start"], r["end"]))
    masks = [np.zeros(len(t), bool) for t in texts]
    for members in groups.values():
        strings = {texts[i][a:b] for i, a, b in members}
        assert len(strings) == 1 and len(members) > 1
        string = strings.pop()
        assert sum(t.startswith(string, k) for t in texts for k in range(len(t) - len(string) + 1)) == len(members)
        for i, a, b in members:
            masks[i][a:b] = True
    assert all((a == b).all() for a, b in zip(masks, plain_removed(texts, 200), strict=True))


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None)]) == plain([(None, None)])


def test_query_on_the_whole_table(spark, sf):
    mine = K.op13_suffix_dedup(spark, sf)
    assert mine.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()]
    assert sorted(map(tuple, mine.collect()), key=repr) == plain(rows)
