"""Quality rules, language identification, grades and toxicity."""

import base64
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listinglens.llm import common as C
from listinglens.llm import grading as G
from listinglens.llm import hashed as H
from listinglens.llm import language_id as L
from listinglens.llm import quality_rules as Q
from listinglens.llm import queries as K
from listinglens.llm import toxicity as X


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "😀", "|", "\n", " ", " ", "\t"]), max_size=80).map(" ".join))
def test_base_counts(text):
    assert Q.base_counts(text.encode(), len(text)) == plain_counts(text)


def test_long_repeats_count_exactly():
    words = [str(i % 5000) for i in range(12_000)]
    assert Q.repeated_words([w.encode() for w in words]) == plain_counts(" ".join(words))[4]


def test_quality_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in K.op5_quality_rules(spark, sf).collect():
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_bands_reject_noise_and_repeats(spark):
    rng = np.random.default_rng(1)
    noise = " ".join(base64.b64encode(rng.bytes(30)).decode() for _ in range(200))
    lines = "\n".join(f"row {i} of the same long and dull table of numbers and names" for i in range(400))
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(400))
    docs = spark.createDataFrame([(1, noise), (2, lines), (3, prose), (4, None), (5, "")], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in Q.rate(docs).collect()}
    assert kept == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert Q.rate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_rest_of_a_text_is_a_chunk(spark):
    rng = np.random.default_rng(4)
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(1200)).encode()
    noise = " ".join(base64.b64encode(rng.bytes(30)).decode() for _ in range(120)).encode()
    rows = [(1, prose[:4096] + noise[:3072]), (2, prose[:4096] + prose[:50]), (3, prose[:4096] + noise[:200]), (4, prose[:5000])]
    rows += [(5, base64.b64encode(rng.bytes(170)).replace(b"/", b" ")[:200]), (6, prose[:200])]
    out = {r.doc_id: r for r in Q.rate(spark.createDataFrame([(i, x.decode()) for i, x in rows], "doc_id long, text string")).collect()}
    assert out[1].bad_chunks == 3072 / 7168 and not out[1].kept and not out[1].base_failed
    assert [out[i].bad_chunks for i in (2, 4, 6)] == [0, 0, 0]
    assert out[3].bad_chunks == 200 / 4296  # a small bad rest weighs by its bytes
    assert out[5].bad_chunks == 1 and out[6].kept


@pytest.mark.parametrize("size", [1, 127, 4096, 4097, 4223, 4224, 8191, 20_000])
def test_chunks_cover_the_text(size):
    starts = Q.chunk_starts(size)
    ends = [*starts[1:], size]
    assert starts[0] == 0 and all(a < b for a, b in zip(starts, ends))
    assert all(b - a == Q.CHUNK for a, b in zip(starts[:-1], ends)) and ends[-1] - starts[-1] < Q.CHUNK + Q.FEWEST_BYTES


def test_language_of_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in K.op6_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_backs_off(spark):
    rows = [(i, "the water is here and there", "en") for i in range(20)] + [(100 + i, "das wasser ist hier und dort", "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.predict("the there")[0] == "en"
    assert model.predict("wassern")[0] == "de"  # unseen, by its n-grams
    assert model.predict("12 !?") == model.predict(None) == model.predict("² ½ ① Ⅷ 5_") == (L.UNKNOWN, 0.0)
    out = L.identify(spark.createDataFrame([(1, None), (2, "dort"), (2, "dort")], "doc_id long, text string"), model)
    assert sorted((r.doc_id, r.lang_pred) for r in out.collect()) == [(1, "und"), (2, "de"), (2, "de")]


def test_language_reads_long_runs_to_their_end(spark):
    head, a, b = "xyzw" * 25, "水木火土" * 700, "ありがと" * 700
    rows = [(i, head + a, "zh") for i in range(20)] + [(100 + i, head + b, "ja") for i in range(20)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"木火土水", "がとあり", "火土$", "w水木火"} <= set(model.grams)  # beyond 64 letters, the end, and across the change
    assert model.predict(head + a[:40])[0] == "zh" and model.predict(head + b[:40])[0] == "ja"


def test_counts_of_ngrams_do_not_depend_on_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abcdefghij klmnopqrst ab c" + "uvwx" * i, "en") for i in range(12)], "doc_id long, text string, lang string")
    whole = L.fit(docs)
    monkeypatch.setattr(L, "PIECE", 3)
    cut = L.fit(docs)
    assert cut.grams == whole.grams and np.array_equal(cut.rates, whole.rates)


def test_shapes_of_whole_words():
    assert H.shape_slot(b"-" * 64 + b"a") != H.shape_slot(b"-" * 64 + b"9")


def test_language_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        lang, alphabet = [("x", "abcd"), ("y", "cdef")][i % 2]
        rows.append((i, " ".join("".join(rng.choice(list(alphabet), rng.integers(1, 5))) for _ in range(30)) + "² é", lang))
    monkeypatch.setattr(L, "LEAST_SHARE", 0.004)
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    words = {g: Counter(w for _, t, lang in learn if lang == g for w in re.findall(r"[a-zé]+", t)) for g in "xy"}
    grams = {(g, n): Counter() for g in "xy" for n in range(1, 5)}
    for g in "xy":
        for w, k in words[g].items():
            for n in range(1, 5):
                marked = f"^{w}$"
                for i in range(len(marked) - n + 1):
                    grams[g, n][marked[i : i + n]] += k
    def rates(counts):  # the floor, then smoothed logarithms over the terms that any language knows
        kept = {g: {w: k for w, k in c.items() if k >= 0.004 * c.total()} for g, c in counts.items()}
        every = {w for c in kept.values() for w in c}
        return {w: [math.log((kept[g].get(w, 0) + 0.5) / (sum(kept[g].values()) + 0.5 * len(every))) for g in "xy"] for w in every}, [sum(kept[g].values()) + 1 for g in "xy"]
    known, prior = rates(words)
    parts = {n: rates({g: grams[g, n] for g in "xy"})[0] for n in range(1, 5)}
    assert set(model.words) == set(known) and set(model.grams) == {t for p in parts.values() for t in p}
    for text in ["ab cd", "aaaa ffff", "dddd cdcd eabf", "é", "cccdcd", "a"]:
        total = np.log(np.array(prior) / sum(prior))
        for w in re.findall(r"[a-zé]+", text):
            if w in known:
                total = total + known[w]
                continue
            for n in range(min(4, len(w) + 2), 0, -1):
                hits = [parts[n][g] for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in parts[n]]
                if hits:
                    total = total + np.mean(hits, axis=0)
                    break
        odds = np.exp(total - total.max())
        lang, score = model.predict(text)
        assert lang == "xy"[int(odds.argmax())] and score == pytest.approx(odds.max() / odds.sum(), rel=1e-4)


def test_rows_without_ids(spark):
    """Null ids stay null and large ones whole, in one batch; columns of the results' names do no harm."""
    docs = spark.createDataFrame([(None, "the water is here", 1), (2**53 + 1, None, 2), (2**53 + 1, "the water is here", 3)], "doc_id long, text string, score int").coalesce(1)
    docs = docs.withColumn("kept", F.lit("x")).withColumn("held_out", F.lit("x"))
    want = [(None, False), (2**53 + 1, zlib.crc32(str(2**53 + 1).encode()) % 5 == 0)]
    model = L.fit(spark.createDataFrame([(1, "the water", "en")], "doc_id long, text string, lang string"))
    grader = G.fit_rows(["a b", "c d"] * 5, np.array([0, 1] * 5))
    for out in (L.identify(docs, model), G.grade(docs, grader)):
        assert [(r.doc_id, r.held_out) for r in out.collect()] == [want[0], want[1], want[1]]
    detector = X.fit_rows(["a b"] * 5, np.zeros(5, int))
    assert [r.doc_id for r in X.score(docs, detector).collect()] == [r.doc_id for r in Q.rate(docs).collect()] == [None, 2**53 + 1, 2**53 + 1]
    assert X.without_toxic(docs, detector).count() == 3
    empty = docs.limit(0)
    assert [x.count() for x in (L.identify(empty, model), G.grade(empty, grader), X.score(empty, detector), Q.rate(empty))] == [0] * 4
    G.fit(empty, G.graded(spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    X.fit(empty, spark.createDataFrame([(None, 1)], "doc_id long, toxic int"))


def test_ratios_by_zstandard(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh \n"), n)) for n in (1, 100, 300, 2000, 4100, 9000, 30_000)]
    out = {r.doc_id: r for r in Q.rate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    squeeze = zstandard.ZstdCompressor(level=3)
    limits = lambda n: [(a, b) for start, a, b in Q.BANDS if n >= start][-1]
    for i, text in enumerate(texts):
        raw = text.encode()
        ratio = len(squeeze.compress(raw)) / len(raw)
        cuts = [raw[a : a + 4096] for a in range(0, len(raw), 4096)]
        if len(cuts) > 1 and len(cuts[-1]) < 128:
            cuts[-2:] = [cuts[-2] + cuts[-1]]
        bad = 0
        for c in cuts:
            low, high = Q.CHUNK_BAND if len(c) >= 4096 else limits(len(c))
            bad += len(c) * (not low <= len(squeeze.compress(c)) / len(c) <= high)
        low, high = limits(len(raw))
        assert out[i].ratio == ratio and out[i].bad_chunks == bad / len(raw)
        assert out[i].kept == (not out[i].base_failed and low <= ratio <= high and bad / len(raw) <= 0.25)


def test_language_without_training_rows(spark):
    model = L.fit(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"))
    assert model.predict("word") == (L.UNKNOWN, 0.0)


def test_minimiser_finds_the_minimum():
    a = np.diag(np.arange(1.0, 11.0))
    b = np.arange(10.0)
    x = H.minimise(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b), np.zeros(10))
    assert x == pytest.approx(b / np.arange(1.0, 11.0), abs=1e-3)


def test_grades_are_ordered():
    texts = ["bad"] * 30 + ["fair"] * 30 + ["good"] * 30
    grader = G.fit_rows(texts, np.repeat([0, 1, 2], 30))
    assert grader.thresholds[0] < grader.thresholds[1]
    expected = [grader.tails(t).sum() for t in ("bad", "fair", "good")]
    assert expected == sorted(expected)
    assert (np.diff(grader.tails("fair")) <= 0).all()


def test_grade_query(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in K.op8_quality_grades(spark, sf).collect() if r.held_out and r.doc_id in quality]
    good, bad = ([r.expected_grade for r in rows if quality[r.doc_id] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.85


def plain_grade(grader, text):
    """(expected grade, tail probability, kept) of a text, by loops."""
    counts = Counter()
    for w in (text or "").encode().split():
        counts[zlib.crc32(w.lower().strip(b".,;:!?\"'()[]#*$%&|<>")) % H.SIZE] += 1
        shape = re.sub(rb"[0-9]+", b"9", re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[A-Z]+", b"A", w)))
        counts[zlib.crc32(b"\0" + shape) % H.SIZE] += 1
    length = math.sqrt(sum(counts.values()))
    score = sum(grader.weights[s] * 2 * math.sqrt(n) / length for s, n in counts.items())
    tails = [1 / (1 + math.exp(c - score)) for c in grader.thresholds]
    return sum(tails), tails[-1], tails[G.KEEP_GRADE - 1] >= 0.5


def test_grade_query_against_loops(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    grader = G.fit(spark.read.parquet(f"{sf}/documents.parquet"), G.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    rows = K.op8_quality_grades(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and np.any(grader.weights)
    for r in rows:
        expected, tail, kept = plain_grade(grader, texts[r.doc_id])
        assert (r.expected_grade, r.tail_probability) == pytest.approx((expected, tail), abs=1e-6)
        assert r.kept == kept and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_grades_of_odd_rows(spark):
    grader = G.fit_rows(["a b", "c d"] * 5, np.array([0, 1] * 5))
    out = G.grade(spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "a " * 50_000)], "doc_id long, text string"), grader)
    assert out.count() == 4
    assert G.grade(spark.createDataFrame([], "doc_id long, text string"), grader).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id, r.grade) for r in G.graded(labels).collect()) == [(1, 0), (3, 1)]


def test_terms_of_texts():
    terms = X.read_terms(["Ab abc", "", "ab"])
    assert terms.n_words.tolist() == [2, 0, 1]
    assert terms.hashes[0] == terms.hashes[2] != terms.hashes[1]  # the words ab, abc, ab
    assert len(terms.hashes) == 3 + 3 + 1  # words, beginnings of two letters, of three
    assert X.read_terms(["\U0001f600 a \U00010400\U00010400"]).n_words.tolist() == [2]  # an emoji is no letter


def ballot_of(votes, gold):
    return np.column_stack((votes, np.where(gold < 0, 0, 2 * gold - 1))).astype(np.int8)


def summed(votes):
    return lambda f: f(votes, np.ones(len(votes)))


def test_label_model_trusts_accurate_voters():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.2).astype(int)
    good = (y & (rng.random(3000) < 0.7)).astype(int)
    twin = good.copy()
    noise = (rng.random(3000) < 0.2).astype(int)
    clean = -((good == 0).astype(int))
    gold = np.where(rng.random(3000) < 0.5, y, -1)
    votes = ballot_of(np.column_stack((good, twin, noise, clean)), gold)
    model = X.fit_label_model(5, summed(votes))
    assert ((model.posterior(votes) > 0.5) == (y == 1)).mean() > 0.9
    assert model.share[0] < model.share[2]  # the twins share their weight


def plain_em(rows, n_voters, rounds, smooth, wrong):
    """The label model without correlations, by loops."""
    prior = rates = None
    known = [r[-1] for r in rows if r[-1]]
    for step in range(rounds):
        post = []
        for r in rows:
            if r[-1]:
                post.append(1 - wrong if r[-1] > 0 else wrong)
            elif rates is None:
                post.append(0.8 if any(v == 1 for v in r[:-2]) else 0.05)
            else:
                odds = math.log(prior / (1 - prior)) + sum(math.log(rates[1][j][v]) - math.log(rates[0][j][v]) for j, v in enumerate(r[:-1]))
                post.append(1 / (1 + math.exp(-odds)))
        prior = (sum(v > 0 for v in known) + 1) / (len(known) + 2) if step == 0 else sum(post) / len(post)
        rates = []
        for c in (0, 1):
            w = [p if c else 1 - p for p in post]
            counts = [{v: smooth + sum(x for x, r in zip(w, rows) if r[j] == v) for v in (-1, 0, 1)} for j in range(n_voters)]
            rates.append([{v: n / sum(k.values()) for v, n in k.items()} for k in counts])
    return rates, prior


def test_label_model_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(6)
    y = rng.random(300) < 0.3
    votes = np.column_stack([np.where(rng.random(300) < 0.8, y, ~y) & (rng.random(300) < 0.7) for _ in range(3)]).astype(int)
    votes = ballot_of(np.column_stack((votes, -1 * ~votes.any(axis=1))), np.where(rng.random(300) < 0.3, y, -1).astype(int))
    monkeypatch.setattr(X, "ROUNDS", 8)
    monkeypatch.setattr(X, "RESHARED", (3, 6))
    monkeypatch.setattr(X, "CORRELATED", 9.0)
    monkeypatch.setattr(X, "SETTLED", 0.0)
    model = X.fit_label_model(5, summed(votes))
    rates, prior = plain_em(votes.tolist(), 5, 8, X.SMOOTH, X.WRONG)
    assert model.prior == pytest.approx(prior)
    for c in (0, 1):
        for j in range(4):
            assert model.rates[c, j].tolist() == pytest.approx([rates[c][j][v] for v in (-1, 0, 1)])
    rest = np.zeros((5, 5))  # the moments, by loops
    for v, p in zip(votes, model.posterior(votes)):
        d = [(v[j] != 0) - (1 - p) * (1 - model.rates[0, j, 1]) - p * (1 - model.rates[1, j, 1]) for j in range(5)]
        rest += np.outer(d, d)
    assert np.allclose(X.vote_moments(model, model.rates, votes, np.ones(300)), rest)


def test_label_model_in_tasks_is_that_of_all_rows(spark):
    rng = np.random.default_rng(3)
    reader = X.Detector(X.word_hashes(X.LEXICON), np.zeros(len(X.LEXICON)), np.zeros(X.SIZE), np.zeros(len(X.LEXICON) + 3), 0.0)
    texts = [" ".join(rng.choice(["a", "b", "idiot", "dumm", "you", "moron", "sc**m"], 6)) for _ in range(400)]
    labels = rng.integers(-1, 2, 400)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    given_ = spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels) if v >= 0], "doc_id long, label int")
    votes = ballot_of(reader.read(texts)[1], labels)
    one, many = X.fit_label_model(votes.shape[1], summed(votes)), X.label_all(docs, given_, reader)
    assert np.allclose(one.rates, many.rates) and np.allclose(one.share, many.share) and one.prior == pytest.approx(many.prior)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    row, slot, value = rng.integers(0, 12, 60), rng.integers(0, 7, 60), rng.random(60)
    grades = rng.permutation(np.repeat([0, 1, 2, 3], 3))
    losses = [
        (G.ordinal_loss(G.Sparse(12, row, slot, value), grades, 7), rng.normal(size=10)),
        (X.logistic_loss(row, slot, value, 7, rng.random((12, 2)), rng.random(12)), rng.normal(size=10)),
    ]
    for loss, x in losses:
        grad = loss(x)[1]
        steps = np.eye(10) * 1e-6
        assert grad == pytest.approx([(loss(x + h)[0] - loss(x - h)[0]) / 2e-6 for h in steps], rel=1e-4, abs=1e-5)
    loss, x = losses[0]
    cuts = [x[7], x[7] + math.exp(x[8]), x[7] + math.exp(x[8]) + math.exp(x[9])]
    total = G.RIDGE / 2 * sum(w * w for w in x[:7])
    for i, g in enumerate(grades):  # the likelihood of each row
        score = sum(x[s] * v for r, s, v in zip(row, slot, value) if r == i)
        below = [0.0, *[1 / (1 + math.exp(score - c)) for c in cuts], 1.0]
        total -= math.log(below[g + 1] - below[g])
    assert loss(x)[0] == pytest.approx(total)


def test_fits_do_not_grow_with_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i} of words") for i in range(300)] + [(1, "same words here")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(G, "fit_sparse", lambda data, grades: seen.append(data.n))
    monkeypatch.setattr(G, "FIT_ROWS", 100)
    G.fit(docs, G.graded(labels))
    assert 20 < seen[0] < 180
    monkeypatch.setattr(X, "classifier", lambda sample, votes, reader, model: seen.append(len(sample.labels)))
    monkeypatch.setattr(X, "FIT_LABELLED", 100)
    X.fit(docs, labels)
    assert 20 < seen[1] < 250


def plain_terms(text):
    """The hashes of a text's terms, and its number of words, by loops."""
    factor, full = int(X.FACTOR), 2**64

    def mixed(code, kind):
        code = (code + kind) * factor % full
        return (code ^ code >> 31) * factor % full

    words, hashes = "".join(c if c.isalpha() else " " for c in text.lower()).split(" "), []
    for w in filter(None, words):
        hashes.append(mixed(sum(ord(c) * pow(factor, i % 64, full) for i, c in enumerate(w)) % full, 0))
        code = ord(w[0])
        for n in range(2, min(len(w), X.LONGEST) + 1):
            code = (code * factor + ord(w[n - 1])) % full
            hashes.append(mixed(code, n))
    return hashes, sum(map(bool, words))


def plain_score(detector, text):
    """The score of a text under a detector, by loops."""
    hashes, n = plain_terms(text or "")
    counts = Counter(hashes)
    fired = [counts[int(v)] > 0 and counts[int(v)] >= least * max(n, 1) for v, least in zip(detector.voters, detector.least)]
    votes = [*fired, bool(X.MASKED.search(text or "")), any(fired) and bool(X.AIMED.search(text or "")), -1 * (not any(fired))]
    z = detector.bias + 100 * sum(detector.weights[h >> 64 - X.BITS] for h in hashes) / max(n, 1)
    return 1 / (1 + math.exp(-z - sum(w * v for w, v in zip(detector.votes, votes))))


def test_toxicity_scores_against_loops(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    detector = X.fit(docs, labels)
    assert len(detector.voters) >= len(X.LEXICON) and np.any(detector.votes)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "du bist ein Dummkopf, s**t"), (-4, "you are an idiot " * 9), (-5, "×²_³ àÉ ß")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = X.score(docs, detector).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.score == pytest.approx(plain_score(detector, texts[r.doc_id]), abs=1e-9)


def plain_voters(texts, labels):
    """Mined (slot, least share) pairs by loops over texts, each a dict of slot and share."""
    members = {}
    for least in X.RATES:
        for slot in {s for t in texts for s in t}:
            has = [i for i, t in enumerate(texts) if slot in t and t[slot] >= np.float32(least) and labels[i] >= 0]
            good = sum(labels[i] == 1 for i in has)
            if good >= X.MINED_TEXTS and good >= X.MINED_SHARE * (len(has) + 1):
                members[slot, least] = has
    chosen, marked = [], set()
    while members:
        gain = {k: sum(labels[i] == 1 and i not in marked for i in has) - 2 * sum(labels[i] == 0 for i in has) for k, has in members.items()}
        best = max(gain, key=lambda k: (gain[k], k[1], -k[0]))
        if gain[best] < X.MINED_TEXTS:
            break
        chosen.append(best)
        marked.update(members.pop(best))
    return chosen


@pytest.mark.parametrize("seed", range(4))
def test_mined_voters_against_loops(seed):
    rng = np.random.default_rng(seed)
    labels = rng.choice([-1, 0, 1], 250, p=[0.2, 0.4, 0.4])
    texts = []
    for label in labels:
        slots = rng.choice(40, 6, replace=False) if label == 1 else rng.choice(np.arange(25, 90), 6, replace=False)
        texts.append({int(s): np.float32(rng.choice([0.005, 0.012, 0.018, 0.027, 0.05])) for s in slots})
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    slot, share = np.array([s for t in texts for s in t]), np.array([v for t in texts for v in t.values()], np.float32)
    mined = X.mine_voters(row, slot, share, labels)
    assert len(mined) > 3 and mined == plain_voters(texts, labels)
    often = Counter(s for t in texts for s in t)
    kept = [(i, s, v) for i, t in enumerate(texts) for s, v in t.items() if often[s] >= X.TERM_TEXTS]
    sample = X.common_terms(X.Sample(labels, row.astype(np.int32), slot.astype(np.int32), share.copy(), np.zeros(0, np.uint64)))
    assert 0 < len(kept) < len(row)
    assert list(zip(sample.row.tolist(), sample.slot.tolist(), sample.share)) == kept


def test_label_model_of_one_hot_id(spark):
    """Rows that share an id, or have none, count as often as they are there."""
    reader = X.Detector(X.word_hashes(X.LEXICON), np.zeros(len(X.LEXICON)), np.zeros(X.SIZE), np.zeros(len(X.LEXICON) + 3), 0.0)
    texts = ["you idiot", "a b", "a moron", "c d"] * 50
    ids = [1] * 80 + [None] * 40 + list(range(2, 82))
    labels = np.array([1 if i == 1 else -1 for i in ids])
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    votes = ballot_of(reader.read(texts)[1], labels)
    one, many = X.fit_label_model(votes.shape[1], summed(votes)), X.label_all(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int"), reader)
    assert np.allclose(one.rates, many.rates) and one.prior == pytest.approx(many.prior)


def test_entropy_in_tasks_is_that_of_all_rows(spark):
    rng = np.random.default_rng(8)
    n = len(X.LEXICON)
    reader = X.Detector(X.word_hashes(X.LEXICON), np.zeros(n), np.zeros(X.SIZE), np.zeros(n + 3), 0.0)
    texts = [" ".join(rng.choice(["a", "b", "calm", "idiot", "dumm", "you", "moron", "sc**m"], 6)) for _ in range(90)] + ["", None, "idiot"]
    model = X.fit_label_model(n + 4, summed(ballot_of(reader.read([t or "" for t in texts])[1], rng.integers(-1, 2, len(texts)))))
    used = np.unique(X._slots(X.read_terms(["a calm idiot", "dumm"]).hashes))  # some of the terms
    rows = X.soft_rows(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), reader, model, used)
    entropy = X.summed_entropy(rows, len(used), n)
    x = rng.normal(size=len(used) + n + 4)

    def plain(x):
        detector, total = X.with_weights(reader, used, x), 0.0
        for t in texts:
            p = plain_score(detector, t)
            q = float(model.posterior(ballot_of(reader.read([t or ""])[1], np.array([-1])))[0])
            total -= q * math.log(p) + (1 - q) * math.log(1 - p)
        return total

    value, grad = entropy(x)
    assert value == pytest.approx(plain(x), rel=1e-9)
    steps = np.eye(len(x))[: len(used) + 3].tolist() + np.eye(len(x))[-4:].tolist()
    slopes = [(plain(x + 1e-5 * np.array(h)) - plain(x - 1e-5 * np.array(h))) / 2e-5 for h in steps]
    assert [*grad[: len(used) + 3], *grad[-4:]] == pytest.approx(slopes, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("block", [1, 40, X.BLOCK])
def test_cells_of_many_texts_are_one_row(spark, monkeypatch, block):
    """A round reads a row for each block of cells, and adds up what loops over the texts do."""
    monkeypatch.setattr(X, "BLOCK", block)
    rng = np.random.default_rng(6)
    n = len(X.LEXICON)
    reader = X.Detector(X.word_hashes(X.LEXICON), np.zeros(n), np.zeros(X.SIZE), np.zeros(n + 3), 0.0)
    texts = [" ".join(rng.choice(["calm", "idiot", "dumm", "you", "moron", "sc**m"], 6)) for _ in range(300)]
    texts = ["", None, *texts, "idiot " * 300, "calm " * 70_000, "..."]
    model = X.fit_label_model(n + 4, summed(ballot_of(reader.read([t or "" for t in texts])[1], rng.integers(-1, 2, len(texts)))))
    used = np.union1d(np.arange(0, X.SIZE, 3), X._slots(X.read_terms(["calm idiot you"]).hashes))  # columns beyond 65,535
    rows = X.soft_rows(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), reader, model, used)
    held = [len(r.lengths) // 4 for r in rows.collect()]
    assert sum(held) == len(texts)
    assert len(held) <= 4 if block > 40 else len(held) > 50
    x = rng.normal(size=len(used) + n + 4) / 100
    detector, value, grad = X.with_weights(reader, used, x), 0.0, np.zeros(len(x))
    column = {int(s): i for i, s in enumerate(used)}
    for t in texts:
        hashes, words = plain_terms(t or "")
        votes = reader.read([t or ""])[1][0].astype(float)
        q = float(model.posterior(ballot_of(votes[None].astype(np.int8), np.array([-1])))[0])
        p = float(detector.scores([t])[0])
        value -= q * math.log(p) + (1 - q) * math.log(1 - p)
        for slot, times in Counter(h >> 64 - X.BITS for h in hashes).items():
            if slot in column:
                grad[column[slot]] += (p - q) * 100 * times / max(words, 1)
        grad[len(used) : -1] += (p - q) * votes
        grad[-1] += p - q
    found = X.summed_entropy(rows, len(used), n)(x)
    assert found[0] == pytest.approx(value, rel=1e-9)
    assert np.allclose(found[1], grad, rtol=1e-9, atol=1e-9)


def test_label_model_reaches_the_classifier(spark, monkeypatch):
    """Texts without a label teach the classifier what the label model says of them."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(40)]
    texts = [" ".join([*rng.choice(words, 20), *(["moron"] * 2 if i % 8 == 0 else [])]) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    none, calm, rude = spark.createDataFrame([], "doc_id long, toxic int"), texts[1], texts[8]
    found = X.fit(docs, none).scores([calm, rude])
    assert found[0] < X.REJECT < found[1]
    labels = spark.createDataFrame([(i, 0) for i in range(1, 400, 2)], "doc_id long, toxic int")
    right = X.label_all

    def inverted(*given):
        model = right(*given)
        return X.LabelModel(model.rates[::-1], model.share, 1 - model.prior, model.told)

    before = X.fit(docs, labels).scores([calm, rude])
    monkeypatch.setattr(X, "label_all", inverted)
    after = X.fit(docs, labels).scores([calm, rude])
    assert np.abs(after - before).max() > 0.1


@pytest.mark.parametrize("most", [C.BLOOM_MOST, 1 << 15])
def test_rows_without_keys_are_those_of_the_anti_join(spark, monkeypatch, most):
    """Also where the filters are so full that most ids pass both."""
    monkeypatch.setattr(C, "BLOOM_MOST", most)
    ids = [None, None, *[5] * 300, *[6] * 300, *range(-3_000, 60_000, 3)]
    rows = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(7)
    for keys in ([], [5], [*range(0, 40_000, 2), 5]):
        table = spark.createDataFrame([(k,) for k in keys], "doc_id long")
        found = [r.text for r in C.without_keys(rows, table, "doc_id", rows.select("doc_id")).collect()]
        known = set(keys)
        assert sorted(found) == sorted(f"text {n}" for n, i in enumerate(ids) if i not in known)


def test_toxicity_fit_shuffles_no_texts_for_their_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some calm words and number {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(0, 300, 2)], "doc_id long, toxic int")
    seen, right = [], X.soft_rows

    def looked_at(plain, *rest):
        seen.append((plain._jdf.queryExecution().executedPlan().toString(), sorted(r.doc_id for r in plain.collect())))
        return right(plain, *rest)

    monkeypatch.setattr(X, "soft_rows", looked_at)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many labels
    try:
        X.fit(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in seen[0][0]
    assert seen[0][1] == [i for i in range(1, 300, 2) if zlib.crc32(str(i).encode()) % 4 != 2]


def test_the_driver_holds_the_samples_cells_once(spark, monkeypatch):
    """The further fit takes the sample's own arrays, slots turned into columns, and finds what copies would."""
    rng = np.random.default_rng(4)
    n, slots = len(X.LEXICON), np.array([7, 90, 4_000])
    pick = rng.integers(0, 3, 60)
    sample = X.Sample(rng.integers(0, 2, 12), np.sort(rng.integers(0, 12, 60)).astype(np.int32), slots[pick].astype(np.int32), rng.random(60).astype(np.float32), np.zeros(0, np.uint64))
    held, seen, right = sample.slot, [], X.logistic_loss
    monkeypatch.setattr(X, "logistic_loss", lambda row, col, *rest: seen.append(col) or right(row, col, *rest))
    monkeypatch.setattr(X, "summed_entropy", lambda rows, n_cols, n_terms: lambda x: (0.0, np.zeros(len(x))))
    start = X.Detector(X.word_hashes(X.LEXICON), np.zeros(n), np.zeros(X.SIZE), np.zeros(n + 3), 0.0)
    votes = np.zeros((12, n + 4), np.int8)
    votes[:, -1] = 2 * sample.labels - 1
    found = X.fit_further(start, None, sample, votes, X.LabelModel(None, np.ones(n + 4), 0.1))
    assert seen[0] is held and seen[0].tolist() == pick.tolist()
    assert np.all(found.weights[slots] != 0) and np.count_nonzero(found.weights) == 3


def test_toxicity_query(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in K.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    hit = [r.predicted for r in rows if toxic[r.doc_id] == 1]
    false = [r.predicted for r in rows if toxic[r.doc_id] == 0]
    assert np.mean(hit) > 0.8
    assert np.mean(false) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    calm = [" ".join(rng.choice(words, 30)) for _ in range(300)]
    rude = [" ".join([*rng.choice(words, 30), *rng.choice(X.LEXICON[:5], 3)]) for _ in range(40)]
    detector = X.fit_rows([*calm, *rude], np.array([0] * 300 + [1] * 40))
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "idiot " * 30_000, "c")], "doc_id long, text string, score string")
    out = {r.doc_id: r.predicted for r in X.score(docs, detector).collect()}
    assert out[1] == out[2] == 0
    kept = X.without_toxic(docs, detector)
    assert kept.columns == docs.columns
    assert X.score(spark.createDataFrame([], "doc_id long, text string"), detector).count() == 0
    assert X.fit_rows([], np.zeros(0, int)).scores(["x"]).shape == (1,)
