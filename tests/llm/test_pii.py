"""Personal data: base spans against Python's regular expressions, discovered spans, redaction."""

import hashlib
import random
import re

from listinglens.llm import pii as P
from listinglens.llm import queries as K

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    def ok(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


HARD = [
    "a@b.c_d@e.f x..y@z.w-.q a@b a@.b @a.b",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3 9.9.9.9.",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 12345678901234567890 0000000000000",
    "+1 (017) 555-7713 +12 +1234567890123456 +1 ( ) 2 +4(9)0 12.34.56 78",
    "é😀 4111111111111111 ü user@example.com 😀",
    "9" * 5000 + " " + "a." * 3000 + "@x " + "+1" + "(" * 4000,
    "",
    None,
]


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    rows = {r.doc_id: r for r in P.digests(P.find(docs)).collect()}
    for i, text in enumerate(HARD):
        want = plain_spans(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [rows[i][f"n_{k}"] for k in P.KINDS] == [sum(s.startswith(k) for s in want) for k in P.KINDS]


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in K.op1_pii(spark, sf).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please reach me at user{i}@mail.example today") for i in range(12)]
    rows += [(100, "please reach me at handle-4471 today"), (101, "order of 990-4471x units, the best")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in P.find(docs).collect()}
    assert found[100] == [("email", 19, 30)]
    assert found[101] == []


def test_untrusted_patterns_discover_nothing(spark):
    rows = [(i, f"the user{i}@mail.example is") for i in range(6)] + [(50 + i, f"the code 77{i}0-88 is") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.spans == r.base for r in P.find(docs).collect())


def test_redaction_keeps_columns_and_rows(spark):
    rows = [(1, "mail a.b@c.example now", "en", 22), (2, None, "en", 0), (3, "", None, 0), (3, "", None, 0), (4, "call +1 (017) 555-7713 or 4111111111111111!", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long")
    out = P.redact(docs)
    assert out.columns == docs.columns
    told = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text is not None)
    assert told == [(1, "mail [EMAIL] now", 16), (3, "", 0), (3, "", 0), (4, "call [PHONE] or [CARD]!", 23)]
    assert out.where("text is null").count() == 1


def test_empty_table(spark):
    assert P.digests(P.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = P.redact(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_matches_in_one_text(spark):
    """Over two levels of strides, with tokens between and inside base spans."""
    text = "".join(f"id{i}x77 u{i}@m{i % 7}.example, 10.0.{i % 300}.{i % 255} é " for i in range(6000))
    docs = spark.createDataFrame([(1, text), (2, "😀 " * 5000 + "a@b.c")], "doc_id long, text string")
    rows = {r.doc_id: r for r in P.digests(P.find(docs)).collect()}
    for i, t in ((1, text), (2, "😀 " * 5000 + "a@b.c")):
        assert rows[i].base_sha256 == hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in P.redact(docs).collect()}
    for i, t in ((1, text), (2, "😀 " * 5000 + "a@b.c")):
        out, at = [], 0
        spans = [s.split(":") for s in (rows[i].spans or "").split(",")]
        for kind, a, b in sorted(spans, key=lambda s: (int(s[1]), int(s[2]))):
            if int(a) >= at:
                out += [t[at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        assert clean[i] == "".join(out) + t[at:]


def plain_bootstrap(texts):
    """Spans that the bootstrap adds to the base ones, by loops over dictionaries."""
    occ = []
    for d, text in enumerate(texts):
        base = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if f"{k}:{m.start()}:{m.end()}" in plain_spans(text)]
        tokens = [m for m in re.finditer(P.TOKEN.replace("*+", "*").replace("}+", "}"), text) if len(re.sub("[^0-9]", "", m.group())) >= P.FEWEST_DIGITS]
        every = {k: list(re.finditer(p, text)) for k, p in BASE.items()}
        for kind, found in [*every.items(), (None, list(re.finditer(P.TOKEN.replace("*+", "*").replace("}+", "}"), text)))]:
            for n, m in enumerate(found):
                if kind and (kind, m.start(), m.end()) not in base:
                    continue
                if not kind and (m.group() not in [t.group() for t in tokens] or any(a < m.end() and m.start() < b for _, a, b in base)):
                    continue
                before = text[found[n - 1].end() if n else 0 : m.start()][-P.CONTEXT :]
                after = text[m.end() : found[n + 1].start() if n + 1 < len(found) else len(text)][: P.CONTEXT]
                left, right = ([w for w in re.split(r"[\W_]+", x.lower()) if w] for x in (before, after))
                pats = [f"L|{left[-2]} {left[-1]}"] if len(left) > 1 else []
                pats += [f"B|{left[-1]}|{right[0]}"] if left and right else []
                occ.append((d, kind, m.start(), m.end(), m.group(), pats))
    edges = {(p, o[4], o[1]) for o in occ for p in o[5]}
    known, found = {(p, v, k): 1.0 for p, v, k in edges if k}, {}
    for _ in range(P.ROUNDS):
        now = dict(known) | {(p, v, found[v][0]): found[v][1] for p, v, k in edges if k is None and v in found}
        conf = {}
        for p, k in {(p, k) for p, _, k in now}:
            scores = [s for (q, _, j), s in now.items() if (q, j) == (p, k)]
            share = min(sum(scores) / len({v for q, v, _ in edges if q == p}), 0.95)
            if len(scores) >= P.SUPPORT and share >= P.CONFIDENCE:
                conf[p, k] = share
        doubts = {}
        for p, v, k in edges:
            if k is None:
                for (q, j), c in conf.items():
                    if q == p:
                        doubts[v, j] = doubts.get((v, j), 1.0) * (1 - c)
        best = {}
        for (v, k), doubt in doubts.items():
            best[v] = max(best.get(v, (0, "")), (1 - doubt, k))
        new = {v: (k, s) for v, (s, k) in best.items() if s >= P.KNOWN}
        if len(new) == len(found):
            found = new
            break
        found = new
    return {(d, found[v][0], a, b) for d, kind, a, b, v, _ in occ if kind is None and v in found}


def test_bootstrap_against_loops(spark):
    rng = random.Random(4)
    names = [f"{rng.choice(['ref', 'acct', 'usr'])}-{rng.randrange(1000, 9999)}" for _ in range(25)]
    texts = []
    for i in range(90):
        lead = rng.choice(["please write to", "contact me at", "the order was"])
        value = rng.choice([f"user{i}@mail.example", f"user{i % 9}@mail.example", rng.choice(names)])
        if lead == "the order was":
            value = rng.choice(names[:8])
        texts.append(f"Some words. {lead} {value} {rng.choice(['today', 'again', 'soon'])} and see 10.0.0.{i} there")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mine = {(r.doc_id, s.kind, s.start, s.end) for r in P.find(docs).collect() for s in r.spans if s not in r.base}
    assert mine == plain_bootstrap(texts) and mine


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a@b.c", 1), (None, None, 2), (2**53 + 1, "x", 3)], "doc_id long, text string, occ int")
    assert sorted((r.doc_id or 0, r.n_email) for r in P.digests(P.find(docs)).collect()) == [(0, 0), (0, 1), (2**53 + 1, 0)]
    assert sorted((r.doc_id or 0, r.text or "", r.occ) for r in P.redact(docs).collect()) == [(0, "", 2), (0, "[EMAIL]", 1), (2**53 + 1, "x", 3)]
    assert P.redact(docs.limit(0)).count() == 0
