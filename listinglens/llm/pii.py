"""Personal data: base patterns, and identifiers found by bootstrapped contexts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglens.llm.common import join_hot, stage_table

#: Kinds in the order in which spans are listed, and their patterns. The look-behinds and possessive
#: repeats change no match; they keep long runs of one class linear and off the regex engine's stack.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Without this character a text has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: An identifier-shaped token: letters, digits and joiners, with a digit. It needs FEWEST_DIGITS digits.
TOKEN = r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]{6,}+"
FEWEST_DIGITS = 4
#: Characters of context read on each side; elements of an array, and characters of a text, that are worked on at a time.
CONTEXT, STRIDE, BLOCK = 48, 64, 1024
#: Bootstrapping: rounds, distinct known entities a pattern needs, its least share of known entities, the score that makes an instance known.
ROUNDS, SUPPORT, CONFIDENCE, KNOWN = 3, 5, 0.7, 0.9


def _words(part: Column) -> Column:
    return F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _contexts(before: Column, after: Column) -> Column:
    """Lexical patterns around an occurrence: the two words before it, and one word on each side."""
    left, right = _words(F.substring(before, -CONTEXT, CONTEXT)), _words(F.substring(after, 1, CONTEXT))
    last, first = F.try_element_at(left, F.lit(-1)), F.get(right, 0)
    two = F.when(F.size(left) >= 2, F.concat(F.lit("L|"), F.try_element_at(left, F.lit(-2)), F.lit(" "), last))
    both = F.concat(F.lit("B|"), last, F.lit("|"), first)
    return F.array_compact(F.array(two, both))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check over a digit string: from the right, every second digit doubled, its own digits summed."""
    parts = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    each = F.transform(parts, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.when(F.length(short).between(1, 3), short.cast("int")).otherwise(0) <= 255)


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _octet)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str) -> tuple[Column, Column]:
    """The stretches between the matches of a pattern, one more than matches, and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _rows(gaps: Column, found: Column) -> Column:
    """Array of (a, b, value): each match with the stretches before and after it."""
    rows = F.zip_with(
        F.zip_with(gaps, F.slice(gaps, F.lit(2), F.size(gaps)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        found,
        lambda g, m: F.struct(g["a"].alias("a"), g["b"].alias("b"), m.alias("value")),
    )
    return F.filter(rows, lambda r: r["value"].isNotNull())


def _add(a: Column, b: Column) -> Column:
    return a + b


def _once(c: Column) -> Column:
    """c, worked out once for a row: Spark does not move it into the functions that read it for each element of an array."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def running(df: DataFrame, arrays: dict[str, Column], merge=_add) -> DataFrame:
    """df with each named array of longs and, as <name>_before, what merge makes of the elements before each one, from zero.

    A fold that gathers an array copies it at every step. So the elements are
    merged in strides, and the strides in strides of strides: work stays close
    to proportional to the length of the array.
    """
    none = F.expr("cast(array() as array<long>)")

    def fold(a, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(a, first, n), F.lit(0).cast("long"), lambda so_far, x: merge(so_far, x))

    def strides(a: str) -> Column:
        firsts = F.sequence(F.lit(1), F.size(a), F.lit(STRIDE))
        return F.when(F.size(a) > 0, F.transform(firsts, lambda i: fold(a, i, F.lit(STRIDE)))).otherwise(none)

    def place(i: Column) -> Column:
        return F.floor(i / STRIDE).cast("int")

    names = list(arrays)
    df = df.withColumns({c: _once(a) for c, a in arrays.items()})
    df = df.withColumns({f"{c}_by1": _once(strides(c)) for c in names})
    df = df.withColumns({f"{c}_by2": _once(strides(f"{c}_by1")) for c in names})

    def upper(c: str):
        return lambda x, j: merge(fold(f"{c}_by2", F.lit(1), place(j)), fold(f"{c}_by1", place(j) * STRIDE + 1, j % STRIDE))

    def lower(c: str):
        return lambda x, i: merge(F.get(f"{c}_by3", place(i)), fold(c, place(i) * STRIDE + 1, i % STRIDE))

    df = df.withColumns({f"{c}_by3": _once(F.transform(f"{c}_by1", upper(c))) for c in names})
    df = df.withColumns({f"{c}_before": _once(F.transform(c, lower(c))) for c in names})
    return df.drop(*[f"{c}_by{i}" for c in names for i in (1, 2, 3)])


def _occurrences(kind: str, wanted) -> Column:
    """Array of (start, end, value, pats) of the wanted matches; <kind>_at_before has the code points before each match's stretch."""

    def placed(x: Column, i: Column) -> Column:
        start = (F.get(f"{kind}_at_before", i) + F.length(x["a"])).cast("int")
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["a"].alias("a"), x["b"].alias("b"))

    kept = F.filter(F.transform(f"{kind}_rows", placed), lambda x: wanted(x["value"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _contexts(x["a"], x["b"]).alias("pats")))


def scan(docs: DataFrame, keep_columns: bool = False) -> DataFrame:
    """One staged row per input row: row_id, doc_id (and doc, all columns), base spans and occurrences.

    base: array of (kind, start, end) of the four kinds. occ: array of (kind,
    start, end, value, pats): the base spans, and with null kind the
    identifier-shaped tokens that touch none of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep_columns else []
    cut = docs.select(F.col("doc_id").alias("doc_id"), text.alias("t"), *carried)
    arrays = []
    for kind, pattern in (*PATTERNS.items(), ("token", TOKEN)):
        gaps, found = _located(F.col("t"), pattern)
        there = F.col("t").contains(NEEDS[kind]) if kind in NEEDS else F.col("t").rlike("[0-9]")
        arrays.append(F.when(there, gaps).otherwise(F.array(F.lit(""))).alias(f"{kind}_gaps"))
        arrays.append(F.when(there, found).otherwise(F.expr("cast(array() as array<string>)")).alias(f"{kind}_found"))
    names = [n for n in ("doc_id", "doc") if n in cut.columns]
    cut = cut.select(*names, *arrays)
    kinds = (*KINDS, "token")
    cut = cut.select(*names, *[_once(_rows(F.col(f"{k}_gaps"), F.col(f"{k}_found"))).alias(f"{k}_rows") for k in kinds])
    lengths = {f"{k}_at": F.transform(f"{k}_rows", lambda x: (F.length(x["a"]) + F.length(x["value"])).cast("long")) for k in kinds}
    cut = running(cut, lengths)
    cut = cut.select(*names, *[_matches(k).alias(k) for k in kinds])
    tagged = [F.transform(k, _tagger(k)) for k in KINDS]
    cut = cut.select(*names, F.concat(*tagged).alias("base"), F.transform("token", _tagger(None)).alias("token"))
    # base spans and tokens in one order: a token touches a base span that ends after it starts, or that comes next and starts before it ends
    order = _once(F.array_sort(F.concat("base", "token"), _by_place))
    cut = running(cut.withColumn("all", order), {"reach": F.transform("all", lambda x: F.when(x["kind"].isNotNull(), x["end"]).otherwise(0).cast("long"))}, F.greatest)
    free = F.transform("all", lambda x, i: F.struct(x.alias("x"), _free(x, i).alias("ok")))
    tokens = F.transform(F.filter(free, lambda y: y["ok"]), lambda y: y["x"])
    out = cut.select(
        F.monotonically_increasing_id().alias("row_id"),
        *names,
        F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))).alias("base"),
        F.concat("base", tokens).alias("occ"),
    )
    return stage_table(out, "pii")


def _by_place(a: Column, b: Column) -> Column:
    """Order of spans by start, base spans before tokens."""
    less = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & a["kind"].isNotNull() & b["kind"].isNull())
    more = (a["start"] > b["start"]) | ((a["start"] == b["start"]) & a["kind"].isNull() & b["kind"].isNotNull())
    return F.when(less, -1).when(more, 1).otherwise(0)


def _free(x: Column, i: Column) -> Column:
    """Whether the element x at place i of `all` is a token that touches no base span."""
    after = F.get("all", i + 1)
    meets = F.coalesce(after["kind"].isNotNull() & (after["start"] < x["end"]), F.lit(False))
    return x["kind"].isNull() & (F.get("reach_before", i) <= x["start"]) & ~meets


def _matches(kind: str) -> Column:
    """The valid matches of a kind, or the identifier-shaped tokens with digits enough."""
    valid = (lambda v: F.length(_digits(v)) >= FEWEST_DIGITS) if kind == "token" else (lambda v: _valid(kind, v))
    return _occurrences(kind, valid)


def _tagger(kind: str | None):
    return lambda x: _tagged(F.lit(kind).cast("string"), x)


def _tagged(kind: Column, x: Column) -> Column:
    return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["pats"].alias("pats"))


def bootstrap(scanned: DataFrame) -> DataFrame | None:
    """Rows (value, kind): identifiers that high-confidence patterns discover; None if there are none.

    The graph joins patterns to distinct values. Known values, at first the
    base ones, give a pattern its confidence in a kind: their summed score
    over all its values. Patterns with enough of both score the values they
    surround, as one less the product of their doubts; values over KNOWN join
    the known ones for the next round.
    """
    met = scanned.select(F.explode("occ").alias("o"))
    edges = met.select(F.explode("o.pats").alias("pat"), F.col("o.value").alias("value"), F.col("o.kind").alias("kind"))
    edges = stage_table(edges.distinct(), "pii-edges")
    n_edges = edges.count()
    seeds = edges.where("kind is not null").select("pat", "value", "kind", F.lit(1.0).alias("score"))
    open_edges = edges.where("kind is null").select("pat", "value")
    size = edges.select("pat", "value").distinct().groupBy("pat").agg(F.count("*").alias("total"))
    degree = open_edges.groupBy("value").agg(F.count("*").alias("pats"))
    found, before = None, 0
    for _ in range(ROUNDS):
        known = seeds
        if found is not None:
            sized = found.join(degree, "value")
            known = known.unionByName(join_hot(open_edges, sized, "value", "pats", n_edges).select("pat", "value", "kind", "score"))
        hits = known.groupBy("pat", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("hits")).where(F.col("hits") >= SUPPORT)
        trusted = hits.join(size, "pat").select("pat", "kind", "total", F.least(F.col("sum") / F.col("total"), F.lit(0.95)).alias("conf"))
        trusted = trusted.where(F.col("conf") >= CONFIDENCE)
        near = join_hot(open_edges, trusted, "pat", "total", n_edges)
        scored = near.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        found = stage_table(best.where(F.col("score") >= KNOWN), "pii-found")
        now = found.count()
        if now == before:
            break
        before = now
    return found.select("value", "kind") if before else None


def find(docs: DataFrame, keep_columns: bool = False) -> DataFrame:
    """Rows (doc_id, base, spans), one per input row, and doc with all its columns if asked.

    base holds the spans (kind, start, end) of the base patterns, ordered by
    kind as in KINDS, then start; spans holds those and the discovered ones in
    the same order. Offsets count code points, end exclusive. Null and empty
    texts have none; null ids stay null; repeated rows are each reported; an
    empty table gives an empty result; other columns do not matter.
    """
    scanned = scan(docs, keep_columns)
    names = [n for n in ("doc_id", "doc") if n in scanned.columns]
    found = bootstrap(scanned)
    if found is None:
        return scanned.select(*names, "base", F.col("base").alias("spans"))
    loose = scanned.select("row_id", F.explode("occ").alias("o")).where("o.kind is null")
    extra = loose.select("row_id", F.col("o.start").alias("start"), F.col("o.end").alias("end"), F.col("o.value").alias("value"))
    often = extra.groupBy("value").agg(F.count("*").alias("times"))
    extra = join_hot(extra, found.join(often, "value"), "value", "times", extra.count()).groupBy("row_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    joined = scanned.select("row_id", *names, "base").join(extra, "row_id", "left")
    every = F.concat("base", F.coalesce("extra", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")))
    place = F.transform(every, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(place), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(*names, "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(ordered).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the SHA-256 of the base spans and all spans as text."""
    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [n(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, each span of its text replaced by its kind in brackets; n_chars follows the new text.

    Overlapping spans are one stretch, named by the first. A null text stays null.
    """
    found = find(docs, keep_columns=True)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # the text in blocks, so that no piece of it is sought from its start
    text = F.col("doc.text")
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    cut = found.select("doc", ordered.alias("ordered"), _once(F.when(F.size("spans") > 0, blocks)).alias("blocks"))
    cut = running(cut, {"reach": F.transform("ordered", lambda x: x["end"].cast("long"))}, F.greatest)

    def piece(start: Column, end: Column) -> Column:
        """Characters start to end, from the blocks that hold them."""
        first = F.floor(start / BLOCK).cast("int")
        held = F.array_join(F.slice("blocks", first + 1, F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0))), "")
        return F.when(end > start, F.substr(held, start - first * BLOCK + 1, end - start)).otherwise("")

    def written(x: Column, i: Column) -> Column:
        reach = F.get("reach_before", i).cast("int")
        return F.when(x["start"] >= reach, F.concat(piece(reach, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

    last = F.array_max(F.transform("ordered", lambda x: x["end"]))
    whole = F.concat(F.array_join(F.transform("ordered", written), ""), piece(last, F.length(text)))
    found = cut
    clean = F.when(F.size("ordered") == 0, text).otherwise(whole)
    out = found.select("doc", clean.alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns])
