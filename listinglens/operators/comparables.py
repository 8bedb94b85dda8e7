"""Comparable listings: similarities, guardrails, scores, reasons and retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights, tolerances and bounds of the comparison.
WEIGHTS = {"district": 24.0, "neighborhood": 20.0, "rooms": 16.0, "m2_gross": 18.0, "building_age": 6.0, "floor": 5.0, "heating_type": 2.0}
TOLERANCES = {"rooms": 3.0, "m2_gross": 100.0, "building_age": 25.0, "floor": 12.0}
STRICT, RELAXED = {"rooms": 2.0, "m2": 0.40, "price": 0.60}, {"rooms": 3.0, "m2": 0.55, "price": 0.80}
MOST, CANDIDATES, GOOD, FALLBACK = 5, 120, 55, 40
#: The reasons shown, in order.
REASONS = {
    "district": "Aynı ilçe", "neighborhood": "Aynı mahalle", "rooms_same": "Oda tipi aynı", "rooms_near": "Oda tipi yakın", "m2_near": "m² değeri yakın",
    "m2_like": "m² aralığı benzer", "floor": "Kat seviyesi benzer", "age": "Bina yaşı yakın", "heating": "Isıtma tipi aynı", "none": "Temel konut özellikleri benzer",
}


def _text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def same_text(a: Column, b: Column) -> Column:
    """Equal once trimmed and lower-cased; two blanks are equal."""
    return _text(a) == _text(b)


def cat_sim(a: Column, b: Column) -> Column:
    return F.when((_text(a) != "") & (_text(b) != ""), same_text(a, b).cast("double"))


def num_sim(a: Column, b: Column, tolerance: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / tolerance)


def num_sim_or_null(a: Column, b: Column, tolerance: float) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), num_sim(a, b, tolerance))


def rel_diff(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def guardrails(q, c, price: Column, bounds: dict) -> Column:
    """q and c give the columns of query and candidate by name; an unknown side passes."""
    checks = [F.abs(q("rooms") - c("rooms")) <= bounds["rooms"], rel_diff(q("m2_gross"), c("m2_gross")) <= bounds["m2"], rel_diff(price, c("price")) <= bounds["price"]]
    return reduce(lambda a, b: a & b, [F.coalesce(x, F.lit(True)) for x in checks])


def match_score(q, c) -> Column:
    """Weighted mean of the known similarities in per cent, with bonuses, rounded half to even, 0 to 99."""
    sims = {n: num_sim_or_null(q(n), c(n), TOLERANCES[n]) if n in TOLERANCES else cat_sim(q(n), c(n)) for n in WEIGHTS}
    total = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), WEIGHTS[n]).otherwise(0.0) for n, s in sims.items()])
    weighted = reduce(lambda a, b: a + b, [F.coalesce(s * WEIGHTS[n], F.lit(0.0)) for n, s in sims.items()])
    bonus = (
        F.when(same_text(q("district"), c("district")), 6.0).otherwise(0.0)
        + F.when(same_text(q("neighborhood"), c("neighborhood")), 8.0).otherwise(0.0)
        + F.when(F.abs(q("m2_gross") - c("m2_gross")) <= 15, 4.0).otherwise(0.0)
        + F.when(F.abs(q("rooms") - c("rooms")) < 0.1, 4.0).otherwise(0.0)
    )
    score = F.least(F.greatest(F.bround(100.0 * weighted / total + bonus), F.lit(0.0)), F.lit(99.0))
    return F.when(total > 0, score).otherwise(0.0).cast("int")


def distance_score(d: Column, p10: Column, p90: Column) -> Column:
    """100 at the tenth percentile of distances, 10 at the ninetieth, 5 to 99."""
    spread = 100 - 90 * (d - p10) / F.greatest(p90 - p10, F.lit(1e-6))
    score = F.when(p90 <= p10, 100 - d * 10).otherwise(spread)
    return F.least(F.greatest(F.bround(score), F.lit(5.0)), F.lit(99.0)).cast("int")


def match_reasons(q, c) -> Column:
    """The first four reasons that hold, or the default one."""
    gap, area = F.abs(q("rooms") - c("rooms")), rel_diff(q("m2_gross"), c("m2_gross"))
    found = [
        F.when(same_text(q("district"), c("district")), REASONS["district"]),
        F.when(same_text(q("neighborhood"), c("neighborhood")), REASONS["neighborhood"]),
        F.when(gap < 0.1, REASONS["rooms_same"]).when(gap <= 1.0, REASONS["rooms_near"]),
        F.when(area <= 0.15, REASONS["m2_near"]).when(area <= 0.30, REASONS["m2_like"]),
        F.when(num_sim_or_null(q("floor"), c("floor"), TOLERANCES["floor"]) >= 0.75, REASONS["floor"]),
        F.when(num_sim_or_null(q("building_age"), c("building_age"), TOLERANCES["building_age"]) >= 0.8, REASONS["age"]),
        F.when(same_text(q("heating_type"), c("heating_type")), REASONS["heating"]),
    ]
    kept = F.array_compact(F.array(*found))
    return F.when(F.size(kept) == 0, F.array(F.lit(REASONS["none"]))).otherwise(F.slice(kept, 1, 4))


def comparables(pairs: DataFrame, k: int = MOST) -> DataFrame:
    """Up to k rows (query_id, listing_id, score, place) for each query, from its candidate pairs.

    pairs has structs `q` and `c` of listings, `price` (the predicted price of
    the query) and `knn_score`. Candidates outside the relaxed guardrails go.
    The rest are ordered by same neighborhood, same district, score and price
    gap; one of each signature stays. Three strict matches of GOOD score are
    enough; else relaxed ones follow the strict ones; else scores from
    FALLBACK on count.
    """
    q, c = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"c.{n}"))
    scored = pairs.where(guardrails(q, c, F.col("price"), RELAXED)).select(
        F.col("q.listing_id").alias("query_id"),
        F.col("c.listing_id").alias("listing_id"),
        F.bround(match_score(q, c) * 0.8 + F.col("knn_score") * 0.2).cast("int").alias("score"),
        guardrails(q, c, F.col("price"), STRICT).alias("strict"),
        same_text(q("neighborhood"), c("neighborhood")).alias("near"),
        same_text(q("district"), c("district")).alias("close"),
        F.coalesce(rel_diff(F.col("price"), c("price")), F.lit(0.0)).alias("gap"),
        F.concat_ws("|", c("district"), c("neighborhood"), c("rooms").cast("string"), c("m2_gross").cast("string"), F.bround(c("price")).cast("string")).alias("sig"),
    )
    order = [F.desc("near"), F.desc("close"), F.desc("score"), F.asc("gap"), F.asc("listing_id")]
    rows = scored.where(F.col("score") >= FALLBACK)
    tier = F.when((F.col("score") >= GOOD) & F.col("strict"), 1).when(F.col("score") >= GOOD, 2).otherwise(3)
    # the best row of each signature within every list that a query may end with: strict, good, any
    rows = rows.withColumn("tier", tier)
    for name, bound in (("s", 1), ("g", 2), ("f", 3)):
        mine = F.when(F.col("tier") <= bound, 1).otherwise(2)
        rows = rows.withColumn(f"first_{name}", (F.row_number().over(Window.partitionBy("query_id", "sig").orderBy(mine, *order)) == 1) & (F.col("tier") <= bound))
    whole = Window.partitionBy("query_id")
    rows = rows.withColumns({"n_strict": F.count_if("first_s").over(whole), "n_good": F.count_if("first_g").over(whole)})
    # signatures of strict rows come first in a merged list; a good row of the same signature gives way
    has_strict = F.max(F.col("first_s").cast("int")).over(Window.partitionBy("query_id", "sig")) == 1
    rows = rows.withColumn("has_strict", has_strict)
    enough = F.col("n_strict") >= min(3, k)
    used = (
        F.when(enough, F.col("first_s"))
        .when(F.col("n_good") > 0, F.col("first_s") | (F.col("first_g") & ~F.col("has_strict")))
        .otherwise(F.col("first_f"))
    )
    rows = rows.where(used)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("first_s"), *order))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("query_id", "listing_id", "score", "place")
