"""Queries of the vector, comparables and confidence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.operators import comparables as C
from listinglens.operators import confidence as Q
from listinglens.operators import vectors as V
from listinglens.operators.quantiles import exact_quantiles
from listinglens.session import rounded, stage_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(build):
        def run(spark, sf_dir):
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


# -- vectors ---------------------------------------------------------------------------------------------------------

CELLS = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


def long_format(df: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """A row for each place of the named arrays."""
    zipped = F.arrays_zip(*names)
    rows = df.select(*keys, F.posexplode(zipped).alias("pos", "z"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), *[rounded(F.col(f"z.{n}"), 6).alias(n) for n in names])


@query("p30_vector_dim", "SELECT min(len(embedding))::BIGINT AS low, max(len(embedding))::BIGINT AS high FROM embeddings")
def _(t):
    size = F.size("embedding").cast("long")
    return t("embeddings").agg(F.min(size).alias("low"), F.max(size).alias("high"))


@query("p31_expand_vector", "SELECT vec_id, embedding[1]::DOUBLE AS e_0, embedding[2]::DOUBLE AS e_1, embedding[3]::DOUBLE AS e_2 FROM embeddings")
def _(t):
    wide = V.expand_vector(t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "embedding", "e", 3)
    return V.expand_vector(V.assemble_vector(wide, "e", 3, "v"), "v", "e", 3)


@query("p32_l2_normalize", f"WITH {CELLS} SELECT vec_id, pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 6) AS v FROM e")
def _(t):
    return long_format(t("embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("v")), ["vec_id"], "v")


@query("a24_pool_vectors", f"WITH {CELLS} SELECT label, pos, round(avg(x), 6) AS mean, round(max(x), 6) AS max FROM e GROUP BY 1, 2")
def _(t):
    return long_format(V.pool_vectors(t("embeddings"), ["label"], "embedding"), ["label"], "mean", "max")


@query("a25_meanmax", f"""WITH {CELLS}, p AS (SELECT label, pos, avg(x) AS m, max(x) AS h FROM e GROUP BY 1, 2),
 n AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS v FROM p UNION ALL SELECT label, pos + 64, h / sqrt(sum(h * h) OVER (PARTITION BY label)) FROM p)
 SELECT label, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS meanmax FROM n""")
def _(t):
    return long_format(V.meanmax(V.pool_vectors(t("embeddings"), ["label"], "embedding")), ["label"], "meanmax")


RANKED = "r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), c AS (SELECT vec_id, label, cap FROM r JOIN (VALUES (4), (8), (12), (16)) v(cap) ON k <= cap)"


@query("a26_pool_caps", f"WITH {CELLS}, {RANKED} SELECT c.label, cap::BIGINT AS cap, pos, round(avg(x), 6) AS mean, round(max(x), 6) AS max FROM c JOIN e USING (vec_id) GROUP BY 1, 2, 3")
def _(t):
    ranked = V.rank_for_caps(t("embeddings"), "label", "vec_id", (4, 8, 12, 16))
    return long_format(V.pool_vectors(ranked, ["label", "cap"], "embedding").withColumn("cap", F.col("cap").cast("long")), ["label", "cap"], "mean", "max")


@query("a27_cap_stats", f"WITH {RANKED} SELECT cap::BIGINT AS cap, count(DISTINCT label) AS keys, count(*) AS items, round(count(*) / count(DISTINCT label), 4) AS mean_items FROM c GROUP BY 1")
def _(t):
    stats = V.cap_stats(V.rank_for_caps(t("embeddings").select("label", "vec_id"), "label", "vec_id", (4, 8, 12, 16)), "label")
    return stats.withColumn("cap", F.col("cap").cast("long"))


PAIRS_E = "SELECT q.vec_id AS query, c.vec_id AS vec_id, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id"


@query("j09_knn_candidates", f"SELECT query, vec_id, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS r FROM ({PAIRS_E})) WHERE r <= 120")
def _(t):
    e = t("embeddings")
    return V.knn(e.where("vec_id % 100 = 0"), e, 120, "vec_id", "embedding").select("query", "vec_id", rounded(F.col("distance"), 5).alias("distance"))


@query("j11_knn_calibration", f"SELECT round(quantile_cont(d, 0.1), 5) AS p10, round(quantile_cont(d, 0.9), 5) AS p90, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS r FROM ({PAIRS_E})) WHERE r <= 5")
def _(t):
    e = t("embeddings")
    near = V.knn(e.where("vec_id % 100 = 0"), e, 5, "vec_id", "embedding")
    return near.agg(rounded(F.percentile("distance", F.lit(0.1)), 5).alias("p10"), rounded(F.percentile("distance", F.lit(0.9)), 5).alias("p90"), F.count("*").alias("n"))


@query("m20_nearest_concept", """WITH b AS (SELECT vec_id AS concept, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 8)
 SELECT vec_id, arg_max(concept, (round(list_inner_product(embedding::DOUBLE[], v), 9), concept)) AS concept FROM embeddings, b GROUP BY 1""")
def _(t):
    bank = t("embeddings").where("vec_id < 8").select(F.col("vec_id").alias("label"), F.col("embedding").alias("vector"))
    return V.nearest_concept(t("embeddings"), bank, "embedding").select("vec_id", F.col("best.label").alias("concept"))


# -- comparables: parts stand for listings ---------------------------------------------------------------------------


def part_listing(t) -> DataFrame:
    p = t("part")
    listing = F.struct(
        F.col("p_partkey").alias("listing_id"), F.col("p_brand").alias("district"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("neighborhood"),
        (F.col("p_size") % 7 + 1).cast("double").alias("rooms"), (F.col("p_size") * 5).cast("double").alias("m2_gross"), (F.col("p_partkey") % 30).cast("double").alias("building_age"),
        (F.col("p_partkey") % 12).cast("double").alias("floor"), F.split("p_name", " ")[0].alias("heating_type"), F.col("p_retailprice").alias("price"),
    )
    vector = F.array((F.col("p_size") * 26).cast("double"), F.round("p_retailprice"))
    return p.select("p_partkey", listing.alias("l"), vector.alias("v"))


def part_pairs(t) -> DataFrame:
    """The stated queries with their 120 nearest parts, as structs q and c, and the distance."""
    rows = part_listing(t)
    near = V.knn(rows.where("p_partkey % 100 = 0"), rows, C.CANDIDATES, "p_partkey", "v").select("query", F.col("p_partkey").alias("found"), "distance")
    own = rows.select(F.col("p_partkey").alias("query"), F.col("l").alias("q"))
    other = rows.select(F.col("p_partkey").alias("found"), F.col("l").alias("c"))
    return near.join(own, "query").join(other, "found").withColumn("price", F.col("q.price"))


PART = """ls AS (SELECT p_partkey AS id, p_brand AS district, CASE WHEN p_partkey % 9 <> 0 THEN p_type END AS nb, (p_size % 7 + 1)::DOUBLE AS rooms, (p_size * 5)::DOUBLE AS m2, (p_partkey % 30)::DOUBLE AS age, (p_partkey % 12)::DOUBLE AS fl,
  string_split(p_name, ' ')[1] AS heat, p_retailprice AS price, p_size * 26 AS vx, round(p_retailprice) AS vy FROM part),
 pr AS (SELECT * FROM (SELECT q.id AS qid, c.id AS cid, sqrt((q.vx - c.vx) ** 2 + (q.vy - c.vy) ** 2) AS d, q, c, row_number() OVER (PARTITION BY q.id ORDER BY (q.vx - c.vx) ** 2 + (q.vy - c.vy) ** 2, c.id) AS r FROM ls q, ls c WHERE q.id % 100 = 0 AND q.id <> c.id) WHERE r <= 120),
 sm AS (SELECT qid, cid, d, q, c, (lower(q.district) = lower(c.district)) AS sd, coalesce(lower(q.nb), '') = coalesce(lower(c.nb), '') AS sn, CASE WHEN q.nb IS NOT NULL AND c.nb IS NOT NULL THEN (q.nb = c.nb)::INT END AS nbs,
  greatest(0, 1 - abs(q.rooms - c.rooms) / 3) AS rs, greatest(0, 1 - abs(q.m2 - c.m2) / 100) AS ms, greatest(0, 1 - abs(q.age - c.age) / 25) AS ags, greatest(0, 1 - abs(q.fl - c.fl) / 12) AS fs, (q.heat = c.heat)::INT AS hs,
  abs(q.m2 - c.m2) / greatest(q.m2, c.m2, 1) AS mg, abs(q.price - c.price) / greatest(q.price, c.price, 1) AS pg FROM pr),
 sc AS (SELECT *, 24 * sd::INT + coalesce(20 * nbs, 0) + 16 * rs + 18 * ms + 6 * ags + 5 * fs + 2 * hs AS ws, 71 + CASE WHEN nbs IS NULL THEN 0 ELSE 20 END AS tw FROM sm)"""


@query("r02_categorical_similarity", f"WITH {PART} SELECT qid, cid, sd::INT::DOUBLE AS district, nbs::DOUBLE AS neighborhood FROM sm")
def _(t):
    p = part_pairs(t)
    return p.select(F.col("query").alias("qid"), F.col("found").alias("cid"), C.cat_sim(F.col("q.district"), F.col("c.district")).alias("district"), C.cat_sim(F.col("q.neighborhood"), F.col("c.neighborhood")).alias("neighborhood"))


@query("r03_numeric_similarity", f"WITH {PART} SELECT qid, cid, round(rs, 6) AS rooms, round(ms, 6) AS area, round(mg, 6) AS area_gap, round(pg, 6) AS price_gap FROM sm")
def _(t):
    p = part_pairs(t)
    return p.select(
        F.col("query").alias("qid"), F.col("found").alias("cid"), rounded(C.num_sim(F.col("q.rooms"), F.col("c.rooms"), 3.0), 6).alias("rooms"), rounded(C.num_sim(F.col("q.m2_gross"), F.col("c.m2_gross"), 100.0), 6).alias("area"),
        rounded(C.rel_diff(F.col("q.m2_gross"), F.col("c.m2_gross")), 6).alias("area_gap"), rounded(C.rel_diff(F.col("q.price"), F.col("c.price")), 6).alias("price_gap"),
    )


@query("v13_guardrails", f"WITH {PART} SELECT qid, cid, abs(q.rooms - c.rooms) <= 2 AND mg <= 0.40 AND pg <= 0.60 AS strict, abs(q.rooms - c.rooms) <= 3 AND mg <= 0.55 AND pg <= 0.80 AS relaxed FROM sm")
def _(t):
    q, c = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"c.{n}"))
    return part_pairs(t).select(F.col("query").alias("qid"), F.col("found").alias("cid"), C.guardrails(q, c, F.col("price"), C.STRICT).alias("strict"), C.guardrails(q, c, F.col("price"), C.RELAXED).alias("relaxed"))


@query("r05_match_score", f"WITH {PART} SELECT qid, cid, least(99, round_even(100 * ws / tw + 6 * sd::INT + 8 * sn::INT + CASE WHEN abs(q.m2 - c.m2) <= 15 THEN 4 ELSE 0 END + CASE WHEN q.rooms = c.rooms THEN 4 ELSE 0 END, 0))::BIGINT AS score FROM sc")
def _(t):
    q, c = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"c.{n}"))
    return part_pairs(t).select(F.col("query").alias("qid"), F.col("found").alias("cid"), C.match_score(q, c).cast("long").alias("score"))


def with_bounds(p: DataFrame) -> DataFrame:
    """The staged pairs with p10 and p90, the exact percentiles of all distances: a percentile aggregate would hold every distinct distance in one task."""
    p = stage_table(p, "pairs")
    bounds = exact_quantiles(p, ["distance"], (0.1, 0.9)).select(F.get("quantiles", 0).alias("p10"), F.get("quantiles", 1).alias("p90"))
    return p.crossJoin(F.broadcast(bounds))  # one row


@query("r06_distance_score", f"WITH {PART}, b AS (SELECT quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.9) AS p90 FROM pr) SELECT qid, cid, greatest(5, least(99, round_even(100 - 90 * (d - p10) / (p90 - p10), 0)))::BIGINT AS score FROM pr, b")
def _(t):
    score = C.distance_score(F.col("distance"), F.col("p10"), F.col("p90"))
    return with_bounds(part_pairs(t).select("query", "found", "distance")).select(F.col("query").alias("qid"), F.col("found").alias("cid"), score.cast("long").alias("score"))


MATCHED = """w AS (SELECT qid, cid, list_filter([CASE WHEN sd THEN 'Aynı ilçe' END, CASE WHEN sn THEN 'Aynı mahalle' END, CASE WHEN q.rooms = c.rooms THEN 'Oda tipi aynı' WHEN abs(q.rooms - c.rooms) <= 1 THEN 'Oda tipi yakın' END,
 CASE WHEN mg <= 0.15 THEN 'm² değeri yakın' WHEN mg <= 0.30 THEN 'm² aralığı benzer' END, CASE WHEN fs >= 0.75 THEN 'Kat seviyesi benzer' END, CASE WHEN ags >= 0.8 THEN 'Bina yaşı yakın' END, CASE WHEN hs = 1 THEN 'Isıtma tipi aynı' END], lambda x: x IS NOT NULL) AS w FROM sm),
 wr AS (SELECT qid, cid, CASE WHEN len(w) = 0 THEN 'Temel konut özellikleri benzer' ELSE array_to_string(w[1:4], '|') END AS reasons FROM w)"""


@query("r07_match_reasons", f"WITH {PART}, {MATCHED} SELECT qid, cid, reasons FROM wr")
def _(t):
    q, c = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"c.{n}"))
    return part_pairs(t).select(F.col("query").alias("qid"), F.col("found").alias("cid"), F.array_join(C.match_reasons(q, c), "|").alias("reasons"))


COMPARABLE = """bd AS (SELECT quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.9) AS p90 FROM pr),
 kn AS (SELECT *, greatest(5, least(99, round_even(100 - 90 * (d - p10) / greatest(p90 - p10, 1e-6), 0))) AS knn, least(99, round_even(100 * ws / tw + 6 * sd::INT + 8 * sn::INT + CASE WHEN abs(q.m2 - c.m2) <= 15 THEN 4 ELSE 0 END + CASE WHEN q.rooms = c.rooms THEN 4 ELSE 0 END, 0)) AS match FROM sc, bd),
 fd AS (SELECT *, round_even(match * 0.8::DOUBLE + knn * 0.2::DOUBLE, 0)::BIGINT AS score, abs(q.rooms - c.rooms) <= 2 AND mg <= 0.40 AND pg <= 0.60 AS strict, (c.district, c.nb, c.rooms, c.m2, round_even(c.price, 0))::VARCHAR AS sig
  FROM kn WHERE abs(q.rooms - c.rooms) <= 3 AND mg <= 0.55 AND pg <= 0.80),
 td AS (SELECT *, CASE WHEN score >= 55 AND strict THEN 1 WHEN score >= 55 THEN 2 ELSE 3 END AS tier FROM fd WHERE score >= 40),
 nt AS (SELECT qid, count(DISTINCT sig) FILTER (tier = 1) AS n_strict, count(*) FILTER (tier <= 2) AS n_good FROM td GROUP BY 1),
 ls1 AS (SELECT td.*, row_number() OVER (PARTITION BY qid, sig ORDER BY tier > 1, sn DESC, sd DESC, score DESC, pg, cid) AS copy FROM td JOIN nt USING (qid) WHERE CASE WHEN n_strict >= 3 THEN tier = 1 WHEN n_good > 0 THEN tier <= 2 ELSE true END),
 cm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier > 1, sn DESC, sd DESC, score DESC, pg, cid) AS place FROM ls1 WHERE copy = 1)"""


@query("r08_comparables", f"WITH {PART}, {COMPARABLE} SELECT qid AS query_id, cid AS listing_id, score, place FROM cm WHERE place <= 5")
def _(t):
    return C.comparables(with_knn_score(part_pairs(t))).withColumns({"score": F.col("score").cast("long"), "place": F.col("place").cast("long")})


def with_knn_score(p: DataFrame) -> DataFrame:
    return with_bounds(p).withColumn("knn_score", C.distance_score(F.col("distance"), F.col("p10"), F.col("p90")))


# -- confidence: customers stand for scored listings -----------------------------------------------------------------


def requests(t) -> DataFrame:
    c = t("customer").join(t("nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    price = F.abs(F.col("c_acctbal")) + 1
    return c.select(
        "c_custkey", F.lit("x").alias("city"), F.when(F.col("c_custkey") % 10 != 0, F.col("n_name")).alias("district"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("neighborhood"),
        F.when(F.col("c_custkey") % 3 != 0, "3+1").alias("rooms"), (F.col("c_custkey") % 50).cast("double").alias("m2_gross"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("title"),
        F.concat_ws(" ", "c_name", "c_mktsegment").substr(F.lit(1), (F.col("c_custkey") % 30).cast("int")).alias("description"), F.when(F.col("c_custkey") % 6 != 0, "t").alias("clean_text"),
        (F.col("c_custkey") % 20).cast("int").alias("images"), F.col("c_acctbal").alias("price"), price.alias("full"), (price * (1 + (F.col("c_custkey") % 9) / 30)).alias("no_text"),
        (price * (1 - (F.col("c_custkey") % 5) / 20)).alias("no_image"), price.alias("tabular"),
    )


REQ = """rq AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN n_name END AS district, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS nb, c_custkey % 3 <> 0 AS hr, c_custkey % 50 AS m2, c_custkey % 4 <> 0 AS ht,
  length(trim((c_name || ' ' || c_mktsegment)[1:(c_custkey % 30)::INT])) AS dl, c_custkey % 6 <> 0 AS hc, c_custkey % 20 AS im, c_acctbal AS price, (c_custkey % 9) / 30 AS nt, (c_custkey % 5) / 20 AS ni FROM customer JOIN nation ON n_nationkey = c_nationkey),
 pf AS (SELECT quantile_cont(price, 0.05) AS p05, quantile_cont(price, 0.95) AS p95 FROM rq),
 dc AS (SELECT district, count(*) AS nd FROM rq WHERE district IS NOT NULL GROUP BY 1), nc AS (SELECT nb, count(*) AS nn FROM rq WHERE nb IS NOT NULL GROUP BY 1),
 rf AS (SELECT (SELECT greatest(quantile_cont(nd, 0.95), 1) FROM dc) AS rd, (SELECT greatest(quantile_cont(nn, 0.95), 1) FROM nc) AS rn),
 pt AS (SELECT rq.*, p05, p95, CASE WHEN district IS NULL THEN 10 ELSE 15 + 85 * sqrt(least(coalesce(nd, 0) / rd, 1)) END AS ds, CASE WHEN rq.nb IS NULL THEN 10 ELSE 15 + 85 * sqrt(least(coalesce(nn, 0) / rn, 1)) END AS ns FROM rq CROSS JOIN pf CROSS JOIN rf LEFT JOIN dc USING (district) LEFT JOIN nc ON nc.nb = rq.nb),
 cs AS (SELECT c_custkey, (10 + CASE WHEN district IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN nb IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN hr THEN 14 ELSE 0 END + CASE WHEN m2 > 0 THEN 16 ELSE 0 END + CASE WHEN ht THEN 12 ELSE 0 END + CASE WHEN dl >= 20 THEN 14 ELSE 0 END + CASE WHEN hc THEN 6 ELSE 0 END + CASE WHEN im > 0 THEN 4 ELSE 0 END)::BIGINT AS completeness,
  (CASE WHEN im <= 0 THEN 20 WHEN im <= 3 THEN 35 + im * 10 WHEN im <= 8 THEN 70 + (im - 4) * 4 WHEN im <= 16 THEN floor(least(98, 88 + (im - 9) * 1.5)) ELSE 98 END)::BIGINT AS visual,
  (CASE WHEN district IS NULL AND nb IS NULL THEN 10 WHEN district IS NOT NULL AND nb IS NOT NULL THEN round_even(0.4::DOUBLE * ds + 0.6::DOUBLE * ns, 0) ELSE round_even(greatest(ds, ns), 0) END)::BIGINT AS location,
  (CASE WHEN price BETWEEN p05 AND p95 THEN 100 ELSE greatest(20, round_even(100 - 65 * least(greatest(p05 - price, price - p95) / greatest(p95 - p05, 1), 1.25::DOUBLE), 0)) END)::BIGINT AS price_range,
  greatest(20, least(100, round_even(100 - 180 * (0.4::DOUBLE * nt + 0.4::DOUBLE * ni), 0)))::BIGINT AS stability FROM pt)"""


@query("r10_completeness", f"WITH {REQ} SELECT c_custkey, completeness FROM cs")
def _(t):
    return requests(t).select("c_custkey", Q.completeness().cast("long").alias("completeness"))


@query("r11_visual_score", f"WITH {REQ} SELECT c_custkey, visual FROM cs")
def _(t):
    return requests(t).select("c_custkey", Q.visual_score(F.col("images")).cast("long").alias("visual"))


@query("r12_location_density", f"WITH {REQ} SELECT c_custkey, location FROM cs")
def _(t):
    r = requests(t)
    return Q.score_confidence(r, r).select("c_custkey", F.col("location").cast("long").alias("location"))


@query("r13_price_range", f"WITH {REQ} SELECT c_custkey, price_range FROM cs")
def _(t):
    r = requests(t)
    return Q.score_confidence(r, r).select("c_custkey", F.col("price_range").cast("long").alias("price_range"))


@query("r14_stability", f"WITH {REQ} SELECT c_custkey, stability FROM cs")
def _(t):
    score = Q.stability_score(*[F.col(c) for c in ("full", "no_text", "no_image", "tabular")])
    return requests(t).select("c_custkey", score.cast("long").alias("stability"))


@query("r15_confidence", f"WITH {REQ} SELECT c_custkey, s AS confidence, CASE WHEN s >= 80 THEN 'Yüksek' WHEN s >= 60 THEN 'Orta' ELSE 'Düşük' END AS label FROM (SELECT *, round_even(completeness * 0.25::DOUBLE + visual * 0.2::DOUBLE + location * 0.2::DOUBLE + price_range * 0.2::DOUBLE + stability * 0.15::DOUBLE, 0)::BIGINT AS s FROM cs)")
def _(t):
    r = requests(t)
    return Q.score_confidence(r, r).select("c_custkey", F.col("confidence").cast("long").alias("confidence"), "label")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TOLD = f"""lb AS (SELECT *, CASE WHEN s >= 80 THEN 'Yüksek' WHEN s >= 60 THEN 'Orta' ELSE 'Düşük' END AS label FROM (SELECT *, round_even(completeness * 0.25::DOUBLE + visual * 0.2::DOUBLE + location * 0.2::DOUBLE + price_range * 0.2::DOUBLE + stability * 0.15::DOUBLE, 0)::BIGINT AS s FROM cs)),
 x AS (SELECT c_custkey, label, unnest([completeness, visual, location, price_range, stability]) AS s, unnest([1, 2, 3, 4, 5]) AS i, unnest({sql_list(v[0] for v in Q.REASONS.values())}) AS pos, unnest({sql_list(v[1] for v in Q.REASONS.values())}) AS neu, unnest({sql_list(v[2] for v in Q.REASONS.values())}) AS neg FROM lb),
 y AS (SELECT *, CASE WHEN s >= 80 THEN pos WHEN s >= 68 THEN neu END AS h, CASE WHEN s <= 60 THEN neg WHEN s <= 72 THEN neu END AS l, CASE WHEN s >= 78 THEN pos WHEN s >= 68 THEN neu END AS st, CASE WHEN s <= 68 THEN neg END AS li FROM x),
 z AS (SELECT c_custkey, label, coalesce(list(h ORDER BY s DESC, i) FILTER (h IS NOT NULL), []) AS h, coalesce(list(l ORDER BY s, i) FILTER (l IS NOT NULL), []) AS l, coalesce(list(st ORDER BY s DESC, i) FILTER (st IS NOT NULL), []) AS st, coalesce(list(li ORDER BY s, i) FILTER (li IS NOT NULL), []) AS li FROM y GROUP BY 1, 2),
 ch AS (SELECT c_custkey, label, CASE label WHEN 'Yüksek' THEN h WHEN 'Düşük' THEN l ELSE list_concat(list_concat(st[1:1], li[1:2]), st[2:]) END AS ch FROM z)"""


@query("r16_confidence_reasons", f"WITH {REQ}, {TOLD} SELECT c_custkey, label, CASE WHEN len(ch) = 0 THEN '{Q.DEFAULT_REASON}' ELSE array_to_string(ch[1:3], '|') END AS reasons FROM ch")
def _(t):
    r = requests(t)
    return Q.score_confidence(r, r).select("c_custkey", "label", F.array_join("reasons", "|").alias("reasons"))


@query("a33_confidence_profile", f"WITH {REQ} SELECT round(p05, 4) AS p05, round(p95, 4) AS p95, round(rd, 4) AS ref_d, round(rn, 4) AS ref_n, (SELECT count(*) FROM rq) AS n_rows FROM pf, rf")
def _(t):
    profile = Q.confidence_profile(requests(t), "district", "neighborhood", "price")
    return profile.select(*[rounded(F.col(c)).alias(c) for c in ("p05", "p95", "ref_d", "ref_n")], "n_rows")


