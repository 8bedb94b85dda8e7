"""Queries of the features, models, profiles and reports."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from listinglens.functions import parse as P
from listinglens.functions import text as X
from listinglens.functions.register import register
from listinglens.operators import comparables as C
from listinglens.operators import confidence as Q
from listinglens.operators import features as E
from listinglens.operators import models as M
from listinglens.operators import profile as O
from listinglens.operators import relate as R
from listinglens.operators import report as T
from listinglens.operators import search as H
from listinglens.operators import stats as S
from listinglens.operators import vectors as V
from listinglens.plans.relational import WORDS_SQL
from listinglens.plans.retrieval import COMPARABLE, MATCHED, PART, part_listing, part_pairs, with_knn_score
from listinglens.session import fresh_path, rounded, stage_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table reader and the session."""

    def add(build):
        def run(spark, sf_dir):
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


# -- tabular features ------------------------------------------------------------------------------------------------


@query("p17_clean_tabular", "SELECT p_partkey, p_brand, p_type, CASE WHEN p_size + p_partkey % 3 <= 12 THEN (p_size + p_partkey % 3)::DOUBLE END AS rooms, p_retailprice FROM part")
def _(t, spark):
    p = t("part").select("p_partkey", F.concat(F.lit("  "), "p_brand").alias("p_brand"), "p_type", F.concat(F.col("p_size").cast("string"), F.lit("+"), (F.col("p_partkey") % 3).cast("string")).alias("rooms"), F.col("p_retailprice").cast("string").alias("p_retailprice"))
    return E.clean_tabular(p, ["p_brand", "p_type"], ["p_retailprice"], ["rooms"])


@query("p33_normalize_payload", "SELECT doc_id, lang, NULL::VARCHAR AS title, CASE WHEN trim(src) = '' THEN 'missing: title|unexpected: n_chars|blank: src' ELSE 'missing: title|unexpected: n_chars' END AS warnings FROM (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE source END AS src FROM documents)")
def _(t, spark):
    d = t("documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("source")).alias("src"), "n_chars")
    out = E.normalize_payload(d, {"doc_id": "long", "lang": "string", "title": "string", "src": "string"})
    return out.select("doc_id", "lang", "title", F.array_join("warnings", "|").alias("warnings"))


HOLES = "h AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS size, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand FROM part)"


def holes(t):
    return t("part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("size"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("brand"))


@query("m01_median_impute", f"WITH {HOLES} SELECT p_partkey, coalesce(size, (SELECT median(size) FROM h)) AS size FROM h")
def _(t, spark):
    return E.median_fill(holes(t), holes(t), ["size"]).select("p_partkey", "size")


@query("m02_mode_impute", f"WITH {HOLES} SELECT p_partkey, coalesce(brand, (SELECT brand FROM h WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 1)) AS brand FROM h")
def _(t, spark):
    return E.mode_fill(holes(t), holes(t), ["brand"]).select("p_partkey", "brand")


@query("m03_one_hot", f"WITH {HOLES}, l AS (SELECT DISTINCT brand AS b FROM h WHERE brand <> 'Brand#7') SELECT p_partkey, coalesce((SELECT string_agg((b = h.brand)::INT::VARCHAR, '' ORDER BY b) FROM l WHERE h.brand IS NOT NULL), (SELECT repeat('0', count(*)::INT) FROM l)) AS hot FROM h")
def _(t, spark):
    hot = E.one_hot(holes(t).where("brand <> 'Brand#7'"), holes(t), "brand")
    return hot.select("p_partkey", F.array_join(F.transform(vector_to_array("brand_hot"), lambda x: x.cast("int").cast("string")), "").alias("hot"))


@query("m04_standard_scale", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS price FROM part")
def _(t, spark):
    p = t("part").select("p_partkey", F.col("p_retailprice").alias("price"))
    return E.standard_scale(p, p, ["price"]).select("p_partkey", rounded(F.col("price"), 6).alias("price"))


@query("m05_tabular_preprocessor", f"""WITH {HOLES}, f AS (SELECT p_partkey, coalesce(size, (SELECT median(size) FROM h)) AS size, coalesce(brand, (SELECT brand FROM h WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 1)) AS brand FROM h), l AS (SELECT brand AS b, row_number() OVER (ORDER BY brand) AS pos FROM (SELECT DISTINCT brand FROM f))
 SELECT p_partkey, 0 AS pos, round((size - (SELECT avg(size) FROM f)) / (SELECT stddev_pop(size) FROM f), 6) AS value FROM f UNION ALL SELECT p_partkey, pos, (b = brand)::INT::DOUBLE FROM f, l""")
def _(t, spark):
    """A row for each cell of the vector."""
    h = holes(t)
    filled = E.mode_fill(h, E.median_fill(h, h, ["size"]), ["brand"])
    ready = E.one_hot(filled, E.standard_scale(filled, filled, ["size"]), "brand")
    cells = E.fuse(ready.withColumn("size", rounded(F.col("size"), 6)), ["size", "brand_hot"]).select("p_partkey", vector_to_array("features").alias("cells"))
    return cells.select("p_partkey", F.posexplode("cells").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query("r01_weight_features", "SELECT p_partkey, round(p_size * 2.6::DOUBLE, 6) AS a, round(p_retailprice * 2.8::DOUBLE, 6) AS b FROM part")
def _(t, spark):
    v = E.weight_features(F.array(F.col("p_size").cast("double"), "p_retailprice"), [2.6, 2.8])
    return t("part").select("p_partkey", v.alias("v")).select("p_partkey", rounded(F.get("v", 0), 6).alias("a"), rounded(F.get("v", 1), 6).alias("b"))


# -- text features ---------------------------------------------------------------------------------------------------

GRAMS = f"""w AS ({WORDS_SQL}), g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM w),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), v AS (SELECT term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, term LIMIT 2000),
 r AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)),
 ti AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM r)"""


#: Terms of a text block.
TERMS = 5000


def words(t):
    return t("documents").select("doc_id", X.tokens(F.col("text")).alias("words"))


@query("f10_tfidf", f"WITH {GRAMS} SELECT doc_id, term, round(weight, 6) AS weight FROM ti")
def _(t, spark):
    return E.tfidf(words(t), "doc_id", "words").select("doc_id", "term", rounded(F.col("weight"), 6).alias("weight"))


def text_vectors(t):
    """The documents' sparse TF-IDF rows and the vocabulary; words are made once, and so are the rows."""
    w = stage_table(words(t), "documents-words")
    vectors, vocabulary = E.tfidf_vectors(w, w, "words", TERMS)
    return stage_table(vectors.select("doc_id", "text_vector"), "text-vectors"), vocabulary


@query("f11_truncated_svd")
def _(t, spark):
    vectors, _ = text_vectors(t)
    v = E.truncated_svd(vectors, "text_vector", 16)
    return E.project(vectors, "text_vector", v, "svd").select("doc_id", vector_to_array("svd").alias("svd"))


@query("f12_component_tokens")
def _(t, spark):
    vectors, vocabulary = text_vectors(t)
    return E.component_tokens(spark, E.truncated_svd(vectors, "text_vector", 8), vocabulary)


@query("f13_token_display", "SELECT DISTINCT p_partkey, token, CASE WHEN p_partkey % 2 = 0 THEN upper(token) ELSE token END AS raw FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part)")
def _(t, spark):
    p = t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return E.token_display(p, "p_partkey", "name")


LOAD = "ld AS (SELECT term, (length(term) - 6)::DOUBLE AS loading FROM v)"


@query("f14_token_contributions", f"WITH {GRAMS}, {LOAD}, s AS (SELECT doc_id, term, round(weight * loading, 9) AS score FROM ti JOIN ld USING (term)), k AS (SELECT *, CASE WHEN score >= 0 THEN 'positive' ELSE 'negative' END AS sign FROM s) SELECT doc_id, sign, count(*) AS n, round(sum(score), 5) AS total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sign ORDER BY abs(score) DESC, term) AS r FROM k) WHERE r <= 3 GROUP BY 1, 2")
def _(t, spark):
    weights = E.tfidf(words(t), "doc_id", "words")
    loadings = weights.select("term").distinct().withColumn("loading", (F.length("term") - 6).cast("double"))
    top = E.token_contributions(weights, loadings, "doc_id").withColumn("score", F.round("score", 9))
    return top.groupBy("doc_id", "sign").agg(F.count("*").alias("n"), rounded(F.sum("score"), 5).alias("total"))


@query("t03_top_features", f"WITH {GRAMS} SELECT term AS feature, round(max(weight), 6) AS importance FROM ti WHERE starts_with(term, 'th') GROUP BY 1 ORDER BY importance DESC, feature LIMIT 20")
def _(t, spark):
    best = E.tfidf(words(t), "doc_id", "words").groupBy(F.col("term").alias("feature")).agg(rounded(F.max("weight"), 6).alias("importance"))
    return M.top_features(best, 20, "th")


@query("t04_signed_top", "WITH s AS (SELECT p_partkey, p_size - 25.5::DOUBLE AS v FROM part) (SELECT *, 'largest' AS side FROM s ORDER BY v DESC, p_partkey LIMIT 5) UNION ALL (SELECT *, 'smallest' FROM s ORDER BY v, p_partkey LIMIT 5) UNION ALL (SELECT *, 'size' FROM s ORDER BY abs(v) DESC, p_partkey LIMIT 5)")
def _(t, spark):
    return M.signed_top(t("part").select("p_partkey", (F.col("p_size") - 25.5).alias("v")), "v", "p_partkey", 5)


@query("t06_locale_sort", "SELECT c_mktsegment AS value, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1, 2")
def _(t, spark):
    rows = S.option_counts(t("customer"), "c_mktsegment")
    padded = F.regexp_replace("label", r"(\d+)", "0000000000$1")
    return rows.orderBy(F.col("value").isNull(), F.collate(padded, "tr_CI"))


@query("a35_feature_space", "SELECT unnest(['rows', 'blank', 'blank_share', 'terms']) AS measure, unnest([count(*)::DOUBLE, count(*) FILTER (n_chars < 100)::DOUBLE, round(100.0::DOUBLE * count(*) FILTER (n_chars < 100) / count(*), 4), 2000.0::DOUBLE]) AS value FROM documents")
def _(t, spark):
    d = t("documents").select(F.when(F.col("n_chars") < 100, "").otherwise("x").alias("clean"))
    return E.feature_space_summary(d, "clean", {"terms": 2000})


@query("a30_recommendations", "SELECT 'link' AS signal, 'drop links' AS message FROM documents WHERE doc_id < 0 UNION ALL SELECT 'text', 'keep texts' FROM (SELECT count(*) FROM documents)")
def _(t, spark):
    summary = S.signal_summary(t("documents"), {"link": F.col("text").rlike("https?://"), "text": F.col("n_chars") > 0})
    return O.recommend(summary, {"link": (99.0, "drop links"), "text": (50.0, "keep texts")})


# -- profiles --------------------------------------------------------------------------------------------------------


def profiles(t):
    rows = None
    for name in ("orders", "part", "documents", "region"):
        one = O.profile_table(t(name), name)
        rows = one if rows is None else rows.unionByName(one)
    return O.classify_table(rows)


@query("a19_detect_roles")
def _(t, spark):
    return O.detect_roles(t("documents"))


@query("a20_classify_tables")
def _(t, spark):
    return O.choose_primary(profiles(t))


@query("a22_profile_tables")
def _(t, spark):
    return profiles(t)


# -- models ----------------------------------------------------------------------------------------------------------


def priced(t):
    """lineitem rows with a feature vector of three blocks: tabular, text-like, vector-like."""
    li = t("lineitem")
    cells = F.array("l_quantity", "l_tax", "l_discount", (F.col("l_linenumber")).cast("double"), (F.col("l_returnflag") == "R").cast("double"), (F.col("l_partkey") % 100).cast("double"))
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = li.select(key.alias("id"), F.col("l_extendedprice").alias("y"), array_to_vector(cells.cast("array<double>")).alias("features"), "l_quantity", "l_tax", "l_discount")
    return out.withColumn("part", R.split_label(F.col("id")))


BLOCKS = {"full": [], "no_text": [range(3, 4)], "no_image": [range(4, 6)], "tabular_only": [range(3, 6)]}
NAMES = ["quantity", "tax", "discount", "line", "returned", "part"]


def parts(t):
    """The training, validation and test rows, assembled once for all fits and metrics of a query."""
    rows = stage_table(priced(t), "priced")
    return [rows.where(F.col("part") == p) for p in ("train", "validation", "test")]


def ridge(split):
    train, validation, _ = split
    return M.candidates("y")["ridge"].fit(train.unionByName(validation))


@query("m06_vector_reducer")
def _(t, spark):
    e = t("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return E.vector_reducer("v", 16, "reduced").fit(e).transform(e).select("vec_id", vector_to_array("reduced").alias("reduced"))


def listed(t):
    """Parts as listings (id, y, part, table, words) and their images (id, vec_id, embedding): a description from documents, four vectors each."""
    p = t("part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), F.array(F.col("p_size").cast("double"), F.length("p_name").cast("double")).alias("table"))
    d = t("documents").select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("words"))
    images = t("embeddings").select(F.expr("vec_id div 4").alias("id"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = p.join(d, "id").join(images.select("id").distinct(), "id", "left_semi").withColumn("part", R.split_label(F.col("id")))
    return stage_table(rows, "listed"), images


TEXT_SIZES, IMAGE_SIZES, CAPS = (8, 32), (4, 16), (1, 4)


def blocks(t, caps=CAPS):
    """The cache, and for each cap the listings with the text and image blocks at their greatest sizes."""
    rows, images = listed(t)
    cache, train = H.RepresentationCache(), "part = 'train'"
    text = H.text_block(cache, rows, "id", "words", train, max(TEXT_SIZES), TERMS)
    wide = {}
    for cap in caps:
        image = H.image_block(cache, rows, images, "id", "vec_id", "embedding", train, cap, max(IMAGE_SIZES))
        wide[cap] = H.fused(cache, rows.drop("words"), "id", text, image, cap)
    return cache, wide


def largest(t):
    """The listings with all cells of all blocks as features."""
    wide = blocks(t, [4])[1][4]
    return stage_table(H.trial_features(wide, H.Trial(max(TEXT_SIZES), max(IMAGE_SIZES), 4, "")).select("id", "y", "part", "features"), "largest")


@query("m07_fuse_blocks")
def _(t, spark):
    """Table, text and image cells of each listing as one vector."""
    return largest(t).select("id", "part", vector_to_array("features").alias("features"))


@query("m08_candidates")
def _(t, spark):
    """The candidates on the fused blocks, each for the price and for its logarithm; errors are of the price."""
    rows = largest(t)
    models = M.candidates("y")
    models |= {f"{n}_log": H.LogTarget(m, "y") for n, m in M.candidates("y").items()}
    trials, _ = M.grid_search(spark, rows.where("part = 'train'"), rows.where("part = 'validation'"), "y", models)
    return M.leaderboard(trials)


@query("m10_grid_search")
def _(t, spark):
    train, validation, _ = parts(t)
    grid = {f"ridge_{r}": LinearRegression(labelCol="y", regParam=r) for r in (0.0, 1.0, 100.0)}
    grid["broken"] = LinearRegression(labelCol="absent")
    return M.leaderboard(M.grid_search(spark, train, validation, "y", grid)[0])


@query("m11_multimodal_search")
def _(t, spark):
    """Text sizes x image sizes x caps x models: one text and one image fit for each cap serve all trials; the best is fitted again and tested."""
    _, wide = blocks(t)
    models = {f"ridge_{r}": LinearRegression(labelCol="y", regParam=r) for r in (1.0, 100.0)}
    trials = stage_table(H.search(spark, wide, [H.Trial(a, b, c, m) for a in TEXT_SIZES for b in IMAGE_SIZES for c in CAPS for m in models], models, "y"), "trials")
    best = H.best_of(trials)
    rows = H.trial_features(wide[best.cap], best)
    _, tested = M.refit_and_test(models[best.model], *[rows.where(F.col("part") == p) for p in ("train", "validation", "test")], "y")
    told = {"model": F.lit(best.model), "text": F.lit(best.text), "image": F.lit(best.image), "cap": F.lit(best.cap), "stage": F.lit("test")}
    return trials.drop("error").withColumn("stage", F.lit("validation")).unionByName(tested.withColumns(told))


@query("m12_refit_and_test")
def _(t, spark):
    rows = largest(t)
    train, validation, test = (rows.where(F.col("part") == p) for p in ("train", "validation", "test"))
    grid = {k: v for k, v in M.candidates("y").items() if k in ("ridge", "elastic_net")}
    trials, _ = M.grid_search(spark, train, validation, "y", grid)
    return M.refit_and_test(grid[M.best_trial(trials)], train, validation, test, "y")[1]


@query("m13_matched_baseline")
def _(t, spark):
    train, validation, test = parts(t)
    both = train.unionByName(validation)
    whole = M.matched_baseline(lambda b: M.candidates("y", b)["ridge"], both, test, "y", "features").withColumn("model", F.lit("all"))
    tab = [range(3, 6)]
    alone = M.matched_baseline(lambda b: M.candidates("y", b)["ridge"], M.masked(both, tab), M.masked(test, tab), "y", "features").withColumn("model", F.lit("tabular"))
    return S.compare_models(whole.unionByName(alone), "tabular")


@query("m15_ablation")
def _(t, spark):
    split = parts(t)
    return M.ablate(ridge(split), split[2], "y", BLOCKS)


@query("m16_ablation_predictions")
def _(t, spark):
    split = parts(t)
    return M.ablation_predictions(ridge(split), split[2], "id", BLOCKS)


@query("m17_importance")
def _(t, spark):
    split = parts(t)
    model = ridge(split)
    native = M.native_importance(spark, model, NAMES).withColumns({"kind": F.lit("native"), "deviation": F.lit(None).cast("double")})
    return native.unionByName(M.permutation_importance(model, split[2], "y", "id", NAMES).withColumn("kind", F.lit("permutation")))


@query("m18_attribution", """WITH a AS (SELECT avg(l_quantity) AS mq, avg(l_tax) AS mt, avg(l_discount) AS md FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(1900 * (l_quantity - mq), 5) AS size, round(-300 * (l_tax - mt) + 800 * (l_discount - md), 5) AS terms FROM lineitem, a""")
def _(t, spark):
    li = t("lineitem")
    means = li.agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_tax", "l_discount")]).first().asDict()
    told = M.attribute_linear(li, means, {"l_quantity": 1900.0, "l_tax": -300.0, "l_discount": 800.0}, {"size": ["l_quantity"], "terms": ["l_tax", "l_discount"]})
    return told.select("l_orderkey", "l_linenumber", "l_partkey", *[rounded(F.get("factors", i)["score"], 5).alias(n) for i, n in enumerate(("size", "terms"))])


def factors(t):
    p = t("part").withColumn("factors", F.array(*[F.struct(F.lit(n).alias("group"), v.cast("double").alias("score")) for n, v in (("a", F.col("p_size") - 25), ("b", F.col("p_partkey") % 7 - 3), ("c", F.col("p_size") % 5 - 2), ("d", F.lit(0.0)))]))
    return M.top_factors(p, "p_partkey", 2)


FACTORS = "f AS (SELECT p_partkey, unnest(['a', 'b', 'c']) AS g, unnest([p_size - 25, p_partkey % 7 - 3, p_size % 5 - 2])::DOUBLE AS s FROM part), k AS (SELECT p_partkey, g, s, CASE WHEN s > 0 THEN 'positive' ELSE 'negative' END AS sign FROM f WHERE s <> 0), t AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, sign ORDER BY abs(s) DESC, g) AS rank FROM k)"


@query("t05_top_factors", f"WITH {FACTORS} SELECT p_partkey, g AS \"group\", s AS score, sign, rank FROM t WHERE rank <= 2")
def _(t, spark):
    return factors(t).withColumn("rank", F.col("rank").cast("long"))


@query("m19_factor_messages", f"WITH {FACTORS} SELECT p_partkey, g || CASE WHEN s > 0 THEN ' raises the price' ELSE ' lowers the price' END AS message FROM t WHERE rank <= 2")
def _(t, spark):
    return factors(t).select("p_partkey", M.factor_message(F.col("group"), F.col("score")).alias("message"))


@query("m21_early_stopping")
def _(t, spark):
    """Boosted trees for the logarithm of the price, as many as bring a gain on the validation rows."""
    train, validation, test = parts(t)
    model, rounds = H.boosted_with_patience(GBTRegressor(featuresCol="features", maxDepth=3, stepSize=0.3, seed=42), train, validation, "y", patience=5, most=40, log=True)
    return S.metrics(model.transform(test), "y", "prediction").withColumn("trees", F.lit(rounds))


@query("m23_bundle")
def _(t, spark):
    path, split = fresh_path(spark, "bundle"), parts(t)
    M.save_bundle(ridge(split), {"model": "ridge", "features": ",".join(NAMES), "target": "y", "mae": 0.0}, path, spark)
    model, info = M.load_bundle(spark, path)
    return S.metrics(model.transform(split[2]), "y", "prediction").crossJoin(F.broadcast(info.select("model", "features", "target")))  # one row


@query("m24_batch_score")
def _(t, spark):
    split = parts(t)
    return M.score(split[2], ridge(split), "id")


# -- comparables and the full report ---------------------------------------------------------------------------------


@query("r04_relative_difference", "SELECT p_partkey, round(abs(p_size - p_retailprice) / greatest(p_size, p_retailprice, 1), 6) AS gap FROM part")
def _(t, spark):
    return t("part").select("p_partkey", rounded(C.rel_diff(F.col("p_size").cast("double"), F.col("p_retailprice")), 6).alias("gap"))


def shaped(t):
    p = part_pairs(t)
    details = p.select(F.col("query").alias("query_id"), F.col("c.listing_id").alias("listing_id"), "q", "c")
    q, c = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"c.{n}"))
    return C.comparables(with_knn_score(p)).join(details, ["query_id", "listing_id"]).select(
        "query_id", F.col("place").cast("long").alias("place"), "listing_id", F.col("score").cast("long").alias("score"),
        *[F.col(f"c.{n}").alias(n) for n in ("district", "neighborhood", "rooms", "m2_gross", "price")], F.array_join(C.match_reasons(q, c), "|").alias("reasons"),
    )


@query("r09_comparable_rows", f"WITH {PART}, {COMPARABLE}, {MATCHED} SELECT qid AS query_id, place, cid AS listing_id, score, c.district AS district, c.nb AS neighborhood, c.rooms AS rooms, c.m2 AS m2_gross, c.price AS price, reasons FROM cm JOIN wr USING (qid, cid) WHERE place <= 5")
def _(t, spark):
    return shaped(t)


REQUEST = ("m2_gross", "building_age", "floor", "name_length", "name_words", "images")
REQUEST_BLOCKS = {"full": [], "no_text": [range(3, 5)], "no_image": [range(5, 6)], "tabular": [range(3, 6)]}


@query("r17_score_report")
def _(t, spark):
    """Parts as listings: a ridge model of all of them, and the report of each stated query."""
    name = F.col("p_name")
    extra = t("part").select("p_partkey", name.alias("title"), F.length(name).cast("double").alias("name_length"), F.size(F.split(name, " ")).cast("double").alias("name_words"), (F.col("p_partkey") % 20).cast("double").alias("images"))
    rows = part_listing(t).select(F.col("p_partkey").alias("query_id"), "l.*").join(extra.withColumnRenamed("p_partkey", "query_id"), "query_id")
    rows = E.fuse(rows, REQUEST).withColumn("part", R.split_label(F.col("query_id"))).withColumns({"city": F.lit("x"), "description": F.col("title"), "clean_text": F.col("title")})
    rows = stage_table(rows, "requests")
    train, test = rows.where("part <> 'test'"), rows.where("part = 'test'")
    model = M.candidates("price")["ridge"].fit(train)
    error = S.metrics(model.transform(test), "price", "prediction").first()["mae"] or 0.0
    asked = rows.where("query_id % 100 = 0")
    told = asked.drop("price").join(M.ablation_predictions(model, asked, "query_id", REQUEST_BLOCKS), "query_id").withColumn("price", F.col("full"))
    means = train.agg(*[F.avg(c).alias(c) for c in REQUEST]).first().asDict()
    coefficients = dict(zip(REQUEST, map(float, model.coefficients), strict=True))
    factors = M.attribute_linear(asked, means, coefficients, {"table": REQUEST[:3], "text": REQUEST[3:5], "images": REQUEST[5:]})
    return T.score_report("query_id", Q.score_confidence(told, rows), error, M.merged_factors(M.top_factors(factors, "query_id"), "query_id"), shaped(t))


def letter_shares(texts):
    """Stands for an encoder: how often each vowel is in a text."""
    return [[float(x.count(v)) for v in "aeiou"] for x in texts]


@query("u05_encode_batches", "SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS pos, unnest([length(text) - length(replace(text, v, '')) for v in ['a', 'e', 'i', 'o', 'u']])::DOUBLE AS value FROM documents WHERE text IS NOT NULL")
def _(t, spark):
    coded = t("documents").select("doc_id", V.encode(F.col("text"), lambda: letter_shares).alias("v"))
    return coded.select("doc_id", F.posexplode("v").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query("u02_transformer", "SELECT p_partkey, CASE WHEN p_size + p_partkey % 3 <= 12 THEN (p_size + p_partkey % 3)::DOUBLE END AS rooms, p_retailprice AS price FROM part")
def _(t, spark):
    """A bundle that starts with its own cleaning step, saved, loaded, and applied to raw rows."""
    raw = t("part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("+"), (F.col("p_partkey") % 3).cast("string")).alias("rooms"), F.col("p_retailprice").cast("string").alias("price"))
    path = fresh_path(spark, "bundle")
    steps = Pipeline(stages=[E.TabularCleaner(numeric=["price"], rooms=["rooms"]), Imputer(inputCol="rooms", outputCol="rooms_filled"), VectorAssembler(inputCols=["rooms_filled"], outputCol="features"), LinearRegression(labelCol="price")])
    M.save_bundle(steps.fit(raw), {"model": "ridge", "features": "rooms", "target": "price", "mae": 0.0}, path, spark)
    model, _ = M.load_bundle(spark, path)
    return model.transform(raw).where("prediction is not null").select("p_partkey", "rooms", "price")


@query("u04_explode_paths", "SELECT event_id, unnest(CASE event_id % 4 WHEN 1 THEN [event_type, 'b'] WHEN 3 THEN ['[' || event_type] ELSE [event_type] END) AS path FROM events")
def _(t, spark):
    kind, written = F.col("event_id") % 4, F.col("event_type")
    listed = F.when(kind == 0, F.concat(F.lit('["'), written, F.lit('", "none"]'))).when(kind == 1, F.concat(F.lit("['"), written, F.lit("', 'b']")))
    paths = P.parse_path_list(listed.when(kind == 2, written).otherwise(F.concat(F.lit("["), written)))
    return t("events").select("event_id", F.explode(paths).alias("path"))


@query("u06_sql_functions", "SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS link FROM pages")
def _(t, spark):
    register(spark)
    return t("pages").selectExpr("page_id", "normalize_url(url) AS link")
