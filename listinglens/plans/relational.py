"""Queries of the validation, join, aggregate, window, sort and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.functions import parse as P
from listinglens.functions import text as X
from listinglens.operators import baseline as B
from listinglens.operators import relate as R
from listinglens.operators import stats as S
from listinglens.operators import validate as V
from listinglens.plans.parsing import COLLAPSED, EDGES, FOLDED, LABELS
from listinglens.session import rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of one or more tables; it gets a reader of the run's folder."""

    def add(build):
        def run(spark, sf_dir):
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


# -- validation: orders stand for listings, lineitem for their images ------------------------------------------------


def listings(t) -> DataFrame:
    o = t("orders").join(t("customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    price = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice") * 2)
    return o.select(
        F.col("o_orderkey").alias("listing_id"),
        price.alias("price"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("c_mktsegment")).alias("city"),
        F.col("o_orderpriority").alias("district"),
        F.when(F.col("o_orderkey") % 11 != 0, "3+1").alias("rooms"),
        (F.col("o_orderkey") % 1100).cast("double").alias("m2_gross"),
        F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_orderkey") % 90).cast("double")).alias("m2_net"),
        F.concat_ws(" ", "c_name", F.when(F.col("o_orderkey") % 3 == 0, F.col("c_mktsegment"))).alias("description"),
    )


def images(t) -> DataFrame:
    return t("lineitem").select(F.col("l_orderkey").alias("listing_id"), "l_linenumber", (F.col("l_returnflag") != "R").alias("is_valid"))


LISTINGS = """
 l AS (SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice * 2 END AS price, CASE WHEN o_orderkey % 13 <> 0 THEN c_mktsegment END AS city,
  o_orderpriority AS district, CASE WHEN o_orderkey % 11 <> 0 THEN '3+1' END AS rooms, (o_orderkey % 1100)::DOUBLE AS m2_gross, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 90)::DOUBLE END AS m2_net,
  concat_ws(' ', c_name, CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment END) AS description FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
 i AS (SELECT l_orderkey AS listing_id, count(*) FILTER (l_returnflag <> 'R') AS vi, count(*) AS ai FROM lineitem GROUP BY 1),
 j AS (SELECT l.*, coalesce(vi, 0) AS vi, coalesce(ai, 0) AS ai, CASE WHEN m2_net >= 10 THEN m2_net ELSE m2_gross END AS a FROM l LEFT JOIN i USING (listing_id)),
 f AS (SELECT *, coalesce(price > 0, false) AS hp, city IS NOT NULL AS hl, rooms IS NOT NULL AS hr, coalesce(a > 0, false) AS hm, length(trim(description)) >= 20 AS hd, vi >= 3 AS hi,
  CASE WHEN price <> 0 AND a > 0 THEN price / a END AS per FROM j),
 g AS (SELECT *, coalesce(price < 1000 OR price > 500000, false) AS op, coalesce(a < 10 OR a > 1000, false) AS om, coalesce(per < 100 OR per > 100000, false) AS o2 FROM f),
 v AS (SELECT *, hp AND hl AND hr AND hm AND NOT op AND NOT om AND NOT o2 AS ml, hp AND hl AND hi AS dl,
  nullif(concat_ws('|', CASE WHEN NOT hp THEN 'missing_price' END, CASE WHEN NOT hl THEN 'missing_location' END, CASE WHEN NOT hr THEN 'missing_rooms' END, CASE WHEN NOT hm THEN 'missing_m2' END,
   CASE WHEN NOT hd THEN 'description_too_short' END, CASE WHEN NOT hi THEN 'not_enough_valid_images' END, CASE WHEN op THEN 'outlier_price' END, CASE WHEN om THEN 'outlier_m2' END, CASE WHEN o2 THEN 'outlier_price_per_m2' END), '') AS reason FROM g)"""


@query("v01_target_not_null", f"WITH {LISTINGS} SELECT listing_id, price FROM l WHERE price IS NOT NULL")
def _(t):
    return V.drop_missing_target(listings(t), "price").select("listing_id", "price")


@query("v04_presence_flags", f"WITH {LISTINGS} SELECT listing_id, hp AS has_price, hl AS has_location, hr AS has_rooms, hm AS has_m2, hd AS has_description, hi AS has_min_images FROM v")
def _(t):
    names = ("price", "location", "rooms", "m2", "description", "min_images")
    return V.validate(listings(t), images(t)).select("listing_id", *[f"has_{n}" for n in names])


@query("v05_outlier_flags", f"WITH {LISTINGS} SELECT listing_id, round(per, 8) AS price_per_m2, op AS is_outlier_price, om AS is_outlier_m2, o2 AS is_outlier_price_per_m2 FROM v")
def _(t):
    return V.validate(listings(t), images(t)).select("listing_id", rounded(F.col("price_per_m2"), 8).alias("price_per_m2"), "is_outlier_price", "is_outlier_m2", "is_outlier_price_per_m2")


@query("v06_readiness", f"WITH {LISTINGS} SELECT listing_id, ml AS ready_ml, dl AS ready_dl, ml AND dl AND hd AS ready_multimodal FROM v")
def _(t):
    return V.validate(listings(t), images(t)).select("listing_id", "ready_ml", "ready_dl", "ready_multimodal")


@query("v07_reject_reason", f"WITH {LISTINGS} SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM v GROUP BY 1")
def _(t):
    return V.validate(listings(t), images(t)).groupBy(F.coalesce("reject_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("v08_validate", f"WITH {LISTINGS} SELECT listing_id, vi AS valid_images, ai > 0 AND ai = vi AS all_images_valid, ml AS ready_ml, reason AS reject_reason FROM v")
def _(t):
    return V.validate(listings(t), images(t)).select("listing_id", "valid_images", "all_images_valid", "ready_ml", "reject_reason")


@query("v09_constraints", """SELECT c_custkey, concat_ws('|', CASE WHEN length(c_name) < 5 THEN 'name: too short' END, CASE WHEN c_acctbal < 0 THEN 'balance: negative' END,
 CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment: unknown' END) AS errors FROM customer""")
def _(t):
    rules = {"name": [(F.length("c_name") >= 5, "too short")], "balance": [(F.col("c_acctbal") >= 0, "negative")], "segment": [(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "unknown")]}
    return V.check_constraints(t("customer"), rules).select("c_custkey", F.array_join("errors", "|").alias("errors"))


@query("v10_upload_checks", """SELECT l_suppkey, coalesce(e, 'ok') AS error, count(*) AS n, count(*) FILTER (r <= 16 AND e IS NULL) AS used FROM (
 SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r,
  CASE WHEN l_returnflag = 'R' THEN 'suffix' WHEN l_linestatus = 'O' THEN 'type' WHEN l_quantity > 40 THEN 'size' END AS e FROM lineitem) GROUP BY ALL""")
def _(t):
    rows = t("lineitem").select(
        "l_suppkey",
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"),
        F.when(F.col("l_returnflag") == "R", "a.gif").otherwise("A.JPG").alias("name"),
        F.when(F.col("l_linestatus") == "O", "image/gif").otherwise("image/png").alias("mime"),
        (F.col("l_quantity") * 262144).alias("bytes"),
    )
    done = V.check_assets(rows, "l_suppkey", "at")
    return done.groupBy("l_suppkey", F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"), F.count_if("used").alias("used"))


@query("v12_min_group_size", "SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1 HAVING count(*) >= 5")
def _(t):
    joined = t("customer").where("c_acctbal > 9000").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return V.having_min(joined.groupBy("n_regionkey").agg(F.count("*").alias("n")))


@query("v14_asset_existence", "SELECT l_orderkey, l_linenumber, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AS valid FROM lineitem")
def _(t):
    paths = t("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("./IMG\\\\"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("path"))
    known = t("part").where("p_size > 20").select(F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"))
    return V.valid_paths(paths, known).select("l_orderkey", "l_linenumber", "valid")


# -- joins and sets --------------------------------------------------------------------------------------------------


@query("j01_join_vectors", "SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN (SELECT doc_id, min(quality) AS quality, arg_min(toxic, (quality, toxic)) AS toxic FROM labels GROUP BY 1) l USING (doc_id)")
def _(t):
    return R.join_vectors(t("documents").select("doc_id", "lang"), t("labels"), "doc_id", ["quality", "toxic"])


@query("j02_keep_known", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    ids = t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return R.keep_known(t("customer").select("c_custkey", "c_name"), ids, "c_custkey")


@query("j03_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    visited = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.pending(t("orders").select("o_orderkey"), visited, "o_orderkey")


@query("j04_lookup_strict", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(t):
    store = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return R.lookup_strict(t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), store, "l_partkey", "p_brand")


@query("j05_child_stats", """SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(valid, 0) AS valid, coalesce(numbers, '') AS numbers FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS valid,
 array_to_string(list_sort(list(l_linenumber)), ',') AS numbers FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(t):
    child = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",")
    return R.with_child_stats(t("orders").select("o_orderkey"), child, "o_orderkey", n=F.count("*"), valid=F.count_if(F.col("l_returnflag") != "R"), numbers=numbers).fillna({"n": 0, "valid": 0, "numbers": ""})


@query("j06_align_predictions", "SELECT o_orderkey, round(o_totalprice * 2, 4) AS double_up, o_custkey::DOUBLE AS other FROM orders")
def _(t):
    o = t("orders")
    models = {"double_up": o.select("o_orderkey", rounded(F.col("o_totalprice") * 2).alias("prediction")), "other": o.select("o_orderkey", F.col("o_custkey").cast("double").alias("prediction"))}
    return R.align_predictions(o.select("o_orderkey"), models, "o_orderkey")


@query("j07_density", "SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 GROUP BY 1, 2")
def _(t):
    counts = t("customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return R.with_density(t("nation").select("n_nationkey", "n_name"), counts, "n_nationkey")


@query("j08_complete_domain", "SELECT r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 3 GROUP BY 1")
def _(t):
    counts = t("nation").where("n_nationkey < 3").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return R.complete_domain(t("region"), counts, "r_regionkey").select("r_name", "n")


@query("j12_relationship", """WITH a AS (SELECT o_orderkey AS k, count(*) AS na FROM orders WHERE o_totalprice > 100000 GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS nb FROM lineitem GROUP BY 1)
 SELECT count(na) AS keys_a, count(nb) AS keys_b, count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS shared, round(100.0::DOUBLE * shared / count(na), 4) AS coverage_a, round(100.0::DOUBLE * shared / count(nb), 4) AS coverage_b, '1:N' AS kind
 FROM a FULL JOIN b USING (k)""")
def _(t):
    return R.relationship(t("orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("j13_complete_keys", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2, 3, 4) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 4)")
def _(t):
    return R.complete_keys(t("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", [1, 2, 3, 4])


@query("x01_union_rows", "SELECT o_orderkey AS id, o_orderstatus AS status, NULL::VARCHAR AS flag FROM orders UNION ALL SELECT l_orderkey, NULL, l_returnflag FROM lineitem WHERE l_linenumber = 1")
def _(t):
    b = t("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"))
    return R.union_rows(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), b)


@query("x02_all_ids", "SELECT o_custkey AS id FROM orders UNION SELECT l_suppkey FROM lineitem")
def _(t):
    return R.all_ids([t("orders").select(F.col("o_custkey").alias("id")), t("lineitem").select(F.col("l_suppkey").alias("id"))], "id")


@query("x03_missing_ids", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(t):
    return R.missing_ids(t("customer").select(F.col("c_custkey").alias("id")), t("orders").select(F.col("o_custkey").alias("id")), "id")


@query("x04_shared_ids", "SELECT l_partkey AS id FROM lineitem INTERSECT SELECT l_suppkey FROM lineitem")
def _(t):
    return R.shared_ids(t("lineitem").select(F.col("l_partkey").alias("id")), t("lineitem").select(F.col("l_suppkey").alias("id")), "id")


@query("x05_array_distinct", "SELECT l_orderkey, array_to_string(list(l_returnflag ORDER BY f, l_returnflag), ',') AS flags FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS f FROM lineitem GROUP BY ALL) GROUP BY 1")
def _(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(ordered), ",").alias("flags"))


# -- windows ---------------------------------------------------------------------------------------------------------


@query("w01_dedup_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return R.dedup_last(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).drop("ts")


@query("w02_dedup_first", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return R.dedup_first(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).drop("ts")


@query("w03_cap_per_group", "SELECT l_orderkey, l_linenumber, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem WHERE l_returnflag <> 'R') WHERE r <= 3")
def _(t):
    rows = R.cap_per_group(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_linenumber", 3, F.col("l_returnflag") != "R")
    return rows.select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("w04_order_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS order_index FROM conversations")
def _(t):
    return R.with_order_index(t("conversations").select("conv_id", "turn"), "conv_id", "turn").withColumn("order_index", F.col("order_index").cast("long"))


TRIALS = "trials AS (SELECT l_returnflag AS model, l_linestatus AS kind, l_linenumber AS cap, count(*) AS n, round(avg(abs(l_extendedprice - l_quantity * 2000)), 4) AS mae, round(sqrt(avg((l_extendedprice - l_quantity * 2000) ** 2)), 4) AS rmse FROM lineitem GROUP BY ALL)"


def trials(t) -> DataFrame:
    m = S.metric_columns(F.col("l_extendedprice"), F.col("l_quantity") * 2000)
    g = t("lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("kind"), F.col("l_linenumber").cast("long").alias("cap"))
    return g.agg(F.count("*").alias("n"), m["mae"].alias("mae"), m["rmse"].alias("rmse"))


@query("w05_best_per_group", f"WITH {TRIALS} SELECT model, kind, cap, mae FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY mae, rmse, model, kind) AS r FROM trials) WHERE r = 1")
def _(t):
    return S.best_per_group(trials(t), "cap", ["mae", "rmse", "model", "kind"]).select("model", "kind", "cap", "mae")


SPLIT = "CASE WHEN left(md5('42:' || o_orderkey), 8) < 'b3333333' THEN 'train' WHEN left(md5('42:' || o_orderkey), 8) < 'd9999999' THEN 'validation' ELSE 'test' END"


@query("w06_split", f"SELECT o_orderkey, {SPLIT} AS part FROM orders")
def _(t):
    return t("orders").select("o_orderkey", R.split_label(F.col("o_orderkey")).alias("part"))


@query("w08_leaderboard", f"WITH {TRIALS} SELECT row_number() OVER (ORDER BY mae, rmse, model, kind, cap) AS rank, model, kind, cap, mae, rmse FROM trials")
def _(t):
    from pyspark.sql import Window

    order = Window.orderBy("mae", "rmse", "model", "kind", "cap")  # a leaderboard has a row for each trial, not for each data row
    return trials(t).select(F.row_number().over(order).cast("long").alias("rank"), "model", "kind", "cap", "mae", "rmse")


# -- prediction frames -----------------------------------------------------------------------------------------------

FRAME = f"""s AS (SELECT o.*, n_name, r_name, {SPLIT} AS part FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
 m AS (SELECT o_orderpriority, avg(o_totalprice) AS gm FROM s WHERE part = 'train' GROUP BY 1), al AS (SELECT avg(o_totalprice) AS q FROM s WHERE part = 'train'),
 fr AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, n_name, r_name, o_totalprice AS y, coalesce(gm, q) AS p, q FROM s LEFT JOIN m USING (o_orderpriority), al WHERE part = 'test')"""


def frame(t) -> DataFrame:
    """Test orders with actual y, group-mean prediction p and global-mean prediction q."""
    nation = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    o = o.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("part", R.split_label(F.col("o_orderkey")))
    out = B.predict_group_mean(o.where("part = 'test'"), o.where("part = 'train'"), "o_orderpriority", "o_totalprice")
    return out.select("o_orderkey", "o_orderpriority", "o_orderstatus", "n_name", "r_name", F.col("o_totalprice").alias("y"), F.col("prediction").alias("p"), F.col("overall").alias("q"))


MAPE = "round(avg(abs(y - {0}) / greatest(y, 1e-8) * 100), 4)"


@query("a02_flagship_error_by_nation", f"WITH {FRAME} SELECT n_name, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((p - y) ** 2)), 4) AS rmse FROM fr GROUP BY 1")
def _(t):
    return S.metrics(frame(t), "y", "p", ["n_name"]).select("n_name", "n", "mae", "rmse")


@query("a01_metrics", f"WITH {FRAME} SELECT count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p) / abs(y) * 100), 4) AS mape FROM fr")
def _(t):
    return S.metrics(frame(t), "y", "p")


@query("a02_error_by_group", f"WITH {FRAME} SELECT n_name AS \"group\", count(*) AS n, round(avg(y), 4) AS mean_actual, round(avg(abs(y - p)), 4) AS mae, {MAPE.format('p')} AS mape FROM fr GROUP BY 1")
def _(t):
    return S.error_by_group(frame(t), "n_name", "y", "p")


IMPROVE = "count(*) AS n, round(avg(abs(y - q)), 4) AS ref_mae, round(avg(abs(y - p)), 4) AS target_mae, round(avg(abs(y - q)) - avg(abs(y - p)), 4) AS mae_gain, round(avg(abs(y - q) / greatest(y, 1e-8) * 100) - avg(abs(y - p) / greatest(y, 1e-8) * 100), 4) AS mape_gain"


@query("a03_improvement_by_group", f"WITH {FRAME} SELECT n_name AS \"group\", {IMPROVE} FROM fr GROUP BY 1 HAVING count(*) >= 5")
def _(t):
    return S.improvement_by_group(frame(t), "n_name", "y", "q", "p")


BIN = "CASE WHEN y < 20000 THEN 1 WHEN y < 30000 THEN 2 WHEN y < 40000 THEN 3 WHEN y < 50000 THEN 4 WHEN y < 75000 THEN 5 ELSE 6 END"


@query("a04_error_by_bin", f"WITH {FRAME} SELECT ({BIN})::BIGINT AS bin, count(*) AS n, round(avg(y), 4) AS mean_actual, round(avg(abs(y - p)), 4) AS mae, {MAPE.format('p')} AS mape FROM fr GROUP BY 1")
def _(t):
    binned = frame(t).withColumn("bin_label", P.cut(F.col("y"), EDGES, LABELS))
    return S.in_bin_order(S.error_by_group(binned, "bin_label", "y", "p"), LABELS).drop("group").withColumn("bin", F.col("bin").cast("long"))


@query("a04_improvement_by_bin", f"WITH {FRAME} SELECT ({BIN})::BIGINT AS bin, {IMPROVE} FROM fr GROUP BY 1")
def _(t):
    binned = frame(t).withColumn("bin_label", P.cut(F.col("y"), EDGES, LABELS))
    return S.in_bin_order(S.improvement_by_group(binned, "bin_label", "y", "q", "p", 1), LABELS).drop("group").withColumn("bin", F.col("bin").cast("long"))


def segments() -> dict:
    return {"all": F.lit(True), "high": F.col("y") >= 75000, "open": F.col("o_orderstatus") == "O", "none": F.lit(False)}


SEG = "seg AS (SELECT 'all' AS segment, * FROM fr UNION ALL SELECT 'high', * FROM fr WHERE y >= 75000 UNION ALL SELECT 'open', * FROM fr WHERE o_orderstatus = 'O')"


def _metric_sql(c: str, prefix: str) -> str:
    return f"round(avg(abs(y - {c})), 4) AS {prefix}_mae, round(sqrt(avg(({c} - y) ** 2)), 4) AS {prefix}_rmse, round(1 - sum((y - {c}) ** 2) / (var_pop(y) * count(*)), 6) AS {prefix}_r2, round(avg(abs(y - {c}) / abs(y) * 100), 4) AS {prefix}_mape"


@query("a05_segment_metrics", f"WITH {FRAME}, {SEG} SELECT segment, count(*) AS n, {_metric_sql('q', 'ref')}, {_metric_sql('p', 'target')}, round(ref_mae - target_mae, 4) AS mae_gain FROM seg GROUP BY 1")
def _(t):
    return S.segment_metrics(frame(t), segments(), "y", "q", "p")


@query("a06_residual_profile", f"WITH {FRAME}, {SEG} SELECT segment, count(*) AS n, round(avg(y - p), 4) AS mean, round(median(y - p), 4) AS median, round(stddev_pop(y - p), 4) AS std, round(avg(abs(y - p)), 4) AS mae, round(avg((y > p)::INT), 6) AS under_share, round(avg((y < p)::INT), 6) AS over_share FROM seg GROUP BY 1")
def _(t):
    return S.residual_profile(frame(t), segments(), "y", "p")


@query("a07_error_by_count", "SELECT l_linenumber::VARCHAR AS \"group\", count(*) AS n, round(avg(l_extendedprice), 4) AS mean_actual, round(avg(abs(l_extendedprice - l_quantity * 2000)), 4) AS mae, round(avg(abs(l_extendedprice - l_quantity * 2000) / greatest(l_extendedprice, 1e-8) * 100), 4) AS mape FROM lineitem GROUP BY 1")
def _(t):
    return S.error_by_group(t("lineitem").withColumn("p", F.col("l_quantity") * 2000), "l_linenumber", "l_extendedprice", "p")


@query("a08_error_summary", f"WITH {FRAME} SELECT round(avg(y), 4) AS mean_actual, round(avg(p), 4) AS mean_predicted, round(avg(p - y), 4) AS mean_signed, round(quantile_cont(abs(y - p), 0.5), 4) AS p50, round(quantile_cont(abs(y - p), 0.9), 4) AS p90, round(quantile_cont(abs(y - p), 0.95), 4) AS p95 FROM fr")
def _(t):
    return S.error_summary(frame(t), "y", "p")


@query("a09_numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS field, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(median({c})::DOUBLE, 4) AS median, round(quantile_cont({c}, 0.05)::DOUBLE, 4) AS p05, round(quantile_cont({c}, 0.95)::DOUBLE, 4) AS p95, count(*) FILTER ({c} IS NULL) AS missing FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_tax")))
def _(t):
    return S.numeric_profile(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query("a10_length_profile", f"""SELECT count(*) AS n, count(*) FILTER (c = 0) AS blank, round(avg(c), 4) AS chars_mean, round(median(c), 4) AS chars_median, round(quantile_cont(c, 0.9), 4) AS chars_p90, round(quantile_cont(c, 0.95), 4) AS chars_p95, max(c) AS chars_max,
 round(avg(w), 4) AS words_mean, round(median(w), 4) AS words_median, round(quantile_cont(w, 0.9), 4) AS words_p90, round(quantile_cont(w, 0.95), 4) AS words_p95, max(w) AS words_max FROM (SELECT length(x) AS c, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END AS w FROM (SELECT {COLLAPSED} AS x FROM documents))""")
def _(t):
    return S.length_profile(t("documents"), "text")


@query("a11_length_bins", """SELECT bin, count(doc_id) AS n, round(100.0::DOUBLE * count(doc_id) / (SELECT count(*) FROM documents), 4) AS share FROM (VALUES ('0-20'), ('20-500'), ('500-2000'), ('2000-9000'), ('9000+'), ('never')) v(bin)
 LEFT JOIN documents ON bin = CASE WHEN n_chars < 20 THEN '0-20' WHEN n_chars < 500 THEN '20-500' WHEN n_chars < 2000 THEN '500-2000' WHEN n_chars < 9000 THEN '2000-9000' ELSE '9000+' END GROUP BY 1""")
def _(t):
    labels = ("0-20", "20-500", "500-2000", "2000-9000", "9000+")
    docs = t("documents").select(P.cut(F.col("n_chars"), (0, 20, 500, 2000, 9000), labels).alias("bin"))
    every = docs.sparkSession.createDataFrame([(x,) for x in (*labels, "never")], "bin string")
    return S.share_by_label(docs, every, "bin")


@query("a12_option_counts", "SELECT p_brand AS value, p_brand AS label, count(*) AS n FROM part GROUP BY 1, 2 UNION ALL SELECT NULL, 'Unknown', 0 WHERE false")
def _(t):
    return S.option_counts(t("part"), "p_brand")


@query("a13_location_tree", """WITH c AS (SELECT r_name, n_name, c_mktsegment AS s, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)
 SELECT r_name, sum(m)::BIGINT AS total, string_agg(line, ';' ORDER BY n_name) AS tree FROM (SELECT r_name, n_name, sum(n) AS m, n_name || '=' || sum(n)::BIGINT || '(' || string_agg(s || ':' || n, ',' ORDER BY s) || ')' AS line FROM c GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    joined = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    tree = S.location_tree(joined, ["r_name", "n_name", "c_mktsegment"])

    def leaf(p):
        return F.concat_ws(":", p["name"], p["n"].cast("string"))

    def line(p):
        return F.concat(p["name"], F.lit("="), p["n"].cast("string"), F.lit("("), F.array_join(F.transform(p["parts"], leaf), ","), F.lit(")"))

    return tree.select("r_name", "total", F.array_join(F.transform("parts", line), ";").alias("tree"))


@query("a13_location_totals", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(t):
    joined = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return S.location_totals(joined, ["r_name", "n_name"])


@query("a14_count_reference", "SELECT greatest(round(quantile_cont(n, 0.95), 4), 1.0)::DOUBLE AS reference FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def _(t):
    return S.count_reference(t("customer"), "c_nationkey")


WORDS_SQL = f"SELECT doc_id, n_chars, regexp_extract_all({FOLDED}, '[a-z0-9]{{2,}}') AS t FROM documents"


@query("a15_keyword_effect", f"""WITH d AS ({WORDS_SQL}), k(keyword, w) AS (VALUES ('insult', ['trash', 'moron']), ('the', ['the']), ('gone', ['qqqq']))
 SELECT keyword, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM d), 4) AS share, round(avg(n_chars), 4) AS mean, round(median(n_chars), 4) AS median, round(avg(n_chars) - (SELECT avg(n_chars) FROM d), 4) AS delta FROM d JOIN k ON list_has_any(t, w) GROUP BY 1""")
def _(t):
    docs = t("documents").select("n_chars", X.tokens(F.col("text")).alias("words"))
    return S.keyword_effect(docs, {"insult": ("trash", "moron"), "the": ("the",), "gone": ("qqqq",)}, "words", "n_chars")


@query("a16_missing_counts", "SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS field, unnest([count(*) - count(event_id), count(*) - count(ts), count(*) - count(user_id), count(*) - count(nullif(event_type, 'click')), count(*) - count(value), count(*) - count(props)]) AS missing FROM events")
def _(t):
    return S.missing_counts(t("events").withColumn("event_type", F.nullif("event_type", F.lit("click"))))


@query("a17_duplicate_count", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY 1, 2)")
def _(t):
    return S.duplicate_count(t("documents").select("text", "lang"))


@query("a18_distinct_ids", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT l_suppkey FROM lineitem)")
def _(t):
    return R.all_ids([t("orders").select(F.col("o_custkey").alias("id")), t("lineitem").select(F.col("l_suppkey").alias("id"))], "id").agg(F.count("*").alias("n"))


@query("a21_audit_paths", "SELECT l_returnflag, count(*) AS total, count(*) FILTER (ok) AS valid, count(DISTINCT CASE WHEN ok THEN l_orderkey END) AS with_valid, array_to_string(list_sort(list(DISTINCT CASE WHEN NOT ok THEN l_partkey END))[1:5], ',') AS broken FROM (SELECT *, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AS ok FROM lineitem) GROUP BY 1")
def _(t):
    known = t("part").where("p_size > 20").select(F.col("p_partkey").cast("string").alias("path"))
    done = V.valid_paths(t("lineitem").select("l_returnflag", "l_orderkey", "l_partkey", F.col("l_partkey").cast("string").alias("path")), known)
    broken = done.where(~F.col("valid")).select("l_returnflag", "l_partkey").distinct()
    first = R.cap_per_group(broken, "l_returnflag", "l_partkey", 5)  # five rows of a flag leave a task, not all its keys
    first = first.groupBy("l_returnflag").agg(F.array_sort(F.collect_list("l_partkey")).alias("keys"))
    counts = done.groupBy("l_returnflag").agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_distinct(F.when(F.col("valid"), F.col("l_orderkey"))).alias("with_valid")
    )
    keys = F.coalesce("keys", F.expr("cast(array() as array<long>)"))
    return counts.join(first, "l_returnflag", "left").withColumn("broken", F.array_join(F.transform(keys, lambda x: x.cast("string")), ",")).drop("keys")


@query("a23_consistency", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')) AS flagged_not_ready, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS logged_not_raw")
def _(t):
    o, li = t("orders"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    a = R.missing_ids(o.where("o_orderstatus = 'F'"), li.where("l_linestatus = 'F'"), "o_orderkey").agg(F.count("*").alias("flagged_not_ready"))
    return a.crossJoin(F.broadcast(R.missing_ids(li, o, "o_orderkey").agg(F.count("*").alias("logged_not_raw"))))  # one row each


@query("a28_top_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM ({WORDS_SQL})) WHERE NOT list_contains({list(X.STOPWORDS)}, term) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def _(t):
    return S.top_terms(t("documents"), X.tokens(F.col("text"), X.STOPWORDS))


@query("a29_signal_summary", f"""WITH d AS (SELECT text AS x, {FOLDED} AS f FROM documents) SELECT unnest(['html', 'link', 'license']) AS signal, unnest([count(*) FILTER (regexp_matches(x, '<[^>]+>')), count(*) FILTER (regexp_matches(x, 'https?://|www\\.')), count(*) FILTER (contains(f, 'licens'))]) AS n,
 unnest([round(100 * avg(regexp_matches(x, '<[^>]+>')::INT), 4), round(100 * avg(regexp_matches(x, 'https?://|www\\.')::INT), 4), round(100 * avg(contains(f, 'licens')::INT), 4)]) AS share FROM d""")
def _(t):
    text = F.col("text")
    return S.signal_summary(t("documents"), {"html": text.rlike("<[^>]+>"), "link": text.rlike(r"https?://|www\."), "license": X.has_phrase(text, "licens")})


@query("a31_run_summary", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS ready, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def _(t):
    kind = F.col("event_type")
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "error").alias("failed"), F.count_if(kind == "purchase").alias("ready"), rounded(F.avg("value"), 6).alias("mean_value"))


@query("a32_histogram", "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 40), 39)::BIGINT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(40)) AS bin) r LEFT JOIN b ON b.bin = r.bin")
def _(t):
    return S.histogram(t("lineitem"), "l_extendedprice")


@query("a34_compare_models", f"""WITH {FRAME}, mm AS (SELECT 'base' AS model, count(*) AS n, round(avg(abs(y - q)), 4) AS mae, round(sqrt(avg((q - y) ** 2)), 4) AS rmse, round(1 - sum((y - q) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - q) / abs(y) * 100), 4) AS mape FROM fr
 UNION ALL SELECT 'group', count(*), round(avg(abs(y - p)), 4), round(sqrt(avg((p - y) ** 2)), 4), round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6), round(avg(abs(y - p) / abs(y) * 100), 4) FROM fr)
 SELECT a.*, round(b.mae - a.mae, 4) AS mae_gain, round(b.rmse - a.rmse, 4) AS rmse_gain, round(b.mape - a.mape, 4) AS mape_gain, round(a.r2 - b.r2, 6) AS r2_gain FROM mm a, mm b WHERE b.model = 'base'""")
def _(t):
    f = frame(t)
    rows = S.metrics(f, "y", "q").withColumn("model", F.lit("base")).unionByName(S.metrics(f, "y", "p").withColumn("model", F.lit("group")))
    return S.compare_models(rows, "base")


@query("a36_top_parents", "SELECT n_name, count(*) AS n, count(DISTINCT c_mktsegment) AS children FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 10")
def _(t):
    joined = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return S.top_parents(joined, "n_name", "c_mktsegment")


@query("a37_worst_groups", f"WITH {FRAME}, g AS (SELECT n_name AS \"group\", count(*) AS n, round(avg(abs(y - p)), 4) AS mae FROM fr GROUP BY 1 HAVING count(*) >= 5) SELECT * FROM g ORDER BY mae DESC, n DESC, \"group\" LIMIT 12")
def _(t):
    return V.having_min(S.error_by_group(frame(t), "n_name", "y", "p")).select("group", "n", "mae").orderBy(F.desc("mae"), F.desc("n"), "group").limit(12)


@query("p28_error_columns", f"WITH {FRAME} SELECT o_orderkey, round(y - p, 4) AS p_residual, round(abs(y - p), 4) AS p_abs_error, round(abs(y - p) / greatest(y, 1e-8) * 100, 6) AS p_ape_pct, round(abs(y - q) - abs(y - p), 4) AS p_gain FROM fr")
def _(t):
    out = S.add_error_columns(frame(t), "y", {"p": "p", "q": "q"}, base="q")
    return out.select("o_orderkey", *[rounded(F.col(c)).alias(c) for c in ("p_residual", "p_abs_error", "p_gain")], rounded(F.col("p_ape_pct"), 6).alias("p_ape_pct"))


@query("p23_out_of_range", "SELECT l_orderkey, l_linenumber, l_extendedprice < lo OR l_extendedprice > hi AS atypical FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem)")
def _(t):
    bounds = t("lineitem").agg(F.percentile("l_extendedprice", F.lit(0.05)).alias("lo"), F.percentile("l_extendedprice", F.lit(0.95)).alias("hi"))
    price = F.col("l_extendedprice")
    return t("lineitem").crossJoin(F.broadcast(bounds)).select("l_orderkey", "l_linenumber", ((price < F.col("lo")) | (price > F.col("hi"))).alias("atypical"))  # one row


@query("p29_segment_flags", "SELECT o_orderkey, o_totalprice >= 75000 AS high, o_totalprice >= 75000 OR o_orderkey % 300 >= 180 OR o_orderpriority IN ('1-URGENT') AS luxury FROM orders")
def _(t):
    high = F.col("o_totalprice") >= 75000
    return t("orders").select("o_orderkey", high.alias("high"), (high | (F.col("o_orderkey") % 300 >= 180) | F.col("o_orderpriority").isin("1-URGENT")).alias("luxury"))


@query("t01_worst_cases", f"WITH {FRAME} SELECT o_orderkey, n_name, round(y, 2) AS y, round(abs(y - p), 4) AS error FROM fr ORDER BY error DESC, o_orderkey LIMIT 20")
def _(t):
    rows = frame(t).select("o_orderkey", "n_name", rounded(F.col("y"), 2).alias("y"), rounded(F.abs(F.col("y") - F.col("p"))).alias("error"))
    return S.worst_cases(rows, "error", ["o_orderkey"])


@query("t02_best_trial", f"WITH {TRIALS} SELECT model, kind, cap, mae FROM trials ORDER BY mae, model, kind, cap LIMIT 1")
def _(t):
    best = F.min_by(F.struct("model", "kind", "cap", "mae"), F.struct("mae", "model", "kind", "cap")).alias("b")
    return trials(t).agg(best).select("b.*")


@query("m09_ols", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def _(t):
    fit = B.ols1(t("lineitem"), "l_quantity", "l_extendedprice")
    return fit.select(rounded(F.col("slope"), 6).alias("slope"), rounded(F.col("intercept")).alias("intercept"), rounded(F.col("r2"), 8).alias("r2"))


@query("m14_group_mean_model", f"WITH {FRAME} SELECT o_orderkey, round(p, 4) AS prediction FROM fr")
def _(t):
    return frame(t).select("o_orderkey", rounded(F.col("p")).alias("prediction"))
