"""Queries of the sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglens.operators import validate as V
from listinglens.plans.relational import LISTINGS, images, listings
from listinglens.session import fresh_path, rounded
from listinglens.sources import snapshots as N
from listinglens.sources import tables as A
from listinglens.streaming import ingest as I
from listinglens.streaming import retry as Y
from listinglens.streaming import seen as W

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(run):
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


@query("s01_parquet_scan", "SELECT * FROM nation")
def _(spark, d):
    return A.read_table(spark, f"{d}/nation.parquet", "n_nationkey int, n_name string, n_regionkey int")


@query("s02_projected_scan", "SELECT p_partkey, p_brand FROM part")
def _(spark, d):
    return A.read_table(spark, f"{d}/part.parquet", columns=["p_partkey", "p_brand"])


@query("s03_catalog")
def _(spark, d):
    return A.scan_catalog(spark, d)


@query("s04_limited_scan", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def _(spark, d):
    return A.read_table(spark, f"{d}/documents.parquet", columns=["doc_id", "lang"], limit=25, order=["doc_id"])


@query("s05_upsert", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("version"))
    path = fresh_path(spark, "upsert")
    N.upsert(o.where("o_orderkey % 3 = 0"), path, "o_orderkey", ["version"])
    change = o.where("o_orderkey % 3 <> 0").unionByName(o.where("o_orderkey % 10 = 0").withColumns({"status": F.lit("new"), "version": F.lit(1)}))
    N.upsert(change, path, "o_orderkey", ["version"])
    return N.read_snapshot(spark, path).drop("version")


@query("s06_event_log", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 2 = 1 THEN event_type END AS event_type FROM events")
def _(spark, d):
    e, path = spark.read.parquet(f"{d}/events.parquet"), fresh_path(spark, "log")
    A.append_events(e.where("event_id % 2 = 0").select("event_id", "value"), path)
    A.append_events(e.where("event_id % 2 = 1").select("event_id", "event_type"), path)
    return A.read_events(spark, path)


@query("s08_state_lines", "SELECT url AS line FROM pages")
def _(spark, d):
    path = fresh_path(spark, "lines")
    A.write_lines(spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit(" "), "url", F.when(F.col("page_id") % 2 == 0, "\n  ").otherwise("")).alias("u")), "u", path)
    return A.read_lines(spark, path)


@query("s09_payloads", "SELECT conv_id, turn, role FROM conversations")
def _(spark, d):
    path = fresh_path(spark, "payloads")
    spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role").write.json(path)
    return A.read_payloads(spark, path, "conv_id long, turn long, role string", multi_line=False).where("_corrupt_record is null").drop("_corrupt_record")


@query("s10_json_metadata", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def _(spark, d):
    path = fresh_path(spark, "meta")
    A.write_json_metadata(spark.read.parquet(f"{d}/region.parquet"), path)
    return spark.read.text(path)


@query("s11_export", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _(spark, d):
    out = fresh_path(spark, "export")
    names = A.export_tables(spark, d, ["nation", "region", "absent"], out)
    frames = [spark.read.option("header", True).csv(f"{out}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    return frames[0].unionByName(frames[1])


@query("s12_vector_table", "SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def _(spark, d):
    path = fresh_path(spark, "vectors")
    A.write_vectors(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"), "embedding", path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("n"), rounded(total, 5).alias("total"))


@query("s13_train_ready", f"WITH {LISTINGS}, p AS (SELECT l_orderkey AS listing_id, array_to_string(list_sort(list(l_linenumber)), ',') AS paths, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT v.listing_id, n AS valid_image_count, paths FROM v JOIN p USING (listing_id) WHERE dl")
def _(spark, d):
    def t(name):
        return spark.read.parquet(f"{d}/{name}.parquet")

    done = A.materialize_train_ready(listings(t), V.validate(listings(t), images(t)), images(t), "listing_id", "ready_dl", F.col("l_linenumber"))
    paths = F.array_join(F.transform("valid_image_paths", lambda x: x.cast("string")), ",")
    return done.select("listing_id", F.col("valid_image_count").cast("long").alias("valid_image_count"), paths.alias("paths"))


def event_files(spark, d, parts: int = 4):
    """events as files of a folder, and their schema."""
    e, path = spark.read.parquet(f"{d}/events.parquet"), fresh_path(spark, "in")
    e.repartition(parts).write.parquet(path)
    return path, e.schema


@query("i01_ingest_stream", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    path, schema = event_files(spark, d)
    out = fresh_path(spark, "out")
    I.ingest_stream(I.file_stream(spark, path, schema), lambda b, _: b.write.mode("append").parquet(out), fresh_path(spark, "cp"))
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value")


@query("i02_streaming_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, d):
    path, schema = event_files(spark, d)
    out = fresh_path(spark, "out")
    stream = I.file_stream(spark, path, schema, 2).withColumn("bucket", F.pmod(F.col("user_id"), F.lit(16)))
    I.upsert_stream(stream, out, "user_id", ["ts", "event_id"], fresh_path(spark, "cp"), "bucket")
    return N.read_snapshot(spark, out).select("user_id", "event_id", "event_type")


@query("i03_drop_seen", "SELECT DISTINCT user_id FROM events")
def _(spark, d):
    """Two runs over one checkpoint, the second with a further copy of all events: each key is taken up once."""
    path, schema = event_files(spark, d)
    out, checkpoint = fresh_path(spark, "seen"), fresh_path(spark, "cp")
    W.take_unseen(I.file_stream(spark, path, schema, 2), out, "user_id", checkpoint)
    spark.read.parquet(f"{d}/events.parquet").repartition(2).write.mode("append").parquet(path)
    return W.take_unseen(I.file_stream(spark, path, schema, 2), out, "user_id", checkpoint).rows().select("user_id")


@query("i04_retry_queue", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500) AND o_orderstatus = 'F' THEN 'visited' ELSE 'queued' END AS state FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("ok"))
    queue, done = I.advance_queue(o.select("o_orderkey"), o, "o_orderkey", "o_orderkey", 500)
    return queue.withColumn("state", F.lit("queued")).unionByName(done.withColumn("state", F.lit("visited")))


RETRIED = """f AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_type = 'purchase') AS r FROM events),
 g AS (SELECT user_id, min(r) FILTER (ok) AS first_ok, count(*) AS n FROM f GROUP BY 1)"""


@query("i04_retry_stream", f"WITH {RETRIED} SELECT user_id, least(coalesce(first_ok - 1, n), 5)::INTEGER AS attempts, CASE WHEN first_ok <= 5 THEN 'done' WHEN coalesce(first_ok - 1, n) >= 5 THEN 'gave_up' ELSE 'waiting' END AS state FROM g")
def _(spark, d):
    """Events as attempts for their user; a purchase is a success. The state of each user after all events."""
    path, schema = event_files(spark, d, 1)
    out = fresh_path(spark, "out")
    attempts = I.file_stream(spark, path, schema, 1, "ts").select("user_id", (F.col("event_type") == "purchase").alias("ok"), "ts")
    I.append_stream(Y.retry_queue(attempts, "user_id", "ok", "ts", late="400 days"), out, fresh_path(spark, "cp"))
    return spark.read.schema("user_id long, attempts int, state string").parquet(out).where("state <> 'retry'")


@query("i05_streaming_validation", "SELECT event_id, value < 0 OR value > 100 AS is_outlier FROM events")
def _(spark, d):
    path, schema = event_files(spark, d)
    out = fresh_path(spark, "out")
    outlier = F.coalesce((F.col("value") < 0) | (F.col("value") > 100), F.lit(False))
    I.append_stream(I.file_stream(spark, path, schema).select("event_id", outlier.alias("is_outlier")), out, fresh_path(spark, "cp"))
    return spark.read.parquet(out)


@query("i06_run_counters", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    path, schema = event_files(spark, d)
    out = fresh_path(spark, "out")
    counts = I.run_counters(I.file_stream(spark, path, schema, 2), "user_id", "event_type")

    def sink(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", fresh_path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.max_by("count", "batch").alias("n"))
    return last


@query("i06_windowed_counters", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    path, schema = event_files(spark, d, 1)
    out = fresh_path(spark, "out")
    counts = I.windowed_counters(I.file_stream(spark, path, schema, 1, "ts"), "ts", "event_type", "1 hour", "400 days")

    def sink(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", fresh_path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).groupBy("w.start", "event_type").agg(F.max_by("count", "batch").alias("n"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


