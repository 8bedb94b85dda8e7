"""Queries of the parsing, filter and text operators (P, V02, V03, V11, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglens.functions import parse as P
from listinglens.functions import text as X
from listinglens.session import rounded

QUERIES: dict = {}
ORACLES: dict = {}


def over(table: str, name: str, columns, sql: str | None = None) -> None:
    """Register a projection of one table and its SQL twin."""

    def run(spark, sf_dir):
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns())

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


over("pages", "p01_normalize_url", lambda: ("page_id", P.normalize_url(F.col("url")).alias("link")),
     "SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS link FROM pages")
over("pages", "p02_absolutize", lambda: ("page_id", P.absolutize(F.concat(F.lit("/"), F.col("page_id").cast("string")), "https://a.example").alias("a"), P.absolutize(F.col("url"), "x").alias("b"), P.absolutize(F.lit("mailto:x"), "x").alias("c")),
     "SELECT page_id, 'https://a.example/' || page_id AS a, url AS b, NULL::VARCHAR AS c FROM pages")
over("pages", "p03_listing_id", lambda: ("page_id", P.listing_id(F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")), F.col("url")).alias("id"), P.run_id(F.col("url")).alias("run")),
     "SELECT page_id, 'source:' || CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR ELSE sha1(rtrim(regexp_replace(url, '[?#].*$', ''), '/')) END AS id, left(sha1(url), 12) AS run FROM pages")
over("lineitem", "p04_image_id", lambda: (P.image_id(F.col("l_orderkey"), F.col("l_linenumber")).alias("image_id"), "l_partkey"),
     "SELECT l_orderkey || ':' || l_linenumber AS image_id, l_partkey FROM lineitem")
over("orders", "p05_parse_money", lambda: ("o_orderkey", P.parse_money(F.concat(F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", "."), F.lit(",50 TL"))).alias("amount"), P.parse_money(F.col("o_orderstatus")).alias("none")),
     "SELECT o_orderkey, floor(o_totalprice) + 0.5 AS amount, NULL::DOUBLE AS none FROM orders")
over("customer", "p06_parse_int", lambda: ("c_custkey", P.parse_int(F.col("c_name")).cast("long").alias("n")),
     "SELECT c_custkey, try_cast(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS n FROM customer")


def _area():
    text = F.concat(F.col("p_size").cast("string"), F.lit(" m2 / "), F.floor(F.col("p_size") / 2).cast("string"), F.lit(" m2"))
    new, old = P.parse_area_pair(text), P.parse_area_pair(text, compat=True)
    return "p_partkey", new["gross"].alias("gross"), new["net"].alias("net"), old["net"].alias("old_net")


over("part", "p07_parse_area_pair", _area,
     "SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size::DOUBLE END AS gross, CASE WHEN p_size // 2 >= 10 THEN (p_size // 2)::DOUBLE END AS net, NULL::DOUBLE AS old_net FROM part")
over("documents", "p08_squeeze", lambda: ("doc_id", F.md5(P.squeeze(F.col("text"))).alias("h")),
     "SELECT doc_id, md5(nullif(regexp_replace(text, '\\s+', '', 'g'), '')) AS h FROM documents")
over("documents", "p09_furnished_to_bool", lambda: ("doc_id", P.furnished_to_bool(F.concat(F.when(F.col("doc_id") % 3 == 0, "Eşyalı değil ").when(F.col("doc_id") % 3 == 1, "eşyalı ").otherwise(""), F.col("lang"))).alias("b")),
     "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS b FROM documents")
over("documents", "p10_scrub_pii", lambda: ("doc_id", F.md5(P.scrub_pii(F.concat_ws(" ", "text", F.lit("tel:05321234567 5321234567 (0532) 1234567")))).alias("h")),
     r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat_ws(' ', text, 'tel:05321234567 5321234567 (0532) 1234567'), 'tel:\+?\d+', ' ', 'g'),
 '\b0?\d{3}\s?\d{3}\s?\d{2}\s?\d{2}\b', ' ', 'g'), '\b\(?0\d{3}\)?\s?\d{3}\s?\d{2}\s?\d{2}\b', ' ', 'g'), '\b\+90\s?\d{3}\s?\d{3}\s?\d{2}\s?\d{2}\b', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents""")
over("pages", "p11_canonical_image_url", lambda: ("page_id", P.canonical_image_url(F.concat(F.lit(" https://x.pics.example/mnresize/132/74/ds01/"), F.col("page_id").cast("string"), F.lit(".jpg?a=1&amp;b=2 "))).alias("link")),
     "SELECT page_id, 'https://x.pics.example/ds01/' || page_id || '.jpg?a=1&b=2' AS link FROM pages")
over("documents", "p12_normalize_string", lambda: ("doc_id", F.md5(P.normalize_string(F.col("text"))).alias("h")),
     "SELECT doc_id, md5(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) AS h FROM documents")
over("lineitem", "p13_room_count", lambda: ("l_orderkey", "l_linenumber", P.room_count(F.concat(F.col("l_linenumber").cast("string"), F.lit(" + "), F.col("l_quantity").cast("int").cast("string"))).alias("rooms"), P.room_count(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" oda"))).alias("single")),
     "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber + l_quantity::INT <= 12 THEN (l_linenumber + l_quantity::INT)::DOUBLE END AS rooms, CASE WHEN l_quantity <= 12 THEN l_quantity END AS single FROM lineitem")
over("part", "p14_floor_value", lambda: ("p_partkey", P.floor_value(F.when(F.col("p_partkey") % 5 == 0, " Zemin  Kat").when(F.col("p_partkey") % 5 == 1, "21 ve üzeri").when(F.col("p_partkey") % 5 == 2, "ara kat").when(F.col("p_partkey") % 5 == 3, "Kot 1").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(". Kat")))).alias("floor")),
     "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 21.0 WHEN 4 THEN p_size END::DOUBLE AS floor FROM part")
over("orders", "p15_furnished_flag", lambda: ("o_orderkey", P.furnished_flag(F.when(F.col("o_orderstatus") == "F", "Evet ").when(F.col("o_orderstatus") == "O", "no").otherwise(F.col("o_orderpriority"))).alias("flag")),
     "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Evet' WHEN 'O' THEN 'Hayir' ELSE o_orderpriority END AS flag FROM orders")
over("events", "p16_coerce_numeric", lambda: ("event_id", P.coerce_numeric(F.get_json_object("props", "$.k")).alias("k"), P.coerce_numeric(F.col("event_type")).alias("none"), P.coerce_numeric(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))).alias("v")),
     "SELECT event_id, (props->>'$.k')::DOUBLE AS k, NULL::DOUBLE AS none, value AS v FROM events")
over("part", "p18_tidy_scalar", lambda: ("p_partkey", P.tidy_scalar(F.col("p_retailprice")).alias("price"), P.tidy_scalar(F.col("p_size").cast("double")).alias("size")),
     "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS price, p_size::VARCHAR AS size FROM part")
over("orders", "p19_format_amount", lambda: ("o_orderkey", P.format_amount(F.col("o_totalprice")).alias("amount")),
     "SELECT o_orderkey, replace(format('{:,}', round_even(o_totalprice, 0)::BIGINT), ',', '.') || ' TL' AS amount FROM orders")
over("lineitem", "p20_price_per_area", lambda: ("l_orderkey", "l_linenumber", rounded(P.price_per_area(F.col("l_extendedprice"), F.col("l_quantity")), 8).alias("ratio"), P.price_per_area(F.lit(0.0), F.col("l_quantity")).alias("none")),
     "SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 8) AS ratio, NULL::DOUBLE AS none FROM lineitem")
over("part", "p21_aspect_ratio", lambda: ("p_partkey", P.aspect_ratio(F.col("p_partkey"), F.col("p_size")).alias("ratio"), P.aspect_ratio(F.col("p_partkey"), F.lit(0)).alias("none")),
     "SELECT p_partkey, round_even(p_partkey / nullif(p_size::DOUBLE, 0), 4) AS ratio, NULL::DOUBLE AS none FROM part")
over("orders", "p22_prediction_band", lambda: ("o_orderkey", P.prediction_band(F.col("o_totalprice"))["low"].alias("low"), P.prediction_band(F.col("o_totalprice"))["high"].alias("high")),
     "SELECT o_orderkey, round(o_totalprice * (1 - 0.1::DOUBLE)) AS low, round(o_totalprice * (1 + 0.1::DOUBLE)) AS high FROM orders")
over("orders", "p24_log_target", lambda: ("o_orderkey", rounded(P.to_log_target(F.col("o_totalprice")), 6).alias("y"), rounded(P.from_log_target(P.to_log_target(F.col("o_totalprice"))), 2).alias("back"), P.from_log_target(F.lit(-3.0)).alias("floor")),
     "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS y, round(o_totalprice, 2) AS back, 0.0::DOUBLE AS floor FROM orders")
EDGES, LABELS = (0, 20_000, 30_000, 40_000, 50_000, 75_000), ("0-20k TRY", "20k-30k TRY", "30k-40k TRY", "40k-50k TRY", "50k-75k TRY", "75k+ TRY")
over("orders", "p25_cut", lambda: ("o_orderkey", P.cut(F.col("o_totalprice"), EDGES, LABELS).alias("bin"), P.cut(-F.col("o_totalprice"), EDGES, LABELS).alias("none")),
     "SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN '0-20k TRY' WHEN o_totalprice < 30000 THEN '20k-30k TRY' WHEN o_totalprice < 40000 THEN '30k-40k TRY' WHEN o_totalprice < 50000 THEN '40k-50k TRY' WHEN o_totalprice < 75000 THEN '50k-75k TRY' ELSE '75k+ TRY' END AS bin, CASE WHEN o_totalprice <= 0 THEN '0-20k TRY' END AS none FROM orders")
over("lineitem", "p26_capped_group", lambda: ("l_orderkey", "l_linenumber", P.capped_group(F.when(F.col("l_quantity") < 40, F.col("l_quantity"))).alias("g")),
     "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 'Unknown' WHEN l_quantity >= 6 THEN '6+ rooms' ELSE l_quantity::INT::VARCHAR END AS g FROM lineitem")
over("events", "p27_fill_unknown", lambda: ("event_id", P.fill_unknown(F.nullif("event_type", F.lit("click"))).alias("g")),
     "SELECT event_id, CASE WHEN event_type = 'click' THEN 'Unknown' ELSE event_type END AS g FROM events")
over("events", "p34_parse_path_list", lambda: ("event_id", F.array_join(P.parse_path_list(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('", "none"]'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("['"), F.col("event_type"), F.lit("', 'b']"))).when(F.col("event_id") % 4 == 2, F.col("event_type")).otherwise(F.concat(F.lit("["), F.col("event_type")))), "|").alias("paths")),
     "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || '|b' WHEN 2 THEN event_type ELSE '[' || event_type END AS paths FROM events")
over("pages", "p35_path_key", lambda: ("page_id", P.path_key(F.concat(F.lit('"./A\\\\B//'), F.col("url"), F.lit('"'))).alias("k")),
     "SELECT page_id, 'a/b/' || regexp_replace(lower(url), '/+', '/', 'g') AS k FROM pages")
SPEC = "<table><tr><th>Oda</th><td>3 + 1</td></tr><tr><th> </th><td>x</td></tr><tr><th>Oda</th><td>"
over("pages", "p36_spec_table", lambda: ("page_id", F.explode(P.extract_spec_table(F.concat(F.lit(SPEC), F.col("page_id").cast("string"), F.lit("</td></tr></table>"), F.col("html")))).alias("label", "value")),
     rf"""WITH l AS (SELECT page_id, regexp_extract_all('{SPEC}' || page_id || '</td></tr></table>' || html, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS l FROM pages), n AS (SELECT page_id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM l),
 c AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(regexp_extract(r, '(?is)<th[^>]*>(.*?)</th>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label, trim(regexp_replace(regexp_replace(regexp_extract(r, '(?is)<td[^>]*>(.*?)</td>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS value FROM n)
 SELECT page_id, label, arg_max(value, i) AS value FROM c WHERE label <> '' AND value <> '' GROUP BY 1, 2""")
over("pages", "p37_title", lambda: ("page_id", P.extract_title(F.col("html")).alias("title")),
     r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''),
 nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')) AS title FROM pages""")
over("pages", "p38_links", lambda: ("page_id", F.size(P.extract_links(F.col("html"))).cast("long").alias("n"), F.array_join(F.array_sort(P.extract_links(F.col("html"))), "|").alias("links")),
     r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)))::BIGINT AS n, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1))), '|'), '') AS links FROM pages""")
over("pages", "p38_images", lambda: ("page_id", F.array_join(P.extract_images(F.concat(F.lit('<img src="data:x"><img src="https://pics.x/mnresize/1/2/a.jpg"><img data-src="https://pics.x/b.PNG" src="https://pics.x/c.jpg"><img src="https://pics.x/a.jpg">'), F.col("html")), "pics"), "|").alias("images")),
     "SELECT page_id, 'https://pics.x/a.jpg|https://pics.x/b.PNG' AS images FROM pages")


def _specs():
    m = F.create_map(F.lit("Oda Sayısı"), F.concat(F.lit("2 + "), F.col("p_size").cast("string")), F.lit("Brüt / Net M2"), F.concat((F.col("p_size") * 2).cast("string"), F.lit(" m2 / "), F.col("p_size").cast("string"), F.lit(" m2")), F.lit("Eşya Durumu"), F.lit("Eşyalı Değil"))
    back = F.from_json(F.to_json(m), "map<string,string>")
    area = P.parse_area_pair(F.try_element_at(back, F.lit("Brüt / Net M2")))
    return ("p_partkey", P.squeeze(F.try_element_at(back, F.lit("Oda Sayısı"))).alias("rooms"), area["gross"].alias("gross"), area["net"].alias("net"), P.furnished_to_bool(F.try_element_at(back, F.lit("Eşya Durumu"))).alias("furnished"), P.parse_money(F.try_element_at(back, F.lit("Aidat"))).alias("dues"))


over("part", "p39_specs_to_listing", _specs,
     "SELECT p_partkey, '2+' || p_size AS rooms, CASE WHEN p_size * 2 >= 10 THEN (p_size * 2)::DOUBLE END AS gross, CASE WHEN p_size >= 10 THEN p_size::DOUBLE END AS net, false AS furnished, NULL::DOUBLE AS dues FROM part")
over("events", "p40_specs_json", lambda: ("event_id", F.to_json(F.from_json("props", "map<string,string>")).alias("specs")),
     """SELECT event_id, '{"k":"' || (props->>'$.k') || '"}' AS specs FROM events""")
over("documents", "p41_preview", lambda: ("doc_id", P.preview(F.col("text")).alias("line")),
     r"SELECT doc_id, CASE WHEN length(t) > 120 THEN t[1:117] || '...' ELSE t END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
over("pages", "v02_listing_photo", lambda: ("page_id", P.is_listing_photo(F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, ".webp").otherwise(".gif")), "example").alias("photo")),
     r"SELECT page_id, contains(u, 'example') AND regexp_matches(u, '(?i)\.(jpg|jpeg|png|webp)(\?|$)') AS photo FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '.webp' ELSE '.gif' END AS u FROM pages)")
over("pages", "v03_matches_route", lambda: ("page_id", P.matches_route(F.col("url"), ("/en/", "https")).alias("hit")),
     "SELECT page_id, contains(url, '/en/') AND contains(url, 'https') AS hit FROM pages")

COLLAPSED = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
FOLDED = f"lower(regexp_replace(regexp_replace(translate({COLLAPSED}, '{X.MARKED}', '{X.BARE}'), '\\p{{Mn}}', '', 'g'), '[^\\x00-\\x7F]', '', 'g'))"
over("documents", "f01_collapse_ws", lambda: ("doc_id", F.md5(X.collapse_ws(F.col("text"))).alias("h")), f"SELECT doc_id, md5({COLLAPSED}) AS h FROM documents")
over("documents", "f02_strip_marks", lambda: ("doc_id", F.md5(X.strip_marks(X.collapse_ws(F.col("text")))).alias("h")),
     f"SELECT doc_id, md5(strip_accents({COLLAPSED})) AS h FROM documents")
over("documents", "f03_ascii_fold", lambda: ("doc_id", F.md5(X.ascii_fold(F.col("text"))).alias("h")), f"SELECT doc_id, md5({FOLDED}) AS h FROM documents")
over("documents", "f04_tokens", lambda: ("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n"), F.size(X.tokens(F.col("text"), X.STOPWORDS)).cast("long").alias("m")),
     f"""SELECT doc_id, len(t)::BIGINT AS n, len(list_filter(t, lambda x: NOT list_contains({list(X.STOPWORDS)}, x) AND NOT regexp_full_match(x, '[0-9]+')))::BIGINT AS m
 FROM (SELECT doc_id, regexp_extract_all({FOLDED}, '[a-z0-9]{{2,}}') AS t FROM documents)""")


def _clean_sql(phrases, least: int, short: bool) -> str:
    text = f"regexp_replace(lower(regexp_replace(translate({COLLAPSED}, '{X.MARKED}', '{X.BARE}'), '\\p{{Mn}}', '', 'g')), '[^a-z0-9]+', ' ', 'g')"
    for phrase in phrases:
        text = f"regexp_replace({text}, '\\b{phrase}\\b', ' ', 'g')"
    if short:
        text = f"regexp_replace({text}, '\\b[a-z]{{1,2}}\\b', ' ', 'g')"
    return f"SELECT doc_id, md5(CASE WHEN len(string_split(t, ' ')) >= {least} THEN t ELSE '' END) AS h FROM (SELECT doc_id, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS t FROM documents)"


over("documents", "f05_clean_text_v1", lambda: ("doc_id", F.md5(X.clean_text(F.col("text"))).alias("h")), _clean_sql(X.BOILERPLATE_V1, 2, False))
over("documents", "f06_clean_text_v2", lambda: ("doc_id", F.md5(X.clean_text(F.col("text"), "v2", 3)).alias("h")), _clean_sql(X.BOILERPLATE_V2, 3, True))
over("conversations", "f07_combine_text", lambda: ("conv_id", "turn", F.md5(X.combine_text(F.when(F.col("turn") > 0, F.col("role")), F.col("text"))).alias("h")),
     "SELECT conv_id, turn, md5(CASE WHEN turn > 0 THEN role || ' ' || text ELSE text END) AS h FROM conversations")
over("documents", "f08_has_keyword", lambda: ("doc_id", X.has_keyword(F.col("text"), ("trash", "moron", "lux")).alias("hit")),
     f"SELECT doc_id, list_has_any(regexp_extract_all({FOLDED}, '[a-z0-9]{{2,}}'), ['trash', 'moron', 'lux']) AS hit FROM documents")
over("documents", "f09_has_phrase", lambda: ("doc_id", X.has_phrase(F.col("text"), "license, version").alias("hit")), f"SELECT doc_id, contains({FOLDED}, 'license, version') AS hit FROM documents")
over("part", "f15_conjunction", lambda: ("p_partkey", X.join_with_conjunction(F.slice(F.array("p_brand", "p_type", "p_name"), F.lit(1), (F.col("p_partkey") % 4).cast("int"))).alias("line")),
     "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand WHEN 2 THEN p_brand || ' ve ' || p_type ELSE p_brand || ', ' || p_type || ' ve ' || p_name END AS line FROM part")
over("documents", "v11_text_signals", lambda: ("doc_id", (X.collapse_ws(F.col("text")) == "").alias("blank"), X.upper_heavy(F.col("text")).alias("upper"), F.col("text").rlike("<[^>]+>").alias("html"), F.col("text").rlike(r"https?://|www\.").alias("link")),
     r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) = '' AS blank, length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 20 AND length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) >= 0.7::DOUBLE * length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS upper,
 regexp_matches(text, '<[^>]+>') AS html, regexp_matches(text, 'https?://|www\.') AS link FROM documents""")
