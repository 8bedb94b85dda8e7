"""Row-level parsing and normalisation, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor words of the domain.
GROUND_FLOORS = ("giriş katı", "zemin kat", "zemin", "bahçe katı", "yüksek giriş")
OPEN_FLOORS = ("ara kat", "en üst kat", "yarı bodrum", "bodrum", "bodrum ve zemin", "çatı katı", "teras katı", "villa katı")
TOP_FLOOR = ("21 ve üzeri", 21.0)
#: Patterns of telephone numbers, in the order in which they are removed.
PHONES = (
    r"tel:\+?\d+",
    r"\b0?\d{3}\s?\d{3}\s?\d{2}\s?\d{2}\b",
    r"\b\(?0\d{3}\)?\s?\d{3}\s?\d{2}\s?\d{2}\b",
    r"\b\+90\s?\d{3}\s?\d{3}\s?\d{2}\s?\d{2}\b",
)
#: Endings of picture links.
PHOTO = r"(?i)\.(jpg|jpeg|png|webp)(\?|$)"


def or_null(pattern: str, c: Column, group: int = 0) -> Column:
    """The first match of a pattern, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def normalize_url(c: Column) -> Column:
    """A link without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "/+$", "")


def absolutize(c: Column, base: str) -> Column:
    """Rooted links get the base, absolute ones stay, others are null."""
    return F.when(c.startswith("/"), F.concat(F.lit(base), c)).when(c.startswith("http"), c)


def listing_id(number: Column, url: Column, source: str = "source") -> Column:
    """source:number, or source:sha1 of the normalised link."""
    return F.concat(F.lit(f"{source}:"), F.coalesce(F.nullif(number, F.lit("")), F.sha1(normalize_url(url))))


def run_id(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def image_id(listing: Column, index: Column) -> Column:
    return F.concat_ws(":", listing.cast("string"), index.cast("string"))


def parse_money(c: Column) -> Column:
    """Amount with dots for thousands, a decimal comma and currency marks; null if it is none."""
    bare = F.trim(F.replace(F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit("₺"), F.lit("")), F.lit("TL"), F.lit("")))
    return F.replace(bare, F.lit(","), F.lit(".")).try_cast("double")


def parse_int(c: Column) -> Column:
    """The first run of digits once dots are removed."""
    return or_null(r"[0-9]+", F.replace(c, F.lit("."), F.lit(""))).try_cast("int")


def parse_area_pair(c: Column, compat: bool = False) -> Column:
    """struct(gross, net) of areas such as '70 m2 / 60 m2'; values under ten are null.

    By default a number counts if a unit follows. With compat every number
    counts, also the 2 of m2, as in the older data.
    """
    text = F.replace(F.lower(c), F.lit(","), F.lit("."))
    pattern = r"(\d+(?:\.\d+)?)" if compat else r"(\d+(?:\.\d+)?)\s*m"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def part(i: int) -> Column:
        value = F.get(found, i).cast("double")
        return F.when(value >= 10, value)

    return F.struct(part(0).alias("gross"), part(1).alias("net"))


def squeeze(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"\s+", ""), F.lit(""))


def furnished_to_bool(c: Column) -> Column:
    """A negation wins, then the word for furnished, else null."""
    text = F.lower(c)
    return F.when(text.contains("değil") | text.contains("degil"), False).when(text.contains("eşyalı") | text.contains("esyali"), True)


def scrub_pii(c: Column) -> Column:
    """Telephone numbers out, white space to single spaces."""
    for pattern in PHONES:
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def canonical_image_url(c: Column) -> Column:
    """Trimmed, entities decoded, the resize segment dropped."""
    return F.regexp_replace(F.replace(F.trim(c), F.lit("&amp;"), F.lit("&")), r"(?i)/mnresize/\d+/\d+/", "/")


def normalize_string(c: Column) -> Column:
    """White space to single spaces, trimmed; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def room_count(c: Column, cap: int = 12) -> Column:
    """a+b is their sum, else the first number; null over cap."""
    text = normalize_string(c)
    both = r"^(\d+)\s*\+\s*(\d+)$"
    total = F.regexp_extract(text, both, 1).try_cast("double") + F.regexp_extract(text, both, 2).try_cast("double")
    value = F.when(text.rlike(both), total).otherwise(or_null(r"\d+", text).try_cast("double"))
    return F.when(value <= cap, value)


def floor_value(c: Column) -> Column:
    """Ground floors are zero, 'n. kat' is n, the open-ended top is 21; other words are null."""
    text = F.lower(normalize_string(c))
    number = or_null(r"^(\d+)\.\s*kat$", text, 1).try_cast("double")
    return F.when(text.isin(*GROUND_FLOORS), 0.0).when(text.isin(*OPEN_FLOORS), None).when(text == TOP_FLOOR[0], TOP_FLOOR[1]).otherwise(number)


def furnished_flag(c: Column) -> Column:
    """Words for yes and no as two labels, else the normalised text."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "evet", "yes", "1"), "Evet").when(text.isin("false", "hayır", "hayir", "no", "0"), "Hayir").otherwise(normalize_string(c.cast("string")))


def coerce_numeric(c: Column) -> Column:
    """Text with a decimal comma or point as a double; null if it is no number."""
    return F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def tidy_scalar(c: Column) -> Column:
    """A number as text, whole numbers without decimals."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def format_amount(c: Column) -> Column:
    """Rounded half to even, dots between thousands, the currency after it."""
    return F.concat(F.translate(F.format_number(F.bround(c, 0), 0), ",", "."), F.lit(" TL"))


def price_per_area(price: Column, area: Column) -> Column:
    """price / area where the price is not zero and the area positive."""
    return F.when((price != 0) & (area > 0), price / area)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.bround(F.try_divide(width.cast("double"), F.nullif(height.cast("double"), F.lit(0.0))), 4)


def prediction_band(c: Column, share: float = 0.1) -> Column:
    return F.struct(F.round(c * (1 - share)).alias("low"), F.round(c * (1 + share)).alias("high"))


def to_log_target(c: Column) -> Column:
    return F.log1p(c)


def from_log_target(c: Column) -> Column:
    return F.greatest(F.expm1(c), F.lit(0.0))


def cut(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the bin [edge, next edge) that c falls in; the last bin is open; outside is null."""
    out = F.when(c < edges[0], None)
    for upper, label in zip([*edges[1:], None][: len(labels)], labels, strict=True):
        out = out.when(c < upper, label) if upper is not None else out.when(c.isNotNull(), label)
    return out


def capped_group(c: Column, cap: int = 6, suffix: str = "+ rooms") -> Column:
    """A whole number as text, the cap and more as one group, null as Unknown."""
    n = c.cast("int")
    return F.when(n.isNull(), "Unknown").when(n >= cap, f"{cap}{suffix}").otherwise(n.cast("string"))


def fill_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("Unknown"))


def parse_path_list(c: Column) -> Column:
    """Paths in a JSON array, a bracketed list with single quotes, or a bare text; words for nothing are dropped."""
    text = F.trim(c)
    listed = F.coalesce(F.from_json(text, "array<string>"), F.from_json(F.translate(text, "'", '"'), "array<string>"))
    items = F.when(text.startswith("["), listed).otherwise(F.array(text))
    return F.filter(F.coalesce(items, F.array(text)), lambda p: p.isNotNull() & ~F.lower(F.trim(p)).isin("", "none", "null", "nan"))


def path_key(c: Column) -> Column:
    """A path for comparison: no quotes, forward slashes, none doubled, no leading ./, lower case."""
    bare = F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(bare, "\\", "/"), "/+", "/"), r"^(\./)+", ""))


def preview(c: Column, n: int = 120) -> Column:
    """One line, cut at n characters with dots."""
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n - 3), F.lit("..."))).otherwise(line)


def is_listing_photo(c: Column, host: str) -> Column:
    return F.coalesce(c.contains(host) & c.rlike(PHOTO), F.lit(False))


def matches_route(c: Column, tokens: Sequence[str]) -> Column:
    """Every token is in the link."""
    out = F.lit(True)
    for token in tokens:
        out = out & c.contains(token)
    return F.coalesce(out, F.lit(False))


def extract_links(html: Column) -> Column:
    """href values in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)))


def extract_images(html: Column, host: str) -> Column:
    """Photo links: data-src, else src, of img tags, canonical, without inline data, in first-seen order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    links = F.transform(
        tags,
        lambda t: F.coalesce(or_null(r'(?i)\sdata-src="([^"]*)"', t, 1), or_null(r'(?i)\ssrc="([^"]*)"', t, 1)),
    )
    clean = F.transform(F.filter(links, lambda x: x.isNotNull() & ~x.startswith("data:")), canonical_image_url)
    return F.array_distinct(F.filter(clean, lambda x: is_listing_photo(x, host)))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def extract_spec_table(html: Column) -> Column:
    """Map of the th and td texts of table rows; blank ones are left out, the last of a repeated label stays."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    pairs = F.transform(
        rows,
        lambda r: F.struct(
            strip_tags(F.regexp_extract(r, r"(?is)<th[^>]*>(.*?)</th>", 1)).alias("key"),
            strip_tags(F.regexp_extract(r, r"(?is)<td[^>]*>(.*?)</td>", 1)).alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda o: o["key"] == p["key"]))
    return F.map_from_entries(last)


def extract_title(html: Column) -> Column:
    """Text of the first h1, else of title."""
    first = F.nullif(strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))
    return F.coalesce(first, F.nullif(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))
