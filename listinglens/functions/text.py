"""Text functions, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words, boilerplate and keyword groups of the domain, folded to ASCII.
STOPWORDS = (
    "acik ama ancak art ayni az baz beri bir biraz biz bu buna bunun cok da daha de degil den en gibi hem her icin ile ise kadar kar "
    "olan olarak olup sonra sadece seklinde siz su tum uzere ve veya ya yani"
).split()
BOILERPLATE_V1 = ("telefonu goster", "detayli bilgi", "arayiniz", "gayrimenkul", "emlak", "kahve icmeye")
BOILERPLATE_V2 = (
    "telefonu goster", "detayli bilgi", "detaylar icin", "arayiniz", "arayin", "iletisime geciniz", "gayrimenkul",
    "emlak", "kahve icmeye", "yetkili", "danisman", "portfoy", "realty",
)
SIGNAL_PHRASES = ("telefonu goster", "detayli bilgi", "arayiniz", "gayrimenkul", "kahve icmeye", "tapu", "kredi islemleri")
LUXURY_WORDS = ("ebeveyn", "guvenlik", "lux", "luks", "manzarali", "rezidans", "residence", "teras", "ultra")
KEYWORDS = {
    "esyali": ("esyali",), "luks": ("luks", "lux"), "sifir": ("sifir",), "manzarali": ("manzarali",), "otopark": ("otopark",),
    "guvenlik": ("guvenlik",), "teras": ("teras",), "balkon": ("balkon",), "ankastre": ("ankastre",), "ebeveyn": ("ebeveyn",),
    "site": ("site",), "asansor": ("asansor",), "metro": ("metro",),
}


def fold_table(last: int = 0x17F) -> tuple[str, str]:
    """Latin letters with marks and their bare letters, derived from Unicode decompositions."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, last + 1) if len(unicodedata.normalize("NFKD", chr(i))) == 2 and unicodedata.combining(unicodedata.normalize("NFKD", chr(i))[1])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = fold_table()


def collapse_ws(c: Column) -> Column:
    """Null as empty, white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def strip_marks(c: Column, dotless: str = "compat") -> Column:
    """Latin letters without their marks; dotless='fold' also turns the dotless i into i."""
    bare = F.regexp_replace(F.translate(c, MARKED, BARE), r"\p{Mn}", "")
    return F.translate(bare, "ı", "i") if dotless == "fold" else bare


def ascii_fold(c: Column) -> Column:
    """Collapsed, without marks, without what is not ASCII, lower case."""
    return F.lower(F.regexp_replace(strip_marks(collapse_ws(c)), r"[^\x00-\x7F]", ""))


def tokens(c: Column, stop: Sequence[str] = ()) -> Column:
    """Runs of two or more of a-z and 0-9 of the folded text; with stop words, without those and without numbers."""
    found = F.regexp_extract_all(ascii_fold(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    if not stop:
        return found
    return F.filter(found, lambda t: ~t.isin(*stop) & ~t.rlike("^[0-9]+$"))


def clean_text(c: Column, rules: str = "v1", least: int = 2, dotless: str = "compat") -> Column:
    """Lower case letters and digits without boilerplate; '' under so many words. v2 also drops words of one or two letters."""
    text = F.regexp_replace(F.lower(strip_marks(collapse_ws(c), dotless)), "[^a-z0-9]+", " ")
    phrases = "|".join(BOILERPLATE_V1 if rules == "v1" else BOILERPLATE_V2)
    text = F.regexp_replace(text, rf"\b(?:{phrases})\b", " ")
    if rules != "v1":
        text = F.regexp_replace(text, r"\b[a-z]{1,2}\b", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.size(F.split(text, " ")) >= least, text).otherwise("")


def combine_text(first: Column, second: Column) -> Column:
    """Both texts with a space between, or the one that is not empty."""
    return F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def has_keyword(c: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens(c), F.array(*map(F.lit, words)))


def has_phrase(c: Column, phrase: str) -> Column:
    return ascii_fold(c).contains(phrase)


def upper_heavy(c: Column, share: float = 0.7, least: int = 20) -> Column:
    """At least so many letters, so large a share of them capitals."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    return F.coalesce((letters >= least) & (capitals >= share * letters), F.lit(False))


def join_with_conjunction(items: Column, word: str = "ve") -> Column:
    """'a', 'a ve b', 'a, b ve c'."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, 0)).otherwise(
        F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(f" {word} "), F.element_at(items, -1))
    )
