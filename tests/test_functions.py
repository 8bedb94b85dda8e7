"""Parsing and text functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from listinglens.functions import parse as P
from listinglens.functions import text as X


def values(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", build(F.col("c")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("build", "rows", "expected"),
    [
        (P.normalize_url, ["https://a.b/c/?x=1#y", "https://a.b/c", None], ["https://a.b/c", "https://a.b/c", None]),
        (P.parse_money, ["29.000 TL", "1.234,5 ₺", "x", "", None], [29000.0, 1234.5, None, None, None]),
        (P.parse_int, ["1.250 gün", "yok", None], [1250, None, None]),
        (P.room_count, ["3+1", "9+4", "10+2", "Stüdyo", "5 oda", " ", None], [4.0, None, 12.0, None, 5.0, None, None]),
        (P.floor_value, ["Zemin Kat", "ara kat", "14. Kat", "21 ve üzeri", "Kot 1", None], [0.0, None, 14.0, 21.0, None, None]),
        (P.furnished_to_bool, ["Eşyalı değil", "eşyalı", "?", None], [False, True, None, None]),
        (P.furnished_flag, ["evet", "0", " a  b ", None], ["Evet", "Hayir", "a b", None]),
        (P.scrub_pii, ["ara tel:+905321 lütfen", "0532 123 45 67!", "x +90 532 123 45 67"], ["ara lütfen", "!", "x +90"]),
        (P.canonical_image_url, [" https://x/mnresize/132/74/ds/a.jpg?a&amp;b "], ["https://x/ds/a.jpg?a&b"]),
        (P.path_key, ['"./A\\B//c.JPG"', "a/b/c.jpg"], ["a/b/c.jpg", "a/b/c.jpg"]),
        (P.preview, ["a\n b", "x" * 130], ["a b", "x" * 117 + "..."]),
        (lambda c: P.parse_area_pair(c)["net"], ["70 m2 / 60 m2", "70 m2", "70 m2 / 5 m2", None], [60.0, None, None, None]),
        (lambda c: P.parse_area_pair(c, compat=True)["net"], ["70 m2 / 60 m2"], [None]),
        (X.clean_text, ["Telefonu göster SATILIK ev!", "emlak", None], ["satilik ev", "", ""]),
        (X.ascii_fold, ["Çok  GÜZEL ev", "sıfır", None], ["cok guzel ev", "sfr", ""]),
    ],
)
def test_function(spark, build, rows, expected):
    assert values(spark, rows, build) == expected


def test_path_lists(spark):
    rows = ['["a", null, "b"]', "['a', 'b']", "a.jpg", "[broken", "none", None]
    assert values(spark, rows, P.parse_path_list) == [["a", "b"], ["a", "b"], ["a.jpg"], ["[broken"], [], []]


def test_bins_are_closed_on_the_left(spark):
    cut = values(spark, [-1.0, 0.0, 19999.0, 20000.0, 1e9, None], lambda c: P.cut(c, (0, 20000), ("low", "high")), "double")
    assert cut == [None, "low", "low", "high", "high", None]


def test_spec_table_keeps_the_last_label(spark):
    html = "<table><tr><th>a</th><td>1</td></tr><tr><th>a</th><td><b>2</b></td></tr><tr><th></th><td>3</td></tr></table>"
    assert values(spark, [html], P.extract_spec_table) == [{"a": "2"}]


def test_conjunction(spark):
    rows = [[], ["a"], ["a", "b"], ["a", "b", "c"]]
    assert values(spark, rows, X.join_with_conjunction, "array<string>") == ["", "a", "a ve b", "a, b ve c"]
