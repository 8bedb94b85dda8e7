"""Confidence of a predicted price: five scores, their weighted mean, a label and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglens.operators.quantiles import exact_quantiles

#: Weights of the five scores and the points of each presence check.
WEIGHTS = {"completeness": 0.25, "visual": 0.20, "location": 0.20, "price_range": 0.20, "stability": 0.15}
POINTS = {"city": 10, "district": 12, "neighborhood": 12, "rooms": 14, "m2_gross": 16, "title": 12, "description": 14, "clean_text": 6, "images": 4}
LABELS = ((80, "Yüksek"), (60, "Orta"), (0, "Düşük"))
#: Fixed values: (positive, neutral, negative) reasons of each score, and the one where none holds.
REASONS = {
    "completeness": ("İlan bilgileri büyük ölçüde eksiksiz paylaşıldı.", "Temel ilan bilgileri büyük ölçüde tamamlandı.", "Bazı temel ilan bilgileri eksik olduğu için güven seviyesi düşüyor."),
    "visual": ("Yeterli sayıda fotoğraf analiz edildi.", "Fotoğraf sayısı orta seviyede olduğu için görsel sinyal kısmen destek sağlıyor.", "Fotoğraf sayısı sınırlı olduğu için görsel sinyal zayıf kalıyor."),
    "location": ("Konum bilgileri eğitim verisinde güçlü temsil ediliyor.", "Seçilen ilçe ve mahalle eğitim verisinde yeterli örnek içeriyor.", "Seçilen konum eğitim verisinde daha sınırlı temsil ediliyor."),
    "price_range": ("Tahmin fiyatı eğitim verisindeki tipik aralıkta.", "Tahmin fiyatı eğitim verisindeki geniş aralığa uyumlu görünüyor.", "Tahmin fiyatı eğitim verisindeki tipik aralığın dışında kalıyor."),
    "stability": ("Metin ve fotoğraf katkıları çıkarıldığında sonuç görece stabil kalıyor.", "Modaliteler arası katkı dengeli görünüyor.", "Metin veya fotoğraf katkısı çıkarıldığında sonuç belirgin değişiyor."),
}
DEFAULT_REASON = "Girilen bilgiler veri setindeki benzer örneklerle kısmen uyumlu görünüyor."


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.bround(c), F.lit(float(low))), F.lit(float(high))).cast("int")


def _given(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def completeness() -> Column:
    """Points of the columns city to images that are filled well enough."""
    checks = {n: _given(F.col(n)) for n in ("city", "district", "neighborhood", "rooms")}
    checks |= {
        "m2_gross": F.coalesce(F.col("m2_gross") > 0, F.lit(False)),
        "title": F.coalesce(F.length(F.trim("title")) >= 5, F.lit(False)),
        "description": F.coalesce(F.length(F.trim("description")) >= 20, F.lit(False)),
        "clean_text": _given(F.col("clean_text")),
        "images": F.coalesce(F.col("images") > 0, F.lit(False)),
    }
    out = F.lit(0)
    for name, ok in checks.items():
        out = out + F.when(ok, POINTS[name]).otherwise(0)
    return out.cast("int")


def visual_score(n: Column) -> Column:
    value = (
        F.when(n <= 0, 20.0).when(n <= 3, 35 + n * 10).when(n <= 8, 70 + (n - 4) * 4).when(n <= 16, F.least(F.lit(98.0), 88 + (n - 9) * 1.5)).otherwise(98.0)
    )
    return F.floor(value).cast("int")


def density_score(district: Column, n_d: Column, ref_d: Column, neighborhood: Column, n_n: Column, ref_n: Column) -> Column:
    def part(key: Column, n: Column, ref: Column) -> Column:
        return F.when(_given(key), 15 + 85 * F.sqrt(F.least(n / F.greatest(ref, F.lit(1.0)), F.lit(1.0)))).otherwise(10.0)

    d, b = part(district, n_d, ref_d), part(neighborhood, n_n, ref_n)
    both = _given(district) & _given(neighborhood)
    score = F.when(both, 0.4 * d + 0.6 * b).when(_given(district) | _given(neighborhood), F.greatest(d, b)).otherwise(10.0)
    return _clip(score, 0, 100)


def price_score(price: Column, p05: Column, p95: Column) -> Column:
    away = F.greatest(p05 - price, price - p95, F.lit(0.0)) / F.greatest(p95 - p05, F.lit(1.0))
    return F.when(price.between(p05, p95), 100).otherwise(_clip(100 - 65 * F.least(away, F.lit(1.25)), 20, 100)).cast("int")


def stability_score(full: Column, no_text: Column, no_image: Column, tabular: Column) -> Column:
    def change(c: Column) -> Column:
        return F.abs(F.coalesce(c, full) - full) / F.abs(full)

    score = _clip(100 - 180 * (0.4 * change(no_text) + 0.4 * change(no_image) + 0.2 * change(tabular)), 20, 100)
    return F.when(F.coalesce(F.abs(full) < 1e-6, F.lit(True)), 60).otherwise(score).cast("int")


def confidence() -> Column:
    """The weighted mean of the score columns, rounded half to even."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.col(name) * weight
    return _clip(total, 0, 100)


def label(score: Column) -> Column:
    return F.when(score >= LABELS[0][0], LABELS[0][1]).when(score >= LABELS[1][0], LABELS[1][1]).otherwise(LABELS[2][1])


def confidence_reasons(label_of: Column) -> Column:
    """At most three reasons from the score columns, by the rules of the label.

    High: the best scores first, positive from 80, neutral from 68. Low: the
    worst first, negative to 60, neutral to 72. Between: one strength, then two
    limits to 68, then further strengths.
    """
    parts = F.array(
        *[
            F.struct(F.col(n).alias("score"), F.lit(w).alias("weight"), *[F.lit(t).alias(k) for k, t in zip(("pos", "neu", "neg"), REASONS[n], strict=True)])
            for n, w in WEIGHTS.items()
        ]
    )

    def by(sign: int):
        def compare(a: Column, b: Column) -> Column:
            less, more = F.lit(-sign), F.lit(sign)
            return F.when(a["score"] < b["score"], less).when(a["score"] > b["score"], more).when(a["weight"] < b["weight"], 1).when(a["weight"] > b["weight"], -1).otherwise(0)

        return F.array_sort(parts, compare)

    best, worst = by(-1), by(1)

    def told(rows: Column, choose) -> Column:
        return F.filter(F.transform(rows, choose), lambda t: t.isNotNull())

    high = told(best, lambda r: F.when(r["score"] >= 80, r["pos"]).when(r["score"] >= 68, r["neu"]))
    low = told(worst, lambda r: F.when(r["score"] <= 60, r["neg"]).when(r["score"] <= 72, r["neu"]))
    strengths = told(best, lambda r: F.when(r["score"] >= 78, r["pos"]).when(r["score"] >= 68, r["neu"]))
    limits = told(worst, lambda r: F.when(r["score"] <= 68, r["neg"]))
    middle = F.concat(F.slice(strengths, 1, 1), F.slice(limits, 1, 2), F.slice(strengths, 2, 9))
    chosen = F.when(label_of == LABELS[0][1], high).when(label_of == LABELS[2][1], low).otherwise(middle)
    return F.when(F.size(chosen) == 0, F.array(F.lit(DEFAULT_REASON))).otherwise(F.slice(F.array_distinct(chosen), 1, 3))


def confidence_profile(df: DataFrame, district: str, neighborhood: str, price: str) -> DataFrame:
    """One row: price bounds and the reference counts of both location levels."""

    def reference(column: str, name: str) -> DataFrame:
        counts = df.where(F.col(column).isNotNull()).groupBy(F.trim(F.col(column).cast("string"))).agg(F.count("*").alias("n"))
        return counts.agg(F.greatest(F.percentile("n", F.lit(0.95)), F.lit(1.0)).alias(name))

    found = exact_quantiles(df, [price], (0.05, 0.95))
    bounds = found.select((F.col("n") + F.col("missing")).alias("n_rows"), F.get("quantiles", 0).alias("p05"), F.get("quantiles", 1).alias("p95"))
    return bounds.crossJoin(reference(district, "ref_d")).crossJoin(reference(neighborhood, "ref_n"))  # one row each


def score_confidence(df: DataFrame, history: DataFrame) -> DataFrame:
    """df with the five scores, confidence, label and reasons.

    df has the columns of POINTS, price and the four predictions (full,
    no_text, no_image, tabular); history has district, neighborhood, price.
    """
    profile = confidence_profile(history, "district", "neighborhood", "price")
    counts = {
        level: history.where(F.col(level).isNotNull()).groupBy(F.trim(F.col(level)).alias(level)).agg(F.count("*").alias(f"n_{level}"))
        for level in ("district", "neighborhood")
    }
    rows = df.crossJoin(F.broadcast(profile))  # one row
    for level, table in counts.items():
        table = table.withColumnRenamed(level, f"{level}_key")
        rows = rows.join(table, F.trim(F.col(level)) == F.col(f"{level}_key"), "left").drop(f"{level}_key").fillna(0, [f"n_{level}"])
    scores = {
        "completeness": completeness(),
        "visual": visual_score(F.col("images")),
        "location": density_score(F.col("district"), F.col("n_district"), F.col("ref_d"), F.col("neighborhood"), F.col("n_neighborhood"), F.col("ref_n")),
        "price_range": price_score(F.col("price"), F.col("p05"), F.col("p95")),
        "stability": stability_score(F.col("full"), F.col("no_text"), F.col("no_image"), F.col("tabular")),
    }
    rows = rows.withColumns(scores).withColumn("confidence", confidence())
    rows = rows.withColumn("label", label(F.col("confidence")))
    return rows.withColumn("reasons", confidence_reasons(F.col("label")))
