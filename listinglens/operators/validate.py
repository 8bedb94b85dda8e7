"""Validation of listings: presence, outliers, readiness, reasons, constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.functions.parse import path_key, price_per_area

#: Bounds of plausible listings.
PRICE, AREA, RATIO = (1000.0, 500000.0), (10.0, 1000.0), (100.0, 100000.0)
LEAST_DESCRIPTION, LEAST_IMAGES = 20, 3
UPLOAD_SUFFIXES, UPLOAD_TYPES, UPLOAD_BYTES, UPLOAD_COUNT = ("jpg", "jpeg", "png"), ("image/jpeg", "image/png"), 10 * 1024 * 1024, 16


def drop_missing_target(df: DataFrame, y: str) -> DataFrame:
    return df.where(F.col(y).isNotNull())


def _outside(c: Column, bounds: tuple[float, float]) -> Column:
    return F.coalesce((c < bounds[0]) | (c > bounds[1]), F.lit(False))


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def presence_flags(df: DataFrame) -> DataFrame:
    """has_* columns; df has price, city, district, rooms, m2_gross, m2_net, description, valid_images."""
    area = F.when(F.col("m2_net") >= 10, F.col("m2_net")).otherwise(F.col("m2_gross"))
    given = F.coalesce(F.col("city"), F.lit("")) != ""
    return df.withColumns(
        {
            "m2_value": area,
            "has_price": _known(F.col("price") > 0),
            "has_location": given & (F.coalesce(F.col("district"), F.lit("")) != ""),
            "has_rooms": F.coalesce(F.col("rooms"), F.lit("")) != "",
            "has_m2": _known(area > 0),
            "has_description": _known(F.length(F.trim("description")) >= LEAST_DESCRIPTION),
            "has_min_images": _known(F.col("valid_images") >= LEAST_IMAGES),
        }
    )


def outlier_flags(df: DataFrame, price=PRICE, area=AREA, ratio=RATIO) -> DataFrame:
    """is_outlier_* and price_per_m2; null values are no outliers."""
    per = price_per_area(F.col("price"), F.col("m2_value"))
    return df.withColumns(
        {
            "price_per_m2": per,
            "is_outlier_price": _outside(F.col("price"), price),
            "is_outlier_m2": _outside(F.col("m2_value"), area),
            "is_outlier_price_per_m2": _outside(per, ratio),
        }
    )


def readiness_flags(df: DataFrame) -> DataFrame:
    present = F.col("has_price") & F.col("has_location") & F.col("has_rooms") & F.col("has_m2")
    ml = present & ~F.col("is_outlier_price") & ~F.col("is_outlier_m2") & ~F.col("is_outlier_price_per_m2")
    dl = F.col("has_price") & F.col("has_location") & F.col("has_min_images")
    return df.withColumns({"ready_ml": ml, "ready_dl": dl, "ready_multimodal": ml & dl & F.col("has_description")})


def reject_reason() -> Column:
    """The reasons in order, joined by bars; null if there is none."""
    lacking = {
        "has_price": "missing_price",
        "has_location": "missing_location",
        "has_rooms": "missing_rooms",
        "has_m2": "missing_m2",
        "has_description": "description_too_short",
        "has_min_images": "not_enough_valid_images",
    }
    parts = [F.when(~F.col(flag), reason) for flag, reason in lacking.items()]
    parts += [F.when(F.col(f"is_{reason}"), reason) for reason in ("outlier_price", "outlier_m2", "outlier_price_per_m2")]
    return F.nullif(F.concat_ws("|", *parts), F.lit(""))


def validate(listings: DataFrame, images: DataFrame, key: str = "listing_id") -> DataFrame:
    """One row per listing with all flags; images has the key and is_valid, and is counted before the join."""
    counts = images.groupBy(key).agg(F.count_if("is_valid").alias("valid_images"), F.count("*").alias("all_images"))
    joined = listings.join(counts, key, "left").fillna(0, ["valid_images", "all_images"])
    flagged = readiness_flags(outlier_flags(presence_flags(joined)))
    whole = (F.col("all_images") > 0) & (F.col("all_images") == F.col("valid_images"))
    return flagged.withColumns({"all_images_valid": whole, "reject_reason": reject_reason()})


def check_constraints(df: DataFrame, rules: Mapping[str, Sequence[tuple[Column, str]]]) -> DataFrame:
    """df with `errors`: the messages of the conditions that do not hold, field by field; a null condition does not hold."""
    checks = [F.when(~_known(ok), F.lit(f"{field}: {message}")) for field, pairs in rules.items() for ok, message in pairs]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def check_assets(df: DataFrame, key: str, order: str) -> DataFrame:
    """Uploads (name, mime, bytes) with `error` and `used`: the first UPLOAD_COUNT of a key are used if they have no error."""
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    error = (
        F.when(~suffix.isin(*UPLOAD_SUFFIXES), "suffix").when(~F.col("mime").isin(*UPLOAD_TYPES), "type").when(F.col("bytes") > UPLOAD_BYTES, "size")
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("error", error).withColumn("rank", rank).withColumn("used", (F.col("rank") <= UPLOAD_COUNT) & F.col("error").isNull())


def having_min(grouped: DataFrame, k: int = 5, n: str = "n") -> DataFrame:
    return grouped.where(F.col(n) >= k)


def valid_paths(paths: DataFrame, manifest: DataFrame, column: str = "path") -> DataFrame:
    """paths with `valid`: a normalised form of the path is in the manifest (column path)."""
    known = manifest.select(path_key(F.col("path")).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    tried = paths.withColumn("_key", path_key(F.col(column)))
    return tried.join(known, "_key", "left").withColumn("valid", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")
