"""The full report of a scored listing: price, interval, factors, comparables and confidence in one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.session import rounded


def gather(rows: DataFrame, key: str, order: str, columns: Sequence[str], out: str) -> DataFrame:
    """One JSON list of a key's few rows, such as its first factors, in order."""
    cells = F.struct(order, *columns)
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(cells))).alias(out))


def score_report(key: str, scored: DataFrame, error: float, factors: DataFrame, similar: DataFrame) -> DataFrame:
    """A row for each key of `scored`: prediction, low and high, factors, similar, confidence, label and reasons.

    scored has the prediction `full` and the columns of score_confidence; error
    is the mean error on rows that the model has not seen. factors (place,
    group, sign, score) and similar (place, listing_id, score, reasons) have a
    few rows for each key, or none.
    """
    price = F.greatest(F.col("full"), F.lit(0.0))
    rows = scored.select(
        key, rounded(price, 2).alias("prediction"), rounded(F.greatest(price - error, F.lit(0.0)), 2).alias("low"), rounded(price + error, 2).alias("high"),
        "confidence", "label", F.array_join("reasons", "|").alias("why"),
    )
    rows = rows.join(gather(factors, key, "place", ["group", "sign", "score"], "factors"), key, "left")
    return rows.join(gather(similar, key, "place", ["listing_id", "score", "reasons"], "similar"), key, "left")
