"""Roles of columns and tables, and profiles of tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.operators import stats as S

#: Column names that hint at a role, in order of priority.
TARGETS = ("price_try", "price", "rent", "o_totalprice", "p_retailprice", "l_extendedprice", "c_acctbal", "value")
TEXT_HINTS = ("title", "description", "text", "html", "comment")
PATH_HINTS, ID_HINTS = ("path", "image", "file"), ("_id", "key", "id")
#: Mean length of the values from which a column is text.
TEXT_LENGTH = 80


def detect_roles(df: DataFrame) -> DataFrame:
    """Rows (field, kind, role): id, target, text, path, link or other, from names and all values that are not null, in one scan."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    target = next((t for t in TARGETS if t in df.columns), None)
    facts = df.agg(
        *[F.avg(F.length(F.col(c))).alias(f"len_{c}") for c in texts],
        *[F.avg(F.col(c).rlike("^https?://").cast("double")).alias(f"url_{c}") for c in texts],
    ).first() if texts else None
    rows = []
    for c, kind in df.dtypes:
        low = c.lower()
        if c == target:
            role = "target"
        elif low.endswith(ID_HINTS):
            role = "id"
        elif c in texts and (facts[f"url_{c}"] or 0) > 0.5:
            role = "link"
        elif c in texts and any(h in low for h in PATH_HINTS):
            role = "path"
        elif c in texts and (low in TEXT_HINTS or (facts[f"len_{c}"] or 0) >= TEXT_LENGTH):
            role = "text"
        else:
            role = "other"
        rows.append((c, kind, role))
    return df.sparkSession.createDataFrame(rows, "field string, kind string, role string")


def profile_table(df: DataFrame, name: str) -> DataFrame:
    """One row: shape, ids, nulls, duplicates, target and text columns."""
    roles = detect_roles(df).agg(
        F.sum((F.col("role") == "id").cast("long")).alias("ids"),
        F.max(F.when(F.col("role") == "target", F.col("field"))).alias("target"),
        F.sum((F.col("role") == "text").cast("long")).alias("texts"),
    )
    shape = df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"))
    missing = S.missing_counts(df).agg(F.sum("missing").alias("missing"))
    return shape.crossJoin(roles).crossJoin(missing).crossJoin(S.duplicate_count(df)).withColumn("name", F.lit(name))  # one row each


def classify_table(profiles: DataFrame) -> DataFrame:
    """profiles with `role` and `trainable`, by a cascade of rules."""
    role = (
        F.when(F.col("n_rows") == 0, "empty").when(F.col("target").isNotNull() & (F.col("texts") > 0), "multimodal").when(F.col("target").isNotNull(), "tabular")
        .when(F.col("texts") > 0, "text").otherwise("reference")
    )
    return profiles.withColumn("role", role).withColumn("trainable", F.col("target").isNotNull() & (F.col("n_rows") >= 100))


def choose_primary(profiles: DataFrame) -> DataFrame:
    """The largest trainable table of each role."""
    return profiles.where("trainable").groupBy("role").agg(F.max_by("name", F.struct("n_rows", "name")).alias("name"))


def recommend(summary: DataFrame, rules: Mapping[str, tuple[float, str]]) -> DataFrame:
    """Rows (signal, message) of the signals whose share reaches the rule's threshold."""
    message = None
    for signal, (least, text) in rules.items():
        ok = (F.col("signal") == signal) & (F.col("share") >= least)
        message = F.when(ok, text) if message is None else message.when(ok, text)
    return summary.withColumn("message", message).where("message is not null").select("signal", "message")
