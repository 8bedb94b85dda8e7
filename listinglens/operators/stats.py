"""Metrics, error summaries, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.operators.quantiles import exact_quantiles
from listinglens.session import Scratch, rounded

#: Actual values below this size have no relative error.
LEAST_ACTUAL = 1e-8


def metric_columns(y: Column, p: Column) -> dict[str, Column]:
    """MAE, RMSE, R2 and MAPE as aggregates over one pass."""
    error = y - p
    sst = F.var_pop(y) * F.count(y)
    ape = F.when(F.abs(y) >= LEAST_ACTUAL, F.abs(error) / F.abs(y) * 100)
    return {
        "mae": rounded(F.avg(F.abs(error))),
        "rmse": rounded(F.sqrt(F.avg(error * error))),
        "r2": rounded(1 - F.try_divide(F.sum(error * error), F.nullif(sst, F.lit(0.0))), 6),
        "mape": rounded(F.avg(ape)),
    }


def metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    columns = [c.alias(n) for n, c in metric_columns(F.col(y), F.col(p)).items()]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *columns)


def add_error_columns(df: DataFrame, actual: str, predictions: Mapping[str, str], base: str | None = None) -> DataFrame:
    """residual, abs error and APE of each named prediction, and the gain in abs error over the base model."""
    y, new = F.col(actual), {}
    for name, column in predictions.items():
        residual = y - F.col(column)
        new[f"{name}_residual"] = residual
        new[f"{name}_abs_error"] = F.abs(residual)
        new[f"{name}_ape_pct"] = F.abs(residual) / F.greatest(y, F.lit(LEAST_ACTUAL)) * 100
    out = df.withColumns(new)
    if base:
        gains = {f"{n}_gain": F.col(f"{base}_abs_error") - F.col(f"{n}_abs_error") for n in predictions if n != base}
        out = out.withColumns(gains)
    return out


def error_by_group(df: DataFrame, group: str, actual: str, p: str) -> DataFrame:
    """n, mean actual, MAE and MAPE of each group, Unknown for null; worst first."""
    y, error = F.col(actual), F.abs(F.col(actual) - F.col(p))
    rows = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("Unknown")).alias("group")).agg(
        F.count("*").alias("n"),
        rounded(F.avg(y)).alias("mean_actual"),
        rounded(F.avg(error)).alias("mae"),
        rounded(F.avg(error / F.greatest(y, F.lit(LEAST_ACTUAL)) * 100)).alias("mape"),
    )
    return rows.orderBy(F.desc("mae"), F.desc("n"), "group")


def improvement_by_group(df: DataFrame, group: str, actual: str, ref: str, target: str, least: int = 5) -> DataFrame:
    y = F.col(actual)

    def mae(c: str) -> Column:
        return F.avg(F.abs(y - F.col(c)))

    def mape(c: str) -> Column:
        return F.avg(F.abs(y - F.col(c)) / F.greatest(y, F.lit(LEAST_ACTUAL)) * 100)

    rows = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("Unknown")).alias("group")).agg(
        F.count("*").alias("n"),
        rounded(mae(ref)).alias("ref_mae"),
        rounded(mae(target)).alias("target_mae"),
        rounded(mae(ref) - mae(target)).alias("mae_gain"),
        rounded(mape(ref) - mape(target)).alias("mape_gain"),
    )
    return rows.where(F.col("n") >= least)


def in_bin_order(summary: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows of a group summary whose group is a bin label, with the bin's place; others are dropped."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("group"))
    return summary.withColumn("bin", place).where(F.col("bin") > 0).orderBy("bin")


def segment_rows(df: DataFrame, segments: Mapping[str, Column]) -> DataFrame:
    """One row for each row and segment that it is in, in one pass; an empty segment has none."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in segments.items()]))
    return df.withColumn("segment", F.explode(names))


def segment_metrics(df: DataFrame, segments: Mapping[str, Column], actual: str, ref: str, target: str) -> DataFrame:
    y = F.col(actual)
    a, b = metric_columns(y, F.col(ref)), metric_columns(y, F.col(target))
    rows = segment_rows(df, segments).groupBy("segment").agg(
        F.count("*").alias("n"), *[c.alias(f"ref_{k}") for k, c in a.items()], *[c.alias(f"target_{k}") for k, c in b.items()]
    )
    return rows.withColumn("mae_gain", rounded(F.col("ref_mae") - F.col("target_mae")))


def residual_profile(df: DataFrame, segments: Mapping[str, Column], actual: str, p: str) -> DataFrame:
    r = F.col(actual) - F.col(p)
    rows = segment_rows(df, segments)
    medians = exact_quantiles(rows, {"r": r}, (0.5,), ["segment"]).select("segment", rounded(F.get("quantiles", 0)).alias("median"))
    facts = rows.groupBy("segment").agg(
        F.count("*").alias("n"),
        rounded(F.avg(r)).alias("mean"),
        rounded(F.stddev_pop(r)).alias("std"),
        rounded(F.avg(F.abs(r))).alias("mae"),
        rounded(F.avg((r > 0).cast("double")), 6).alias("under_share"),
        rounded(F.avg((r < 0).cast("double")), 6).alias("over_share"),
    )
    return facts.join(medians, "segment").select("segment", "n", "mean", "median", "std", "mae", "under_share", "over_share")


def error_summary(df: DataFrame, actual: str, p: str) -> DataFrame:
    y, q = F.col(actual), F.col(p)
    error = F.abs(y - q)
    means = df.agg(rounded(F.avg(y)).alias("mean_actual"), rounded(F.avg(q)).alias("mean_predicted"), rounded(F.avg(q - y)).alias("mean_signed"))
    shares = (0.5, 0.9, 0.95)
    found = exact_quantiles(df, {"error": error}, shares).select(*[rounded(F.get("quantiles", i)).alias(f"p{int(x * 100)}") for i, x in enumerate(shares)])
    return means.crossJoin(F.broadcast(found))  # one row


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, min, max, median, p05, p95 and nulls of each column."""
    found = exact_quantiles(df, columns, (0.5, 0.05, 0.95))
    cells = [rounded(c).alias(n) for n, c in (("min", F.col("low")), ("max", F.col("high")), *((n, F.get("quantiles", i)) for i, n in enumerate(("median", "p05", "p95"))))]
    return found.select("field", *cells, "missing")


def length_profile(df: DataFrame, column: str) -> DataFrame:
    text = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " "))
    measured = df.select(F.length(text).alias("chars"), F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).alias("words"))
    out = [F.count("*").alias("n"), F.count_if(F.col("chars") == 0).alias("blank")]
    for c in ("chars", "words"):
        out += [rounded(F.avg(c)).alias(f"{c}_mean"), rounded(F.median(c)).alias(f"{c}_median")]
        out += [rounded(F.percentile(c, F.lit(x))).alias(f"{c}_p{int(x * 100)}") for x in (0.9, 0.95)]
        out.append(F.max(c).cast("long").alias(f"{c}_max"))
    return measured.agg(*out)


def share_by_label(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Count and share in per cent of each defined label, zero for unseen ones."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    out = labels.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("share", rounded(100 * F.try_divide(F.col("n"), F.col("total")))).drop("total")


def option_counts(df: DataFrame, column: str) -> DataFrame:
    """value, label and count; null last, then count, then label."""
    value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    rows = df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).withColumn("label", F.coalesce("value", F.lit("Unknown")))
    return rows.orderBy(F.col("value").isNull(), F.desc("n"), F.lower("label"))


def location_tree(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row per top value: count, and the nested counts of the two levels below as a sorted array."""
    top, mid, low = levels
    leaf = df.groupBy(top, mid, low).agg(F.count("*").alias("n"))
    inner = leaf.groupBy(top, mid).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(low).alias("name"), "n"))).alias("parts"))
    outer = F.struct(F.col(mid).alias("name"), "n", "parts")
    return inner.groupBy(top).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(outer)).alias("parts"))


def location_totals(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Counts at every level of the hierarchy."""
    return df.rollup(*levels).agg(F.count("*").alias("n"))


def count_reference(df: DataFrame, column: str) -> DataFrame:
    """The 95th percentile of the counts of values, at least one."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.greatest(rounded(F.percentile("n", F.lit(0.95))), F.lit(1.0)), F.lit(1.0)).alias("reference"))


def keyword_effect(df: DataFrame, groups: Mapping[str, Sequence[str]], words: str, y: str) -> DataFrame:
    """For each keyword group that occurs: n, share, mean and median of y, and the difference from the overall mean."""
    hit = F.array_compact(F.array(*[F.when(F.arrays_overlap(F.col(words), F.array(*map(F.lit, w))), F.lit(g)) for g, w in groups.items()]))
    scratch = Scratch(df.sparkSession)
    rows = scratch.stage(df.select(y, hit.alias("hits")), "keyword-hits")  # words are looked up once
    overall = rows.agg(F.count("*").alias("total"), F.avg(y).alias("overall"))
    hits = rows.select(y, F.explode("hits").alias("keyword"))
    medians = exact_quantiles(hits, [y], (0.5,), ["keyword"]).select("keyword", rounded(F.get("quantiles", 0)).alias("median"))
    found = hits.groupBy("keyword").agg(F.count("*").alias("n"), F.avg(y).alias("mean")).join(medians, "keyword")  # a row for each keyword group
    joined = found.crossJoin(F.broadcast(overall))  # one row
    told = joined.select(
        "keyword", "n", rounded(100 * F.col("n") / F.col("total")).alias("share"), rounded(F.col("mean")).alias("mean"), "median",
        rounded(F.col("mean") - F.col("overall")).alias("delta"),
    )
    return scratch.result(told, "keyword-effect")


def missing_counts(df: DataFrame) -> DataFrame:
    """field and nulls, for all columns in one pass."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "field", "missing")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct row; nested cells compare as JSON."""
    nested = ("map", "array", "struct")
    cells = [F.to_json(F.col(f"`{c}`")).alias(c) if kind.startswith(nested) else F.col(f"`{c}`") for c, kind in df.dtypes]
    return df.select(*cells).groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def top_terms(df: DataFrame, words: Column, n: int = 20) -> DataFrame:
    return df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def signal_summary(df: DataFrame, signals: Mapping[str, Column]) -> DataFrame:
    """signal, count and share in per cent, in one pass."""
    rows = [F.struct(F.lit(k).alias("signal"), F.count_if(c).alias("n"), rounded(100 * F.avg(c.cast("double"))).alias("share")) for k, c in signals.items()]
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Counts of equal bins over [min, max], the last one closed, empty bins included."""
    edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    value = F.col(column)
    place = F.least(F.floor((value - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    counts = df.where(value.isNotNull()).crossJoin(F.broadcast(edges)).groupBy(F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])


def top_parents(df: DataFrame, parent: str, child: str, n: int = 10) -> DataFrame:
    rows = df.groupBy(parent).agg(F.count("*").alias("n"), F.count_distinct(child).alias("children"))
    return rows.orderBy(F.desc("n"), parent).limit(n)


def worst_cases(df: DataFrame, error: str, ids: Sequence[str], n: int = 20) -> DataFrame:
    return df.orderBy(F.desc(error), *ids).limit(n)


def best_per_group(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.select(F.struct("*").alias("row"), rank.alias("rank")).where("rank = 1").select("row.*")


def compare_models(metric_rows: DataFrame, ref: str) -> DataFrame:
    """Metrics of each model and its improvement over the reference; R2 counts upwards."""
    base = metric_rows.where(F.col("model") == ref).select(*[F.col(m).alias(f"_{m}") for m in ("mae", "rmse", "r2", "mape")])
    joined = metric_rows.crossJoin(F.broadcast(base))  # one row
    gains = [rounded(F.col(f"_{m}") - F.col(m)).alias(f"{m}_gain") for m in ("mae", "rmse", "mape")]
    return joined.select("model", "n", "mae", "rmse", "r2", "mape", *gains, rounded(F.col("r2") - F.col("_r2"), 6).alias("r2_gain"))
