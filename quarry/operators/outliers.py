"""Outliers and segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import count_below, quantiles, quantiles_of
from quarry.semantics import safe_div, with_scalar
from quarry.session import stored


# O1
def iqr_filter(df: DataFrame, col: str, k: float = 1.5, log: bool = False, method: str = "exact") -> DataFrame:
    """Rows inside [q1 - k*iqr, q3 + k*iqr] of the (log) column, with the bounds attached."""
    x = F.ln(F.col(col).cast("double")) if log else F.col(col).cast("double")
    src = df.where(F.col(col) > 0) if log else df
    src = src.withColumn("_v", x)
    q = quantiles(src, "_v", {"q1": 0.25, "q3": 0.75}, method=method)
    q = q.select((F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))).alias("lower"),
                 (F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))).alias("upper"))
    t = with_scalar(src, q, "_b")
    return (t.where((F.col("_v") >= F.col("_b.lower")) & (F.col("_v") <= F.col("_b.upper")))
            .withColumns({"lower": F.col("_b.lower"), "upper": F.col("_b.upper")}).drop("_b", "_v"))


# O2
def iqr_outliers(df: DataFrame, key: str, cols: list[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """Per row: which features fall outside their Tukey fences, how many, repeat flag.

    Fences for all columns come from one grouped quantile pass over the
    unpivoted table (the column name is the group), joined back by name:
    a bounded table of one row per feature.
    """
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        key, cols, "feature", "value").where(F.col("value").isNotNull())
    q = quantiles(long, "value", {"q1": 0.25, "q3": 0.75}, by=["feature"], method=method, few=True)
    fences = F.broadcast(q.select("feature", (F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))).alias("lo"),
                                  (F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))).alias("hi")))
    flagged = long.join(fences, "feature").where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    per_row = flagged.groupBy(key).agg(F.count(F.lit(1)).alias("n_outlier_features"),
                                       F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("outlier_features"))
    return per_row.withColumn("repeat_outlier", (F.col("n_outlier_features") > 1).cast("int"))


def clean_rows(df: DataFrame, key: str, outliers: DataFrame) -> DataFrame:
    """The clean set: rows that are outliers in no feature."""
    return df.join(outliers.select(key), key, "left_anti")


# O3
def quantile_bins(df: DataFrame, col: str, n: int, name: str = "qbin", method: str = "exact") -> DataFrame:
    """Equal-frequency bins (right-closed, first bin includes the minimum):
    bin = number of distinct interior edges strictly below x."""
    probs = {f"p{i}": i / n for i in range(1, n)}
    q = quantiles(df, col, probs, method=method)
    edges = q.select(F.array_sort(F.array_distinct(F.array(*[F.col(p) for p in probs]))).alias("edges"))
    t = with_scalar(df, edges, "_e")
    x = F.col(col).cast("double")
    return t.withColumn(name, F.when(x.isNotNull(), count_below(F.col("_e.edges"), x, n - 1))).drop("_e")


# O4
def segment_outliers(df: DataFrame, segment: str | list[str], col: str, p: float = 0.25,
                     flag: str = "low_outlier", method: str = "exact") -> DataFrame:
    """Flag rows below their segment's p-quantile (segment quantiles joined back).

    The quantiles are stored, so the plan knows their size: few segments are broadcast, and no
    task gets all rows of a segment to sort."""
    keys = [segment] if isinstance(segment, str) else list(segment)
    q = stored(quantiles(df, col, {"_seg_q": p}, by=keys, method=method))
    out = df.join(q, keys, "left")
    return out.withColumn(flag, (F.col(col) < F.col("_seg_q")).cast("int")).withColumnRenamed("_seg_q", "segment_q")


# O5
def quartile_flag(df: DataFrame, col: str, p: float = 0.25, flag: str = "low_flag", method: str = "exact") -> DataFrame:
    q = quantiles(df, col, {"q": p}, method=method)
    t = with_scalar(df, q, "_q")
    return t.withColumn(flag, (F.col(col) < F.col("_q.q")).cast("int")).drop("_q")


# O6
def quadrants(df: DataFrame, a: str, b: str, method: str = "exact") -> DataFrame:
    """Median split of two scores (each by its own median) -> quadrant counts."""
    meds = quantiles_of(df, {a: {"ma": 0.5}, b: {"mb": 0.5}}, method=method)  # one pipeline, two medians
    t = with_scalar(df, meds, "_m")
    quad = F.concat(F.when(F.col(a) > F.col("_m.ma"), "high_").otherwise("low_"), F.lit(a), F.lit("__"),
                    F.when(F.col(b) > F.col("_m.mb"), "high_").otherwise("low_"), F.lit(b))
    return t.groupBy(quad.alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))


# O7
def threshold_segments(df: DataFrame, col: str, cuts: list[tuple[float, str]], name: str = "segment",
                       negative: str = "negative", zero: str = "zero", other: str = "other") -> DataFrame:
    """Sign segments, then ascending thresholds: first cut with x < cut gives its label."""
    x = F.col(col)
    expr = F.when(x < 0, negative).when(x == 0, zero)
    for cut, label in sorted(cuts):
        expr = expr.when(x < cut, label)
    return df.withColumn(name, expr.otherwise(other))


# O8
def rfm_features(df: DataFrame, key: str, ts: str, amount: str) -> DataFrame:
    """Count, average amount, days on file (to the latest date in the table),
    mean gap between purchases (0 for a single one), and log1p forms."""
    per = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_purchases"), F.avg(F.col(amount).cast("double")).alias("avg_amount"),
        F.min(F.to_date(ts)).alias("_first"), F.max(F.to_date(ts)).alias("_last"))
    latest = df.agg(F.max(F.to_date(ts)).alias("d"))
    t = with_scalar(per, latest, "_m")
    return t.select(
        key, "n_purchases", "avg_amount",
        F.datediff(F.col("_m.d"), F.col("_first")).alias("days_on_file"),
        F.coalesce(safe_div(F.datediff(F.col("_last"), F.col("_first")), F.col("n_purchases") - 1), F.lit(0.0)).alias("mean_gap_days"),
        F.log1p(F.col("n_purchases")).alias("log_n_purchases"),
        F.log1p(F.col("avg_amount")).alias("log_avg_amount"))
