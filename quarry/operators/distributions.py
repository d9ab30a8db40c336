"""Distribution tables (D1-D9): the data behind the reference's charts.

Whole-table statistics (min/max, quantile edges) are one-row aggregates
attached through scalar subqueries; bin and bucket counts are map-side
combined ``groupBy``s. The bin/bucket/grid lists are bounded by parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import bucket_index, quantiles, quantiles_of
from quarry.semantics import with_scalar


def _bin_index(x: Column, lo: Column, width: Column, bins: int) -> Column:
    """floor((x-lo)/w), the last bin closed at the maximum."""
    raw = F.floor((x - lo) / width).cast("int")
    return F.when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))


def _edges_frame(df: DataFrame, col: str, log: bool) -> DataFrame:
    x = F.col(col).cast("double")
    v = F.log10(x) if log else x
    src = df.where(x > 0) if log else df
    return src.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


# D1
def histogram(df: DataFrame, col: str, bins: int = 10, log: bool = False) -> DataFrame:
    """(bin, lower, upper, count) for every bin, empty bins included.

    ``log=True`` spaces edges evenly in log10 (non-positive values dropped).
    """
    stats = _edges_frame(df, col, log).select(
        "lo", "hi", ((F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("w"))
    x = F.col(col).cast("double")
    v = F.log10(x) if log else x
    src = df.where(x > 0) if log else df.where(x.isNotNull())
    tagged = with_scalar(src.select(v.alias("_v")), stats, "_s")
    counts = tagged.groupBy(_bin_index(F.col("_v"), F.col("_s.lo"), F.col("_s.w"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    grid = with_scalar(stats.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")), stats, "_s")
    lower = F.col("_s.lo") + F.col("bin") * F.col("_s.w")
    upper = F.col("_s.lo") + (F.col("bin") + 1) * F.col("_s.w")
    if log:
        lower, upper = F.pow(F.lit(10.0), lower), F.pow(F.lit(10.0), upper)
    return (grid.select("bin", lower.alias("lower"), upper.alias("upper"))
            .join(counts, "bin", "left").select("bin", "lower", "upper",
                                                F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


# D2
def histogram_compare(df: DataFrame, col: str, label: str, bins: int | list[float] = 10, log: bool = False,
                      delta: float = 1.0) -> DataFrame:
    """(label, bin, lower, upper, count, density) of two or more populations over shared bins, empty ones included.

    ``bins`` is a number of even bins over the column's range, or a list of edges.
    ``log=True`` spaces them evenly in log10, from the smallest value plus ``delta``
    (which must be positive). Values outside the edges count nowhere; density =
    count / (the label's count inside them * (upper - lower)).
    """
    src = df.select(F.col(label).alias("label"), F.col(col).cast("double").alias("_x")).dropna()
    if isinstance(bins, int):
        n = bins
        low = F.min("_x") + F.lit(float(delta)) if log else F.min("_x")
        v = F.log10("_x") if log else F.col("_x")
        ends = src.agg(low.alias("lo"), F.max("_x").alias("hi"))
        if log:
            ends = ends.select(F.log10("lo").alias("lo"), F.log10("hi").alias("hi"))
        stats = ends.select("lo", "hi", ((F.col("hi") - F.col("lo")) / F.lit(float(n))).alias("w"))
        tagged = with_scalar(src, stats, "_s").where(v >= F.col("_s.lo"))
        index = _bin_index(v, F.col("_s.lo"), F.col("_s.w"), n)

        def edge(i: Column) -> Column:
            at = F.col("_s.lo") + i * F.col("_s.w")
            return F.pow(F.lit(10.0), at) if log else at
    else:
        edges = sorted(float(e) for e in bins)
        n = len(edges) - 1
        tagged, stats = src.where(F.col("_x").between(edges[0], edges[-1])), None
        index = F.least(sum((F.col("_x") >= e).cast("int") for e in edges[1:]), F.lit(n - 1))

        def edge(i: Column) -> Column:
            return F.element_at(F.array(*[F.lit(e) for e in edges]), i + 1)
    counts = tagged.groupBy("label", index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("label").agg(F.sum("count").alias("_n"))
    out = (totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
           .join(counts, ["label", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint")))
    out = (out if stats is None else with_scalar(out, stats, "_s")).withColumns(
        {"lower": edge(F.col("bin")), "upper": edge(F.col("bin") + 1)})
    return out.select("label", "bin", "lower", "upper", "count",
                      F.try_divide("count", F.col("_n") * (F.col("upper") - F.col("lower"))).alias("density"))


# D3
def rate_by_category(df: DataFrame, cat: str, target: str, hue: str | None = None) -> DataFrame:
    """count, mean target and its standard error per category (and hue)."""
    keys = [cat] + ([hue] if hue else [])
    t = F.col(target).cast("double")
    return df.where(F.col(cat).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg(t).alias("mean"),
        (F.stddev_samp(t) / F.sqrt(F.count(t))).alias("stderr"))


# D4
def box_stats(df: DataFrame, col: str, group: str | None = None, k: float = 1.5, method: str = "exact") -> DataFrame:
    """Quartiles, 1.5*IQR fences, whisker ends (extreme values inside the fences), outlier count."""
    by = [group] if group else []
    qs = quantiles(df, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=by, method=method)
    qs = qs.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "lower_fence": F.col("q1") - F.lit(k) * F.col("iqr"), "upper_fence": F.col("q3") + F.lit(k) * F.col("iqr")})
    src = df.select(*by, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    j = src.join(qs, by) if by else with_scalar(src, qs, "_q").select("_x", "_q.*")
    inside = (F.col("_x") >= F.col("lower_fence")) & (F.col("_x") <= F.col("upper_fence"))
    kept = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in kept],
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"), F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def _bucket_edges(df: DataFrame, feature: str, buckets: int, method: str) -> DataFrame:
    """One row: sorted distinct percentile edges at 0, 1/b, ..., 1."""
    probs = {f"p{i}": i / buckets for i in range(buckets + 1)}
    q = quantiles(df, feature, probs, method=method)
    return q.select(F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in probs]))).alias("edges"))


def bucketize(df: DataFrame, feature: str, buckets: int = 10, name: str = "bucket", method: str = "exact") -> DataFrame:
    """Percentile bucket of ``feature``: [e_i, e_{i+1}), the last bucket closed.

    Adds ``name``, ``<name>_lower``, ``<name>_upper``.
    """
    edges = _bucket_edges(df, feature, buckets, method)
    b = bucket_index(F.col("_e.edges"), F.col(feature).cast("double"), buckets + 1)
    return _bounded(with_scalar(df, edges, "_e").withColumn(name, b).drop("_e"), edges, name)


def _bounded(df: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``df`` with the bounds of its bucket ``name``."""
    e = F.col("_e.edges")
    return with_scalar(df, edges, "_e").withColumns({
        f"{name}_lower": F.element_at(e, F.col(name) + 1), f"{name}_upper": F.element_at(e, F.col(name) + 2)}).drop("_e")


# D5
def target_by_bucket(df: DataFrame, feature: str, target: str, buckets: int = 10, method: str = "exact") -> DataFrame:
    """count, mean target and bounds per percentile bucket of the feature."""
    src = df.where(F.col(feature).isNotNull())
    edges = _bucket_edges(src, feature, buckets, method)
    b = bucket_index(F.col("_e.edges"), F.col(feature).cast("double"), buckets + 1)
    per = with_scalar(src, edges, "_e").groupBy(b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col(target).cast("double")).alias("mean_target"))
    return _bounded(per, edges, "bucket").select("bucket", "bucket_lower", "bucket_upper", "count", "mean_target")


def target_by_value(df: DataFrame, feature: str, target: str) -> DataFrame:
    """D5 for features with few distinct values: count and mean target per value."""
    return df.where(F.col(feature).isNotNull()).groupBy(feature).agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col(target).cast("double")).alias("mean_target"))


# D6
def target_by_grid(df: DataFrame, f1: str, f2: str, target: str, buckets: int = 5, method: str = "exact") -> DataFrame:
    """D5 buckets on two features; both sets of percentile edges come from one
    quantile pipeline over the unpivoted pair."""
    src = df.where(F.col(f1).isNotNull() & F.col(f2).isNotNull())
    probs = {i: i / buckets for i in range(buckets + 1)}
    q = quantiles_of(src, {f1: {f"a{i}": p for i, p in probs.items()}, f2: {f"b{i}": p for i, p in probs.items()}},
                     method=method)
    edges = q.select(F.array_sort(F.array_distinct(F.array(*[F.col(f"a{i}") for i in probs]))).alias("e1"),
                     F.array_sort(F.array_distinct(F.array(*[F.col(f"b{i}") for i in probs]))).alias("e2"))
    t = with_scalar(src, edges, "_e")
    b = t.withColumns({"b1": bucket_index(F.col("_e.e1"), F.col(f1).cast("double"), buckets + 1),
                       "b2": bucket_index(F.col("_e.e2"), F.col(f2).cast("double"), buckets + 1)})
    return b.groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("count"),
                                     F.avg(F.col(target).cast("double")).alias("mean_target"))


# D7
def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x: slope, intercept, r, r2, n (one aggregation)."""
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
                  F.corr(xx, yy).alias("r"), F.regr_r2(yy, xx).alias("r2"), F.regr_count(yy, xx).alias("n"))


# D8
def period_series(past: DataFrame, future: DataFrame, ts: str, cut: str) -> DataFrame:
    """Daily counts of a historic and a future table, stacked and labelled by period."""
    def daily(d: DataFrame, source: str) -> DataFrame:
        return d.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(source))
    both = daily(past, "past").unionByName(daily(future, "future"))
    return both.withColumn("period", F.when(F.col("day") < F.to_date(F.lit(cut)), "before_cut").otherwise("after_cut"))


# D9
def density(df: DataFrame, col: str, grid: int | list[float] = 50, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on a grid: (point, x, density).

    One pass: each grid point is its own sum accumulator inside a single
    aggregation (no row x grid expansion, no join); grid size is a parameter.
    Bandwidth defaults to Scott's rule, std_samp * n^(-1/5).
    """
    x = F.col(col).cast("double")
    src = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    stats = src.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.stddev_samp("_x").alias("sd"),
                    F.count(F.lit(1)).alias("n"))
    if isinstance(grid, int):
        pts = [(i, None) for i in range(grid)]
        g = grid
    else:
        pts = list(enumerate(grid))
        g = len(grid)
    t = with_scalar(src, stats, "_s")
    h = F.lit(float(bandwidth)) if bandwidth else F.col("_s.sd") * F.pow(F.col("_s.n").cast("double"), F.lit(-0.2))

    def point(i, val):
        if val is not None:
            return F.lit(float(val))
        return F.col("_s.lo") + F.lit(i) * (F.col("_s.hi") - F.col("_s.lo")) / F.lit(float(max(g - 1, 1)))

    sums = t.agg(*[F.sum(F.exp(-F.pow((point(i, v) - F.col("_x")) / h, 2) / 2.0)).alias(f"k{i}") for i, v in pts],
                 F.first(h).alias("_h"), F.first("_s").alias("_s"))
    norm = F.col("_s.n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    rows = sums.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("point"), point(i, v).alias("x"), (F.col(f"k{i}") / norm).alias("density"))
        for i, v in pts])).alias("r"))
    return rows.select("r.*")
