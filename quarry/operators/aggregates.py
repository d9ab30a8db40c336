"""Aggregation (A1-A18) and window/set/unnest operations.

Grouped work is expressed as ``groupBy().agg()`` so Spark plans a partial
(map-side) aggregate before the shuffle: a key holding a third of all rows
shuffles one partial row per task. Where the reference attaches a group value
to each row (pandas ``transform``), we aggregate and join back instead of
using a key-partitioned window, which would pull a hot key into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import quantiles
from quarry.operators.profile import top_n_per_group
from quarry.semantics import mode_of, safe_div, with_scalar

AGGS = {
    "min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count,
    "nunique": F.count_distinct, "var_pop": F.var_pop, "std_pop": F.stddev_pop,
    "std": F.stddev_samp, "first": F.min,
}


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    """C11: rows with a NULL key belong to no group."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


# A1
def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return _known(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(*keys)


# A2
def distinct_by(df: DataFrame, key: str | list[str], col: str, approx: bool = False, name: str | None = None) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    f = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return _known(df, keys).groupBy(*keys).agg(f.alias(name or f"n_{col}"))


# A3
def agg_by(df: DataFrame, key: str | list[str], spec: dict[str, tuple[str, str]]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return _known(df, keys).groupBy(*keys).agg(*[AGGS[fn](F.col(c)).alias(out) for out, (fn, c) in spec.items()])


# A4
def mean_by(df: DataFrame, key: str | list[str], col: str, name: str | None = None) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return _known(df, keys).groupBy(*keys).agg(F.avg(col).alias(name or f"mean_{col}"))


# A5
def sum_label_by(df: DataFrame, key: str | list[str], col: str, threshold: float,
                 sum_name: str = "total", label: str = "label") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return (_known(df, keys).groupBy(*keys).agg(F.sum(col).alias(sum_name))
            .withColumn(label, (F.col(sum_name) >= threshold).cast("int")))


# A6
def nested_mean(df: DataFrame, key: str, sub: str, inner_fn: str, col: str, name: str | None = None) -> DataFrame:
    """Inner aggregate per (key, sub), outer mean per key: two chained groupBys."""
    inner = _known(df, [key, sub]).groupBy(key, sub).agg(AGGS[inner_fn](F.col(col)).alias("_inner"))
    return inner.groupBy(key).agg(F.avg("_inner").alias(name or f"mean_{inner_fn}_{col}_per_{sub}"))


# A7
def variance_by(df: DataFrame, keys: list[str], col: str, name: str | None = None) -> DataFrame:
    return _known(df, keys).groupBy(*keys).agg(F.var_pop(col).alias(name or f"var_{col}"))


# A8
def quantiles_by(df: DataFrame, key: str | list[str], col: str, probs: dict[str, float] | None = None,
                 method: str = "exact") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return quantiles(df, col, probs or {"q1": 0.25, "q3": 0.75}, by=keys, method=method)


# A9
def crosstab_long(df: DataFrame, a: str, b: str, name: str = "n") -> DataFrame:
    return _known(df, [a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias(name))


# A10
def count_positive_by(df: DataFrame, key: str | list[str], flag: Column | str) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    f = F.col(flag) if isinstance(flag, str) else flag
    return _known(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"),
                                 F.sum(f.cast("int")).cast("bigint").alias("positive"))


# A11
def summarize(df: DataFrame, col: str, method: str = "exact") -> DataFrame:
    """One row: n, mean, median, mode (smallest on ties, C5), min, max, share > 0."""
    base = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"),
                  F.avg((F.col(col) > 0).cast("double")).alias("share_positive"))
    base = with_scalar(base, mode_of(df, col, "mode"), "_mode").withColumn("mode", F.col("_mode.mode")).drop("_mode")
    med = quantiles(df, col, {"median": 0.5}, method=method)
    return with_scalar(base, med, "_med").withColumn("median", F.col("_med.median")).drop("_med")


# A12
def value_counts(df: DataFrame, col: str, n: int | None = None, name: str = "n") -> DataFrame:
    """Frequency table, total order count desc then value asc (C9); top n if given."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    ordered = vc.orderBy(F.col(name).desc(), F.col(col).asc())
    return ordered.limit(n) if n else ordered


# A13
def first_by(df: DataFrame, key: str | list[str], col: str) -> DataFrame:
    """Deterministic single value per key (``min`` instead of ``first``)."""
    keys = [key] if isinstance(key, str) else list(key)
    return _known(df, keys).groupBy(*keys).agg(F.min(col).alias(col))


# A14
def ratio_by(df: DataFrame, key: str | list[str], num: Column, den: Column, name: str = "ratio") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return (_known(df, keys).groupBy(*keys).agg(num.alias("_num"), den.alias("_den"))
            .select(*keys, "_num", "_den", safe_div("_num", "_den").alias(name))
            .withColumnsRenamed({"_num": "numerator", "_den": "denominator"}))


# A15
def prevalence(features: DataFrame, membership: DataFrame, feature_sets: DataFrame,
               member: str = "member", group: str = "group_id", feature: str = "feature",
               value: str = "value", set_col: str = "set_name", population: str = "__all__",
               members: DataFrame | None = None) -> DataFrame:
    """Share of members per group whose features in a set sum to non-zero.

    ``feature_sets`` (set_name, feature) is the curated code list; AQE broadcasts
    it when it is small. A member's flag for a set is
    ``sum(value) != 0`` over its features in the set; members without such
    features count 0. ``members`` is the list of ids that count: those in no
    group count in the population row alone, and others in no row. Without it
    all distinct members of the groups count (membership may overlap or miss,
    so the population is computed separately, not as a grouping set).
    """
    sets = feature_sets.select(set_col, feature)
    flagged = (features.join(sets, feature)
               .groupBy(member, set_col).agg(F.sum(value).alias("_s"))
               .where(F.col("_s") != 0).select(member, set_col))
    mem = membership.select(F.col(group).cast("string").alias(group), member).distinct()
    set_names = feature_sets.select(set_col).distinct()
    if members is None:
        all_members = mem.select(member).distinct()
    else:
        all_members = members.select(member).distinct()
        mem = mem.join(all_members, member, "left_semi")

    sizes = mem.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    hits = flagged.join(mem, member).groupBy(group, set_col).agg(F.count(F.lit(1)).alias("flagged"))
    # every (group, set) pair: each group row expands over the (bounded) list
    # of set names, delivered as one array by a scalar subquery
    names = set_names.agg(F.array_sort(F.collect_list(set_col)).alias("_names"))
    grid = sizes.withColumn(set_col, F.explode(names.scalar()))
    per_group = (grid.join(hits, [group, set_col], "left")
                 .select(group, set_col, "members", F.coalesce("flagged", F.lit(0)).alias("flagged")))

    n_all = all_members.agg(F.count(F.lit(1)).alias("members"))
    pop_hits = flagged.join(all_members, member, "left_semi").groupBy(set_col).agg(
        F.count(F.lit(1)).alias("flagged"))
    pop = (set_names.join(pop_hits, set_col, "left")
           .select(F.lit(population).alias(group), set_col,
                   n_all.scalar().alias("members"), F.coalesce("flagged", F.lit(0)).alias("flagged")))
    out = per_group.unionByName(pop)
    return out.withColumn("prevalence", F.col("flagged") / F.col("members"))


# A16
def ranked_prevalence(prev: DataFrame, group: str = "group_id", tag: str = "set_name",
                      value: str = "prevalence", as_map: bool = False) -> DataFrame:
    """Rank tags inside each group by prevalence (desc, then tag asc).

    Each group holds one row per tag (bounded by the tag list), so the
    group-partitioned window is bounded.
    """
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(tag).asc())
    ranked = prev.select(group, tag, value, F.row_number().over(w).alias("rank"))
    if not as_map:
        return ranked
    entries = F.transform(F.array_sort(F.collect_list(F.struct("rank", tag, value))),
                          lambda s: F.struct(s[tag], s[value]))
    return ranked.groupBy(group).agg(F.map_from_entries(entries).alias("ranked"))


# A17
def correlation(df: DataFrame, cols: list[str], hi: float | None = None, lo: float | None = None) -> DataFrame:
    """Pearson correlation of every column pair (a < b) in one aggregation, long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    out = long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("col_a"),
                      F.split_part("pair", F.lit("|"), F.lit(2)).alias("col_b"), "corr")
    if hi is not None or lo is not None:
        cond = F.lit(False)
        if hi is not None:
            cond = cond | (F.col("corr") >= hi)
        if lo is not None:
            cond = cond | (F.col("corr") <= lo)
        out = out.where(cond)
    return out


# A18
def prevalence_filter(features: DataFrame, limit: float, row: str = "row_id", feature: str = "feature",
                      value: str = "value", n_rows: DataFrame | int | None = None) -> DataFrame:
    """Keep features non-zero in at least ``limit`` rows (below 1: that share of
    all rows, rounded half to even). ``n_rows`` is the number of matrix rows, or a
    one-value frame of it; without it rows that have no entry at all are not counted."""
    nz = features.where(F.col(value) != 0)
    support = nz.groupBy(feature).agg(F.count_distinct(row).alias("_rows"))
    if limit < 1:
        if n_rows is None:
            n_rows = features.agg(F.count_distinct(row).alias("n"))
        n = n_rows.scalar() if isinstance(n_rows, DataFrame) else F.lit(n_rows)
        threshold = F.bround(F.lit(float(limit)) * n)
    else:
        threshold = F.lit(float(limit))
    keep = support.where(F.col("_rows") >= threshold).select(feature)
    return features.join(keep, feature, "left_semi")


# W1
def group_broadcast(df: DataFrame, key: str | list[str], spec: dict[str, Column]) -> DataFrame:
    """Attach group aggregates to every row: aggregate (map-side combined) + join back."""
    keys = [key] if isinstance(key, str) else list(key)
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in spec.items()])
    return df.join(agg, keys, "left")


# W2
def stack(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# W3
def explode_events(df: DataFrame, key: str, map_col: str, as_of: str | None = None,
                   date_name: str = "event_date", item_name: str = "item") -> DataFrame:
    """Unnest ``map<date string, array<item>>`` to (key, date, item) rows before ``as_of``."""
    entries = df.select(key, F.explode(F.map_entries(F.col(map_col))).alias("_e"))
    rows = entries.select(key, F.to_date(F.col("_e.key")).alias(date_name),
                          F.explode(F.col("_e.value")).alias(item_name))
    return rows.where(F.col(date_name) < F.to_date(F.lit(as_of))) if as_of else rows


# W4
def top_k_wide(df: DataFrame, key: str, name: str, value: str, k: int, bias: str | None = None,
               matched: DataFrame | None = None, missing: str = "N/A", digits: int = 2) -> DataFrame:
    """Top-k (name, value) per entity by |value| desc (name asc on ties), as k column pairs.

    The row named ``bias`` is an entity's intercept: a column of its own, out of the ranking.
    ``matched`` (key, matched) lists all entities: one without a match has ``missing`` in every
    column, and all columns are text then, values with ``digits`` decimals.
    """
    ranking = df.where(F.col(name) != bias) if bias is not None else df
    scored = ranking.select(key, (-F.abs(F.col(value))).alias("_neg"), name, value)
    top = top_n_per_group(scored, [key], "_neg", k)
    w = Window.partitionBy(key).orderBy("_neg", name, value)  # at most k rows per key here
    ranked = top.withColumn("_r", F.row_number().over(w))
    cols, added = [], []
    for i in range(1, k + 1):
        cols += [F.max(F.when(F.col("_r") == i, F.col(name))).alias(f"{name}_{i}"),
                 F.max(F.when(F.col("_r") == i, F.col(value))).alias(f"{value}_{i}")]
        added += [(f"{name}_{i}", False), (f"{value}_{i}", True)]
    out = ranked.groupBy(key).agg(*cols)
    if bias is not None:
        # an entity may have an intercept alone
        out = df.where(F.col(name) == bias).groupBy(key).agg(F.max(value).alias("intercept")).join(out, key, "full")
        added = [("intercept", True), *added]
    if matched is not None:
        out = matched.select(key, "matched").join(out, key, "left")
        text = lambda c, number: (F.col(c).cast(f"decimal(38,{digits})") if number else F.col(c)).cast("string")
        out = out.select(key, *[F.when(F.col("matched"), text(c, number)).otherwise(missing).alias(c) for c, number in added])
    return out
