"""Profiling and data-quality queries.

Per-column profiles are ONE aggregation over the table followed by an
``unpivot`` of the single result row: a single scan, partial aggregation per
task, never one job per column.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import quantiles


# P1
def profile_columns(df: DataFrame) -> DataFrame:
    """(column, position, data_type, non_null, rows)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    long = row.unpivot("_rows", df.columns, "column_name", "non_null")
    meta = df.sparkSession.createDataFrame(
        [(c, i, types[c]) for i, c in enumerate(df.columns)], "column_name string, position int, data_type string")
    # meta is one row per column of the schema: bounded by the schema width
    return long.join(F.broadcast(meta), "column_name").select(
        "column_name", "position", "data_type", F.col("non_null").cast("bigint").alias("non_null"),
        F.col("_rows").cast("bigint").alias("rows"))


# P2
def null_rates(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """(column, null_count, null_pct) in one pass; optionally only columns with nulls."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = row.unpivot("_rows", df.columns, "column_name", "null_count")
    out = long.select("column_name", F.col("null_count").cast("bigint").alias("null_count"),
                      (F.try_divide(F.col("null_count") * 100.0, F.col("_rows"))).alias("null_pct"))
    return out.where(F.col("null_count") > 0) if only_missing else out


# P3
def describe_numeric(df: DataFrame, cols: list[str], method: str = "exact") -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column (long form).

    The algebraic part is one aggregation; quartiles come from the distributed
    exact quantile operator over the unpivoted long table (column as group).
    """
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    stats = (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    row = wide.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), *[f(c).alias(n) for n, f in stats]) for c in cols]).alias("_c"))
    base = row.select(F.explode("_c").alias("_c")).select("_c.*")
    long = wide.unpivot([], cols, "column_name", "value")
    qs = quantiles(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by=["column_name"], method=method, few=True)
    return base.join(qs, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


# P4
def cardinality(df: DataFrame, cols: list[str], n: int = 10) -> DataFrame:
    """(column, n_distinct, first_values): first ``n`` sorted distinct values.

    Distinct values are found with a map-side combined (column, value)
    aggregation; the first n per column come from a ``min``-heap free
    approach: rank within column over the deduplicated values only.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value").where(F.col("value").isNotNull())
    distinct_vals = long.groupBy("column_name", "value").agg(F.lit(1).alias("_one"))
    card = distinct_vals.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    firsts = top_n_per_group(distinct_vals, ["column_name"], "value", n)
    heads = firsts.groupBy("column_name").agg(
        F.array_sort(F.collect_list("value")).alias("first_values"))
    return card.join(heads, "column_name").select("column_name", F.col("n_distinct").cast("bigint").alias("n_distinct"),
                                             F.array_join("first_values", ",").alias("first_values"))


def top_n_per_group(df: DataFrame, by: list[str], order: str, n: int, salts: int = 16,
                    descending: bool = False) -> DataFrame:
    """Rows with the n smallest (or largest) ``order`` per group, skew-safe.

    Stage 1 ranks inside (group, salt) sub-groups so a hot group is spread
    over ``salts`` tasks; only n rows per sub-group survive. Stage 2 ranks the
    at most n*salts survivors per group. Ties broken by all columns.
    """
    from pyspark.sql import Window
    cols = df.columns
    o = F.col(order).desc() if descending else F.col(order).asc()
    rest = [F.col(c).asc() for c in cols if c != order and c not in by]
    salted = df.withColumn("_salt", (F.abs(F.xxhash64(*cols)) % salts).cast("int"))
    w1 = Window.partitionBy(*by, "_salt").orderBy(o, *rest)
    stage1 = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n).drop("_r", "_salt")
    w2 = Window.partitionBy(*by).orderBy(o, *rest)
    return stage1.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= n).drop("_r")


# P5
def value_range(items: dict[str, tuple[DataFrame, str]], fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """(name, min_value, max_value) one row per (table, column), formatted as text."""
    parts = [df.agg(F.lit(name).alias("name"), F.date_format(F.min(c), fmt).alias("min_value"),
                    F.date_format(F.max(c), fmt).alias("max_value")) for name, (df, c) in items.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# P6
def fd_violations(df: DataFrame, key: str, attr: str) -> DataFrame:
    """Keys with more than one distinct value of ``attr``."""
    return (df.groupBy(key).agg(F.count_distinct(attr).alias("n_values"))
            .where(F.col("n_values") > 1))


# P7
def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once, with the key's row count.

    Aggregate + join back instead of a key-partitioned window: counts combine
    map-side, and AQE splits a hot key on the join.
    """
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count")).where(F.col("dup_count") > 1)
    d = dup.withColumnsRenamed({k: f"_dup_{k}" for k in keys})
    same = reduce(and_, (df[k].eqNullSafe(d[f"_dup_{k}"]) for k in keys))  # NULL keys equal each other
    return df.join(d, same).select(*keys, *[c for c in df.columns if c not in keys], "dup_count")


# P8
def column_mismatch(df: DataFrame, a: Column | str, b: Column | str) -> DataFrame:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return df.where(~a.eqNullSafe(b))


# P9
def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) from one pass of ``count_if`` per rule."""
    row = df.agg(*[F.count_if(pred).alias(name) for name, pred in rules.items()])
    return row.unpivot([], list(rules), "rule", "violations").select(
        "rule", F.col("violations").cast("bigint").alias("violations"))


# P10
def code_dictionary(df: DataFrame, codes_col: str, sep: str | None = None, is_array: bool = False) -> DataFrame:
    """(system, code, n_codes): a row for every distinct code of a system.

    With ``sep`` each code is ``system<sep>code``; otherwise the value's column
    name is the system. Distinct pairs are reduced map-side; no system's codes are
    brought together, so one that holds most of them is as many rows.
    """
    codes = F.explode(F.col(codes_col)) if is_array else F.col(codes_col)
    flat = df.select(codes.alias("_code")).where(F.col("_code").isNotNull())
    if sep:
        flat = flat.select(F.split_part("_code", F.lit(sep), F.lit(1)).alias("system"),
                           F.col("_code").alias("code"))
    else:
        flat = flat.select(F.lit(codes_col).alias("system"), F.col("_code").alias("code"))
    pairs = flat.distinct()
    sizes = pairs.groupBy("system").agg(F.count(F.lit(1)).alias("n_codes"))
    return pairs.join(sizes, "system")
