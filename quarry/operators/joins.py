"""Joins and lookups.

No join here forces a broadcast of data whose size is unknown: AQE converts a
shuffle join into a broadcast at runtime when the built side is measured to be
under ``spark.sql.autoBroadcastJoinThreshold`` (the size check), and splits
skewed partitions otherwise. Explicit ``broadcast`` is used only for sides
whose size is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# J1
def inner(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "inner")


# J2
def left_fill(a: DataFrame, b: DataFrame, on, fill: dict) -> DataFrame:
    return a.join(b, on, "left").fillna(fill)


# J3
def semi(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "left_semi")


# J4
def anti(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "left_anti")


# J5
def flag_member(a: DataFrame, b: DataFrame, on: str | list[str], name: str) -> DataFrame:
    """0/1 flag: key present in ``b``. ``b`` keys are deduplicated map-side first."""
    keys = [on] if isinstance(on, str) else list(on)
    present = b.select(*keys).where(F.greatest(*[F.col(k).isNotNull() for k in keys]) if len(keys) > 1
                                    else F.col(keys[0]).isNotNull()).distinct().withColumn("_hit", F.lit(1))
    return a.join(present, keys, "left").withColumn(name, F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit")


# J6
def lookup(df: DataFrame, agg_df: DataFrame, keys: list[str], default=-1, cols: list[str] | None = None) -> DataFrame:
    """Left join of per-key aggregates with a default for missing keys."""
    cols = cols or [c for c in agg_df.columns if c not in keys]
    out = df.join(agg_df.select(*keys, *cols), keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(default).cast(dict(agg_df.dtypes)[c])) for c in cols})


# J7
def join_within_months(base: DataFrame, ev: DataFrame, key: str, base_ts: str, ev_ts: str, n: int,
                       lower: str | None = None) -> DataFrame:
    """Equal key and ev_ts <= base_ts + n months (month end clipped, C8).

    ``lower`` bounds the event from below too: "inclusive" asks for
    base_ts <= ev_ts, "strict" for base_ts < ev_ts, None for nothing.

    An equi-join on ``key`` with a residual range predicate: the hash/sort key
    is the entity, so the interval condition costs nothing extra to partition.
    """
    at, start = F.to_date(F.col(ev_ts)), F.to_date(F.col(base_ts))
    bound = {None: F.lit(True), "inclusive": at >= start, "strict": at > start}[lower]
    cond = (base[key] == ev[key]) & bound & (at <= F.add_months(start, n))
    return base.join(ev, cond, "inner").drop(ev[key])


# J8
def covered_on(df: DataFrame, key: str, intervals_col: str, date: str,
               group_field: str = "group_number", start_field: str = "start_date",
               end_field: str = "end_date") -> DataFrame:
    """Entities covered on ``date`` with the (smallest) group covering them.

    Unnests the coverage intervals, keeps those containing the slice date,
    and picks one deterministic group per entity with ``min`` (an aggregate,
    combined map-side).
    """
    d = F.to_date(F.lit(date))
    iv = df.select(key, F.explode(intervals_col).alias("_iv")).select(key, "_iv.*")
    hit = iv.where((d >= F.col(start_field)) & (d <= F.col(end_field)))
    return hit.groupBy(key).agg(F.min(group_field).alias(group_field))


# J9
def align_features(dfs: list[DataFrame], key: str, long: bool = False) -> DataFrame:
    """Wide: full outer join of feature sets on the row key (COALESCEd key).
    Long: union of (key, feature, value) tables."""
    if long:
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d, allowMissingColumns=True)
        return out
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, key, "full")
    return out


def eq(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    c = None
    for k in cols:
        t = a[k] == b[k]
        c = t if c is None else c & t
    return c
