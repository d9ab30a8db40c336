"""Semantics contract C1-C19 as reusable column expressions.

Each helper returns a ``Column``; none of them triggers an action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ANSI division raises on zero; divide to NULL then fill a sentinel.
def safe_div(num: ColumnLike, den: ColumnLike, default=None) -> Column:
    q = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default).cast("double"))


# NaN poisons avg/max and sorts above numbers; turn it into NULL at the source.
def nan_to_null(c: ColumnLike) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# Monday = 0.
def monday_weekday(c: ColumnLike) -> Column:
    return F.weekday(col(c))


# Naive (NTZ) timestamps are wall-clock UTC; make them instants.
def as_instant(c: ColumnLike) -> Column:
    return col(c).cast("timestamp")


# Elapsed days floored (negatives round down), as pandas Timedelta.days.
def floor_days(later: ColumnLike, earlier: ColumnLike) -> Column:
    micros = F.unix_micros(as_instant(later)) - F.unix_micros(as_instant(earlier))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def elapsed_seconds(later: ColumnLike, earlier: ColumnLike) -> Column:
    micros = F.unix_micros(as_instant(later)) - F.unix_micros(as_instant(earlier))
    return micros / F.lit(1_000_000.0)


# Month offset clipping to month end.
def shift_months(c: ColumnLike, n: int) -> Column:
    return F.add_months(F.to_date(col(c)), n)


# Isin on NULL is false -> falls to the default.
def keep_listed(c: ColumnLike, values: list, other: str) -> Column:
    c = col(c)
    return F.when(c.isin(values), c).otherwise(F.lit(other))


# Half-even rounding (pandas/numpy) vs half-up (SQL round).
def round_half_even(c: ColumnLike, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


# UTC instant -> local wall clock, zone dropped.
def to_local(c: ColumnLike, tz: str) -> Column:
    return F.from_utc_timestamp(as_instant(c), tz)


# C17: undefined ratio is 0 (precision with no predicted positive).
def ratio_or_zero(num: ColumnLike, den: ColumnLike) -> Column:
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


# Reproducible hash bucket 0..99 from the md5 prefix of a key.
def hash_prefix(key: ColumnLike) -> Column:
    return F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: ColumnLike, buckets: int = 100) -> Column:
    return (hash_prefix(key) % F.lit(buckets)).cast("int")


def total_order(df: DataFrame, first: list[str]) -> list[str]:
    """Order by the given columns, then every remaining column."""
    return list(first) + [c for c in df.columns if c not in first]


def with_scalar(df: DataFrame, stats: DataFrame, name: str = "_s") -> DataFrame:
    """Attach a one-row aggregate as a struct column via a scalar subquery.

    The subquery runs once; its single row reaches every task as a literal,
    so no cross join or broadcast of data is needed.
    """
    packed = stats.select(F.struct(*stats.columns).alias(name))
    return df.withColumn(name, packed.scalar())


# The smallest value wins ties.
def mode_of(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """The most frequent value (per group), from value counts: no task holds a group's values."""
    keys = list(by or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg((-F.count(F.lit(1))).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct("_n", "_v"))["_v"].alias(name))
