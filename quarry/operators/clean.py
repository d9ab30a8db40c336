"""Projection, filter and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import quantiles
from quarry.semantics import hash_prefix, mode_of, safe_div, with_scalar


# R1
def project(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None,
            rename: dict[str, str] | None = None) -> DataFrame:
    out = df.select(*keep) if keep else df
    if drop:
        out = out.drop(*drop)
    if rename:
        out = out.withColumnsRenamed(rename)
    return out


# R2
def where(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate)


# R3
def drop_nulls(df: DataFrame, subset: list[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=subset)


# R4
def dedup(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


# R5
def keep_one(df: DataFrame, keys: list[str], order: list[str], which: str = "first") -> DataFrame:
    """First (or last) row per key under a total order.

    Implemented as ``min``/``max`` of a struct (order columns, then every other
    column) per key: an aggregate, so each task combines its rows map-side and
    a key holding a third of the table still shuffles only one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest]).alias("_row")
    pick = F.min(packed) if which == "first" else F.max(packed)
    return (df.groupBy(*keys).agg(pick.alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in order + rest])
            .select(*df.columns))


# R6
def keep_group_min(df: DataFrame, key: str | list[str], col: str, use_max: bool = False) -> DataFrame:
    """Every row equal to its group's minimum (ties stay): aggregate + join back."""
    keys = [key] if isinstance(key, str) else list(key)
    ext = (F.max if use_max else F.min)(col).alias("_ext")
    best = df.groupBy(*keys).agg(ext)
    return df.join(best, keys).where(F.col(col) == F.col("_ext")).drop("_ext")


# R7
def case_column(df: DataFrame, name: str, cases: list[tuple[Column, object]], default=None) -> DataFrame:
    expr = None
    for pred, val in cases:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(pred, v) if expr is None else expr.when(pred, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return df.withColumn(name, expr.otherwise(d))


# R8
def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast to the given types with NULL on failure (ANSI ``try_cast``)."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


# R9
def map_values(df: DataFrame, col: str, mapping: dict, out: str | None = None, keep_unmapped: bool = False) -> DataFrame:
    """Literal lookup map; unmapped values become NULL (or stay, if asked)."""
    lut = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    mapped = F.try_element_at(lut, F.col(col))
    if keep_unmapped:
        mapped = F.coalesce(mapped, F.col(col))
    return df.withColumn(out or col, mapped)


# R10
def ordinal_encode(df: DataFrame, col: str, order: str, out: str | None = None) -> DataFrame:
    """Code categories 0,1,2... by first appearance under ``order``.

    The category table is one row per distinct value (the vocabulary), built by
    a map-side combined ``min`` per value; codes are the distributed dense rank
    of (first appearance, value), joined back (AQE broadcasts it when small).
    """
    from quarry.operators.ordered import dense_index
    firsts = df.groupBy(col).agg(F.min(order).alias("_first")).where(F.col(col).isNotNull())
    codes = dense_index(firsts, ["_first", col], name=out or f"{col}_code").drop("_first")
    return df.join(codes, col, "left")


# R11
def fill_missing(df: DataFrame, cols: list[str] | None = None, num=-1, text: str = "missing") -> DataFrame:
    cols = cols or df.columns
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    types = dict(df.dtypes)
    fills = {}
    for c in cols:
        t = types[c]
        if t in numeric or t.startswith("decimal"):
            fills[c] = num
        elif t == "string":
            fills[c] = text
    return df.fillna(fills)


# R12
def recode_sentinels(df: DataFrame, cols: list[str], negative=-2, null=-1) -> DataFrame:
    return df.withColumns({
        c: F.when(F.col(c) < 0, F.lit(negative)).otherwise(F.coalesce(F.col(c), F.lit(null))) for c in cols})


# R13
def guarded_ratio(df: DataFrame, num: str, den: str, name: str, default: float = -1.0,
                  guards: list[Column] | None = None) -> DataFrame:
    """num/den, with the sentinel when the ratio is undefined or a guard fires."""
    r = safe_div(num, den, default)
    for g in guards or []:
        r = F.when(g, F.lit(default)).otherwise(r)
    return df.withColumn(name, r)


def _fitted(df: DataFrame, c: str, kind: str, name: str, by: list[str], method: str) -> DataFrame:
    if kind == "median":
        return quantiles(df, c, {name: 0.5}, by=by, method=method)
    if kind == "mode":
        return mode_of(df, c, name, by)
    if kind == "mean":
        return df.groupBy(*by).agg(F.avg(c).alias(name))
    raise ValueError(kind)


# R14
def fill_statistic(df: DataFrame, stats: dict[str, str], fit_df: DataFrame | None = None,
                   method: str = "exact") -> DataFrame:
    """Fill NULLs with a global median / mode / mean fitted on ``fit_df``.

    The fitted values form one row, attached through a scalar subquery.
    """
    fit = fit_df if fit_df is not None else df
    out = df
    for i, (c, kind) in enumerate(stats.items()):
        one = _fitted(fit, c, kind, "v", [], method)
        out = with_scalar(out, one, f"_fill{i}")  # one-row statistic as a scalar subquery
    return out.withColumns({
        c: F.coalesce(F.col(c).cast("double") if stats[c] == "median" else F.col(c), F.col(f"_fill{i}.v"))
        for i, c in enumerate(stats)}).drop(*[f"_fill{i}" for i in range(len(stats))])


# R15
def fill_group_statistic(df: DataFrame, group: str | list[str], stats: dict[str, str],
                         method: str = "exact") -> DataFrame:
    """Fill NULLs with a per-group median / mode (group keys: C11, NULL keys stay NULL)."""
    keys = [group] if isinstance(group, str) else list(group)
    fitted = None
    for c, kind in stats.items():
        part = _fitted(df.where(F.col(c).isNotNull()), c, kind, f"_f_{c}", keys, method)
        fitted = part if fitted is None else fitted.join(part, keys, "full")
    out = df.join(fitted, keys, "left")
    return out.withColumns({
        c: F.coalesce(F.col(c).cast("double") if stats[c] == "median" else F.col(c), F.col(f"_f_{c}"))
        for c in stats}).drop(*[f"_f_{c}" for c in stats])


# R16
def top_k(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """Sort + limit: planned as TakeOrderedAndProject (per-task top-k, then merge)."""
    return df.orderBy(*order).limit(k)


# R17
def sample_rows(df: DataFrame, key: str, frac: float | None = None, n: int | None = None) -> DataFrame:
    """Reproducible sample by key hash (C18): a fraction, or the n smallest hashes."""
    if frac is not None:
        return df.where(hash_prefix(key) < F.lit(frac * 2.0 ** 32))
    if n is not None:
        return df.orderBy(hash_prefix(key), F.col(key)).limit(n)
    raise ValueError("frac or n")
