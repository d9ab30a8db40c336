"""Scalar functions F1-F14: date, text, math and name rewriting.

All are JVM-side column expressions (whole-stage codegen, no Python workers).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.semantics import as_instant, col, elapsed_seconds as _elapsed_seconds, floor_days, shift_months as _shift

ColumnLike = Column | str


# F1
def epoch_to_ts(c: ColumnLike) -> Column:
    return F.timestamp_seconds(col(c))


# F2
def parse_date(c: ColumnLike, fmt: str = "yyyy-MM-dd", as_date: bool = True) -> Column:
    """Parse text by format; NULL on failure (ANSI-safe)."""
    ts = F.try_to_timestamp(col(c).cast("string"), F.lit(fmt))
    return F.to_date(ts) if as_date else ts


# F3
def date_parts(df: DataFrame, ts: str, prefix: str | None = None) -> DataFrame:
    p = prefix if prefix is not None else f"{ts}_"
    c = F.col(ts)
    return df.withColumns({
        f"{p}date": F.to_date(c),
        f"{p}year": F.year(c),
        f"{p}month": F.month(c),
        f"{p}weekday": F.weekday(c),
        f"{p}hour": F.hour(c),
    })


# F4
def calendar_flags(df: DataFrame, ts: str, holidays: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    p = prefix if prefix is not None else f"{ts}_"
    d = F.to_date(F.col(ts))
    hol = [F.lit(h).cast("date") for h in (holidays or [])]
    return df.withColumns({
        f"{p}is_weekend": F.weekday(d).isin(5, 6).cast("int"),
        f"{p}is_holiday": (d.isin(*hol) if hol else F.lit(False)).cast("int"),
    })


# F5
def week_of_month(c: ColumnLike) -> Column:
    """Monday-based week of month: ceil((day + weekday(first of month)) / 7)."""
    d = F.to_date(col(c))
    return F.ceil((F.dayofmonth(d) + F.weekday(F.trunc(d, "MM"))) / F.lit(7.0)).cast("int")


# F6
def to_local(c: ColumnLike, tz: str) -> Column:
    return F.from_utc_timestamp(as_instant(c), tz)


# F7
def elapsed_seconds(later: ColumnLike, earlier: ColumnLike) -> Column:
    return _elapsed_seconds(later, earlier)


def elapsed_days(later: ColumnLike, earlier: ColumnLike) -> Column:
    return floor_days(later, earlier)


# F8
def shift_months(c: ColumnLike, n: int) -> Column:
    return _shift(c, n)


# F9
def age(c: ColumnLike, as_of: ColumnLike | str, rule: str = "days365") -> Column:
    """Age in years under three rules.

    ``days365``: int(days / 365); ``years365_25``: days / 365.25;
    ``year_diff``: year(as_of) - year(birth).
    """
    ref = F.to_date(F.lit(as_of)) if isinstance(as_of, str) and not as_of.isidentifier() else F.to_date(col(as_of))
    born = F.to_date(col(c))
    days = F.datediff(ref, born)
    if rule == "days365":
        return (days / F.lit(365)).cast("int")
    if rule == "years365_25":
        return days / F.lit(365.25)
    if rule == "year_diff":
        return F.year(ref) - F.year(born)
    raise ValueError(rule)


# F10
def text_part(c: ColumnLike, sep: str, i: int) -> Column:
    """1-based part of a split (negative counts from the end); '' when absent."""
    return F.split_part(col(c), F.lit(sep), F.lit(i))


def leading_number(c: ColumnLike, sep: str = "/") -> Column:
    """Leading number of 'x/y' text (e.g. '4.1/5' -> 4.1); NULL when not numeric."""
    head = F.trim(F.split_part(col(c), F.lit(sep), F.lit(1)))
    return head.try_cast("double")


# F11
def concat_key(cols: list[ColumnLike], sep: str = "_") -> Column:
    """Composite text key; NULL when any part is NULL (as pandas string +)."""
    parts = [col(c).cast("string") for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep), p)
    return out


# F12
def log_features(df: DataFrame, cols: list[str], kind: str = "log1p", suffix: str | None = None) -> DataFrame:
    """log / log1p / exp with ANSI-safe guards (non-positive input -> NULL)."""
    sfx = suffix if suffix is not None else f"_{kind}"
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        if kind == "log":
            out[c + sfx] = F.when(x > 0, F.ln(x))
        elif kind == "log1p":
            out[c + sfx] = F.when(x > -1, F.log1p(x))
        elif kind == "exp":
            out[c + sfx] = F.exp(x)
        else:
            raise ValueError(kind)
    return df.withColumns(out)


# F13
def clamp_round(c: ColumnLike, lo: float = 0.0, digits: int = 2, half_even: bool = False) -> Column:
    x = F.greatest(col(c).cast("double"), F.lit(float(lo)))
    return F.bround(x, digits) if half_even else F.round(x, digits)


# F14
def display_names(df: DataFrame, feature: str, codes: DataFrame, systems: DataFrame, summary: bool = False,
                  display: str = "display") -> DataFrame:
    """``df`` with the display name of each ``family|...|last`` feature name by its family's rule.

    ``codes``: (url, code, name); of several names of a code the first counts; ``systems``:
    (short, url). Last part: Claims, Coverage, Claims_Coverage, Demographic;
    system and code: MedicalCodeCounter; disease: DiseaseTagCounter; system and the
    code's name: CrossCodeCounter (unknown codes keep their name); family and last
    part: LabInterpreter and, with ``summary``, Summary, whose rows go without it.
    Other families, and names too short for their rule, keep their name.
    """
    c = col(feature)
    family, last = F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(-1))
    second = F.get(F.split(last, "_"), F.lit(1))
    code = F.split_part(F.split_part(last, F.lit("_"), F.lit(-1)), F.lit("-"), F.lit(-1))
    cross = family == "CrossCodeCounter"
    named = (systems.join(codes, "url")
             .groupBy(F.col("short").alias("_short"), F.col("code").cast("string").alias("_code")).agg(F.min("name").alias("_name")))
    keyed = df.withColumns({"_system": F.when(cross, F.lower(second)), "_of": F.when(cross, code)})
    out = keyed.join(named, (F.col("_system") == F.col("_short")) & (F.col("_of") == F.col("_code")), "left")
    name = (F.when(family.isin("Claims", "Coverage", "Claims_Coverage", "Demographic"), last)
            .when(family == "MedicalCodeCounter", F.concat(second, F.lit("|"), F.split_part(last, F.lit("-"), F.lit(-1))))
            .when(family == "DiseaseTagCounter", second)
            .when(cross, F.concat(second, F.lit("|"), F.col("_name")))
            .when(family.isin("LabInterpreter", "Summary"), F.concat(family, F.lit("|"), last)))
    out = out.withColumn(display, F.coalesce(name, c))
    if not summary:
        out = out.where(F.coalesce(family != "Summary", F.lit(True)))
    return out.select(*df.columns, display)


def normalize_feature_name(c: ColumnLike, sep: str = ".", rules: dict[str, int] | None = None,
                           default_parts: int = 1) -> Column:
    """Rewrite a hierarchical feature name to its display name by family.

    The family is the first ``sep``-separated part; ``rules`` maps a family to
    how many leading parts form the display name (default ``default_parts``).
    Names without a separator pass through.
    """
    c = col(c)
    fam = F.split_part(c, F.lit(sep), F.lit(1))
    parts = F.split(c, re.escape(sep), -1)  # split takes a regex

    def first_n(n: int) -> Column:
        return F.array_join(F.slice(parts, 1, n), sep)

    expr = None
    for family, n in (rules or {}).items():
        cond = fam == F.lit(family)
        expr = F.when(cond, first_n(n)) if expr is None else expr.when(cond, first_n(n))
    dflt = first_n(default_parts)
    return dflt if expr is None else expr.otherwise(dflt)
