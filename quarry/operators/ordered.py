"""Order statistics without a single-task sort.

* ``quantiles``: exact linear-interpolated quantiles (DuckDB ``quantile_cont`` /
  numpy ``linear``) by narrowing ranks.  A bounded sketch brackets every wanted rank in a
  small range of values; one pass counts what lies before, in and between the brackets,
  value by value inside them alone.  The exact counts prove that a rank is in its bracket (else
  the bracket is widened to that side) and a bracket with many distinct values is cut
  into cells and narrowed to the one or two that hold its rank, again and again.
  Only what is left (at most ``most`` values a bracket) is put in order.
* ``running_sums`` and ``dense_index``: cumulative sums and dense ranks along the whole
  order key.  Rows are range-partitioned on the full key, stored, and each part
  starts from the totals of the parts before it.  A hot group or a common prefix is
  split like anything else; only exactly equal keys stay together.

``method='approx'`` swaps in ``percentile_approx`` (a bounded sketch) and
``method='buffered'`` the built-in exact ``percentile`` (which buffers a
value->count map per group in one task: fine for small or low-cardinality
groups).  NULL group keys are dropped (C11).
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.semantics import with_scalar
from quarry.session import stored

#: Relative accuracy of the bracketing sketch (1 / ACCURACY of the rows).
ACCURACY = 10_000
#: Distances of a bracket's ends from its rank, as shares of the rows: the first that covers two rows is taken.
REACH = [4.0 ** k / 2500 for k in range(7)]
#: Cells a bracket is cut into, and the distinct values of a bracket that may be ordered.
CELLS, MOST = 64, 100_000


def _count_below(edges: Column, x: Column, n: int, closed: bool = False) -> Column:
    """Number of the ``n`` sorted edges below x (``closed``: not above x), as a balanced
    CASE tree (binary search, ~log2(n) comparisons per row, whole-stage codegen)
    instead of a per-row scan of the array. NULL edges, at the end, are above any x."""
    def under(i: int) -> Column:
        e = F.element_at(edges, F.lit(i))
        return e <= x if closed else e < x

    def node(lo: int, hi: int) -> Column:  # answer lies in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2  # is the mid-th edge (1-based) below x?
        return F.when(under(mid), node(mid, hi)).otherwise(node(lo, mid - 1))
    return node(0, n)


def count_below(edges: Column, x: Column, n: int, closed: bool = False) -> Column:
    """``_count_below`` for an array of at most ``n`` sorted edges."""
    return _count_below(F.slice(F.concat(edges, F.array_repeat(F.lit(None).cast("double"), n)), 1, n), x, n, closed)


def bucket_index(edges: Column, x: Column, n: int) -> Column:
    """Bucket [e_i, e_{i+1}) of x among at most ``n`` sorted distinct edges, the last one closed."""
    return F.greatest(F.least(count_below(edges, x, n, closed=True) - 1, F.size(edges) - 2), F.lit(0))


def _attach(df: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of ``state`` (one row per group, or one row)."""
    if by:
        return df.join(state, by)
    extra = state.columns
    return with_scalar(df, state, "_s").select(*df.columns, *[F.col(f"_s.{c}").alias(c) for c in extra])


def _brackets(rows: DataFrame, by: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """(by, _n, _lo, _hi): how many values, and per probability a range that should hold its ranks."""
    clamp = lambda p: min(max(p, 0.0), 1.0)
    marks = sorted({clamp(p + s * d) for p in probs for d in REACH for s in (-1, 1)})
    place = {m: i for i, m in enumerate(marks)}
    # the sketch may be off by its accuracy, and ranks n * p and (n - 1) * p by one
    enough = [math.ceil(2 / (d - 2 / ACCURACY)) for d in REACH[:-1]]
    wide = F.expr("CASE " + " ".join(f"WHEN _n >= {n} THEN {i}" for i, n in enumerate(enough)) + f" ELSE {len(enough)} END")

    def ends(sign: int) -> Column:  # by reach, then by probability: the place of the bracket's end among the marks
        at = ",".join("array(" + ",".join(str(place[clamp(p + sign * d)]) for p in probs) + ")" for d in REACH)
        return F.expr(f"transform(array({at})[_w], i -> _e[i])")

    sketch = rows.groupBy(*by).agg(F.count("_x").alias("_n"), F.percentile_approx("_x", marks, accuracy).alias("_e"))
    return sketch.where("_n > 0").withColumn("_w", wide).select(*by, "_n", ends(-1).alias("_lo"), ends(1).alias("_hi"))


# SQL text, as these expressions repeat for every bracket j

def _in(j: int) -> str:
    return f"(_x >= _lo[{j}] AND _x <= _hi[{j}])"


def _counted(rows: DataFrame, brackets: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, _x, _gap, _c): values inside a bracket with their counts; what lies between is one
    row after the last bracket before it (``_gap`` 1 at that bracket's end, NULL before all)."""
    met = _attach(rows, brackets.select(*by, "_lo", "_hi"), by)
    inside = "_gap = 0 AND (" + " OR ".join(_in(j) for j in range(k)) + ")"
    # the brackets' ends rise with their probabilities
    last = "CASE " + " ".join(f"WHEN _hi[{j}] < _x OR (_gap = 1 AND _hi[{j}] = _x) THEN _hi[{j}]" for j in reversed(range(k))) + " END"
    named = met.select(*by, "_c", F.expr(f"CASE WHEN {inside} THEN _x ELSE {last} END").alias("_at"), F.expr(f"CASE WHEN {inside} THEN 0 ELSE 1 END").alias("_gap"))
    return named.groupBy(*by, F.col("_at").alias("_x"), "_gap").agg(F.sum("_c").alias("_c"))


def _held(counts: DataFrame, brackets: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, _n, _lo, _hi, _before, _inside, _values): per bracket the rows before it, the rows and the distinct values in it."""
    met = _attach(counts, brackets, by)
    own = [f"_gap = 0 AND {_in(j)}" for j in range(k)]
    listed = lambda parts: F.expr(f"array({','.join(parts)})")
    return met.groupBy(*by).agg(
        F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        listed(f"sum(CASE WHEN coalesce(_x < _lo[{j}], true) THEN _c ELSE 0 END)" for j in range(k)).alias("_before"),
        listed(f"sum(CASE WHEN {own[j]} THEN _c ELSE 0 END)" for j in range(k)).alias("_inside"),
        listed(f"count_if({own[j]})" for j in range(k)).alias("_values"))


def _rank(p: float) -> Column:
    return (F.col("_n") - 1) * F.lit(float(p))


def _narrowed(counts: DataFrame, held: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Brackets cut into cells by the distinct values in them, and narrowed to the cells that hold their ranks."""
    k = len(probs)
    met = _attach(counts.where("_gap = 0"), held, by)
    each = met.select(*by, "_x", "_c", F.expr("explode(array(" + ",".join(f"CASE WHEN {_in(j)} THEN {j} END" for j in range(k)) + "))").alias("_j")).where("_j is not null")
    edges = each.groupBy(*by, "_j").agg(F.percentile_approx("_x", [i / CELLS for i in range(1, CELLS)], ACCURACY).alias("_e"))
    cells = each.join(edges, [*by, "_j"]).groupBy(*by, "_j", _count_below(F.col("_e"), F.col("_x"), CELLS - 1).alias("_cell")).agg(
        F.sum("_c").alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    order = Window.partitionBy(*by, "_j").orderBy("_cell")
    cells = _attach(cells.withColumn("_end", F.sum("_c").over(order)), held, by)
    at = F.col("_before")[F.col("_j")]
    rank = F.element_at(F.array(*[_rank(p) for p in probs]), F.col("_j") + 1)
    holds = (at + F.col("_end") - F.col("_c") <= F.ceil(rank)) & (F.floor(rank) < at + F.col("_end"))
    ends = cells.where(holds).groupBy(*by, "_j").agg(F.min("_min").alias("_lo"), F.max("_max").alias("_hi"))
    packed = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_j", "_lo", "_hi"))).alias("_b"))
    return _attach(packed, held.select(*by, "_n"), by).select(
        *by, "_n", F.transform("_b", lambda b: b["_lo"]).alias("_lo"), F.transform("_b", lambda b: b["_hi"]).alias("_hi"))


def _fixed(state: DataFrame, by: list[str], few: bool) -> DataFrame:
    """``state`` evaluated once: a row a group, stored, or brought to the driver where the groups are one or columns of a schema."""
    if by and not few:
        return stored(state)
    return state.sparkSession.createDataFrame(state.toArrow(), state.schema)


def _narrow(rows: DataFrame, by: list[str], probs: list[float], accuracy: int, most: int, few: bool) -> tuple[DataFrame, DataFrame]:
    """Counts in brackets that hold all ranks in at most ``most`` distinct values each, and how many values each group has."""
    k = len(probs)
    brackets = _fixed(_brackets(rows, by, probs, accuracy), by, few)
    counts = stored(_counted(rows, brackets, by, k))
    while True:
        held = _held(counts, brackets, by, k)
        low = [f"_before[{j}] > floor((_n - 1) * {p!r}D)" for j, p in enumerate(probs)]
        high = [f"_before[{j}] + _inside[{j}] <= ceil((_n - 1) * {p!r}D)" for j, p in enumerate(probs)]
        missed = F.expr(" OR ".join(low + high))
        values, wrong = held.agg(F.max(F.array_max("_values")), F.bool_or(missed)).first()
        if wrong:
            wider = lambda c, miss, far: F.expr("array(" + ",".join(f"CASE WHEN {m} THEN double('{far}') ELSE {c}[{j}] END" for j, m in enumerate(miss)) + ")")
            # brackets stay in order: one without end ends all after it
            rising = F.transform(wider("_hi", high, "NaN"), lambda x, i: F.array_max(F.slice(wider("_hi", high, "NaN"), F.lit(1), i + 1)))
            brackets = _fixed(held.select(*by, "_n", wider("_lo", low, "-Infinity").alias("_lo"), rising.alias("_hi")), by, few)
            counts = stored(_counted(rows, brackets, by, k))
        elif (values or 0) > most:
            brackets = _fixed(_narrowed(counts, held, by, probs), by, few)
            counts = stored(_counted(counts, brackets, by, k))
        else:
            return counts, brackets.select(*by, "_n")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None,
              method: str = "exact", few: bool = False, accuracy: int = ACCURACY, most: int = MOST) -> DataFrame:
    """One row per group with a column per named probability.

    NULL values and NULL group keys are ignored; groups with no value are absent, and
    without groups an empty table gives one row of NULLs (as in SQL).  ``df`` is
    read twice (sketch, counts), so it should be deterministic and cheap, or stored.
    ``few``: the groups are columns of a schema, so their brackets fit on the driver.
    """
    by = list(by or [])
    v = df.select(*by, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    if by:
        v = v.dropna(subset=by)
    if method == "approx":
        return v.groupBy(*by).agg(*[
            F.percentile_approx("_x", p, 100_000).cast("double").alias(n) for n, p in probs.items()])
    if method == "buffered":
        return v.groupBy(*by).agg(*[F.percentile("_x", p).alias(n) for n, p in probs.items()])

    wanted = sorted(set(probs.values()))
    counts, sizes = _narrow(v.withColumns({"_gap": F.lit(0), "_c": F.lit(1).cast("long")}), by, wanted, accuracy, most, few)
    # at most ``most`` values a bracket are left of a group: bounded, whatever its size
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_x"), "_gap")
    ranked = _attach(counts.withColumn("_end", F.sum("_c").over(order) - 1), sizes, by).withColumn("_start", F.col("_end") + 1 - F.col("_c"))
    aggs = []
    for i, p in enumerate(wanted):
        h = f"(_n - 1) * {p!r}D"
        aggs += [F.expr(f"max(CASE WHEN _start <= {end}({h}) AND {end}({h}) <= _end THEN _x END)").alias(f"_{end}_{i}") for end in ("floor", "ceil")]
        aggs.append(F.expr(f"max({h} - floor({h}))").alias(f"_f_{i}"))
    picked = ranked.groupBy(*by).agg(*aggs)
    at = {p: i for i, p in enumerate(wanted)}
    return picked.select(*by, *[
        # lo*(1-f) + hi*f, the floating-point form of Spark's percentile
        F.expr("CASE WHEN _floor_{0} = _ceil_{0} THEN _floor_{0} ELSE _floor_{0} * (1.0D - _f_{0}) + _ceil_{0} * _f_{0} END".format(at[p])).alias(n)
        for n, p in probs.items()])


def quantiles_of(df: DataFrame, specs: dict[str, dict[str, float]], method: str = "exact") -> DataFrame:
    """Whole-table quantiles of several columns in ONE pipeline, as one row.

    ``specs`` maps a column to {output name: probability}. The columns are
    unpivoted into a long table whose group key is the column name, so a
    single sketch and one pass of counts serve them all.
    """
    cols = list(specs)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "_col", "_v")
    wanted = sorted({p for names in specs.values() for p in names.values()})
    q = quantiles(long, "_v", {f"_q{i}": p for i, p in enumerate(wanted)}, by=["_col"], method=method, few=True)
    return q.agg(*[F.max(F.when(F.col("_col") == F.lit(c), F.col(f"_q{wanted.index(p)}"))).alias(name)
                   for c, names in specs.items() for name, p in names.items()])


def running_sums(df: DataFrame, order: str | list[str], sums: list[str], by: list[str] | None = None,
                 prefix: str = "cum_", totals_for: list[str] | None = None, total_prefix: str = "total_") -> DataFrame:
    """Add ``cum_<s>`` = sum of ``s`` over rows with order key <= this row's key.

    Requires the ``order`` columns to be unique within each group (pre-aggregate first)
    and non-null, as the group keys. Ascending order; negate the key for descending.
    ``totals_for`` adds group totals ``total_<s>``.

    Rows are range-partitioned on (by, order) as a whole and stored: a recomputed task
    finds the same parts. A part adds up its own rows of a group, after the totals of the
    group's parts before it (as many rows as there are parts, for each group that spans several).
    """
    by = list(by or [])
    keys = [*by, *([order] if isinstance(order, str) else order)]
    parts = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
                            *[F.sum(f"_t_{s}").over(Window.partitionBy(*by)).alias(f"{total_prefix}{s}") for s in (totals_for or [])])
    if not by:
        # one row a part: bounded by the number of shuffle partitions
        offsets = F.broadcast(offsets)
    joined = parts.join(offsets, [*by, "_part"])
    inside = Window.partitionBy(*by, "_part").orderBy(*keys[len(by):]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(*[c for c in joined.columns if not c.startswith("_o_") and c != "_part"],
                         *[(F.col(f"_o_{s}") + F.sum(s).over(inside)).alias(f"{prefix}{s}") for s in sums])


def dense_index(df: DataFrame, key: str | list[str], by: list[str] | None = None, name: str = "index") -> DataFrame:
    """Distinct ``key`` tuples (per ``by`` group) with a dense 0-based index in
    ascending key order, without a single-task global sort and whatever prefixes the keys share."""
    by = list(by or [])
    keys = [key] if isinstance(key, str) else list(key)
    d = df.select(*by, *keys).dropna(subset=[*by, keys[0]]).distinct().withColumn("_one", F.lit(1))
    r = running_sums(d, keys, ["_one"], by=by)
    return r.select(*by, *keys, (F.col("cum__one") - 1).cast("int").alias(name))
