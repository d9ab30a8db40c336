"""Evaluation metrics (T1-T12), relational over (label, score[, weight, split]).

Ranking metrics (ROC, PR, AP) collapse rows to distinct scores first (a
map-side combined ``groupBy``), then take running sums along the score with
the range-partitioned prefix sums, so no single task sorts the table. Rows without
a score are left out. AUC and
AP are algebraic sums over the per-score rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import count_below, quantiles, quantiles_of, running_sums
from quarry.semantics import ratio_or_zero, safe_div, with_scalar
from quarry.session import PART_ROWS, stored


# T1
def confusion(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(label, pred, n) with overall accuracy attached."""
    by = list(by or [])
    cells = df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"))
    # classes squared rows: the accuracy is a ratio of their sums; a pair with a NULL is no answer
    known = F.when(F.col(label).isNotNull() & F.col(pred).isNotNull(), F.col("n"))
    hit = F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)
    acc = cells.groupBy(*by).agg(F.try_divide(F.sum(hit).cast("double"), F.sum(known)).alias("accuracy"))
    return cells.join(acc, by) if by else with_scalar(cells, acc, "_a").withColumn("accuracy", F.col("_a.accuracy")).drop("_a")


# T2
def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """precision, recall, f1, support per class, plus 'macro avg' and 'weighted avg' rows."""
    cells = df.groupBy(F.col(label).cast("string").alias("_y"), F.col(pred).cast("string").alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    # every cell counts for its true and for its predicted class: two rows a cell, classes squared cells
    sides = F.array(F.struct(F.col("_y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("n_pred")),
                    F.struct(F.col("_p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("n_pred")))
    hit = F.when((F.col("_y") == F.col("_p")) & (F.col("side.support") > 0), F.col("n")).otherwise(0)
    per = (cells.select("_y", "_p", "n", F.explode(sides).alias("side")).where("side.c is not null").groupBy(F.col("side.c").alias("c"))
           .agg(F.sum(hit).alias("tp"), F.sum("side.support").alias("support"), F.sum("side.n_pred").alias("n_pred")))
    per = per.select(F.col("c").alias("class"),
                     ratio_or_zero("tp", "n_pred").alias("precision"), ratio_or_zero("tp", "support").alias("recall"),
                     F.col("support").cast("bigint").alias("support"))
    per = per.withColumn("f1", ratio_or_zero(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                             F.col("precision") + F.col("recall")))
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.sum("support").cast("bigint").alias("support"), F.avg("f1").alias("f1"))
    tot = F.sum("support")
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                       tot.cast("bigint").alias("support"), (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"))
    return per.unionByName(macro).unionByName(weighted)


def _score_table(df: DataFrame, label: str, score: str, by: list[str], weight: str | None) -> DataFrame:
    """Per distinct score: positives and negatives at it, down to it (cum_) and in all (P, N).
    Rows without a score rank nowhere and are left out, in ``P`` and ``N`` too."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pos = F.when(F.col(label).cast("int") == 1, w).otherwise(F.lit(0.0))
    rows = df.where(F.col(score).isNotNull()).dropna(subset=by) if by else df.where(F.col(score).isNotNull())
    per = rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(pos).alias("pos"), F.sum(w - pos).alias("neg"))
    # descending score = ascending negated score
    cum = running_sums(per.withColumn("_k", -F.col("score")), "_k", ["pos", "neg"], by=by, totals_for=["pos", "neg"])
    return cum.withColumnsRenamed({"total_pos": "P", "total_neg": "N"}).drop("_k")


# T3
def roc(df: DataFrame, label: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """ROC points per distinct threshold: (threshold, tp, fp, tpr, fpr)."""
    by = list(by or [])
    s = _score_table(df, label, score, by, weight)
    return s.select(*by, F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    safe_div("cum_pos", "P").alias("tpr"), safe_div("cum_neg", "N").alias("fpr"))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Trapezoid area: sum over thresholds of neg_i * (tp_i + tp_{i-1}) / 2, over P*N.
    NULL where a class is absent."""
    by = list(by or [])
    s = _score_table(df, label, score, by, weight)
    area = F.sum(F.col("neg") * (F.lit(2.0) * F.col("cum_pos") - F.col("pos"))) / F.lit(2.0)
    return s.groupBy(*by).agg(F.try_divide(area, F.first("P") * F.first("N")).alias("auc"))


def binned_roc_auc(df: DataFrame, label: str, score: str, by: list[str], bins: int = 1000) -> DataFrame:
    """(by, auc): the area as Spark's ``BinaryClassificationMetrics`` makes it, of a curve thinned to one point for every
    (distinct scores / ``bins``) scores, whole number, if that is 2 or more.  NaN is the highest score; without positives the area is 0,
    without negatives 1.

    Rows are shuffled once, into ranges of the score of about ``PART_ROWS`` rows.  What is left of a range are its counts by distinct
    score, as packed arrays; they are stored, so that each range knows how many scores are above it."""
    rows = df.select(*by, F.col(score).cast("double").alias("_s"), (F.col(label) > 0.5).cast("long").alias("_pos"))
    n = max(-(-df.count() // PART_ROWS), 1)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def summed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby([*by, "_s"], dropna=False, as_index=False)[["_pos", "_n"]].sum()

    def pack(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.assign(_n=1))
            size += len(b)
            if size > 2_000_000:  # many rows of one score
                held = [summed(held)]
                size = len(held[0])
        if held:
            for key, g in summed(held).groupby(by, dropna=False):
                pos, every = g["_pos"].to_numpy(np.int64)[::-1], g["_n"].to_numpy(np.int64)[::-1]
                yield pd.DataFrame([[*key, len(g), pos.tobytes(), (every - pos).tobytes()]], columns=[*by, "_scores", "_pos", "_neg"])

    packed = rows.repartitionByRange(n, *by, "_s").mapInPandas(pack, f"{keys}, _scores long, _pos binary, _neg binary")
    packed = stored(packed.withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    above = group.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    # one row a part
    places = packed.select(*by, "_part", F.coalesce(F.sum("_scores").over(above), F.lit(0)).alias("_above"),
                           F.greatest(F.floor(F.sum("_scores").over(group) / bins), F.lit(1)).alias("_step"))

    def thin(batches):
        for b in batches:
            for r in b.to_dict("records"):
                at = (r["_above"] + np.arange(r["_scores"])) // r["_step"]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                pos, neg = (np.add.reduceat(np.frombuffer(r[c], np.int64), first) for c in ("_pos", "_neg"))
                yield pd.DataFrame({**{c: [r[c]] * len(first) for c in by}, "_at": at[first], "_pos": pos, "_neg": neg})

    placed = packed.join(F.broadcast(places), [*by, "_part"])
    points = placed.mapInPandas(thin, f"{keys}, _at long, _pos long, _neg long").groupBy(*by, "_at").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    # at most two times ``bins`` points a group
    down = group.orderBy("_at")
    share = lambda c, w: F.coalesce(F.try_divide(F.sum(c).over(w), F.sum(c).over(group)), F.lit(0.0))
    curve = points.select(*by, "_at", share("_neg", down).alias("x"), share("_pos", down).alias("y"))
    step = curve.withColumns({"_x": F.lag("x", 1, 0.0).over(down), "_y": F.lag("y", 1, 0.0).over(down)})
    area = F.sum((F.col("x") - F.col("_x")) * (F.col("y") + F.col("_y")) / 2)
    end = F.max(F.struct("_at", "x", "y"))
    return step.groupBy(*by).agg(area.alias("_a"), end.alias("_e")).select(
        *by, (F.col("_a") + (1 - F.col("_e.x")) * (F.col("_e.y") + 1) / 2).alias("auc"))


# T4
def pr_curve(df: DataFrame, label: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Precision-recall points per distinct threshold."""
    by = list(by or [])
    s = _score_table(df, label, score, by, weight)
    return s.select(*by, F.col("score").alias("threshold"),
                    safe_div("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                    safe_div("cum_pos", "P").alias("recall"))


def average_precision(df: DataFrame, label: str, score: str, by: list[str] | None = None,
                      weight: str | None = None) -> DataFrame:
    """AP = sum_i (R_i - R_{i-1}) * P_i over distinct thresholds (step interpolation).
    NULL without positives."""
    by = list(by or [])
    s = _score_table(df, label, score, by, weight)
    term = F.try_divide("pos", "P") * F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return s.groupBy(*by).agg(F.sum(term).alias("average_precision"))


# T5
def regression_metrics(df: DataFrame, y: str, p: str, n_features: int = 1, by: list[str] | None = None) -> DataFrame:
    """MAE, MSE, RMSE, R2, adjusted R2, MAPE in one aggregation.
    R2 is NULL for a constant y, adjusted R2 also for n = n_features + 1."""
    by = list(by or [])
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    e = yy - pp
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_sse"), F.var_pop(yy).alias("_vy"),
        F.avg(F.abs(F.try_divide(e, yy))).alias("mape"))
    r2 = F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("n"))
    return agg.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"),
                      (F.lit(1.0) - F.try_divide((F.lit(1.0) - r2) * (F.col("n") - 1), F.col("n") - n_features - 1)).alias("adj_r2"),
                      "mape")


# T6
def asymmetric_loss(df: DataFrame, y: str, p: str, factor: float = 4.0, by: list[str] | None = None) -> DataFrame:
    """Mean squared error with under-prediction (y > p) weighted by ``factor``."""
    by = list(by or [])
    e = F.col(y).cast("double") - F.col(p).cast("double")
    return df.groupBy(*by).agg(F.avg(F.when(e > 0, F.lit(factor) * e * e).otherwise(e * e)).alias("asymmetric_loss"))


def _top_metrics(df: DataFrame, y: str, p: str, q: float, by: list[str], prefix: str = "", prior: str | None = None) -> DataFrame:
    """Top-q membership by truth and by prediction, precision/recall/F1, cost capture."""
    if by:
        qy = quantiles(df, y, {"ty": q}, by=by)
        qp = quantiles(df, p, {"tp_": q}, by=by)
        t = df.join(qy, by).join(qp, by)
        if prior:
            t = t.join(quantiles(df, prior, {"_pq": q}, by=by), by)
    else:
        cuts = {y: {"ty": q}, p: {"tp_": q}} | ({prior: {"_pq": q}} if prior else {})
        both = quantiles_of(df, cuts)  # one pipeline for all columns
        t = with_scalar(df, both, "_q").withColumns({c: F.col(f"_q.{c}") for d in cuts.values() for c in d}).drop("_q")
    if prior:  # the cuts are those of all rows
        t = t.where(F.col(prior) < F.col("_pq"))
    yt, pt = F.col(y) > F.col("ty"), F.col(p) > F.col("tp_")
    agg = t.groupBy(*by).agg(
        F.count_if(yt & pt).alias("_tp"), F.count_if(pt).alias("_np"), F.count_if(yt).alias("_ny"),
        F.sum(F.when(pt, F.col(y).cast("double")).otherwise(0.0)).alias("_cap_pred"),
        F.sum(F.when(yt, F.col(y).cast("double")).otherwise(0.0)).alias("_cap_true"),
        F.sqrt(F.avg(F.when(yt, F.pow(F.col(y).cast("double") - F.col(p).cast("double"), 2)))).alias("_rmse"))
    prec, rec = ratio_or_zero("_tp", "_np"), ratio_or_zero("_tp", "_ny")
    return agg.select(*by, prec.alias(f"{prefix}precision"), rec.alias(f"{prefix}recall"),
                      ratio_or_zero(F.lit(2.0) * prec * rec, prec + rec).alias(f"{prefix}f1"),
                      ratio_or_zero("_cap_pred", "_cap_true").alias(f"{prefix}cost_capture"),
                      *[F.col("_rmse").alias(f"{prefix}rmse")] * bool(prior))


# T7
def top_decile_metrics(df: DataFrame, y: str, p: str, q: float = 0.9, by: list[str] | None = None) -> DataFrame:
    return _top_metrics(df, y, p, q, list(by or []))


# T8
def threshold_metrics(df: DataFrame, y: str, p: str, thresholds: list[float], by: list[str] | None = None,
                      probs: dict[float, str] | None = None, prior: str | None = None) -> DataFrame:
    """Per threshold t: RMSE of rows with y > t, precision/recall/F1 of (p > t vs y > t),
    cost capture sum(y | p>t)/sum(y | y>t), and AP for the label y > t, scored by
    ``probs[t]`` (a per-threshold classifier probability column) or by p. Given
    ``prior``, only rows with prior < t count for t.

    No row is copied per threshold: a row falls in one cell of the lattice of sorted
    thresholds (how many lie below y, below p, and not above prior), and all metrics are
    sums over the cells, a small table. AP takes one order per score column, with one
    count of positives and negatives per threshold.
    """
    by = list(by or [])
    ts = sorted({float(t) for t in thresholds})
    k = len(ts)
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    edges = F.array(*[F.lit(t) for t in ts])
    above = {"_iy": count_below(edges, yy, k), "_ip": count_below(edges, pp, k)}
    if prior:
        above["_ir"] = F.when(F.col(prior).isNull(), k).otherwise(count_below(edges, F.col(prior).cast("double"), k, closed=True))
    else:
        above["_ir"] = F.lit(0)
    keep = {"_y": yy, "_p": pp} | {f"_s{i}": F.coalesce(F.col(c).cast("double"), pp) for i, c in enumerate(sorted(set((probs or {}).values())))}
    rows = df.select(*by, *[c.alias(n) for n, c in (above | keep).items()])

    e = F.pow(F.col("_y") - F.col("_p"), 2)
    cells = rows.groupBy(*by, *above).agg(F.count(F.lit(1)).alias("_c"), F.sum("_y").alias("_sy"), F.sum(e).alias("_se"), F.count(e).alias("_ce"))
    x = cells.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("threshold", F.element_at(edges, F.col("_k")))
    counts = F.col("_ir") < F.col("_k")
    yt, pt = (F.col("_iy") >= F.col("_k")) & counts, (F.col("_ip") >= F.col("_k")) & counts
    total = lambda cond, c: F.sum(F.when(cond, F.coalesce(c, F.lit(0))).otherwise(0))
    agg = x.groupBy(*by, "threshold").agg(
        F.sqrt(F.try_divide(total(yt, "_se"), total(yt, "_ce"))).alias("rmse_above"), total(yt & pt, "_c").alias("_tp"), total(pt, "_c").alias("_np"),
        total(yt, "_c").alias("_ny"), total(pt, "_sy").alias("_cp"), total(yt, "_sy").alias("_ct"))
    prec, rec = ratio_or_zero("_tp", "_np"), ratio_or_zero("_tp", "_ny")
    base = agg.select(*by, "threshold", "rmse_above", prec.alias("precision"), rec.alias("recall"),
                      ratio_or_zero(F.lit(2.0) * prec * rec, prec + rec).alias("f1"),
                      ratio_or_zero("_cp", "_ct").alias("cost_capture"))

    score_of = {float(t): f"_s{sorted(set(probs.values())).index(c)}" for t, c in (probs or {}).items()}
    found = [_lattice_precision(rows, s, {i + 1: t for i, t in enumerate(ts) if score_of.get(t, "_p") == s}, by)
             for s in dict.fromkeys(score_of.get(t, "_p") for t in ts)]
    return base.join(reduce(DataFrame.unionByName, found), [*by, "threshold"], "left")


def _lattice_precision(rows: DataFrame, score: str, at: dict[int, float], by: list[str]) -> DataFrame:
    """(by, threshold, average_precision) of the thresholds ``at`` (by place in the lattice), all in one order of ``score``."""
    counted = {i: F.col("_ir") < i for i in at}
    rows = rows.where(F.col(score).isNotNull()).dropna(subset=by) if by else rows.where(F.col(score).isNotNull())
    per = rows.groupBy(*by, (-F.col(score)).alias("_k")).agg(
        *[F.count_if(counted[i] & (F.col("_iy") >= i)).alias(f"_p{i}") for i in at], *[F.count_if(counted[i]).alias(f"_n{i}") for i in at])
    cum = running_sums(per, "_k", [f"_{c}{i}" for i in at for c in "pn"], by=by, totals_for=[f"_p{i}" for i in at])
    term = lambda i: F.try_divide(F.col(f"_p{i}"), F.col(f"total__p{i}")) * F.try_divide(F.col(f"cum__p{i}"), F.col(f"cum__n{i}"))
    wide = cum.groupBy(*by).agg(F.array(*[F.struct(F.lit(t).alias("threshold"), F.sum(term(i)).alias("average_precision")) for i, t in at.items()]).alias("_a"))
    return wide.select(*by, F.explode("_a").alias("_a")).select(*by, "_a.*")


# T9
def newly_top_metrics(df: DataFrame, y: str, p: str, prior: str, q: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """T7 on the rows whose prior value is below its q-quantile (newly high), and the
    RMSE of its true top rows (NULL without any); all three cuts come from all rows."""
    return _top_metrics(df, y, p, q, list(by or []), prefix="newly_", prior=prior)


def newly_threshold_metrics(df: DataFrame, y: str, p: str, prior: str, thresholds: list[float], by: list[str] | None = None,
                            probs: dict[float, str] | None = None) -> DataFrame:
    """T8's precision, recall, F1 and AP per threshold on the rows whose prior value is
    below that threshold (newly high)."""
    names = {c: f"newly_{c}" for c in ("precision", "recall", "f1", "average_precision")}
    out = threshold_metrics(df, y, p, thresholds, by, probs, prior)
    return out.select(*(by or []), "threshold", *names).withColumnsRenamed(names)


# T10
def by_split(metric, df: DataFrame, split: str, **kw) -> DataFrame:
    """Any metric above, computed per split (the split becomes a grouping key)."""
    return metric(df, by=[split], **kw)


# T11
def cluster_profile(df: DataFrame, label: str, cols: list[Column | str]) -> DataFrame:
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(cs)])


# T12
def score_summary(df: DataFrame, y: str, p: str, period: str, method: str = "exact") -> DataFrame:
    means = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_true"), F.avg(p).alias("mean_pred"))
    my = quantiles(df, y, {"median_true": 0.5}, by=[period], method=method)
    mp = quantiles(df, p, {"median_pred": 0.5}, by=[period], method=method)
    return means.join(my, period).join(mp, period)
