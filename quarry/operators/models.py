"""Models: training and batch scoring through pyspark.ml.

Fits are the only actions in the library. Every result table (coefficients,
importances, sweeps, PCA loadings) is bounded by the number of features or
settings, never by the row count. Iterative fits cut lineage with a reliable
checkpoint in the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.features import anova_f, select_k_best
from quarry.operators.metrics import binned_roc_auc
from quarry.session import cut_lineage, dealt, freed_shuffles, stored
from quarry.sources.io import scratch_path


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _narrow(df: DataFrame, cols: list[str], *others: str | None) -> DataFrame:
    """The columns that a fit reads.  Trees hold their rows as objects, some 250 bytes each, so fits of trees have them dealt."""
    return df.select(*dict.fromkeys([*cols, *[c for c in others if c]]))


# L1
def fit_logistic(df: DataFrame, cols: list[str], label: str, reg: float = 0.01, weight: str | None = None,
                 max_iter: int = 100, tol: float = 1e-6):
    """L2-regularised logistic regression; returns (model, ranked coefficient table)."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0,
                            maxIter=max_iter, tol=tol, **({"weightCol": weight} if weight else {}))
    model = lr.fit(assemble(df, cols))
    coefs = [(c, float(v), abs(float(v))) for c, v in zip(cols, model.coefficients.toArray())]
    coefs.sort(key=lambda r: (-r[2], r[0]))
    table = _table(df.sparkSession, [(i + 1, c, v) for i, (c, v, _) in enumerate(coefs)] +
                   [(0, "intercept", float(model.intercept))], "rank int, feature string, coefficient double")
    return model, table


# L2
def fit_forest(df: DataFrame, cols: list[str], label: str, kind: str = "classification", trees: int = 50,
               depth: int = 5, seed: int = 42, weight: str | None = None, bootstrap: bool = True):
    cls = RandomForestClassifier if kind == "classification" else RandomForestRegressor
    est = cls(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, bootstrap=bootstrap,
              **({"weightCol": weight} if weight else {}))
    return est.fit(assemble(dealt(_narrow(df, cols, label, weight)), cols))


# L3
def fit_boosted_classifier(df: DataFrame, cols: list[str], label: str, iters: int = 250, depth: int = 4,
                           rate: float = 0.1, seed: int = 42, weight: str | None = None):
    est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=iters, maxDepth=depth, stepSize=rate,
                        seed=seed, **({"weightCol": weight} if weight else {}))
    return est.fit(assemble(dealt(_narrow(df, cols, label, weight)), cols))


# L4
def fit_boosted_regressor(df: DataFrame, cols: list[str], label: str, iters: int = 100, depth: int = 4,
                          rate: float = 0.1, validation: str | None = None, tol: float = 0.01, seed: int = 42):
    """Boosted trees; with ``validation`` (a boolean column) training stops early
    when the validation error stops improving by ``tol``."""
    kw = {"validationIndicatorCol": validation, "validationTol": tol} if validation else {}
    est = GBTRegressor(featuresCol="features", labelCol=label, maxIter=iters, maxDepth=depth, stepSize=rate,
                       seed=seed, **kw)
    return est.fit(assemble(dealt(_narrow(df, cols, label, validation)), cols))


# L5
#: Rounds between two stored tables of margins.
KEEP = 8


class NewtonBoostModel:
    """base + rate * sum(tree predictions); ``losses`` has (training, validation) loss by round."""

    def __init__(self, cols, base, rate, trees, losses=()):
        self.cols, self.base, self.rate, self.trees, self.losses = cols, base, rate, trees, list(losses)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        cur = assemble(df, self.cols).withColumn(out, F.lit(self.base))
        for i, t in enumerate(self.trees):
            cur = t.setPredictionCol(f"_t{i}").transform(cur)
            cur = cur.withColumn(out, F.col(out) + F.lit(self.rate) * F.col(f"_t{i}")).drop(f"_t{i}")
        return cur.drop("features")


def _moved(df: DataFrame, trees: list, rate: float) -> DataFrame:
    """``df`` with the margin ``_p`` moved by each of ``trees``."""
    for t in trees:
        df = t.setPredictionCol("_step").transform(df).withColumn("_p", F.col("_p") + F.lit(rate) * F.col("_step")).drop("_step")
    return df


def _bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by ``key``: tables bucketed alike join without a shuffle."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"quarry_{name}_{uuid.uuid4().hex}"
    # one file a bucket
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def fit_newton_boosting(df: DataFrame, cols: list[str], label: str, factor: float = 4.0, rounds: int = 250,
                        rate: float = 0.3, depth: int = 3, validation: str | None = None, patience: int = 10,
                        tol: float = 0.0) -> NewtonBoostModel:
    """Gradient boosting with the asymmetric squared loss
    L = factor * r^2 if r = y - p > 0 else r^2 (under-prediction costs more).

    Each round fits a weighted regression tree to the Newton target
    -g/h (= r for this loss) with weight h (2*factor or 2), so every leaf
    value is the Newton step sum(-g)/sum(h). The rows are written once; every ``KEEP`` rounds
    their margins alone (row, prediction so far) are, bucketed like the rows, so
    neither is shuffled for their join and no plan grows with the rounds.  The trees since
    are applied as rows are read.

    With ``validation`` (a boolean column) those rows are not trained on, and training stops
    when their mean loss has not fallen by more than ``tol`` (a share of the best) for ``patience`` rounds; the
    trees up to the best round stay.
    """
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    data = assemble(df.select(*cols, F.col(label).cast("double").alias("_y"), held.alias("_held")), cols).select("features", "_y", "_held")
    rows = _bucketed(stored(data.withColumn("_row", F.monotonically_increasing_id())), "_row", "rows")
    base, n = rows.where(~F.col("_held")).agg(F.avg("_y"), F.count(F.lit(1))).first()
    base, margins, since = float(base), None, []
    now = lambda: _moved(rows.join(margins, "_row") if margins is not None else rows.withColumn("_p", F.lit(base)), since, rate)
    r = F.col("_y") - F.col("_p")
    loss = F.when(r > 0, F.lit(factor) * r * r).otherwise(r * r)
    trees, losses, best, best_at = [], [], math.inf, 0
    for i in range(rounds):
        step = now().where(~F.col("_held")).select("features", r.alias("_r"), F.when(r > 0, F.lit(2.0 * factor)).otherwise(F.lit(2.0)).alias("_h"))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="_r", weightCol="_h", maxDepth=depth,
                                     predictionCol="_step").fit(dealt(step, n=n))
        trees.append(tree)
        since.append(tree)
        if len(since) == KEEP:
            margins, since = _bucketed(now().select("_row", "_p"), "_row", "margins"), []
        by = now().agg(F.avg(F.when(~F.col("_held"), loss)), F.avg(F.when(F.col("_held"), loss))).first()
        losses.append(tuple(by))
        if validation and by[1] is not None:
            if by[1] < best * (1 - tol):
                best, best_at = by[1], i + 1
            elif i + 1 - best_at >= patience:
                break
    return NewtonBoostModel(cols, base, rate, trees[:best_at] if validation and best_at else trees, losses)


# L6
def fit_threshold_classifiers(df: DataFrame, cols: list[str], y: str, thresholds: list[float], iters: int = 250):
    """One boosted classifier per threshold t on the label y > t."""
    models = {}
    df = stored(df.select(*dict.fromkeys([*cols, y])))  # read by every fit
    for t in thresholds:
        lab = df.withColumn("_lab", (F.col(y) > t).cast("double"))
        models[t] = fit_boosted_classifier(lab, cols, "_lab", iters=iters)
    return models


# L7
def fit_kmeans(df: DataFrame, features: str | list[str], k: int, seed: int = 42, max_iter: int = 30):
    """Returns (model, labelled frame, centres table, training cost)."""
    data = df if isinstance(features, str) else assemble(df, features)
    fcol = features if isinstance(features, str) else "features"
    data = stored(data)  # every iteration reads it again
    model = KMeans(featuresCol=fcol, k=k, seed=seed, maxIter=max_iter, predictionCol="cluster").fit(data)
    centres = _table(df.sparkSession, [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                     "cluster int, centre array<double>")
    return model, model.transform(data), centres, float(model.summary.trainingCost)


# L8
def kmeans_sweep(df: DataFrame, features: str, ks: list[int], seed: int = 42) -> DataFrame:
    """(k, cost, silhouette) per k; silhouette is Spark's squared-Euclidean one.

    Besides the fits, the rows are read twice however many k there are: one pass assigns
    each row under every model and adds up moments by (k, cluster), the other scores it under every model."""
    data = stored(df.select(F.col(features)))
    models = {k: KMeans(featuresCol=features, k=k, seed=seed, predictionCol="cluster").fit(data) for k in ks}
    scores = silhouettes(data, features, {k: np.stack(m.clusterCenters()) for k, m in models.items()})
    costs = _table(df.sparkSession, [(k, float(m.summary.trainingCost)) for k, m in models.items()], "k int, cost double")
    return costs.join(scores, "k").select("k", "cost", "silhouette")


def silhouettes(df: DataFrame, features: str, centres: dict[int, np.ndarray]) -> DataFrame:
    """(k, silhouette): the mean silhouette of all rows under each of several sets of centres.

    The moments (count, mean vector, mean squared norm) are a row a cluster, bounded by the sets.
    """
    x = df.select(vector_to_array(features).alias("x"))
    first = np.cumsum([0, *[len(c) for c in centres.values()]])
    whole = np.concatenate(list(centres.values()))

    def assigned(v: np.ndarray) -> list[np.ndarray]:
        d = (v ** 2).sum(axis=1)[:, None] - 2 * v @ whole.T + (whole ** 2).sum(axis=1)
        return [d[:, lo:hi].argmin(axis=1) + lo for lo, hi in zip(first[:-1], first[1:], strict=True)]

    def add(parts):
        n, total, norm = np.zeros(len(whole)), np.zeros(whole.shape), np.zeros(len(whole))
        for part in parts:
            if len(part):
                v = np.stack(part["x"].to_numpy())
                for at in assigned(v):
                    np.add.at(n, at, 1)
                    np.add.at(total, at, v)
                    np.add.at(norm, at, (v ** 2).sum(axis=1))
        yield pd.DataFrame({"at": np.arange(len(whole)), "n": n, "total": list(total), "norm": norm})

    d = whole.shape[1]
    moments = x.mapInPandas(add, "at int, n double, total array<double>, norm double")
    rows = moments.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(d)]).alias("total"), F.sum("norm").alias("norm"))
    found = {r["at"]: r for r in rows.collect()}
    n = np.array([found[i]["n"] if i in found else 0.0 for i in range(len(whole))])
    mean = np.stack([np.array(found[i]["total"]) if i in found else np.zeros(d) for i in range(len(whole))]) / np.maximum(n, 1)[:, None]
    norm = np.array([found[i]["norm"] if i in found else 0.0 for i in range(len(whole))]) / np.maximum(n, 1)

    def score(parts):
        total, count = np.zeros(len(centres)), 0
        for part in parts:
            if len(part):
                v = np.stack(part["x"].to_numpy())
                far = np.maximum((v ** 2).sum(axis=1)[:, None] - 2 * v @ mean.T + norm, 0)
                far[:, n == 0] = np.inf
                count += len(v)
                for j, at in enumerate(assigned(v)):
                    own = far[np.arange(len(v)), at] * n[at] / np.maximum(n[at] - 1, 1)
                    rest = far[:, first[j]:first[j + 1]].copy()
                    rest[np.arange(len(v)), at - first[j]] = np.inf
                    other = rest.min(axis=1)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        s = (other - own) / np.maximum(own, other)
                    total[j] += np.where((n[at] <= 1) | ~np.isfinite(other) | (np.maximum(own, other) == 0), 0.0, s).sum()
        yield pd.DataFrame({"k": list(centres), "total": total, "n": count})

    sums = x.mapInPandas(score, "k int, total double, n long")
    return sums.groupBy("k").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("silhouette"))


def row_silhouette(df: DataFrame, features: str, cluster: str = "cluster", name: str = "silhouette") -> DataFrame:
    """Per-row silhouette with squared Euclidean distance (the measure Spark's
    ClusteringEvaluator averages).

    The mean squared distance from x to cluster c is
    |x|^2 - 2 x.mu_c + mean_c(|y|^2), so only per-cluster count, mean vector
    and mean squared norm are needed: k summaries (bounded by k), attached to
    every row as literals; no pairwise distances are formed.
    """
    x = vector_to_array(features)
    norm2 = F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda a, b: a + b)
    base = df.select("*", x.alias("_x"), norm2.alias("_n2"))
    dim = len(base.select("_x").first()[0])
    stats = base.groupBy(cluster).agg(F.count(F.lit(1)).alias("_cnt"), F.avg("_n2").alias("_s"),
                                      *[F.avg(F.col("_x")[i]).alias(f"_m{i}") for i in range(dim)]).collect()
    stats = sorted(stats, key=lambda r: r[cluster])  # k rows
    dists = []
    for r in stats:
        mu = F.array(*[F.lit(float(r[f"_m{i}"])) for i in range(dim)])
        dot = F.aggregate(F.zip_with(F.col("_x"), mu, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        dists.append(F.struct(F.lit(r[cluster]).alias("c"), F.lit(int(r["_cnt"])).alias("n"),
                              (F.col("_n2") - 2 * dot + F.lit(float(r["_s"]))).alias("d")))
    t = base.withColumn("_d", F.array(*dists))
    mine = F.filter("_d", lambda e: e["c"] == F.col(cluster))[0]
    # the point itself is excluded from its own cluster's mean: scale by n/(n-1)
    own = mine["d"] * mine["n"] / (mine["n"] - 1)
    other = F.array_min(F.transform(F.filter("_d", lambda e: e["c"] != F.col(cluster)), lambda e: e["d"]))
    sil = (F.when(other.isNull() | (mine["n"] <= 1), F.lit(0.0))
           .otherwise((other - own) / F.greatest(own, other)))
    return t.withColumn(name, sil).drop("_x", "_n2", "_d")


# L9
def grid_search(df: DataFrame, cols: list[str], label: str, estimator, grid: dict, folds: int = 3,
                fold_col: str | None = None, metric: str = "areaUnderROC", seed: int = 42):
    """k-fold (or given fold column, e.g. time blocks) cross-validated grid search.

    The rows are written once, by fold, and every fit reads the folds it is trained on; nothing but the
    estimator's own blocks is held in memory.  Areas under ROC of all settings and folds are made in one
    job, binned like ``BinaryClassificationEvaluator``'s; other metrics come from Spark's evaluators."""
    from itertools import product
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
    b = ParamGridBuilder()
    for p, vals in grid.items():
        b = b.addGrid(getattr(estimator, p), vals)
    settings = b.build()
    ev = (BinaryClassificationEvaluator(labelCol=label, metricName=metric) if metric in ("areaUnderROC", "areaUnderPR")
          else RegressionEvaluator(labelCol=label, metricName=metric))
    kw = {"foldCol": fold_col, "numFolds": folds} if fold_col else {"numFolds": folds, "seed": seed}
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=settings, evaluator=ev, parallelism=2, **kw)
    data = _stored_by_fold(df, cols, folds, fold_col, seed)
    parts = [(data.where(F.col("_fold") != i), data.where(F.col("_fold") == i)) for i in range(folds)]

    def fit(task: tuple[int, int]) -> tuple:
        i, j = task
        model = estimator.fit(parts[i][0], settings[j])
        return model, None if metric == "areaUnderROC" else float(ev.evaluate(model.transform(parts[i][1])))

    tasks = list(product(range(folds), range(len(settings))))
    with ThreadPool(cv.getParallelism()) as pool:
        fits = dict(zip(tasks, pool.map(fit, tasks, chunksize=1), strict=True))
    if metric == "areaUnderROC":
        found = _areas(parts, [[fits[i, j][0] for j in range(len(settings))] for i in range(folds)], label)
    else:
        found = {t: m for t, (_, m) in fits.items()}
    by_fold = np.array([[found[i, j] for j in range(len(settings))] for i in range(folds)])
    metrics = [float(m) for m in by_fold.mean(axis=0)]
    best = settings[int(np.argmax(metrics) if ev.isLargerBetter() else np.argmin(metrics))]
    model = cv._copyValues(CrossValidatorModel(estimator.fit(data, best), metrics, [], [float(m) for m in by_fold.std(axis=0)]))
    rows = [(str({p.name: v for p, v in pm.items()}), m) for pm, m in zip(settings, metrics, strict=True)]
    return model, _table(df.sparkSession, rows, "params string, metric double")


def _stored_by_fold(df: DataFrame, cols: list[str], folds: int, fold_col: str | None, seed: int) -> DataFrame:
    """``df`` with features and ``_fold``, in a folder for each fold; random folds are those of ``CrossValidator``."""
    spark = df.sparkSession
    if fold_col:
        fold = F.col(fold_col).cast("int")
    else:
        df = df.withColumn("_rand", F.rand(seed))
        fold = sum((F.when(F.col("_rand") >= i / folds, 1).otherwise(0) for i in range(1, folds)), F.lit(0))
    data = assemble(dealt(df.withColumn("_fold", fold).drop("_rand")), cols)
    path = scratch_path(spark, "folds")
    with freed_shuffles(spark):
        data.write.partitionBy("_fold").parquet(path)
    data = spark.read.schema(data.schema).parquet(path)
    if fold_col:
        seen = {r[0] for r in data.select("_fold").distinct().collect()}
        if wrong := [f for f in seen if f is None or not 0 <= f < folds]:
            raise ValueError(f"Fold number must be in range [0, {folds}), but got {wrong[0]}")
        for i in range(folds):
            if not seen - {i}:
                raise ValueError(f"The training data at fold {i} is empty.")
            if i not in seen:
                raise ValueError(f"The validation data at fold {i} is empty.")
    return data


def _areas(parts: list[tuple[DataFrame, DataFrame]], models: list[list], label: str) -> dict[tuple[int, int], float]:
    """Area under ROC by (fold, setting): each fold's held-out rows are read once and scored by all its models."""
    every = None
    for i, (_, held) in enumerate(parts):
        cur = held
        for j, m in enumerate(models[i]):
            scored = m.transform(cur)
            s = F.col("rawPrediction")
            if scored.schema["rawPrediction"].dataType.typeName() != "double":
                s = vector_to_array(s)[1]
            cur = scored.select(*cur.columns, s.alias(f"_s{j}"))
        scores = F.explode(F.array(*[F.struct(F.lit(j).alias("setting"), F.col(f"_s{j}").alias("score")) for j in range(len(models[i]))]))
        rows = cur.select(F.lit(i).alias("fold"), label, scores.alias("_s")).select("fold", "_s.setting", "_s.score", label)
        every = rows if every is None else every.unionByName(rows)
    areas = {(r["fold"], r["setting"]): r["auc"] for r in binned_roc_auc(every, label, "score", ["fold", "setting"]).collect()}
    # without rows the curve is the diagonal
    return {(i, j): areas.get((i, j), 0.5) for i in range(len(parts)) for j in range(len(models[i]))}


def rotation_search(df: DataFrame, cols: list[str], label: str, estimator, grid: dict, period: str, metric: str = "rmse",
                    parallelism: int = 4) -> DataFrame:
    """(setting, <parameters>, rotation, metric): each setting of the grid, fitted on all periods but one and
    tested on that one, for every period.

    Periods become folds of one stored table, read by all fits; ``parallelism`` fits run at a
    time. Results are told by (setting, rotation), whatever the order in which fits end."""
    from itertools import product
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    folds = stored(assemble(block_folds(df.select(*cols, label, period), period), cols).select("fold", "features", label))
    rotations = sorted(r[0] for r in folds.select("fold").distinct().collect())
    names = list(grid)
    settings = list(product(*[grid[n] for n in names]))
    ev = (BinaryClassificationEvaluator(labelCol=label, metricName=metric) if metric in ("areaUnderROC", "areaUnderPR")
          else RegressionEvaluator(labelCol=label, metricName=metric))

    def fit(task: tuple[int, int]) -> tuple:
        i, rotation = task
        params = {estimator.getParam(n): v for n, v in zip(names, settings[i], strict=True)}
        model = estimator.fit(folds.where(F.col("fold") != rotation), params)
        return i, *[float(v) for v in settings[i]], int(rotation), float(ev.evaluate(model.transform(folds.where(F.col("fold") == rotation))))

    with ThreadPool(parallelism) as pool:
        rows = pool.map(fit, [(i, r) for i in range(len(settings)) for r in rotations], chunksize=1)
    return _table(df.sparkSession, rows, "setting int, " + ", ".join(f"{n} double" for n in names) + ", rotation int, metric double")


def block_folds(df: DataFrame, period: str, name: str = "fold") -> DataFrame:
    """Time-block rotation: the fold id is the (dense) rank of the period."""
    from pyspark.sql import Window
    # one row per period: bounded by the calendar, not by the data, so a
    # single ranking task over the distinct periods is fine
    periods = df.select(period).distinct()
    ids = periods.withColumn(name, (F.dense_rank().over(Window.orderBy(period)) - 1).cast("int"))
    return df.join(F.broadcast(ids), period)


# L10
def sweep(df: DataFrame, values: list, fit, score) -> DataFrame:
    """Fit once per setting value on one stored input; one (value, score) row each."""
    data = cut_lineage(dealt(df))
    rows = [(str(v), float(score(fit(data, v)))) for v in values]
    return _table(df.sparkSession, rows, "value string, score double")


def sweep_feature_counts(df: DataFrame, features: list[str], label: str, counts: list[int], fit, score) -> DataFrame:
    """(value, score): for each of ``counts``, ``fit(data, columns)`` on that many features, the best by
    ANOVA F (ties by name), and ``score(model, data, columns)``.  F scores are made once, on the
    stored input; features are columns, so their ranking is bounded by the schema."""
    data = cut_lineage(dealt(df))
    ranked = [r["feature"] for r in select_k_best(anova_f(data, features, label), max(counts)).collect()]
    rows = [(str(k), float(score(fit(data, ranked[:k]), data, ranked[:k]))) for k in counts]
    return _table(df.sparkSession, rows, "value string, score double")


# L11
def importance_table(model, names: list[str], n: int | None = None, relative: bool = True) -> DataFrame:
    """Ranked feature importances, top n, scaled so the maximum is 100."""
    imp = model.featureImportances.toArray()
    rows = sorted(((names[i], float(v)) for i, v in enumerate(imp)), key=lambda r: (-r[1], r[0]))
    rows = rows[:n] if n else rows
    top = max((v for _, v in rows), default=0.0) or 1.0
    spark = SparkSession.getActiveSession()
    return _table(spark, [(i + 1, f, v, v * 100.0 / top if relative else v) for i, (f, v) in enumerate(rows)],
                  "rank int, feature string, importance double, relative double")


# L12
def partial_dependence(model, df: DataFrame, cols: list[str], col: str, grid: list[float],
                       prediction: str = "prediction") -> DataFrame:
    """Mean prediction with ``col`` set to each grid value for every row.

    Each row is expanded once per grid value (the grid is a bounded
    parameter, expanded by ``explode``, not a join), scored, then averaged.
    """
    x = df.select(*cols).withColumn("grid_value", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    x = x.withColumn(col, F.col("grid_value"))
    scored = model.transform(assemble(x, cols))
    pred = F.col(prediction)
    if "probability" in scored.columns:
        pred = vector_to_array("probability")[1]
    return scored.groupBy("grid_value").agg(F.avg(pred).alias("mean_prediction"))


# L13
def build_pipeline(stages: list) -> Pipeline:
    return Pipeline(stages=stages)


# L14
def score(model, df: DataFrame, key: str, cols: list[str], floor: float | None = 0.0, digits: int | None = 2,
          prob: bool = False, name: str = "score") -> DataFrame:
    """Batch scoring keyed by id: prediction (or P(class 1)), floored and rounded half-even."""
    out = model.transform(assemble(df.select(key, *cols), cols))
    s = vector_to_array("probability")[1] if prob else F.col("prediction")
    if floor is not None:
        s = F.greatest(s, F.lit(floor))
    if digits is not None:
        s = F.bround(s, digits)
    return out.select(key, s.alias(name))


def product_of_scores(a: DataFrame, b: DataFrame, key: str, name: str = "score") -> DataFrame:
    """Join two score sets on the key and multiply them (e.g. probability x severity)."""
    return a.withColumnRenamed(name, "_a").join(b.withColumnRenamed(name, "_b"), key).select(
        key, (F.col("_a") * F.col("_b")).alias(name))


# M7
def pca(df: DataFrame, features: str | list[str], k: int, standardize: bool = True):
    """PCA on (optionally standardised) input.

    Returns (projection frame, loadings table (component, feature, loading),
    explained-variance table). Component signs are fixed so the largest
    absolute loading is positive.
    """
    from pyspark.ml.feature import StandardScaler
    data = df if isinstance(features, str) else assemble(df, features)
    fcol = features if isinstance(features, str) else "features"
    names = None if isinstance(features, str) else features
    if standardize:
        sc = StandardScaler(inputCol=fcol, outputCol="_std", withMean=True, withStd=True).fit(data)
        data, fcol = sc.transform(data), "_std"
    model = PCA(k=k, inputCol=fcol, outputCol="pcs").fit(data)
    pc = model.pc.toArray()  # d x k (bounded by the feature count)
    d = pc.shape[0]
    signs = []
    for j in range(k):
        col = pc[:, j]
        i = int(abs(col).argmax())
        signs.append(1.0 if col[i] >= 0 else -1.0)
    names = names or [f"f{i}" for i in range(d)]
    spark = df.sparkSession
    loadings = _table(spark, [(j + 1, names[i], float(pc[i, j] * signs[j])) for j in range(k) for i in range(d)],
                      "component int, feature string, loading double")
    ev = model.explainedVariance.toArray()
    cum = 0.0
    ev_rows = []
    for j in range(k):
        cum += float(ev[j])
        ev_rows.append((j + 1, float(ev[j]), cum))
    explained = _table(spark, ev_rows, "component int, explained_variance double, cumulative double")
    proj = model.transform(data).withColumn("pcs", vector_to_array("pcs"))
    proj = proj.withColumn("pcs", F.transform("pcs", lambda v, i: v * F.element_at(
        F.array(*[F.lit(s) for s in signs]), i + 1)))
    return proj, loadings, explained


# O9
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search (isolation forest paper)."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def isolation_forest(df: DataFrame, key: str, cols: list[str], trees: int = 50, sample: int = 256,
                     seed: int = 42, contamination: float | None = None) -> DataFrame:
    """Isolation-forest decision score per row, low for anomalies:
    ``anomaly_score`` = -2^(-E[h(x)] / c(sample)) - offset, ``anomaly_label`` -1
    below 0 and else 1.  The offset is -0.5, or with ``contamination`` that
    quantile of the rows' scores.

    1. Tree samples: a row joins tree t when hash(key, seed, t) falls under
       sample/N, so each tree gets about ``sample`` rows (bounded) and rows
       are selected independently (no sort, no global window).
    2. Trees are grown per tree id with ``applyInPandas`` (numpy on <= a few
       hundred rows), emitted as node rows.
    3. The forest (trees x nodes, bounded by trees * 2 * sample) is collected
       and broadcast; rows are scored by a vectorised pandas UDF, once: where a quantile
       of the scores is wanted, they are stored.
    """
    spark = df.sparkSession
    x = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).na.fill(0.0, cols)
    n = x.agg(F.count(F.lit(1)).alias("n")).scalar()
    # the inclusion rate is a scalar subquery; project it first (subqueries
    # cannot sit inside the higher-order function)
    x_p = x.withColumn("_p", F.least(F.lit(1.0), F.lit(float(sample)) / n))
    member = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                      lambda t: F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed), t), 11).cast("double") / float(1 << 53) < F.col("_p"))
    sampled = x_p.withColumn("tree", F.explode(member)).drop("_p")
    d = len(cols)
    limit = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100_003 + t)
        data = pdf[cols].to_numpy()
        nodes = []

        def build(idx, depth):
            nid = len(nodes)
            nodes.append(None)
            sub = data[idx]
            if depth >= limit or len(idx) <= 1:
                nodes[nid] = (t, nid, -1, 0.0, -1, -1, len(idx))
                return nid
            f = int(rng.integers(d))
            lo, hi = sub[:, f].min(), sub[:, f].max()
            if lo == hi:
                nodes[nid] = (t, nid, -1, 0.0, -1, -1, len(idx))
                return nid
            thr = float(rng.uniform(lo, hi))
            left = build(idx[sub[:, f] < thr], depth + 1)
            right = build(idx[sub[:, f] >= thr], depth + 1)
            nodes[nid] = (t, nid, f, thr, left, right, len(idx))
            return nid

        build(np.arange(len(data)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    schema = "tree int, node int, feature int, threshold double, left int, right int, size long"
    forest_df = sampled.groupBy("tree").applyInPandas(grow, schema)
    forest = forest_df.toPandas()  # bounded: trees * (2 * sample) nodes
    sizes = forest[forest["node"] == 0]["size"]
    psi = float(sizes.mean()) if len(sizes) else float(sample)
    norm = _c(psi)

    def walkable(g: pd.DataFrame) -> tuple:
        """(feature, threshold, left, right, path length at a leaf, steps) by node; a leaf leads to itself."""
        g = g.sort_values("node")
        leaf = (g["feature"] < 0).to_numpy()
        own = np.arange(len(g))
        left, right = (np.where(leaf, own, g[c].to_numpy()).astype(np.int64) for c in ("left", "right"))
        depth = np.zeros(len(g))
        for i in own[~leaf]:  # a node comes before its children
            depth[[left[i], right[i]]] = depth[i] + 1
        length = np.where(leaf, depth + np.array([_c(v) for v in g["size"]]), 0.0)
        return np.where(leaf, 0, g["feature"].to_numpy()).astype(np.int64), g["threshold"].to_numpy(), left, right, length, int(depth.max())

    bc = spark.sparkContext.broadcast([walkable(g) for _, g in forest.groupby("tree")])

    @F.pandas_udf("double")
    def path_score(rows: pd.DataFrame) -> pd.Series:
        pts = np.ascontiguousarray(rows.to_numpy(dtype=float)).ravel()
        first = np.arange(len(rows)) * d
        total = np.zeros(len(rows))
        for feature, threshold, left, right, length, steps in bc.value:
            cur = np.zeros(len(rows), dtype=np.int64)
            for _ in range(steps):
                cur = np.where(pts[first + feature[cur]] < threshold[cur], left[cur], right[cur])
            total += length[cur]
        mean_h = total / max(len(bc.value), 1)
        return pd.Series(-np.power(2.0, -mean_h / norm) if norm > 0 else np.full(len(rows), -0.5))

    scored = x.withColumn("_s", path_score(F.struct(*[F.col(c) for c in cols])))
    offset = F.lit(-0.5)
    if contamination is not None:
        from quarry.operators.ordered import quantiles
        from quarry.semantics import with_scalar
        scored = stored(scored)
        scored = with_scalar(scored, quantiles(scored, "_s", {"cut": contamination}), "_c")
        offset = F.col("_c.cut")
    scored = scored.withColumn("anomaly_score", F.col("_s") - offset)
    return scored.select(*x.columns, "anomaly_score", F.when(F.col("anomaly_score") < 0, -1).otherwise(1).alias("anomaly_label"))
