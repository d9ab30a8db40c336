"""What a task holds and how often rows are read must not grow with the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import models, outliers
from quarry.plans import questions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 50)


def test_dealt_bounds_the_rows_of_a_part_and_keeps_them_all(spark):
    df = spark.range(10_000).coalesce(1).withColumn("k", F.col("id") % 7)
    assert session.dealt(df, rows=10_000) is df
    parts = session.dealt(df, rows=100).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 100 and sum(r[1] for r in parts) == 10_000 and max(r[1] for r in parts) <= 200
    assert session.dealt(df, "k", rows=100).select("k", F.spark_partition_id()).distinct().count() == 7


def test_few_segments_are_broadcast_whatever_the_estimate(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 3).alias("seg"), F.sqrt("id").alias("x"))
    df = session.stored(df.withColumn("seg", F.when(F.col("id") != 5, F.col("seg"))))
    out = outliers.segment_outliers(df, "seg", "x")
    assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
    values = {s: np.sqrt(np.array([i for i in range(20_000) if i % 3 == s and i != 5], dtype=float)) for s in range(3)}
    got = {r["seg"]: r["segment_q"] for r in out.groupBy("seg").agg(F.first("segment_q").alias("segment_q")).collect()}
    assert got.pop(None) is None and got == pytest.approx({s: np.quantile(v, 0.25) for s, v in values.items()})


def test_isolation_forest_scores_rows_once(spark):
    df = spark.range(3000).select("id", F.rand(1).alias("a"), F.when(F.col("id") == 7, 9.0).otherwise(F.rand(2)).alias("b"))
    out = models.isolation_forest(session.stored(df), "id", ["a", "b"], trees=20, contamination=0.05)
    assert "ArrowEvalPython" not in plan_of(out)
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == 3000 and rows[7]["anomaly_label"] == -1 and sum(r["anomaly_label"] == -1 for r in rows.values()) == 150


def test_fits_of_trees_get_their_rows_dealt(spark, small_parts, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "assemble", lambda df, cols, out="features", real=models.assemble: seen.append(plan_of(df)) or real(df, cols, out))
    df = spark.range(1000).coalesce(1).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    for fit in (models.fit_forest, lambda *a: models.fit_boosted_classifier(*a, iters=2), lambda *a: models.fit_boosted_regressor(*a, iters=2)):
        fit(df, ["x"], "y")
    assert len(seen) == 3 and all("REPARTITION_BY_NUM" in p for p in seen)
    assert models.sweep(df, [1], lambda d, v: d, lambda d: len(d.groupBy(F.spark_partition_id()).count().collect())).first()["score"] >= 20


def test_newton_boosting_gives_the_same_with_few_and_many_stored_margins(spark, monkeypatch):
    df = session.stored(spark.range(600).select((F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 5 + F.col("id") % 13).cast("double").alias("y"), (F.col("id") % 4 == 0).alias("v")))
    got, written = [], []
    monkeypatch.setattr(models, "_bucketed", lambda df, key, name, real=models._bucketed: written.append(name) or real(df, key, name))
    for keep, times in ((2, 3), (100, 0)):
        monkeypatch.setattr(models, "KEEP", keep)
        written.clear()
        got.append(models.fit_newton_boosting(df, ["x"], "y", rounds=7, validation="v").losses)
        assert written.count("margins") == times
    assert len(got[0]) == 7 and np.allclose(got[0], got[1])


def test_provider_features_deal_claims_by_what_their_levels_share(spark, small_parts):
    rows = [(i % 4, i % 50, i % 9, f"p{i % 3}", float(i), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "prov int, claim int, mem int, code string, cost double, s double")
    out = questions.provider_features(df, "prov", "claim", "mem", "code", "cost", "s")
    assert plan_of(out).count("REPARTITION_BY_NUM") >= 2
    got = {r["prov"]: r for r in out.collect()}
    for p in range(4):
        own = [r for r in rows if r[0] == p]
        claims, mems = {r[1] for r in own}, {r[2] for r in own}
        assert (got[p]["unique_claims"], got[p]["unique_members"]) == (len(claims), len(mems))
        assert got[p]["cost_per_claim"] == pytest.approx(sum(r[4] for r in own) / len(claims))
        assert got[p]["claims_per_member"] == pytest.approx(len({(r[1], r[2]) for r in own}) / len(mems))


def _graded(spark, n):
    df = spark.range(n).select((F.col("id") % 4).cast("int").alias("fold"), F.rand(3).alias("x"), F.rand(4).alias("z"))
    return session.stored(df.withColumn("y", (F.col("x") + F.rand(5) > 1).cast("double")))


def test_binned_areas_are_those_of_the_evaluator_whatever_the_parts(spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from quarry.operators import metrics
    df = session.stored(_graded(spark, 9000).select("fold", "y", F.when(F.col("fold") == 1, 0.5).otherwise(F.round("x", 4)).alias("s")))
    for rows in (500, 100_000):
        monkeypatch.setattr(metrics, "PART_ROWS", rows)
        got = {r["fold"]: r["auc"] for r in metrics.binned_roc_auc(df, "y", "s", ["fold"]).collect()}
        assert len(got) == 4 and got[1] == 0.5
        for i, v in got.items():
            ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y")
            assert v == pytest.approx(ev.evaluate(df.where(F.col("fold") == i).coalesce(1)), abs=1e-12)
    one = df.where("fold = 0")
    assert metrics.binned_roc_auc(one.withColumn("y", F.lit(0.0)), "y", "s", ["fold"]).first()["auc"] == 0
    assert metrics.binned_roc_auc(one.withColumn("y", F.lit(1.0)), "y", "s", ["fold"]).first()["auc"] == 1


@pytest.mark.parametrize("fold_col", ["fold", None])
def test_grid_search_gives_the_cross_validator_s_metrics_and_caches_no_fold(spark, fold_col, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    df = _graded(spark, 2000).coalesce(1)
    est = LogisticRegression(labelCol="y", maxIter=5)
    grid = ParamGridBuilder().addGrid(est.regParam, [0.01, 0.5]).build()
    kw = {"foldCol": fold_col} if fold_col else {"seed": 42}
    want = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="y"),
                          numFolds=4, **kw).fit(models.assemble(df, ["x", "z"]))
    cached = []
    monkeypatch.setattr(type(df), "cache", lambda d: cached.append(d) or d)
    model, table = models.grid_search(df, ["x", "z"], "y", est, {"regParam": [0.01, 0.5]}, folds=4, fold_col=fold_col)
    assert not cached
    assert model.avgMetrics == pytest.approx(want.avgMetrics, abs=1e-9) and model.stdMetrics == pytest.approx(want.stdMetrics, abs=1e-9)
    assert np.allclose(model.bestModel.coefficients.toArray(), want.bestModel.coefficients.toArray())
    assert [r["metric"] for r in table.collect()] == model.avgMetrics


def test_grid_search_refuses_folds_without_rows_or_out_of_range(spark):
    from pyspark.ml.classification import LogisticRegression
    df, est = _graded(spark, 200), LogisticRegression(labelCol="y", maxIter=2)
    for folds, word in ((3, "range"), (5, "validation data at fold 4")):
        with pytest.raises(ValueError, match=word):
            models.grid_search(df, ["x"], "y", est, {"regParam": [0.1]}, folds=folds, fold_col="fold")


def test_block_folds_do_not_shuffle_the_rows_by_period(spark):
    df = session.stored(spark.range(1000).select("id", (F.col("id") % 3).alias("p")))
    out = models.block_folds(df, "p")
    assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
    assert {(r["p"], r["fold"]) for r in out.collect()} == {(0, 0), (1, 1), (2, 2)}
