"""Invariants for operators without an SQL oracle (models, forests, curves)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _q(spark, name):
    return E.queries()[name](spark, SF_SMALL)


def test_importances_sum_to_one(spark):
    rows = _q(spark, "l2_forest_classifier_importance").collect()
    assert abs(sum(r["importance"] for r in rows) - 1.0) < 1e-6
    assert abs(max(r["relative"] for r in rows) - 100.0) < 1e-9


def test_pca_explained_variance_bounded(spark):
    rows = _q(spark, "m7_pca_explained_variance").orderBy("component").collect()
    assert all(0 <= r["explained_variance"] <= 1 for r in rows)
    assert rows[-1]["cumulative"] <= 1.0 + 1e-9
    assert all(a["explained_variance"] >= b["explained_variance"] for a, b in zip(rows, rows[1:]))


def test_partial_dependence_probabilities(spark):
    rows = _q(spark, "l12_partial_dependence").collect()
    assert len(rows) == 5 and all(0.0 <= r["mean_prediction"] <= 1.0 for r in rows)


def test_isolation_forest_scores(spark):
    df = _q(spark, "o9_isolation_forest")
    r = df.agg(F.min("anomaly_score"), F.max("anomaly_score"), F.avg((F.col("anomaly_label") == -1).cast("int")), F.count(F.lit(1))).first()
    n = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert r[3] == n and -1.0 < r[0] < 0.0 < r[1] < 1.0 and 0.0 < r[2] <= 0.06


def test_roc_monotone(spark):
    rows = _q(spark, "t3_roc").orderBy(F.col("threshold").desc()).collect()
    assert all(a["tpr"] <= b["tpr"] and a["fpr"] <= b["fpr"] for a, b in zip(rows, rows[1:]))
    assert abs(rows[-1]["tpr"] - 1.0) < 1e-12 and abs(rows[-1]["fpr"] - 1.0) < 1e-12


def test_newton_boosting_beats_constant(spark):
    from quarry.operators import metrics as T
    from quarry.operators import models as L
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    feats = ["l_quantity", "l_discount", "l_tax"]
    model = L.fit_newton_boosting(li, feats, "l_extendedprice", factor=4.0, rounds=3, rate=0.5)
    scored = model.transform(li)
    base = scored.withColumn("c", F.lit(model.base))
    boosted = T.asymmetric_loss(scored, "l_extendedprice", "prediction", 4.0).first()[0]
    const = T.asymmetric_loss(base, "l_extendedprice", "c", 4.0).first()[0]
    assert boosted < const


def test_newton_boosting_stores_margins_alone_and_stops_early(spark):
    from quarry.operators import models as L
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").withColumn("held", F.col("l_linenumber") == 1)
    feats = ["l_quantity", "l_discount", "l_tax"]
    kept, whole = [], L._bucketed
    L._bucketed = lambda df, key, name: kept.append((name, whole(df, key, name))) or kept[-1][1]
    try:
        model = L.fit_newton_boosting(li, feats, "l_extendedprice", factor=2.0, rounds=4, rate=0.5)
        early = L.fit_newton_boosting(li, feats, "l_extendedprice", rounds=250, rate=1.0, validation="held", patience=2, tol=0.2)
    finally:
        L._bucketed = whole
    train = [a for a, _ in model.losses]
    assert len(model.trees) == 4 and all(a > b for a, b in zip(train, train[1:]))
    assert len(early.trees) < len(early.losses) < 250 and all(v is not None for _, v in early.losses)
    assert all(t.columns == ["_row", "_p"] for name, t in kept if name == "margins")
    joined = kept[0][1].join(kept[1][1].hint("merge"), "_row")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_silhouettes_of_many_k_equal_spark_and_read_the_rows_twice(spark):
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    from quarry.operators import models as L
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("vec"))
    fitted = {k: KMeans(featuresCol="vec", k=k, seed=1, maxIter=3, predictionCol="cluster").fit(emb) for k in (2, 5, 11)}
    got = {r["k"]: r["silhouette"] for r in L.silhouettes(emb, "vec", {k: np.stack(m.clusterCenters()) for k, m in fitted.items()}).collect()}
    ev = ClusteringEvaluator(featuresCol="vec", predictionCol="cluster")
    for k, m in fitted.items():
        assert abs(got[k] - ev.evaluate(m.transform(emb))) < 1e-9


def test_kmeans_sweep_cost_decreases(spark):
    rows = _q(spark, "l8_kmeans_sweep").orderBy("k").collect()
    assert rows[0]["cost"] >= rows[-1]["cost"] and all(-1 <= r["silhouette"] <= 1 for r in rows)


def test_models_are_seed_stable(spark):
    a = sorted(tuple(r) for r in _q(spark, "l7_kmeans_clusters").select("cluster", "size").collect())
    b = sorted(tuple(r) for r in _q(spark, "l7_kmeans_clusters").select("cluster", "size").collect())
    assert a == b


def test_row_silhouette_mean_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    from quarry.operators import models as L
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("vec"))
    _, labelled, _, _ = L.fit_kmeans(emb, "vec", 4)
    mean_rows = L.row_silhouette(labelled, "vec").agg(F.avg("silhouette")).first()[0]
    ev = ClusteringEvaluator(featuresCol="vec", predictionCol="cluster", metricName="silhouette",
                             distanceMeasure="squaredEuclidean").evaluate(labelled)
    assert abs(mean_rows - ev) < 1e-6


def test_pca_loadings_unit_norm_and_sign_fixed(spark):
    rows = _q(spark, "m7_pca_loadings").collect()
    by_comp = {}
    for r in rows:
        by_comp.setdefault(r["component"], []).append(r["loading"])
    assert len(by_comp) == 3
    for vals in by_comp.values():
        assert abs(sum(v * v for v in vals) - 1.0) < 1e-9
        assert max(vals, key=abs) > 0
