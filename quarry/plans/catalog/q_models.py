"""Catalog entries: models.

Model fits are not expressible in SQL, so these have no oracle: the driver
records a rows-only check. Each entry returns a table whose size is bounded
by features/settings, or a per-row score table over the whole input.
"""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import metrics as T
from quarry.operators import models as L
from quarry.plans.catalog.registry import Tables, register
from quarry.semantics import hash_bucket

LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", *LI_FEATS, F.year("l_shipdate").alias("ship_year"),
                             (F.col("l_returnflag") == "R").cast("double").alias("returned"))


def _emb(t):
    return t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vec"))


@register("l1_logistic_coefficients")
def l1(spark, sf):
    _, coefs = L.fit_logistic(_li(Tables(spark, sf)), LI_FEATS, "returned", reg=0.01)
    return coefs


@register("l1_logistic_balanced")
def l1b(spark, sf):
    from quarry.operators.features import with_class_weights
    li = with_class_weights(_li(Tables(spark, sf)), "returned")
    _, coefs = L.fit_logistic(li, LI_FEATS, "returned", reg=0.01, weight="weight")
    return coefs


@register("l2_forest_classifier_importance")
def l2(spark, sf):
    m = L.fit_forest(_li(Tables(spark, sf)), LI_FEATS, "returned", "classification", trees=20, depth=5)
    return L.importance_table(m, LI_FEATS)


@register("l2_forest_regressor_importance")
def l2b(spark, sf):
    feats = ["l_quantity", "l_discount", "l_tax"]
    m = L.fit_forest(_li(Tables(spark, sf)), feats, "l_extendedprice", "regression", trees=20, depth=5)
    return L.importance_table(m, feats)


@register("l3_boosted_classifier_importance")
def l3(spark, sf):
    m = L.fit_boosted_classifier(_li(Tables(spark, sf)), LI_FEATS, "returned", iters=10)
    return L.importance_table(m, LI_FEATS, n=3)


@register("l11_importance_top_n_relative")
def l11(spark, sf):
    m = L.fit_forest(_li(Tables(spark, sf)), LI_FEATS, "returned", "classification", trees=10, depth=4)
    return L.importance_table(m, LI_FEATS, n=2, relative=True)


@register("l4_boosted_regressor_early_stop")
def l4(spark, sf):
    feats = ["l_quantity", "l_discount", "l_tax"]
    li = _li(Tables(spark, sf)).withColumn("is_val", hash_bucket(F.concat_ws("-", "l_orderkey", "l_linenumber")) < 20)
    m = L.fit_boosted_regressor(li, feats, "l_extendedprice", iters=20, validation="is_val", tol=0.01)
    return L.importance_table(m, feats)


@register("l5_newton_boosting_loss")
def l5(spark, sf):
    t = Tables(spark, sf)
    li = _li(t)
    feats = ["l_quantity", "l_discount", "l_tax"]
    model = L.fit_newton_boosting(li, feats, "l_extendedprice", factor=4.0, rounds=4, rate=0.5, depth=3)
    scored = model.transform(li)
    return T.asymmetric_loss(scored, "l_extendedprice", "prediction", 4.0, by=["ship_year"])


@register("l6_threshold_classifiers")
def l6(spark, sf):
    t = Tables(spark, sf)
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty"),
        F.avg("l_discount").alias("avg_discount"))
    o = t.orders.join(per, "o_orderkey")
    feats = ["n_lines", "qty", "avg_discount"]
    models = L.fit_threshold_classifiers(o, feats, "o_totalprice", [200000.0, 300000.0], iters=5)
    out = None
    for thr, m in models.items():
        part = L.importance_table(m, feats).withColumn("threshold", F.lit(thr))
        out = part if out is None else out.unionByName(part)
    return out


@register("l7_kmeans_clusters")
def l7(spark, sf):
    _, labelled, _, cost = L.fit_kmeans(_emb(Tables(spark, sf)), "vec", 10)
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("training_cost", F.lit(cost))


@register("l8_kmeans_sweep")
def l8(spark, sf):
    return L.kmeans_sweep(_emb(Tables(spark, sf)), "vec", list(range(2, 30)))


@register("l8_kmeans_row_silhouette")
def l8b(spark, sf):
    _, labelled, _, _ = L.fit_kmeans(_emb(Tables(spark, sf)), "vec", 4)
    return L.row_silhouette(labelled, "vec").select("vec_id", "cluster", "silhouette")


@register("l9_grid_search_block_cv")
def l9(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    years = _li(Tables(spark, sf))
    li = L.block_folds(years, "ship_year")
    folds = len(years.select("ship_year").distinct().collect())  # one row a year
    est = LogisticRegression(featuresCol="features", labelCol="returned", maxIter=20)
    _, table = L.grid_search(li.select(*LI_FEATS, "returned", F.col("fold").cast("int")), LI_FEATS, "returned", est,
                             {"regParam": [0.01, 0.1]}, folds=folds, fold_col="fold")
    return table


_L9_GRID = [m * 10.0 ** e for e in range(-3, 6) for m in range(1, 10)]


@register("l9_rotation_search", """
WITH p AS (SELECT year(o_orderdate) AS y, dense_rank() OVER (ORDER BY year(o_orderdate)) - 1 AS period, o_totalprice / 1000 AS t,
                  CASE o_orderpriority[1] WHEN '1' THEN 1.0 WHEN '2' THEN 2.0 ELSE 3.0 END + (o_custkey % 7) AS x FROM orders),
     d AS (SELECT period % 3 AS fold, x, t FROM p),
     grid AS (SELECT ((e + 3) * 9 + m - 1)::int AS setting, m * pow(10.0, e) AS l FROM range(-3, 6) a(e), range(1, 10) b(m)),
     fit AS (SELECT r.fold AS rotation, avg(x) AS mx, avg(t) AS mt, covar_pop(t, x) AS c, var_pop(x) AS v, stddev_pop(t) AS st
             FROM (SELECT DISTINCT fold FROM d) r JOIN d ON d.fold <> r.fold GROUP BY 1),
     held AS (SELECT fold AS rotation, count(*) AS n, avg(x) AS hx, avg(t) AS ht, var_pop(x) AS vx, var_pop(t) AS vt, covar_pop(t, x) AS ch FROM d GROUP BY 1),
     w AS (SELECT *, c / (v + l / st) AS slope  -- the fit scales the label, not its penalty
             FROM fit JOIN held USING (rotation), grid)
SELECT setting, rotation::int AS rotation, round(l, 6) AS "regParam",
       round(sqrt(vt - 2 * slope * ch + slope * slope * vx + pow(ht - mt - slope * (hx - mx), 2)), 4) AS metric
FROM w
""")
def l9_rotation(spark, sf):
    from pyspark.ml.regression import LinearRegression
    o = Tables(spark, sf).orders
    years = o.select(F.year("o_orderdate").alias("y")).distinct().withColumn(
        "period", F.pmod(F.dense_rank().over(Window.orderBy("y")) - 1, F.lit(3)))  # one row a year
    first = F.substring("o_orderpriority", 1, 1)
    x = F.when(first == "1", 1.0).when(first == "2", 2.0).otherwise(3.0) + F.col("o_custkey") % 7
    rows = o.withColumn("y", F.year("o_orderdate")).join(years, "y").select((F.col("o_totalprice") / 1000).alias("t"), x.alias("x"), "period")
    est = LinearRegression(featuresCol="features", labelCol="t", solver="normal", standardization=False)
    out = L.rotation_search(rows, ["x"], "t", est, {"regParam": _L9_GRID}, "period")
    return out.select("setting", "rotation", F.round("regParam", 6).alias("regParam"), F.round("metric", 4).alias("metric"))


@register("l9_grid_search_kfold")
def l9b(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    est = LogisticRegression(featuresCol="features", labelCol="returned", maxIter=20)
    _, table = L.grid_search(_li(Tables(spark, sf)).select(*LI_FEATS, "returned"), LI_FEATS, "returned", est, {"regParam": [0.01, 0.1]}, folds=3)
    return table


@register("l10_sweep_depth")
def l10(spark, sf):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    li = _li(Tables(spark, sf))
    ev = BinaryClassificationEvaluator(labelCol="returned")
    return L.sweep(li, [2, 4], lambda d, v: L.fit_boosted_classifier(d, LI_FEATS, "returned", iters=5, depth=v),
                   lambda m: ev.evaluate(m.transform(L.assemble(li, LI_FEATS))))


@register("l12_partial_dependence")
def l12(spark, sf):
    li = _li(Tables(spark, sf))
    m = L.fit_forest(li, LI_FEATS, "returned", "classification", trees=10, depth=4)
    return L.partial_dependence(m, li, LI_FEATS, "l_discount", [0.0, 0.025, 0.05, 0.075, 0.1])


@register("l13_chained_scaler_model")
def l13(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    li = _li(Tables(spark, sf))
    pipe = L.build_pipeline([VectorAssembler(inputCols=LI_FEATS, outputCol="raw"),
                             StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                             LogisticRegression(labelCol="returned", maxIter=20)])
    model = pipe.fit(li)
    return T.confusion(model.transform(li).withColumn("pred", F.col("prediction").cast("int"))
                       .withColumn("label", F.col("returned").cast("int")), "label", "pred")


@register("l14_score_product")
def l14(spark, sf):
    t = Tables(spark, sf)
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty"))
    o = t.orders.join(per, "o_orderkey").withColumn("high", (F.col("o_totalprice") > 200000).cast("double"))
    feats = ["n_lines", "qty"]
    reg = L.fit_boosted_regressor(o, feats, "o_totalprice", iters=5)
    clf = L.fit_boosted_classifier(o, feats, "high", iters=5)
    sev = L.score(reg, o, "o_orderkey", feats, floor=0.0, digits=2)
    prob = L.score(clf, o, "o_orderkey", feats, floor=None, digits=None, prob=True)
    return L.product_of_scores(prob, sev, "o_orderkey")


@register("m7_pca_explained_variance")
def m7(spark, sf):
    _, _, explained = L.pca(_emb(Tables(spark, sf)), "vec", 3)
    return explained


@register("m7_pca_loadings")
def m7c(spark, sf):
    _, loadings, _ = L.pca(_emb(Tables(spark, sf)), "vec", 3)
    return loadings


@register("m7_pca_projection")
def m7b(spark, sf):
    proj, _, _ = L.pca(_emb(Tables(spark, sf)), "vec", 3)
    return proj.select("vec_id", "label", "pcs")


@register("o9_isolation_forest")
def o9(spark, sf):
    li = _li(Tables(spark, sf)).withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_quantity",
                                                                     "l_extendedprice"))
    out = L.isolation_forest(li, "row_key", LI_FEATS, trees=20, sample=256, contamination=0.05)
    return out.select("row_key", "anomaly_score", "anomaly_label")
