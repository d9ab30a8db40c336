"""Catalog entries: models on inputs whose fitted values have a closed form, checked in SQL.

A tree on a 0/1 feature has one possible split, so its leaves are group means (or Newton
steps); a straight line, a logistic curve over two groups and the axes of two columns are known.
"""

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.operators import models as L
from quarry.plans.catalog.q_aggregates import PREV_SQL, _prevalence
from quarry.plans.catalog.registry import Tables, register
from quarry.sources import io as S

_ROWS = """
WITH d AS (SELECT l_orderkey, l_linenumber, (l_linestatus = 'F')::int::double AS b, (l_returnflag = 'R')::int::double AS returned,
                  l_extendedprice / 1000 AS price, l_quantity AS q FROM lineitem)"""


def _rows(spark, sf):
    return Tables(spark, sf).lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").cast("double").alias("b"), (F.col("l_returnflag") == "R").cast("double").alias("returned"),
        (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").cast("double").alias("q"))


def _per(df, by, value, digits=6, name="value"):
    """The one value every group has under a fitted tree (the mean of equal numbers)."""
    return df.groupBy(*by).agg(F.round(F.avg(value), digits).alias(name), F.count(F.lit(1)).alias("n"))


def _scored(model, df, prob=False):
    out = model.transform(L.assemble(df, ["b"]))
    return out.withColumn("_v", vector_to_array("probability")[1] if prob else F.col("prediction"))


@register("l1_logistic_two_groups", _ROWS + """,
p AS (SELECT avg(returned) FILTER (WHERE b = 0) AS p0, avg(returned) FILTER (WHERE b = 1) AS p1 FROM d)
SELECT 0 AS rank, 'intercept' AS feature, round(ln(p0 / (1 - p0)), 4) AS coefficient FROM p
UNION ALL SELECT 1, 'b', round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) FROM p
""")
def l1_two(spark, sf):
    _, coefs = L.fit_logistic(_rows(spark, sf), ["b"], "returned", reg=0.0, tol=1e-12)
    return coefs.withColumn("coefficient", F.round("coefficient", 4))


@register("l1_logistic_two_groups_balanced", _ROWS + """,
c AS (SELECT returned, count(*) AS n_c, sum(count(*)) OVER () / (2 * count(*)) AS w FROM d GROUP BY 1),
p AS (SELECT b, sum(w * returned) / sum(w) AS p FROM d JOIN c USING (returned) GROUP BY 1),
g AS (SELECT max(ln(p / (1 - p))) FILTER (WHERE b = 0) AS g0, max(ln(p / (1 - p))) FILTER (WHERE b = 1) AS g1 FROM p)
SELECT 0 AS rank, 'intercept' AS feature, round(g0, 4) AS coefficient FROM g UNION ALL SELECT 1, 'b', round(g1 - g0, 4) FROM g
""")
def l1_two_balanced(spark, sf):
    from quarry.operators.features import with_class_weights
    _, coefs = L.fit_logistic(with_class_weights(_rows(spark, sf), "returned"), ["b"], "returned", reg=0.0, weight="weight", tol=1e-12)
    return coefs.withColumn("coefficient", F.round("coefficient", 4))


# groups of unlike majorities: leaves of one majority are merged
@register("l2_forest_group_shares", _ROWS + """
SELECT b, round(avg(CASE WHEN b = 1 THEN (l_linenumber <= 5)::int ELSE returned END), 6) AS value, count(*) AS n FROM d GROUP BY 1
""")
def l2_shares(spark, sf):
    df = _rows(spark, sf)
    df = df.withColumn("y", F.when(F.col("b") == 1, (F.col("l_linenumber") <= 5).cast("double")).otherwise(F.col("returned")))
    m = L.fit_forest(df, ["b"], "y", "classification", trees=3, depth=2, bootstrap=False)
    return _per(_scored(m, df, prob=True), ["b"], "_v")


@register("l2_forest_group_means", _ROWS + "SELECT b, round(avg(price), 6) AS value, count(*) AS n FROM d GROUP BY 1")
def l2_means(spark, sf):
    df = _rows(spark, sf)
    return _per(_scored(L.fit_forest(df, ["b"], "price", "regression", trees=3, depth=2, bootstrap=False), df), ["b"], "_v")


@register("l3_boosted_first_tree", _ROWS + """
SELECT b, round(1 / (1 + exp(-2 * (2 * avg(returned) - 1))), 6) AS value, count(*) AS n FROM d GROUP BY 1
""")
def l3_first(spark, sf):
    df = _rows(spark, sf)
    return _per(_scored(L.fit_boosted_classifier(df, ["b"], "returned", iters=1, depth=1), df, prob=True), ["b"], "_v")


@register("l4_boosted_held_out_means", _ROWS + """
SELECT b, round(avg(price) FILTER (WHERE l_linenumber <> 1), 6) AS value, count(*) AS n FROM d GROUP BY 1
""")
def l4_means(spark, sf):
    df = _rows(spark, sf).withColumn("held", F.col("l_linenumber") == 1)
    return _per(_scored(L.fit_boosted_regressor(df, ["b"], "price", iters=5, depth=1, validation="held"), df), ["b"], "_v")


@register("l5_newton_steps", _ROWS + """,
p0 AS (SELECT *, avg(price) OVER () AS p FROM d),
p1 AS (SELECT * REPLACE (p + 0.5 * (sum(CASE WHEN price > p THEN 8.0 ELSE 2.0 END * (price - p)) OVER (PARTITION BY b)
                                   / sum(CASE WHEN price > p THEN 8.0 ELSE 2.0 END) OVER (PARTITION BY b)) AS p) FROM p0),
p2 AS (SELECT * REPLACE (p + 0.5 * (sum(CASE WHEN price > p THEN 8.0 ELSE 2.0 END * (price - p)) OVER (PARTITION BY b)
                                   / sum(CASE WHEN price > p THEN 8.0 ELSE 2.0 END) OVER (PARTITION BY b)) AS p) FROM p1)
SELECT b, round(avg(p), 6) AS value, count(*) AS n FROM p2 GROUP BY 1
""")
def l5_steps(spark, sf):
    df = _rows(spark, sf)
    m = L.fit_newton_boosting(df, ["b"], "price", factor=4.0, rounds=2, rate=0.5, depth=1)
    return _per(m.transform(df), ["b"], "prediction")


@register("l6_threshold_first_trees", _ROWS + """
SELECT t AS threshold, b, round(1 / (1 + exp(-2 * (2 * avg((price > t)::int) - 1))), 6) AS value, count(*) AS n
FROM d, (SELECT unnest([20.0, 40.0, 60.0]) AS t) GROUP BY 1, 2
""")
def l6_first(spark, sf):
    df = _rows(spark, sf)
    out = None
    for t, m in L.fit_threshold_classifiers(df, ["b"], "price", [20.0, 40.0, 60.0], iters=1).items():
        part = _per(_scored(m, df, prob=True).withColumn("threshold", F.lit(t)), ["threshold", "b"], "_v")
        out = part if out is None else out.unionByName(part)
    return out


# three values, two of them near: two clusters, whatever the start
_SPOTS = """
WITH d AS (SELECT CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 100.0 END::double AS x FROM lineitem),
c AS (SELECT *, (x > 50)::int AS c FROM d),
m AS (SELECT c, count(*) AS n, avg(x) AS mean, avg(x * x) AS sq FROM c GROUP BY 1),
j AS (SELECT x, (x * x - 2 * x * a.mean + a.sq) * a.n / (a.n - 1) AS own, x * x - 2 * x * o.mean + o.sq AS other, pow(x - a.mean, 2) AS err
      FROM c JOIN m a ON a.c = c.c JOIN m o ON o.c <> c.c)"""


def _spots(spark, sf):
    flag = F.col("l_returnflag")
    x = F.when(flag == "A", 0.0).when(flag == "N", 1.0).otherwise(100.0)
    return L.assemble(Tables(spark, sf).lineitem.select(x.alias("x")), ["x"])


@register("l7_kmeans_of_spots", _SPOTS + """
SELECT round(mean, 6) AS centre, n AS size, (SELECT round(sum(err), 2) FROM j) AS cost FROM m
""")
def l7_spots(spark, sf):
    _, labelled, centres, cost = L.fit_kmeans(_spots(spark, sf), "features", 2)
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return centres.join(sizes, "cluster").select(F.round(F.col("centre")[0], 6).alias("centre"), "size", F.round(F.lit(cost), 2).alias("cost"))


@register("l8_silhouette_of_spots", _SPOTS + """
SELECT 2 AS k, round(sum(err), 2) AS cost, round(avg((other - own) / greatest(own, other)), 9) AS silhouette FROM j
""")
def l8_spots(spark, sf):
    out = L.kmeans_sweep(_spots(spark, sf), "features", [2])
    return out.select("k", F.round("cost", 2).alias("cost"), F.round("silhouette", 9).alias("silhouette"))


@register("l8_row_silhouette_of_spots", _SPOTS + """
SELECT x, round(avg((other - own) / greatest(own, other)), 9) AS silhouette, count(*) AS n FROM j GROUP BY 1
""")
def l8_rows_spots(spark, sf):
    _, labelled, _, _ = L.fit_kmeans(_spots(spark, sf), "features", 2)
    return _per(L.row_silhouette(labelled, "features"), ["x"], "silhouette", 9, "silhouette")


@register("l10_sweep_penalty", _ROWS + """,
s AS (SELECT covar_pop(price, q) AS c, var_pop(q) AS vx, var_pop(price) AS vt, stddev_pop(price) AS st FROM d)
SELECT l::varchar AS value, round(sqrt(vt - 2 * (c / (vx + l / st)) * c + pow(c / (vx + l / st), 2) * vx), 6) AS score
FROM s, (SELECT unnest([0.0, 100.0, 10000.0, 1000000.0])::double AS l)
""")
def l10_penalty(spark, sf):
    from pyspark.ml.evaluation import RegressionEvaluator
    ev = RegressionEvaluator(labelCol="price", metricName="rmse")

    def fit(data, reg):
        return LinearRegression(labelCol="price", solver="normal", standardization=False, regParam=reg).fit(data)
    df = L.assemble(_rows(spark, sf).select("price", "q"), ["q"])
    out = L.sweep(df, [0.0, 100.0, 10000.0, 1000000.0], fit, lambda m: ev.evaluate(m.transform(df)))
    return out.withColumn("score", F.round("score", 6))


@register("l10_sweep_feature_count", _ROWS + """,
l AS (UNPIVOT (SELECT returned, b, q FROM d) ON b, q INTO NAME feature VALUE x),
g AS (SELECT feature, returned, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY ALL),
f AS (SELECT feature, (SELECT count(*) FROM d) AS n_all, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS ssw FROM g GROUP BY 1),
r AS (SELECT feature, (sum(n * (m - mean) ** 2) / (any_value(k) - 1)) / (any_value(ssw) / (any_value(n_all) - any_value(k))) AS score
      FROM g JOIN f USING (feature) GROUP BY 1),
best AS (SELECT arg_max(feature, score) AS feature FROM r),
s AS (SELECT var_pop(b) AS vb, var_pop(q) AS vq, var_pop(returned) AS vt, covar_pop(b, q) AS bq, covar_pop(b, returned) AS bt, covar_pop(q, returned) AS qt FROM d)
SELECT '1' AS value, round(sqrt(vt - CASE feature WHEN 'b' THEN bt * bt / vb ELSE qt * qt / vq END), 6) AS score FROM s, best
UNION ALL SELECT '2', round(sqrt(vt - (bt * bt * vq - 2 * bt * qt * bq + qt * qt * vb) / (vb * vq - bq * bq)), 6) FROM s
""")
def l10_feature_count(spark, sf):
    from pyspark.ml.evaluation import RegressionEvaluator
    ev = RegressionEvaluator(labelCol="returned", metricName="rmse")

    def fit(data, cols):
        return LinearRegression(labelCol="returned", solver="normal").fit(L.assemble(data, cols))
    out = L.sweep_feature_counts(_rows(spark, sf).select("returned", "b", "q"), ["q", "b"], "returned", [1, 2], fit,
                                 lambda m, data, cols: ev.evaluate(m.transform(L.assemble(data, cols))))
    return out.withColumn("score", F.round("score", 6))


@register("l10_sweep_leaf_size", _ROWS + """,
g AS (SELECT b, count(*) AS n, var_pop(price) AS v FROM d GROUP BY 1),
s AS (SELECT min(n) AS least, sum(n * v) / sum(n) AS inside, (SELECT var_pop(price) FROM d) AS whole FROM g)
SELECT l::varchar AS value, round(sqrt(CASE WHEN least >= l THEN inside ELSE whole END), 6) AS score
FROM s, (SELECT unnest([1, 1000, 20000, 1000000]) AS l)
""")
def l10_leaf_size(spark, sf):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import DecisionTreeRegressor
    ev = RegressionEvaluator(labelCol="price", metricName="rmse")

    def fit(data, least):
        return DecisionTreeRegressor(labelCol="price", maxDepth=1, minInstancesPerNode=least).fit(data)
    df = L.assemble(_rows(spark, sf).select("price", "b"), ["b"])
    out = L.sweep(df, [1, 1000, 20000, 1000000], fit, lambda m: ev.evaluate(m.transform(df)))
    return out.withColumn("score", F.round("score", 6))


@register("l11_importance_of_one_split", "SELECT 1 AS rank, 'b' AS feature, 1.0::double AS importance, 100.0::double AS relative UNION ALL SELECT 2, 'zero', 0.0, 0.0")
def l11_one(spark, sf):
    df = _rows(spark, sf).withColumn("zero", F.lit(0.0))
    m = L.fit_forest(df, ["zero", "b"], "price", "regression", trees=1, depth=2, bootstrap=False)
    return L.importance_table(m, ["zero", "b"], n=2)


@register("l12_partial_dependence_of_a_line", _ROWS + """,
s AS (SELECT regr_slope(price, q) AS w, regr_intercept(price, q) AS a FROM d)
SELECT g AS grid_value, round(a + w * g, 6) AS mean_prediction FROM s, (SELECT unnest([0.0, 10.0, 25.0, 50.0])::double AS g)
""")
def l12_line(spark, sf):
    df = _rows(spark, sf)
    m = LinearRegression(labelCol="price", solver="normal").fit(L.assemble(df, ["q"]))
    return L.partial_dependence(m, df, ["q"], "q", [0.0, 10.0, 25.0, 50.0]).withColumn("mean_prediction", F.round("mean_prediction", 6))


def _line_pipeline():
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    return L.build_pipeline([VectorAssembler(inputCols=["q"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                             LinearRegression(labelCol="price", solver="normal")])


_LINE = _ROWS + """,
s AS (SELECT regr_slope(price, q) AS w, regr_intercept(price, q) AS a FROM d)
SELECT q, round(avg(a + w * q), 6) AS value, count(*) AS n FROM d, s GROUP BY 1
"""


@register("l13_chained_scaler_line", _LINE)
def l13_line(spark, sf):
    df = _rows(spark, sf)
    return _per(_line_pipeline().fit(df).transform(df), ["q"], "prediction")


@register("s8_saved_line", _LINE)
def s8_line(spark, sf):
    df = _rows(spark, sf)
    path = S.scratch_path(spark, "line")
    S.save_model(_line_pipeline().fit(df), path)
    return _per(S.load_model(path).transform(df), ["q"], "prediction")


@register("l14_score_product_of_groups", """
WITH d AS (SELECT o_orderkey, (o_orderstatus = 'F')::int AS b, o_totalprice AS t, (o_totalprice > 200000)::int AS high FROM orders),
g AS (SELECT b, avg(t) AS m, 1 / (1 + exp(-2 * (2 * avg(high) - 1))) AS p FROM d GROUP BY 1)
SELECT o_orderkey, round(p * m, 3) AS score FROM d JOIN g USING (b)
""")
def l14_groups(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("b"), "o_totalprice",
                                        (F.col("o_totalprice") > 200000).cast("double").alias("high"))
    sev = L.score(L.fit_boosted_regressor(o, ["b"], "o_totalprice", iters=1, depth=1), o, "o_orderkey", ["b"], digits=None)
    prob = L.score(L.fit_boosted_classifier(o, ["b"], "high", iters=1, depth=1), o, "o_orderkey", ["b"], floor=None, digits=None, prob=True)
    return L.product_of_scores(prob, sev, "o_orderkey").select("o_orderkey", F.round("score", 3).alias("score"))


_AXES = _ROWS + """,
v AS (SELECT var_samp(q) AS a, var_samp(price) AS c, covar_samp(q, price) AS h FROM d),
e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + h * h) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + h * h) AS l2, 0.5 * atan2(2 * h, a - c) AS th FROM v),
f AS (SELECT *, CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN sign(cos(th)) ELSE sign(sin(th)) END AS s1,
             CASE WHEN abs(sin(th)) >= abs(cos(th)) THEN sign(-sin(th)) ELSE sign(cos(th)) END AS s2 FROM e),
x AS (SELECT l1 / (l1 + l2) AS r1, l2 / (l1 + l2) AS r2, s1 * cos(th) AS q1, s1 * sin(th) AS p1, -s2 * sin(th) AS q2, s2 * cos(th) AS p2 FROM f)
"""


def _axes(spark, sf):
    return L.pca(_rows(spark, sf), ["q", "price"], 2, standardize=False)


@register("m7_pca_of_two_columns", _AXES + """
SELECT 1 AS component, round(r1, 6) AS explained_variance, round(r1, 6) AS cumulative FROM x UNION ALL SELECT 2, round(r2, 6), round(r1 + r2, 6) FROM x
""")
def m7_two(spark, sf):
    return _axes(spark, sf)[2].select("component", *[F.round(c, 6).alias(c) for c in ("explained_variance", "cumulative")])


@register("m7_loadings_of_two_columns", _AXES + """
SELECT 1 AS component, 'q' AS feature, round(q1, 6) AS loading FROM x UNION ALL SELECT 1, 'price', round(p1, 6) FROM x
UNION ALL SELECT 2, 'q', round(q2, 6) FROM x UNION ALL SELECT 2, 'price', round(p2, 6) FROM x
""")
def m7_two_loadings(spark, sf):
    return _axes(spark, sf)[1].withColumn("loading", F.round("loading", 6))


@register("m7_projection_of_two_columns", _AXES + """
SELECT l_orderkey, l_linenumber, round(avg(q * q1 + price * p1), 4) AS first, round(avg(q * q2 + price * p2), 4) AS second FROM d, x GROUP BY 1, 2
""")
def m7_two_projected(spark, sf):
    p = _axes(spark, sf)[0]
    return p.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.avg(F.col("pcs")[0]), 4).alias("first"), F.round(F.avg(F.col("pcs")[1]), 4).alias("second"))


@register("a16_ranked_prevalence_map_entries", PREV_SQL + """
SELECT group_id, set_name, round(prevalence, 9) AS prevalence,
       row_number() OVER (PARTITION BY group_id ORDER BY prevalence DESC, set_name ASC)::int AS rank
FROM prev
""")
def a16_entries(spark, sf):
    out = A.ranked_prevalence(_prevalence(spark, sf), as_map=True)
    name = next(c for c, t in out.dtypes if t.startswith("map"))
    return out.select("group_id", F.posexplode(F.map_entries(name)).alias("at", "e")).select(
        "group_id", F.col("e.key").alias("set_name"), F.round("e.value", 9).alias("prevalence"), (F.col("at") + 1).alias("rank"))
