"""Catalog entries: evaluation metrics.

Binary task on lineitem: label = returned (l_returnflag = 'R'), score =
l_discount + l_tax (coarse, so many tied scores), prediction = score > 0.1.
Regression task on orders: y = o_totalprice, p = 0.9 * y + 20000.
"""

from pyspark.sql import functions as F

from quarry.operators import metrics as T
from quarry.plans.catalog.registry import Tables, register
from quarry.semantics import hash_bucket


def _r(df, cols, d=9):
    return df.withColumns({c: F.round(c, d) for c in cols})


def _binary(t):
    return t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                             (F.col("l_discount") + F.col("l_tax")).alias("score")).withColumn(
        "pred", (F.col("score") > 0.1).cast("int"))


BIN_SQL = """(SELECT (l_returnflag = 'R')::int AS label, l_discount + l_tax AS score,
                   ((l_discount + l_tax) > 0.1)::int AS pred FROM lineitem)"""


def _reg(t):
    return t.orders.select("o_orderkey", "o_orderdate", "o_custkey", F.col("o_totalprice").alias("y"),
                           (F.col("o_totalprice") * 0.9 + 20000.0).alias("p"))


REG_SQL = """(SELECT o_orderkey, o_orderdate, o_custkey, o_totalprice AS y, o_totalprice * 0.9 + 20000.0 AS p
             FROM orders)"""


@register("t1_confusion", f"""
SELECT label, pred, count(*) AS n, round((SELECT avg((label = pred)::int) FROM {BIN_SQL}), 9) AS accuracy
FROM {BIN_SQL} GROUP BY 1, 2
""")
def t1(spark, sf):
    return _r(T.confusion(_binary(Tables(spark, sf)), "label", "pred"), ["accuracy"])


@register("t2_classification_report", f"""
WITH b AS {BIN_SQL},
     cls AS (SELECT label::varchar AS c FROM b UNION SELECT pred::varchar FROM b),
     per AS (SELECT c AS class,
                    coalesce((SELECT count(*) FROM b WHERE label::varchar = c AND pred::varchar = c)
                             / nullif((SELECT count(*) FROM b WHERE pred::varchar = c), 0), 0) AS precision,
                    coalesce((SELECT count(*) FROM b WHERE label::varchar = c AND pred::varchar = c)
                             / nullif((SELECT count(*) FROM b WHERE label::varchar = c), 0), 0) AS recall,
                    (SELECT count(*) FROM b WHERE label::varchar = c) AS support FROM cls),
     per2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per),
     allr AS (SELECT * FROM per2
              UNION ALL SELECT 'macro avg', avg(precision), avg(recall), sum(support), avg(f1) FROM per2
              UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                               sum(support), sum(f1 * support) / sum(support) FROM per2)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, support::bigint AS support,
       round(f1, 9) AS f1 FROM allr
""")
def t2(spark, sf):
    return _r(T.classification_report(_binary(Tables(spark, sf)), "label", "pred"), ["precision", "recall", "f1"])


ROC_SQL = f"""
WITH per AS (SELECT score, sum(label)::double AS pos, sum(1 - label)::double AS neg FROM {BIN_SQL} GROUP BY 1),
     cum AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn
             FROM per),
     tot AS (SELECT sum(pos) AS "P", sum(neg) AS "N" FROM per)
"""


@register("t3_roc", ROC_SQL + """
SELECT score AS threshold, cp AS tp, cn AS fp, round(cp / "P", 9) AS tpr, round(cn / "N", 9) AS fpr FROM cum, tot
""")
def t3(spark, sf):
    return _r(T.roc(_binary(Tables(spark, sf)), "label", "score"), ["tpr", "fpr"])


@register("t3_roc_auc", ROC_SQL + """
SELECT round(sum(neg * (2 * cp - pos)) / 2.0 / (max("P") * max("N")), 9) AS auc FROM cum, tot
""")
def t3b(spark, sf):
    return _r(T.roc_auc(_binary(Tables(spark, sf)), "label", "score"), ["auc"])


@register("t4_pr_curve", ROC_SQL + """
SELECT score AS threshold, round(cp / (cp + cn), 9) AS precision, round(cp / "P", 9) AS recall FROM cum, tot
""")
def t4(spark, sf):
    return _r(T.pr_curve(_binary(Tables(spark, sf)), "label", "score"), ["precision", "recall"])


@register("t4_average_precision", ROC_SQL + """
SELECT round(sum((pos / "P") * (cp / (cp + cn))), 9) AS average_precision FROM cum, tot
""")
def t4b(spark, sf):
    return _r(T.average_precision(_binary(Tables(spark, sf)), "label", "score"), ["average_precision"])


_REGM = """count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 2) AS mse,
       round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 9) AS r2,
       round(1 - (sum((y - p) * (y - p)) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 1 - 1), 9) AS adj_r2,
       round(avg(abs((y - p) / nullif(y, 0))), 9) AS mape"""


def _regm(df):
    return _r(_r(_r(df, ["mae", "rmse"], 6), ["mse"], 2), ["r2", "adj_r2", "mape"], 9)


@register("t5_regression_metrics", f"SELECT {_REGM} FROM {REG_SQL}")
def t5(spark, sf):
    return _regm(T.regression_metrics(_reg(Tables(spark, sf)), "y", "p", 1))


@register("t6_asymmetric_loss", f"""
SELECT round(avg(CASE WHEN y - p > 0 THEN 4.0 * (y - p) * (y - p) ELSE (y - p) * (y - p) END), 2) AS asymmetric_loss
FROM {REG_SQL}
""")
def t6(spark, sf):
    return _r(T.asymmetric_loss(_reg(Tables(spark, sf)), "y", "p", 4.0), ["asymmetric_loss"], 2)


def _top_sql(src: str, prefix: str = "", all_rows: str = "s") -> str:
    return f"""
WITH s AS {src},
     q AS (SELECT quantile_cont(y, 0.9) AS ty, quantile_cont(p, 0.9) AS tp_ FROM {all_rows}),
     a AS (SELECT count(*) FILTER (WHERE y > ty AND p > tp_) AS tp, count(*) FILTER (WHERE p > tp_) AS np,
                  count(*) FILTER (WHERE y > ty) AS ny, sum(CASE WHEN p > tp_ THEN y ELSE 0 END) AS cp,
                  sum(CASE WHEN y > ty THEN y ELSE 0 END) AS ct FROM s, q),
     m AS (SELECT coalesce(tp / nullif(np, 0), 0) AS pr, coalesce(tp / nullif(ny, 0), 0) AS rc,
                  coalesce(cp / nullif(ct, 0), 0) AS cc FROM a)
SELECT round(pr, 9) AS {prefix}precision, round(rc, 9) AS {prefix}recall,
       round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 9) AS {prefix}f1, round(cc, 9) AS {prefix}cost_capture FROM m
"""


@register("t7_top_decile_metrics", _top_sql(REG_SQL))
def t7(spark, sf):
    out = T.top_decile_metrics(_reg(Tables(spark, sf)), "y", "p", 0.9)
    return _r(out, ["precision", "recall", "f1", "cost_capture"])


@register("t8_threshold_metrics", f"""
WITH s AS {REG_SQL}, th AS (SELECT unnest([100000.0, 200000.0, 300000.0])::double AS threshold),
     x AS (SELECT threshold, y, p, (y > threshold)::int AS lab FROM s CROSS JOIN th),
     a AS (SELECT threshold, sqrt(avg(CASE WHEN y > threshold THEN (y - p) * (y - p) END)) AS rmse_above,
                  count(*) FILTER (WHERE lab = 1 AND p > threshold) AS tp, count(*) FILTER (WHERE p > threshold) AS np,
                  count(*) FILTER (WHERE lab = 1) AS ny, sum(CASE WHEN p > threshold THEN y ELSE 0 END) AS cp,
                  sum(CASE WHEN lab = 1 THEN y ELSE 0 END) AS ct FROM x GROUP BY 1),
     per AS (SELECT threshold, p AS score, sum(lab)::double AS pos, sum(1 - lab)::double AS neg FROM x GROUP BY 1, 2),
     cum AS (SELECT *, sum(pos) OVER (PARTITION BY threshold ORDER BY score DESC) AS cpos,
                       sum(neg) OVER (PARTITION BY threshold ORDER BY score DESC) AS cneg,
                       sum(pos) OVER (PARTITION BY threshold) AS "P" FROM per),
     ap AS (SELECT threshold, sum((pos / "P") * (cpos / (cpos + cneg))) AS average_precision FROM cum GROUP BY 1),
     m AS (SELECT a.*, coalesce(tp / nullif(np, 0), 0) AS pr, coalesce(tp / nullif(ny, 0), 0) AS rc FROM a)
SELECT m.threshold, round(rmse_above, 6) AS rmse_above, round(pr, 9) AS precision, round(rc, 9) AS recall,
       round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 9) AS f1, round(coalesce(cp / nullif(ct, 0), 0), 9) AS cost_capture,
       round(ap.average_precision, 9) AS average_precision
FROM m LEFT JOIN ap USING (threshold)
""")
def t8(spark, sf):
    out = T.threshold_metrics(_reg(Tables(spark, sf)), "y", "p", [100000.0, 200000.0, 300000.0])
    return _r(_r(out, ["rmse_above"], 6), ["precision", "recall", "f1", "cost_capture", "average_precision"])


_PRIOR_SRC = """(SELECT r.* FROM (SELECT o.*, c.c_acctbal AS prior FROM {reg} o JOIN customer c ON o.o_custkey = c.c_custkey) r
                WHERE prior < (SELECT quantile_cont(c_acctbal, 0.9) FROM (SELECT c.c_acctbal FROM {reg} o
                               JOIN customer c ON o.o_custkey = c.c_custkey)))"""


_T8P_SQL = f"""
WITH s AS (SELECT *, 1 / (1 + exp(-(p - 100000.0) / 50000.0)) AS pr_100k, 1 / (1 + exp(-(p - 300000.0) / 50000.0)) AS pr_300k
           FROM {REG_SQL}),
     th AS (SELECT unnest([100000.0, 300000.0])::double AS threshold),
     x AS (SELECT threshold, y, CASE WHEN threshold = 100000.0 THEN pr_100k ELSE pr_300k END AS score,
                  (y > threshold)::int AS lab FROM s CROSS JOIN th),
     per AS (SELECT threshold, score, sum(lab)::double AS pos, sum(1 - lab)::double AS neg FROM x GROUP BY 1, 2),
     cum AS (SELECT *, sum(pos) OVER (PARTITION BY threshold ORDER BY score DESC) AS cpos,
                       sum(neg) OVER (PARTITION BY threshold ORDER BY score DESC) AS cneg,
                       sum(pos) OVER (PARTITION BY threshold) AS "P" FROM per)
SELECT threshold, round(sum((pos / "P") * (cpos / (cpos + cneg))), 9) AS average_precision FROM cum GROUP BY 1
"""


@register("t8_threshold_metrics_with_probs", _T8P_SQL)
def t8b(spark, sf):
    reg = _reg(Tables(spark, sf)).withColumns({
        "pr_100k": 1 / (1 + F.exp(-(F.col("p") - 100000.0) / 50000.0)),
        "pr_300k": 1 / (1 + F.exp(-(F.col("p") - 300000.0) / 50000.0))})
    out = T.threshold_metrics(reg, "y", "p", [100000.0, 300000.0], probs={100000.0: "pr_100k", 300000.0: "pr_300k"})
    return _r(out.select("threshold", "average_precision"), ["average_precision"])


@register("t9_newly_top_metrics", _top_sql(_PRIOR_SRC.format(reg=REG_SQL), "newly_", f"(SELECT o.* FROM {REG_SQL} o JOIN customer c ON o.o_custkey = c.c_custkey)"))
def t9(spark, sf):
    t = Tables(spark, sf)
    df = _reg(t).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("prior")),
                      "o_custkey")
    out = T.newly_top_metrics(df, "y", "p", "prior", 0.9).drop("newly_rmse")
    return _r(out, ["newly_precision", "newly_recall", "newly_f1", "newly_cost_capture"])


_NEW_SQL = f"(SELECT o.*, c.c_acctbal * 30 AS prior FROM {REG_SQL} o JOIN customer c ON o.o_custkey = c.c_custkey)"


def _new(t):
    return _reg(t).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") * 30).alias("prior")), "o_custkey")


@register("t9_newly_top_rmse", f"""
WITH s AS {_NEW_SQL}, q AS (SELECT quantile_cont(y, 0.9) AS ty, quantile_cont(prior, 0.9) AS tq FROM s)
SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS newly_rmse FROM s, q WHERE y > ty AND prior < tq
""")
def t9_rmse(spark, sf):
    return _r(T.newly_top_metrics(_new(Tables(spark, sf)), "y", "p", "prior", 0.9).select("newly_rmse"), ["newly_rmse"], 6)


@register("t9_newly_threshold_metrics", f"""
WITH s AS {_NEW_SQL}, th AS (SELECT unnest([100000.0, 200000.0, 300000.0])::double AS threshold),
     x AS (SELECT threshold, y, p, (y > threshold)::int AS lab FROM s CROSS JOIN th WHERE prior < threshold),
     a AS (SELECT threshold, count(*) FILTER (WHERE lab = 1 AND p > threshold) AS tp, count(*) FILTER (WHERE p > threshold) AS np,
                  count(*) FILTER (WHERE lab = 1) AS ny FROM x GROUP BY 1),
     per AS (SELECT threshold, p AS score, sum(lab)::double AS pos, sum(1 - lab)::double AS neg FROM x GROUP BY 1, 2),
     cum AS (SELECT *, sum(pos) OVER (PARTITION BY threshold ORDER BY score DESC) AS cpos,
                       sum(neg) OVER (PARTITION BY threshold ORDER BY score DESC) AS cneg,
                       sum(pos) OVER (PARTITION BY threshold) AS "P" FROM per),
     ap AS (SELECT threshold, sum((pos / "P") * (cpos / (cpos + cneg))) AS average_precision FROM cum GROUP BY 1),
     m AS (SELECT a.*, coalesce(tp / nullif(np, 0), 0) AS pr, coalesce(tp / nullif(ny, 0), 0) AS rc FROM a)
SELECT m.threshold, round(pr, 9) AS newly_precision, round(rc, 9) AS newly_recall,
       round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 9) AS newly_f1, round(ap.average_precision, 9) AS newly_average_precision
FROM m LEFT JOIN ap USING (threshold)
""")
def t9_thresholds(spark, sf):
    out = T.newly_threshold_metrics(_new(Tables(spark, sf)), "y", "p", "prior", [100000.0, 200000.0, 300000.0])
    return _r(out, ["newly_precision", "newly_recall", "newly_f1", "newly_average_precision"])


_SPLIT_SQL = "CASE WHEN (('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 100) < 70 THEN 'train' ELSE 'test' END"


@register("t10_by_split", f"""
SELECT split, {_REGM} FROM (SELECT *, {_SPLIT_SQL} AS split FROM {REG_SQL}) GROUP BY split
""")
def t10(spark, sf):
    df = _reg(Tables(spark, sf)).withColumn(
        "split", F.when(hash_bucket("o_orderkey") < 70, "train").otherwise("test"))
    return _regm(T.by_split(T.regression_metrics, df, "split", y="y", p="p", n_features=1))


DIMENSIONS = 64  # of the embeddings table


@register("t11_cluster_profile", f"""
SELECT label, count(*) AS size, {", ".join(f"round(avg(embedding[{i + 1}]::double), 9) AS mean_{i}" for i in range(DIMENSIONS))}
FROM embeddings GROUP BY label
""")
def t11(spark, sf):
    e = Tables(spark, sf).embeddings
    out = T.cluster_profile(e, "label", [F.col("embedding")[i].cast("double") for i in range(DIMENSIONS)])
    return _r(out, [f"mean_{i}" for i in range(DIMENSIONS)])


@register("t12_score_summary", f"""
SELECT year(o_orderdate)::int AS period, count(*) AS n, round(avg(y), 6) AS mean_true, round(avg(p), 6) AS mean_pred,
       round(quantile_cont(y, 0.5), 6) AS median_true, round(quantile_cont(p, 0.5), 6) AS median_pred
FROM {REG_SQL} GROUP BY 1
""")
def t12(spark, sf):
    df = _reg(Tables(spark, sf)).withColumn("period", F.year("o_orderdate"))
    out = T.score_summary(df, "y", "p", "period")
    return _r(out, ["mean_true", "mean_pred", "median_true", "median_pred"], 6)
