"""Catalog entries: outliers and segmentation."""

from pyspark.sql import functions as F

from quarry.operators import outliers as O
from quarry.plans.catalog.registry import Tables, register


def _r(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


@register("o1_iqr_filter", """
WITH q AS (SELECT quantile_cont(ln(o_totalprice), 0.25) AS q1, quantile_cont(ln(o_totalprice), 0.75) AS q3
           FROM orders WHERE o_totalprice > 0),
     b AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT o_orderkey, o_totalprice, round(lower, 9) AS lower, round(upper, 9) AS upper
FROM orders CROSS JOIN b WHERE o_totalprice > 0 AND ln(o_totalprice) BETWEEN lower AND upper
""")
def o1(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return _r(O.iqr_filter(o, "o_totalprice", log=True), ["lower", "upper"], 9)


_O2_BASE = """
WITH per AS (SELECT l_orderkey AS o_orderkey, count(*)::double AS n_lines, sum(l_quantity) AS qty,
                    avg(l_discount) AS avg_discount FROM lineitem GROUP BY 1),
     base AS (SELECT o.o_orderkey, o.o_totalprice, p.n_lines, p.qty, p.avg_discount
              FROM orders o JOIN per p USING (o_orderkey)),
     long AS (UNPIVOT base ON o_totalprice, n_lines, qty, avg_discount INTO NAME feature VALUE value),
     f AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1),
     flagged AS (SELECT l.o_orderkey, l.feature FROM long l JOIN f USING (feature)
                 WHERE l.value < q1 - 1.5 * (q3 - q1) OR l.value > q3 + 1.5 * (q3 - q1))
"""


def _o2_input(t):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty"),
        F.avg("l_discount").alias("avg_discount"))
    return t.orders.select("o_orderkey", "o_totalprice").join(per, "o_orderkey")


@register("o2_iqr_outliers", _O2_BASE + """
SELECT o_orderkey, count(*) AS n_outlier_features, string_agg(feature, ',' ORDER BY feature) AS outlier_features,
       (count(*) > 1)::int AS repeat_outlier
FROM flagged GROUP BY 1
""")
def o2(spark, sf):
    t = Tables(spark, sf)
    return O.iqr_outliers(_o2_input(t), "o_orderkey", ["o_totalprice", "n_lines", "qty", "avg_discount"])


@register("o2_clean_rows", _O2_BASE + """
SELECT o_orderkey, o_totalprice FROM base
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM flagged)
""")
def o2b(spark, sf):
    t = Tables(spark, sf)
    base = _o2_input(t)
    out = O.iqr_outliers(base, "o_orderkey", ["o_totalprice", "n_lines", "qty", "avg_discount"])
    return O.clean_rows(base, "o_orderkey", out).select("o_orderkey", "o_totalprice")


@register("o3_quantile_bins", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0.25, 0.5, 0.75]))) AS edges FROM orders)
SELECT o_orderkey, len(list_filter(edges, lambda v: v < o_totalprice))::int AS qbin FROM orders, e
""")
def o3(spark, sf):
    return O.quantile_bins(Tables(spark, sf).orders, "o_totalprice", 4).select("o_orderkey", "qbin")


@register("o4_segment_outliers", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS sq FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, round(q.sq, 6) AS segment_q,
       (l.l_extendedprice < q.sq)::int AS low_outlier
FROM lineitem l JOIN q USING (l_returnflag)
""")
def o4(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    out = O.segment_outliers(li, "l_returnflag", "l_extendedprice")
    return _r(out.select("l_orderkey", "l_linenumber", "l_returnflag", "segment_q", "low_outlier"), ["segment_q"])


@register("o5_quartile_flag", """
SELECT o_orderkey, (o_totalprice < (SELECT quantile_cont(o_totalprice, 0.25) FROM orders))::int AS low_flag FROM orders
""")
def o5(spark, sf):
    return O.quartile_flag(Tables(spark, sf).orders, "o_totalprice").select("o_orderkey", "low_flag")


@register("o6_quadrants", """
WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS ma, quantile_cont(l_extendedprice, 0.5) AS mb FROM lineitem)
SELECT concat(CASE WHEN l_quantity > ma THEN 'high_' ELSE 'low_' END, 'l_quantity__',
              CASE WHEN l_extendedprice > mb THEN 'high_' ELSE 'low_' END, 'l_extendedprice') AS quadrant,
       count(*) AS n
FROM lineitem, m GROUP BY 1
""")
def o6(spark, sf):
    return O.quadrants(Tables(spark, sf).lineitem, "l_quantity", "l_extendedprice")


@register("o7_threshold_segments", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal = 0 THEN 'zero'
                       WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'other' END AS segment
FROM customer
""")
def o7(spark, sf):
    c = Tables(spark, sf).customer
    return O.threshold_segments(c, "c_acctbal", [(1000, "low"), (5000, "mid")]).select("c_custkey", "segment")


@register("o8_rfm_features", """
WITH m AS (SELECT max(o_orderdate::date) AS d FROM orders),
     p AS (SELECT o_custkey, count(*) AS n_purchases, avg(o_totalprice) AS avg_amount,
                  min(o_orderdate::date) AS f, max(o_orderdate::date) AS l FROM orders GROUP BY 1)
SELECT o_custkey, n_purchases, round(avg_amount, 6) AS avg_amount, datediff('day', f, m.d)::int AS days_on_file,
       round(coalesce(datediff('day', f, l) / nullif(n_purchases - 1, 0), 0), 9) AS mean_gap_days,
       round(ln(1 + n_purchases), 9) AS log_n_purchases, round(ln(1 + avg_amount), 9) AS log_avg_amount
FROM p, m
""")
def o8(spark, sf):
    out = O.rfm_features(Tables(spark, sf).orders, "o_custkey", "o_orderdate", "o_totalprice")
    return _r(_r(out, ["avg_amount"]), ["mean_gap_days", "log_n_purchases", "log_avg_amount"], 9)
