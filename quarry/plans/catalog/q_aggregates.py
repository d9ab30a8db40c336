"""Catalog entries: aggregation."""

from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.plans.catalog.registry import Tables, register


@register("a1_count_by", """
SELECT ts::date::varchar AS day, event_type, count(*) AS n FROM events
WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2
""")
def a1(spark, sf):
    ev = Tables(spark, sf).events.select(F.to_date("ts").cast("string").alias("day"), "event_type")
    return A.count_by(ev, ["day", "event_type"])


@register("a2_distinct_by", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_l_partkey FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1")
def a2(spark, sf):
    return A.distinct_by(Tables(spark, sf).lineitem, "l_suppkey", "l_partkey")


@register("a3_agg_by", """
SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_order, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order,
       round(sum(o_totalprice), 2) AS total, count(o_orderkey) AS n
FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey
""")
def a3(spark, sf):
    out = A.agg_by(Tables(spark, sf).orders, "o_custkey", {
        "first_order": ("min", "o_orderdate"), "last_order": ("max", "o_orderdate"),
        "total": ("sum", "o_totalprice"), "n": ("count", "o_orderkey")})
    return out.select("o_custkey", F.date_format("first_order", "yyyy-MM-dd").alias("first_order"),
                      F.date_format("last_order", "yyyy-MM-dd").alias("last_order"),
                      F.round("total", 2).alias("total"), "n")


@register("a4_mean_by", """
SELECT l_returnflag, round(avg(l_discount), 9) AS mean_l_discount FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1
""")
def a4(spark, sf):
    out = A.mean_by(Tables(spark, sf).lineitem, "l_returnflag", "l_discount")
    return out.withColumn("mean_l_discount", F.round("mean_l_discount", 9))


@register("a5_sum_label_by", """
SELECT l_orderkey, sum(l_quantity) AS total, (sum(l_quantity) >= 100)::int AS label FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1
""")
def a5(spark, sf):
    return A.sum_label_by(Tables(spark, sf).lineitem, "l_orderkey", "l_quantity", 100)


@register("a6_nested_mean", """
SELECT l_suppkey, round(avg(s), 6) AS mean_sum_per_order FROM (
  SELECT l_suppkey, l_orderkey, sum(l_extendedprice) AS s FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL GROUP BY 1, 2) GROUP BY 1
""")
def a6(spark, sf):
    out = A.nested_mean(Tables(spark, sf).lineitem, "l_suppkey", "l_orderkey", "sum", "l_extendedprice",
                        "mean_sum_per_order")
    return out.withColumn("mean_sum_per_order", F.round("mean_sum_per_order", 6))


@register("a7_variance_by", """
SELECT o_orderstatus, o_orderpriority, round(var_pop(o_totalprice), 2) AS var_o_totalprice FROM orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2
""")
def a7(spark, sf):
    out = A.variance_by(Tables(spark, sf).orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return out.withColumn("var_o_totalprice", F.round("var_o_totalprice", 2))


@register("a8_quantiles_by", """
SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS q3
FROM lineitem GROUP BY 1
""")
def a8(spark, sf):
    out = A.quantiles_by(Tables(spark, sf).lineitem, "l_suppkey", "l_extendedprice")
    return out.select("l_suppkey", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"))


@register("a9_crosstab_long", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2
""")
def a9(spark, sf):
    return A.crosstab_long(Tables(spark, sf).orders, "o_orderstatus", "o_orderpriority")


@register("a10_count_positive_by", """
SELECT l_linestatus, count(*) AS total, sum((l_discount > 0.05)::int)::bigint AS positive FROM lineitem
WHERE l_linestatus IS NOT NULL GROUP BY 1
""")
def a10(spark, sf):
    return A.count_positive_by(Tables(spark, sf).lineitem, "l_linestatus", F.col("l_discount") > 0.05)


@register("a11_summarize", """
SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean,
       (SELECT o_totalprice FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_totalprice ASC LIMIT 1) AS mode,
       min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg((o_totalprice > 0)::int), 9) AS share_positive,
       quantile_cont(o_totalprice, 0.5) AS median
FROM orders
""")
def a11(spark, sf):
    out = A.summarize(Tables(spark, sf).orders, "o_totalprice")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("share_positive", F.round("share_positive", 9))


@register("a12_value_counts", """
SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand ASC LIMIT 10
""")
def a12(spark, sf):
    return A.value_counts(Tables(spark, sf).part, "p_brand", 10)


@register("a12_value_counts_all", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def a12b(spark, sf):
    return A.value_counts(Tables(spark, sf).part, "p_type")


@register("a13_first_by", "SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def a13(spark, sf):
    return A.first_by(Tables(spark, sf).orders, "o_custkey", "o_orderpriority")


@register("a14_ratio_by", """
SELECT c.c_nationkey, count(o.o_orderkey) AS numerator, count(DISTINCT o.o_custkey) AS denominator,
       round(count(o.o_orderkey) / count(DISTINCT o.o_custkey), 9) AS orders_per_customer
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey IS NOT NULL GROUP BY 1
""")
def a14(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = A.ratio_by(j, "c_nationkey", F.count("o_orderkey"), F.count_distinct("o_custkey"), "orders_per_customer")
    return out.withColumn("orders_per_customer", F.round("orders_per_customer", 9))


# The curated feature sets used for the prevalence questions.
FEATURE_SETS = [("economy", "ECONOMY"), ("large_or_small", "LARGE"), ("large_or_small", "SMALL"),
                ("promo", "PROMO"), ("standard", "STANDARD")]
FEATURE_SETS_SQL = ", ".join(f"('{s}', '{f}')" for s, f in FEATURE_SETS)

PREV_SQL = f"""
WITH sets(set_name, feature) AS (VALUES {FEATURE_SETS_SQL}),
     feats AS (SELECT o.o_custkey AS member, p.p_type AS feature, l.l_quantity AS value
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
     flagged AS (SELECT member, set_name FROM feats JOIN sets USING (feature)
                 GROUP BY member, set_name HAVING sum(value) <> 0),
     mem AS (SELECT DISTINCT c_nationkey::varchar AS group_id, c_custkey AS member FROM customer),
     sizes AS (SELECT group_id, count(*) AS members FROM mem GROUP BY group_id),
     names AS (SELECT DISTINCT set_name FROM sets),
     hits AS (SELECT group_id, set_name, count(*) AS flagged FROM flagged JOIN mem USING (member) GROUP BY 1, 2),
     per_group AS (SELECT s.group_id, n.set_name, s.members, coalesce(h.flagged, 0) AS flagged
                   FROM sizes s CROSS JOIN names n LEFT JOIN hits h ON h.group_id = s.group_id AND h.set_name = n.set_name),
     allm AS (SELECT DISTINCT member FROM mem),
     pop AS (SELECT '__all__' AS group_id, n.set_name, (SELECT count(*) FROM allm) AS members,
                    (SELECT count(*) FROM flagged f WHERE f.set_name = n.set_name AND f.member IN (SELECT member FROM allm))
                    AS flagged FROM names n),
     prev AS (SELECT *, flagged / members AS prevalence FROM (SELECT * FROM per_group UNION ALL SELECT * FROM pop))
"""


def _prevalence(spark, sf, in_group=None, listed=None):
    t = Tables(spark, sf)
    feats = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("o_custkey").alias("member"), F.col("p_type").alias("feature"),
                     F.col("l_quantity").alias("value")))
    members = (t.customer if in_group is None else t.customer.where(in_group)).select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("member"))
    sets = spark.createDataFrame(FEATURE_SETS, "set_name string, feature string")
    return A.prevalence(feats, members, sets, members=listed)


@register("a15_prevalence", PREV_SQL + """
SELECT group_id, set_name, members, flagged, round(prevalence, 9) AS prevalence FROM prev
""")
def a15(spark, sf):
    return _prevalence(spark, sf).withColumn("prevalence", F.round("prevalence", 9))


@register("a15_prevalence_member_list", PREV_SQL.replace(
    "FROM customer)", "FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM orders))").replace(
    "SELECT DISTINCT member FROM mem)", "SELECT DISTINCT o_custkey AS member FROM orders)") + """
SELECT group_id, set_name, members, flagged, round(prevalence, 9) AS prevalence FROM prev
""")
def a15b(spark, sf):
    """Customers with a negative balance are in no group; those without orders are not on the list."""
    t = Tables(spark, sf)
    out = _prevalence(spark, sf, F.col("c_acctbal") >= 0, t.orders.select(F.col("o_custkey").alias("member")))
    return out.withColumn("prevalence", F.round("prevalence", 9))


@register("a16_ranked_prevalence", PREV_SQL + """
SELECT group_id, set_name, round(prevalence, 9) AS prevalence,
       row_number() OVER (PARTITION BY group_id ORDER BY prevalence DESC, set_name ASC)::int AS rank
FROM prev
""")
def a16(spark, sf):
    out = A.ranked_prevalence(_prevalence(spark, sf))
    return out.withColumn("prevalence", F.round("prevalence", 9))


@register("a16_ranked_prevalence_map")
def a16b(spark, sf):
    """Same ranking as an ordered map per group (tag -> prevalence, highest first)."""
    return A.ranked_prevalence(_prevalence(spark, sf), as_map=True)


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("a17_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 9) AS corr FROM lineitem"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]))
def a17(spark, sf):
    return A.correlation(Tables(spark, sf).lineitem, CORR_COLS).withColumn("corr", F.round("corr", 9))


@register("a17_correlation_masked", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 9) AS corr FROM lineitem"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]) + ") WHERE corr >= 0.003 OR corr <= -0.002")
def a17b(spark, sf):
    out = A.correlation(Tables(spark, sf).lineitem, CORR_COLS, hi=0.003, lo=-0.002)
    return out.withColumn("corr", F.round("corr", 9))


@register("a18_prevalence_filter", """
WITH f AS (SELECT o.o_custkey AS row_id, p.p_brand AS feature, sum(l.l_quantity) AS value
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
           GROUP BY 1, 2),
     s AS (SELECT feature, count(DISTINCT row_id) AS n FROM f WHERE value <> 0 GROUP BY 1)
SELECT row_id, feature, value FROM f
WHERE feature IN (SELECT feature FROM s WHERE n >= round_even((0.5 * (SELECT count(*) FROM customer))::double, 0))
""")
def a18(spark, sf):
    t = Tables(spark, sf)
    f = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
         .groupBy(F.col("o_custkey").alias("row_id"), F.col("p_brand").alias("feature"))
         .agg(F.sum("l_quantity").alias("value")))
    return A.prevalence_filter(f, 0.5, n_rows=t.customer.agg(F.count(F.lit(1)).alias("n")))
