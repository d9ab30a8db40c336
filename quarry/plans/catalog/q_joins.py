"""Catalog entries: joins and lookups."""

from pyspark.sql import functions as F

from quarry.operators import joins as J
from quarry.plans.catalog.registry import Tables, register


@register("j1_inner", """
SELECT o.o_orderkey, c.c_name, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def j1(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    return J.inner(t.orders, c, "o_custkey").select("o_orderkey", "c_name", "c_nationkey")


@register("j2_left_fill", """
SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def j2(spark, sf):
    t = Tables(spark, sf)
    return J.left_fill(t.documents.select("doc_id"), t.labels, "doc_id", {"quality": 0, "toxic": 0})


@register("j3_semi", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)
""")
def j3(spark, sf):
    t = Tables(spark, sf)
    ev = t.events.select(F.col("user_id").alias("c_custkey"))
    return J.semi(t.customer, ev, "c_custkey").select("c_custkey", "c_name")


@register("j4_anti", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def j4(spark, sf):
    t = Tables(spark, sf)
    return J.anti(t.documents, t.labels, "doc_id").select("doc_id", "source")


@register("j5_flag_member", """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') THEN 1 ELSE 0 END
       AS purchased
FROM customer
""")
def j5(spark, sf):
    t = Tables(spark, sf)
    buyers = t.events.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("c_custkey"))
    return J.flag_member(t.customer, buyers, "c_custkey", "purchased").select("c_custkey", "purchased")


@register("j6_lookup", """
WITH a AS (SELECT o_custkey, count(*) AS n_orders, round(avg(o_totalprice), 6) AS avg_price FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, coalesce(a.n_orders, -1) AS n_orders, coalesce(a.avg_price, -1) AS avg_price
FROM customer c LEFT JOIN a ON c.c_custkey = a.o_custkey
""")
def j6(spark, sf):
    t = Tables(spark, sf)
    agg = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.avg("o_totalprice"), 6).alias("avg_price"))
    return J.lookup(t.customer.select("c_custkey"), agg, ["c_custkey"], -1)


@register("j7_join_within_months", """
SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE l.l_shipdate::date <= (o.o_orderdate::date + INTERVAL 3 MONTH)::date
""")
def j7(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    out = J.join_within_months(t.orders, li, "o_orderkey", "o_orderdate", "l_shipdate", 3)
    return out.select("o_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register("j7_join_within_months_strict", """
SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE l.l_shipdate::date > o.o_orderdate::date AND l.l_shipdate::date <= (o.o_orderdate::date + INTERVAL 3 MONTH)::date
""")
def j7b(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    out = J.join_within_months(t.orders, li, "o_orderkey", "o_orderdate", "l_shipdate", 3, lower="strict")
    return out.select("o_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register("j8_covered_on", """
SELECT o_custkey AS c_custkey, min(o_orderpriority) AS group_number FROM orders
WHERE DATE '1998-06-01' >= o_orderdate::date AND DATE '1998-06-01' <= (o_orderdate::date + INTERVAL 3 MONTH)::date
GROUP BY o_custkey
""")
def j8(spark, sf):
    o = Tables(spark, sf).orders
    # each order is a coverage record holding an array of (group, start, end) intervals
    cov = o.select(F.col("o_custkey").alias("c_custkey"), F.array(F.struct(
        F.col("o_orderpriority").alias("group_number"), F.to_date("o_orderdate").alias("start_date"),
        F.add_months(F.to_date("o_orderdate"), 3).alias("end_date"))).alias("coverage"))
    return J.covered_on(cov, "c_custkey", "coverage", "1998-06-01")


@register("j9_align_features", """
WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
     b AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_totalprice, b.n_lines, b.qty
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
""")
def j9(spark, sf):
    t = Tables(spark, sf)
    a = t.orders.where(F.col("o_orderstatus") != "P").select("o_orderkey", "o_totalprice")
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    return J.align_features([a, b], "o_orderkey")


@register("j9_align_features_long", """
SELECT o_orderkey AS row_id, 'totalprice' AS feature, o_totalprice AS value FROM orders
UNION ALL
SELECT l_orderkey, 'qty', sum(l_quantity) FROM lineitem GROUP BY l_orderkey
""")
def j9b(spark, sf):
    t = Tables(spark, sf)
    a = t.orders.select(F.col("o_orderkey").alias("row_id"), F.lit("totalprice").alias("feature"),
                        F.col("o_totalprice").alias("value"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.lit("qty").alias("feature"), F.sum("l_quantity").alias("value"))
    return J.align_features([a, b], "row_id", long=True)
