"""Catalog entries: window, set and unnest operations."""

from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.plans.catalog.registry import Tables, register


@register("w1_group_broadcast", """
SELECT e.event_id, e.user_id, g.n_events, strftime(g.first_ts, '%Y-%m-%d %H:%M:%S') AS first_ts
FROM events e JOIN (SELECT user_id, count(*) AS n_events, min(ts) AS first_ts FROM events GROUP BY 1) g USING (user_id)
""")
def w1(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts")
    out = A.group_broadcast(ev, "user_id", {"n_events": F.count(F.lit(1)), "first_ts": F.min("ts")})
    return out.select("event_id", "user_id", "n_events", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@register("w2_stack", """
SELECT o_orderkey, o_totalprice, NULL::varchar AS o_orderstatus FROM orders WHERE year(o_orderdate) < 1998
UNION ALL
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE year(o_orderdate) >= 1998
""")
def w2(spark, sf):
    o = Tables(spark, sf).orders
    a = o.where(F.year("o_orderdate") < 1998).select("o_orderkey", "o_totalprice")
    b = o.where(F.year("o_orderdate") >= 1998).select("o_orderkey", "o_totalprice", "o_orderstatus")
    return A.stack(a, b)


@register("w3_explode_events", """
SELECT user_id, ts::date::varchar AS event_date, event_type AS item FROM events WHERE ts::date < DATE '2024-01-20'
""")
def w3(spark, sf):
    ev = Tables(spark, sf).events
    # one dated-map record per event: {date: [event_type]}
    rec = ev.select("user_id", F.create_map(F.to_date("ts").cast("string"), F.array("event_type")).alias("visits"))
    out = A.explode_events(rec, "user_id", "visits", "2024-01-20")
    return out.select("user_id", F.col("event_date").cast("string").alias("event_date"), "item")


_W4_VAL = "l_extendedprice * (l_discount - 0.05)"


@register("w4_top_k_wide", f"""
WITH s AS (SELECT l_orderkey, l_partkey::varchar AS name, {_W4_VAL} AS v FROM lineitem),
     r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(v) DESC, name ASC, v ASC) AS rk FROM s)
SELECT l_orderkey,
       max(name) FILTER (WHERE rk = 1) AS name_1, round(max(v) FILTER (WHERE rk = 1), 6) AS v_1,
       max(name) FILTER (WHERE rk = 2) AS name_2, round(max(v) FILTER (WHERE rk = 2), 6) AS v_2,
       max(name) FILTER (WHERE rk = 3) AS name_3, round(max(v) FILTER (WHERE rk = 3), 6) AS v_3
FROM r GROUP BY l_orderkey
""")
def w4(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        "l_orderkey", F.col("l_partkey").cast("string").alias("name"), F.expr(_W4_VAL).alias("v"))
    out = A.top_k_wide(li, "l_orderkey", "name", "v", 3)
    return out.select("l_orderkey", *[x for i in (1, 2, 3) for x in (
        F.col(f"name_{i}"), F.round(f"v_{i}", 6).alias(f"v_{i}"))])


@register("w4_top_k_wide_intercept", f"""
WITH s AS (SELECT l_orderkey, l_partkey::varchar AS name, round({_W4_VAL}, 6) AS v FROM lineitem),
     r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(v) DESC, name ASC, v ASC) AS rk FROM s),
     w AS (SELECT l_orderkey,
       max(name) FILTER (WHERE rk = 1) AS name_1, max(v) FILTER (WHERE rk = 1) AS v_1,
       max(name) FILTER (WHERE rk = 2) AS name_2, max(v) FILTER (WHERE rk = 2) AS v_2 FROM r GROUP BY 1)
SELECT o_orderkey AS l_orderkey,
       CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE round(o_totalprice, 2)::decimal(38,6)::varchar END AS intercept,
       CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE name_1 END AS name_1,
       CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE v_1::decimal(38,6)::varchar END AS v_1,
       CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE name_2 END AS name_2,
       CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE v_2::decimal(38,6)::varchar END AS v_2
FROM orders LEFT JOIN w ON l_orderkey = o_orderkey
""")
def w4_intercept(spark, sf):
    t = Tables(spark, sf)
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("name"), F.round(F.expr(_W4_VAL), 6).alias("v"))
    # an order's total stands for the bias; partly shipped orders have no match
    bias = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit("Bias").alias("name"), F.round("o_totalprice", 2).alias("v"))
    matched = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") != "P").alias("matched"))
    return A.top_k_wide(rows.unionByName(bias), "l_orderkey", "name", "v", 2, "Bias", matched, digits=6)
