"""Catalog entries: distribution tables."""

from pyspark.sql import functions as F

from quarry.operators import distributions as D
from quarry.plans.catalog.registry import Tables, register


def _r(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


@register("d1_histogram", """
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 20.0 AS w
           FROM orders),
     b AS (SELECT least(floor((o_totalprice - s.lo) / s.w)::int, 19) AS bin, count(*) AS n FROM orders, s GROUP BY 1),
     g AS (SELECT unnest(range(0, 20))::int AS bin)
SELECT g.bin, round(s.lo + g.bin * s.w, 6) AS lower, round(s.lo + (g.bin + 1) * s.w, 6) AS upper,
       coalesce(b.n, 0) AS count
FROM g CROSS JOIN s LEFT JOIN b ON g.bin = b.bin
""")
def d1(spark, sf):
    return _r(D.histogram(Tables(spark, sf).orders, "o_totalprice", 20), ["lower", "upper"])


@register("d1_histogram_log", """
WITH s AS (SELECT min(log10(o_totalprice)) AS lo, max(log10(o_totalprice)) AS hi,
                  (max(log10(o_totalprice)) - min(log10(o_totalprice))) / 12.0 AS w FROM orders WHERE o_totalprice > 0),
     b AS (SELECT least(floor((log10(o_totalprice) - s.lo) / s.w)::int, 11) AS bin, count(*) AS n
           FROM orders, s WHERE o_totalprice > 0 GROUP BY 1),
     g AS (SELECT unnest(range(0, 12))::int AS bin)
SELECT g.bin, round(pow(10, s.lo + g.bin * s.w), 4) AS lower, round(pow(10, s.lo + (g.bin + 1) * s.w), 4) AS upper,
       coalesce(b.n, 0) AS count
FROM g CROSS JOIN s LEFT JOIN b ON g.bin = b.bin
""")
def d1b(spark, sf):
    return _r(D.histogram(Tables(spark, sf).orders, "o_totalprice", 12, log=True), ["lower", "upper"], 4)


@register("d2_histogram_compare", """
WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10.0 AS w FROM lineitem),
     c AS (SELECT l_returnflag AS label, least(floor((l_extendedprice - s.lo) / s.w)::int, 9) AS bin, count(*) AS n
           FROM lineitem, s GROUP BY 1, 2),
     t AS (SELECT label, sum(n) AS total FROM c GROUP BY 1),
     g AS (SELECT label, total, unnest(range(0, 10))::int AS bin FROM t)
SELECT g.label, g.bin, round(s.lo + g.bin * s.w, 6) AS lower, round(s.lo + (g.bin + 1) * s.w, 6) AS upper,
       coalesce(c.n, 0) AS count, round(coalesce(c.n, 0) / (g.total * s.w), 12) AS density
FROM g LEFT JOIN c ON g.label = c.label AND g.bin = c.bin CROSS JOIN s
""")
def d2(spark, sf):
    out = D.histogram_compare(Tables(spark, sf).lineitem, "l_extendedprice", "l_returnflag", 10)
    return _r(_r(out, ["density"], 12), ["lower", "upper"])


@register("d2_histogram_compare_log", """
WITH s AS (SELECT log10(min(l_quantity) + 1) AS lo, (log10(max(l_quantity)) - log10(min(l_quantity) + 1)) / 7.0 AS w FROM lineitem),
     c AS (SELECT l_linestatus AS label, least(floor((log10(l_quantity) - s.lo) / s.w)::int, 6) AS bin, count(*) AS n
           FROM lineitem, s WHERE log10(l_quantity) >= s.lo GROUP BY 1, 2),
     t AS (SELECT label, sum(n) AS total FROM c GROUP BY 1),
     g AS (SELECT label, total, unnest(range(0, 7))::int AS bin FROM t),
     e AS (SELECT g.*, pow(10, s.lo + g.bin * s.w) AS lower, pow(10, s.lo + (g.bin + 1) * s.w) AS upper FROM g CROSS JOIN s)
SELECT e.label, e.bin, round(lower, 6) AS lower, round(upper, 6) AS upper, coalesce(c.n, 0) AS count,
       round(coalesce(c.n, 0) / (e.total * (upper - lower)), 9) AS density
FROM e LEFT JOIN c ON e.label = c.label AND e.bin = c.bin
""")
def d2_log(spark, sf):
    out = D.histogram_compare(Tables(spark, sf).lineitem, "l_quantity", "l_linestatus", 7, log=True)
    return _r(_r(out, ["density"], 9), ["lower", "upper"])


@register("d2_histogram_compare_edges", """
WITH e AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin, unnest([0.0, 5.0, 20.0, 45.0, 60.0]) AS lower, unnest([5.0, 20.0, 45.0, 60.0, 90.0]) AS upper),
     t AS (SELECT l_linestatus AS label, count(*) AS total FROM lineitem WHERE l_quantity BETWEEN 0 AND 90 GROUP BY 1),
     c AS (SELECT l_linestatus AS label, e.bin, count(*) AS n FROM lineitem JOIN e
             ON l_quantity >= e.lower AND (l_quantity < e.upper OR (e.bin = 4 AND l_quantity = e.upper)) GROUP BY 1, 2)
SELECT t.label, e.bin::int AS bin, e.lower::double AS lower, e.upper::double AS upper, coalesce(c.n, 0) AS count,
       round(coalesce(c.n, 0) / (t.total * (e.upper - e.lower))::double, 12) AS density
FROM t CROSS JOIN e LEFT JOIN c ON c.label = t.label AND c.bin = e.bin
""")
def d2_edges(spark, sf):
    return _r(D.histogram_compare(Tables(spark, sf).lineitem, "l_quantity", "l_linestatus", [0, 5, 20, 45, 60, 90]), ["density"], 12)


@register("d3_rate_by_category", """
SELECT l_linestatus, year(l_shipdate)::int AS ship_year, count(*) AS count,
       round(avg((l_returnflag = 'R')::int), 9) AS mean,
       round(stddev_samp((l_returnflag = 'R')::int) / sqrt(count(*)), 9) AS stderr
FROM lineitem GROUP BY 1, 2
""")
def d3(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_linestatus", F.year("l_shipdate").alias("ship_year"),
                                           (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return _r(D.rate_by_category(li, "l_linestatus", "returned", "ship_year"), ["mean", "stderr"], 9)


_BOX_SQL = """
WITH q AS (SELECT {g} quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem {grp}),
     f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
     a AS (SELECT {g} count(*) AS n,
                  min(CASE WHEN l_extendedprice BETWEEN lower_fence AND upper_fence THEN l_extendedprice END) AS whisker_low,
                  max(CASE WHEN l_extendedprice BETWEEN lower_fence AND upper_fence THEN l_extendedprice END) AS whisker_high,
                  count(*) FILTER (WHERE NOT (l_extendedprice BETWEEN lower_fence AND upper_fence)) AS n_outliers
           FROM lineitem {join} {grp})
SELECT {g} a.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence, whisker_low, whisker_high, n_outliers
FROM f {join2}
"""
_BOX_COLS = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]


@register("d4_box_stats", _BOX_SQL.format(g="", grp="", join="CROSS JOIN f", join2="CROSS JOIN a"))
def d4(spark, sf):
    return _r(D.box_stats(Tables(spark, sf).lineitem, "l_extendedprice"), _BOX_COLS)


@register("d4_box_stats_by_group", _BOX_SQL.format(
    g="l_returnflag,", grp="GROUP BY l_returnflag", join="JOIN f USING (l_returnflag)",
    join2="JOIN a USING (l_returnflag)").replace("SELECT l_returnflag, a.n", "SELECT f.l_returnflag, a.n")
    .replace("FROM lineitem JOIN f USING (l_returnflag) GROUP BY l_returnflag", "FROM lineitem JOIN f USING (l_returnflag) GROUP BY l_returnflag"))
def d4b(spark, sf):
    return _r(D.box_stats(Tables(spark, sf).lineitem, "l_extendedprice", "l_returnflag"), _BOX_COLS)


def _bucket_sql(col: str, b: int, alias: str) -> str:
    probs = ", ".join(str(i / b) for i in range(b + 1))
    return (f"(SELECT list_sort(list_distinct(quantile_cont({col}, [{probs}]))) AS e FROM lineitem) {alias}")


def _bucket_expr(col: str, alias: str) -> str:
    return (f"greatest(least(len(list_filter({alias}.e, lambda v: v <= {col})) - 1, len({alias}.e) - 2), 0)")


@register("d5_target_by_bucket", f"""
WITH b AS (SELECT {_bucket_expr('l_extendedprice', 'q')} AS bucket, q.e, l_discount FROM lineitem, {_bucket_sql('l_extendedprice', 10, 'q')})
SELECT bucket::int AS bucket, round(e[bucket + 1], 6) AS bucket_lower, round(e[bucket + 2], 6) AS bucket_upper,
       count(*) AS count, round(avg(l_discount), 9) AS mean_target
FROM b GROUP BY bucket, e
""")
def d5(spark, sf):
    out = D.target_by_bucket(Tables(spark, sf).lineitem, "l_extendedprice", "l_discount", 10)
    return _r(_r(out, ["bucket_lower", "bucket_upper"]), ["mean_target"], 9)


@register("d5_target_by_value", """
SELECT l_quantity, count(*) AS count, round(avg(l_discount), 9) AS mean_target FROM lineitem GROUP BY 1
""")
def d5b(spark, sf):
    return _r(D.target_by_value(Tables(spark, sf).lineitem, "l_quantity", "l_discount"), ["mean_target"], 9)


@register("d6_target_by_grid", f"""
WITH b AS (SELECT {_bucket_expr('l_extendedprice', 'q1')} AS b1, {_bucket_expr('l_quantity', 'q2')} AS b2, l_discount
           FROM lineitem, {_bucket_sql('l_extendedprice', 4, 'q1')}, {_bucket_sql('l_quantity', 4, 'q2')})
SELECT b1::int AS b1, b2::int AS b2, count(*) AS count, round(avg(l_discount), 9) AS mean_target FROM b GROUP BY 1, 2
""")
def d6(spark, sf):
    out = D.target_by_grid(Tables(spark, sf).lineitem, "l_extendedprice", "l_quantity", "l_discount", 4)
    return _r(out, ["mean_target"], 9)


@register("d7_linear_trend", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(corr(l_quantity, l_extendedprice), 9) AS r, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2,
       regr_count(l_extendedprice, l_quantity)::bigint AS n
FROM lineitem
""")
def d7(spark, sf):
    out = D.linear_trend(Tables(spark, sf).lineitem, "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("r", 9).alias("r"), F.round("r2", 9).alias("r2"), "n")


@register("d8_period_series", """
SELECT ts::date::varchar AS day, count(*) AS n, 'past' AS source,
       CASE WHEN ts::date < DATE '2024-01-15' THEN 'before_cut' ELSE 'after_cut' END AS period
FROM events WHERE event_type = 'purchase' GROUP BY ts::date
UNION ALL
SELECT ts::date::varchar, count(*), 'future',
       CASE WHEN ts::date < DATE '2024-01-15' THEN 'before_cut' ELSE 'after_cut' END
FROM events WHERE event_type = 'view' GROUP BY ts::date
""")
def d8(spark, sf):
    ev = Tables(spark, sf).events
    out = D.period_series(ev.where(F.col("event_type") == "purchase"), ev.where(F.col("event_type") == "view"),
                          "ts", "2024-01-15")
    return out.withColumn("day", F.col("day").cast("string"))


@register("d9_density", """
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h,
                  count(*) AS n FROM orders),
     g AS (SELECT unnest(range(0, 16))::int AS point),
     gp AS (SELECT point, lo + point * (hi - lo) / 15.0 AS x, h, n FROM g CROSS JOIN s)
SELECT point, round(x, 6) AS x, round(sum(exp(-pow((x - o_totalprice) / h, 2) / 2.0)) / (n * h * sqrt(2 * pi())), 14) AS density
FROM gp CROSS JOIN orders GROUP BY point, x, h, n
""")
def d9(spark, sf):
    out = D.density(Tables(spark, sf).orders, "o_totalprice", 16)
    return _r(_r(out, ["x"]), ["density"], 14)
