"""Catalog entries: scalar functions."""

from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.plans.catalog.registry import Tables, register

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _fmt(c):
    return F.date_format(c, TS_FMT)


@register("f1_epoch_to_ts", """
SELECT event_id, floor(epoch_us(ts) / 1000000)::bigint AS epoch_s,
       strftime(make_timestamp(floor(epoch_us(ts) / 1000000)::bigint * 1000000), '%Y-%m-%d %H:%M:%S') AS ts_from_epoch
FROM events
""")
def f1(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch_s"))
    return ev.select("event_id", "epoch_s", _fmt(S.epoch_to_ts("epoch_s")).alias("ts_from_epoch"))


@register("f2_parse_date", """
SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')::date::varchar AS parsed,
       try_strptime(o_orderpriority, '%Y-%m-%d')::date::varchar AS bad_parse
FROM orders
""")
def f2(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey",
                    S.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd").cast("string").alias("parsed"),
                    S.parse_date("o_orderpriority", "yyyy-MM-dd").cast("string").alias("bad_parse"))


@register("f3_date_parts", """
SELECT event_id, ts::date::varchar AS ts_date, year(ts)::int AS ts_year, month(ts)::int AS ts_month,
       (isodow(ts) - 1)::int AS ts_weekday, hour(ts)::int AS ts_hour
FROM events
""")
def f3(spark, sf):
    ev = S.date_parts(Tables(spark, sf).events, "ts")
    return ev.select("event_id", F.col("ts_date").cast("string").alias("ts_date"), "ts_year", "ts_month",
                     "ts_weekday", "ts_hour")


@register("f4_calendar_flags", """
SELECT event_id, (isodow(ts) IN (6, 7))::int AS ts_is_weekend,
       (ts::date IN (DATE '2024-01-01', DATE '2024-01-15'))::int AS ts_is_holiday
FROM events
""")
def f4(spark, sf):
    ev = S.calendar_flags(Tables(spark, sf).events, "ts", ["2024-01-01", "2024-01-15"])
    return ev.select("event_id", "ts_is_weekend", "ts_is_holiday")


@register("f5_week_of_month", """
SELECT o_orderkey, ceil((day(o_orderdate) + isodow(date_trunc('month', o_orderdate)) - 1) / 7.0)::int AS wom
FROM orders
""")
def f5(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", S.week_of_month("o_orderdate").alias("wom"))


@register("f6_to_local", """
SELECT event_id, strftime(timezone('US/Pacific', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS local_ts FROM events
""")
def f6(spark, sf):
    ev = Tables(spark, sf).events
    return ev.select("event_id", _fmt(S.to_local("ts", "US/Pacific")).alias("local_ts"))


@register("f7_elapsed", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
       (epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 1000000.0 AS elapsed_s,
       floor((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000.0)::bigint AS elapsed_d
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")
def f7(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    S.elapsed_seconds("l_shipdate", "o_orderdate").alias("elapsed_s"),
                    S.elapsed_days("l_shipdate", "o_orderdate").alias("elapsed_d"))


@register("f8_shift_months", """
SELECT o_orderkey, (o_orderdate::date + INTERVAL 12 MONTH)::date::varchar AS plus_12,
       (o_orderdate::date - INTERVAL 1 MONTH)::date::varchar AS minus_1
FROM orders
""")
def f8(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", S.shift_months("o_orderdate", 12).cast("string").alias("plus_12"),
                    S.shift_months("o_orderdate", -1).cast("string").alias("minus_1"))


@register("f9_age", """
SELECT o_orderkey, trunc(datediff('day', o_orderdate::date, DATE '2017-01-01') / 365)::int AS age_days365,
       round(datediff('day', o_orderdate::date, DATE '2017-01-01') / 365.25, 6) AS age_365_25,
       (2017 - year(o_orderdate))::int AS age_year_diff
FROM orders
""")
def f9(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", S.age("o_orderdate", "2017-01-01", "days365").alias("age_days365"),
                    F.round(S.age("o_orderdate", "2017-01-01", "years365_25"), 6).alias("age_365_25"),
                    S.age("o_orderdate", "2017-01-01", "year_diff").alias("age_year_diff"))


@register("f10_text_part", """
SELECT p_partkey, split_part(p_name, ' ', 2) AS second_word, substr(p_type, 1, 3) AS type_prefix,
       trim(concat('  ', p_brand, ' ')) AS brand_trim,
       TRY_CAST(trim(split_part(concat(p_size::varchar, '/5'), '/', 1)) AS DOUBLE) AS size_lead,
       TRY_CAST(trim(split_part(p_name, '/', 1)) AS DOUBLE) AS name_lead
FROM part
""")
def f10(spark, sf):
    p = Tables(spark, sf).part
    return p.select("p_partkey", S.text_part("p_name", " ", 2).alias("second_word"),
                    F.substring("p_type", 1, 3).alias("type_prefix"),
                    F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("brand_trim"),
                    S.leading_number(F.concat(F.col("p_size").cast("string"), F.lit("/5"))).alias("size_lead"),
                    S.leading_number("p_name").alias("name_lead"))


@register("f11_concat_key", """
SELECT c_custkey, c_nationkey::varchar || '_' || c_mktsegment AS nation_segment FROM customer
""")
def f11(spark, sf):
    c = Tables(spark, sf).customer
    return c.select("c_custkey", S.concat_key(["c_nationkey", "c_mktsegment"], "_").alias("nation_segment"))


@register("f12_log_features", """
SELECT o_orderkey, round(ln(o_totalprice), 9) AS o_totalprice_log, round(ln(1 + o_totalprice), 9) AS o_totalprice_log1p,
       round(exp(o_totalprice / 1000000.0), 9) AS scaled_exp
FROM orders
""")
def f12(spark, sf):
    o = Tables(spark, sf).orders.withColumn("scaled", F.col("o_totalprice") / 1_000_000.0)
    o = S.log_features(o, ["o_totalprice"], "log")
    o = S.log_features(o, ["o_totalprice"], "log1p")
    o = S.log_features(o, ["scaled"], "exp")
    return o.select("o_orderkey", F.round("o_totalprice_log", 9).alias("o_totalprice_log"),
                    F.round("o_totalprice_log1p", 9).alias("o_totalprice_log1p"),
                    F.round("scaled_exp", 9).alias("scaled_exp"))


@register("f13_clamp_round", """
SELECT c_custkey, round(greatest(c_acctbal, 0.0), 1) AS acctbal_floor0 FROM customer
""")
def f13(spark, sf):
    c = Tables(spark, sf).customer
    return c.select("c_custkey", S.clamp_round("c_acctbal", 0.0, 1).alias("acctbal_floor0"))


_F14_FAMILIES = ["Claims", "Coverage", "Claims_Coverage", "Demographic", "MedicalCodeCounter", "DiseaseTagCounter",
                 "CrossCodeCounter", "LabInterpreter", "Summary", "Other"]


@register("f14_display_names", f"""
WITH n AS (SELECT p_partkey, concat({_F14_FAMILIES}[p_partkey % 10 + 1], '|x|n_', p_brand, '_c-', p_size::varchar) AS feature FROM part),
     d AS (SELECT DISTINCT lower(p_brand) AS short, p_size::varchar AS code, 'size ' || p_size::varchar AS name FROM part WHERE p_size <= 25),
     f AS (SELECT p_partkey, feature, split_part(feature, '|', 1) AS family, split_part(feature, '|', 3) AS tail FROM n),
     g AS (SELECT *, split_part(tail, '_', 2) AS system, split_part(tail, '-', 2) AS code FROM f)
SELECT p_partkey, feature,
       CASE WHEN family IN ('Claims', 'Coverage', 'Claims_Coverage', 'Demographic') THEN tail
            WHEN family = 'MedicalCodeCounter' THEN system || '|' || g.code
            WHEN family = 'DiseaseTagCounter' THEN system
            WHEN family = 'CrossCodeCounter' THEN coalesce(system || '|' || d.name, feature)
            WHEN family = 'LabInterpreter' THEN family || '|' || tail ELSE feature END AS display
FROM g LEFT JOIN d ON family = 'CrossCodeCounter' AND lower(system) = short AND g.code = d.code
WHERE family <> 'Summary'
""")
def f14_display(spark, sf):
    part = Tables(spark, sf).part
    families = F.array(*[F.lit(x) for x in _F14_FAMILIES])
    names = part.select("p_partkey", F.concat(families[(F.col("p_partkey") % 10).cast("int")], F.lit("|x|n_"), "p_brand", F.lit("_c-"),
                                              F.col("p_size").cast("string")).alias("feature"))
    short, url = F.lower("p_brand"), F.concat(F.lit("url:"), F.lower("p_brand"))
    systems = part.select(short.alias("short"), url.alias("url")).distinct()
    codes = part.where("p_size <= 25").select(url.alias("url"), F.col("p_size").alias("code"),
                                              F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("name")).distinct()
    return S.display_names(names, "feature", codes, systems)


@register("f14_normalize_feature_name", """
WITH n AS (SELECT p_partkey, concat(p_type, '.', p_brand, '.', p_size::varchar) AS feature FROM part)
SELECT p_partkey, feature,
       CASE WHEN split_part(feature, '.', 1) = 'ECONOMY' THEN array_to_string(string_split(feature, '.')[1:2], '.')
            WHEN split_part(feature, '.', 1) = 'LARGE' THEN array_to_string(string_split(feature, '.')[1:3], '.')
            ELSE split_part(feature, '.', 1) END AS display
FROM n
""")
def f14(spark, sf):
    p = Tables(spark, sf).part.select(
        "p_partkey", F.concat_ws(".", "p_type", "p_brand", F.col("p_size").cast("string")).alias("feature"))
    return p.select("p_partkey", "feature",
                    S.normalize_feature_name("feature", ".", {"ECONOMY": 2, "LARGE": 3}, 1).alias("display"))
