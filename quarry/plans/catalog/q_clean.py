"""Catalog entries: projection, filter, cleaning."""

from pyspark.sql import functions as F

from quarry.operators import clean as R
from quarry.plans.catalog.q_profile import DOCS_LABELS_SQL, _docs_labels
from quarry.plans.catalog.registry import Tables, register


@register("r1_project", "SELECT o_orderkey, o_custkey, o_totalprice AS total FROM orders")
def r1(spark, sf):
    o = Tables(spark, sf).orders
    return R.project(o, keep=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"],
                     drop=["o_orderstatus"], rename={"o_totalprice": "total"})


@register("r2_where", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE (l_quantity BETWEEN 10 AND 20 AND year(l_shipdate) = 1998 AND NOT (l_returnflag = 'N')) OR l_discount IS NULL
""")
def r2(spark, sf):
    li = Tables(spark, sf).lineitem
    pred = ((F.col("l_quantity").between(10, 20) & (F.year("l_shipdate") == 1998) & ~(F.col("l_returnflag") == "N"))
            | F.col("l_discount").isNull())
    return R.where(li, pred).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@register("r3_drop_nulls", f"SELECT doc_id, quality, toxic FROM {DOCS_LABELS_SQL} WHERE quality IS NOT NULL")
def r3(spark, sf):
    return R.drop_nulls(_docs_labels(Tables(spark, sf)), subset=["quality"]).select("doc_id", "quality", "toxic")


@register("r4_dedup", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def r4(spark, sf):
    return R.dedup(Tables(spark, sf).lineitem.select("l_returnflag", "l_linestatus", "l_tax"))


@register("r5_keep_one_first", """
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type, value, props) AS rn FROM events)
WHERE rn = 1
""")
def r5(spark, sf):
    ev = Tables(spark, sf).events
    return R.keep_one(ev, ["user_id"], ["ts"], "first").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_id", "event_type", "value")


@register("r5_keep_one_last", """
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC,
                               value DESC, props DESC) AS rn FROM events)
WHERE rn = 1
""")
def r5b(spark, sf):
    ev = Tables(spark, sf).events
    return R.keep_one(ev, ["user_id"], ["ts"], "last").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_id", "event_type", "value")


@register("r6_keep_group_min", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
WHERE o_totalprice = (SELECT min(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
""")
def r6(spark, sf):
    o = Tables(spark, sf).orders
    return R.keep_group_min(o, "o_custkey", "o_totalprice").select("o_orderkey", "o_custkey", "o_totalprice")


@register("r7_case_column", """
SELECT event_id, CASE WHEN value >= 100 THEN 'high' WHEN value >= 10 THEN 'mid' ELSE 'low' END AS value_band
FROM events
""")
def r7(spark, sf):
    ev = Tables(spark, sf).events
    return R.case_column(ev, "value_band", [(F.col("value") >= 100, "high"), (F.col("value") >= 10, "mid")],
                         "low").select("event_id", "value_band")


@register("r8_coerce", """
SELECT p_partkey, TRY_CAST(p_size::varchar AS INTEGER) AS size_num,
       TRY_CAST(split_part(p_name, ' ', 1) AS DOUBLE) AS first_word_num,
       TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand_num
FROM part
""")
def r8(spark, sf):
    p = Tables(spark, sf).part.select(
        "p_partkey", F.col("p_size").cast("string").alias("size_num"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word_num"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand_num"))
    return R.coerce(p, {"size_num": "int", "first_word_num": "double", "brand_num": "bigint"})


@register("r9_map_values", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE NULL END AS status_code FROM orders
""")
def r9(spark, sf):
    o = Tables(spark, sf).orders
    return R.map_values(o, "o_orderstatus", {"F": 1, "O": 0}, out="status_code").select("o_orderkey", "status_code")


@register("r10_ordinal_encode", """
WITH firsts AS (SELECT o_orderpriority, min(o_orderdate) AS f FROM orders GROUP BY o_orderpriority),
     codes AS (SELECT o_orderpriority, (dense_rank() OVER (ORDER BY f, o_orderpriority) - 1)::int AS o_orderpriority_code
               FROM firsts)
SELECT o.o_orderkey, o.o_orderpriority, c.o_orderpriority_code FROM orders o JOIN codes c USING (o_orderpriority)
""")
def r10(spark, sf):
    o = Tables(spark, sf).orders
    return R.ordinal_encode(o, "o_orderpriority", "o_orderdate").select("o_orderkey", "o_orderpriority",
                                                                       "o_orderpriority_code")


@register("r11_fill_missing", f"""
SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, coalesce(lang, 'missing') AS lang
FROM {DOCS_LABELS_SQL}
""")
def r11(spark, sf):
    return R.fill_missing(_docs_labels(Tables(spark, sf))).select("doc_id", "quality", "toxic", "lang")


@register("r12_recode_sentinels", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -2 ELSE coalesce(c_acctbal, -1) END AS c_acctbal FROM customer
""")
def r12(spark, sf):
    c = Tables(spark, sf).customer
    return R.recode_sentinels(c, ["c_acctbal"]).select("c_custkey", "c_acctbal")


@register("r13_guarded_ratio", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity > 49 THEN -1 ELSE coalesce(round(l_tax / nullif(l_discount, 0), 6), -1) END AS tax_per_discount
FROM lineitem
""")
def r13(spark, sf):
    li = Tables(spark, sf).lineitem
    out = R.guarded_ratio(li, "l_tax", "l_discount", "tax_per_discount", -1.0, guards=[F.col("l_quantity") > 49])
    return out.select("l_orderkey", "l_linenumber", F.round("tax_per_discount", 6).alias("tax_per_discount"))


_MODE_TOXIC = "(SELECT toxic FROM labels GROUP BY toxic ORDER BY count(*) DESC, toxic ASC LIMIT 1)"


@register("r14_fill_statistic", f"""
SELECT doc_id, coalesce(quality::double, (SELECT quantile_cont(quality, 0.5) FROM labels)) AS quality,
       coalesce(toxic, {_MODE_TOXIC}) AS toxic
FROM {DOCS_LABELS_SQL}
""")
def r14(spark, sf):
    return R.fill_statistic(_docs_labels(Tables(spark, sf)), {"quality": "median", "toxic": "mode"}).select(
        "doc_id", "quality", "toxic")


@register("r15_fill_group_statistic", f"""
WITH d AS {DOCS_LABELS_SQL},
     med AS (SELECT source, quantile_cont(quality, 0.5) AS mq FROM d WHERE quality IS NOT NULL GROUP BY source),
     cnt AS (SELECT source, toxic, count(*) AS n FROM d WHERE toxic IS NOT NULL GROUP BY source, toxic),
     md AS (SELECT source, toxic AS mt FROM (
              SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, toxic ASC) AS rn FROM cnt) WHERE rn = 1)
SELECT d.doc_id, d.source, coalesce(d.quality::double, med.mq) AS quality, coalesce(d.toxic, md.mt) AS toxic
FROM d LEFT JOIN med ON d.source = med.source LEFT JOIN md ON d.source = md.source
""")
def r15(spark, sf):
    return R.fill_group_statistic(_docs_labels(Tables(spark, sf)), "source",
                                  {"quality": "median", "toxic": "mode"}).select("doc_id", "source", "quality", "toxic")


@register("r16_top_k", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def r16(spark, sf):
    o = Tables(spark, sf).orders
    return R.top_k(o, [F.col("o_totalprice").desc(), "o_orderkey"], 10).select("o_orderkey", "o_custkey", "o_totalprice")


_HASH = "('0x' || substr(md5({k}::varchar), 1, 8))::bigint"


@register("r17_sample_fraction", f"""
SELECT o_orderkey, o_totalprice FROM orders WHERE ({_HASH.format(k='o_orderkey')} < 0.1 * 4294967296)
""")
def r17(spark, sf):
    return R.sample_rows(Tables(spark, sf).orders, "o_orderkey", frac=0.1).select("o_orderkey", "o_totalprice")


@register("r17_sample_count", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey LIMIT 500
""")
def r17b(spark, sf):
    return R.sample_rows(Tables(spark, sf).orders, "o_orderkey", n=500).select("o_orderkey", "o_totalprice")
