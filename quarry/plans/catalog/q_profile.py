"""Catalog entries: profiling and data quality."""

from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.plans.catalog.registry import Tables, register

ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
DOC_LABEL_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
CARD_COLS = ["p_brand", "p_type", "p_size"]


def _docs_labels(t: Tables):
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


DOCS_LABELS_SQL = ("(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                   "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


@register("p1_profile_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS position, '{ty}' AS data_type, count({c}) AS non_null, count(*) AS rows "
    f"FROM orders" for i, (c, ty) in enumerate(ORDERS_COLS)))
def p1(spark, sf):
    return P.profile_columns(Tables(spark, sf).orders)


@register("p2_null_rates", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS null_pct FROM {DOCS_LABELS_SQL}"
    for c in DOC_LABEL_COLS))
def p2(spark, sf):
    return P.null_rates(_docs_labels(Tables(spark, sf))).withColumn("null_pct", F.round("null_pct", 6))


@register("p2_null_rates_only_missing", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS null_pct FROM {DOCS_LABELS_SQL}) "
    f"WHERE null_count > 0" for c in DOC_LABEL_COLS))
def p2b(spark, sf):
    return P.null_rates(_docs_labels(Tables(spark, sf)), only_missing=True).withColumn("null_pct", F.round("null_pct", 6))


@register("p3_describe_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"min({c})::double AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, max({c})::double AS max FROM lineitem" for c in DESCRIBE_COLS))
def p3(spark, sf):
    out = P.describe_numeric(Tables(spark, sf).lineitem, DESCRIBE_COLS)
    return out.withColumns({c: F.round(c, 6) for c in ["mean", "std", "p25", "p50", "p75"]})


@register("p4_cardinality", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}::varchar) AS n_distinct, "
    f"(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c}::varchar AS v FROM part ORDER BY v LIMIT 10)) "
    f"AS first_values FROM part" for c in CARD_COLS))
def p4(spark, sf):
    return P.cardinality(Tables(spark, sf).part, CARD_COLS, 10)


@register("p5_value_range", """
SELECT 'orders.o_orderdate' AS name, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_value,
       strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_value FROM orders
UNION ALL
SELECT 'events.ts', strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events
""")
def p5(spark, sf):
    t = Tables(spark, sf)
    return P.value_range({"orders.o_orderdate": (t.orders, "o_orderdate"), "events.ts": (t.events, "ts")})


@register("p6_fd_violations", """
SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY l_partkey
HAVING count(DISTINCT l_suppkey) > 1
""")
def p6(spark, sf):
    return P.fd_violations(Tables(spark, sf).lineitem, "l_partkey", "l_suppkey")


@register("p7_duplicate_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, dup_count FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dup_count FROM lineitem) WHERE dup_count > 1
""")
def p7(spark, sf):
    out = P.duplicate_rows(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "dup_count")


@register("p8_column_mismatch", """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'F' ELSE 'O' END AS derived_status
FROM orders
WHERE o_orderstatus IS DISTINCT FROM (CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'F' ELSE 'O' END)
""")
def p8(spark, sf):
    o = Tables(spark, sf).orders.withColumn(
        "derived_status", F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "F").otherwise("O"))
    return P.column_mismatch(o, "o_orderstatus", "derived_status").select("o_orderkey", "o_orderstatus", "derived_status")


@register("p9_rule_violations", """
SELECT 'negative_balance' AS rule, count(*) FILTER (WHERE c_acctbal < 0) AS violations FROM customer
UNION ALL SELECT 'nation_out_of_range', count(*) FILTER (WHERE c_nationkey < 0 OR c_nationkey > 24) FROM customer
UNION ALL SELECT 'blank_name', count(*) FILTER (WHERE trim(c_name) = '') FROM customer
""")
def p9(spark, sf):
    c = Tables(spark, sf).customer
    return P.rule_violations(c, {
        "negative_balance": F.col("c_acctbal") < 0,
        "nation_out_of_range": (F.col("c_nationkey") < 0) | (F.col("c_nationkey") > 24),
        "blank_name": F.trim("c_name") == "",
    })


@register("p10_code_dictionary", """
WITH codes AS (
  SELECT DISTINCT split_part(code, ':', 1) AS system, code FROM (
    SELECT unnest([concat('type:', p_type), concat('brand:', p_brand)]) AS code FROM part))
SELECT system, code, count(*) OVER (PARTITION BY system) AS n_codes FROM codes
""")
def p10(spark, sf):
    p = Tables(spark, sf).part.select(F.array(F.concat(F.lit("type:"), "p_type"),
                                              F.concat(F.lit("brand:"), "p_brand")).alias("codes"))
    return P.code_dictionary(p, "codes", sep=":", is_array=True)
