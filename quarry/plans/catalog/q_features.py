"""Catalog entries: feature engineering (M1-M6, M8, M9)."""

from pyspark.sql import functions as F

from quarry.operators import features as M
from quarry.plans.catalog.registry import Tables, register


def _r(df, cols, d=9):
    return df.withColumns({c: F.round(c, d) for c in cols})


def _fit_apply(t):
    o = t.orders
    return o.where(F.year("o_orderdate") < 1998), o.where(F.year("o_orderdate") >= 1998)


@register("m1_one_hot", """
WITH fit AS (SELECT * FROM orders WHERE year(o_orderdate) < 1998), ap AS (SELECT * FROM orders WHERE year(o_orderdate) >= 1998)
SELECT o_orderkey, 'o_orderpriority=' || o_orderpriority AS feature, 1.0::double AS value FROM ap
WHERE o_orderpriority IN (SELECT o_orderpriority FROM fit)
UNION ALL
SELECT o_orderkey, 'o_orderstatus=' || o_orderstatus, 1.0::double FROM ap WHERE o_orderstatus IN (SELECT o_orderstatus FROM fit)
""")
def m1(spark, sf):
    fit, ap = _fit_apply(Tables(spark, sf))
    return M.one_hot(fit, ap, "o_orderkey", ["o_orderpriority", "o_orderstatus"])


@register("m2_binary_encode", """
WITH f AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1),
     c AS (SELECT p_brand, dense_rank() OVER (ORDER BY first, p_brand) AS code FROM f),
     nb AS (SELECT greatest(ceil(log2(count(*) + 1))::int, 1) AS nbits FROM f)
SELECT p.p_partkey, b.bit::int AS bit, ((c.code >> b.bit) & 1)::int AS value
FROM part p JOIN c USING (p_brand) CROSS JOIN nb CROSS JOIN LATERAL (SELECT unnest(range(0, nb.nbits)) AS bit) b
""")
def m2(spark, sf):
    return M.binary_encode(Tables(spark, sf).part, "p_partkey", "p_brand", "p_partkey")


_M3_COLS = ["o_orderstatus", "o_orderpriority", "o_totalprice"]


@register("m3_vectorize_apply_vocabulary", """
WITH longf AS (
  SELECT o_orderkey, year(o_orderdate) AS y, 'o_orderstatus=' || o_orderstatus AS feature, 1.0::double AS value FROM orders
  UNION ALL SELECT o_orderkey, year(o_orderdate), 'o_orderpriority=' || o_orderpriority, 1.0::double FROM orders
  UNION ALL SELECT o_orderkey, year(o_orderdate), 'o_totalprice', o_totalprice FROM orders),
     vocab AS (SELECT feature, (row_number() OVER (ORDER BY feature) - 1)::int AS index
               FROM (SELECT DISTINCT feature FROM longf WHERE y < 1998))
SELECT o_orderkey, feature, value, index FROM longf JOIN vocab USING (feature) WHERE y >= 1998
""")
def m3(spark, sf):
    fit, ap = _fit_apply(Tables(spark, sf))
    vocab = M.feature_vocabulary(M.vectorize(fit, "o_orderkey", _M3_COLS))
    return M.apply_vocabulary(M.vectorize(ap, "o_orderkey", _M3_COLS), vocab).select(
        "o_orderkey", "feature", "value", "index")


@register("m3_sparse_vectors", """
WITH longf AS (
  SELECT o_orderkey, year(o_orderdate) AS y, 'o_orderstatus=' || o_orderstatus AS feature, 1.0::double AS value FROM orders
  UNION ALL SELECT o_orderkey, year(o_orderdate), 'o_orderpriority=' || o_orderpriority, 1.0::double FROM orders
  UNION ALL SELECT o_orderkey, year(o_orderdate), 'clerk=' || o_custkey, 1.0::double FROM orders
  UNION ALL SELECT o_orderkey, year(o_orderdate), 'o_totalprice', o_totalprice FROM orders),
     vocab AS (SELECT feature, (row_number() OVER (ORDER BY feature) - 1)::int AS index
               FROM (SELECT DISTINCT feature FROM longf WHERE y < 1998))
SELECT o_orderkey, (SELECT count(*) FROM vocab)::int AS size, index, sum(value) AS value
FROM longf JOIN vocab USING (feature) WHERE y >= 1998 GROUP BY o_orderkey, index HAVING sum(value) <> 0
""")
def m3_sparse(spark, sf):
    fit, ap = (d.withColumn("clerk", F.col("o_custkey").cast("string")) for d in _fit_apply(Tables(spark, sf)))
    cols = [*_M3_COLS, "clerk"]
    vocab = M.feature_vocabulary(M.vectorize(fit, "o_orderkey", cols))
    rows = M.sparse_rows(M.vectorize(ap, "o_orderkey", cols), vocab, "o_orderkey")
    cells = rows.select("o_orderkey", "size", F.explode(F.arrays_zip("indices", "values")).alias("c"))
    return cells.select("o_orderkey", "size", F.col("c.indices").alias("index"), F.col("c.values").alias("value"))


@register("m4_lump_top_n", """
WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand ASC LIMIT 10)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'other' END AS brand_lumped FROM part
""")
def m4(spark, sf):
    return M.lump_top_n(Tables(spark, sf).part, "p_brand", 10, "other", "brand_lumped").select("p_partkey", "brand_lumped")


@register("m5_standardize", """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                  stddev_pop(l_extendedprice) AS sp FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 9) AS l_quantity_z,
       round((l_extendedprice - mp) / sp, 9) AS l_extendedprice_z
FROM lineitem, s
""")
def m5(spark, sf):
    li = Tables(spark, sf).lineitem
    out = M.standardize(li.where(F.col("l_returnflag") != "R"), li, ["l_quantity", "l_extendedprice"])
    return _r(out.select("l_orderkey", "l_linenumber", "l_quantity_z", "l_extendedprice_z"),
              ["l_quantity_z", "l_extendedprice_z"])


_M6_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_M6_SQL = """
WITH long AS (UNPIVOT (SELECT l_returnflag, l_quantity::double AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
              ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE x),
     per AS (SELECT feature, l_returnflag, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2),
     g AS (SELECT feature, sum(n) AS n_total, count(*) AS k_classes, sum(n * m) / sum(n) AS gm FROM per GROUP BY 1),
     f AS (SELECT feature, (sum(n * pow(m - gm, 2)) / (max(k_classes) - 1)) / (sum(n * v) / (max(n_total) - max(k_classes)))
                  AS f_score
           FROM per JOIN g USING (feature) GROUP BY 1)
"""


@register("m6_anova_f", _M6_SQL + "SELECT feature, round(f_score, 6) AS f_score FROM f")
def m6(spark, sf):
    return _r(M.anova_f(Tables(spark, sf).lineitem, _M6_FEATS, "l_returnflag"), ["f_score"], 6)


@register("m6_select_k_best", _M6_SQL + "SELECT feature, round(f_score, 6) AS f_score FROM f ORDER BY f_score DESC, feature LIMIT 2")
def m6b(spark, sf):
    scores = M.anova_f(Tables(spark, sf).lineitem, _M6_FEATS, "l_returnflag")
    return _r(M.select_k_best(scores, 2), ["f_score"], 6)


_H = "('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint"


@register("m8_split", f"""
SELECT o_orderkey, CASE WHEN {_H} < 0.2 * 4294967296 THEN 'test' ELSE 'train' END AS split FROM orders
""")
def m8(spark, sf):
    return M.split(Tables(spark, sf).orders, "o_orderkey", 20).select("o_orderkey", "split")


@register("m8_split_stratified", f"""
SELECT o_orderkey, o_orderpriority,
       CASE WHEN percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY {_H}) < 0.2 THEN 'test' ELSE 'train' END AS split
FROM orders
""")
def m8b(spark, sf):
    out = M.split(Tables(spark, sf).orders, "o_orderkey", 20, strata="o_orderpriority")
    return out.select("o_orderkey", "o_orderpriority", "split")


@register("m9_class_weights", """
SELECT l_returnflag, count(*) AS n_c,
       round((SELECT count(*) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)), 9) AS weight
FROM lineitem GROUP BY 1
""")
def m9(spark, sf):
    return _r(M.class_weights(Tables(spark, sf).lineitem, "l_returnflag"), ["weight"])
