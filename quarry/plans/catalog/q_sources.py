"""Catalog entries: sources and sinks (S1-S8) as write/read round trips.

Each entry writes a whole test table with the sink under test into a fresh
folder below the shared checkpoint directory, reads it back with the source
under test, and returns the result; the oracle is the original table.
"""

from pyspark.sql import functions as F

from quarry.plans.catalog.registry import Tables, register
from quarry.sources import io as S

CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@register("s1_csv_round_trip", "SELECT * FROM customer")
def s1(spark, sf):
    path = S.scratch_path(spark, "customer_csv")
    S.write_csv(Tables(spark, sf).customer, path)
    return S.read_csv(spark, path, CUSTOMER_SCHEMA)


@register("s1_csv_pipe_separator", "SELECT * FROM customer")
def s1b(spark, sf):
    path = S.scratch_path(spark, "customer_psv")
    Tables(spark, sf).customer.write.mode("overwrite").option("header", True).option("sep", "|").csv(path)
    return S.read_csv(spark, path, CUSTOMER_SCHEMA, sep="|")


@register("s2_jsonl_nested_round_trip", """
SELECT event_id, user_id, json_extract_string(props, '$.k')::bigint AS k FROM events
""")
def s2(spark, sf):
    path = S.scratch_path(spark, "events_jsonl")
    ev = Tables(spark, sf).events.select("event_id", "user_id",
                                        F.from_json("props", "map<string,bigint>").alias("props"))
    S.write_json(ev, path)
    back = S.read_jsonl(spark, path, "event_id bigint, user_id bigint, props map<string,bigint>")
    return back.select("event_id", "user_id", F.col("props")["k"].alias("k"))


@register("s3_json_document_round_trip", "SELECT * FROM region")
def s3(spark, sf):
    path = S.scratch_path(spark, "region_doc")
    S.write_json_document(Tables(spark, sf).region, path)
    return S.read_json_document(spark, path, "r_regionkey int, r_name string")


@register("s4_read_table_repartitioned", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s4(spark, sf):
    df = S.read_table(spark, f"{sf}/orders.parquet", "parquet", partitions=8, key="o_custkey")
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


@register("s5_csv_write_modes", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def s5(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus")
    path = S.scratch_path(spark, "orders_csv")
    S.write_csv(o.where(F.col("o_orderstatus") == "O"), path, files=2)
    S.write_csv(o.where(F.col("o_orderstatus") == "F"), path, files=2, mode="overwrite")
    S.write_csv(o.where(F.col("o_orderstatus") == "P"), path, mode="ignore")  # output exists: skipped
    return S.read_csv(spark, path, "o_orderkey bigint, o_orderstatus string")


@register("s6_json_round_trip", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
""")
def s6(spark, sf):
    path = S.scratch_path(spark, "lineitem_json")
    S.write_json(Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path)
    return S.read_jsonl(spark, path, "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string")


@register("s7_feature_store_round_trip", """
WITH f AS (SELECT o.o_custkey AS row_id, p.p_type AS feature, sum(l.l_quantity) AS value
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
           GROUP BY 1, 2),
     v AS (SELECT feature, (dense_rank() OVER (ORDER BY feature) - 1)::int AS index FROM (SELECT DISTINCT feature FROM f))
SELECT row_id, feature, value, index FROM f JOIN v USING (feature)
""")
def s7(spark, sf):
    t = Tables(spark, sf)
    f = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
         .groupBy(F.col("o_custkey").alias("row_id"), F.col("p_type").alias("feature"))
         .agg(F.sum("l_quantity").alias("value")))
    path = S.scratch_path(spark, "features")
    S.write_features(f, path)
    values, vocab = S.read_features(spark, path)
    return values.join(vocab, "feature").select("row_id", "feature", "value", "index")


@register("s8_model_save_load")
def s8(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                           (F.col("l_returnflag") == "R").cast("double").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features"),
                             LogisticRegression(maxIter=10)]).fit(li)
    path = S.scratch_path(spark, "model")
    S.save_model(model, path)
    loaded = S.load_model(path)
    return loaded.transform(li).select("l_orderkey", "l_linenumber", "prediction")


PATIENT_SCHEMA = ("user_id bigint, observations map<string,array<struct<code:string,interpretation:string,"
                  "value:double>>>")


@register("s2_jsonl_patient_records", """
SELECT user_id, ts::date::varchar AS event_date, event_type AS code, count(*) AS n
FROM events GROUP BY 1, 2, 3
""")
def s2b(spark, sf):
    """Nested dated records (date -> list of {code, interpretation, value}) as
    JSON lines, read back with an explicit schema and unnested (S2 + W3)."""
    from quarry.operators.aggregates import explode_events
    ev = Tables(spark, sf).events
    rec = ev.select("user_id", F.create_map(F.to_date("ts").cast("string"), F.array(F.struct(
        F.col("event_type").alias("code"),
        F.when(F.col("value") >= 100, "H").alias("interpretation"),
        F.col("value").alias("value")))).alias("observations"))
    path = S.scratch_path(spark, "patients_jsonl")
    S.write_json(rec, path)
    back = S.read_jsonl(spark, path, PATIENT_SCHEMA)
    flat = explode_events(back, "user_id", "observations", None, "event_date", "obs")
    return flat.groupBy("user_id", F.col("event_date").cast("string").alias("event_date"),
                        F.col("obs.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
