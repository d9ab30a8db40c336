"""Catalog entries: business questions."""

from pyspark.sql import functions as F

from quarry.plans import questions as B
from quarry.plans.catalog.registry import Tables, register
from quarry.session import dealt

# events stand-ins: view = ad exposure, signup = install, purchase = checkout;
# user_id is both uid and device_id; value >= 100 is a direct purchase.


def _funnel_inputs(t: Tables):
    ev = t.events.select("user_id", "ts", "event_type", "value", "event_id")
    exposures = ev.where(F.col("event_type") == "view").select(F.col("user_id").alias("uid"), F.col("ts").alias("ad_ts"))
    installs = ev.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("uid"), F.col("user_id").alias("device_id"), F.col("ts").alias("install_ts"))
    checkouts = ev.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("device_id"), F.col("ts").alias("ck_ts"), "value", "event_id")
    return exposures, installs, checkouts


@register("b1_funnel", """
WITH ex AS (SELECT user_id FROM events WHERE event_type = 'view'),
     dev AS (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM ex)),
     ck AS (SELECT * FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM dev))
SELECT (SELECT count(*) FROM ex) AS exposures, count(*) AS checkouts,
       count(*) FILTER (WHERE value >= 100 OR value < 100 AND event_id % 2 = 1) AS acquired,
       round(count(*) FILTER (WHERE value >= 100 OR value < 100 AND event_id % 2 = 1) * 100.0 / (SELECT count(*) FROM ex), 4) AS conversion_pct
FROM ck
""")
def b1_funnel(spark, sf):
    """Acquired: a direct purchase (value >= 100), or a trial that converted (an odd event_id stands for it)."""
    exposures, installs, checkouts = _funnel_inputs(Tables(spark, sf))
    status = F.when(F.col("value") >= 100, "direct_purchase").when(F.col("value") < 100, "trial_started")
    acquired = F.coalesce((status == "direct_purchase") | ((status == "trial_started") & (F.col("event_id") % 2 == 1)), F.lit(False))
    return B.funnel(exposures, installs, checkouts, acquired=acquired.cast("int"))


@register("b2_time_to_acquisition", """
WITH first_exp AS (SELECT user_id, min(ts) AS ad_ts FROM events WHERE event_type = 'view' GROUP BY user_id),
     pairs AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'),
     acq AS (
       SELECT e.ts AS ck_ts, f.ad_ts, CASE WHEN e.value >= 100 THEN 'direct' ELSE 'through_trial' END AS kind
       FROM events e JOIN pairs p ON e.user_id = p.user_id JOIN first_exp f ON e.user_id = f.user_id
       WHERE e.event_type = 'purchase'),
     d AS (SELECT kind, floor((epoch_us(ck_ts) - epoch_us(ad_ts)) / 86400000000.0)::bigint
                  + CASE WHEN kind = 'through_trial' THEN 7 ELSE 0 END AS days FROM acq)
SELECT count(*) AS acquisitions, count(*) FILTER (WHERE kind = 'direct') AS direct,
       round(avg(days), 9) AS mean_days, count(*) FILTER (WHERE days < 0) AS negative
FROM d
""")
def b2_time_to_acquisition(spark, sf):
    exposures, installs, checkouts = _funnel_inputs(Tables(spark, sf))
    out = B.time_to_acquisition(exposures, installs, checkouts, "uid", "device_id", "ad_ts", "ck_ts",
                                F.col("value") >= 100)
    return out.withColumn("mean_days", F.round("mean_days", 9))


def _r(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


@register("b3_contact_frequency", """
WITH pu AS (SELECT user_id, count(*) AS c FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT c AS contact_times, count(*) AS n_users, (SELECT max(c) FROM pu) AS max_contact_times FROM pu GROUP BY c
""")
def b3(spark, sf):
    exposures, _, _ = _funnel_inputs(Tables(spark, sf))
    return B.contact_frequency(exposures, "uid")


@register("b3_contact_frequency_histogram", """
WITH pu AS (SELECT user_id, count(*)::double AS c FROM events WHERE event_type = 'view' GROUP BY 1),
     s AS (SELECT min(c) AS lo, (max(c) - min(c)) / 75.0 AS w FROM pu),
     b AS (SELECT least(floor((c - s.lo) / s.w)::int, 74) AS bin, count(*) AS n FROM pu, s GROUP BY 1),
     g AS (SELECT unnest(range(0, 75))::int AS bin)
SELECT g.bin, round(s.lo + g.bin * s.w, 6) AS lower, round(s.lo + (g.bin + 1) * s.w, 6) AS upper,
       coalesce(b.n, 0) AS count
FROM g CROSS JOIN s LEFT JOIN b ON g.bin = b.bin
""")
def b3b(spark, sf):
    """Contacts per exposed user (W1 + dedup per user), drawn as a 75-bin histogram."""
    from quarry.operators.distributions import histogram
    exposures, _, _ = _funnel_inputs(Tables(spark, sf))
    per_user = exposures.groupBy("uid").agg(F.count(F.lit(1)).cast("double").alias("contact_times"))
    return _r(histogram(per_user, "contact_times", 75), ["lower", "upper"])


@register("b4_propensity_base", """
WITH v AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
     c AS (SELECT user_id, count(*) AS contact_times, min(ts) AS mts FROM v GROUP BY 1),
     f AS (SELECT v.user_id, v.ts, c.contact_times FROM v JOIN c ON v.user_id = c.user_id AND v.ts = c.mts)
SELECT user_id AS uid, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ad_ts, (isodow(ts) - 1)::int AS ad_dow, hour(ts)::int AS ad_hour,
       contact_times,
       (user_id IN (SELECT user_id FROM events WHERE event_type = 'signup'))::int AS installed,
       (user_id IN (SELECT s.user_id FROM events s JOIN events p ON s.user_id = p.user_id
                    WHERE s.event_type = 'signup' AND p.event_type = 'purchase'))::int AS converted,
       strftime((SELECT min(ts) FROM events i WHERE i.event_type = 'signup' AND i.user_id = f.user_id),
                '%Y-%m-%d %H:%M:%S') AS first_install_ts
FROM f
""")
def b4(spark, sf):
    exposures, installs, checkouts = _funnel_inputs(Tables(spark, sf))
    out = B.propensity_base(exposures, installs, checkouts, "uid", "ad_ts", "device_id", install_ts="install_ts")
    return out.withColumns({"ad_ts": F.date_format("ad_ts", "yyyy-MM-dd HH:mm:ss"),
                            "first_install_ts": F.date_format("first_install_ts", "yyyy-MM-dd HH:mm:ss")})


@register("b5_window_label", """
WITH s AS (SELECT o.o_orderkey, sum(l.l_quantity) AS t FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
           WHERE l.l_shipdate::date <= (o.o_orderdate::date + INTERVAL 24 MONTH)::date GROUP BY 1)
SELECT o.o_orderkey, coalesce(s.t, 0)::double AS window_total, (coalesce(s.t, 0) >= 100)::int AS label
FROM orders o LEFT JOIN s USING (o_orderkey)
""")
def b5(spark, sf):
    t = Tables(spark, sf)
    ev = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_quantity")
    return B.window_label(t.orders, ev, "o_orderkey", "o_orderdate", "l_shipdate", "l_quantity", 24, 100.0)


_B6_KEYS = {"market": ["c_nationkey"], "store": ["o_custkey"], "market_store": ["c_nationkey", "o_custkey"],
            "weekday": ["dow"]}


def _b6_sql():
    enc = []
    sel = []
    for name, keys in _B6_KEYS.items():
        k = ", ".join(keys)
        on = " AND ".join(f"t.{x} = e_{name}.{x}" for x in keys)
        enc.append(f"e_{name} AS (SELECT {k}, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM feat GROUP BY {k})")
        sel.append((name, on))
    joins = " ".join(f"LEFT JOIN e_{n} ON {on}" for n, on in sel)
    cols = ", ".join(f"round(coalesce(e_{n}.m, -1), 6) AS mean_{n}, round(coalesce(e_{n}.v, -1), 2) AS var_{n}"
                     for n, _ in sel)
    return f"""
WITH base AS (SELECT o.o_orderkey, o.o_orderdate, o.o_totalprice, o.o_custkey, c.c_nationkey, (isodow(o.o_orderdate) - 1)::int AS dow
              FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
     feat AS (SELECT * FROM base WHERE o_orderdate < TIMESTAMP '1998-01-01'),
     tgt AS (SELECT * FROM base WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'),
     {", ".join(enc)}
SELECT t.o_orderkey, {cols} FROM tgt t {joins}
"""


@register("b6_lagged_encoding", _b6_sql())
def b6(spark, sf):
    t = Tables(spark, sf)
    base = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumn(
        "dow", F.weekday("o_orderdate"))
    feat = base.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    tgt = base.where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
                     & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    out = B.lagged_encoding(feat, tgt, _B6_KEYS, "o_totalprice")
    means = [f"mean_{n}" for n in _B6_KEYS]
    vars_ = [f"var_{n}" for n in _B6_KEYS]
    return _r(_r(out.select("o_orderkey", *[c for n in _B6_KEYS for c in (f"mean_{n}", f"var_{n}")]), means), vars_, 2)


@register("b6_lagged_encoding_hour", """
WITH e AS (SELECT event_id, ts, value, hour(ts)::int AS hour FROM events),
     h AS (SELECT hour, avg(value) AS m, var_pop(value) AS v FROM e WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT event_id, round(coalesce(m, -1), 6) AS mean_hour, round(coalesce(v, -1), 2) AS var_hour
FROM e LEFT JOIN h USING (hour) WHERE ts >= TIMESTAMP '2024-01-16'
""")
def b6_hour(spark, sf):
    e = Tables(spark, sf).events.withColumn("hour", F.hour("ts"))
    start = F.lit("2024-01-16").cast("timestamp_ntz")
    out = B.lagged_encoding(e.where(F.col("ts") < start), e.where(F.col("ts") >= start), {"hour": ["hour"]}, "value")
    return _r(_r(out.select("event_id", "mean_hour", "var_hour"), ["mean_hour"]), ["var_hour"], 2)


@register("b7_provider_features", """
WITH c AS (SELECT l.l_suppkey, l.l_orderkey, o.o_custkey, p.p_type, l.l_extendedprice, l.l_discount
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
     pc AS (SELECT l_suppkey, avg(n) AS ppc, avg(s) AS cpc FROM
              (SELECT l_suppkey, l_orderkey, count(DISTINCT p_type) AS n, sum(l_extendedprice) AS s FROM c GROUP BY 1, 2) GROUP BY 1),
     pm AS (SELECT l_suppkey, avg(n) AS ppm, avg(s) AS cpm, avg(k) AS kpm FROM
              (SELECT l_suppkey, o_custkey, count(DISTINCT p_type) AS n, count(DISTINCT l_orderkey) AS k, sum(l_extendedprice) AS s
               FROM c GROUP BY 1, 2) GROUP BY 1),
     t AS (SELECT l_suppkey, count(DISTINCT o_custkey) AS unique_members, count(DISTINCT l_orderkey) AS unique_claims,
                  avg(l_discount) AS mean_score FROM c GROUP BY 1)
SELECT l_suppkey, unique_members, unique_claims, round(mean_score, 9) AS mean_score,
       round(ppc, 9) AS procedures_per_claim, round(cpc, 6) AS cost_per_claim,
       round(ppm, 9) AS procedures_per_member, round(cpm, 6) AS cost_per_member,
       round(kpm, 9) AS claims_per_member
FROM t JOIN pc USING (l_suppkey) JOIN pm USING (l_suppkey)
""")
def b7(spark, sf):
    t = Tables(spark, sf)
    n = t.lineitem.count()
    li = dealt(t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice", "l_discount"), "l_orderkey", n=n)
    c = li.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    out = B.provider_features(c, "l_suppkey", "l_orderkey", "o_custkey", "p_type", "l_extendedprice", "l_discount", n=n)
    return _r(_r(out, ["cost_per_claim", "cost_per_member"]),
              ["mean_score", "procedures_per_claim", "procedures_per_member", "claims_per_member"], 9)


@register("b8_claim_flags", """
SELECT DISTINCT l_orderkey, 'rf_' || l_returnflag AS feature, 1.0::double AS value FROM lineitem
UNION
SELECT DISTINCT l_orderkey, 'ls_' || l_linestatus, 1.0::double FROM lineitem
UNION ALL
SELECT l_orderkey, 'last_' || feature, value FROM (
  SELECT l_orderkey, l_quantity::double AS l_quantity, l_discount::double AS l_discount FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC, l_discount DESC) AS rn
    FROM lineitem) WHERE rn = 1)
UNPIVOT (value FOR feature IN (l_quantity, l_discount))
UNION ALL
SELECT l_orderkey, 'mean_score', round(avg(l_tax), 9) FROM lineitem GROUP BY 1
""")
def b8(spark, sf):
    li = Tables(spark, sf).lineitem
    out = B.claim_flags(li, "l_orderkey", {"l_returnflag": "rf", "l_linestatus": "ls"}, ["l_linenumber"],
                        ["l_quantity", "l_discount"], score="l_tax")
    return out.withColumn("value", F.when(F.col("feature") == "mean_score", F.round("value", 9))
                          .otherwise(F.col("value")))


B9_AS_OF = "2024-01-25"


def _b9_inputs(t):
    """Nested patient-style records built from events -- resources as
    map<date, array<item>> and observations as map<date, array<struct>> --
    then unnested (W3) into the flat inputs of the feature builder."""
    from quarry.operators.aggregates import explode_events
    ev = t.events
    day = F.to_date("ts").cast("string")
    resources = ev.select("user_id", F.create_map(day, F.array(
        F.when(F.col("event_id") % 3 != 0, F.concat("event_type", F.lit("_"), F.get_json_object("props", "$.k"))))).alias("resources"))
    observations = ev.select("user_id", F.create_map(day, F.array(F.struct(
        F.col("event_type").alias("code"),
        F.when(F.col("value") >= 100, "H").when(F.col("value") < 5, "L").alias("interpretation"),
        F.col("value").alias("value"), F.col("event_id").alias("seq")))).alias("observations"))
    res = explode_events(resources, "user_id", "resources", None, "date", "item")
    obs = explode_events(observations, "user_id", "observations", None, "date", "o").select(
        "user_id", "date", "o.code", "o.interpretation", "o.value", "o.seq")
    return res, obs


@register("b9_patient_features", f"""
WITH r AS (SELECT user_id, ts::date AS date, CASE WHEN event_id % 3 <> 0 THEN event_type || '_' || json_extract_string(props, '$.k') END AS item
           FROM events WHERE ts::date < DATE '{B9_AS_OF}'),
     o AS (SELECT user_id, ts::date AS date, event_type AS code,
                  CASE WHEN value >= 100 THEN 'H' WHEN value < 5 THEN 'L' END AS interpretation, value, event_id AS seq
           FROM events WHERE ts::date < DATE '{B9_AS_OF}'),
     rs AS (SELECT user_id, count(DISTINCT date) AS v, min(date) AS lo, max(date) AS hi FROM r GROUP BY 1),
     os AS (SELECT user_id, count(DISTINCT date) AS v, min(date) AS lo, max(date) AS hi FROM o GROUP BY 1),
     parts AS (
       SELECT user_id, split_part(item, '_', 1) AS feature, count(*)::double AS value FROM r WHERE item IS NOT NULL GROUP BY 1, 2
       UNION ALL SELECT user_id, item, count(*) FROM r WHERE item IS NOT NULL GROUP BY 1, 2
       UNION ALL SELECT c_custkey, 'Age', c_nationkey + 18 FROM customer
       UNION ALL SELECT c_custkey, 'IsMale', c_custkey % 2 FROM customer
       UNION ALL SELECT user_id, 'hospital_visits', v FROM rs
       UNION ALL SELECT user_id, 'res_days', datediff('day', lo, hi) FROM rs
       UNION ALL SELECT user_id, 'res_recency', datediff('day', hi, DATE '{B9_AS_OF}') FROM rs
       UNION ALL SELECT r.user_id, 'last_' || item, count(*) FROM r JOIN rs ON r.user_id = rs.user_id AND r.date = rs.hi WHERE item IS NOT NULL GROUP BY 1, 2
       UNION ALL SELECT user_id, code, count(*) FROM o GROUP BY 1, 2
       UNION ALL SELECT user_id, code || '_' || interpretation, count(*) FROM o WHERE interpretation IS NOT NULL GROUP BY 1, 2
       UNION ALL SELECT user_id, interpretation, count(*) FROM o WHERE interpretation IS NOT NULL GROUP BY 1, 2
       UNION ALL SELECT user_id, 'lab_visits', v FROM os
       UNION ALL SELECT user_id, 'obs_days', datediff('day', lo, hi) FROM os
       UNION ALL SELECT user_id, 'obs_recency', datediff('day', hi, DATE '{B9_AS_OF}') FROM os
       UNION ALL SELECT o.user_id, 'last_' || code, count(*) FROM o JOIN os ON o.user_id = os.user_id AND o.date = os.hi GROUP BY 1, 2
       UNION ALL SELECT o.user_id, 'last_' || code || '_val', arg_max(value, seq) FROM o JOIN os
                 ON o.user_id = os.user_id AND o.date = os.hi WHERE value IS NOT NULL GROUP BY o.user_id, code)
SELECT user_id, feature, round(sum(value), 6) AS value FROM parts GROUP BY 1, 2 HAVING sum(value) > 0
""")
def b9(spark, sf):
    t = Tables(spark, sf)
    res, obs = _b9_inputs(t)
    # every third event names no item: it counts as a visit only
    people = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") + 18).alias("age"),
                               (F.col("c_custkey") % 2).alias("is_male"))
    return _r(B.patient_features(res, obs, "user_id", B9_AS_OF, people), ["value"])


@register("b10_label_window", """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS tag FROM orders)
SELECT o_orderkey, tag, CASE WHEN trim(tag) = '' THEN 0 ELSE 1 END AS target FROM d
WHERE trim(tag) = '' OR (try_strptime(trim(tag), '%Y-%m-%d')::date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')
""")
def b10(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")).alias("tag"))
    return B.label_window(o, "tag", "1998-01-01", "1998-12-31")


def _b11_inputs(t):
    members = t.customer.select(F.col("c_custkey").alias("member"), "c_nationkey")
    claims = t.orders.select(F.col("o_custkey").alias("member"), F.to_date("o_orderdate").alias("date"),
                             F.col("o_totalprice").alias("amount"))
    coverage = t.orders.select(F.col("o_custkey").alias("member"), F.to_date("o_orderdate").alias("start_date"),
                               F.add_months(F.to_date("o_orderdate"), 3).alias("end_date"))
    preds = t.customer.select(F.col("c_custkey").alias("member"), (F.col("c_acctbal") / 1000.0).alias("pred"))
    return members, claims, coverage, preds


@register("b11_group_features_target", """
WITH m AS (SELECT DISTINCT c_custkey AS member, c_nationkey FROM customer),
     born AS (SELECT c_custkey AS member, DATE '1930-01-01' + (c_custkey % 20000)::int AS b FROM customer),
     ages AS (SELECT c_nationkey, avg(date_diff('year', b, DATE '1998-01-01')
                     - CASE WHEN strftime(b, '%m-%d') > '01-01' THEN 1 ELSE 0 END) AS mean_age FROM m JOIN born USING (member) GROUP BY 1),
     cov AS (SELECT o_custkey AS member, o_orderdate::date AS s, (o_orderdate::date + INTERVAL 3 MONTH)::date AS e FROM orders),
     firsts AS (SELECT unnest(generate_series(TIMESTAMP '1998-04-01', TIMESTAMP '1999-03-01', INTERVAL 1 MONTH))::date AS mo),
     months AS (SELECT c_nationkey, count(*) AS n FROM (SELECT DISTINCT member, mo FROM cov JOIN firsts ON mo BETWEEN s AND e) JOIN m USING (member) GROUP BY 1),
     cost AS (SELECT c_nationkey, sum(o_totalprice) AS a FROM orders JOIN customer ON o_custkey = c_custkey
              WHERE o_orderdate >= TIMESTAMP '1998-04-01' AND o_orderdate < TIMESTAMP '1999-04-01' GROUP BY 1)
SELECT g.c_nationkey, round(mean_age, 9) AS mean_age, coalesce(n, 0) AS target_member_months,
       round(coalesce(a, 0) / nullif(n, 0), 4) AS target_pmpm,
       CASE WHEN n_regionkey = 0 THEN NULL WHEN n_regionkey = 1 THEN 'test' ELSE 'train' END AS split
FROM (SELECT DISTINCT c_nationkey FROM m) g LEFT JOIN ages USING (c_nationkey) LEFT JOIN months USING (c_nationkey)
     LEFT JOIN cost USING (c_nationkey) LEFT JOIN nation ON n_nationkey = g.c_nationkey
""")
def b11_target(spark, sf):
    t = Tables(spark, sf)
    members, claims, coverage, preds = _b11_inputs(t)
    births = t.customer.select(F.col("c_custkey").alias("member"),
                               F.date_add(F.lit("1930-01-01").cast("date"), (F.col("c_custkey") % 20000).cast("int")).alias("birth_date"))
    splits = t.nation.where("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"),
                                                       F.when(F.col("n_regionkey") == 1, "test").otherwise("train").alias("split"))
    out = B.group_features(members, claims, coverage, preds, "member", "c_nationkey", "1998-01-01", 300000.0,
                           births, ("1998-04-01", "1999-04-01"), splits)
    out = out.select("c_nationkey", "mean_age", "target_member_months", "target_pmpm", "split")
    return _r(_r(out, ["target_pmpm"], 4), ["mean_age"], 9)


@register("b11_group_features", """
WITH m AS (SELECT DISTINCT c_custkey AS member, c_nationkey FROM customer),
     c AS (SELECT o_custkey AS member, o_orderdate::date AS date, o_totalprice AS amount FROM orders
           WHERE o_orderdate::date >= DATE '1997-01-01' AND o_orderdate::date < DATE '1998-01-01'),
     pm AS (SELECT member, sum(amount) AS a12, sum(CASE WHEN date >= DATE '1997-09-01' THEN amount ELSE 0 END) AS a4
            FROM c GROUP BY 1),
     mm AS (SELECT m.*, coalesce(a12, 0) AS a12, coalesce(a4, 0) AS a4 FROM m LEFT JOIN pm USING (member)),
     cov AS (SELECT o_custkey AS member, o_orderdate::date AS s, (o_orderdate::date + INTERVAL 3 MONTH)::date AS e FROM orders),
     months AS (SELECT DISTINCT member, mo FROM (
                  SELECT member, s, e, unnest(generate_series(date_trunc('month', s)::timestamp,
                                                              date_trunc('month', e)::timestamp, INTERVAL 1 MONTH))::date AS mo
                  FROM cov)
                WHERE mo >= s AND mo <= e AND mo >= DATE '1997-01-01' AND mo < DATE '1998-01-01'),
     mmo AS (SELECT c_nationkey, count(*) AS member_months FROM months JOIN m USING (member) GROUP BY 1),
     b AS (SELECT c_nationkey, count(*) AS n FROM (SELECT DISTINCT member FROM cov
              WHERE s <= DATE '1997-01-01' AND e >= DATE '1997-01-01') JOIN m USING (member) GROUP BY 1),
     en AS (SELECT c_nationkey, count(*) AS n FROM (SELECT DISTINCT member FROM cov
              WHERE s <= DATE '1998-01-01' AND e >= DATE '1998-01-01') JOIN m USING (member) GROUP BY 1),
     pr AS (SELECT c_custkey AS member, c_acctbal / 1000.0 AS pred FROM customer),
     ps AS (SELECT c_nationkey, avg(pred) AS mean_pred, stddev_samp(pred) AS std_pred, quantile_cont(pred, 0.5) AS median_pred
            FROM m LEFT JOIN pr USING (member) GROUP BY 1),
     base AS (SELECT c_nationkey, count(*) AS members, sum(a12) AS allowed_12, sum(a4) AS allowed_4,
                     avg((a12 > 300000)::int) AS share_high_cost FROM mm GROUP BY 1),
     clip AS (SELECT member, greatest(s, DATE '1997-01-01') AS cs, least(e, DATE '1997-12-31') AS ce FROM cov),
     cdays AS (SELECT DISTINCT member, unnest(generate_series(cs::timestamp, ce::timestamp, INTERVAL 1 DAY))::date AS d
               FROM clip WHERE cs <= ce),
     dd AS (SELECT c_nationkey, count(*) AS days FROM cdays JOIN m USING (member) GROUP BY 1),
     allf AS (SELECT base.*, coalesce(mmo.member_months, 0) AS member_months, coalesce(b.n, 0) AS members_begin,
                     coalesce(en.n, 0) AS members_end, ps.mean_pred, ps.std_pred, ps.median_pred,
                     coalesce(dd.days, 0) AS days
              FROM base LEFT JOIN mmo USING (c_nationkey) LEFT JOIN b USING (c_nationkey) LEFT JOIN en USING (c_nationkey)
                   LEFT JOIN ps USING (c_nationkey) LEFT JOIN dd USING (c_nationkey))
SELECT c_nationkey, members, round(allowed_12, 2) AS allowed_12, round(allowed_4, 2) AS allowed_4,
       round(share_high_cost, 9) AS share_high_cost, member_months, members_begin, members_end,
       round(mean_pred, 9) AS mean_pred, round(std_pred, 9) AS std_pred, round(median_pred, 9) AS median_pred,
       round(allowed_12 / nullif(member_months, 0), 4) AS pmpm,
       round((members_end - members_begin) / nullif(member_months, 0), 9) AS trend,
       round(allowed_4 / (allowed_12 + 1.0), 9) AS cost_fraction_last_4_month,
       round(days / members, 9) AS mean_days_covered
FROM allf
""")
def b11(spark, sf):
    members, claims, coverage, preds = _b11_inputs(Tables(spark, sf))
    out = B.group_features(members, claims, coverage, preds, "member", "c_nationkey", "1998-01-01", 300000.0)
    out = _r(out, ["allowed_12", "allowed_4"], 2)
    out = _r(out, ["pmpm"], 4)
    return _r(out, ["share_high_cost", "mean_pred", "std_pred", "median_pred", "trend", "cost_fraction_last_4_month",
                    "mean_days_covered"], 9)


def _b12_inputs(spark, t):
    from quarry.functions.scalar import normalize_feature_name
    contrib = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
               .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
               .select(F.col("o_custkey").alias("member"), F.concat_ws(".", "p_type", "p_brand").alias("feature"),
                       (F.col("l_quantity") * F.col("l_discount")).alias("contribution")))
    # the feature dictionary comes from the part table (every possible feature),
    # not from a second pass over the contributions
    # PROMO features have no display name, and some display names no bucket
    name_map = t.part.select(F.concat_ws(".", "p_type", "p_brand").alias("feature")).distinct().where(
        ~F.startswith("feature", F.lit("PROMO"))).withColumn(
        "display", normalize_feature_name("feature", ".", {"ECONOMY": 2}, 1))
    bucket_map = name_map.select("display").distinct().withColumn(
        "bucket", F.when(F.col("display").startswith("ECONOMY"), "economy")
        .when(F.col("display").isin("LARGE", "SMALL"), "size")).where("bucket IS NOT NULL")
    preds = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy(F.col("o_custkey").alias("member")).agg((F.sum("l_extendedprice") / 10000.0).alias("pred")))
    return contrib, preds, name_map, bucket_map


@register("b12_rollup_contributions", """
WITH c AS (SELECT o.o_custkey AS member, p.p_type || '.' || p.p_brand AS feature, l.l_quantity * l.l_discount AS contribution
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
     n AS (SELECT DISTINCT feature, CASE WHEN split_part(feature, '.', 1) = 'ECONOMY'
                                         THEN array_to_string(string_split(feature, '.')[1:2], '.')
                                         ELSE split_part(feature, '.', 1) END AS display FROM c
           WHERE NOT starts_with(feature, 'PROMO')),
     b AS (SELECT DISTINCT display, CASE WHEN starts_with(display, 'ECONOMY') THEN 'economy'
                                         WHEN display IN ('LARGE', 'SMALL') THEN 'size' END AS bucket FROM n),
     per AS (SELECT member, coalesce(b.bucket, n.display, c.feature) AS bucket, sum(contribution) AS contribution
             FROM c LEFT JOIN n USING (feature) LEFT JOIN b USING (display) GROUP BY 1, 2),
     pr AS (SELECT o.o_custkey AS member, sum(l.l_extendedprice) / 10000.0 AS pred
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1),
     tot AS (SELECT member, sum(contribution) AS t FROM c GROUP BY 1)
SELECT member, bucket, round(contribution, 6) AS contribution FROM per
UNION ALL
SELECT pr.member, 'bias', round(pr.pred - coalesce(tot.t, 0), 2) FROM pr LEFT JOIN tot USING (member)
""")
def b12(spark, sf):
    contrib, preds, name_map, bucket_map = _b12_inputs(spark, Tables(spark, sf))
    return _r(B.rollup_contributions(contrib, preds, name_map, bucket_map), ["contribution"])


@register("b13_prior_window", """
SELECT c_custkey AS o_custkey, CASE WHEN (SELECT min(o_orderdate::date) FROM orders) <= DATE '1997-01-01'
       THEN round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate::date >= DATE '1997-01-01'
                                                       AND o_orderdate::date < DATE '1998-01-01'), 0), 2) END AS prior_cost
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1
""")
def b13(spark, sf):
    t = Tables(spark, sf)
    out = B.prior_window(t.orders, "o_custkey", "o_orderdate", "o_totalprice", "1998-01-01",
                         members=t.customer.select(F.col("c_custkey").alias("o_custkey")))
    return _r(out, ["prior_cost"], 2)


_SPLIT3 = ("CASE WHEN (('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 100) < 70 THEN 'train' "
           "WHEN (('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 100) < 85 THEN 'evaluate' ELSE 'test' END")


@register("b14_training_cohort", f"""
SELECT o_orderkey, split, dataset FROM (
  SELECT o_orderkey, o_orderstatus, o_totalprice, {_SPLIT3} AS split, 'y1997' AS dataset FROM orders WHERE year(o_orderdate) = 1997
  UNION ALL
  SELECT o_orderkey, o_orderstatus, o_totalprice, {_SPLIT3}, 'y1998' FROM orders WHERE year(o_orderdate) = 1998)
WHERE split IN ('train', 'evaluate') AND (o_orderstatus <> 'P' OR o_totalprice > 100000)
""")
def b14(spark, sf):
    from quarry.semantics import hash_bucket
    o = Tables(spark, sf).orders
    hb = hash_bucket("o_orderkey")
    o = o.withColumn("split", F.when(hb < 70, "train").when(hb < 85, "evaluate").otherwise("test"))
    sets = {"y1997": o.where(F.year("o_orderdate") == 1997), "y1998": o.where(F.year("o_orderdate") == 1998)}
    out = B.training_cohort(sets, "split", ["train", "evaluate"],
                            (F.col("o_orderstatus") != "P") | (F.col("o_totalprice") > 100000))
    return out.select("o_orderkey", "split", "dataset")


@register("b15_multi_parent_flag", """
SELECT l_partkey, (count(DISTINCT l_suppkey) > 1)::int AS multi_parent FROM lineitem GROUP BY 1
""")
def b15(spark, sf):
    return B.multi_parent_flag(Tables(spark, sf).lineitem, "l_partkey", "l_suppkey")
