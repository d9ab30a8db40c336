"""Hand-made fixtures, one per semantics rule C1-C19 (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from quarry import semantics as C
from quarry.operators.aggregates import value_counts
from quarry.operators.clean import keep_one
from quarry.operators.metrics import classification_report
from quarry.operators.ordered import quantiles
from quarry.plans.questions import patient_features


def test_c1_safe_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 2.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(C.safe_div("a", "b", -1)).collect()] == [-1.0, -1.0, -1.0, 2.0]


def test_c2_nan_skipped(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert df.select(F.avg(C.nan_to_null("x"))).first()[0] == 2.0


def test_c3_monday_zero(spark):
    df = spark.createDataFrame([(dt.date(2015, 2, 16),), (dt.date(2015, 2, 15),)], "d date")
    assert [r[0] for r in df.select(C.monday_weekday("d")).collect()] == [0, 6]


def test_c4_linear_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert quantiles(df, "x", {"q": 0.25}).first()["q"] == 1.75


def test_c5_mode_smallest(spark):
    df = spark.createDataFrame([(3,), (2,), (3,), (2,)], "x int")
    assert df.select(F.mode("x", True)).first()[0] == 2


def test_c6_variances(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    r = df.agg(F.var_pop("x"), F.var_samp("x")).first()
    assert abs(r[0] - 2 / 3) < 1e-12 and r[1] == 1.0


def test_c7_floor_days(spark):
    a = dt.datetime(2020, 1, 1, 12)
    df = spark.createDataFrame([(a, a + dt.timedelta(hours=12)), (a, a - dt.timedelta(hours=12))], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(C.floor_days("b", "a")).collect()] == [0, -1]


def test_c8_month_end_clip(spark):
    df = spark.createDataFrame([(dt.date(2016, 2, 29),)], "d date")
    assert df.select(C.shift_months("d", 12)).first()[0] == dt.date(2017, 2, 28)


def test_c9_top_n_ties(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",)], "v string")
    assert value_counts(df, "v", 1).first()["v"] == "a"


def test_c10_null_not_in_list(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(C.keep_listed("v", ["a"], "non_top_ten")).first()[0] == "non_top_ten"


def test_c11_groupby_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    assert value_counts(df, "k").count() == 1


def test_c12_null_keys_never_join(spark):
    a = spark.createDataFrame([(None, 1)], "k string, x int")
    b = spark.createDataFrame([(None, 2)], "k string, y int")
    assert a.join(b, "k").count() == 0


def test_c13_keep_first_total_order(spark):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, t, "z"), (1, t, "b")], "k int, ts timestamp, other string")
    assert keep_one(df, ["k"], ["ts"]).first()["other"] == "b"


def test_c14_counter_drops_non_positive(spark):
    res = spark.createDataFrame([], "key int, date date, item string")
    obs = spark.createDataFrame([(1, dt.date(2020, 1, 1), "k", None, 1.0, 1), (1, dt.date(2020, 1, 1), "k", None, -1.0, 2)],
                                "key int, date date, code string, interpretation string, value double, seq int")
    feats = {r["feature"]: r["value"] for r in patient_features(res, obs, "key", "2020-01-05").collect()}
    # last_k_val = value at the last seq = -1 -> dropped; k counted twice -> kept
    assert "last_k_val" not in feats and feats["k"] == 2.0


def test_c15_rounding_modes(spark):
    r = spark.range(1).select(F.round(F.lit(2.5)), F.bround(F.lit(2.5))).first()
    assert (r[0], r[1]) == (3.0, 2.0)


def test_c16_utc_to_pacific(spark):
    df = spark.createDataFrame([(dt.datetime(2015, 2, 1, 5),)], "ts timestamp_ntz")
    assert df.select(C.to_local("ts", "US/Pacific")).first()[0] == dt.datetime(2015, 1, 31, 21)


def test_c17_precision_zero_when_undefined(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    rows = {r["class"]: r for r in classification_report(df, "label", "pred").collect()}
    assert rows["1"]["precision"] == 0.0


def test_c18_hash_bucket(spark):
    r = spark.createDataFrame([("42",)], "k string").select(C.hash_prefix("k"), C.hash_bucket("k")).first()
    assert (r[0], r[1]) == (2714814184, 84)


def test_c19_ntz_as_utc(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts timestamp_ntz")
    assert df.select(F.unix_micros(C.as_instant("ts"))).first()[0] == 1704067200000000
