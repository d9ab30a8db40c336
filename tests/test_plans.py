"""Plan shape and skew checks: the properties the operators are designed for."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ordered
from quarry.operators.clean import keep_one
from quarry.operators.ordered import quantiles
from quarry.session import cut_lineage, stored
from tests.conftest import SF_SMALL

SF_MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(params=["narrow_to_few_values", "poor_sketch", "default"])
def split_mode(request, monkeypatch):
    """Run order-statistics checks also with brackets narrowed down to three values,
    and with a sketch so poor that brackets miss their ranks (the small fixtures need neither)."""
    whole = ordered._narrow
    if request.param == "narrow_to_few_values":
        monkeypatch.setattr(ordered, "_narrow", lambda rows, by, probs, accuracy, most, few: whole(rows, by, probs, accuracy, 3, few))
    if request.param == "poor_sketch":
        monkeypatch.setattr(ordered, "_narrow", lambda rows, by, probs, accuracy, most, few: whole(rows, by, probs, 3, 50, few))
    return request.param


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_one_is_an_aggregate_not_a_window(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    plan = _plan(keep_one(ev, ["user_id"], ["ts"]))
    assert "Window" not in plan and "HashAggregate" in plan or "ObjectHashAggregate" in plan or "SortAggregate" in plan


def test_filter_and_columns_reach_the_scan(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    df = li.where(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


@pytest.mark.parametrize("by", [[], ["l_returnflag"]])
def test_only_values_near_a_rank_are_ordered(spark, by):
    """What is put in order is the narrowed counts: a small share of the distinct values."""
    li = spark.read.parquet(f"{SF_MEDIUM}/lineitem.parquet")
    rows = li.select(*by, F.col("l_extendedprice").alias("_x")).withColumns({"_gap": F.lit(0), "_c": F.lit(1).cast("long")})
    counts, sizes = ordered._narrow(rows, by, [0.5], ordered.ACCURACY, ordered.MOST, False)
    assert counts.count() < 0.02 * rows.select(*by, "_x").distinct().count()
    assert counts.agg(F.sum("_c")).first()[0] == rows.count() == sizes.agg(F.sum("_n")).first()[0]


ODD = {"one": [1.0], "two": [1.0, 2.0], "nan": [float("nan"), 1.0, 2.0], "ends": [-0.0, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")],
       "tied": [7.0] * 40 + [8.0], "wide": [10.0 ** (k / 3) for k in range(-300, 300)], "none": [None, None], None: [3.0]}


@pytest.mark.usefixtures("split_mode")
def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([(g, v) for g, values in ODD.items() for v in [*values, None]], "g string, v double")
    probs = {f"p{i}": p for i, p in enumerate([0.0, 0.01, 0.25, 0.5, 0.5, 0.99, 1.0])}
    got = {r["g"]: r.asDict() for r in quantiles(df, "v", probs, by=["g"]).collect()}
    assert set(got) == set(ODD) - {None, "none"}  # a NULL group is no group
    for g, r in got.items():
        values = sorted(ODD[g], key=lambda v: (v != v, v))
        for k, p in probs.items():
            h = (len(values) - 1) * p
            lo, hi = values[int(np.floor(h))], values[int(np.ceil(h))]
            assert r[k] == pytest.approx(lo if lo == hi else lo * (1 - h % 1) + hi * (h % 1), nan_ok=True), (g, k)
    assert [tuple(r) for r in quantiles(df.limit(0), "v", {"m": 0.5}).collect()] == [(None,)]
    assert quantiles(df.limit(0), "v", {"m": 0.5}, by=["g"]).collect() == []


def test_keys_with_shared_prefixes_spread_over_parts(spark, monkeypatch):
    """Many keys over few long prefixes: no part holds more than its share of them."""
    kept = []
    monkeypatch.setattr(ordered, "stored", lambda df, whole=ordered.stored: kept.append(whole(df)) or kept[-1])
    n = 200_000
    keys = spark.range(n).select(F.concat(F.lit("https://example.org/"), (F.col("id") % 50).cast("string"), F.lit("/item="), F.col("id").cast("string")).alias("k"))
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        index = ordered.dense_index(keys, "k")
        sizes = [r["count"] for r in kept[0].groupBy("_part").count().collect()]
        assert len(sizes) == 20 and max(sizes) < 2 * n / 20
        got = [r["k"] for r in index.where("index % 40000 = 0 or index = 199999").orderBy("index").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    want = sorted(f"https://example.org/{i % 50}/item={i}" for i in range(n))
    assert got == [want[i] for i in (0, 40000, 80000, 120000, 160000, 199999)]


@pytest.mark.usefixtures("split_mode")
def test_hot_key_quantiles_and_keep_one_are_exact(spark):
    """One key holds a third of all rows (derived from lineitem): results must
    still equal the brute-force answer."""
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    skewed = li.withColumn("k", F.when(F.col("l_linenumber") <= 2, F.lit(-1)).otherwise(F.col("l_suppkey")))
    hot_share = skewed.where(F.col("k") == -1).count() / skewed.count()
    assert hot_share > 0.25
    got = {r["k"]: r["m"] for r in quantiles(skewed, "l_extendedprice", {"m": 0.5}, by=["k"]).collect()}
    pdf = skewed.select("k", "l_extendedprice").toPandas()
    for k, g in pdf.groupby("k"):
        assert abs(got[k] - float(np.quantile(g["l_extendedprice"], 0.5))) < 1e-6
    first = {r["k"]: r["l_extendedprice"] for r in keep_one(skewed.select("k", "l_extendedprice"), ["k"],
                                                              ["l_extendedprice"]).collect()}
    for k, g in pdf.groupby("k"):
        assert first[k] == g["l_extendedprice"].min()


@pytest.mark.usefixtures("split_mode")
def test_hot_score_roc_auc_is_exact(spark):
    """A third of the rows share one score: the bucketed running sums must
    still give the brute-force AUC and AP."""
    from quarry.operators.metrics import average_precision, roc_auc
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    df = li.select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                   F.when(F.col("l_linenumber") <= 2, F.lit(0.5)).otherwise(F.col("l_discount")).alias("score"))
    pdf = df.toPandas()
    assert (pdf["score"] == 0.5).mean() > 0.25
    auc = roc_auc(df, "label", "score").first()["auc"]
    ap = average_precision(df, "label", "score").first()["average_precision"]
    # brute force over distinct thresholds, descending
    g = pdf.groupby("score")["label"].agg(["sum", "count"]).sort_index(ascending=False)
    pos, neg = g["sum"].to_numpy(), (g["count"] - g["sum"]).to_numpy()
    P, N = pos.sum(), neg.sum()
    tp, fp = np.cumsum(pos), np.cumsum(neg)
    prev_tp = np.concatenate([[0], tp[:-1]])
    auc_bf = float(((fp - np.concatenate([[0], fp[:-1]])) * (tp + prev_tp)).sum() / (2 * P * N))
    ap_bf = float(((pos / P) * (tp / (tp + fp))).sum())
    assert abs(auc - auc_bf) < 1e-12 and abs(ap - ap_bf) < 1e-12


@pytest.mark.usefixtures("split_mode")
def test_dense_index_strings_match_sorted_order(spark):
    from quarry.operators.ordered import dense_index
    words = ["abcdefgh", "abcdefga", "abcdef", "abc", "", "zeta", "Zeta", "émile", "über", "abÿ", "a", "abcdefg"]
    df = spark.createDataFrame([(w,) for w in words * 3], "w string")
    got = {r["w"]: r["index"] for r in dense_index(df, "w").collect()}
    expect = {w: i for i, w in enumerate(sorted(set(words)))}
    assert got == expect


@pytest.mark.usefixtures("split_mode")
def test_dense_index_numbers_per_group(spark):
    from quarry.operators.ordered import dense_index
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    got = {(r["l_returnflag"], r["l_quantity"]): r["index"]
           for r in dense_index(li, "l_quantity", by=["l_returnflag"]).collect()}
    pdf = li.select("l_returnflag", "l_quantity").toPandas()
    for g, sub in pdf.groupby("l_returnflag"):
        for i, v in enumerate(sorted(sub["l_quantity"].unique())):
            assert got[(g, v)] == i


@pytest.mark.usefixtures("split_mode")
def test_results_do_not_depend_on_partitioning(spark):
    """What a recomputed stage sees (other partition counts, AQE choices) must
    not change exact results: quantiles and AUC are identical across settings."""
    from quarry.operators.metrics import roc_auc
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    scored = li.select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                       (F.col("l_discount") + F.col("l_tax")).alias("score"))
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, aqe in [(3, "true"), (17, "false"), (8, "true")]:
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            q = sorted(tuple(r) for r in quantiles(li, "l_extendedprice", {"a": 0.1, "b": 0.5, "c": 0.99},
                                                   by=["l_returnflag"]).collect())
            auc = roc_auc(scored, "label", "score").first()["auc"]
            results.append((q, round(auc, 12)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert results[0] == results[1] == results[2]


@pytest.mark.usefixtures("split_mode")
def test_quantiles_equal_percentile(spark):
    """Also for groups of more values than a sketch holds, and for many ranks near each other."""
    li = spark.read.parquet(f"{SF_MEDIUM}/lineitem.parquet")
    probs = {f"p{i}": p for i, p in enumerate([0.0, 0.01, 0.0101, 0.1, 0.5, 0.97, 0.999, 1.0])}
    for by in ([], ["l_returnflag"], ["l_suppkey"]):
        got = sorted(tuple(r) for r in quantiles(li, "l_extendedprice", probs, by=by).collect())
        want = sorted(tuple(r) for r in quantiles(li, "l_extendedprice", probs, by=by, method="buffered").collect())
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert all((abs(x - y) < 1e-6) if isinstance(x, float) else x == y for x, y in zip(g, w))


def test_rows_without_a_score_rank_nowhere(spark):
    from quarry.operators.metrics import average_precision, pr_curve, roc_auc
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (1, None), (0, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert average_precision(df, "y", "s").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert roc_auc(df, "y", "s").first()[0] == 0.5
    assert pr_curve(df, "y", "s").count() == 3


@pytest.mark.parametrize("cut", [cut_lineage, stored])
def test_a_cut_leaves_no_shuffle_files(spark, cut):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    def shuffled():
        return {f for f in blocks.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and "shuffle_" in f}
    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    counts = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("key")).agg(F.count("*").alias("n"))
    got = cut(counts)
    for _ in range(100):  # files go shortly after the job
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert got.count() == counts.count() == 5_000 and got.where("n <> 4").count() == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    counts.collect()
    assert shuffled() - before  # the files of a plain query are its frame's
