"""Hand-computed cases: absent classes, constant targets, NULL keys, tiny fractions, cuts of all rows."""

import datetime

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import aggregates, clean, features, joins, metrics, outliers, profile
from quarry.plans import questions
from quarry.semantics import mode_of


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.7), ("b", 0, 0.1), ("b", 1, 0.9)], "g string, y int, s double")
    auc = {r.g: r.auc for r in metrics.roc_auc(df, "y", "s", by=["g"]).collect()}
    assert auc == {"a": None, "b": 1.0}
    none = metrics.average_precision(df.withColumn("y", F.lit(0)), "y", "s").collect()
    assert all(r.average_precision is None for r in none)


def test_constant_target(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p", 1).first()
    assert (r.mae, r.r2, r.adj_r2) == (1.0, None, None)


def test_newly_top_cuts_come_from_all_rows(spark):
    # y and p cut at 4.6 over all rows; of the rows below the prior's cut none is above it
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (2.0, 2.0, 0.0), (3.0, 3.0, 0.0), (4.0, 4.0, 0.0), (5.0, 5.0, 9.0)], "y double, p double, prior double")
    r = metrics.newly_top_metrics(df, "y", "p", "prior", 0.9).first()
    assert (r.newly_precision, r.newly_recall) == (0.0, 0.0)


def test_null_strata_and_keys_stay(spark):
    df = spark.range(400).withColumn("g", F.when(F.col("id") % 4 > 0, F.col("id") % 4))
    out = features.split(df, "id", 20, strata="g")
    assert out.count() == 400 and out.where("g IS NULL AND split = 'test'").count() == 20
    assert {r["count"] for r in out.where("split = 'test'").groupBy("g").count().collect()} == {20}
    dup = profile.duplicate_rows(spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int"), ["k"])
    assert sorted((r.v, r.dup_count) for r in dup.collect()) == [(1, 2), (2, 2)]


@pytest.mark.parametrize("frac", [0.00004, 0.005])
def test_small_fractions(spark, frac):
    df = spark.range(1_000_000)
    for n in (clean.sample_rows(df, "id", frac).count(), features.split(df, "id", 100 * frac).where("split = 'test'").count()):
        assert 0.5 * frac * 1e6 <= n <= 1.6 * frac * 1e6


def test_months_bound_and_prior_window(spark):
    base = spark.createDataFrame([(1, "2020-01-31")], "k int, d string")
    ev = spark.createDataFrame([(1, "2019-01-01", 1), (1, "2020-01-31", 2), (1, "2020-02-29", 3), (1, "2020-03-01", 4)], "k int, e string, v int")
    got = {low: sorted(r.v for r in joins.join_within_months(base, ev, "k", "d", "e", 1, low).collect())
           for low in (None, "inclusive", "strict")}
    assert got == {None: [1, 2, 3], "inclusive": [2, 3], "strict": [3]}
    people = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    paid = spark.createDataFrame([(1, "2019-06-01", 5.0), (2, "2020-06-01", 7.0)], "k int, e string, a double")
    prior = questions.prior_window(paid, "k", "e", "a", "2021-01-01", members=people)
    assert {r.k: r.prior_cost for r in prior.collect()} == {1: 0.0, 2: 7.0, 3: 0.0}
    short = questions.prior_window(paid, "k", "e", "a", "2020-01-01", members=people)
    assert {r.prior_cost for r in short.collect()} == {None}


def test_provider_features_count_codes(spark):
    rows = [("p", "c1", "m1", "x", 1.0), ("p", "c1", "m1", "x", 2.0), ("p", "c2", "m1", "y", 3.0), ("p", "c3", "m2", "x", 4.0)]
    r = questions.provider_features(spark.createDataFrame(rows, "p string, c string, m string, code string, a double"), "p", "c", "m", "code", "a").first()
    assert (r.unique_claims, r.unique_members, r.procedures_per_claim, r.procedures_per_member, r.claims_per_member) == (3, 2, 1.0, 1.5, 1.5)


def test_names_without_bucket_stay(spark):
    contrib = spark.createDataFrame([(1, "f", 1.0), (1, "g", 2.0), (1, "h", 4.0)], "member int, feature string, contribution double")
    out = questions.rollup_contributions(
        contrib, spark.createDataFrame([(1, 7.126)], "member int, pred double"),
        spark.createDataFrame([("f", "F"), ("g", "G")], "feature string, display string"),
        spark.createDataFrame([("F", "B")], "display string, bucket string"))
    assert {r.bucket: r.contribution for r in out.collect()} == {"B": 1.0, "G": 2.0, "h": 4.0, "bias": 0.13}


def test_prevalence_counts_listed_members_and_filter_rounds(spark):
    feats = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (9, "a", 1.0)], "member int, feature string, value double")
    groups = spark.createDataFrame([("g", 1), ("g", 3), ("g", 9)], "group_id string, member int")
    sets = spark.createDataFrame([("s", "a")], "set_name string, feature string")
    listed = spark.createDataFrame([(1,), (2,), (3,), (4,)], "member int")
    out = aggregates.prevalence(feats, groups, sets, members=listed)
    assert {r.group_id: (r.members, r.flagged) for r in out.collect()} == {"g": (2, 1), "__all__": (4, 2)}
    one = spark.createDataFrame([(1, "x", 1.0)], "row_id int, feature string, value double")
    assert aggregates.prevalence_filter(one, 0.1, n_rows=14).count() == 1  # 1.4 rounds to 1
    assert aggregates.prevalence_filter(one, 0.1, n_rows=25).count() == 0  # 2.5 rounds to 2


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 3.0), ("b", 3.0), ("b", 1.0), ("a", None)], "g string, v double")
    assert {r.g: r.m for r in mode_of(df, "v", "m", ["g"]).collect()} == {"a": 1.0, "b": 3.0}


def test_clean_rows_and_single_purchases(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.0)], "k int, v double")
    flagged = spark.createDataFrame([(3, 1, "v", 0)], "k int, n_outlier_features int, outlier_features string, repeat_outlier int")
    assert sorted(r.k for r in outliers.clean_rows(df, "k", flagged).collect()) == [1, 2]
    one = spark.createDataFrame([("c", "2020-01-01", 5.0)], "c string, d string, a double")
    assert outliers.rfm_features(one, "c", "d", "a").first().mean_gap_days == 0.0


def test_newly_high_by_threshold(spark):
    rows = [(9.0, 8.0, 1.0), (9.0, 1.0, 2.0), (1.0, 8.0, 4.9), (9.0, 9.0, 5.0), (1.0, 9.0, 7.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "y double, p double, prior double")
    r = {x.threshold: x for x in metrics.newly_threshold_metrics(df, "y", "p", "prior", [5.0, 0.5]).collect()}
    assert (r[5.0].newly_precision, r[5.0].newly_recall, r[5.0].newly_f1) == (0.5, 0.5, 0.5)  # of the first three rows
    assert (r[0.5].newly_precision, r[0.5].newly_average_precision) == (0.0, None)  # no prior below it


def test_display_names_by_family(spark):
    names = ["Claims|a|Cost", "MedicalCodeCounter|n_icd_c-77", "DiseaseTagCounter|x_asthma", "CrossCodeCounter|n_ICD_c-J45",
             "CrossCodeCounter|n_ICD_c-unknown", "LabInterpreter|x|High", "Summary|x|Total", "Custom|x", "DiseaseTagCounter"]
    df = spark.createDataFrame([(n,) for n in names], "feature string")
    codes = spark.createDataFrame([("u", "J45", "Asthma"), ("v", "J45", "Other")], "url string, code string, name string")
    systems = spark.createDataFrame([("icd", "u"), ("loinc", "v")], "short string, url string")
    got = {r.feature: r.display for r in scalar.display_names(df, "feature", codes, systems).collect()}
    want = dict(zip(names, ["Cost", "icd|77", "asthma", "ICD|Asthma", names[4], "LabInterpreter|High", None, "Custom|x", names[8]], strict=True))
    assert got == {k: v for k, v in want.items() if v}
    assert scalar.display_names(df, "feature", codes, systems, summary=True).where("display = 'Summary|Total'").count() == 1


def test_group_features_of_the_target(spark):
    day = lambda *cols: [F.to_date(c).alias(c) for c in cols]
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "member long, g string")
    claims = spark.createDataFrame([(1, "2020-03-01", 60.0), (1, "2020-02-29", 5.0), (2, "2021-02-28", 30.0), (2, "2021-03-01", 7.0)], "member long, date string, amount double").select("member", *day("date"), "amount")
    coverage = spark.createDataFrame([(1, "2020-02-15", "2020-04-01"), (2, "1900-01-01", "9999-12-31")], "member long, start_date string, end_date string").select("member", *day("start_date", "end_date"))
    births = spark.createDataFrame([(1, "1990-01-01"), (2, "1980-01-02")], "member long, birth_date string")
    preds = spark.createDataFrame([(1, 1.0)], "member long, pred double")
    splits = spark.createDataFrame([("a", "train")], "g string, split string")
    out = questions.group_features(members, claims, coverage, preds, "member", "g", "2020-01-01", births=births, target=("2020-03-01", "2021-03-01"), splits=splits)
    r = {x.g: x for x in out.collect()}
    assert (r["a"].mean_age, r["a"].target_member_months, r["a"].split) == (34.5, 14, "train")
    assert r["a"].target_pmpm == 90 / 14 and r["a"].member_months == 12
    assert (r["b"].mean_age, r["b"].target_member_months, r["b"].target_pmpm, r["b"].split) == (None, 0, None, None)


def test_null_keys_form_no_group(spark):
    """C11: rows with a NULL key belong to no group, in every grouped aggregate."""
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), (None, "x", 3.0), ("b", "y", 5.0)], "k string, j string, v double")
    one = {tuple(r) for r in aggregates.count_by(df, ["k"]).collect()}
    assert one == {("a", 2), ("b", 1)}
    made = [aggregates.distinct_by(df, "k", "v"), aggregates.agg_by(df, "k", {"s": ("sum", "v")}), aggregates.mean_by(df, "k", "v"), aggregates.sum_label_by(df, "k", "v", 2.0),
            aggregates.nested_mean(df, "k", "j", "sum", "v"), aggregates.variance_by(df, ["k"], "v"), aggregates.quantiles_by(df, "k", "v"), aggregates.count_positive_by(df, "k", F.col("v") > 1),
            aggregates.first_by(df, "k", "v"), aggregates.ratio_by(df, "k", F.sum("v"), F.count("v"))]
    for out in made:
        assert {r["k"] for r in out.collect()} == {"a", "b"}
    assert {tuple(r) for r in aggregates.crosstab_long(df, "k", "j").collect()} == {("a", "x", 1), ("b", "y", 1)}
    assert {tuple(r) for r in aggregates.nested_mean(df, "k", "j", "sum", "v", "m").collect()} == {("a", 1.0), ("b", 5.0)}


def test_intercept_stands_apart_and_unmatched_entities_have_no_values(spark):
    df = spark.createDataFrame([(1, "Bias", 9.0), (1, "f", -2.0), (1, "g", 1.5), (2, "Bias", 0.5), (2, "f", 1.0), (3, "Bias", 4.0)], "e int, name string, v double")
    matched = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "e int, matched boolean")
    got = {r["e"]: tuple(r)[1:] for r in aggregates.top_k_wide(df, "e", "name", "v", 2, "Bias", matched).collect()}
    assert got == {1: ("9.00", "f", "-2.00", "g", "1.50"), 2: ("N/A",) * 5, 3: ("4.00", None, None, None, None), 4: (None,) * 5}


def test_a_code_listed_twice_keeps_rows_single(spark):
    df = spark.createDataFrame([("CrossCodeCounter|icd_x-a1",)], "feature string")
    codes = spark.createDataFrame([("u", "a1", "Zeta"), ("u", "a1", "Alpha")], "url string, code string, name string")
    systems = spark.createDataFrame([("x-a1", "u"), ("a1", "u")], "short string, url string")
    assert scalar.display_names(df, "feature", codes, systems).count() == 1


def test_sparse_vectors_cost_their_non_zeros(spark):
    """A million features: a row's vector holds its own alone, and reads back as an ML vector."""
    vocab = spark.range(1_000_000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("feature"), F.col("id").cast("int").alias("index"))
    long = spark.createDataFrame([(1, "f999999", 2.0), (1, "f5", 1.0), (1, "f5", 0.5), (1, "f7", 0.0), (2, "f3", -1.0), (3, "unknown", 1.0)], "row int, feature string, value double")
    got = {r["row"]: (r["size"], r["indices"], r["values"]) for r in features.sparse_rows(long, vocab, "row").collect()}
    assert got == {1: (1_000_000, [5, 999_999], [1.5, 2.0]), 2: (1_000_000, [3], [-1.0])}
    v = {r["row"]: r["features"] for r in features.to_vector(long, vocab, "row").collect()}
    assert v[1] == Vectors.sparse(1_000_000, {5: 1.5, 999_999: 2.0}) and v[2].size == 1_000_000


def test_covered_days_and_months_are_unions_of_intervals(spark):
    day = datetime.date
    members = spark.createDataFrame([(1, "g"), (2, "g"), (3, None)], "member int, grp string")
    claims = spark.createDataFrame([(1, day(2020, 5, 1), 10.0)], "member int, date date, amount double")
    cover = [(1, day(2019, 1, 1), day(2019, 2, 10)), (1, day(2019, 2, 5), day(2019, 2, 20)), (1, day(2019, 2, 1), day(2019, 2, 3)), (2, day(2018, 1, 1), day(2030, 1, 1)),
             (2, day(2019, 12, 31), day(2019, 12, 30))]
    coverage = spark.createDataFrame(cover, "member int, start_date date, end_date date")
    preds = spark.createDataFrame([(1, 0.5)], "member int, pred double")
    r = questions.group_features(members, claims, coverage, preds, "member", "grp", "2020-01-01", target=("2020-01-01", "2026-01-01")).collect()
    assert len(r) == 1
    assert r[0]["mean_days_covered"] == (51 + 365) / 2 and r[0]["member_months"] == 2 + 12
    assert (r[0]["members_begin"], r[0]["members_end"], r[0]["target_member_months"], r[0]["target_pmpm"]) == (2, 1, 72, 10.0 / 72)
