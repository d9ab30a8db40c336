"""Business questions (B1-B15): compositions of the operator families.

Each function takes DataFrames and returns a lazy DataFrame.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.aggregates import group_broadcast
from quarry.operators.clean import keep_group_min, keep_one
from quarry.operators.joins import flag_member
from quarry.operators.ordered import quantiles
from quarry.semantics import floor_days, safe_div, with_scalar
from quarry.session import dealt, stored


# B1
def funnel(exposures: DataFrame, installs: DataFrame, checkouts: DataFrame,
           user: str = "uid", device: str = "device_id", acquired: Column | None = None) -> DataFrame:
    """Exposed users -> their installs' devices -> acquired checkouts.

    Two semi joins (EXISTS) replace the materialised id lists; one aggregate.
    """
    exposed_users = exposures.select(user)
    devices = installs.join(exposed_users, user, "left_semi").select(device)
    ck = checkouts.join(devices, device, "left_semi")
    acq = acquired if acquired is not None else F.lit(1)
    n_exp = exposures.agg(F.count(F.lit(1)).alias("exposures"))
    out = ck.agg(F.count(F.lit(1)).alias("checkouts"), F.sum(acq.cast("bigint")).alias("acquired"))
    out = with_scalar(out, n_exp, "_e")
    return out.select(F.col("_e.exposures").alias("exposures"), "checkouts",
                      F.coalesce("acquired", F.lit(0)).alias("acquired"),
                      F.round(safe_div(F.col("acquired") * 100.0, F.col("_e.exposures")), 4).alias("conversion_pct"))


# B2
def acquisitions(exposures: DataFrame, installs: DataFrame, checkouts: DataFrame,
                 user: str, device: str, exp_ts: str, ck_ts: str, is_direct: Column,
                 trial_days: int = 7) -> DataFrame:
    """Per acquisition: days from the user's first exposure (+7 on the trial path)."""
    first_exp = exposures.groupBy(user).agg(F.min(exp_ts).alias(exp_ts))
    acq = checkouts.select(device, ck_ts, F.when(is_direct, "direct").otherwise("through_trial").alias("acquired_type"))
    pairs = installs.select(user, device).distinct()
    m = acq.join(pairs, device).join(first_exp, user)
    days = floor_days(F.col(ck_ts), F.col(exp_ts))
    return m.withColumn("day_to_acq", F.when(F.col("acquired_type") == "through_trial", days + trial_days).otherwise(days))


def time_to_acquisition(exposures: DataFrame, installs: DataFrame, checkouts: DataFrame,
                        user: str, device: str, exp_ts: str, ck_ts: str, is_direct: Column,
                        trial_days: int = 7) -> DataFrame:
    """One row: acquisitions, direct ones, mean days to acquisition, negative durations."""
    m = acquisitions(exposures, installs, checkouts, user, device, exp_ts, ck_ts, is_direct, trial_days)
    return m.agg(F.count(F.lit(1)).alias("acquisitions"),
                 F.count_if(F.col("acquired_type") == "direct").alias("direct"),
                 F.avg("day_to_acq").alias("mean_days"),
                 F.count_if(F.col("day_to_acq") < 0).alias("negative"))


# B3
def contact_frequency(df: DataFrame, key: str, name: str = "contact_times") -> DataFrame:
    """Distribution of contacts per user: (contact_times, n_users, max_contact_times)."""
    per_user = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    dist = per_user.groupBy(name).agg(F.count(F.lit(1)).alias("n_users"))
    mx = per_user.agg(F.max(name).alias("m"))
    return with_scalar(dist, mx, "_m").withColumn(f"max_{name}", F.col("_m.m")).drop("_m")


# B4
def propensity_base(exposures: DataFrame, installs: DataFrame, checkouts: DataFrame,
                    user: str, ts: str, device: str, converted: Column | None = None,
                    install_ts: str | None = None) -> DataFrame:
    """First exposure per user (ties kept) with weekday/hour/contact count, plus
    installed and converted flags and, given ``install_ts``, the first install time."""
    from quarry.operators.joins import flag_member
    counted = group_broadcast(exposures, user, {"contact_times": F.count(F.lit(1))})
    first = keep_group_min(counted, user, ts)
    base = first.select(user, ts, F.weekday(ts).alias("ad_dow"), F.hour(ts).alias("ad_hour"), "contact_times")
    base = flag_member(base, installs.select(user), user, "installed")
    if install_ts is not None:
        first_install = installs.groupBy(user).agg(F.min(install_ts).alias("first_install_ts"))
        base = base.join(first_install, user, "left")
    ck = checkouts if converted is None else checkouts.where(converted)
    buyers = installs.select(user, device).join(ck.select(device), device).select(user)
    return flag_member(base, buyers, user, "converted")


# B5
def window_label(base: DataFrame, ev: DataFrame, key: str, base_ts: str, ev_ts: str, amount: str,
                 months: int = 24, threshold: float = 3.0, name: str = "label") -> DataFrame:
    """Sum of ``amount`` up to base_ts + months (end included, no lower bound); label = sum >= threshold; absent -> 0."""
    from quarry.operators.joins import join_within_months
    j = join_within_months(base.select(key, base_ts), ev.select(key, ev_ts, amount), key, base_ts, ev_ts, months)
    sums = j.groupBy(key).agg(F.sum(amount).alias("window_total"))
    out = base.select(key).join(sums, key, "left").fillna({"window_total": 0})
    return out.withColumn(name, (F.col("window_total") >= threshold).cast("int"))


# B6
def lagged_encoding(feat: DataFrame, target: DataFrame, keysets: dict[str, list[str]], value: str,
                    default: float = -1.0) -> DataFrame:
    """Target encodings from the feature period: mean and population variance
    of ``value`` per key set, left joined onto the target-period rows."""
    out = target
    for name, keys in keysets.items():
        enc = feat.groupBy(*keys).agg(F.avg(value).alias(f"mean_{name}"), F.var_pop(value).alias(f"var_{name}"))
        out = out.join(enc, keys, "left").fillna({f"mean_{name}": default, f"var_{name}": default})
    return out


# B7
def provider_features(claims: DataFrame, provider: str, claim: str, member: str, procedure: str, charge: str,
                      score: str | None = None, n: int | None = None) -> DataFrame:
    """Seven provider columns (+ mean score) from a cascade of distinct levels.

    Procedures are distinct codes in a claim or of a member; claims per member
    is the mean over a provider's members of their distinct claims there. Rows are
    collapsed once to (provider, member, claim, code); coarser levels come from finer ones,
    so no row is expanded per distinct count.  Rows are dealt by what the levels of a claim, and those of a
    member, have in common, in parts that do not grow with the table.  ``n``: about how many claims rows there are, if known.
    """
    # stored: each coarser level prunes other columns, so none could share the exchange of another
    base = stored(dealt(claims, provider, member, claim, n=n).groupBy(provider, member, claim, procedure).agg(
        F.sum(charge).alias("_cost"), *([F.sum(score).alias("_s"), F.count(score).alias("_sn")] if score else [])))
    known = lambda c, name: F.count(c).alias(name)
    n = base.count()
    by_claim, by_member = dealt(base, provider, claim, n=n), dealt(base, provider, member, n=n)
    claim_codes = by_claim.groupBy(provider, claim, procedure).agg(F.sum("_cost").alias("_cost"))
    per_claim = claim_codes.groupBy(provider, claim).agg(known(procedure, "_codes"), F.sum("_cost").alias("_cost"))
    c = per_claim.groupBy(provider).agg(
        known(claim, "unique_claims"), F.avg("_codes").alias("procedures_per_claim"), F.avg("_cost").alias("cost_per_claim"))
    member_codes = by_member.groupBy(provider, member, procedure).agg(F.lit(1).alias("_1")).groupBy(provider).agg(known(procedure, "_pairs"))
    sums = [F.sum("_s").alias("_s"), F.sum("_sn").alias("_sn")] if score else []
    member_claims = by_member.groupBy(provider, member, claim).agg(F.sum("_cost").alias("_cost"), *sums)
    per_member = member_claims.groupBy(provider, member).agg(known(claim, "_claims"), F.sum("_cost").alias("_cost"), *sums)
    m = per_member.groupBy(provider).agg(
        known(member, "unique_members"), F.count(F.lit(1)).alias("_members"), F.avg("_cost").alias("cost_per_member"),
        F.avg("_claims").alias("claims_per_member"), *([F.try_divide(F.sum("_s"), F.sum("_sn")).alias("mean_score")] if score else []))
    out = c.join(m, provider).join(member_codes, provider)
    return out.withColumn("procedures_per_member", F.col("_pairs") / F.col("_members")).drop("_pairs", "_members")


# B8
def claim_flags(claims: DataFrame, claim: str, code_cols: dict[str, str], order: list[str],
                last_cols: list[str], score: str | None = None) -> DataFrame:
    """Long features per claim: ``prefix_code`` = 1 for every non-null code, the
    claim's last row values (``last_<col>``) under a total order and, given
    ``score``, the claim's mean score as the ``mean_score`` target row."""
    stacked = None
    for col_name, prefix in code_cols.items():
        part = claims.select(claim, F.concat(F.lit(prefix + "_"), F.col(col_name).cast("string")).alias("feature")).where(
            F.col(col_name).isNotNull())
        stacked = part if stacked is None else stacked.unionByName(part)
    flags = stacked.distinct().withColumn("value", F.lit(1.0))
    last = keep_one(claims.select(claim, *order, *[c for c in last_cols if c not in order]), [claim], order, "last")
    lasts = last.select(claim, *[c for c in last_cols]).unpivot(claim, last_cols, "feature", "value").select(
        claim, F.concat(F.lit("last_"), F.col("feature")).alias("feature"), F.col("value").cast("double").alias("value"))
    out = flags.unionByName(lasts)
    if score is not None:
        target = claims.groupBy(claim).agg(F.lit("mean_score").alias("feature"),
                                           F.avg(F.col(score).cast("double")).alias("value"))
        out = out.unionByName(target)
    return out


# B9
def patient_features(resources: DataFrame, observations: DataFrame, key: str, as_of: str,
                     people: DataFrame | None = None) -> DataFrame:
    """Long (key, feature, value) patient features with counter semantics (C14).

    ``resources``: (key, date, item) with item = '<system>_<code>'; a NULL item
    counts as a visit only. ``people``: (key, age, is_male) adds Age and IsMale;
    ``observations``: (key, date, code, interpretation, value, seq) where seq
    orders entries inside a date. Only dates before ``as_of`` count.
    Features: item and system counts; hospital_visits, res_days, res_recency,
    last_<item>; code, code_interpretation and interpretation counts;
    lab_visits, obs_days, obs_recency, last_<code>, last_<code>_val. Values
    for the same feature add up and only positive totals are kept.
    """
    cut = F.to_date(F.lit(as_of))
    none = lambda kind: F.lit(None).cast(kind)
    r = resources.select(key, "date", F.lit(True).alias("_r"), F.col("item"), none("string").alias("code"), none("string").alias("interpretation"),
                         none("double").alias("_v"), none("long").alias("_seq"))
    o = observations.select(key, "date", F.lit(False).alias("_r"), none("string").alias("item"), "code", "interpretation",
                            F.col("value").cast("double").alias("_v"), F.col("seq").cast("long").alias("_seq"))
    rows = r.unionByName(o).where(F.col("date") < cut)

    # days and the last one, by kind: a row per key from one per (key, kind, day)
    days = rows.groupBy(key, "_r", "date").agg(F.lit(1).alias("_1"))
    of = lambda kind, c: F.when(F.col("_r") == F.lit(kind), c)
    span = days.groupBy(key).agg(*[f(of(kind, F.col("date"))).alias(n + name) for kind, name in ((True, "_r"), (False, "_o"))
                                   for f, n in ((F.count, "_n"), (F.min, "_lo"), (F.max, "_hi"))])

    def one(feature, value, when=None, seq=None):
        e = F.struct((feature if isinstance(feature, Column) else F.lit(feature)).alias("feature"), value.cast("double").alias("value"),
                     (none("long") if seq is None else seq).alias("seq"))
        return e if when is None else F.when(when, e)

    def of_key(name, visits, spread, recency):
        seen = F.col(f"_n{name}") > 0
        return [one(visits, F.col(f"_n{name}"), seen), one(spread, F.datediff(f"_hi{name}", f"_lo{name}"), seen),
                one(recency, F.datediff(cut, f"_hi{name}"), seen)]

    count = F.lit(1.0)
    item, code, interp = F.col("item"), F.col("code"), F.col("interpretation")
    last = F.col("date") == F.when(F.col("_r"), F.col("_hi_r")).otherwise(F.col("_hi_o"))
    seen = ~F.col("_r")
    of_row = [one(F.split_part(item, F.lit("_"), F.lit(1)), count, item.isNotNull()), one(item, count, item.isNotNull()),
              one(F.concat(F.lit("last_"), item), count, item.isNotNull() & last),
              one(code, count, seen), one(F.concat(code, F.lit("_"), interp), count, seen & interp.isNotNull()), one(interp, count, interp.isNotNull()),
              one(F.concat(F.lit("last_"), code), count, seen & last),
              one(F.concat(F.lit("last_"), code, F.lit("_val")), F.col("_v"), seen & last & F.col("_v").isNotNull(), F.coalesce("_seq", F.lit(0)))]
    # one generator for the rows of all kinds and the row of each key
    listed = rows.join(span, key).select(key, F.array(*of_row).alias("f")).unionByName(
        span.select(key, F.array(*of_key("_r", "hospital_visits", "res_days", "res_recency"), *of_key("_o", "lab_visits", "obs_days", "obs_recency")).alias("f")))
    if people is not None:
        listed = listed.unionByName(people.select(key, F.array(one("Age", F.col("age")), one("IsMale", F.col("is_male"))).alias("f")))
    each = listed.select(key, F.explode(F.filter("f", lambda x: x["value"].isNotNull())).alias("f")).select(key, "f.*")
    # counts add up; of values on the last day the one of the highest seq counts
    total = each.groupBy(key, "feature").agg(F.sum(F.when(F.col("seq").isNull(), F.col("value"))).alias("_s"),
                                             F.max(F.when(F.col("seq").isNotNull(), F.struct("seq", "value"))).alias("_m"))
    value = F.coalesce("_s", F.lit(0.0)) + F.coalesce(F.col("_m.value"), F.lit(0.0))
    return total.select(key, "feature", value.alias("value")).where(F.col("value") > 0)


# B10
def label_window(df: DataFrame, col: str, start: str, end: str, name: str = "target") -> DataFrame:
    """Blank date -> 0; date inside [start, end] -> 1; any other date -> row excluded."""
    txt = F.trim(F.col(col).cast("string"))
    d = F.to_date(F.try_to_timestamp(txt, F.lit("yyyy-MM-dd")))
    inside = (d >= F.to_date(F.lit(start))) & (d <= F.to_date(F.lit(end)))
    blank = F.col(col).isNull() | (txt == "")
    return df.where(blank | inside).withColumn(name, F.when(blank, 0).otherwise(1))


# B11
def group_features(members: DataFrame, claims: DataFrame, coverage: DataFrame, preds: DataFrame,
                   member: str, group: str, slice_date: str, high_cost: float = 8000.0, births: DataFrame | None = None,
                   target: tuple[str, str] | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Group features at a slice date.

    ``members``: (member, group); ``claims``: (member, date, amount);
    ``coverage``: (member, start_date, end_date); ``preds``: (member, pred).
    Windows are [slice - 12 months, slice) and [slice - 4 months, slice).
    A member month is a month in the 12-month window whose first day is
    covered. Counts of covered members are taken at the slice date and
    12 months earlier; trend = (end - begin) / member_months;
    cost_fraction_last_4_month = allowed_4 / (allowed_12 + 1).
    ``births`` (member, birth_date) adds mean_age: whole years at the slice date;
    ``target``, the window [start, end) of the target, adds target_member_months and
    target_pmpm; ``splits`` (group, split) adds the split, NULL for unmapped groups.
    """
    s = F.to_date(F.lit(slice_date))
    w12, w4 = F.add_months(s, -12), F.add_months(s, -4)
    m = members.select(member, group).distinct().where(F.col(group).isNotNull())
    windows = [(w12, s)] + ([tuple(F.to_date(F.lit(d)) for d in target)] if target else [])

    # claims: all windows in one pass
    inside = lambda lo, hi: (F.col("date") >= lo) & (F.col("date") < hi)
    wanted = reduce(or_, [inside(*w) for w in windows])
    paid = lambda lo, hi: F.sum(F.when(inside(lo, hi), F.col("amount")).otherwise(0.0))
    cost = claims.where(wanted).groupBy(member).agg(
        paid(w12, s).alias("allowed_12"), paid(w4, s).alias("allowed_4"), *([paid(*windows[1]).alias("_cost")] if target else []))

    # coverage: the union of a member's intervals, as bits of its days and months, in one pass
    covers = lambda d: F.max(((F.col("start_date") <= d) & (F.col("end_date") >= d)).cast("int"))
    aggs = [covers(w12).alias("members_begin"), covers(s).alias("members_end")]
    first, last = F.greatest("start_date", w12), F.least("end_date", F.date_sub(s, 1))
    days = _united(F.datediff(first, w12), F.datediff(last, w12), 366)
    aggs += [u.alias(f"_d{i}") for i, u in enumerate(days)]
    bits = {"_days": len(days)}
    for name, (lo, hi) in zip(("member_months", "target_member_months"), windows, strict=False):
        at = lambda d: F.year(d) * 12 + F.month(d) - (F.year(lo) * 12 + F.month(lo))  # noqa: E731, B023
        from_, to = F.greatest("start_date", lo), F.least("end_date", F.date_sub(hi, 1))
        length = 13 if name == "member_months" else _months(*target) + 1
        months = _united(F.when(from_ <= to, at(from_) + (F.dayofmonth(from_) > 1).cast("int")), at(to), length)
        aggs += [u.alias(f"_{name}{i}") for i, u in enumerate(months)]
        bits[name] = len(months)
    covered = coverage.groupBy(member).agg(*aggs)
    held = lambda name, n: sum((F.bit_count(f"{'_d' if name == '_days' else '_' + name}{i}") for i in range(1, n)),
                               F.bit_count(f"{'_d' if name == '_days' else '_' + name}0"))
    covered = covered.select(member, "members_begin", "members_end", *[held(n, k).alias(n) for n, k in bits.items()])

    per = m.join(cost, member, "left").join(covered, member, "left")
    if births is not None:
        years = F.floor(F.months_between(s, F.to_date("birth_date")) / 12)
        per = per.join(births.groupBy(member).agg(F.sum(years).alias("_years"), F.count(years).alias("_born")), member, "left")
    per = per.fillna({"allowed_12": 0.0, "allowed_4": 0.0})
    counted = ["members_begin", "members_end", *bits, *(["_cost"] if target else [])]
    out = per.groupBy(group).agg(
        F.count(F.lit(1)).alias("members"), F.sum("allowed_12").alias("allowed_12"), F.sum("allowed_4").alias("allowed_4"),
        F.avg((F.col("allowed_12") > high_cost).cast("double")).alias("share_high_cost"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted],
        *([F.try_divide(F.sum("_years"), F.sum("_born")).alias("mean_age")] if births is not None else []))
    pm = m.join(preds, member)
    pstats = pm.groupBy(group).agg(F.avg("pred").alias("mean_pred"), F.stddev_samp("pred").alias("std_pred"))
    out = out.join(pstats, group, "left").join(quantiles(pm, "pred", {"median_pred": 0.5}, by=[group]), group, "left")
    if target is not None:
        out = out.withColumn("target_pmpm", safe_div("_cost", "target_member_months")).drop("_cost")
    if splits is not None:
        out = out.join(splits.select(group, "split"), group, "left")
    return out.withColumn("mean_days_covered", F.col("_days") / F.col("members")).drop("_days").withColumns({
        "pmpm": safe_div("allowed_12", "member_months"),
        "trend": safe_div(F.col("members_end") - F.col("members_begin"), F.col("member_months")),
        "cost_fraction_last_4_month": F.col("allowed_4") / (F.col("allowed_12") + 1.0)})


def _months(start: str, end: str) -> int:
    """Calendar months from the one of ``start`` to the one of ``end`` (dates as text)."""
    (y0, m0), (y1, m1) = (map(int, d.split("-")[:2]) for d in (start, end))
    return (y1 - y0) * 12 + m1 - m0


def _united(first: Column, last: Column, length: int) -> list[Column]:
    """The union of the ranges [first, last] of 0 .. length - 1 in a group, as words of 60 bits:
    fixed in size and united before the shuffle, however many ranges overlap."""
    words = []
    for w in range(0, length, 60):
        a, b = F.greatest(first - w, F.lit(0)), F.least(last - w, F.lit(59))
        ones = F.call_function("shiftleft", F.lit(1).cast("long"), (b - a + 1).cast("int")) - 1
        range_ = F.call_function("shiftleft", ones, a.cast("int"))
        words.append(F.coalesce(F.bit_or(F.when((first <= last) & (a <= b), range_).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long")))
    return words


# B12
def rollup_contributions(contrib: DataFrame, preds: DataFrame, name_map: DataFrame, bucket_map: DataFrame,
                         member: str = "member", feature: str = "feature", value: str = "contribution",
                         pred: str = "pred") -> DataFrame:
    """Sum per-feature contributions into buckets per member; bias = pred - total,
    to two places. A display name without a bucket keeps its own name, and a
    feature without a display name its own.

    ``name_map`` (feature, display) and ``bucket_map`` (display, bucket) are
    vocabulary tables; AQE broadcasts them when their measured size is small.
    """
    j = (contrib.join(name_map, feature, "left")
         .join(bucket_map, "display", "left")
         .withColumn("bucket", F.coalesce("bucket", "display", feature)))
    per = j.groupBy(member, "bucket").agg(F.sum(value).alias("contribution"))
    tot = contrib.groupBy(member).agg(F.sum(value).alias("_total"))
    bias = preds.join(tot, member, "left").select(
        member, F.lit("bias").alias("bucket"),
        F.round(F.col(pred) - F.coalesce("_total", F.lit(0.0)), 2).alias("contribution"))
    return per.unionByName(bias)


# B13
def prior_window(df: DataFrame, key: str, ts: str, amount: str, slice_date: str, name: str = "prior_cost",
                 members: DataFrame | None = None) -> DataFrame:
    """Amount in [slice - 1 year, slice) per key, 0 for ``members`` without any;
    NULL for all when the whole data starts after the window's start."""
    s = F.to_date(F.lit(slice_date))
    start = F.add_months(s, -12)
    per = df.groupBy(key).agg(
        F.sum(F.when((F.to_date(ts) >= start) & (F.to_date(ts) < s), F.col(amount)).otherwise(0.0)).alias("_sum"))
    if members is not None:
        per = members.select(key).distinct().join(per, key, "left")
    first = df.agg(F.min(F.to_date(ts)).alias("first"))
    return with_scalar(per, first, "_d").select(
        key, F.when(F.col("_d.first") <= start, F.coalesce("_sum", F.lit(0.0))).alias(name))


# B14
def training_cohort(datasets: dict[str, DataFrame], split_col: str, splits: list[str], predicate: Column) -> DataFrame:
    """Rows of the chosen splits satisfying the predicate, stacked with a dataset label."""
    out = None
    for name, d in datasets.items():
        part = d.where(F.col(split_col).isin(splits) & predicate).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# B15
def multi_parent_flag(df: DataFrame, child: str, parent: str, name: str = "multi_parent") -> DataFrame:
    """Children with more than one parent flagged 1, others 0 (one row per child)."""
    from quarry.operators.profile import fd_violations
    children = df.select(child).distinct()
    multi = fd_violations(df, child, parent).select(child).withColumn("_hit", F.lit(1))
    return children.join(multi, child, "left").select(child, F.coalesce("_hit", F.lit(0)).alias(name))
