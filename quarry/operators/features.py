"""Feature engineering for models (M1-M9).

Features stay long (row, feature, value) until a model needs a vector.
Vocabularies (distinct category values, feature names) grow with the feature
space, so their joins are left to AQE, which broadcasts them only when their
measured size is under the threshold; explicit broadcasts are kept for tables
bounded by a parameter (top-N lists) or by the class count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.aggregates import value_counts
from quarry.operators.clean import ordinal_encode
from quarry.operators.ordered import dense_index, running_sums
from quarry.semantics import hash_prefix, with_scalar
from quarry.sources.io import scratch_path


def vocabulary(fit_df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, index): distinct non-null values per column, indexed
    0.. in sorted order within each column (distributed dense rank)."""
    return dense_index(_values(fit_df, cols), "value", by=["column_name"])


def _values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value): every column's values as text, long form."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "value").where("value is not null")


# M1
def one_hot(fit_df: DataFrame, apply_df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Long one-hot indicators ``col=value`` -> 1.0 for values seen in ``fit_df``;
    unseen values in ``apply_df`` produce no indicator (all-zero row)."""
    # the vocabulary grows with category cardinality: AQE broadcasts it only
    # when its measured size is under the broadcast threshold
    vocab = _values(fit_df, cols).distinct()
    long = apply_df.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        key, cols, "column_name", "value")
    hits = long.join(vocab, ["column_name", "value"], "left_semi")
    return hits.select(key, F.concat("column_name", F.lit("="), "value").alias("feature"), F.lit(1.0).alias("value"))


def one_hot_vector(fit_df: DataFrame, apply_df: DataFrame, cols: list[str]):
    """ML form: StringIndexer(handleInvalid='keep') + OneHotEncoder fitted on
    ``fit_df``, applied to ``apply_df`` (returns the transformed frame)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
           for c in cols]
    enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_ohe" for c in cols],
                        handleInvalid="keep", dropLast=False)
    model = Pipeline(stages=idx + [enc]).fit(fit_df)
    return model.transform(apply_df)


# M2
def binary_encode(df: DataFrame, key: str, col: str, order: str) -> DataFrame:
    """Ordinal code (first appearance, 1-based) spread over bits, long form
    (key, bit, value); the bit count comes from the vocabulary size."""
    coded = ordinal_encode(df.select(key, col, order), col, order, "_code").withColumn("_code", F.col("_code") + 1)
    n = df.select(col).where(F.col(col).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n"))
    nbits = F.greatest(F.ceil(F.log2(n.scalar() + 1)).cast("int"), F.lit(1))
    bits = coded.withColumn("bit", F.explode(F.sequence(F.lit(0), nbits - 1)))
    return bits.select(key, "bit", F.expr("shiftright(_code, bit) & 1").alias("value"))


# M3
def vectorize(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Dict vectoriser, long form: text -> ``name=value`` with 1.0, numbers pass through."""
    types = dict(df.dtypes)
    parts = []
    for c in cols:
        if types[c] == "string":
            parts.append(df.select(key, F.concat(F.lit(c + "="), F.col(c)).alias("feature"),
                                   F.lit(1.0).alias("value")).where(F.col(c).isNotNull()))
        else:
            parts.append(df.select(key, F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                         .where(F.col(c).isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_vocabulary(long: DataFrame, feature: str = "feature") -> DataFrame:
    """(feature, index) in sorted feature order (distributed dense rank)."""
    return dense_index(long, feature)


def apply_vocabulary(long: DataFrame, vocab: DataFrame, feature: str = "feature") -> DataFrame:
    """Keep features known to the vocabulary and attach their index
    (join strategy left to AQE: vocabularies grow with the feature space)."""
    return long.join(vocab, feature, "inner")


def sparse_rows(long: DataFrame, vocab: DataFrame, key: str, feature: str = "feature", value: str = "value",
                size: int | None = None) -> DataFrame:
    """(key, size, indices, values): a row's non-zero values by ascending index; values of one
    feature add up. Nothing grows with the vocabulary but ``size``, its length (counted
    unless given), so a million features cost a row only those it has."""
    n = F.lit(size) if size is not None else vocab.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    cells = apply_vocabulary(long, vocab, feature).groupBy(key, "index").agg(F.sum(F.col(value).cast("double")).alias("_v"))
    rows = cells.where("_v <> 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "_v"))).alias("_c"))
    return rows.select(key, n.alias("size"), F.transform("_c", lambda x: x["index"]).alias("indices"), F.transform("_c", lambda x: x["_v"]).alias("values"))


def to_vector(long: DataFrame, vocab: DataFrame, key: str, feature: str = "feature", value: str = "value",
              size: int | None = None) -> DataFrame:
    """(key, features): ``sparse_rows`` as sparse ML vectors, for the model edge.

    An ML vector is stored as (type, size, indices, values), type 0 for a sparse one; the
    rows are written in that form and read as vectors, so no Python worker is involved.
    """
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType
    parts = sparse_rows(long, vocab, key, feature, value, size)
    packed = parts.select(key, F.struct(F.lit(0).cast("tinyint").alias("type"), "size", "indices", "values").alias("features"))
    path = scratch_path(long.sparkSession, "vectors")
    packed.write.parquet(path)
    return long.sparkSession.read.schema(StructType([packed.schema[key], StructField("features", VectorUDT())])).parquet(path)


# M4
def lump_top_n(df: DataFrame, col: str, n: int, other: str = "other", out: str | None = None) -> DataFrame:
    """Keep the n most frequent values (count desc, value asc), lump the rest."""
    top = value_counts(df, col, n).select(col).withColumn("_top", F.lit(1))
    j = df.join(top, col, "left")  # at most n rows
    return j.withColumn(out or col, F.when(F.col("_top") == 1, F.col(col)).otherwise(F.lit(other))).drop("_top")


# M5
def standardize(fit_df: DataFrame, apply_df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std, both fitted on ``fit_df`` (one-row scalar)."""
    stats = fit_df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    t = with_scalar(apply_df, stats, "_st")
    return t.withColumns({f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"_st.m_{c}"), F.col(f"_st.s_{c}"))
                          for c in cols}).drop("_st")


# M6
def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One-way ANOVA F statistic per feature (classes = label values).

    One aggregation over the unpivoted table gives per (feature, class) count,
    mean and population variance (numerically stable, no raw sums of squares);
    SSB = sum n_c (mean_c - mean)^2, SSW = sum n_c var_c,
    F = (SSB / (k-1)) / (SSW / (n-k)).
    """
    long = df.select(F.col(label).alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        "_y", features, "feature", "x").where(F.col("x").isNotNull())
    per = long.groupBy("feature", "_y").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"),
                                            F.var_pop("x").alias("v"))
    grand = per.groupBy("feature").agg(
        F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("k_classes"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    j = per.join(grand, "feature")  # k rows per feature
    tot = j.groupBy("feature", "n_total", "k_classes").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"))
    return tot.select("feature", F.try_divide(F.col("ssb") / (F.col("k_classes") - 1),
                                              F.col("ssw") / (F.col("n_total") - F.col("k_classes"))).alias("f_score"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """Top k features by F score (feature name breaks ties); one row per feature."""
    return scores.orderBy(F.col("f_score").desc_nulls_last(), "feature").limit(k)


# M8
def split(df: DataFrame, key: str, test_pct: float, strata: str | None = None, name: str = "split") -> DataFrame:
    """Reproducible train/test split by key hash.

    Plain: hash below test_pct of its 32-bit range -> test. Stratified: inside each stratum,
    rows ranked by hash; percent rank < test_pct/100 -> test. The rank comes
    from the range-partitioned running count (no stratum-wide sort in one task).
    """
    h = hash_prefix(key)
    if strata is None:
        return df.withColumn(name, F.when(h < F.lit(test_pct / 100.0 * 2.0 ** 32), "test").otherwise("train"))
    # a NULL stratum is a stratum of its own
    keyed = df.withColumns({"_h": h.cast("double"), "_s": F.coalesce(F.concat(F.lit("s"), F.col(strata).cast("string")), F.lit("n"))})
    counts = keyed.groupBy("_s", "_h").agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sums(counts, "_h", ["_c"], by=["_s"])
    n = counts.groupBy("_s").agg(F.sum("_c").alias("_n"))
    ranks = cum.join(n, "_s").select("_s", "_h", F.try_divide((F.col("cum__c") - F.col("_c")).cast("double"),
                                                                  (F.col("_n") - 1).cast("double")).alias("_pr"))
    out = keyed.join(ranks, ["_s", "_h"])
    return out.withColumn(name, F.when(F.coalesce("_pr", F.lit(0.0)) < F.lit(test_pct / 100.0), "test")
                          .otherwise("train")).drop("_h", "_s", "_pr")


# M9
def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c) per class, as a (label, weight) table."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = per.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    t = with_scalar(per, tot, "_t")
    return t.select(label, "n_c", (F.col("_t.n") / (F.col("_t.k") * F.col("n_c"))).alias(name))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the weight column (``weightCol`` for pyspark.ml); classes are few: broadcast."""
    return df.join(F.broadcast(class_weights(df, label, name).select(label, name)), label, "left")
