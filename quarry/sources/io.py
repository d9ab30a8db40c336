"""Sources and sinks.

Readers take explicit schemas (inference only when none is given); writers
control file counts with ``repartition`` only when asked, and support
``mode='ignore'`` as the skip-if-present guard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# S1
def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             sep: str = ",", header: bool = True) -> DataFrame:
    r = spark.read.option("header", header).option("sep", sep)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


# S2
def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


# S3
def read_json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


# S4
def read_table(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None,
               partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Named-format read; optional hash repartition on ``key`` (or round robin)."""
    df = spark.read.format(fmt).options(**(options or {})).load(path)
    if partitions:
        df = df.repartition(partitions, key) if key else df.repartition(partitions)
    return df


# S5
def write_csv(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    out = df.repartition(files) if files else df
    out.write.mode(mode).option("header", True).csv(path)


# S6
def write_json(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    out = df.repartition(files) if files else df
    out.write.mode(mode).json(path)


# Sparse feature store = long (row, feature, value) + (feature, index) vocabulary.
def write_features(long: DataFrame, path: str, row: str = "row_id", feature: str = "feature",
                   value: str = "value", mode: str = "overwrite") -> DataFrame:
    """Write the long table and a dense vocabulary; returns the vocabulary plan."""
    from quarry.operators.ordered import dense_index
    vocab = dense_index(long, feature)
    long.select(row, feature, value).write.mode(mode).parquet(f"{path}/values")
    vocab.write.mode(mode).parquet(f"{path}/vocabulary")
    return vocab


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/vocabulary")


# S8
def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (cluster-visible)."""
    import uuid

    from quarry.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/quarry-io/{name}-{uuid.uuid4().hex}"


def write_json_document(df: DataFrame, path: str) -> None:
    """One JSON array document. Only for small reference tables: the whole
    table becomes one string in one task (use ``write_json`` otherwise)."""
    doc = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)
