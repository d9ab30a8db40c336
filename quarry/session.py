"""Session construction and cluster-safe helpers (checkpointing)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every quarry session relies on (see SURVEY section 1.1).
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the quarry settings.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(CORE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in CORE_CONF.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's ``spark.checkpoint.dir`` wins; only when it is unset (tests,
    laptops) do we set one, under ``fallback`` or a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not (conf_dir or fallback) and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    target = conf_dir or fallback or os.path.join(os.environ.get("TMPDIR", "/tmp"), "quarry-checkpoints")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its shuffle files removed when it ends, on all executors, not
    when the driver's collector comes to them.  For results that are written and read again:
    nothing asks for those files any more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint) and bounds plan growth
    in iterative algorithms.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not eager:
        return df.checkpoint(eager=False)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read
    again: a cut of lineage that keeps column pruning, and rows that stay as they are when
    a task is run again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows a part in ``dealt``.
PART_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, n: int | None = None, rows: int | None = None) -> DataFrame:
    """``df`` in parts of about ``rows`` rows (by ``keys``, if given), so tasks hold as much
    whatever the table's size; a table of at most ``rows`` stays as it is.  ``n``: how many rows there are, if known."""
    n, rows = df.count() if n is None else n, rows or PART_ROWS
    return df if n <= rows else df.repartition(max(-(-n // rows), df.sparkSession.sparkContext.defaultParallelism), *keys)
