"""Arrow-batch scans of whole texts and small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quarry
from quarry.llm.words import BATCH_BYTES, BATCH_ROWS
from quarry.session import stored as stored  # the operators import it from here


def small_batches(spark: SparkSession) -> None:
    """Few rows and bytes in an Arrow batch, as a row may hold a very long text; the workers get this library."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Send the library's modules to the executors, once in a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = Path(quarry.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry_library.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._quarry_shipped = True


def scan(df: DataFrame, columns: list, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``make()`` runs once in a task and gives a function from a RecordBatch of
    ``columns`` to a dict of result columns (or an iterator of such dicts)."""
    small_batches(df.sparkSession)
    fields = [(n, t) for n, t in df.sparkSession.createDataFrame([], schema).dtypes]
    arrow = [pa.field(n, _arrow(t)) for n, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = work(batch)
            for out in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays(
                    [_array(out[f.name], f.type) for f in arrow], schema=pa.schema(arrow))

    return df.select(*columns).mapInArrow(run, schema)


def scan_rows(df: DataFrame, text: str, make: Callable[[], Callable], carried: tuple[str, ...] = ()) -> DataFrame:
    """Judge whole rows in place, without a shuffle: the function ``make()`` gives
    gets the text column of a batch and returns ``(keep, texts)``: a mask, and the
    new texts or None.  All columns stay; ``n_chars``, if present, follows a new text.
    The ``carried`` columns are given too, and new values for them returned after ``texts``."""
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keep, texts, *values = work(*[batch.column(names.index(c)) for c in (text, *carried)])
            arrays = list(batch.columns)
            for c, new in zip(carried, values, strict=True):
                arrays[names.index(c)] = pa.array(new, batch.schema.field(names.index(c)).type)
            if texts is not None:
                kind = batch.schema.field(names.index(text)).type
                arrays[names.index(text)] = pa.array(texts, kind)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    new = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                    arrays[at] = new.cast(batch.schema.field(at).type)
            batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
            "boolean": pa.bool_(), "binary": pa.binary()}[kind]


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def as_id(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(id as text) mod 3 is 1; a null id counts as an empty text (not held out)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def hashed_fraction(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the row's ``columns`` alone."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def spread(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` whose lengths are ``counts``."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]
