"""11. Sharding by a two-pass external shuffle. [native]

Pass one reads the records once, draws a seeded hash for each and writes them with it
to the shared checkpoint folder: what follows reads the same draws however often
a task is run again.  The measured bytes and rows then fix a number of buckets of
bounded size, and the hash scatters the records uniformly over them.  Pass two
shuffles every bucket by Fisher-Yates (Spark's ``shuffle`` is that algorithm) and gives
its records consecutive places: the counts of the buckets before it come first.

The places 0 to n - 1 are cut into ``shards`` runs whose lengths differ by one at most
(law ``rows``); a slot is the place within the run.  A bucket's places are consecutive,
so a task writes to the one or two shards its buckets lie in, in order.

A record is drawn by the seed, its text and where it was read, so rows that repeat
as a whole, one text or one id in however many rows, go to different buckets; no
task holds a group.  Equal texts are not kept together.  Reruns over the same files, read
in the same splits, agree.

A null text counts no bytes (``size`` 1) and has the crc32 of an empty one; null ids
are records like others; an empty table gives no rows, and with fewer rows than
shards some shards are empty.  Columns of the table named like the two that are added
are replaced.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.scan import stored

#: Production parameters: shards, bytes and records a bucket holds on average.
SHARDS, BUCKET_BYTES, BUCKET_ROWS, SEED = 16, 16 << 20, 50_000, 11
#: Bytes a record counts besides its text.
OVERHEAD = 64


def buckets(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """(bucket, start, order): places before each bucket, and its Fisher-Yates permutation.

    Starts are sums in two levels, so no task adds up all buckets."""
    wide = max(1, math.isqrt(count))
    held = rows.groupBy("bucket").agg(F.count("*").alias("held")).withColumn("part", F.expr(f"bucket div {wide}"))
    before = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = stored(held)
    parts = held.groupBy("part").agg(F.sum("held").alias("held")).select("part", before(W.orderBy("part")).alias("start"))
    inside = held.select("bucket", "part", "held", before(W.partitionBy("part").orderBy("bucket")).alias("inside"))
    # the generator goes on from row to row of a partition: fixed partitions in a fixed order make reruns agree
    dealt = inside.join(parts, "part").repartition(math.ceil(count / 64), "bucket").sortWithinPartitions("bucket")
    order = F.shuffle(F.sequence(F.lit(0), F.col("held").cast("int") - 1), seed)
    return stored(dealt.select("bucket", (F.col("start") + F.col("inside")).alias("start"), order.alias("order")))


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text", names: tuple[str, str] = ("_shard", "_slot"),
            bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """``docs`` with the shard and the slot in it of every row, in random order."""
    kept = [c for c in docs.columns if c not in names]
    column = lambda c: F.col(f"`{c}`")
    nbytes = F.coalesce(F.octet_length(column(text)), F.lit(0)) + OVERHEAD
    read = docs.select(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("record"), nbytes.cast("long").alias("bytes"),
                       F.xxhash64(F.lit(seed), column(text)).alias("drawn"), F.monotonically_increasing_id().alias("read"))
    rows = stored(read.withColumn("draw", F.xxhash64("drawn", "read")).drop("drawn"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    count = max(1, math.ceil(total / bucket_bytes), math.ceil(n / bucket_rows))
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(count).cast("long")))

    nth = F.row_number().over(W.partitionBy("bucket").orderBy("draw", "read"))
    placed = (rows.select("record", "draw", "read", "bucket").withColumn("nth", nth).join(buckets(rows.select("bucket"), count, seed), "bucket")
              .withColumn("place", F.col("start") + F.element_at("order", F.col("nth"))))
    shard = F.expr(f"place * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        *[F.col("record")[f"c{i}"].alias(c) for i, c in enumerate(kept)],
        F.col("shard").cast("int").alias(names[0]), (F.col("place") - first).cast("long").alias(names[1]))


def write_shards(shuffled: DataFrame, path: str, names: tuple[str, str] = ("_shard", "_slot")) -> None:
    """Writes what ``sharded`` gave as Parquet, a folder for each shard; slots rise in every file."""
    shuffled.sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: size, text_crc32, law, shard, slot; grown_shard belongs to another law and is null."""
    s = sharded(docs, text=text, names=("_shard", "_slot"), **options)
    return s.select(
        F.col(doc_id).cast("long").alias(doc_id), text_size(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
