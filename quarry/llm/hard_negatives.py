"""13. Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows are put in the order (dimension, label, Hilbert index of the vector's cell) by a
range partitioning on that whole key, packed into blocks of ``block`` rows of one label
and written as Parquet, each block with its zone map: the least and largest value of
every dimension, its label and its smallest id.  Zone maps are packed into pages.

An anchor's inner product with any row of a block lies between the sums of the smaller
and of the larger products with the two ends of every dimension (interval arithmetic).
So a window of scores must read a block only if that interval meets the window, and
only if its upper end reaches the anchor's last place so far.  Four searches follow:

1. the most promising block of each page with the anchor's label gives a bound for
   its last positive; 2. all other blocks of the label that may hold a better one
   are read; 3. and 4. do the same for the windows of the positives (between 50 and 95 %
   of their scores) over the blocks of other labels.

Anchors go in chunks to the pages, and what a block must answer goes to the block: rows of
bounded size all along, so a label or a vector that holds a third of all rows is many
blocks of work, none larger than others.  Blocks of equal vectors have an exact bound
and ties go to smaller ids, so only the blocks with the smallest ids are read.  Nothing is
left out that a window could need: results equal brute force.

Components become floor(scale * x), x as double, held to ±sqrt(2 ** 62 / dimensions) so
that a score always fits in a long; scores are exact integers.  Rows with a null label or
vector, or a null or non-finite component, take no part; a vector without components is
one of dimension 0 and scores 0.  A row is compared with rows of its own dimension only.
A row with a null id is a candidate, after all others among ties, and comes back
with a null id; an id that repeats names rows of their own, an anchor each.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.scan import small_batches, stored

#: Production parameters: rows of a block, zone maps of a page, anchors of a chunk, bits of a Hilbert cell in each dimension.
BLOCK, PAGE, CHUNK, BITS = 256, 256, 256, 2
#: Fixed values of the contract: scale, positives, negatives, the window in hundredths of the positive's score.
SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 3, 50, 95
#: Beyond any score and any place; the id that stands for null.
LOW, HIGH, NO_ID = -(1 << 62) - 1, (1 << 62) + 1, (1 << 63) - 1

PACKED = "dim int, label long, anchor boolean, id long, vector binary, cell binary"
BLOCKS = "block long, dim int, label long, size int, first_id long, ids binary, anchors binary, vectors binary, least binary, most binary"
PAGES = "page long, dim int, blocks binary, labels binary, first_ids binary, least binary, most binary"
WORK = "block long, label long, dim int, rows binary, vectors binary, low binary, high binary, bar binary, bar_id binary"
ANCHORS = "anchor long, chunk long, id long, label long, dim int, vector binary"
FOUND = "anchor long, window int, score long, id long, row long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of every row of ``cells`` (n x d, values below 2 ** bits) as d * bits binary digits, first ones first.

    Skilling's transform, on whole columns: undo the excess rotations and reflections level by level, then Gray-decode."""
    x = cells.astype(np.int64).T.copy()
    d = x.shape[0]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(d):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] & (1 << level)) > 0, (1 << level) - 1, 0) if d else 0
    x ^= flip
    digits = [(x[i] >> level) & 1 for level in range(bits - 1, -1, -1) for i in range(d)]
    return np.stack(digits, axis=1).astype(np.uint8) if digits else np.zeros((cells.shape[0], 0), np.uint8)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products a @ b.T, in floating point where no sum can pass its exact integers."""
    if a.size and b.size:
        most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
        for kind, exact in ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53)):
            if most < exact:
                return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval in which the products of each row of ``a`` with any vector between ``least`` and ``most`` lie."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, least) + products(down, most), products(up, most) + products(down, least)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _out(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema(spark, ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in spark.createDataFrame([], ddl).dtypes])


def _mapped(df: DataFrame, work, ddl: str) -> DataFrame:
    """``df`` through ``work``, a generator from rows (dicts) to rows."""
    schema = _schema(df.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in work(_batches(batches)):
            held.append(row)
            size += 64 + sum(len(v) for v in row.values() if isinstance(v, bytes))
            if size > 1 << 21:
                yield _out(schema, held)
                held, size = [], 0
        yield _out(schema, held)

    return df.mapInArrow(run, ddl)


def packed(rows: DataFrame, spread: dict[int, float], scale: int, bits: int) -> DataFrame:
    """(dim, label, anchor, id, vector, cell) from (label, anchor, id, vector); ``spread``
    has each dimension's root mean square component, the width of two Hilbert cells."""
    schema = _schema(rows.sparkSession, PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            dims = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            vectors, cells = [b""] * b.num_rows, [b""] * b.num_rows
            for d in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == d)
                x = np.floor(flat[starts[at][:, None] + np.arange(d)] * scale)
                most = np.floor(np.sqrt(2.0 ** 62 / d))
                x = np.clip(x, -most, most).astype(np.int64)
                width = 4 * max(spread.get(int(d), 1.0) * scale, 1.0) / (1 << bits)
                digits = hilbert(np.clip(np.floor(x / width) + (1 << (bits - 1)), 0, (1 << bits) - 1), bits)
                for i, v, c in zip(at, x, np.packbits(digits, axis=1), strict=True):
                    vectors[i], cells[i] = v.tobytes(), c.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), b.column("label"), b.column("anchor"), b.column("id"),
                                              pa.array(vectors, pa.binary()), pa.array(cells, pa.binary())], schema=schema)

    return rows.select("label", "anchor", "id", "vector").mapInArrow(run, PACKED)


def block_table(rows: DataFrame, size: int) -> DataFrame:
    """The blocks of ``packed`` rows in Hilbert order; a row's name is its block's plus its place there."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        at = TaskContext.get().partitionId() << 33
        held = []

        def block() -> dict:
            nonlocal at
            d = held[0]["dim"]
            v = np.frombuffer(b"".join(r["vector"] for r in held), np.int64).reshape(len(held), d)
            ids = np.array([r["id"] for r in held], np.int64)
            made = {"block": at, "dim": d, "label": held[0]["label"], "size": len(held), "first_id": int(ids.min()), "ids": ids.tobytes(),
                    "anchors": np.array([r["anchor"] for r in held], bool).tobytes(), "vectors": v.tobytes(),
                    "least": v.min(axis=0).tobytes(), "most": v.max(axis=0).tobytes()}
            at += len(held)
            held.clear()
            return made

        for r in rows:
            if held and (len(held) == size or (held[0]["dim"], held[0]["label"]) != (r["dim"], r["label"])):
                yield block()
            held.append(r)
        if held:
            yield block()

    order = ["dim", "label", "cell", "id", "salt"]
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(_mapped(ranged.drop("cell", "salt"), work, BLOCKS))


def page_table(blocks: DataFrame, size: int) -> DataFrame:
    """Zone maps of up to ``size`` blocks of one dimension in a row."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        at = TaskContext.get().partitionId() << 33
        held: list[dict] = []

        def page() -> dict:
            nonlocal at
            ints = lambda k: np.array([r[k] for r in held], np.int64).tobytes()
            made = {"page": at, "dim": held[0]["dim"], "blocks": ints("block"), "labels": ints("label"), "first_ids": ints("first_id"),
                    "least": b"".join(r["least"] for r in held), "most": b"".join(r["most"] for r in held)}
            at += 1
            held.clear()
            return made

        for r in rows:
            if held and (len(held) == size or held[0]["dim"] != r["dim"]):
                yield page()
            held.append(r)
        if held:
            yield page()

    return stored(_mapped(blocks.select("block", "dim", "label", "first_id", "least", "most"), work, PAGES))


def anchor_table(blocks: DataFrame, size: int) -> DataFrame:
    """(anchor, chunk, id, label, dim, vector) of the rows marked as anchors; neighbours on the curve share a chunk of up to ``size``."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        at, n = TaskContext.get().partitionId() << 33, 0
        for r in rows:
            v = np.frombuffer(r["vectors"], np.int64).reshape(r["size"], r["dim"])
            ids = np.frombuffer(r["ids"], np.int64)
            for i in np.flatnonzero(np.frombuffer(r["anchors"], bool)):
                yield {"anchor": r["block"] + int(i), "chunk": at + n // size, "id": int(ids[i]), "label": r["label"], "dim": r["dim"], "vector": v[i].tobytes()}
                n += 1

    return stored(_mapped(blocks.select("block", "dim", "label", "size", "ids", "anchors", "vectors"), work, ANCHORS))


def chosen(anchors: DataFrame, pages: DataFrame, same: bool, first: bool) -> DataFrame:
    """What each block must answer: the anchors (with low, high, bar and bar_id for each window) whose windows it can serve.

    ``first``: of every page the block with the highest bound alone; else all others that reach a bar."""
    listed = pages.groupBy("dim").agg(F.collect_list("page").alias("pages"))
    every = listed.agg(F.map_from_entries(F.collect_list(F.struct("dim", "pages"))).alias("every")).scalar()
    one = F.struct("anchor", "label", "vector", "low", "high", "bar", "bar_id")
    chunks = anchors.groupBy("dim", "chunk").agg(F.array_sort(F.collect_list(one)).alias("held"))
    met = chunks.withColumn("page", F.explode(every[F.col("dim")])).join(pages.drop("dim"), "page")

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            held, d = r["held"], r["dim"]
            ints = lambda k: np.frombuffer(r[k], np.int64)
            a = np.frombuffer(b"".join(h["vector"] for h in held), np.int64).reshape(len(held), d)
            blocks, labels, ids = ints("blocks"), ints("labels"), ints("first_ids")
            low, high, bar, bar_id = (np.array([h[k] for h in held], np.int64) for k in ("low", "high", "bar", "bar_id"))
            least, most = bounds(a, ints("least").reshape(len(blocks), d), ints("most").reshape(len(blocks), d))
            own = np.array([h["label"] for h in held], np.int64)
            fits = (own[:, None] == labels) == same
            meets = (least[:, :, None] <= high[:, None, :]) & (most[:, :, None] >= low[:, None, :])
            best = np.where(fits & meets.any(axis=2), most, LOW).argmax(axis=1)
            reaches = (most[:, :, None] > bar[:, None, :]) | ((most[:, :, None] == bar[:, None, :]) & (ids[None, :, None] <= bar_id[:, None, :]))
            needed = fits & (meets.any(axis=2) if first else (meets & reaches).any(axis=2))
            picked = np.arange(len(blocks)) == best[:, None]
            needed &= picked if first else ~picked
            names = np.array([h["anchor"] for h in held], np.int64)
            for j in np.flatnonzero(needed.any(axis=0)):
                i = needed[:, j]
                yield {"block": int(blocks[j]), "label": int(labels[j]), "dim": d, "rows": names[i].tobytes(), "vectors": a[i].tobytes(),
                       "low": low[i].tobytes(), "high": high[i].tobytes(), "bar": bar[i].tobytes(), "bar_id": bar_id[i].tobytes()}

    return _mapped(met, work, WORK)


def answered(work: DataFrame, blocks: DataFrame, keep: int) -> DataFrame:
    """(anchor, window, score, id, row): each block's first ``keep`` rows in each window of the anchors that need it."""
    met = work.join(blocks.select("block", "size", "ids", F.col("vectors").alias("candidates")), "block")

    def run(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            d, n = r["dim"], r["size"]
            ints = lambda k: np.frombuffer(r[k], np.int64)
            names, ids = ints("rows"), ints("ids")
            by_id = np.argsort(ids, kind="stable")
            place = r["block"] + by_id
            low, high, bar, bar_id = (ints(k).reshape(len(names), -1) for k in ("low", "high", "bar", "bar_id"))
            s = products(ints("vectors").reshape(len(names), d), ints("candidates").reshape(n, d)[by_id])
            s[place[None, :] == names[:, None]] = LOW
            order = np.argsort(-s, axis=1, kind="stable")
            s = np.take_along_axis(s, order, axis=1)
            made = []
            for w in range(low.shape[1]):
                at = (s > high[:, w, None]).sum(axis=1)[:, None] + np.arange(keep)
                score = np.take_along_axis(s, np.minimum(at, n - 1), axis=1)
                col = np.take_along_axis(order, np.minimum(at, n - 1), axis=1)
                cand = ids[by_id][col]
                good = (at < n) & (score >= low[:, w, None]) & (score > LOW)
                good &= (score > bar[:, w, None]) | ((score == bar[:, w, None]) & (cand <= bar_id[:, w, None]))
                i = np.nonzero(good)[0]
                made.append((names[i], np.full(len(i), w, np.int32), score[good], cand[good], place[col[good]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=["anchor", "window", "score", "id", "row"])

    return met.mapInArrow(lambda batches: run(_batches(batches)), FOUND)


def best(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of every anchor's window, with their rank from 1."""
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def barred(anchors: DataFrame, found: DataFrame, keep: int) -> DataFrame:
    """``anchors`` whose bars are the last of ``keep`` places found; with fewer, the window's own low end."""
    last = best(found, keep).where(F.col("rank") == keep).groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("window", F.struct("score", "id")))).alias("last"))
    at = lambda i: F.coalesce(F.col("last"), F.create_map().cast("map<int,struct<score:bigint,id:bigint>>"))[i.cast("int")]
    return anchors.join(last, "anchor", "left").withColumns({
        "bar": F.transform("low", lambda x, i: F.coalesce(at(i)["score"], x)),
        "bar_id": F.transform("low", lambda x, i: F.coalesce(at(i)["id"], F.lit(NO_ID)))}).drop("last")


def searched(anchors: DataFrame, pages: DataFrame, blocks: DataFrame, same: bool, keep: int) -> DataFrame:
    """The first ``keep`` rows of every window of ``anchors`` (arrays low and high), of the same label or of others."""
    start = anchors.withColumns({"bar": F.col("low"), "bar_id": F.transform("low", lambda x: F.lit(NO_ID))})
    near = stored(answered(chosen(start, pages, same, True), blocks, keep))
    rest = answered(chosen(barred(anchors, near, keep), pages, same, False), blocks, keep)
    return best(near.unionByName(rest), keep)


def hard_negatives(table: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
                   block: int = BLOCK, page: int = PAGE, chunk: int = CHUNK, bits: int = BITS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` (a condition) marks the rows whose ``positives`` first rows of the same label set
    the windows: negatives score from ``least`` to ``most`` hundredths of the positive's score."""
    small_batches(table.sparkSession)
    rows = table.select((F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
                        F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("label is not null and vector is not null").where(F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x / F.size("vector"))
    spread = {r[0]: float(r[1]) for r in rows.groupBy(F.size("vector")).agg(F.sqrt(F.avg(squares))).collect()}
    blocks = block_table(packed(rows, spread, scale, bits), block)
    pages = page_table(blocks, page)
    anchors = anchor_table(blocks, chunk)
    near = searched(anchors.withColumns({"low": F.array(F.lit(LOW + 1)), "high": F.array(F.lit(HIGH))}), pages, blocks, True, positives)
    near = stored(near.select("anchor", F.col("rank").alias("nth"), F.col("id").alias("positive"), F.col("score").alias("positive_score")))
    # whole hundredths and the rest apart: no product leaves the longs
    share = lambda k, more: F.expr(f"((positive_score - pmod(positive_score, 100)) div 100) * {k} + (pmod(positive_score, 100) * {k} + {more}) div 100")
    windows = near.withColumns({"window": F.col("nth") - 1, "low": share(least, 99), "high": share(most, 0)}).where("low <= high")
    by_window = F.map_from_entries(F.collect_list(F.struct("window", F.struct("low", "high"))))
    end = lambda k, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.col("w")[i][k], F.lit(none)))
    held = stored(anchors.join(windows.groupBy("anchor").agg(by_window.alias("w")), "anchor")
                  .withColumns({"low": end("low", HIGH), "high": end("high", LOW)}).drop("w"))
    far = searched(held, pages, blocks, False, negatives)
    asked = windows.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (far.select("anchor", "window", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score")).join(asked, ["anchor", "window"])
            .select(named("anchor_id").alias("anchor_id"), named("positive").alias("positive_id"), "rank", named("negative").alias("negative_id"), "positive_score", "negative_score"))
