"""4. Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct shingles (``width`` consecutive words; a
shorter text is one shingle).  Steps:

1. One scan gives each document its set's size and fingerprint and the keys of
   ``bands`` bands of ``rows`` signature coordinates.  The signature is circulant: a
   first permutation places every shingle, and coordinate k is the smallest value
   of one second permutation shifted by k, so a shingle's values for all
   coordinates are neighbours in one table.
2. Documents with equal sets form a class, represented by its smallest id; copies
   never meet pairwise.
3. In every bucket the smallest representative is the hub, and each other member is
   verified against it.  Verified links are contracted to components.
4. Members of one bucket in different components are then compared, so no link
   that the banding finds is lost: buckets that share members form a family,
   families are dealt to cells, and each task compares two cells in memory and
   emits links alone.

Pairs are confirmed on the full sets, made anew from the whole texts (shingles as
64-bit hashes).  Unless given, there are as many bands of 8 rows as it takes to miss a
pair at the threshold with a chance of at most 3e-6 (40 at 0.85, 70 at 0.8), more
similar pairs far less.

Null and empty texts have no set and link with nothing.  Rows that repeat an id are
judged alike; a null id is no component's smallest one, and such rows are not kept in the report, while
``keep_one_each`` keeps one row of every component.  Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.scan import as_id, scan, stored
from quarry.llm.words import NON_SPACE, Texts, chunks, lowered, mix64, run_hashes, words

WIDTH, NUMERATOR, DENOMINATOR = 3, 85, 100
ROWS = 8
#: The chance to miss a pair at the threshold.
MISSED = 3e-6
#: Partners verified together against one text, and members of a family in a cell.
CELL = 256
#: The circulant's universe.
PLACES = 1 << 20


def shingle_sets(texts: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct shingles of every text."""
    w = words(lowered(texts), NON_SPACE)
    first, hashes = run_hashes(w, width)
    owner = np.searchsorted(w.offsets, first, "right") - 1
    for short in range(1, width):
        at = np.flatnonzero(w.counts == short)
        if at.size:
            f, h = run_hashes(w, short)
            mine = np.isin(f, w.offsets[at])
            mine &= w.counts[np.searchsorted(w.offsets, f, "right") - 1] == short
            owner = np.concatenate([owner, np.searchsorted(w.offsets, f[mine], "right") - 1])
            hashes = np.concatenate([hashes, h[mine]])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(owner.size, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    return np.searchsorted(owner, np.arange(texts.n + 1)), hashes


class Circulant:
    """Signatures from two permutations, the second one shifted for each coordinate."""

    def __init__(self, size: int, seed: int = 1):
        table = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:size]]), size)
        self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        at = mix64(shingles ^ self.seed) >> np.uint64(64 - PLACES.bit_length() + 1)
        low = None
        for a in range(0, at.size, 512):  # a long text in steps
            part = self.windows[at[a:a + 512]].min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each signature and band."""
    x = signatures.reshape(-1, bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for j in range(rows):
        total = mix64(total + x[:, :, j] * np.uint64(0x9E3779B97F4A7C15))
    return total.view(np.int64)


def row_key(doc_id: str, text: str):
    """Tells rows apart whose ids repeat."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("row")


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, row, n_shingles, print, bands) of every document; no print and bands without a set."""

    def make():
        sign = Circulant(bands * rows)

        def work(batch):
            n, prints, keys = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for c in chunks(batch.column(2)):
                offsets, hashes = shingle_sets(c, width)
                n[c.first:c.first + c.n] = np.diff(offsets)
                some = np.flatnonzero(np.diff(offsets))
                if not some.size:
                    continue
                sets = [hashes[offsets[i]:offsets[i + 1]] for i in some]
                made = band_keys(np.stack([sign(s) for s in sets]), bands, rows)
                for i, s, k in zip(some, sets, made, strict=True):
                    prints[c.first + i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    keys[c.first + i] = k
            return {"id": batch.column(0), "row": batch.column(1), "n_shingles": n, "print": prints, "bands": keys}
        return work

    return scan(docs, [as_id(doc_id), row_key(doc_id, text), text], make,
                "id long, row long, n_shingles long, print binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, share: tuple[int, int], cell: int = CELL) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough.

    A text with many partners is sent once for every ``cell`` of them."""
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells"))
    dealt = (pairs.join(per, "a").withColumn("cell", F.pmod(F.xxhash64("b"), F.col("cells")).cast("int"))
             .join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "cell", "b", "text"))
    hubs = (texts.withColumnsRenamed({"id": "hub", "text": "hub_text"}).join(per.withColumnRenamed("a", "hub"), "hub")
            .select("hub", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("hub_cell"), "hub_text"))
    top, bottom = share

    def sets(column):
        for c in chunks(column):
            offsets, hashes = shingle_sets(c, width)
            yield from (hashes[offsets[i]:offsets[i + 1]] for i in range(c.n))

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = np.zeros(left.num_rows, bool)
        if right.num_rows:
            mine = next(sets(right.column("hub_text")))
            for i, other in enumerate(sets(left.column("text"))):
                both = np.intersect1d(mine, other, assume_unique=True).size
                keep[i] = bottom * both >= top * (mine.size + other.size - both)
        return left.select(["a", "b"]).filter(pa.array(keep))

    return (dealt.groupBy("a", "cell").cogroup(hubs.groupBy("hub", "hub_cell")).applyInArrow(check, "a long, b long"))


def _sized(share: tuple[int, int]):
    top, bottom = share
    return bottom * F.least("n_a", "n_b") >= top * F.greatest("n_a", "n_b")


def across(members: DataFrame, width: int, share: tuple[int, int], cell: int = CELL) -> DataFrame:
    """Links (a, b) between different components of a family, from (family, id, component, bands, text).

    A family's members are dealt to cells; a task gets two cells and emits links alone,
    no more than join its components (a spanning forest of them).  Pairs that share a
    band and whose sizes allow a link are compared on the full sets."""
    size = members.groupBy("family").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells"))
    dealt = members.join(size, "family").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = dealt.select("family", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", "id", "component", "bands", "text")
    top, bottom = share

    def check(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, cells = t["id"].to_numpy(), t["cell"].to_numpy()
        parts = np.unique(t["component"].to_numpy(), return_inverse=True)[1]  # joined as links are found
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        one = t["low"][0].as_py() == t["high"][0].as_py()
        offsets, hashes = [np.zeros(1, np.int64)], []
        for c in chunks(t["text"]):
            o, h = shingle_sets(c, width)
            offsets.append(o[1:] + offsets[-1][-1])
            hashes.append(h)
        offsets, hashes = np.concatenate(offsets), np.concatenate(hashes)
        n, owner = np.diff(offsets), np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(hashes, kind="stable")
        sorted_hashes, sorted_owner = hashes[order], owner[order]
        a, b = [], []
        for i in range(len(ids)):
            maybe = (parts != parts[i]) & (bottom * np.minimum(n, n[i]) >= top * np.maximum(n, n[i]))
            maybe &= (ids > ids[i]) if one else (cells > cells[i])
            maybe[maybe] = (bands[maybe] == bands[i]).any(axis=1)
            if not maybe.any():
                continue
            mine = hashes[offsets[i]:offsets[i + 1]]
            lo, hi = np.searchsorted(sorted_hashes, mine), np.searchsorted(sorted_hashes, mine, "right")
            at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(sorted_owner[at], minlength=len(ids))
            for j in np.flatnonzero(maybe & (bottom * both >= top * (n + n[i] - both))).tolist():
                if parts[j] != parts[i]:
                    parts[parts == parts[j]] = parts[i]
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("family", "low", "high").applyInArrow(check, "a long, b long")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
            share: tuple[int, int] = (NUMERATOR, DENOMINATOR), bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """(id, row, n_shingles, component_id, survivor) of every document; ``row`` is its ``row_key``,
    ``survivor`` that of the row that stands for its component: the first by (id is null, id, row)."""
    bands = bands or enough_bands(share[0] / share[1], rows)
    signed = stored(signatures(docs, doc_id, text, width, bands, rows))
    # a class of equal sets; its row with the smallest id stands for it
    classes = (signed.where("print is not null").groupBy("print")
               .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("x"))
               .select("print", F.col("x.id").alias("rep"), F.col("x.row").alias("node")))
    members = (signed.select("row", "n_shingles", "bands").join(classes.select("node"), F.col("row") == F.col("node"), "left_semi")
               .groupBy("row").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
               .select(F.col("row").alias("id"), "n", F.explode("bands").alias("bucket")))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("hub")).where("size > 1")
    members = stored(members.join(shared, "bucket").select("bucket", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")))
    texts = (docs.select(row_key(doc_id, text).alias("id"), F.col(text).alias("text"))
             .join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]))

    tried = stored(members.where("id <> hub").withColumnsRenamed({"hub": "a", "id": "b", "hub_n": "n_a", "n": "n_b"})
                        .where(_sized(share)).select("a", "b").distinct())
    links = stored(verified(tried, texts, width, share))
    merged = components(links)

    # what is left: members of one bucket in different components; buckets that share members are a family
    left = (members.join(merged, members.id == merged.node, "left")
            .select("bucket", "id", F.coalesce("component", "id").alias("component")))
    counts = left.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("first"))
    left = stored(left.join(counts.where("low < high"), "bucket").select("id", "component", "first").distinct())
    families = components(left.select(F.col("first").alias("a"), F.col("id").alias("b"))).withColumnsRenamed({"node": "id", "component": "family"})
    keys = signed.select(F.col("row").alias("id"), "bands").join(families.select("id"), "id", "left_semi").dropDuplicates(["id"])
    rest = left.select("id", "component").distinct().join(families, "id").join(keys, "id").join(texts, "id")
    more = stored(across(rest, width, share))
    merged = stored(components(links.union(more)))

    found = classes.join(merged, "node", "left").select("print", "rep", "node", F.coalesce("component", "node").alias("component"))
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"), F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("x"))
    found = found.join(least, "component").select("print", "component_id", F.col("x.node").alias("survivor"))
    return (signed.select("id", "row", "n_shingles", "print").join(found, "print", "left")
            .select("id", "row", "n_shingles", F.when(F.col("print").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.coalesce("survivor", "row").alias("survivor")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: n_shingles, component_id and whether it is the component's smallest id."""
    return (grouped(docs, doc_id, text, **options)
            .select(F.col("id").alias(doc_id), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one row for each group of near duplicates: the first by
    (id is null, id, row key), whatever ids are null or repeated.

    Rows of one id and text are copies of each other, whatever their other columns: one of
    them stays.  They are told apart by their id and a 128-bit hash of the text, so two unlike
    documents never count as one.  Texts without words are linked with nothing: every such row
    stays, repeated ones too."""
    kept = grouped(docs, doc_id, text, **options).where("row = survivor").groupBy(F.col("row").alias("_row")).agg(F.max("n_shingles").alias("_n"))
    column = lambda c: F.col(f"`{c}`")
    rows = docs.select(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_doc"), row_key(doc_id, text).alias("_row"),
                       column(doc_id).cast("long").alias("_id"), F.md5(column(text).cast("binary")).alias("_print")).join(kept, "_row")
    # one pass, grouped as it was joined: a row without words is a group of its own
    rows = rows.withColumn("_own", F.when(F.col("_n") == 0, F.monotonically_increasing_id()))
    stay = rows.dropDuplicates(["_row", "_id", "_print", "_own"])
    return stay.select(*[F.col("_doc")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def miss_chance(similarity: float, bands: int, rows: int = ROWS) -> float:
    """The chance that a pair of that similarity shares no bucket."""
    return math.pow(1 - similarity ** rows, bands)


def enough_bands(similarity: float, rows: int = ROWS, missed: float = MISSED) -> int:
    """The smallest number of bands with which ``miss_chance`` is at most ``missed``."""
    bands = 1
    while miss_chance(similarity, bands, rows) > missed:
        bands += 1
    return bands
