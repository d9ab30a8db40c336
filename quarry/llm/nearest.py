"""3. Approximate nearest neighbours by cross-polytope hashing.

Every table applies its own fast pseudo-rotation (three rounds of random signs and a
Hadamard transform) and assigns a unit vector to the nearest signed axis; ``hashes``
axes in a row name a bucket.  A query probes the ``probes`` best buckets of each
table.  Every row is indexed.

The indexed rows are dealt by a hash to shards and the queries to chunks.  A cell is a shard
and a chunk with the names of their buckets in all tables, so a vector travels once for
each cell and not for each table and probe, and a hot bucket is spread over all shards.
A cell compares every query with all rows of its buckets, keeps what may be among its ``k``
best, ranks that by exact inner products and returns k rows a query at most.  Cells are
bounded in bytes.  Large jobs take the shards in rounds: a query brings the score of its
k-th best so far, below which nothing is returned, and a round's shuffle files are freed,
so neither memory nor disk grows with queries times rows; the compared pairs do (about
``tables * probes / (2 d) ** hashes`` of all).

Equal vectors: only the k + 1 smallest ids of a vector can be among anyone's k
nearest with ties to smaller ids, so the others are left out before hashing; that
loses nothing.  A vector that is null, zero or holds null or non-finite components
takes no part.  With fewer than k candidates found a query returns what there
is, and a query without other vectors returns no row.  An id that repeats
with different vectors keeps its best score.  Rows with a null id take no part.
Dimensions may not differ; shorter ones than a power of two are padded with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.scan import scan, small_batches, stored

#: Production parameters: tables, axes in a bucket's name, probes of a table.
TABLES, HASHES, PROBES = 16, 1, 8
K = 20
#: Bytes of a shard and of a chunk at most, and of the copies that a round sends if they are more than twice the table.
SHARD_BYTES, CHUNK_BYTES, ROUND_BYTES = 40 << 20, 24 << 20, 1 << 30
#: Vectors in a shard at least, unless ``cell`` is given; shards for each core, if there are vectors enough.
LEAST_SHARD, SHARDS_A_CORE = 4096, 4
#: From so many pairs on there are rounds: the first one has a part of the shards, and each four times as many as were done after the one before.
ROUNDS_FROM, FIRST, CHUNKS = 1 << 33, 12, 4
#: Inner products held at a time, as many of a query as are passed over together if the largest one is too small,
#: and found pairs that wait to be cut to each query's best.
BLOCK, RUN, PENDING = 1 << 19, 16, 1 << 21


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of every column."""
    d, n = x.shape
    h = 1
    while h < d:
        x = x.reshape(d // (2 * h), 2, h, n)
        y = np.empty_like(x)
        np.add(x[:, 0], x[:, 1], out=y[:, 0])
        np.subtract(x[:, 0], x[:, 1], out=y[:, 1])
        x = y
        h *= 2
    return x.reshape(d, n) / np.sqrt(d)


class CrossPolytope:
    """The scores of the signed axes for one table: column j is axis j, j + d its opposite."""

    def __init__(self, dimension: int, table: int, hashes: int, seed: int = 7):
        self.d = 1 << max(0, dimension - 1).bit_length()
        self.signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (hashes, 3, self.d))

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        padded = np.zeros((self.d, x.shape[0]))
        padded[:x.shape[1]] = (x / np.linalg.norm(x, axis=1, keepdims=True)).T
        for rounds in self.signs:
            y = padded
            for s in rounds:
                y = hadamard(y * s[:, None])
            out.append(np.concatenate([y.T, -y.T], axis=1))
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        name = np.zeros(x.shape[0], np.int64)
        for s in self.scores(x):
            name = name * 2 * self.d + s.argmax(axis=1)
        return name

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` best buckets of every row by the sum of axis scores, best first."""
        names = np.zeros((x.shape[0], 1), np.int64)
        totals = np.zeros((x.shape[0], 1))
        for s in self.scores(x):
            best = np.argsort(-s, axis=1, kind="stable")[:, :n]
            gain = np.take_along_axis(s, best, axis=1)
            names = (names[:, :, None] * 2 * self.d + best[:, None, :]).reshape(x.shape[0], -1)
            totals = (totals[:, :, None] + gain[:, None, :]).reshape(x.shape[0], -1)
            first = np.argsort(-totals, axis=1, kind="stable")[:, :n]
            names, totals = np.take_along_axis(names, first, axis=1), np.take_along_axis(totals, first, axis=1)
        return names


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _name_type(dimension: int, hashes: int) -> np.dtype:
    """The smallest type that holds every bucket's name."""
    return np.min_scalar_type((2 << max(0, dimension - 1).bit_length()) ** hashes - 1)


def _hashed(df: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """(id, v, b): the vector packed as ``_vector_type``, and the names of its bucket (or of its
    probed buckets) in every table, packed as ``_name_type``."""
    kind = _vector_type(df)

    def make():
        made = {}

        def work(batch):
            x = matrix(batch.column(1))
            d = x.shape[1]
            names = []
            step = max(16, (1 << 16) // d)  # rows whose scores stay in the processor's cache
            for t in range(tables):
                if (t, d) not in made:
                    made[t, d] = CrossPolytope(d, t, hashes)
                cp = made[t, d]
                parts = [x[a:a + step] for a in range(0, len(x), step)]
                names.append(np.concatenate([cp.probes(p, probes) if probes else cp.buckets(p)[:, None] for p in parts]))
            names = np.stack(names, axis=1).astype(_name_type(d, hashes))
            return {"id": batch.column(0), "v": _packed(x.astype(kind)), "b": _packed(names)}
        return work

    return scan(df, ["id", "v"], make, "id long, v binary, b binary")


def _vector_type(df: DataFrame) -> str:
    """Floats stay as they are; any other components are doubles."""
    return "<f4" if dict(df.dtypes)["v"] == "array<float>" else "<f8"


def _packed(x: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    size = x[:1].nbytes
    offsets = np.arange(0, size * len(x) + 1, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The rows that ``_packed`` made."""
    parts = []
    for c in column.chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind).reshape(len(c), -1))
    return np.concatenate(parts)


def ranked(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of every query's ``k`` best, itself left out.

    The scores are sums in one fixed order, whatever else is in the cell."""
    rough = q @ c.T
    rough[q_ids[:, None] == c_ids[None, :]] = -np.inf
    out = []
    for i in range(len(q)):
        row = rough[i]
        at = np.arange(row.size)
        if row.size > k:
            least = np.partition(row, row.size - k)[row.size - k]
            at = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else row > -np.inf)
        at = at[row[at] > -np.inf]
        exact = (c[at] * q[i]).sum(axis=1)
        best = np.lexsort((c_ids[at], -exact))[:k]
        out.append((np.full(best.size, q_ids[i]), c_ids[at[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def exact_best(q_ids, q, c_ids, c, at_q, at_c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, of the candidate, score) of every query's ``k`` best among the given
    pairs of places, by (score, id); a query itself is left out, and an id counts once, by its best score.

    The scores are sums in one fixed order, whatever else is in the cell."""
    other = q_ids[at_q] != c_ids[at_c]
    at_q, at_c = at_q[other], at_c[other]
    score = np.empty(at_q.size)
    step = max(1, BLOCK // q.shape[1])
    for a in range(0, at_q.size, step):
        score[a:a + step] = (c[at_c[a:a + step]].astype(np.float64) * q[at_q[a:a + step]].astype(np.float64)).sum(axis=1)
    order = np.lexsort((-score, c_ids[at_c], at_q))
    at_q, at_c, score = at_q[order], at_c[order], score[order]
    first = np.ones(at_q.size, bool)
    first[1:] = (at_q[1:] != at_q[:-1]) | (c_ids[at_c[1:]] != c_ids[at_c[:-1]])
    at_q, at_c, score = at_q[first], at_c[first], score[first]
    order = np.lexsort((c_ids[at_c], -score, at_q))
    at_q, at_c, score = at_q[order], at_c[order], score[order]
    keep = _place(at_q) < k
    return at_q[keep], at_c[keep], score[keep]


def _place(sorted_keys: np.ndarray) -> np.ndarray:
    """Every row's place, from 0, among the rows of its key."""
    new = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if sorted_keys.size else np.zeros(0, np.int64)
    return np.arange(sorted_keys.size) - np.repeat(new, np.diff(np.append(new, sorted_keys.size)))


class Best:
    """Pairs of places (query, candidate) of a cell that may be among a query's ``k`` best.

    ``rough`` scores are single-precision products of scaled vectors, off by ``error`` at most.
    A pair is dropped only if so many rows are better beyond any error that k other ids are among them."""

    def __init__(self, q_ids, q, c_ids, c, k: int, least):
        self.q_ids, self.q, self.c_ids, self.c, self.k, self.exact_least = q_ids, q, c_ids, c, k, least
        # the query itself may be among the best, and an id with all its vectors
        self.enough = (k + 1) * int(np.unique(c_ids, return_counts=True)[1].max())
        self.error = (q.shape[1] + 8) * 2.0 ** -24
        self.top = np.float64(max(c.max(), -c.min()))
        self.norm = max(np.linalg.norm(c[a:a + 4096] / self.top, axis=1).max() for a in range(0, len(c), 4096))
        self.q_top = np.maximum(q.max(axis=1), -q.min(axis=1)).astype(np.float64)
        self.q_norm, self.unit = np.empty(len(q)), np.empty(q.shape, np.float32)
        for a in range(0, len(q), 4096):
            unit = q[a:a + 4096] / self.q_top[a:a + 4096, None]
            self.q_norm[a:a + 4096] = np.linalg.norm(unit, axis=1)
            self.unit[a:a + 4096] = unit / self.q_norm[a:a + 4096, None]
        self.least = self._rough(np.arange(len(q)), least) - np.float32(2 * self.error)
        self.found, self.waiting, self.n = [np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)], [], 0

    def _rough(self, at_q: np.ndarray, score: np.ndarray) -> np.ndarray:
        return (score / self.q_top[at_q] / self.q_norm[at_q] / self.top / self.norm).astype(np.float32)

    def scaled(self, at: np.ndarray) -> np.ndarray:
        """The candidates at these places, the longest one of the cell having length 1."""
        out = np.empty((at.size, self.c.shape[1]), np.float32)
        for a in range(0, at.size, 4096):
            out[a:a + 4096] = self.c[at[a:a + 4096]] / self.top / self.norm
        return out

    def compare(self, at_q: np.ndarray, at_c: np.ndarray, c: np.ndarray) -> None:
        """All pairs of these queries and candidates, whose ``scaled`` rows are ``c``."""
        height = min(at_q.size, 1024)
        width = max(RUN, BLOCK // height)
        for a in range(0, at_q.size, height):
            rows = at_q[a:a + height]
            unit = self.unit[rows].T
            for b in range(0, len(c), width):
                self._take(rows, at_c[b:b + width], c[b:b + width] @ unit)

    def _take(self, rows, at_c, rough) -> None:
        """``rough``: a row for each candidate, a column for each query."""
        least, n = self.least[rows], at_c.size
        runs = n // RUN
        tops = rough[:runs * RUN].reshape(runs, RUN, rows.size).max(axis=1)
        run, i = np.nonzero(tops >= least)
        if i.size > tops.size // 4 and n > 2 * self.enough:  # early on: first each query's best of these
            last = np.partition(rough.T, n - self.enough, axis=1)[:, n - self.enough]
            self.least[rows] = least = np.maximum(least, last - np.float32(2 * self.error))
            run, i = np.nonzero(tops >= least)
        j = run[:, None] * RUN + np.arange(RUN)
        score = rough[j, i[:, None]]
        hit = np.nonzero(score >= least[i][:, None])
        rest = np.nonzero(rough[runs * RUN:] >= least)
        if hit[0].size + rest[0].size == 0:
            return
        self.waiting.append((rows[np.append(i[hit[0]], rest[1])], at_c[np.append(j[hit], rest[0] + runs * RUN)],
                             np.append(score[hit], rough[rest[0] + runs * RUN, rest[1]])))
        self.n += hit[0].size + rest[0].size
        if self.n > max(PENDING, self.found[0].size):
            self._cut()

    def _cut(self) -> None:
        at_q, at_c, rough = (np.concatenate([x, *(w[i] for w in self.waiting)]) for i, x in enumerate(self.found))
        self.waiting, self.n = [], 0
        still = rough >= self.least[at_q]
        at_q, at_c, rough = at_q[still], at_c[still], rough[still]
        first = np.unique(at_q * np.int64(len(self.c)) + at_c, return_index=True)[1]
        at_q, at_c, rough = at_q[first], at_c[first], rough[first]
        bits = rough.view(np.int32)
        falling = np.where(bits < 0, bits & 0x7FFFFFFF, ~bits).astype(np.int64)  # in the order of -rough
        order = np.argsort((at_q.astype(np.int64) << 32) + falling)
        at_q, at_c, rough = at_q[order], at_c[order], rough[order]
        last = np.flatnonzero(_place(at_q) == self.enough - 1)
        self.least[at_q[last]] = np.maximum(self.least[at_q[last]], rough[last] - np.float32(2 * self.error))
        still = rough >= self.least[at_q]
        self.found = [at_q[still], at_c[still], rough[still]]
        if self.found[0].size > max(PENDING, 2 * (self.k + 1) * len(self.q)):  # very many are as good as equal, or of one id
            at_q, at_c, score = exact_best(self.q_ids, self.q, self.c_ids, self.c, *self.found[:2], self.k)
            rough = self._rough(at_q, score)
            last = np.flatnonzero(_place(at_q) == self.k - 1)
            self.least[at_q[last]] = np.maximum(self.least[at_q[last]], rough[last] - np.float32(2 * self.error))
            self.found = [at_q, at_c, rough]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of every query's ``k`` best."""
        self._cut()
        at_q, at_c, score = exact_best(self.q_ids, self.q, self.c_ids, self.c, *self.found[:2], self.k)
        some = score >= self.exact_least[at_q]
        at_q, at_c, score = at_q[some], at_c[some], score[some]
        return self.q_ids[at_q], self.c_ids[at_c], score


def ranked_cell(q_ids, q, probes, c_ids, c, buckets, k: int, least=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of every query's ``k`` best among the candidates in a bucket that it
    probes; ``probes`` has a row for each query and table, ``buckets`` a row for each candidate.
    Scores below a query's ``least`` do not matter."""
    best = Best(q_ids, q, c_ids, c, k, np.full(len(q), -np.inf) if least is None else least)
    for t in range(buckets.shape[1]):
        c_order = np.argsort(buckets[:, t], kind="stable").astype(np.int32)
        named, scaled = buckets[c_order, t], best.scaled(c_order)
        asked = probes[:, t].ravel()
        asked_order = np.argsort(asked, kind="stable")
        names, starts = np.unique(asked[asked_order], return_index=True)
        low, high = np.searchsorted(named, names), np.searchsorted(named, names, "right")
        for a, z, lo, hi in zip(starts, [*starts[1:], asked.size], low, high, strict=True):
            if lo < hi:
                best.compare((asked_order[a:z] // probes.shape[2]).astype(np.int32), c_order[lo:hi], scaled[lo:hi])
    return best.best()


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
            tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, cell: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which
    ``is_query`` (a column expression over ``id``) holds.  ``cell``: about how many vectors a shard and a chunk of
    queries hold, else as many as their bytes and the cores allow; it does not change what is found."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = usable(vectors, vec_id, embedding).dropDuplicates(["id", "v"])
    kind, first = _vector_type(v), W.partitionBy("v").orderBy("id")
    base = v.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n")
    base = stored(_hashed(base, tables, hashes, 0))
    query = stored(_hashed(v.where(is_query), tables, hashes, probes))
    one = query.select(F.length("v").alias("v"), F.length("b").alias("b")).first() or {"v": 1, "b": 1}
    size, q_size = one["v"] + tables, one["v"] + one["b"]
    n_base, n_query = base.count(), query.count()
    large = n_base * n_query >= ROUNDS_FROM
    a_shard = cell or max(1, min(SHARD_BYTES // size, max(LEAST_SHARD, n_base // (SHARDS_A_CORE * spark.sparkContext.defaultParallelism))))
    a_chunk = cell or max(1, min(CHUNK_BYTES // q_size, n_query // CHUNKS if large else n_query))
    shards, chunks = max(1, -(-n_base // a_shard)), max(1, -(-n_query // a_chunk))
    sent = chunks * n_base * size // shards + n_query * q_size  # for each shard
    most = max(1, max(ROUND_BYTES, 2 * n_base * size) // max(1, sent))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    each = lambda a, z: F.explode(F.sequence(F.lit(a), F.lit(z)))
    names = _name_type(one["v"] // np.dtype(kind).itemsize, hashes)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rank(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        wanted = _unpacked(queries["q_b"], names).reshape(queries.num_rows, tables, -1)
        made = ranked_cell(queries["q_id"].to_numpy(), _unpacked(queries["q_v"], kind), wanted,
                           candidates["id"].to_numpy(), _unpacked(candidates["v"], kind), _unpacked(candidates["b"], names),
                           k, queries["q_least"].to_numpy())
        return pa.table(list(made), schema=schema)

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, done, more = None, 0, max(1, shards // FIRST) if large else shards
    while True:
        z = min(done + min(more, most), shards)
        asked = query.withColumn("least", F.lit(float("-inf")))
        if best is not None:
            last = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("last"))
            asked = asked.join(last, "id", "left").withColumn("least", F.coalesce("last", "least"))
        left = base.select(deal(shards).alias("i"), each(0, chunks - 1).alias("j"), "id", "v", "b").where(F.col("i").between(done, z - 1))
        right = asked.select(each(done, z - 1).alias("q_i"), deal(chunks).alias("q_j"), *[F.col(c).alias(f"q_{c}") for c in ("id", "v", "b", "least")])
        found = (left.groupBy("i", "j").cogroup(right.groupBy("q_i", "q_j"))
                 .applyInArrow(rank, "query_id long, vec_id long, score double"))
        if best is not None:
            found = found.union(best.select("query_id", "vec_id", "score"))
        best = (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        if z == shards:
            return best
        best, done, more = stored(best), z, 3 * z


def recall(found: DataFrame, vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
           block: int = 4096) -> DataFrame:
    """One row: the share of the true ``k`` nearest that ``found`` holds, by brute force
    over all rows in blocks of queries (a check of the index, not part of a search)."""
    v = usable(vectors, vec_id, embedding)
    rows = v.where(is_query).collect()
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = None
    for a in range(0, len(rows), block):
        ids = np.array([r.id for r in rows[a:a + block]])
        q = np.array([r.v for r in rows[a:a + block]], np.float64)

        def make(ids=ids, q=q):
            def work(batch):
                made = ranked(ids, q, batch.column(0).to_numpy(), matrix(batch.column(1)), k)
                return dict(zip(("query_id", "vec_id", "score"), made, strict=True))
            return work

        part = scan(v, ["id", "v"], make, "query_id long, vec_id long, score double")
        truth = part if truth is None else truth.union(part)
    truth = truth.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    hit = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
