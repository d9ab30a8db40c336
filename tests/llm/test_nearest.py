"""op3's cells: what is sent, and what they return against plain loops over the same buckets."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import nearest


def vectors(n, d=64, seed=8):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype("f4")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def buckets(x, probes=0, tables=16):
    made = [nearest.CrossPolytope(x.shape[1], t, 1) for t in range(tables)]
    return np.stack([c.probes(x, probes) if probes else c.buckets(x)[:, None] for c in made], axis=1)


def plain(ids, x, asked, k=20):
    """(query, rank, id, score), a row of ``x`` after the other."""
    base, wanted, best = buckets(x.astype("f8"))[:, :, 0], buckets(x[asked].astype("f8"), 8), {}
    for q, mine in zip(asked, wanted, strict=True):
        for i in np.flatnonzero((mine == base[:, :, None]).any(axis=(1, 2))):
            if ids[i] != ids[q]:
                score = float((x[i].astype("f8") * x[q].astype("f8")).sum())
                best.setdefault(int(ids[q]), {}).setdefault(int(ids[i]), []).append(score)
    return sorted((q, r, i, s) for q, own in best.items()
                  for r, (s, i) in enumerate(sorted(((max(s), i) for i, s in own.items()), key=lambda a: (-a[0], a[1]))[:k], 1))


def shuffled(spark):
    """The shuffle files that there are, with their sizes."""
    tops = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    found = [os.path.join(d, f) for top in tops for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")]
    return {f: os.path.getsize(f) for f in found if os.path.exists(f)}


def test_a_vector_is_not_sent_for_each_table_and_probe(spark):
    x = vectors(3000)
    df = frame(spark, range(3000), x)
    before = shuffled(spark)
    got = nearest.nearest(df, F.col("id") % 20 == 0)
    assert len(got.collect()) == 150 * 20
    new = sum(size for f, size in shuffled(spark).items() if f not in before)
    assert 0 < new < 8 * x.nbytes  # one table and probe after the other: over 20 times


def odd_vectors():
    x = vectors(700, 16)
    x[100:160] = x[90]  # copies, more than k
    x[200:260] = x[80] * (1 + np.arange(60)[:, None] * np.float32(1e-7))  # nearer than single precision tells apart
    x[300:320] *= np.float32(1e-25)
    x[320:340] *= np.float32(1e15)
    ids = np.arange(700)
    ids[400:440] = 400  # an id with many vectors, a query too
    ids[500:503] = 7
    return ids, x


@pytest.mark.parametrize("rounds", [False, True])
def test_cells_find_what_the_buckets_hold(spark, monkeypatch, rounds):
    ids, x = odd_vectors()
    if rounds:  # many shards, one after the other, with the least score that matters
        monkeypatch.setattr(nearest, "ROUNDS_FROM", 1)
        monkeypatch.setattr(nearest, "FIRST", 4)
    got = nearest.nearest(frame(spark, ids, x), F.col("id") % 20 == 0, cell=100 if rounds else None).collect()
    # copies of one vector: the 21 smallest ids are indexed
    kept = np.r_[0:90, 90, 100:120, 91:100, 160:700]
    want = plain(ids[kept], x[kept], np.flatnonzero(ids[kept] % 20 == 0))
    asked = {q for q, *_ in want}
    assert [tuple(r) for r in sorted(got) if r["query_id"] in asked & set(ids[kept].tolist())] == [r for r in want if r[0] in asked]


def test_a_cell_cuts_what_waits_without_loss(monkeypatch):
    ids, x = odd_vectors()
    kept = np.r_[0:90, 90, 100:120, 91:100, 160:700]
    ids, x = ids[kept], x[kept]
    asked = np.flatnonzero(ids % 20 == 0)
    base, wanted = buckets(x.astype("f8"))[:, :, 0], buckets(x[asked].astype("f8"), 8)
    whole = nearest.ranked_cell(ids[asked], x[asked], wanted, ids, x, base, 20)
    monkeypatch.setattr(nearest, "PENDING", 30)
    monkeypatch.setattr(nearest, "BLOCK", 64)
    cut = nearest.ranked_cell(ids[asked], x[asked], wanted, ids, x, base, 20)
    rows = lambda made: sorted(zip(*(a.tolist() for a in made), strict=True))
    assert rows(cut) == rows(whole)
    one = {q: s for q, r, _, s in plain(ids, x, asked) if r == 20}
    some = nearest.ranked_cell(ids[asked], x[asked], wanted, ids, x, base, 20, np.array([one.get(int(i), -np.inf) for i in ids[asked]]))
    assert set(rows(some)) <= set(rows(whole))
    assert {(q, i) for q, _, i, _ in plain(ids, x, asked)} <= {(q, i) for q, i, _ in rows(some)}
