"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, hot groups and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import conversation_repair, hard_negatives, sharding
from quarry.plans.catalog.registry import Tables

DOCS = "doc_id long, text string, _shard string, draw string, bucket int, place long, record string, bytes int"
TURNS = "conv_id long, turn long, role string, text string, at long, conv string, piece int, mark string, kind string"
VECTORS = "vec_id long, embedding array<float>, label int, block long, anchor string, id long, dim int, score double"


# sharding

def shards(df, **options):
    return [r.asDict() for r in sharding.sharded(df, **options).collect()]


def test_sharding_is_a_permutation_with_even_gapless_shards(spark):
    texts = [None, "", "x" * 200_000, *["same"] * 40, *[f"t{i}" for i in range(60)]]
    df = spark.createDataFrame([(None if i % 9 == 0 else i % 30, t, "s", "d", 1, 2, "r", 3) for i, t in enumerate(texts)], DOCS)
    got = shards(df, shards=7, bucket_rows=10)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["draw"], r["place"], r["record"]) for r in got) == sorted(
        (i % 9 == 0, 0 if i % 9 == 0 else i % 30, t or "", "d", 2, "r") for i, t in enumerate(texts))
    counts = {}
    for r in got:
        counts.setdefault(r["_shard"], []).append(r["_slot"])
    assert set(counts) == set(range(7)) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())


def test_sharding_of_identical_rows_spreads_them_over_buckets(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    rows = sharding.sharded(df, shards=16, bucket_rows=100)
    n = [r["count"] for r in rows.groupBy("_shard").count().collect()]
    assert n == [250] * 16 and rows.select("_shard", "_slot").distinct().count() == 4000


def test_sharding_order_is_random_seeded_and_agrees_on_reruns(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    place = lambda **o: {r["doc_id"]: r["_shard"] * 10_000 + r["_slot"] for r in shards(df, shards=4, bucket_rows=300, **o)}
    one, two, other = place(), place(), place(seed=5)
    assert one == two != other
    order = sorted(one, key=one.get)
    assert abs(np.corrcoef(order, np.arange(3000))[0, 1]) < 0.08
    # pairs of neighbours rise as often as they fall
    assert 0.45 < np.mean(np.diff(order) > 0) < 0.55


def test_sharding_writes_files_in_slot_order(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(sharding.sharded(df, shards=3, bucket_rows=50), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and {r[0] for r in back.select("_shard").distinct().collect()} == {0, 1, 2}
    for f in (tmp_path / "out").glob("*/*.parquet"):
        slots = [r[0] for r in spark.read.parquet(str(f)).select("_slot").collect()]
        assert slots == sorted(slots)


def test_shard_report(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é!"), (None, "a")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sharding.shard_report(df).collect()}
    assert [(got[i]["size"], got[i]["text_crc32"]) for i in (1, 2, 3)] == [(1, 0), (1, 0), (4, zlib.crc32("é!".encode()))]
    assert {(r["law"], r["grown_shard"]) for r in got.values()} == {("rows", None)}
    assert sharding.shard_report(df.limit(0)).collect() == []


# conversation repair

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NEW = (("u", "user"), ("a", "assistant"))


def damage(rows):
    out = []
    for c, t, r, x in rows:
        n = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{n(c)}:{n(t)}".encode()) % 20
        r, x = n(r), n(x)
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for _, _, r, x in rows:
        end = x.rstrip("\t\n\x0b\x0c\r ")
        found.append("blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((r, x))
    return found


def cheapest(rows, found):
    """All edit sequences of least cost by grammar state, turn by turn, with their results."""
    def inserted(cur):
        for _ in range(4):
            for s, c, a, o in [(s, c, a, o) for s, d in cur.items() for (c, a), o in d.items()]:
                for ch, role in NEW:
                    if (s, ch) in STEP:
                        cur.setdefault(STEP[s, ch], {}).setdefault((c + 2, a + "I"), (*o, role + ":"))
            cur = least(cur)
        return cur

    def least(cur):
        return {s: {k: v for k, v in d.items() if k[0] == min(c for c, _ in d)} for s, d in cur.items()}

    cur = {"": {(0, ""): ()}}
    for (_, _, r, x), f in zip(rows, found, strict=True):
        new = {}
        for s, d in inserted(cur).items():
            for (c, a), o in d.items():
                new.setdefault(s, {}).setdefault((c + 3, a + "D"), o)
                if f in ("blank", "duplicate"):
                    continue
                late = f == "truncated"
                if (s, r[:1]) in STEP:
                    new.setdefault(STEP[s, r[:1]], {}).setdefault((c + late, a + "K"), (*o, f"{r}:{x}"))
                for ch, role in NEW:
                    if (s, ch) in STEP:
                        new.setdefault(STEP[s, ch], {}).setdefault((c + 2 + late, a + "R"), (*o, f"{role}:{x}"))
        cur = least(new)
    return min(((k, o) for s, d in inserted(cur).items() if s in ("", "a") for k, o in d.items()), key=lambda z: z[0])


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    found = faults(rows)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    (cost, audit), lines = cheapest(rows, found)
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", " ", "", None, "A b!", "\t\n"]
    rows = []
    for c in [None, *range(n)]:
        turns = rng.sample(range(-5, 12), rng.randint(1, 8))
        for k, t in enumerate(turns):
            rows.append((c, None if k == 0 and rng.random() < 0.2 else t, rng.choice(["user", "assistant", "system", "tool", "User", "", None]), rng.choice([*texts, f"t{t}."])))
    return rows


@pytest.mark.parametrize("piece", [2, 4096])
def test_repair_equals_brute_force(spark, piece):
    rows = conversations(piece, 60)
    df = spark.createDataFrame([(*r, 1, "c", 2, "m", "k") for r in rows], TURNS)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_report(df, piece=piece).collect()}
    by = {c: [] for c, *_ in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    assert got == {c: expected(v) for c, v in by.items()}


def test_only_white_space_is_passed_over_at_a_text_s_end(spark):
    ends = [*"xbc0\\tnrvf", "\x0b", "\x0c", "\x0b.", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\x00", "\t", "\r\n "]
    texts = [t for e in ends for t in (e, f"Hi.{e}", f"Hi{e}", f"Hi.{e} \x0c")] + ["bc", "0", "x0bc", "b0x. c"]
    rows = [(i // 4, i % 4, ("user", "assistant")[i % 2], x) for i, x in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "c", 2, "m", "k") for r in rows], TURNS)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_report(df).collect()}
    assert got == {c: expected(damage([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}


def test_repair_query_on_its_whole_table(spark):
    df = Tables(spark, "/root/testdata/sf0.001").conversations
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_report(df).collect()}
    by = {r[0]: [] for r in df.collect()}
    for r in damage([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]):
        by[r[0]].append(r)
    assert got == {c: expected(v) for c, v in by.items()}


def test_repaired_turns_follow_the_grammar_in_a_long_conversation_of_many_pieces(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"text {rng.randint(0, 900)}{rng.choice('.,')}") for t in range(1200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = conversation_repair.repair(df, piece=8)
    report = done.report.collect()
    turns = [(r["role"], r["text"]) for r in done.turns.orderBy("at", "nth").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns)) and len(report) == 1
    whole = conversation_repair.repair(df).report.first()
    assert (report[0]["cost"], report[0]["audit"], report[0]["illegal"]) == (whole["cost"], whole["audit"], whole["illegal"])
    assert len(re.findall("[DKR]", whole["audit"])) == 1200


def test_repair_of_nothing_and_of_one_row_repeated(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.repair_report(spark.createDataFrame([], schema)).collect() == []
    done = conversation_repair.repair(spark.createDataFrame([(1, 1, "user", "Hi.")] * 50, schema), piece=8)
    r = done.report.first()
    # the first row stays, the others go, and an answer is put in: before the deletions, as D comes before I
    assert (r["duplicate"], r["cost"], r["audit"]) == (49, 149, "K" + "D" * 49 + "I")
    assert [t["role"] for t in done.turns.orderBy("at", "nth").collect()] == ["user", "assistant"]


def test_each_node_is_solved_from_its_successor_alone():
    strings = sorted({"".join(random.Random(i).choices("suaoSUAx", k=random.Random(i).randint(0, 6))) for i in range(300)})
    rows = list(conversation_repair.solve(iter([("end", s[::-1], 1) for s in sorted(strings, key=lambda s: s[::-1])])))
    assert len(rows) == len(strings)
    for _, marks, _, cost, edits, _ in rows:
        (c, audit), _ = cheapest([(0, 0, m.lower(), "") for m in marks], ["blank" if m == "x" else "truncated" if m.isupper() else "" for m in marks])
        assert (cost, edits[::2]) == (c, audit)


# hard negatives

def mined(rows, positives=5, negatives=3):
    rows = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    key = lambda s, r: (-s, r[0] is None, r[0] or 0)
    for a in rows:
        if a[0] is None or a[0] % 50:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], r[2], strict=True)), r) for r in rows if r is not a and len(r[2]) == len(a[2])), key=lambda z: key(*z))
        for s, p in [z for z in scored if z[1][1] == a[1]][:positives]:
            near = [z for z in scored if z[1][1] != a[1] and 50 * s <= 100 * z[0] <= 95 * s][:negatives]
            out += [(a[0], p[0], k + 1, r[0], s, t) for k, (t, r) in enumerate(near)]
    return sorted(out, key=repr)


def mine(spark, rows, **options):
    df = spark.createDataFrame([(*r, 5, "a", 6, 7, 0.5) for r in rows], VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted([tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label=label, **options).collect()], key=repr)


@pytest.mark.parametrize("sizes", [{"block": 4, "page": 3, "chunk": 2}, {}])
def test_mining_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    rows = [(int(i) if i % 90 else None, [float(x) for x in centres[i % 6] + rng.normal(size=5) * 0.2], int(i % 3)) for i in range(1, 400)]
    rows += [(1000 + i, [0.5, 0.5, 0.0, 0.0, 0.25], i % 2) for i in range(120)]  # equal vectors: ties by id
    rows += [(2000, None, 1), (2050, [0.0] * 5, 1), (2100, [1.0, None, 0.0, 0.0, 0.0], 2), (2150, [float("nan")] * 5, 1), (2200, [1.0] * 5, None),
             (2250, [float("inf")] * 5, 1), (2300, [1.0, 2.0], 1), (2350, [1.0, 2.5], 1), (2301, [0.9, 1.5], 2), (2400, [], 1), (2401, [], 1), (2402, [], 2)]
    assert mine(spark, rows, **sizes) == mined(rows)


def test_mining_with_few_rows_hot_labels_and_negative_scores(spark):
    assert mine(spark, [(50, [1.0, 0.0], 1)]) == []
    assert mine(spark, []) == []
    rows = [(i, [-1.0 if i % 50 else 1.0, i / 1000], 1 if i % 3 else 2) for i in range(1, 200)]
    assert mine(spark, rows, block=8) == mined(rows)
    huge = [(50, [1e30, 1.0], 1), (51, [1e30, 1.0], 1), (52, [0.7e30, 1.0], 2)]
    assert len(mine(spark, huge)) <= 1


def test_zone_maps_spare_blocks_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 2
    rows = [(int(i), [float(x) for x in centres[i % 40] + rng.normal(size=8) * 0.05], int(i % 4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    hard_negatives.small_batches(spark)
    packed = hard_negatives.packed(df.select(F.col("label").cast("long").alias("label"), (F.col("vec_id") % 50 == 0).alias("anchor"), F.col("vec_id").alias("id"),
                                             F.col("embedding").cast("array<double>").alias("vector")), {8: 2.0}, 256, 2)
    blocks = hard_negatives.block_table(packed, 32)
    pages, anchors = hard_negatives.page_table(blocks, 64), hard_negatives.anchor_table(blocks, 16)
    wide = anchors.withColumns({"low": F.array(F.lit(hard_negatives.LOW + 1)), "high": F.array(F.lit(hard_negatives.HIGH))})
    start = wide.withColumns({"bar": F.col("low"), "bar_id": F.array(F.lit(hard_negatives.NO_ID))})
    near = hard_negatives.answered(hard_negatives.chosen(start, pages, True, True), blocks, 5)
    rest = hard_negatives.chosen(hard_negatives.barred(wide, near, 5), pages, True, False)
    read = sum(len(r["rows"]) // 8 for r in rest.collect())
    assert read < 0.35 * anchors.count() * blocks.count() / 4


def test_hilbert_neighbours_differ_in_one_place():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = [tuple(k) for k in hard_negatives.hilbert(cells, bits)]
        order = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
