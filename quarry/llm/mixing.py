"""6. Mixing sources to target weights by a hypergeometric splitting tree. [native]

Sizes are words.  Sources in code-point order (null last) weigh by a repeating
cycle and share ``share`` of all sizes; a source's target stops at ``ceiling`` times
its size, and the excess is reshared by weight until none is above.

A source's documents stand in an order given by a hash of their id, and its quota
in words is drawn from that order: so many full passes and a last one that ends
at a *cut*.  The cut is found by descending the hash digits: sums by the first
digits tell the block it lies in, that block alone is summed by the next digits, and so
on: rows are summed by source and digits before a join, and a join is on both, so no task
orders or holds a source's documents.  ``mix_report`` counts the document at the cut in part,
which makes a source's words exact; ``mixed`` takes whole documents alone, up to the one at
the cut if at least half of it is due, so a source's words are within half a document
of its target and no text is ever shortened.  Rows that share the key at the cut are drawn in
the order of a hash of their texts, found the same way.

Every block drawn (a source, the first hash digits, a pass) is a slot of its
source's exact block quota.  The slots of all sources go down a binary tree: each
node gives a random half of its slots to either child, so a child's counts by
source follow the multivariate hypergeometric distribution.  The half is where the
count by the first digits of a random key ends; only the slots of those digits are ranked, so
no level ranks a node's slots in one task.  The leaves are the output shards.  They get disjoint permuted blocks, and rows are shuffled within their
shard by a second hash.

Tables that leave the row level are bounded: one row a source, and 16 ** digits
blocks of it at most.  A null text has size 0; a document of size 0 is taken with 0
words; a null id stands in the order as an empty one.  Rows that repeat an id stand
together; if the cut falls on them, ``mix_report`` gives each its share of what is left,
in proportion to size (so its SQL), and ``mixed`` takes whole rows.
An empty table gives no rows.  Columns of the table may have any names; one named like a column that is added is replaced.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.scan import stored

# Fixed values of the contract.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CEILING = 1.5, 2.0
#: Hexadecimal digits of the hash in a block's name; levels of the splitting tree.
DIGITS, LEVELS, SEED = 2, 4, "mix-1"
PICKS = "array<struct<pass:int,words:bigint,shard:int,place:string>>"


def n_words(text: str) -> Column:
    r"""The number of ``[^\x20\x09-\x0D]+``."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(_src, source_size, target) from one row (source, _src, source_size) for each source.

    Resharing ends with the smallest level L at which the sum of min(weight * L,
    ceiling) over the sources is the whole amount; sources by ceiling / weight show
    which of them are full at that level."""
    order = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("top", ceiling * F.col("source_size"))
    # in order of the level at which a source is full: what full ones hold, and the weights of the others
    full = W.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), "source")
    s = s.withColumns({"amount": share * F.sum("source_size").over(W.partitionBy()),
                       "held": F.coalesce(F.sum("top").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
                       "open": F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))})
    s = s.withColumn("level", (F.col("amount") - F.col("held")) / F.col("open"))
    # the first source that is not full at its level sets the level of all
    level = F.min(F.when(F.col("weight") * F.col("level") <= F.col("top"), F.struct(F.col("top") / F.col("weight"), F.col("level")))).over(W.partitionBy())
    return s.select("_src", "source_size", F.least("top", F.coalesce(F.col("weight") * level.getField("level"), F.col("top"))).alias("target"))


def keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: str = SEED) -> DataFrame:
    """(_doc, source, _size, _src, _key): the row, its source, its words, a join key for the
    source that is never null, and the order."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_doc"), F.col(source).cast("string").alias("source"),
        n_words(text).alias("_size"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("_src"),
        F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")).alias("_key"))


def _cut(rows: DataFrame, rest: DataFrame, digits: int) -> DataFrame:
    """(_src, cut, cut_rest, cut_words): the key at which ``rest`` words end, and how many
    words are drawn there of how many; rows of (_src, _key, _size)."""
    order = W.partitionBy("_src").orderBy("cut")
    coarse = stored(rows.groupBy("_src", F.substring("_key", 1, 3 * digits).alias("_key")).agg(F.sum("_size").alias("_size")))
    cut = rest.select("_src", F.col("rest").alias("cut_rest"))
    for known, n in ((0, digits), (digits, 2 * digits), (2 * digits, 3 * digits), (3 * digits, 32)):
        at = (coarse if n <= 3 * digits else rows).withColumn("cut", F.substring("_key", 1, n))
        if known:  # the block found so far alone, one a source; what is left there comes with it: a plan reads each cut once
            found = cut.select("_src", F.col("cut").alias("_at"), "cut_rest")
            at = at.withColumn("_at", F.substring("_key", 1, known)).join(found, ["_src", "_at"])
            sums = at.groupBy("_src", "cut", "cut_rest").agg(F.sum("_size").alias("cut_words"))
        else:
            sums = at.groupBy("_src", "cut").agg(F.sum("_size").alias("cut_words")).join(cut, "_src")
        sums = sums.withColumn("before", F.sum("cut_words").over(order) - F.col("cut_words"))
        cut = (sums.where((F.col("before") < F.col("cut_rest")) & (F.col("cut_rest") <= F.col("before") + F.col("cut_words")))
               .select("_src", "cut", (F.col("cut_rest") - F.col("before")).alias("cut_rest"), "cut_words"))
    return cut


def _numbered(made: DataFrame, plan: DataFrame, text: Column, digits: int) -> DataFrame:
    """``made`` with the order of rows at the cut's key: _tied (a hash of the text), tied
    (the one at which the words end, with tied_rest words left) and _nth among equal texts there."""
    made = made.withColumn("_tied", F.when(F.col("_key") == F.col("cut"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    rows = stored(made.where("_tied is not null").select("_src", F.col("_tied").alias("_key"), "_size"))
    ends = _cut(rows, plan.where("cut is not null").select("_src", F.col("cut_rest").alias("rest")), digits)
    made = made.join(stored(ends.select("_src", F.col("cut").alias("tied"), F.col("cut_rest").alias("tied_rest"))), "_src", "left")
    at = F.coalesce(F.col("_tied") == F.col("tied"), F.lit(False))
    nth = F.row_number().over(W.partitionBy("_src").orderBy(F.to_json("_doc")))
    return made.where(~at).withColumn("_nth", F.lit(1)).unionByName(made.where(at).withColumn("_nth", nth))


def _shards(drawn: DataFrame, levels: int, seed: str, digits: int) -> DataFrame:
    """(_src, block, shards) from the slots (_src, block, times): the leaf of each slot, by pass."""
    slots = drawn.select("_src", "block", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)).alias("pass"), F.lit(0).alias("node"))
    node = W.partitionBy("node")
    for level in range(levels):
        draw = F.md5(F.concat_ws("|", F.lit(f"{seed}|{level}"), "_src", "block", "pass").cast("binary"))
        slots = stored(slots.withColumns({"draw": draw, "digit": F.substring(draw, 1, digits)}))
        # the digits at which half of a node's slots end, then the slots of those digits alone
        held = slots.groupBy("node", "digit").agg(F.count("*").alias("held"))
        held = held.withColumns({"before": F.sum("held").over(node.orderBy("digit")) - F.col("held"), "rest": F.expr("sum(held) over (partition by node) div 2")})
        middle = held.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("held")))
        # at most 2 ** levels nodes: a proven bound
        middle = F.broadcast(middle.select("node", "digit", (F.col("rest") - F.col("before")).alias("nth")))
        inside = slots.join(middle, ["node", "digit"]).withColumn("at", F.row_number().over(node.orderBy("draw")))
        cut = F.broadcast(inside.where("at = nth").select("node", F.col("draw").alias("cut")))
        # one slot more in the second half of an odd number; a lone slot goes there
        slots = slots.join(cut, "node", "left").select(
            "_src", "block", "pass", (2 * F.col("node") + F.coalesce((F.col("draw") > F.col("cut")).cast("int"), F.lit(1))).alias("node"))
    return slots.groupBy("_src", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "node"))), lambda x: x["node"]).alias("shards"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE,
        ceiling: float = CEILING, digits: int = DIGITS, levels: int = LEVELS, seed: str = SEED, whole: bool = False) -> DataFrame:
    """``docs`` with _size, _source_size, _target, _taken and _picks: an array of
    (pass, words, shard, place), one entry for each pass that takes the row.

    With ``whole``, the document at the cut and rows that share its key are taken as a
    whole or not at all, one after the other, instead of each in part."""
    rows = stored(keyed(docs, doc_id, text, source, seed).select("source", "_src", "_key", "_size"))
    plan = targets(rows.groupBy("source", "_src").agg(F.sum("_size").alias("source_size")), weights, share, ceiling)
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    # stored tables have a measured size: Spark broadcasts them to the texts below its threshold, and else splits hot sources
    plan = stored(plan.withColumns({"passes": passes, "rest": words - passes * F.col("source_size")})
                  .select("_src", "source_size", "target", "passes", "rest"))
    plan = stored(plan.join(_cut(rows, plan.where("rest > 0"), digits), "_src", "left"))

    block = F.substring("_key", 1, digits)
    last = F.coalesce((block <= F.substring("cut", 1, digits)).cast("int"), F.lit(0))
    drawn = (rows.select("_src", block.alias("_key")).distinct().join(plan, "_src")
             .select("_src", F.col("_key").alias("block"), (F.col("passes") + last).alias("times")).where("times > 0"))
    shards = stored(_shards(drawn, levels, seed, digits))

    made = keyed(docs, doc_id, text, source, seed).drop("source").join(plan, "_src")
    part = F.floor(F.col("_size") * F.col("cut_rest") / F.greatest("cut_words", F.lit(1)))
    if whole:
        made = _numbered(made, plan, F.col("_doc")[f"c{docs.columns.index(text)}"], digits)
        left = F.col("tied_rest") - (F.col("_nth") - 1) * F.col("_size")
        part = (F.when(F.col("_tied") < F.col("tied"), F.col("_size"))
                .when((F.col("_tied") == F.col("tied")) & (2 * left >= F.col("_size")), F.col("_size")).otherwise(0))
    extra = F.when(F.col("_key") < F.col("cut"), F.col("_size")).when(F.col("_key") == F.col("cut"), part).otherwise(0).cast("long")
    place = lambda i: F.md5(F.concat_ws("|", F.lit(f"{seed}|place"), i.cast("string"), "_key").cast("binary"))
    pick = lambda shard, i: F.struct(
        i.cast("int").alias("pass"), F.when(i < F.col("passes"), F.col("_size")).otherwise(F.col("_extra")).alias("words"),
        shard.alias("shard"), place(i).alias("place"))
    made = (made.withColumns({"_extra": F.coalesce(extra, F.lit(0).cast("long")), "_block": block})
            .join(shards.withColumnsRenamed({"block": "_block", "shards": "_shards"}), ["_src", "_block"], "left"))
    added = {"_size": F.col("_size"), "_source_size": F.col("source_size"), "_target": F.col("target"),
             "_taken": F.col("passes") * F.col("_size") + F.col("_extra"),
             "_picks": F.filter(F.coalesce(F.transform("_shards", pick), F.array().cast(PICKS)), lambda x: x["words"] > 0)}
    # apart: names of the table must not stand beside expressions over the plan's
    made = made.select("_doc", *[c.alias(n) for n, c in added.items()])
    return made.select(*[F.col("_doc")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns) if c not in added], *added)


def mix_report(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Per document: size, source_size, target, taken, how many picks of it went down the tree, and their shards."""
    return mix(docs, doc_id, **options).select(
        F.col(doc_id).cast("long").alias(doc_id), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.size("_picks").cast("long").alias("picks"),
        F.transform("_picks", lambda x: x["shard"]).alias("shards"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", levels: int = LEVELS, **options) -> DataFrame:
    """The mix itself: a row for each pick, by shard and shuffled in it, with the
    columns of ``docs`` and _pass, _words, _shard, _place; texts are whole."""
    m = mix(docs, doc_id, text, levels=levels, whole=True, **options).withColumn("_picks", F.explode("_picks"))
    added = {f"_{c}": F.col(f"_picks.{c}") for c in ("pass", "words", "shard", "place")}
    return (m.select(*[F.col(f"`{c}`") for c in docs.columns if c in m.columns[:-5] and c not in added], *[c.alias(n) for n, c in added.items()])
            .repartition(F.col("_shard"), F.substring("_place", 1, 2)).sortWithinPartitions("_shard", "_place"))


#: DuckDB SQL for ``mix_report`` over ``documents`` with the production parameters, without ``shards``;
#: ``picks`` counts in Spark what came out of the tree's leaves, here what must.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight,
             2.0::DOUBLE * source_size AS top FROM s),
f AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS amount,
        coalesce(sum(top) OVER (ORDER BY top / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(weight) OVER (ORDER BY top / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
      FROM w),
l AS (SELECT arg_min((amount - held) / open, top / weight) AS level FROM f WHERE weight * ((amount - held) / open) <= top),
t AS (SELECT src, source_size, least(top, coalesce(weight * level, top)) AS target FROM f LEFT JOIN l ON true),
p AS (SELECT *, CAST(round(target) AS BIGINT) AS words,
             CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM t),
b AS (SELECT src, k, sum(size) AS key_words, sum(sum(size)) OVER (PARTITION BY src ORDER BY k) - sum(size) AS before FROM d GROUP BY src, k)
SELECT doc_id, size, source_size, target, taken, CASE WHEN size = 0 THEN 0 ELSE passes + (taken > passes * size)::BIGINT END AS picks FROM (
SELECT d.doc_id, d.size, p.source_size, p.target, p.passes,
       CAST(passes * size + CASE
         WHEN words - passes * source_size <= before THEN 0
         WHEN words - passes * source_size >= before + key_words THEN size
         ELSE floor(size * (words - passes * source_size - before) / greatest(key_words, 1)) END AS BIGINT) AS taken
FROM d JOIN p USING (src) JOIN b ON d.src = b.src AND d.k = b.k)
"""
