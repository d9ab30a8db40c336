"""12. Conversation structure repair over a suffix-shared automaton.

A turn is one mark: its role's initial (s, u, a, other; upper case if the text is
truncated) or x if it must go (blank, or role and text seen earlier).  The marks of a
conversation, read from the end, are a path of suffixes; conversations that end alike
share it.  Distinct mark strings are sorted by their reverse over range partitions, so a
task meets each of its suffixes once: it keeps the path of the current string and drops what the
next one does not share (a minimal automaton of single suffixes, built incrementally
as a DAWG is).  Each new node gets, for every state of the grammar ``(s?(ua)+)?``, the
cost to go and the best next edits from its successor alone.  A string's cheapest audit is read off along its path.

Ties go to the ASCII-least audit.  Edits of one letter lead to one state, so the least letter
among the cheapest at each step gives the least audit.

Long conversations are cut into pieces of at most ``piece`` turns.  A piece of a
longer one has the cost-to-go vector at its end (less its smallest entry) as its context and is a
string of that context; pieces pass costs backward, then states forward, one small row a
piece, streamed in order.  So no task holds a conversation, except where one value must
be made from all of it: the audit (a letter a turn) and a digest (streamed).

Turns are ordered by turn (nulls first), then role, then a hash of the text; equal rows stand
together.  A null role or text is one space, so a null text is blank.  A null conversation
id is a conversation.  An empty table gives no rows.  Roles count by their first character, as it is.
Texts are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.scan import small_batches, stored

#: Fixed values of the contract: costs of an edit; what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns of a piece, a power of two.
PIECE = 4096
FAR = 1 << 40
#: States: nothing yet, after s, after u, after a.  NEXT is where an inserted or reroled turn leads.
NEXT = (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Costs and edits (letter and initial by turns) at the end of a conversation.
END = (0, 2 * INSERT, INSERT, 0)
END_EDITS = ("", "IuIa", "Ia", "")
SPACES = "\t\n\x0b\x0c\r "
ROLES = {"u": "user", "a": "assistant"}
SOLVED = "context string, marks string, state int, cost long, edits string, leaves int"


@lru_cache(maxsize=1 << 16)
def node(mark: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], tuple]:
    """(cost to go, (edits, state after the turn)) by state, of the node that ``mark`` leads from to one with ``costs``."""
    late = TRUNCATED if mark.isupper() else 0
    ways = []
    for q in range(4):
        w = [(DELETE + costs[q], "D", "D-", q)]
        if mark != "x":
            if q in KEPT.get(mark.lower(), {}):
                to = KEPT[mark.lower()][q]
                w.append((late + costs[to], "K", "K" + mark.lower(), to))
            w.append((REROLE + late + costs[NEXT[q]], "R", "R" + "?sua"[NEXT[q]], NEXT[q]))
        ways.append(w)
    plain = [min(c for c, *_ in w) for w in ways]
    # at most two inserts in a row can pay: a third would be back in the same state
    once = [min(plain[q], INSERT + plain[NEXT[q]]) for q in range(4)]
    total = [min(plain[q], INSERT + once[NEXT[q]]) for q in range(4)]
    moves: dict[int, tuple] = {}

    def move(q: int) -> tuple:
        if q not in moves:
            w = [(letter, edits, to) for c, letter, edits, to in ways[q] if c == total[q]]
            if INSERT + total[NEXT[q]] == total[q]:
                w.append(("I", "", q))
            letter, edits, to = min(w)
            if letter == "I":
                edits, to = move(NEXT[q])
                edits = "I" + "?sua"[NEXT[q]] + edits
            moves[q] = (edits, to)
        return moves[q]

    for q in range(4):
        if total[q] < FAR:
            move(q)
    return tuple(min(t, FAR) for t in total), tuple(moves.get(q) for q in range(4))


def solve(rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple]:
    """``SOLVED`` rows of (context, reversed marks, number of start states), sorted by the first two."""
    context, before, path = None, "", []
    for name, marks, states in rows:
        if name != context:
            context, before = name, ""
            path = [(END if name == "end" else tuple(map(int, name.split(","))), 0, None)]
        shared = 0
        while shared < min(len(before), len(marks)) and before[shared] == marks[shared]:
            shared += 1
        del path[shared + 1:]
        for mark in marks[shared:]:
            costs, base, _ = path[-1]
            made, moves = node(mark, costs)
            least = min(made)
            path.append((tuple(min(c - least, FAR) if c < FAR else FAR for c in made), base + least, moves))
        before = marks
        ends = path[0][0]
        for start in range(states):
            if path[-1][0][start] >= FAR:
                continue
            q, edits = start, []
            for _, _, moves in reversed(path[1:]):
                made, q = moves[q]
                edits.append(made)
            if name == "end":
                edits.append(END_EDITS[q])
            cost = path[-1][0][start] + path[-1][1]
            yield name, marks[::-1], start, cost - (0 if name == "end" else ends[q]), "".join(edits), q


def _streamed(df: DataFrame, columns: list[str], work, ddl: str) -> DataFrame:
    """``df`` through ``work``, a generator from tuples of ``columns`` to tuples of ``ddl``; some thousand at a time."""
    fields = [(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[t]) for n, t in df.sparkSession.createDataFrame([], ddl).dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

        held, size = [], 0
        for row in work(tuples()):
            held.append(row)
            size += 32 + sum(len(v) for v in row if isinstance(v, str))
            if size > 1 << 20:
                yield batch(held)
                held, size = [], 0
        yield batch(held)

    return df.select(*columns).mapInArrow(run, ddl)


def solved(strings: DataFrame) -> DataFrame:
    """Costs, edits and the state at the end of every distinct (context, marks), from ``states`` start states each."""
    s = strings.groupBy("context", F.reverse("marks").alias("back")).agg(F.max("states").alias("states"))
    s = s.repartitionByRange("context", "back").sortWithinPartitions("context", "back")
    return _streamed(s, ["context", "back", "states"], solve, SOLVED)


def costs_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, piece, context) of pieces (conv, piece, costs by state and by state at the end), last pieces first."""
    conv, v = None, END
    for name, piece, table in rows:
        if name != conv:
            conv, v = name, END
            yield name, piece, "end"
        else:
            yield name, piece, ",".join(map(str, v))
        v = [min(table[4 * q + j] + v[j] for j in range(4)) for q in range(4)]
        v = tuple(min(x - min(v), FAR) for x in v)


def states_on(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, piece, state at its start) of pieces (conv, piece, state at the end by state at the start), in order."""
    conv, q = None, 0
    for name, piece, leaves in rows:
        if name != conv:
            conv, q = name, 0
        yield name, piece, q
        q = leaves[q]


def digests(rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(conv, sha256 of its lines joined by line feeds) from (conv, line) in order."""
    conv, h = None, None
    for name, line in rows:
        if h is None or name != conv:
            if h is not None:
                yield conv, h.hexdigest()
            conv, h = name, hashlib.sha256()
        else:
            h.update(b"\n")
        h.update(line.encode("utf-8", "surrogatepass"))
    if h is not None:
        yield conv, h.hexdigest()


class Repair(NamedTuple):
    """``report``: a row a conversation; ``turns``: the repaired turns (conv, at, nth, edit, role, text), in order of at and nth."""

    report: DataFrame
    turns: DataFrame


def conv_key(conv_id: str) -> Column:
    """A text that names the conversation and is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("n"))


def ordered(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, at): ``at`` rises in the order of a conversation's turns."""
    rows = turns.select(conv_key(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    order = ["conv", F.asc_nulls_first("turn"), "role", "hash", "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("at")))


def marked(rows: DataFrame) -> DataFrame:
    """(conv, turn, at, initial, fault, mark) of ordered rows."""
    # as a literal: SQL text knows no \x escapes and would trim the letters of them
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    narrow = rows.select("conv", "turn", "at", "role", F.md5(F.col("text").cast("binary")).alias("hash"), end.alias("end"))
    # the first of equal turns, by its own place: no join on a turn that many share
    first = narrow.where("end <> ''").groupBy("conv", "role", "hash").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("end") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return (narrow.join(first, "at", "left").select("conv", "turn", "at", own.alias("initial"), fault.alias("fault"))
            .withColumn("mark", mark))


def counted(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of marked rows."""
    span = (F.max("turn").cast("decimal(20)") - F.min("turn") + 1 - F.count_distinct("turn")).cast("decimal(21)")
    longest = F.lit((1 << 63) - 1).cast("decimal(21)")
    return rows.groupBy("conv").agg(F.least(F.coalesce(span, F.lit(0)), longest).cast("long").alias("gaps"),
                                    *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])


def pieces_of(rows: DataFrame, piece: int) -> DataFrame:
    """(conv, piece, ats, initials, marks, nth, of, illegal): runs of at most ``piece`` turns, and
    the illegal neighbours in each and to the one before."""
    held = rows.withColumn("piece", F.expr(f"at div {piece}")).groupBy("conv", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "initial", "mark"))).alias("held"))
    joined = lambda k: F.array_join(F.transform("held", lambda x: x[k]), "")
    held = stored(held.select("conv", "piece", F.transform("held", lambda x: x["at"]).alias("ats"), joined("initial").alias("initials"), joined("mark").alias("marks")))
    legal = lambda c: F.regexp_count(c, F.lit("(?=su|ua|au)"))
    inside = F.length("initials") - 1 - legal(F.col("initials"))
    order = W.partitionBy("conv").orderBy("piece")
    narrow = held.select("conv", "piece", inside.alias("inside"), F.substring("initials", 1, 1).alias("first"), F.expr("right(initials, 1)").alias("last"))
    border = F.concat(F.lag("last").over(order), "first")
    narrow = narrow.select("conv", "piece", F.row_number().over(order).alias("nth"), F.count("*").over(W.partitionBy("conv")).alias("of"),
                           (F.col("inside") + F.coalesce((legal(border) == 0).cast("int"), F.lit(0))).cast("long").alias("illegal"))
    return stored(held.drop("initials").join(narrow, ["conv", "piece"]))


def started(pieces: DataFrame) -> DataFrame:
    """``pieces`` with context, state, cost and edits."""
    lone = pieces.where("of = 1").withColumns({"context": F.lit("end"), "state": F.lit(0)})
    cut = pieces.where("of > 1")
    # every piece's costs from each state to each state at its end
    bases = F.array(*[F.lit(",".join(str(0 if i == j else FAR) for i in range(4))) for j in range(4)])
    tables = solved(cut.select(F.explode(bases).alias("context"), "marks", F.lit(4).alias("states")))
    tables = tables.groupBy("marks").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "state", "leaves"), "cost"))).alias("known"))
    keys = F.array(*[F.lit(f"{q}|{j}") for q in range(4) for j in range(4)])
    tables = tables.select("marks", F.transform(keys, lambda k: F.coalesce(F.col("known")[k], F.lit(FAR))).alias("table"))
    back = cut.select("conv", "piece", "marks").join(tables, "marks").repartition("conv").sortWithinPartitions("conv", F.desc("piece"))
    contexts = stored(cut.join(_streamed(back, ["conv", "piece", "table"], costs_back, "conv string, piece long, context string"), ["conv", "piece"]))

    strings = lone.select("context", "marks", F.lit(1).alias("states")).unionByName(contexts.select("context", "marks", F.lit(4).alias("states")))
    answers = stored(solved(strings))
    leaves = answers.groupBy("context", "marks").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "leaves"))), lambda x: x["leaves"]).alias("leaves"))
    on = contexts.join(leaves, ["context", "marks"]).repartition("conv").sortWithinPartitions("conv", "piece")
    states = _streamed(on, ["conv", "piece", "leaves"], states_on, "conv string, piece long, state int")
    every = lone.unionByName(contexts.join(states, ["conv", "piece"]))
    return stored(every.join(answers.drop("leaves"), ["context", "marks", "state"]))


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> Repair:
    """The cheapest repair of every conversation in ``turns``."""
    small_batches(turns.sparkSession)
    rows = ordered(turns, conv_id, turn, role, text)
    marks = stored(marked(rows))
    done = started(pieces_of(marks, piece))

    letters = F.regexp_replace("edits", "(.).", "$1")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", letters.alias("letters")))), lambda x: x["letters"]), "")
    report = counted(marks).join(done.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit")), "conv")

    # a turn's edits: inserts before it, its own, and for the last turn the inserts at the end
    runs = F.regexp_extract_all("edits", F.lit("(?:I.)*[DKR].(?:(?:I.)+$)?"), F.lit(0))
    by_turn = done.select(F.explode(F.arrays_zip(F.col("ats").alias("at"), runs.alias("edits"))).alias("x")).select("x.at", "x.edits")
    made = rows.select("conv", "at", "role", "text").join(by_turn, "at")
    made = made.select("conv", "at", "role", "text", F.posexplode(F.regexp_extract_all("edits", F.lit(".."), F.lit(0))).alias("nth", "edit")).where("edit <> 'D-'")
    letter, initial = F.substring("edit", 1, 1), F.substring("edit", 2, 1)
    new = F.when(initial == "u", "user").otherwise("assistant")
    made = made.select("conv", "at", "nth", letter.alias("edit"), F.when(letter == "K", F.col("role")).otherwise(new).alias("role"),
                       F.when(letter == "I", "").otherwise(F.col("text")).alias("text"))
    return Repair(report, made)


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as the contract damages them: by crc32(conv_id:turn) % 20."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named(conv_id), F.lit(":"), named(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), named(role).alias("role"), named(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), again.alias("copy")).drop("copy")


def repair_report(turns: DataFrame, conv_id: str = "conv_id", **options) -> DataFrame:
    """Per conversation of ``turns``: counts, cost and audit after the contract's damage, and the digest of the repaired turns."""
    done = repair(damaged(turns, conv_id), **options)
    lines = done.turns.select("conv", "at", "nth", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv").sortWithinPartitions("conv", "at", "nth")
    hashes = _streamed(lines, ["conv", "line"], digests, "conv string, repaired_sha256 string")
    every = turns.groupBy(conv_id).agg(F.lit(1)).select(F.col(conv_id).alias("conv_id"), conv_key(conv_id).alias("conv"))
    out = every.join(done.report, "conv", "left").join(hashes, "conv", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
