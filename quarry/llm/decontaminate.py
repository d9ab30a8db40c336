"""8. Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of the benchmark (``window`` consecutive words of an item; a shorter
item is one window) are hashed and broadcast; every whole text is scanned for
them in Arrow batches, a hash hit is verified word by word, and the words inside
occurrences are marked.  One broadcast holds at most ``block`` windows: a larger
benchmark is taken in several passes over the documents, each with its own block,
so nothing is left out and no worker holds more than one block.  The word runs hit are
carried through the passes, and a document is judged on those of all blocks.

Null and empty texts have no words and no hits; a benchmark row without words has
no window; a null ``item_id`` marks words but is not listed among the items.
Repeated rows are judged alike; an empty benchmark hits nothing; other columns
of either table do not matter.
"""

from __future__ import annotations



import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scan import as_id, scan, scan_rows
from quarry.llm.words import ALNUM, chunks, lowered, run_hashes, words
from quarry.session import cut_lineage

#: Words in a window.
WINDOW = 13
#: Windows in one broadcast (about 200 bytes each in a worker).
BLOCK = 400_000


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, hash, window_text) of every window of every item."""

    def make():
        def work(batch):
            items = batch.column(0).to_pylist()
            for c in chunks(batch.column(1)):
                low = lowered(c)
                w = words(low, ALNUM)
                counts = w.counts
                out = {"item_id": [], "length": [], "hash": [], "window_text": []}
                for length in {min(window, int(n)) for n in counts if n}:
                    first, hashes = run_hashes(w, length)
                    for f, h in zip(first.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        i = int(np.searchsorted(w.offsets, f, "right")) - 1
                        if min(window, counts[i]) == length:
                            out["item_id"].append(items[c.first + i])
                            out["length"].append(length)
                            out["hash"].append(h)
                            out["window_text"].append(_run_text(low, w, f, length))
                yield out
        return work

    return scan(benchmark, [F.col("item_id").cast("string"), "text"], make,
                "item_id string, length int, hash long, window_text string")


def _run_text(low, w, first: int, length: int) -> str:
    return b" ".join(low.data[s:e].tobytes() for s, e in
                     zip(w.starts[first:first + length], w.ends[first:first + length], strict=True)).decode("utf-8", "replace")


class _Index:
    """One block of windows: sorted hashes by length, and what each hash stands for."""

    def __init__(self, rows):
        self.known: dict[tuple[int, int], dict[str, set]] = {}
        for r in rows:
            self.known.setdefault((r.length, r.hash), {}).setdefault(r.window_text, set()).add(r.item_id)
        self.sorted = {length: np.sort(np.array([h for n, h in self.known if n == length], np.int64).view(np.uint64))
                       for length in {n for n, _ in self.known}}

    def hits(self, low, w):
        """(first word, length, items) of every verified occurrence."""
        for length, wanted in self.sorted.items():
            first, hashes = run_hashes(w, length)
            at = np.minimum(np.searchsorted(wanted, hashes), wanted.size - 1)
            for k in np.flatnonzero(wanted[at] == hashes).tolist():
                f = int(first[k])
                items = self.known[length, int(hashes[k:k + 1].view(np.int64)[0])].get(_run_text(low, w, f, length))
                if items is not None:
                    yield f, length, items


def _blocks(benchmark: DataFrame, window: int, block: int):
    """(whether it is the last one, broadcast index) of each block."""
    windows = benchmark_windows(benchmark, window).distinct()
    if (total := windows.count()) > block:
        windows = cut_lineage(windows)
    n = max(1, -(-total // block))
    for i in range(n):
        part = windows.where(F.pmod(F.xxhash64("hash", "window_text"), F.lit(n)) == i) if n > 1 else windows
        yield i == n - 1, benchmark.sparkSession.sparkContext.broadcast(_Index(part.collect()))


def _add_hits(index: _Index, texts: pa.Array, firsts: list, ends: list, items: list | None = None) -> np.ndarray:
    """Add one block's hits to the word runs (and items) of each text; gives the word counts."""
    n_words = np.zeros(len(texts), np.int64)
    for c in chunks(texts):
        low = lowered(c)
        w = words(low, ALNUM)
        n_words[c.first:c.first + c.n] = w.counts
        for f, length, found in index.hits(low, w):
            i = int(np.searchsorted(w.offsets, f, "right")) - 1
            firsts[c.first + i].append(f - int(w.offsets[i]))
            ends[c.first + i].append(f - int(w.offsets[i]) + length)
            if items is not None:
                items[c.first + i] |= found - {None}
    for i, run in enumerate(firsts):
        if run:
            firsts[i], ends[i] = merged(run, ends[i])
    return n_words


def mark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document: n_words, the hit word runs (``first_hit``, ``end_hit``) and the items hit."""
    marked = docs.select(as_id(doc_id), F.col(text).alias("text"), F.array().cast("array<long>").alias("first_hit"),
                         F.array().cast("array<long>").alias("end_hit"), F.array().cast("array<string>").alias("items"),
                         F.lit(0).cast("long").alias("n_words"))
    for k, (_, index) in enumerate(_blocks(benchmark, window, block)):
        def make(index=index):
            def work(batch):
                ids, texts, firsts, ends, items, _ = batch.columns
                firsts, ends, items = firsts.to_pylist(), ends.to_pylist(), [set(x) for x in items.to_pylist()]
                n_words = _add_hits(index.value, texts, firsts, ends, items)
                return {doc_id: ids, "text": texts, "first_hit": firsts, "end_hit": ends, "items": [sorted(x) for x in items], "n_words": n_words}
            return work
        if k:
            marked = cut_lineage(marked)
        marked = scan(marked, [doc_id, "text", "first_hit", "end_hit", "items", "n_words"], make,
                      f"{doc_id} long, text string, first_hit array<long>, end_hit array<long>, items array<string>, n_words long")
    return marked


def merged(firsts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Overlapping and touching runs of words as disjoint ones."""
    a, b = [], []
    for f, e in sorted(zip(firsts, ends, strict=True)):
        if b and f <= b[-1]:
            b[-1] = max(b[-1], e)
        else:
            a.append(f)
            b.append(e)
    return a, b


def _n_hit():
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    return total("end_hit") - total("first_hit")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document: words, hit words, items, and whether at least 5 % of its words are hit."""
    m = mark(docs, benchmark, doc_id, text, window, block).withColumn("n_hit", _n_hit())
    return m.select(doc_id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                      block: int = BLOCK, spans: bool = False) -> DataFrame:
    """The documents without contaminated ones; with ``spans``, contaminated ones stay
    and lose the hit words (and what stands between hit neighbours).

    The hit runs are carried through all blocks over unchanged texts, as in ``mark``, and
    judged once after the last block."""
    names, runs = docs.columns, ("_first_hit", "_end_hit")
    docs = docs.withColumns({c: F.array().cast("array<long>") for c in runs})
    for k, (last, index) in enumerate(_blocks(benchmark, window, block)):
        def make(last=last, index=index):
            def work(column: pa.Array, firsts: pa.Array, ends: pa.Array):
                firsts, ends = firsts.to_pylist(), ends.to_pylist()
                n_words = _add_hits(index.value, column, firsts, ends)
                keep, texts = np.ones(len(column), bool), column.to_pylist() if last and spans else None
                for i, (a, b) in enumerate(zip(firsts, ends, strict=True)):
                    if not last or not a or 20 * (sum(b) - sum(a)) < n_words[i]:
                        continue
                    if spans:
                        texts[i] = _without(column.slice(i, 1), a, b)
                    else:
                        keep[i] = False
                return keep, texts, firsts, ends
            return work
        if k:
            docs = cut_lineage(docs)
        docs = scan_rows(docs, text, make, runs)
    return docs.select(names)


def _without(column: pa.Array, firsts: list[int], ends: list[int]) -> str:
    """The one text of ``column`` without the given runs of words."""
    c = next(chunks(column))
    w = words(lowered(c), ALNUM)
    left = [0, *[int(w.ends[e - 1]) for e in ends]]
    right = [*[int(w.starts[f]) for f in firsts], int(c.offsets[1])]
    return b"".join(c.data[s:e].tobytes() for s, e in zip(left, right, strict=True)).decode()
