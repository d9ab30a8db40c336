"""2. Quality classifier: histogram gradient-boosted trees over document statistics.

A scan turns every whole text into a row of statistics (byte classes, word and
line lengths, repetition).  Trees are fitted on a bounded sample of labelled rows:
binned features, gradient histograms by one ``bincount`` a level, logistic loss.  The
fitted trees are complete binary trees in flat arrays (feature, threshold, leaf), so
scoring walks all rows of a batch down one tree with a few numpy gathers.

Only the text is an input of a score.  ``sample`` bounds the rows that are learned
from: those of the smallest hash of the id among all labelled rows that are not held
out.  Null and empty texts have zero statistics and get a score like any other.  A
document with several labels is learned from once for each; null labels are ignored.
Without labels of both kinds every score is the share of label 1 (0.5 without any).
Repeated rows get equal scores; other columns do not matter.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scan import as_id, held_out, scan, scan_rows
from quarry.llm.words import NON_SPACE, Texts, Words, chunks, lowered, run_hashes, words

#: Most labelled rows that trees are fitted on.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST, L2 = 80, 4, 0.12, 64, 10, 1.0

_LINES = np.ones(256, bool)
_LINES[0x0A] = False


def _table(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_SYMBOLS = _table(set(range(0x21, 0x7F)) - set(b".,;:!?'\"()-") - {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)})
CLASSES = {
    "upper": _table(range(0x41, 0x5B)), "digit": _table(range(0x30, 0x3A)), "space": ~NON_SPACE, "newline": _table([0x0A]),
    "stops": _table(b".,;:!?"), "shout": _table(b"!?"), "symbols": _SYMBOLS, "brackets": _table(b"<>{}[]|\\/=_"), "wide": _table(range(0x80, 0x100)),
}
FEATURES = ["bytes", "words", *CLASSES, "word_length", "longest_word", "distinct_words", "distinct_runs", "lines", "distinct_lines",
            "line_words", "symbol_ends", "stop_ends", "short_words", "long_words", "top_word", "capital_words"]


def _per_text(w: Words, what: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(what, dtype=np.int64)])
    return sums[w.offsets[1:]] - sums[w.offsets[:-1]]


def _distinct(offsets: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct values, and how often the most frequent one stands."""
    n = offsets.size - 1
    if not hashes.size:
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])]))
    times = np.diff(np.concatenate([first, [o.size]]))
    most = np.zeros(n)
    np.maximum.at(most, o[first], times)
    return np.bincount(o[first], minlength=n).astype(float), most


def statistics(texts: Texts) -> np.ndarray:
    """One row of FEATURES for each text."""
    size = np.diff(texts.offsets).astype(float)
    per_byte = lambda x: x / np.maximum(size, 1)
    out = {"bytes": np.log1p(size)}
    for name, table in CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(table[texts.data], dtype=np.int64)])
        out[name] = per_byte(sums[texts.offsets[1:]] - sums[texts.offsets[:-1]])
    w = words(lowered(texts), NON_SPACE)
    n = w.counts.astype(float)
    per_word = lambda x: x / np.maximum(n, 1)
    length = w.ends - w.starts
    out["words"], out["word_length"] = np.log1p(n), per_word(_per_text(w, length))
    out["longest_word"] = np.zeros(texts.n)
    owner = w.owner()
    np.maximum.at(out["longest_word"], owner, length)
    distinct, most = _distinct(w.offsets, owner, w.hashes)
    out["distinct_words"], out["top_word"] = per_word(distinct), per_word(most)
    first, runs = run_hashes(w, 3)
    out["distinct_runs"] = _distinct(w.offsets, np.searchsorted(w.offsets, first, "right") - 1, runs)[0] / np.maximum(n - 2, 1)
    lines = words(texts, _LINES)
    m = lines.counts.astype(float)
    out["lines"], out["line_words"] = np.log1p(m), n / np.maximum(m, 1)
    out["distinct_lines"] = _distinct(lines.offsets, lines.owner(), lines.hashes)[0] / np.maximum(m, 1)
    last = texts.data[w.ends - 1] if w.ends.size else texts.data[:0]
    head = texts.data[w.starts] if w.starts.size else texts.data[:0]
    out["symbol_ends"], out["stop_ends"] = per_word(_per_text(w, _SYMBOLS[last])), per_word(_per_text(w, CLASSES["stops"][last]))
    out["capital_words"] = per_word(_per_text(w, CLASSES["upper"][head]))
    out["short_words"], out["long_words"] = per_word(_per_text(w, length <= 2)), per_word(_per_text(w, length >= 12))
    return np.stack([out[f] for f in FEATURES], axis=1)


class Trees(NamedTuple):
    """Complete binary trees in flat arrays: node i has the children 2 i + 1 and 2 i + 2."""

    start: float
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray  # the right child takes values above it
    leaf: np.ndarray  # (trees, 2 ** depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = LEAST, l2: float = L2) -> Trees:
    """Boosted trees for the labels ``y`` (0 or 1)."""
    share = float(np.mean(y)) if len(y) else 0.5
    inner = 2 ** depth - 1
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1)
    flat = binned + np.arange(m) * bins
    start = float(np.log(share / (1 - share)))
    raw = np.full(n, start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, int), np.full(inner, np.inf), np.full(inner, bins)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            a, width = 2 ** level - 1, 2 ** level
            at = ((node - a)[:, None] * (m * bins) + flat).ravel()
            hist = [np.bincount(at, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2) for v in (g, h, np.ones(n))]
            G, H, N = (x[:, :1, -1:] for x in hist)
            gain = hist[0] ** 2 / (hist[1] + l2) + (G - hist[0]) ** 2 / (H - hist[1] + l2) - G ** 2 / (H + l2)
            gain[(hist[2] < least) | (N - hist[2] < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[a + k], threshold[a + k], cut[a + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf = rate * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + l2)
        raw += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(thresholds), np.array(leaves))


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """(doc_id, x, keep...): an array of FEATURES for every document."""

    def make():
        def work(batch):
            x = np.concatenate([statistics(c) for c in chunks(batch.column(1))])
            return {doc_id: batch.column(0), "x": list(x)} | {k: batch.column(2 + i) for i, k in enumerate(keep)}
        return work

    types = dict(docs.dtypes)
    return scan(docs, [as_id(doc_id), text, *keep], make, f"{doc_id} long, x array<double>" + "".join(f", {k} {types[k]}" for k in keep))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled documents that are not held out."""
    chosen = (labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
              .where(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # at most ``sample`` short rows
    got = document_statistics(rows, "_id", "_text", "_label").orderBy(F.xxhash64("_id"), "_id", F.to_json("x")).limit(sample).collect()
    return fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([float(r["_label"] > 0) for r in got]))


def quality_scores(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document."""

    def make():
        def work(batch):
            s = np.concatenate([trees.scores(statistics(c)) for c in chunks(batch.column(1))])
            return {doc_id: batch.column(0), "score": s, "predicted": (s >= 0.5).astype(np.int32)}
        return work

    return scan(docs, [as_id(doc_id), text], make, f"{doc_id} long, score double, predicted int")


def keep_quality(docs: DataFrame, trees: Trees, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that score at least ``least``."""

    def make():
        return lambda column: (np.concatenate([trees.scores(statistics(c)) for c in chunks(column)]) >= least, None)

    return scan_rows(docs, text, make)


def quality_report(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: held_out, score, predicted, from trees trained on rows not held out."""
    trees = train(docs, labels, label, doc_id, text)
    return quality_scores(docs, trees, doc_id, text).select(doc_id, held_out(doc_id).alias("held_out"), "score", "predicted")
