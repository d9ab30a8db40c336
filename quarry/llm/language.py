"""5. Language ID by a linear-chain conditional random field over words.

Every word of a line gets a label.  A word's scores come from hashed affixes and byte
n-grams and from a lexicon (the languages in which the training words were seen); the
transitions between neighbouring labels are learned with them.  Forward-backward
gives each word's marginals, so a passage in another language is labelled as such, and
a document's language is the one with the largest sum of marginals over its words.
Its score is that language's share.

Training is by Adagrad on the conditional log-likelihood, on at most ``runs`` runs of
``run_words`` words a language, drawn by hash from all texts that are not held out.
One half makes the lexicon, the other the weights.  Training lines join two runs, half
of them from different documents of any language, so that transitions are learned.

Words are runs of letters; chains are lines.  A null text or one without a letter is
``und`` with score 0.  A null language teaches nothing; with no language to learn
from, every text is ``und``.  Repeated rows are labelled alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scan import as_id, held_out, scan, scan_rows
from quarry.llm.words import Texts, Words, chunks, lowered, mix64, words

UNDETERMINED = "und"
#: Training runs a language at most (about: drawn by hash), words in a run, hashed features.
RUNS, RUN_WORDS, BUCKETS = 2500, 24, 1 << 15

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_U = np.uint64


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every feature: prefixes and suffixes of 1 to 3 bytes, byte bigrams and trigrams."""
    length = ends - starts
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint64)
    who, what = [], []

    def add(kind: int, at: np.ndarray, owner: np.ndarray, n: int):
        code = np.full(at.size, kind, np.uint64)
        for j in range(n):
            code = code * _U(257) + padded[at + j] + _U(1)
        who.append(owner)
        what.append((mix64(code) % _U(BUCKETS)).astype(np.int64))

    for n in (1, 2, 3):
        long = np.flatnonzero(length >= n)
        add(n, starts[long], long, n)
        add(3 + n, ends[long] - n, long, n)
    for n in (2, 3):
        count = np.maximum(length - n + 1, 0)
        owner = np.repeat(np.arange(starts.size), count)
        inside = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)
        add(6 + n, starts[owner] + inside, owner, n)
    whole = np.arange(starts.size)
    who.append(whole)
    what.append(np.zeros(starts.size, np.int64))  # bias
    who, what = np.concatenate(who), np.concatenate(what)
    order = np.argsort(who, kind="stable")
    return who[order], what[order]


class Chain:
    """Lines of one to many words, longest first, for forward-backward over all at once."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]
        steps = int(lengths.max()) if lengths.size else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(1, steps + 1), "right")

    def marginals(self, emission: np.ndarray, move: np.ndarray, pairs: bool = False):
        """(marginals of words, sum of pair marginals or None) from exp scores."""
        k = move.shape[0]
        alpha, gamma = np.empty_like(emission), np.empty_like(emission)
        a = None
        for t, n in enumerate(self.active.tolist()):
            at = self.starts[:n] + t
            a = emission[at] if a is None else (a[:n] @ move) * emission[at]
            a = a / a.sum(axis=1, keepdims=True)
            alpha[at] = a
        total = np.zeros((k, k))
        beta = np.ones((self.starts.size, k))
        for t in range(len(self.active) - 1, -1, -1):
            n = int(self.active[t])
            at = self.starts[:n] + t
            g = alpha[at] * beta[:n]
            gamma[at] = g / g.sum(axis=1, keepdims=True)
            if t:
                after = emission[at] * beta[:n]
                if pairs:
                    x = alpha[at - 1][:, :, None] * move[None] * after[:, None, :]
                    total += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                b = after @ move.T
                beta[:n] = b / b.sum(axis=1, keepdims=True)
        return gamma, total if pairs else None


class Model:
    """Weights of the field; empty without languages."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages = languages
        self.weights = np.zeros((BUCKETS, k))
        self.lexicon_weights = np.eye(k)
        self.move = np.zeros((k, k))
        self.lexicon_words = np.zeros(0, np.uint64)
        self.lexicon = np.zeros((0, k))

    def lexicon_rows(self, hashes: np.ndarray) -> np.ndarray:
        rows = np.zeros((hashes.size, len(self.languages)))
        if self.lexicon_words.size:
            at = np.minimum(np.searchsorted(self.lexicon_words, hashes), self.lexicon_words.size - 1)
            known = self.lexicon_words[at] == hashes
            rows[known] = self.lexicon[at[known]]
        return rows

    def scores(self, who: np.ndarray, what: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        """Scores of the labels for ``n`` different words."""
        total = np.stack([np.bincount(who, self.weights[what, j], n) for j in range(len(self.languages))], axis=1)
        return total + rows @ self.lexicon_weights

    def label(self, texts: Texts) -> tuple[Words, np.ndarray]:
        """The words of some texts and the marginals of their labels."""
        low = lowered(texts)
        w = words(low, _LETTERS)
        k = len(self.languages)
        if not w.starts.size or not k:
            return w, np.zeros((w.starts.size, k))
        kinds, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        who, what = _features(low.data, w.starts[first], w.ends[first])
        s = self.scores(who, what, kinds.size, self.lexicon_rows(kinds))
        emission = np.exp(np.clip(s - s.max(axis=1, keepdims=True), -40, 0))[which]
        line = np.cumsum(low.data == 0x0A)[w.starts]
        owner = w.owner()
        starts = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])]))
        chain = Chain(starts, np.diff(np.concatenate([starts, [w.starts.size]])))
        move = np.exp(self.move - self.move.max())
        return w, chain.marginals(emission, np.maximum(move, 1e-12))[0]

    def documents(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of every text of a column."""
        found, scores = [], []
        for c in chunks(column):
            w, marginals = self.label(c)
            if not self.languages:
                found += [UNDETERMINED] * c.n
                scores += [0.0] * c.n
                continue
            sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(marginals, axis=0)])
            sums = sums[w.offsets[1:]] - sums[w.offsets[:-1]]
            best = sums.argmax(axis=1)
            plain = np.concatenate([[0], np.cumsum(_LETTERS[lowered(c).data] & (c.data < 0x80))])
            plain = plain[c.offsets[1:]] > plain[c.offsets[:-1]]
            for i in range(c.n):
                if plain[i] or (w.counts[i] and any(map(str.isalpha, c.raw(i).decode("utf-8", "replace")))):
                    found.append(self.languages[best[i]])
                    scores.append(float(min(1.0, sums[i, best[i]] / max(1, w.counts[i]))))
                else:
                    found.append(UNDETERMINED)
                    scores.append(0.0)
        return found, np.array(scores)


def fit(languages: list[str], runs: list[tuple[int, str]], epochs: int = 6, batch: int = 400, rate: float = 0.3, l2: float = 1e-4, seed: int = 3) -> Model:
    """The field from (language, run of words) pairs."""
    model = Model(languages)
    k = len(languages)
    if not k or not runs:
        return model
    rng = np.random.default_rng(seed)
    runs = [runs[i] for i in rng.permutation(len(runs))]
    half = len(runs) // 2 if len(runs) > 20 else 0

    def scanned(part):
        c = next(chunks(pa.array([t for _, t in part]), 1 << 62))
        return lowered(c), words(lowered(c), _LETTERS), np.array([y for y, _ in part])

    if half:
        _, w, y = scanned(runs[:half])
        kinds, which = np.unique(w.hashes, return_inverse=True)
        counts = np.zeros((kinds.size, k))
        np.add.at(counts, (which, np.repeat(y, w.counts)), 1)
        smooth = counts + 0.2
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        model.lexicon_words, model.lexicon = kinds, logs - logs.mean(axis=1, keepdims=True)
    low, w, y = scanned(runs[half:])
    kinds, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
    who, what = _features(low.data, w.starts[first], w.ends[first])
    rows = model.lexicon_rows(kinds)
    n_runs = y.size
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.lexicon_weights, model.move)]
    for _ in range(epochs):
        partner = rng.permutation(n_runs)
        joined = rng.random(n_runs) < 0.5
        for a in range(0, n_runs, batch):
            lines, labels, lengths = [], [], []
            for i in range(a, min(a + batch, n_runs)):
                at = [np.arange(w.offsets[i], w.offsets[i + 1])]
                of = [np.full(at[0].size, y[i])]
                if joined[i]:
                    j = partner[i]
                    at.append(np.arange(w.offsets[j], w.offsets[j + 1]))
                    of.append(np.full(at[1].size, y[j]))
                lines += at
                labels += of
                lengths.append(sum(x.size for x in at))
            at, labels, lengths = np.concatenate(lines), np.concatenate(labels), np.array(lengths)
            lengths = lengths[lengths > 0]
            if not at.size:
                continue
            starts = np.cumsum(lengths) - lengths
            s = model.scores(who, what, kinds.size, rows)
            emission = np.exp(np.clip(s - s.max(axis=1, keepdims=True), -40, 0))[which[at]]
            gamma, pairs = Chain(starts, lengths).marginals(emission, np.exp(model.move), pairs=True)
            miss = -gamma
            miss[np.arange(at.size), labels] += 1
            by_word = np.stack([np.bincount(which[at], miss[:, j], kinds.size) for j in range(k)], axis=1)
            inner = np.ones(at.size, bool)
            inner[starts] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
            grads = [np.stack([np.bincount(what, by_word[who, j], BUCKETS) for j in range(k)], axis=1), rows.T @ by_word, seen - pairs]
            for value, square, g in zip((model.weights, model.lexicon_weights, model.move), squares, grads, strict=True):
                g = g / lengths.size - l2 * value
                square += g * g
                value += rate * g / np.sqrt(square)
    return model


def train(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", runs: int = RUNS, run_words: int = RUN_WORDS) -> Model:
    """A model from about ``runs`` runs of words for each language of the rows not held out."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & ~held_out("id"))

    def count():
        def work(batch):
            n = np.zeros(batch.num_rows, np.int64)
            for c in chunks(batch.column(1)):
                n[c.first:c.first + c.n] = -(-words(lowered(c), _LETTERS).counts // run_words)
            return {"lang": batch.column(0), "n": n}
        return work

    totals = {r.lang: r.n for r in scan(rows, ["lang", "text"], count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(x for x, n in totals.items() if n)
    if not languages:
        return Model([])
    share = {x: min(1.0, runs / totals[x]) for x in languages}

    def draw():
        def work(batch):
            out = {"lang": [], "run": []}
            langs = batch.column(0).to_pylist()
            ids = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            ids = np.nan_to_num(ids).astype(np.int64).view(np.uint64)
            for c in chunks(batch.column(2)):
                low = lowered(c)
                w = words(low, _LETTERS)
                n = -(-w.counts // run_words)
                owner = np.repeat(np.arange(c.n), n)
                number = np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)
                u = mix64(mix64(ids[c.first + owner] + _U(1)) + number.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) / 2.0 ** 64
                limit = np.array([share.get(langs[c.first + i], 0.0) for i in range(c.n)])
                for i, r in zip(owner[u < limit[owner]].tolist(), number[u < limit[owner]].tolist(), strict=True):
                    a = int(w.offsets[i]) + r * run_words
                    b = min(a + run_words, int(w.offsets[i + 1]))
                    out["lang"].append(langs[c.first + i])
                    out["run"].append(b" ".join(low.data[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)).decode("utf-8", "replace"))
            return out
        return work

    got = sorted((languages.index(r.lang), r.run) for r in scan(rows, ["lang", "id", "text"], draw, "lang string, run string").collect())
    return fit(languages, got)


def language_labels(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS and the training runs

    def make():
        def work(batch):
            found, scores = shared.value.documents(batch.column(1))
            return {doc_id: batch.column(0), "lang_pred": found, "score": scores}
        return work

    return scan(docs, [as_id(doc_id), text], make, f"{doc_id} long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents with a language that holds at least ``least`` of their words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(column):
            found, scores = shared.value.documents(column)
            return (np.array(found) != UNDETERMINED) & (scores >= least), None
        return work

    return scan_rows(docs, text, make)


def language_report(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: held_out, lang_pred, score, from a model of the rows not held out."""
    model = train(docs, lang, doc_id, text)
    return language_labels(docs, model, doc_id, text).select(doc_id, held_out(doc_id).alias("held_out"), "lang_pred", "score")
