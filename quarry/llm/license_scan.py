"""1. Licence scans by a positional index of rare licence words.

The index holds short licence phrases and longer notices ("templates").  Every
key phrase of a template is posted under one word: the one with the highest IDF
over *all* documents.  A scan looks up the postings of a file's licence words,
which gives places where a phrase would have to start; the phrase's other words
must then stand at their relative places.  A template is reported if all its
mandatory key phrases are verified and their relative positions agree on where
the template starts, up to ``slack`` words.  Its score is the IDF-weighted share
of the template's words found at their places.

Words are runs of letters and digits after lower-casing A-Z.  Null and empty
texts have no words, no labels and score 0.  Whole texts are scanned, repeated
rows alike; phrases may overlap, and all places count.  With an empty table all
words count as equally rare.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scan import as_id, scan
from quarry.llm.words import ALNUM, chunks, lowered, words

# Fixed values of the contract: base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wording of public licence notices, label -> (text, mandatory key phrases).
NOTICES = {
    "afl-notice": ("licensed under the academic free license", ["academic free license"]),
    "agpl": ("gnu affero general public license", ["gnu affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "apache-2.0-notice": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license", "obtain a copy of the license"]),
    "boost": ("boost software license", ["boost software license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "are permitted provided that the following conditions"]),
    "cc-by-nc": ("licensed under cc by nc", ["cc by nc"]),
    "cc-by-nd": ("licensed under cc by nd", ["cc by nd"]),
    "cc-by-sa": ("licensed under cc by sa", ["cc by sa"]),
    "cc0": ("cc0 1 0 universal", ["cc0 1 0"]),
    "creative-commons-by": ("creative commons attribution", ["creative commons attribution"]),
    "epl": ("eclipse public license", ["eclipse public license"]),
    "gpl-2.0": ("gnu general public license version 2", ["gnu general public license version 2"]),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "gpl-notice": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it under the terms", "published by the free software foundation"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["copy modify and or distribute this software", "with or without fee is hereby granted"]),
    "lgpl": ("gnu lesser general public license", ["gnu lesser general public license"]),
    "mit-notice": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    "mpl": ("mozilla public license", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software", "into the public domain"]),
    "zlib": ("this software is provided as is without any express or implied warranty", ["without any express or implied warranty"]),
}


class Template(NamedTuple):
    label: str
    words: list[str]
    phrases: list[tuple[int, list[str]]]  # place in the template, words
    base: bool


def templates(base: dict[str, str] = BASE, notices: dict[str, tuple[str, list[str]]] = NOTICES) -> list[Template]:
    made = [Template(label, p.split(), [(0, p.split())], True) for p, label in base.items()]
    for label, (text, phrases) in notices.items():
        all_words = text.split()
        at = []
        for p in phrases:
            p = p.split()
            at.append((next(i for i in range(len(all_words)) if all_words[i:i + len(p)] == p), p))
        made.append(Template(label, all_words, at, False))
    return made


def word_hashes(wanted: list[str]) -> np.ndarray:
    return words(next(chunks(pa.array([" ".join(wanted)]))), ALNUM).hashes


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of documents with each licence word; bounded by the vocabulary."""
    hashes = word_hashes(vocabulary)
    order = np.argsort(hashes)

    def make():
        def work(batch):
            seen = np.zeros(len(vocabulary) + 1, np.int64)
            seen[-1] = batch.num_rows
            for c in chunks(batch.column(0)):
                w = words(lowered(c), ALNUM)
                if not w.hashes.size:
                    continue
                at = np.minimum(np.searchsorted(hashes, w.hashes, sorter=order), order.size - 1)
                hit = np.flatnonzero(hashes[order[at]] == w.hashes)
                pairs = np.unique(np.searchsorted(w.offsets, hit, "right") * len(vocabulary) + order[at[hit]])
                seen[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            return {"word": np.arange(seen.size), "n": seen}
        return work

    got = {r.word: r.n for r in scan(docs, [text], make, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.get(len(vocabulary), 0), {v: got.get(i, 0) for i, v in enumerate(vocabulary)}


class LicenceIndex:
    """Postings of the templates' key phrases under their rarest words."""

    def __init__(self, made: list[Template], n_docs: int, df: dict[str, int]):
        self.made = made
        self.vocabulary = sorted({w for t in made for w in t.words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = word_hashes(self.vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.idf = np.array([math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for w in self.vocabulary])
        self.words = [np.array([number[w] for w in t.words]) for t in made]
        #: by rare word: (template, phrase, place of the word in the phrase)
        self.postings: dict[int, list[tuple[int, int, int]]] = {}
        self.phrases = []
        for k, t in enumerate(made):
            row = []
            for j, (place, phrase) in enumerate(t.phrases):
                ids = np.array([number[w] for w in phrase])
                rare = int(np.argmax(self.idf[ids]))
                self.postings.setdefault(int(ids[rare]), []).append((k, j, rare))
                row.append((place, ids))
            self.phrases.append(row)
        self.rare = np.zeros(len(self.vocabulary), bool)
        self.rare[list(self.postings)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The licence word at each place, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.hashes.size - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def look_up(self, ids: np.ndarray) -> dict[int, tuple[list[int], float]]:
        """By template: places of its start (of its first key phrase, for base ones all places) and the best score."""
        starts: dict[tuple[int, int], list[int]] = {}
        for p in np.flatnonzero((ids >= 0) & self.rare[ids]).tolist():
            for k, j, rare in self.postings[int(ids[p])]:
                place, phrase = self.phrases[k][j]
                s = p - rare
                if s >= 0 and s + phrase.size <= ids.size and np.array_equal(ids[s:s + phrase.size], phrase):
                    starts.setdefault((k, j), []).append(s - place)
        found = {}
        for k in sorted({k for k, _ in starts}):
            slack = max(2, self.words[k].size // 5)
            rest = [np.array(starts.get((k, j), [])) for j in range(1, len(self.phrases[k]))]
            agreed = [s for s in starts.get((k, 0), []) if all(r.size and np.abs(r - s).min() <= slack for r in rest)]
            if agreed:
                found[k] = agreed, max(self.share(k, s, ids) for s in agreed)
        return found

    def share(self, k: int, start: int, ids: np.ndarray) -> float:
        at = start + np.arange(self.words[k].size)
        inside = (at >= 0) & (at < ids.size)
        same = np.zeros(at.size, bool)
        same[inside] = ids[at[inside]] == self.words[k][inside]
        weight = self.idf[self.words[k]]
        return float(weight[same].sum() / weight.sum())


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", made: list[Template] | None = None) -> DataFrame:
    """Per document: words, places of base phrases, labels of base phrases and of all templates, best score.

    ``found`` lists every reported template as label:start (words from 0)."""
    made = made or templates()
    vocabulary = sorted({w for t in made for w in t.words})
    index = LicenceIndex(made, *document_frequencies(docs, vocabulary, text))

    def make():
        def work(batch):
            n = batch.num_rows
            out = {"n_words": np.zeros(n, np.int64), "n_base": np.zeros(n, np.int64), "first_word": [None] * n, "last_word": [None] * n,
                   "base_labels": [""] * n, "labels": [""] * n, "score": np.zeros(n), "found": [[] for _ in range(n)]}
            for c in chunks(batch.column(1)):
                w = words(lowered(c), ALNUM)
                out["n_words"][c.first:c.first + c.n] = w.counts
                ids = index.numbers(w.hashes) if w.hashes.size else np.zeros(0, np.int64)
                rare = np.flatnonzero((ids >= 0) & index.rare[ids])
                for i in np.unique(np.searchsorted(w.offsets, rare, "right") - 1).tolist():
                    found = index.look_up(ids[w.offsets[i]:w.offsets[i + 1]])
                    if not found:
                        continue
                    r = c.first + i
                    base = [s for k, (places, _) in found.items() if made[k].base for s in places]
                    out["n_base"][r] = len(base)
                    if base:
                        out["first_word"][r], out["last_word"][r] = min(base), max(base)
                    out["base_labels"][r] = ",".join(sorted({made[k].label for k in found if made[k].base}))
                    out["labels"][r] = ",".join(sorted({made[k].label for k in found}))
                    out["score"][r] = max(x for _, x in found.values())
                    out["found"][r] = sorted(f"{made[k].label}:{s}" for k, (places, _) in found.items() for s in places)
            return out | {doc_id: batch.column(0)}
        return work

    return scan(docs, [as_id(doc_id), text], make, f"{doc_id} long, n_words long, n_base long, first_word long, last_word long, "
                "base_labels string, labels string, score double, found array<string>")
