"""The pipeline's stages against brute force on a small table."""

import itertools
import random
import re

import corpus_pipeline
from quarry.llm.scan import stored

from test_operators import alnum, shingles

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(8, 80))) for _ in range(60)]
    for t in texts[:15]:  # copies, near copies, and others less near
        for change in (0, 1, 2, 6):
            w = t.split()
            for _ in range(change):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    items = [" ".join(word() for _ in range(20)) for _ in range(4)]
    texts += [f"{texts[i]} {items[i]} {texts[i + 20]}" for i in range(4)] + [" ".join(texts[20:50]) + " " + items[0][:1]]
    texts += ["a note password = abcdefgh12345678 here " + word(), None, "", "123 !!!"]
    docs = spark.createDataFrame([(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out, names = {}, [n for n, _ in corpus_pipeline.STAGES]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stored(stage(spark, at, str(tmp_path)))
        out[name] = {r.doc_id: r for r in at.collect()}
        if name != names[-1]:
            assert at.columns == docs.columns

    assert set(out["language"]) == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    sets = {i: shingles(texts[i], 5) for i in out["language"]}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert set(out["near_duplicates"]) == {i for i in sets if root(i) == i}

    windows = {tuple(w[k:k + 13]) for w in map(alnum, items) for k in range(len(w) - 12)}

    def contaminated(t):
        w = alnum(t)
        hit = {k for s in range(len(w) - 12) if tuple(w[s:s + 13]) in windows for k in range(s, s + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)
    assert set(out["decontamination"]) == {i for i in out["near_duplicates"] if not contaminated(texts[i])}
    assert set(out["secrets"]) == set(out["decontamination"])
    for i, r in out["secrets"].items():
        assert r.n_chars == len(r.text) and "abcdefgh12345678" not in r.text
        assert "password" in (texts[i] or "") or r.text == texts[i]
    total = sum(len(WORDS.findall(r.text)) for r in out["secrets"].values())
    mixed = at.collect()
    longest = max(len(WORDS.findall(r.text)) for r in out["secrets"].values())
    assert abs(sum(r._words for r in mixed) - 1.5 * total) <= 3 * (longest / 2 + 0.5)  # whole texts of three sources
    assert all(r.text == out["secrets"][r.doc_id].text for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)
