"""9. Token counts from distinct pre-tokens, without materialising ids.

1. A scan cuts every whole text into pre-tokens and writes *blocks*: some
   documents (about ``block_bytes`` of text, ``block_rows`` documents at most) with the block's distinct pre-tokens
   once, and for each document the places of its pre-tokens in that list with
   their frequencies.  A pre-token is never repeated inside a block.
2. The lists are dealt and sorted by pre-token (one row for a block and pre-token,
   whatever the number of documents), so that equal ones stand together and the
   library counts the pieces of each exactly once.
3. The counts go back to their blocks, meet the documents' frequencies there, and
   are summed.

So the shuffles carry a block's vocabulary, not its text.  A block is bounded by
``block_bytes`` plus one document and by ``block_rows``; a pre-token in all blocks has one row a block.

Pre-tokens are those of the tokenizer's byte-level rule; a special string in a
text is one token, as by the library's default.  Null and empty texts have no
bytes and no tokens.  Repeated rows are counted alike.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.scan import as_id, scan, small_batches, stored

# Fixed value: the byte-level pre-token rule.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a block, and its documents: many null or empty texts fill no block by their bytes.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 1 << 18


class PreTokens:
    """The distinct pre-tokens of a text with their frequencies."""

    def __init__(self, tokenizer_json: str):
        made = json.loads(tokenizer_json)
        kind = made["pre_tokenizer"]
        if made["normalizer"] is not None or kind["type"] != "ByteLevel" or not kind["use_regex"] or kind["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without normaliser or prefix space is needed")
        added = made["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special strings must match as they stand")
        self.special = regex.compile("|".join(sorted((regex.escape(t["content"]) for t in added), key=len, reverse=True))) if added else None
        self.rule = regex.compile(PRE_TOKEN)
        self.known = set(map(chr, range(128)))
        self.library = Tokenizer.from_str(tokenizer_json).pre_tokenizer

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii() and (new := set(text) - self.known):
            # the two libraries differ on characters that only the newest Unicode assigns
            if any(unicodedata.category(c) == "Cn" for c in new):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
            self.known |= new
        return self.rule.findall(text)

    def __call__(self, text: str) -> Counter:
        if self.special is None or not self.special.search(text):
            return Counter(self._pieces(text))
        found: Counter = Counter(self.special.findall(text))
        for part in self.special.split(text):
            found.update(self._pieces(part))
        return found


def _packed(places: list[np.ndarray], times: list[np.ndarray]) -> bytes:
    """Each document's sorted places (as steps) and frequencies, small numbers compressed."""
    n = [p.size for p in places]
    flat = np.empty(1 + len(n) + 2 * sum(n), "<u4")
    flat[:len(n) + 1] = [len(n), *n]
    at, half = len(n) + 1, sum(n)
    for p, t in zip(places, times, strict=True):
        order = np.argsort(p, kind="stable")
        flat[at:at + p.size] = np.diff(p[order], prepend=0)
        flat[at + half:at + half + p.size] = t[order]
        at += p.size
    planes, z = flat.view(np.uint8).reshape(-1, 4), zlib.compressobj(1)
    return b"".join([*(z.compress(np.ascontiguousarray(planes[:, k])) for k in range(4)), z.flush()])


def _summed(packed: bytes, pieces: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Each document's sum of frequency times ``pieces`` at its places, worked out for
    some documents at a time (about ``step`` places, or one document)."""
    flat = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    n = int(flat[0])
    ends = np.concatenate([[0], np.cumsum(flat[1:n + 1], dtype=np.int64)])
    steps, times = flat[n + 1:].reshape(2, -1)
    sums, first = np.zeros(n, np.int64), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, "right")) - 1)
        lo, hi, runs = ends[first], ends[last], ends[first:last + 1] - ends[first]
        total = np.concatenate([[0], np.cumsum(steps[lo:hi], dtype=np.int64)])
        at = total[1:] - np.repeat(total[runs[:-1]], np.diff(runs))
        sums[first:last] = np.diff(np.concatenate([[0], np.cumsum(pieces[at] * times[lo:hi])])[runs])
        first = last
    return sums


def pretoken_blocks(docs: DataFrame, tokenizer_json: str, doc_id: str = "doc_id", text: str = "text",
                    block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of documents: ids, sizes, distinct pre-tokens, and packed for each document
    the places of its pre-tokens in that list with their frequencies."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("pre", pa.list_(pa.string())), ("uses", pa.binary())])

    def run(batches):
        pre = PreTokens(tokenizer_json)

        def fresh():
            return [], [], {}, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((ids, sizes, list(place), _packed(places, times)), schema, strict=True)], schema=schema)

        ids, sizes, place, places, times, held = fresh()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = t or ""
                found = pre(t)
                ids.append(i)
                sizes.append(len(t) if t.isascii() else len(t.encode()))
                places.append(np.fromiter((place.setdefault(p, len(place)) for p in found), np.int32, len(found)))
                times.append(np.fromiter(found.values(), np.int32, len(found)))
                held += sizes[-1]
                if held >= block_bytes or len(ids) >= block_rows:
                    yield row()
                    ids, sizes, place, places, times, held = fresh()
        if ids:
            yield row()

    return docs.select(as_id(doc_id), F.col(text).alias("text")).mapInArrow(
        run, "doc_ids array<long>, n_bytes array<long>, pre array<string>, uses binary")


def count_pieces(listed: DataFrame, tokenizer_json: str) -> DataFrame:
    """``listed`` (block, place, pre) with ``pieces`` for ``pre``.

    All rows of a pre-token stand together, one for each block that has it, and the
    library counts it once."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = Tokenizer.from_str(tokenizer_json)
        last, pieces = None, 0

        def work(batch):
            nonlocal last, pieces
            runs = pc.run_end_encode(batch.column(2))
            texts, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            known = texts[0] == last
            counts = ([pieces] if known else []) + [len(e) for e in tokenizer.encode_batch_fast(texts[known:], add_special_tokens=False)]
            last, pieces = texts[-1], counts[-1]
            return {"block": batch.column(0), "place": batch.column(1), "pieces": np.repeat(counts, np.diff(ends, prepend=0))}
        return work

    return scan(listed.repartition("pre").sortWithinPartitions("pre"), ["block", "place", "pre"], make, "block long, place int, pieces int")


def token_counts(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = 1024, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document: n_bytes, n_tokens, and whether the tokens exceed ``limit``."""
    with open(tokenizer_file, encoding="utf-8") as f:  # the driver's file goes to the workers with the task
        tokenizer_json = f.read()
    blocks = stored(pretoken_blocks(docs, tokenizer_json, doc_id, text, block_bytes, block_rows)
                    .withColumn("block", F.monotonically_increasing_id()))
    listed = blocks.select("block", F.posexplode("pre").alias("place", "pre"))
    counted = count_pieces(listed, tokenizer_json).withColumnRenamed("block", "in_block")
    schema = pa.schema([(doc_id, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def total(block: pa.Table, pieces: pa.Table) -> pa.Table:
        ids, sizes = block["doc_ids"].combine_chunks().values, block["n_bytes"].combine_chunks().values
        by_place = np.zeros(pieces.num_rows, np.int64)
        by_place[pieces["place"].to_numpy()] = pieces["pieces"].to_numpy()
        n = _summed(block["uses"][0].as_py(), by_place)
        return pa.table([ids, sizes, pa.array(n), pa.array(n > limit)], schema=schema)

    return (blocks.drop("pre").groupBy("block").cogroup(counted.groupBy("in_block"))
            .applyInArrow(total, f"{doc_id} long, n_bytes long, n_tokens long, over_limit boolean"))
