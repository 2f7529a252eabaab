"""Benchmark decontamination by SimHash over item-sized windows.

Texts are lower-cased and cut into words of letters and digits.  An item of L
words is looked for in every window of L words of every whole text; a text of
fewer words is one window for it:

1. A window whose 5-word shingles are to agree to ``threshold`` with an item's
   must hold at least ``t/(1+t)`` of the shingles of both together, which is
   ``2t/(1+t)`` of its own where both have as many.  Windows with fewer are
   passed over; nothing that the last step could accept is lost.
2. Each window left gets a 64-bit SimHash of its words.
3. Fingerprints are looked up in a multi-index: RADIUS + 1 blocks of bits, so
   that two fingerprints at most RADIUS bits apart agree in one block at least.
4. Candidates within RADIUS are held to the exact weighted similarity of their
   shingles, sum of minima over sum of maxima of the counts.

The items travel to the executors in blocks of a bounded number of characters;
where the benchmark is larger than one block, the documents are read once for
each, so nothing unbounded is broadcast.

Cases: null or empty texts hold nothing; an item without words is never found;
items under five words are one shingle; repeated rows give repeated hits; null
ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut

SHINGLE = 5
THRESHOLD = 0.8
#: Windows at the threshold are 8 of 64 bits away on average, with a deviation of under 3.
RADIUS = 15
#: Characters of benchmark text in one broadcast block: some 700,000 shingles in the index of each Python worker.
BLOCK_CHARS = 4_000_000
TOKEN = re.compile(r"[^\W_]+")
#: Windows fingerprinted at once: bounds memory.
CHUNK = 4096
EDGES = np.linspace(0, 64, RADIUS + 2).astype(int)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def shingles(words: list[str], k: int = SHINGLE) -> list[tuple[str, ...]]:
    k = min(k, len(words))
    return list(zip(*(words[i:] for i in range(k)))) if k else []


def bits_of(word: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"), 7), np.uint8)).astype(np.int32)


def fingerprints(words: list[str], starts: np.ndarray, size: int, known: dict[str, np.ndarray]) -> np.ndarray:
    """SimHash (unsigned) of the windows of ``size`` words at ``starts``, from running bit counts."""
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), CHUNK):
        part = starts[at : at + CHUNK]
        first = int(part[0])
        span = words[first : int(part[-1]) + size]
        run = np.zeros((len(span) + 1, 64), np.int32)
        for i, w in enumerate(span):
            if (b := known.get(w)) is None:
                b = known[w] = bits_of(w)
            run[i + 1] = b
        run = run.cumsum(axis=0)
        rel = part - first
        out[at : at + CHUNK] = np.packbits(2 * (run[rel + size] - run[rel]) > size, axis=1).view(">u8")[:, 0]
    return out


def blocks_of(fp: int) -> list[int]:
    return [(fp >> int(a)) & ((1 << int(b - a)) - 1) for a, b in zip(EDGES, EDGES[1:])]


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class Index:
    """The items of one block, by size, shingle and fingerprint block."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items = [(i, w, Counter(shingles(w))) for i, w in ((i, tokens(t)) for i, t in items) if w]
        self.by_size: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        self.sizes_of: dict[tuple[str, ...], set[int]] = defaultdict(set)
        known: dict[str, np.ndarray] = {}
        self.prints = []
        for k, (_, words, counts) in enumerate(self.items):
            fp = int(fingerprints(words, np.zeros(1, np.int64), len(words), known)[0])
            self.prints.append(fp)
            for b, v in enumerate(blocks_of(fp)):
                self.by_size[len(words)][b, v].append(k)
            for s in counts:
                self.sizes_of[s].add(len(words))
        self.shingles = set(self.sizes_of)
        self.short = {len(s) for s in self.shingles if len(s) < SHINGLE}

    def find(self, text: str | None) -> Iterator[tuple[int | None, float, int, int]]:
        """``(item_id, similarity, first word, words)``: the best window of each item found."""
        words = tokens(text)
        for k in [SHINGLE, *self.short]:
            grams = zip(*(words[i:] for i in range(k)))
            if not self.shingles.isdisjoint(grams):
                yield from self._near(words, k)

    def _near(self, words: list[str], k: int) -> Iterator[tuple[int | None, float, int, int]]:
        grams = list(zip(*(words[i:] for i in range(k))))
        hit = np.fromiter((g in self.shingles for g in grams), bool, len(grams))
        held = np.concatenate(([0], hit.cumsum()))
        sizes = set().union(*(self.sizes_of[grams[i]] for i in np.flatnonzero(hit)))
        best: dict[int, tuple[float, int]] = {}
        known: dict[str, np.ndarray] = {}
        for size in sorted(s for s in sizes if min(s, SHINGLE) == k):
            # an item longer than the text is held against the whole of it
            width = min(size, len(words))
            own = width - k + 1
            least = np.ceil(self.threshold / (1 + self.threshold) * (own + size - k + 1) - 1e-9)
            starts = np.flatnonzero(held[own:] - held[:-own] >= least)
            if not len(starts):
                continue
            index = self.by_size[size]
            # starts far from each other are fingerprinted apart, so that memory follows their number
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
                for start, fp in zip(run.tolist(), fingerprints(words, run, width, known).tolist()):
                    near = {i for b, v in enumerate(blocks_of(fp)) for i in index.get((b, v), ())}
                    near = [i for i in near if (self.prints[i] ^ fp).bit_count() <= RADIUS]
                    if near:
                        counts = Counter(grams[start : start + own])
                        for i in near:
                            s = similarity(counts, self.items[i][2])
                            if s >= self.threshold and s > best.get(i, (0.0, 0))[0]:
                                best[i] = (s, start)
        for i, (s, start) in best.items():
            yield self.items[i][0], s, start, min(len(self.items[i][1]), len(words))


def item_blocks(benchmark: DataFrame, item_id: str, text: str, most: int = BLOCK_CHARS) -> Iterator[tuple[list[tuple[int | None, str | None]], bool]]:
    """The benchmark in lists of about ``most`` characters, by the size that is measured first, and whether each is the last."""
    b = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    chars = b.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 + chars // most
    for k in range(n):
        part = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else b
        yield [(r.i, r.t) for r in part.collect()], k == n - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, n_words)`` for every document and item found in it."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, similarity double, start_word long, n_words long"

    def scan(held) -> DataFrame:
        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(held.value, threshold)
            for batch in batches:
                ids, out = batch.column(0), []
                for row, t in enumerate(batch.column(1)):
                    out += [(ids[row].as_py(), *h) for h in index.find(t.as_py())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

        kinds = arrow_schema(schema)
        return narrow.mapInArrow(hits, schema)

    found = []
    for block, last in item_blocks(benchmark, item_id, item_text):
        held = spark.sparkContext.broadcast(block)
        found.append(scan(held) if last else cut(scan(held), "hits"))
        if not last:
            # written before the next block is read, so that one block at a time is held
            held.destroy()
    return reduce(DataFrame.unionByName, found)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no item is found; texts stay where they are, a flag is made beside them."""
    for block, last in item_blocks(benchmark, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.where(~_flag(held, threshold)(F.col(text)))
        if not last:
            # written before the next block is read, so that one block at a time is held
            docs = cut(docs, "clean")
            held.destroy()
    return docs


def _flag(held, threshold: float):
    kept: dict[str, Index] = {}

    @F.pandas_udf("boolean")
    def flag(texts: pd.Series) -> pd.Series:
        if "index" not in kept:
            kept["index"] = Index(held.value, threshold)
        index = kept["index"]
        return pd.Series([next(index.find(t), None) is not None for t in texts], dtype=bool)

    return flag
