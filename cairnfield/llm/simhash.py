"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is read as 32 segments of two bits; a segment's bit count
is 0, 1 or 2.  The Manhattan distance of two such count vectors never exceeds
the Hamming distance of the fingerprints, so it is a lower bound to prune by.

Within radius 3 the distances of the two 16-segment halves add up to at most 3,
so in one half the vectors are at most 1 apart.  The grid range-join uses that:
its cells are (half, packed count vector); every fingerprint lies in two cells
and is looked up in them and in the cells at distance 1.  Two vectors at
distance 1 differ in the parity of their sum, so only odd ones look into
neighbouring cells, which halves the probes.  A pair that meets is held against
the Manhattan bound of all 32 segments and then against the Hamming distance
itself, inside the join's condition, so no list of candidates is written.

Cases: a null or empty text has fingerprint zero and is linked like any other;
repeated rows and ties give equal fingerprints; a null ``doc_id`` is kept and
never becomes a component's id unless the component has no other; other columns
of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, popcount, words_of

#: Hashes per block of counting: bounds memory for very long texts.
CHUNK = 1 << 15
LOW = 0x5555555555555555
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that over half the hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, k: int = 3) -> int:
    """Unsigned SimHash of a text: lower-cased A-Z, ``k``-word shingles with repeats, XXH64 seed 42."""
    words = [w.lower() for w in words_of(text)]
    n = len(words) - k + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(k)))), dtype="<u8", count=n))


def with_fingerprint(df: DataFrame, text: str = "text", k: int = 3, name: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, k) for t in texts], dtype=np.uint64).view(np.int64))

    return df.withColumn(name, fp(F.col(text)))


def counts_of(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of 32 bits, two bits each."""
    return half.bitwiseAND(F.lit(0x55555555)) + F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))


def unary(fp: Column) -> Column:
    """Segment counts in unary, two bits each: Hamming distance here is Manhattan distance of the counts."""
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(F.lit(LOW)), 1))


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Pairs ``(a, b)`` with a < b of distinct fingerprints that differ in 1 to 3 bits."""
    base = fps.select(F.col(fp).alias("fp"))
    own, near = [], []
    for h, half in enumerate((F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))):
        packed = counts_of(half)
        own.append(packed + F.lit(h << 34))
        odd = popcount(packed.bitwiseAND(F.lit(0x55555555))) % 2 == 1  # counts of 1 are the odd ones
        for i in range(16):
            field = F.shiftright(packed, 2 * i).bitwiseAND(F.lit(3))
            near.append(F.when(odd & (field < 2), packed + F.lit((h << 34) + (1 << 2 * i))))
            near.append(F.when(odd & (field > 0), packed + F.lit((h << 34) - (1 << 2 * i))))
    stored = base.select("fp", F.explode(F.array(*own)).alias("cell"))
    probes = base.select("fp", F.explode(F.array(*own, *near)).alias("cell")).where("cell is not null")
    l, r = probes.alias("l"), stored.alias("r")
    met = l.join(
        r,
        (F.col("l.cell") == F.col("r.cell"))
        & (F.col("l.fp") != F.col("r.fp"))
        & (popcount(unary(F.col("l.fp")).bitwiseXOR(unary(F.col("r.fp")))) <= 3)
        & (popcount(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= 3),
    )
    return met.select(F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Documents with one fingerprint are summed up first, so a group of exact
    copies of any size is one row from the search for links on.
    """
    fps = cut(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", k).select("doc_id", "fp"), "fps")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(distinct))
    rooted = distinct.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(ids, "root").select("fp", "component_id"), "named")
    drop(root, distinct)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
