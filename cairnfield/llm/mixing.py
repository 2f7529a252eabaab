"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each document of a source expects ``target / source size`` copies.  Documents
stand in order of size class and then of a hash of their id; the prefix sum of
expected copies, moved by one random offset per source, crosses some whole numbers
at each document, and that many copies are emitted.  As sizes rise along the order,
every size class gets its share whatever the offset, so the words taken come near
the target even in sources with few or very unequal documents.

The prefix sum is made in two levels so that a hot source is never one task:
documents are dealt into blocks of a size class and 256 parts of the hash, the
block counts are summed up along the order, and rows are numbered in their block.
Texts stay out of this: narrow rows are numbered, and the copies are joined back.
Sums are fixed-point whole numbers, so no document crosses more boundaries than its
expected copies, rounded up, and reruns agree.

Cases: a null or empty text has size 0; texts of any length are counted whole; a null
source is a source of its own, last in order; a source of size 0 has target 0 and no
copies; rows that agree in id, source and text are one document, of which all their
copies are made; other columns stay, but those with the name of a result column are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
ONE = 1 << 40
SEED = "mix-1"
#: Hexadecimal digits of the hash that deal the rows of a size class into 256 blocks.
DIGITS = 2


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """``(source, source_size, weight, target)``: the total shared by weight, none above MAX_COPIES times its size.

    With the share per unit of weight rising from source to source in order of
    ``MAX_COPIES * size / weight``, the sources before the first one that can
    hold its share are the capped ones; the rest goes to the others by weight.
    This table has a row per source and is the only one in a single task.
    """
    s = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place - 1) % len(WEIGHTS) + 1).cast("long"))
    full = F.lit(MAX_COPIES) * F.col("source_size")
    s = s.withColumn("room", full / F.col("weight"))
    run, every = Window.orderBy("room", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(every) - F.sum(full).over(run) + full)
    s = s.withColumn("share", F.col("left") / (F.sum("weight").over(every) - F.sum("weight").over(run) + F.col("weight")))
    s = s.withColumn("level", -F.min(F.when(F.col("share") <= F.col("room"), F.struct("room", (-F.col("share")).alias("s")))).over(every)["s"])
    return s.select("source", "source_size", "weight", F.least(full.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def offset(key: Column, seed: str) -> Column:
    """A number below ONE that depends on the source and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 10), 16, 10).cast("long")


def size_class(size: str) -> Column:
    """Log-linear class of a size, as text in order: exact below 16, then 8 classes for each doubling."""
    shift = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return F.lpad((F.call_function("shiftright", F.col(size), shift) + 8 * shift).cast("string"), 3, "0")


def ranked(sized: DataFrame) -> DataFrame:
    """Add the block ``(key, block)`` of each row and its number ``i`` in it."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = sized.withColumns({"key": _key("source"), "hash": digest, "block": F.concat(size_class("size"), F.substring(digest, 1, DIGITS))})
    return d.withColumn("i", F.row_number().over(Window.partitionBy("key", "block").orderBy("hash", "doc_id", "size", "tie"))).drop("hash")


def crossings(i: str, rate: str) -> tuple[Column, Column]:
    """Whole part and rest of ``i * rate / ONE``; decimals, as the product can pass a long."""
    product = f"cast({i} as decimal(20,0)) * cast({rate} as decimal(18,0))"
    whole = F.expr(f"({product}) div cast({ONE} as decimal(20,0))")
    return whole, F.expr(f"cast(({product}) % cast({ONE} as decimal(20,0)) as bigint)")


def with_copies(sized: DataFrame, seed: str = SEED) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to narrow rows of ``doc_id``, ``source``, ``size`` and ``tie``."""
    t = targets(sized).select(
        _key("source").alias("key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE)).otherwise(0).cast("long").alias("rate"),
    )
    rows = ranked(sized)
    run = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy("key", "block").agg(F.count("*").alias("n"))
    plan = cut(counts.withColumn("before", F.sum("n").over(run) - F.col("n")).drop("n").join(t, "key"), "plan")
    w0, r0 = crossings("before + i - 1", "rate")
    w1, r1 = crossings("before + i", "rate")
    d = rows.join(plan, ["key", "block"]).withColumns({"w0": w0, "r0": r0, "w1": w1, "r1": r1, "shift": offset(F.col("key"), seed)})
    up = lambda rest: (F.col(rest) + F.col("shift") >= ONE).cast("long")
    return d.withColumn("copies", F.col("w1") - F.col("w0") + up("r1") - up("r0")).select(*sized.columns, "source_size", "target", "copies")


def narrow_rows(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("tie"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mixture itself: every document once per copy, with ``copy`` counting from 0."""
    docs = docs.drop(*(c for c in ("size", "source_size", "target", "copies", "copy") if c in docs.columns))
    narrow = cut(narrow_rows(docs, doc_id, text, source), "sizes")
    every = with_copies(narrow, seed).groupBy("doc_id", "source", "tie", "size", "source_size", "target").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    made = cut(every.where("copies > 0").withColumnsRenamed({"doc_id": "__cf_id", "source": "__cf_source", "tie": "__cf_tie", "n": "__cf_n"}), "copies")
    drop(narrow)
    own = (F.xxhash64(text) == F.col("__cf_tie")) & F.col(doc_id).eqNullSafe(F.col("__cf_id")) & F.col(source).eqNullSafe(F.col("__cf_source"))
    met = docs.join(made, own)
    if not made.where("__cf_n > 1").isEmpty():
        met = met.where("__cf_n = 1").unionByName(met.where("__cf_n > 1").dropDuplicates(["__cf_id", "__cf_source", "__cf_tie"]))
    return met.drop("__cf_id", "__cf_source", "__cf_tie", "__cf_n").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))


def taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every document, without texts."""
    d = with_copies(cut(narrow_rows(docs, doc_id, text, source), "sizes"), seed)
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
