"""Quality rules with thresholds that adapt to each language and source.

Every document is measured (shares in thousandths).  For each (lang, source)
and each measure the documents that pass the base rules are summed up in a
quantile sketch: a histogram over log-linear buckets whose width is at most 1/32
of the value.  Such sketches merge by adding counts, so the sketch of a language
or of the corpus is the sum of those of its sources, the result does not depend
on how rows are dealt out, and a hot source is one row per bucket after the
partial sums.  Fences are read from a group's sketches alone,

    upper = Q3 + 3 spread        lower = Q1 - 3 spread
    spread = the larger of Q3 - Q1 and the step

where the step is what one event (a symbol, a repeated line, a letter) adds to the
group's median document, by the sketches of word and line counts; it counts where
most documents have none and the quartiles are equal.  A group's fence is drawn
towards that of its language, and the language's towards the corpus's, by ``PRIOR``
pseudo-documents, so that small groups need no special case; and it may not pass the
outer fence (6 spreads) of the wider group, so that a source that is mostly junk does
not set its own standard.  The fences are joined back and documents outside are
rejected.

Cases: a null or empty text has no words and fails the base rules; texts of any
length are measured whole; null ``lang`` or ``source`` is a group of its own;
repeated rows are measured and judged row by row; other columns stay; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, shielded, words_of

SYMBOL = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 50
#: Pseudo-documents by which a group's fences are drawn towards the wider group's.
PRIOR = 50
SPREADS = 3
#: What one event adds to a document, in thousandths of its words or lines: a repeated line makes two lines' words repeat.
STEPS = {"symbol": (1000, "words"), "dup": (1000, "lines"), "repeat": (2000, "lines"), "length": (1000, "words")}

MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    words = words_of(text)
    n = len(words)
    if not n:
        return (0, 0, len(SYMBOL.findall(text or "")), 0, 0, 0)
    chars = sum(map(len, (w.decode("utf-8", "surrogatepass") for w in words))) if not text.isascii() else sum(map(len, words))
    seen, repeated, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip("\x20\t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                repeated += 1
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = 0
    if len(windows) < n - 2:
        end = 0  # words before this index are counted already
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return (n, chars, len(SYMBOL.findall(text)), repeated, covered, lines)


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures and ``base_failed``."""

    @F.pandas_udf(MEASURES)
    def measures(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=MEASURES.names, dtype="int64")

    # else the optimiser would measure a text once for each filter and column that uses it
    m = df.withColumn("__cf_m", measures.asNondeterministic()(F.col(text))).select("*", "__cf_m.*").drop("__cf_m")
    return m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def shares() -> dict[str, Column]:
    """The judged measures in thousandths; null where there is nothing to divide by."""
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b)))
    return {"symbol": per("n_symbols", "n_words"), "dup": per("n_dup_lines", "n_lines"), "repeat": per("n_repeat_words", "n_words"), "length": per("word_chars", "n_words")}


def bucket(v: Column) -> Column:
    """Log-linear bucket of a whole number: exact below 64, then 32 buckets for each doubling."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftright", v, shift) + 32 * shift


def lowest(b: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest((F.floor(b / 32) - 1).cast("int"), F.lit(0))
    return F.call_function("shiftleft", (b - 32 * shift).cast("long"), shift)


def key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang_key, source_key, measure, bucket, n)`` of the documents that pass the base rules."""
    held = {**shares(), "words": F.col("n_words"), "lines": F.col("n_lines")}
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in held.items()))
    rows = measured.where("not base_failed").select(key(lang).alias("lang_key"), key(source).alias("source_key"), F.inline(pairs))
    return rows.where("v is not null").groupBy("lang_key", "source_key", "measure", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches of wider groups."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *by: str) -> DataFrame:
    """One row per group: ``total`` and for each judged measure ``lower``, ``upper`` and the outer fences."""
    w = [*by, "measure"]
    run = sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*w).orderBy("bucket"))).withColumn("total", F.sum("n").over(Window.partitionBy(*w)))
    q = lambda k, part: F.min(F.when((F.col("measure") == k) & (4 * F.col("upto") >= part * F.col("total")), lowest(F.col("bucket")))).cast("double").alias(f"q{part}_{k}")
    quartiles = [q(k, part) for k in STEPS for part in (1, 3)] + [q("words", 2), q("lines", 2)]
    got = run.groupBy(*by).agg(F.max("total").cast("double").alias("total"), *quartiles)
    out = []
    for k, (unit, per) in STEPS.items():
        wide = SPREADS * F.greatest(F.col(f"q3_{k}") - F.col(f"q1_{k}"), F.lit(float(unit)) / F.greatest(F.col(f"q2_{per}"), F.lit(1.0)))
        out += [(F.col(f"q3_{k}") + wide).alias(f"upper_{k}"), (F.col(f"q1_{k}") - wide).alias(f"lower_{k}")]
        out += [(F.col(f"q3_{k}") + 2 * wide).alias(f"outer_upper_{k}"), (F.col(f"q1_{k}") - 2 * wide).alias(f"outer_lower_{k}")]
    return got.where("total is not null").select(*by, "total", *out)


def drawn(near: DataFrame, far: DataFrame, *by: str) -> DataFrame:
    """Fences of groups, drawn towards those of the wider groups and kept within their outer ones."""
    far = far.select(*by, *(F.col(c).alias(f"far_{c}") for c in far.columns if c not in (*by, "total")))
    met = near.join(far, list(by)) if by else near.crossJoin(far)  # the corpus is one row
    out = []
    for k in STEPS:
        for side, most in (("upper", F.least), ("lower", F.greatest)):
            pulled = (F.col("total") * F.col(f"{side}_{k}") + PRIOR * F.col(f"far_{side}_{k}")) / (F.col("total") + PRIOR)
            out += [most(pulled, F.col(f"far_outer_{side}_{k}")).alias(f"{side}_{k}"), f"outer_{side}_{k}"]
    return met.select(*(c for c in near.columns if c.endswith("_key")), *out)


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) with ``lower_<measure>`` and ``upper_<measure>``."""
    s = cut(sketches(measured, lang, source), "sketch")
    by_lang = drawn(fences(merge(s, "lang_key"), "lang_key"), fences(merge(s)))
    own = drawn(fences(s, "lang_key", "source_key"), by_lang, "lang_key")
    out = cut(own.select("lang_key", "source_key", *(f"{side}_{k}" for k in STEPS for side in ("lower", "upper"))), "fences")
    drop(s)
    return out


def judge(measured: DataFrame, fence: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``rejected_by`` (the first measure outside its fence, or null) and ``kept``.

    The fences are a written table, so Spark knows their size: it broadcasts
    them below its threshold and otherwise joins by key, splitting a hot source.
    """
    f = fence.select(F.col("lang_key").alias("__cf_lk"), F.col("source_key").alias("__cf_sk"), F.struct(*[c for c in fence.columns if c not in ("lang_key", "source_key")]).alias("__cf_f"))
    joined = measured.join(f, (key(lang) == F.col("__cf_lk")) & (key(source) == F.col("__cf_sk")), "left").drop("__cf_lk", "__cf_sk")
    why = F.when(F.col("base_failed"), F.lit("base"))
    for k, v in shares().items():
        why = why.when(v > F.col(f"__cf_f.upper_{k}"), F.lit(k))
        if k == "length":
            why = why.when(v < F.col(f"__cf_f.lower_{k}"), F.lit(k))
    return joined.withColumn("rejected_by", why).withColumn("kept", F.col("rejected_by").isNull()).drop("__cf_f")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with measures, ``rejected_by`` and ``kept``; measured columns replace any of the same name."""
    docs = docs.drop(*(c for c in ("rejected_by", "kept", "base_failed", *MEASURES.names) if c in docs.columns))
    return judge(with_measures(docs, text), thresholds(with_measures(docs.select(text, lang, source), text), lang, source), lang, source)


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns as they were."""
    return shielded(docs, (text, lang, source), lambda d: quality_rules(d, text, lang, source).where("kept").select(*d.columns))


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The verdict alone, without texts: each text is measured once and the narrow measures are written."""
    m = with_measures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))).drop("text")
    m = cut(m, "measures")
    return judge(m, thresholds(m)).drop("lang", "source")
