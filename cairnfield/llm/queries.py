"""The ``opN_<name>`` queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, htmltree, linededup, mixing, oracles, pii, quality, simhash, urlfilter, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_terms")


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op4_htmltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts without labels; each is decoded by the model of the conversations of the other half."""
    rows = table(spark, sf_dir, "conversations")
    return chat.parse(chat.transcripts(rows), labelled=rows, folds=2)


QUERIES = {f.__name__: f for f in (op1_quality, op2_pii, op3_urlfilter, op4_htmltree, op5_decontaminate, op6_mixing, op7_warc, op8_simhash, op9_linededup, op10_chat)}

ORACLES = oracles.ORACLES
