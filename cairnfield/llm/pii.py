"""Personal data, and the terms that give it away.

Four patterns find emails, IP addresses, card and phone numbers; keys and other
secrets are told by length and entropy, and are a fifth protected class.  Beyond them,
the corpus itself tells which terms disclose that such an entity is near.  With
``p(c)`` the share of texts that hold an entity of class c and ``p(c|t)`` the
share, of the texts that hold term t, of those with one of c within ``NEAR``
words of t, the information that t gives about c is PMI(c;t) =
log2 p(c|t) / p(c), at most IC(c) = -log2 p(c).  All three counts are of different
texts, so copies of a document neither add to a share nor dilute it.  The
disclosure of a term is PMI / IC, with the lower
bound of Wilson's interval for p(c|t), so that a rare term discloses nothing by
chance.  Terms of at least ``GENERALISE`` are replaced by a general word, those of
at least ``REMOVE`` are removed.

Counts are over all texts.  Terms near entities are counted first; document
frequencies are then needed for those alone, and a filter of fixed size (512 KB)
keeps other words from being shuffled; exact joins follow it.

Cases: a null or empty text holds nothing; texts of any length are read whole; repeated rows are judged alike (equal
rows and copies count once in the statistics); null ids are kept; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: All protected classes; spans are in this order.
CLASSES = (*KINDS, "secret")
NEAR = 6
#: Characters on either side in which the nearest words are looked for.
REACH = 400
#: Different texts that hold a term near an entity, for it to be judged.
MIN_TEXTS = 5
GENERALISE, REMOVE = 0.75, 0.9
Z = 2.576
FILTER_WORDS = 1 << 16
#: Words whose membership a task remembers at once.
MOST_KNOWN = 1 << 18
TERM = re.compile(r"[^\W\d_]{2,}")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A digit after a digit can start no address that the first digit could not.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Where a secret may be: runs of at least 24 characters, looked for at their start only.
RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{24,}+")
#: Characters per change between letter and digit that a secret has at most, which paths and
#: dated names exceed, and bits of entropy per character that it has at least.
MIXED, ENTROPY = 8, 3.0

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each ``@`` with what may stand before it, back to the match before; linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str | None) -> list[Span]:
    """The spans of the four patterns by kind, then start; code points, end exclusive."""
    if not text:
        return []
    out = emails(text)
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out

#: Without the characters that join words.
PLAIN = str.maketrans("", "", "_+/=-")


def entropy(run: str) -> float:
    """Bits per character, by the run's own character counts."""
    return sum(-n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def secrets(text: str | None, base: list[Span]) -> list[Span]:
    """Long runs of mixed letters and digits with high entropy that overlap no base span; linear in the text."""
    if not text or not DIGIT.search(text):
        return []
    out = []
    for m in RUN.finditer(text):
        run = m[0].translate(PLAIN)
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:]))
        if turns * MIXED >= len(m[0]) and entropy(m[0]) >= ENTROPY and not any(a < m.end() and m.start() < b for _, a, b in base):
            out.append(("secret", m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def terms_near(text: str, spans: list[Span]) -> set[tuple[str, str]]:
    """``(kind, term)`` of the words around each span that are not in a span themselves."""
    out: set[tuple[str, str]] = set()
    for kind, a, b in spans:
        left, right = text[max(0, a - REACH) : a].lower(), text[b : b + REACH].lower()
        before = [m[0] for m in TERM.finditer(left) if (m.start() > 0 or a <= REACH) and not covered(a - len(left) + m.start(), spans)]
        after = [m[0] for m in TERM.finditer(right) if (m.end() < len(right) or b + REACH >= len(text)) and not covered(b + m.start(), spans)]
        out.update((kind, t) for t in before[-NEAR:] + after[:NEAR])
    return out


def covered(at: int, spans: list[Span]) -> bool:
    return any(a <= at < b for _, a, b in spans)


class Filter:
    """Members of a set of terms, by one bit of FILTER_WORDS words each; errs only towards yes."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __contains__(self, term: str) -> bool:
        h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)
        return bool(int(self.words[h % FILTER_WORDS]) >> (h >> 32 & 63) & 1)

    def among(self, terms: set[str], known: dict[str, bool]) -> list[str]:
        """The members among ``terms``; ``known`` holds what was asked before, as words come again and again."""
        if len(known) > MOST_KNOWN:
            known.clear()
        new = terms.difference(known)
        known.update((w, w in self) for w in new)
        return [w for w in terms if known[w]]

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        """Which of signed hashes are members."""
        bits = self.words[np.mod(hashes, FILTER_WORDS)] >> (hashes.view(np.uint64) >> np.uint64(32) & np.uint64(63))
        return (bits & np.uint64(1)).astype(bool)


def filter_of(members: DataFrame, h: Column | None = None) -> Filter:
    """At most FILTER_WORDS rows reach the driver, whatever the number of members; ``h`` is a hash, of ``term`` by default."""
    h = F.xxhash64("term") if h is None else h
    bit = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(63)).cast("int")
    rows = members.groupBy(F.pmod(h, F.lit(FILTER_WORDS)).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).collect()
    words = np.zeros(FILTER_WORDS, np.uint64)
    for r in rows:
        words[r.slot] = r.bits & 0xFFFFFFFFFFFFFFFF
    return Filter(words)


BASE = "n_email long, n_ip long, n_card long, n_phone long, n_secret long, base_sha256 string, base string, held string, near array<struct<kind:string,term:string>>"


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base spans and the terms near them."""

    @F.pandas_udf(BASE)
    def base(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            own = base_spans(t)
            spans, s = own + secrets(t, own), joined(own)
            kinds = [k for k, _, _ in spans]
            near = [{"kind": k, "term": w} for k, w in sorted(terms_near(t, spans))] if spans else []
            out.append((*(kinds.count(k) for k in CLASSES), hashlib.sha256(s.encode()).hexdigest(), s, joined(spans), near))
        return pd.DataFrame(out, columns=[*(f"n_{k}" for k in CLASSES), "base_sha256", "base", "held", "near"])

    return docs.withColumn("__cf_b", base(F.col(text))).select("*", "__cf_b.*").drop("__cf_b")


def disclosing(docs: DataFrame, based: DataFrame, text: str = "text") -> DataFrame:
    """``(term, kind)``: the terms to generalise (``term``) or to remove (``reveal``), with their ``disclosure``.

    ``same`` of both tables is a hash of the text.
    """
    holds = based.select("same", *((F.col(f"n_{k}") > 0).alias(k) for k in CLASSES)).distinct()
    n = holds.agg(F.count("*").alias("n"), *(F.count_if(k).alias(k) for k in CLASSES)).first()
    near = based.select("same", F.inline("near")).distinct().groupBy("kind", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= MIN_TEXTS)
    near = cut(near, "near")
    copied = docs.sparkSession.sparkContext.broadcast(filter_of(based.groupBy("same").count().where("count > 1"), F.col("same")))
    prior = F.create_map(*(F.lit(x) for k in CLASSES for x in (k, max(n[k], 1) / max(n.n, 1))))[F.col("kind")]

    def terms_of(wanted: DataFrame, single: bool) -> DataFrame:
        """``(same, term)`` for each row, and of those of texts with copies none if ``single``."""
        held = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))

        @F.pandas_udf("array<string>")
        def terms(texts: pd.Series, same: pd.Series) -> pd.Series:
            passed, known = held.value, {}
            skip = copied.value.hold(same.to_numpy(np.int64)) if single else np.zeros(len(texts), bool)
            return pd.Series([passed.among(set(TERM.findall(t.lower())), known) if t and not s else [] for t, s in zip(texts, skip)])

        return docs.select("same", F.explode(terms(F.col(text), F.col("same"))).alias("term"))

    def judged(both: DataFrame) -> DataFrame:
        p, z = F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0)), F.lit(Z)
        low = (p + z * z / (2 * F.col("n_term")) - z * F.sqrt(p * (1 - p) / F.col("n_term") + z * z / (4 * F.col("n_term") ** 2))) / (1 + z * z / F.col("n_term"))
        worth = F.when(prior < 1, F.log2(low / prior) / -F.log2(prior)).otherwise(F.lit(0.0))
        return both.withColumn("disclosure", worth).where(F.col("disclosure") >= GENERALISE)

    # texts without copies are counted by rows first, with nothing to shuffle but sums: more texts only lower
    # a disclosure, so terms that fail by these alone are out, and different texts are told apart for few terms
    alone = terms_of(near.select("term"), True).groupBy("term").agg(F.count("*").alias("n_alone"))
    least = near.join(alone, "term", "left").withColumn("n_term", F.greatest(F.coalesce("n_alone", F.lit(0)), "n_both"))
    likely = cut(judged(least).select("kind", "term", "n_both"), "likely")
    counts = terms_of(likely.select("term"), False).distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    out = judged(likely.join(counts, "term")).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    return cut(out.withColumn("kind", F.when(F.col("disclosure") >= REMOVE, F.lit("reveal")).otherwise(F.lit("term"))), "disclosing")


def hits_of(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, doc, extra)``: the spans of disclosing terms outside those of entities, of the documents that have some."""
    held = docs.sparkSession.sparkContext.broadcast(filter_of(found.select("term")))

    @F.pandas_udf("array<struct<term:string,start:long,end:long>>")
    def places(texts: pd.Series) -> pd.Series:
        passed, known, out = held.value, {}, []
        if not passed.words.any():
            return pd.Series([[] for _ in texts])
        for t in texts:
            low = t.lower() if t else ""
            if not passed.among(set(TERM.findall(low)), known):
                out.append([])
                continue
            # lower-casing can change a text's length; positions then come from the text itself
            words = ((m[0], m) for m in TERM.finditer(low)) if len(low) == len(t or "") else ((m[0].lower(), m) for m in TERM.finditer(t))
            got = [{"term": w, "start": m.start(), "end": m.end()} for w, m in words if w in passed]
            if got:
                spans = base_spans(t)
                spans += secrets(t, spans)
                got = [g for g in got if not any(a < g["end"] and g["start"] < b for _, a, b in spans)]
            out.append(got)
        return pd.Series(out)

    at = docs.select("doc_id", "doc", F.inline(places(F.col(text)))).join(found.select("term", "kind"), "term").select("doc_id", "doc", "kind", "start", "end").distinct()
    spans = F.sort_array(F.collect_list(F.struct(F.when(F.col("kind") == "term", 0).otherwise(1).alias("o"), "start", "end", "kind")))
    spell = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return at.groupBy("doc_id", "doc").agg(F.count("*").alias("n_added"), F.array_join(spell, ",").alias("extra"))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, ``base_sha256``, ``spans`` and ``doc``, a hash of id and text to join by.

    ``n_terms`` counts the spans of disclosing terms.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("doc"), F.xxhash64(text).alias("same"))
    based = cut(with_base(d).drop("text"), "base")
    found = disclosing(d, based)
    extra = hits_of(d, found).withColumnRenamed("doc_id", "other_id").withColumnRenamed("doc", "other")
    out = based.join(extra, (F.col("doc") == F.col("other")) & F.col("doc_id").eqNullSafe(F.col("other_id")), "left")
    spans = F.concat_ws(",", F.when(F.col("held") != "", F.col("held")), "extra")
    return out.select("doc_id", "doc", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), "n_secret", F.coalesce("n_added", F.lit(0)).cast("long").alias("n_terms"))


def redact(text: str | None, spans: str | None) -> str | None:
    """The text with its spans generalised or removed; of spans that overlap, the one that starts first counts."""
    if not text or not spans:
        return text
    parsed = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    out, at = [], 0
    for a, b, k in parsed:
        if a >= at:
            out += [text[at:a], "" if k == "reveal" else f"[{k.upper()}]"]
            at = -b
        else:
            at = max(at, -b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span generalised or removed from ``text``."""
    found = cut(detect(docs, doc_id, text).select(F.col("doc_id").alias("__cf_id"), F.col("doc").alias("__cf_doc"), F.col("spans").alias("__cf_spans")).where("__cf_spans <> ''").distinct(), "spans")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([redact(t, s) for t, s in zip(texts, spans)])

    met = docs.withColumn("__cf_key", F.xxhash64(doc_id, text)).join(found, (F.col("__cf_key") == F.col("__cf_doc")) & F.col(doc_id).eqNullSafe(F.col("__cf_id")), "left")
    return met.withColumn(text, cleaned(F.col(text), F.col("__cf_spans"))).drop("__cf_id", "__cf_doc", "__cf_spans", "__cf_key")
