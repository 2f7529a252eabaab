"""URL filter: host rules first, then a weighted vocabulary.

Rules name a host and a path prefix; one fits its host and all subdomains, and
of several that fit the longest wins.  Where none fits, an Aho-Corasick
automaton runs once over host and path and reports every term of the vocabulary
that stands between boundaries (no letter or digit next to it).  Each distinct
term counts once with its weight; a strict term weighs as much as the limit, a
soft one weighs one, so one strict or several distinct soft terms block a url.
Query and fragment are not looked at, as they carry tracking words.

Cases: a null url or one without ``://`` has empty host and path and is allowed;
repeated rows are judged alike; other columns stay; a column of the input that
has the name of a result column is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

LIMIT = 2
#: Terms that block a url alone.
STRICT = ("casino", "escort", "gambling", "malware", "phishing", "porn", "porno", "sexcam", "viagra", "warez", "xxx")
#: Terms of which LIMIT distinct ones block a url.
SOFT = ("ads", "adult", "bet", "bets", "bonus", "cheap", "click", "credit", "deals", "farm", "free", "hot", "loan", "loans", "pill", "pills", "poker", "prize", "sex", "spam", "teen", "track", "tracker", "win", "x")
WEIGHTS = {t: LIMIT for t in STRICT} | {t: 1 for t in SOFT}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), "://[^/?#]*([^?#]*)", 1), F.lit(""))


class Vocabulary:
    """Distinct terms of a text, found in one pass."""

    def __init__(self, weights: dict[str, int]):
        self.weights = weights
        self.machine = ahocorasick.Automaton()
        for t in weights:
            self.machine.add_word(t, t)
        self.machine.make_automaton()

    def hits(self, text: str) -> set[str]:
        found, edge = set(), lambda i: not (0 <= i < len(text) and text[i].isascii() and text[i].isalnum())
        for end, term in self.machine.iter(text):
            if term not in found and edge(end + 1) and edge(end - len(term)):
                found.add(term)
        return found


class Rules:
    """Host rules by host, looked up from each suffix of a host."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def fit(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while at >= 0:
            suffix = host[at:]
            for p, verdict in self.by_host.get(suffix, ()):
                if path.startswith(p) and (best[0] is None or len(suffix + p) > len(best[0])):
                    best = (suffix + p, verdict)
            at = host.find(".", at) + 1 or -1
        return best


def judge(pages: DataFrame, url: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, weights: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict``, ``n_strict`` and ``n_soft`` to every row."""
    rules, weights = list(rules), dict(WEIGHTS if weights is None else weights)

    @F.pandas_udf("rule string, verdict string, n_strict long, n_soft long")
    def verdicts(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        by_host, words, out = Rules(rules), Vocabulary(weights), []
        for host, path in zip(hosts, paths):
            rule, verdict = by_host.fit(host, path)
            hits = words.hits(host + path.lower())
            strict = sum(weights[t] >= limit for t in hits)
            out.append((rule, verdict or ("block" if sum(weights[t] for t in hits) >= limit else "allow"), strict, len(hits) - strict))
        return pd.DataFrame(out, columns=["rule", "verdict", "n_strict", "n_soft"])

    pages = pages.drop(*(c for c in ("host", "path", "rule", "verdict", "n_strict", "n_soft", "__cf_v") if c in pages.columns and c != url))
    return pages.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("__cf_v", verdicts("host", "path")).select("*", "__cf_v.*").drop("__cf_v")
