"""Transcripts to canonical chat turns with a hidden Markov model.

The hidden state of a line is its role and whether it begins a turn; what is
seen of it is the speaker marker (from the row's own label or at the start of
the line), whether the line starts a row, whether it ends in a question mark, and
its length class.  Roles' first states, transitions and line features are counted
over all labelled rows; only how far markers can be trusted is a parameter.
Viterbi's path gives each line its role; runs of one turn are rendered as one
ChatML turn with the markers cut off.

A conversation of any length is decoded exactly without being gathered: rows are
dealt into blocks of ``BLOCK`` turn numbers; where a conversation has more than one,
each is summed up in one (max, +) matrix of best scores from state to state; the small
matrices of a conversation are multiplied along it to find the states at the block
borders; and each block is then decoded between its borders.

``transcripts`` writes conversations as transcripts without labels, in one of several
marker styles each and with some markers missing; parsed by a model that was counted
on the other half of the conversations, they tell how well roles are recovered.

Cases: null and empty texts are one empty line; lines of any length are read whole; a null role is recovered from the
text and its neighbours; unknown labels count as no marker; null ``conv_id`` is one
conversation; a null turn comes first; rows that agree in turn stand in order of
role and text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

ROLES = ("system", "user", "assistant")
#: Labels and markers of the roles, as found in public chat formats.
ALIASES = {
    "system": "system", "sys": "system", "developer": "system",
    "user": "user", "human": "user", "prompter": "user", "customer": "user", "question": "user", "q": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "chatbot": "assistant", "answer": "assistant", "a": "assistant",
}
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*([A-Za-z]+)\s*(?:\|>)?|\[\s*([A-Za-z]+)\s*\]\s*:?|(?:\#{1,6}\s*|\*\*)?([A-Za-z]+)(?:\*\*)?\s*:(?:\*\*)?)\s*")
#: Probability that a turn begins with its own role's marker, with another's, or with none.
MARKED, CROSSED = 0.9, 0.01
#: Probability that a line within a turn looks like one with a marker.
STRAY = 0.002
BLOCK = 256
LENGTHS = (0, 40, 160, 640)
S = 2 * len(ROLES)  # role, begins; role, goes on; one more state stands before the first line
NONE = -1e30
TURNS = {"key": "string", "at": "string", "part": "long", "role": "string", "text": "string", "rendered": "string"}
NEVER = (NONE,) * len(ROLES)
#: How transcripts mark speakers, by style.
STYLES = (("System: ", "User: ", "Assistant: "), ("### System: ", "### Human: ", "### Assistant: "), ("<|system|> ", "<|user|> ", "<|assistant|> "), ("[SYSTEM] ", "[CUSTOMER] ", "[BOT] "))
#: One of so many turns of a transcript has no marker.
UNMARKED = 4


def length_class(n: int) -> int:
    return sum(n > x for x in LENGTHS)


def alias(label: str | None) -> int:
    role = ALIASES.get((label or "").strip().lower())
    return ROLES.index(role) if role else -1


def marked(line: str) -> tuple[int, str]:
    """Role number of the marker at a line's start, or -1, and the line without it."""
    m = MARKER.match(line)
    if m and (k := alias(m[1] or m[2] or m[3])) >= 0:
        return k, line[m.end() :]
    return -1, line


def fold_of(folds: int) -> Column:
    return F.pmod(F.xxhash64("conv_id"), F.lit(folds)).cast("int")


def train(rows: DataFrame, folds: int = 1) -> list[dict[str, list]]:
    """Log probabilities from counts over labelled rows: first roles, transitions, line features by role.

    With ``folds`` over 1 the model of a fold is counted on the conversations of the others.
    """
    known = F.create_map(*(F.lit(x) for k, r in ALIASES.items() for x in (k, ROLES.index(r))))
    r = rows.select("conv_id", fold_of(folds).alias("f"), "turn", known[F.lower(F.trim("role"))].alias("k"), "text").where("k is not null")
    pairs = r.select("conv_id", "f", F.col("turn").alias("t"), F.col("k").alias("k0"))
    nxt = pairs.alias("p").join(r.alias("n"), F.col("p.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("p.t") + 1 == F.col("n.turn")))
    moves = nxt.groupBy("p.f", F.col("p.k0").alias("i"), F.col("n.k").alias("j")).count().collect()
    starts = r.where("turn = 0").groupBy("f", "k").count().collect()
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))
    n = F.length(F.trim("line"))
    size = sum((F.when(n > x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    seen = r.select("f", "k", line.alias("line")).groupBy("f", "k", F.trim("line").endswith("?").alias("q"), size.alias("s")).count().collect()
    out = []
    for f in range(folds):
        counts = lambda kept: (x for x in kept if folds == 1 or x.f != f)  # noqa: E731, B023
        first, move, look = np.ones(3), np.ones((3, 3)), np.ones((3, 2, len(LENGTHS) + 1))
        for x in counts(starts):
            first[x.k] += x["count"]
        for x in counts(moves):
            move[x.i, x.j] += x["count"]
        for x in counts(seen):
            look[x.k, int(x.q), x.s] += x["count"]
        turns = max(1.0, first.sum() + move.sum())
        more = min(0.95, max(0.05, 1 - turns / (2 * max(turns, look.sum()))))
        move = np.log((1 - more) * move / move.sum(axis=1, keepdims=True))
        out.append({"first": np.log(first / first.sum()).tolist(), "move": move.tolist(), "more": math.log(more), "look": np.log(look / look.sum(axis=(1, 2), keepdims=True)).tolist()})
    return out


class Model:
    """The model's tables as plain numbers: steps of seven states cost less so than as arrays."""

    def __init__(self, held: dict[str, list]):
        self.first, self.move, self.more = held["first"], held["move"], held["more"]
        marks = lambda m, r: math.log(MARKED if m == r else CROSSED if m >= 0 else 1 - MARKED - 2 * CROSSED)
        stray = lambda m: math.log(STRAY if m >= 0 else 1 - 3 * STRAY)
        self.begins, self.goes = {}, {}
        for m in range(-1, 3):
            for q in range(2):
                for s in range(len(LENGTHS) + 1):
                    self.begins[m, q, s] = tuple(held["look"][r][q][s] + marks(m, r) for r in range(3))
                    self.goes[m, q, s] = tuple(held["look"][r][q][s] + stray(m) for r in range(3))

    def emit(self, line: str, marker: int, opens: bool) -> tuple[tuple, tuple]:
        """Log probabilities of a line by role, if it begins a turn and if it goes on with one."""
        at = marker, int(line.rstrip().endswith("?")), length_class(len(line.strip()))
        return self.begins[at], NEVER if opens else self.goes[at]

    def seen(self, role: str | None, text: str | None) -> Iterator[tuple[str, tuple[tuple, tuple]]]:
        """The lines of a row without markers, and their emissions."""
        for k, line in enumerate((text or "").split("\n")):
            marker, rest = marked(line)
            if k == 0 and (label := alias(role)) >= 0:
                marker, rest = label, rest if marker == label else line
            yield (rest if marker >= 0 else line), self.emit(line, marker, k == 0)

    def step(self, score: list[float], e: tuple[tuple, tuple]) -> tuple[list[float], list[int]]:
        """Scores after a line, and the state that each came from."""
        at = [i + (score[i + 1] > score[i]) for i in (0, 2, 4)]
        best = [score[i] for i in at]
        out, back = [], []
        for j in range(3):
            top, came = score[S] + self.first[j], S
            for i in range(3):
                if (x := best[i] + self.move[i][j]) > top:
                    top, came = x, at[i]
            out += [top + e[0][j], best[j] + self.more + e[1][j]]
            back += [came, at[j]]
        return [*out, NONE], [*back, S]


def blocks(it: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows that follow each other; a group never spans more than what one block holds."""
    held, last = [], None
    for pdf in it:
        k = pdf[keys].astype(object).where(pdf[keys].notna(), None)
        change = (k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).any(axis=1).to_numpy()
        change[0] = True
        edges = [*np.flatnonzero(change), len(pdf)]
        for a, b in zip(edges, edges[1:]):
            key = tuple(k.iloc[a])
            if held and key != last:
                yield last, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held, last = [*held, pdf.iloc[a:b]], key
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]


def lines_of(model: Model, pdf: pd.DataFrame) -> Iterator[tuple[int, str, tuple]]:
    for k, (role, text) in enumerate(zip(pdf["role"], pdf["text"])):
        for line, e in model.seen(role if isinstance(role, str) else None, text if isinstance(text, str) else None):
            yield k, line, e


def from_state(k: int) -> list[float]:
    return [0.0 if i == k else NONE for i in range(S + 1)]


def matrix_of(model: Model, pdf: pd.DataFrame) -> np.ndarray:
    """Best scores from the state before a block to its last state."""
    scores = [from_state(k) for k in range(S + 1)]
    for _, _, e in lines_of(model, pdf):
        scores = [model.step(s, e)[0] for s in scores]
    return np.array(scores)


def decode(model: Model, pdf: pd.DataFrame, before: int = S, after: int = -1) -> list[tuple[int, str, int]]:
    """``(row, line, state)`` of the best path from the state before a block to its last state, -1 for the best one."""
    seen, score, back = list(lines_of(model, pdf)), from_state(before), []
    for _, _, e in seen:
        score, came = model.step(score, e)
        back.append(came)
    state, path = after if after >= 0 else max(range(S + 1), key=score.__getitem__), []
    for came in reversed(back):
        path.append(state)
        state = came[state]
    return [(k, line, s) for (k, line, _), s in zip(seen, reversed(path))]


def borders(mats: list[np.ndarray]) -> list[tuple[int, int]]:
    """States before and at the end of each block of one conversation."""
    score, back = np.full(S + 1, NONE), []
    score[S] = 0.0
    for m in mats:
        ways = score[:, None] + m
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    out, state = [], int(score.argmax())
    for prev in reversed(back):
        out.append((int(prev[state]), state))
        state = int(prev[state])
    return out[::-1]


def render(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def turns_of(path: list[tuple[int, str, int]]) -> Iterator[tuple[int, int, str, str]]:
    """``(row, part, role, text)``: a turn ends with its row or where another begins."""
    last, lines, part = None, [], 0
    for k, line, s in path:
        if last is None or k != last[0] or s % 2 == 0:
            if last is not None:
                yield last[0], part, ROLES[last[1] // 2], "\n".join(lines)
            part = part + 1 if last is not None and k == last[0] else 0
            last, lines = (k, s), []
        lines.append(line)
    if last is not None:
        yield last[0], part, ROLES[last[1] // 2], "\n".join(lines)


def transcripts(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with ``role`` hidden: the speaker is written before the text, in the conversation's style, or not at all."""
    style, bare = F.pmod(F.xxhash64(F.lit("style"), conv_id), F.lit(len(STYLES))), F.pmod(F.xxhash64(F.lit("bare"), conv_id, turn), F.lit(UNMARKED)) == 0
    known = F.create_map(*(F.lit(x) for k, r in ALIASES.items() for x in (k, ROLES.index(r))))[F.lower(F.trim(role))]
    mark = F.get(F.get(F.lit([list(s) for s in STYLES]), style.cast("int")), known)
    said = F.concat(F.when(bare, F.lit("")).otherwise(F.coalesce(mark, F.lit(""))), F.coalesce(text, F.lit("")))
    return rows.withColumns({role: F.lit(None).cast("string"), text: said})


def parse(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", labelled: DataFrame | None = None, folds: int = 1) -> DataFrame:
    """``(conv_id, turn, part, role, text, rendered)``: one row per recovered turn, in canonical form.

    The model is counted on ``labelled`` rows, those of ``rows`` by default; with
    ``folds`` over 1, never on the conversation that it decodes.
    """
    named = lambda d: d.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    r = named(rows)
    held = train(r if labelled is None else named(labelled), folds)
    # keys go to Python as text, as a nullable number would become a float there
    r = r.withColumns({"key": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), "fold": fold_of(folds), "block": F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK), "at": F.col("turn").cast("string")})
    order = ["key", "block", "turn", "role", "text"]

    def matrices(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [Model(h) for h in held]
        for (key, block), pdf in blocks(it, ["key", "block"]):
            yield pd.DataFrame({"key": [key], "block": [block], "m": [matrix_of(models[int(pdf["fold"].iloc[0])], pdf).ravel()]})

    def edges(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, pdf in blocks(it, ["key"]):
            found = borders([np.asarray(m).reshape(S + 1, S + 1) for m in pdf["m"]])
            yield pdf[["key", "block"]].assign(before=[b for b, _ in found], after=[a for _, a in found])

    def decoded(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, out = [Model(h) for h in held], []
        for (key, _), pdf in blocks(it, ["key", "block"]):
            first, at = pdf.iloc[0], pdf["at"].tolist()
            path = decode(models[int(first["fold"])], pdf, int(first["before"]), int(first["after"]))
            out += [(key, at[k], part, a, b, render(a, b)) for k, part, a, b in turns_of(path)]
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=list(TURNS))
                out = []
        yield pd.DataFrame(out, columns=list(TURNS))

    laid = r.drop("conv_id")
    # only conversations of several blocks have borders to be found
    several = cut(laid.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low <> high").select("key"), "several")
    mats = laid.join(several, "key", "left_semi").repartition("key", "block").sortWithinPartitions(*order).select("key", "fold", "block", "role", "text").mapInPandas(matrices, "key string, block long, m array<double>")
    edge = cut(mats.repartition("key").sortWithinPartitions("key", "block").mapInPandas(edges, "key string, block long, before int, after int"), "borders")
    drop(several)
    met = laid.join(edge, ["key", "block"], "left").withColumns({"before": F.coalesce("before", F.lit(S)), "after": F.coalesce("after", F.lit(-1))})
    met = met.repartition("key", "block").sortWithinPartitions(*order)
    out = met.select("key", "fold", "block", "at", "role", "text", "before", "after").mapInPandas(decoded, ", ".join(f"{c} {t}" for c, t in TURNS.items()))
    kind = rows.schema[conv_id].dataType
    return out.select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias("conv_id"), F.col("at").cast("long").alias("turn"), "part", "role", "text", "rendered")
