"""Main text of web pages by a tree-structured graphical model.

A page is parsed into the tree of its block elements.  Each node has a hidden
label, content or not.  Its own evidence (tag, words of class, id and role, length
of its own text, share of it in links, sentence ends) gives a node potential, and
each edge a potential of the labels of parent and child, which differs for
sectioning and plain children.  Sum-product messages pass from the leaves up and
from the root down; as the graph is a tree, the marginals they give are exact.
Text of nodes whose marginal favours content is kept, in page order.

The potentials are counts over labelled pages.  Those are made by ``labelled_pages``,
a seeded generator of page layouts in which every element is labelled;
``TRAINING_PAGES`` is how many.

Cases: a null or empty page has empty text; unclosed, misnested and cut-off tags
are handled as browsers do in outline; repeated rows give equal results; other
columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 600
SEED = 11
#: Elements inside a block; all others with a name end a run of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is not part of the page.
UNSEEN = frozenset("head script style template noscript iframe object svg math canvas audio video select datalist textarea button".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONING = frozenset("body article main section nav aside header footer form div ul ol table dl".split())
#: What an opening tag closes if it is open in the same parent.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
OWNERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    up: int
    words: tuple[str, ...] = ()
    label: int = -1
    text: int = 0
    linked: int = 0
    ends: int = 0
    kids: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes, parents before children, and ``(node, text)`` of each run of text in page order."""
    nodes, runs = [Node("#root", -1)], []
    stack, held, links = [0], [], 0
    unseen = 0

    def flush() -> None:
        if not held:
            return
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        if text:
            at = nodes[stack[-1]]
            at.text += len(text)
            at.linked += sum(len(t) for t, inside in held if inside)
            at.ends += sum(text.count(c) for c in ".!?")
            if not unseen:
                runs.append((stack[-1], text))
        held.clear()

    def pop() -> None:
        nonlocal unseen
        flush()
        unseen -= nodes[stack.pop()].tag in UNSEEN

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            held.append((page[at:], links > 0))
            break
        if lt > at:
            held.append((page[at:lt], links > 0))
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(page, lt)
        if m is None:
            if lt + 1 < n and (page[lt + 1] in "!?/" or page[lt + 1].isalpha()):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                held.append(("<", links > 0))
                at = lt + 1
            continue
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag in INLINE:
            if tag == "br":
                held.append((" ", False))
            elif tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if closing:
            if any(nodes[i].tag == tag for i in stack):
                while nodes[stack[-1]].tag != tag:
                    pop()
                pop()
                links = 0
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            owners = OWNERS.get(tag, set())
            for i in reversed(range(1, len(stack))):
                if nodes[stack[i]].tag in owners:
                    break
                if nodes[stack[i]].tag in CLOSES[tag]:
                    while len(stack) > i:
                        pop()
        elif nodes[stack[-1]].tag == "p":
            pop()
        words, label = [], -1
        for k, v in ATTRIBUTE.findall(m[3]) if m[3] else ():
            v = v.strip("\"'").lower()
            if k.lower() == "data-y":
                label = int(v)
            else:
                words += WORD.findall(v)
        nodes.append(Node(tag, stack[-1], tuple(dict.fromkeys(words)), label))
        nodes[stack[-1]].kids.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
        unseen += tag in UNSEEN
        if m[3].endswith("/"):
            pop()
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            if tag == "title":
                held.append((page[at : end.start() if end else n], False))
            at = end.start() if end else n
    while len(stack) > 1:
        pop()
    flush()
    return nodes, runs


def features(node: Node, up: str) -> list[str]:
    size = sum(node.text > x for x in (0, 20, 80, 200))
    out = [f"tag:{node.tag}", f"in:{up}", f"size:{size}"]
    if node.text:
        out += [f"links:{min(3, 4 * node.linked // node.text)}", f"ends:{min(3, node.ends)}"]
    return out + [f"is:{w}" for w in node.words]


class Model:
    """Node and edge potentials as log probabilities."""

    def __init__(self, pages: list[str]):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        totals, edges, root = [1.0, 1.0], {k: [[1.0, 1.0], [1.0, 1.0]] for k in (False, True)}, [1.0, 1.0]
        for page in pages:
            nodes, _ = parse(page)
            labels = [0] * len(nodes)
            for i, x in enumerate(nodes):
                labels[i] = x.label if x.label >= 0 else labels[x.up] if x.up >= 0 else 1
                if x.up < 0:
                    root[labels[i]] += 1
                    continue
                edges[x.tag in SECTIONING][labels[x.up]][labels[i]] += 1
                totals[labels[i]] += 1
                seen[labels[i]].update(features(x, nodes[x.up].tag))
        known = set(seen[0]) | set(seen[1])
        self.node = {f: math.log((seen[1][f] + 0.5) / (totals[1] + 1)) - math.log((seen[0][f] + 0.5) / (totals[0] + 1)) for f in known}
        self.edge = {k: [[v / sum(row) for v in row] for row in e] for k, e in edges.items()}
        self.root = [v / sum(root) for v in root]

    def evidence(self, nodes: list[Node]) -> list[float]:
        """Log odds of content from each node's own features."""
        return [0.0] + [sum(self.node.get(f, 0.0) for f in features(x, nodes[x.up].tag)) for x in nodes[1:]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is content: one pass up, one pass down."""
        odds = self.evidence(nodes)
        own = [(1.0, math.exp(max(-60.0, min(60.0, o)))) for o in odds]
        belief = [list(x) for x in own]  # own evidence times messages from children
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            e, (b0, b1) = self.edge[nodes[i].tag in SECTIONING], belief[i]
            m = (e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1)
            z = m[0] + m[1]
            sent[i] = (m[0] / z, m[1] / z)
            up = belief[nodes[i].up]
            up[0] *= sent[i][0]
            up[1] *= sent[i][1]
            z = up[0] + up[1]
            up[0], up[1] = max(up[0] / z, 1e-150), max(up[1] / z, 1e-150)
        full = [list(x) for x in belief]
        full[0] = [belief[0][0] * self.root[0], belief[0][1] * self.root[1]]
        for i in range(1, len(nodes)):
            e, up = self.edge[nodes[i].tag in SECTIONING], full[nodes[i].up]
            rest = (up[0] / sent[i][0], up[1] / sent[i][1])  # the parent's belief without this child
            z = rest[0] + rest[1]
            rest = (rest[0] / z, rest[1] / z)
            f = [belief[i][0] * (rest[0] * e[0][0] + rest[1] * e[1][0]), belief[i][1] * (rest[0] * e[0][1] + rest[1] * e[1][1])]
            z = f[0] + f[1]
            full[i] = [max(f[0] / z, 1e-150), max(f[1] / z, 1e-150)]
        return [b / (a + b) for a, b in full]

    def main_text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, runs = parse(page)
        p = self.marginals(nodes)
        return "\n".join(text for i, text in runs if p[i] > 0.5)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Pages of many layouts; ``data-y`` is 1 on elements of the article and 0 on all others."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stock = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(400)]

    def say(a: int, b: int, end: str = ".") -> str:
        w = [r.choice(stock) for _ in range(r.randint(a, b))]
        for k in range(len(w)):
            if r.random() < 0.08:
                w[k] += "."
        return " ".join(w).capitalize() + end

    def el(tag: str, y: int, inner: str, *words: str) -> str:
        c = r.choice(words) if words and r.random() < 0.85 else ""
        how = r.choice(["class", "class", "id"]) if c else ""
        return f'<{tag}{f""" {how}="{c}\"""" if c else ""} data-y="{y}">{inner}</{tag}>'

    def links(y: int, k: int) -> str:
        return el(r.choice(["ul", "ul", "div"]), y, "".join(el("li", y, f'<a href="/{i}">{say(1, 3, "")}</a>') for i in range(k)))

    def ad() -> str:
        return el("div", 0, r.choice([say(3, 14), f'<a href="/x">{say(2, 8, "")}</a>', el("p", 0, say(4, 14))]), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")

    def notice() -> str:
        return el("div", 0, el("p", 0, say(6, 25)) + r.choice(["", el("p", 0, '<a href="/ok">ok</a>')]), "cookie", "consent", "notice", "popup", "newsletter", "subscribe", "modal")

    def comments() -> str:
        each = lambda: el(r.choice(["div", "li", "article"]), 0, el("p", 0, say(4, 40)), "comment", "reply")
        return el(r.choice(["section", "div"]), 0, r.choice(["", el("h3", 0, say(1, 2, ""))]) + "".join(each() for _ in range(r.randint(1, 5))), "comments", "responses", "discussion")

    def article() -> str:
        out = [el(r.choice(["h1", "h1", "h2"]), 1, say(3, 12, ""), "title", "headline")] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 14)):
            k = r.random()
            text = say(1, 120) if r.random() < 0.8 else say(1, 4)
            if r.random() < 0.2:
                text = f'{text} <a href="/y">{say(1, 3, "")}</a> {say(2, 12)}'
            if r.random() < 0.1:
                text = f"<b>{text}<br>"
            if k < 0.8:
                out.append(el("p", 1, text))
            elif k < 0.86:
                out.append(el("h2", 1, say(2, 7, "")))
            elif k < 0.91:
                out.append(el("ul", 1, "".join(el("li", 1, say(2, 20)) for _ in range(r.randint(2, 5)))))
            elif k < 0.95:
                out.append(el("blockquote", 1, el("p", 1, say(5, 40))))
            else:
                out.append(el("table", 1, "".join(el("tr", 1, "".join(el("td", 1, say(1, 3, "")) for _ in range(3))) for _ in range(3))))
        if r.random() < 0.15:
            out.insert(r.randint(0, len(out)), ad())
        body = "".join(out)
        return r.choice([el("article", 1, body), el("article", 1, body), el("main", 1, body), el("div", 1, body, "content", "article", "post", "entry", "story", "body", "text"), el("main", 1, el("article", 1, body))])

    pages = []
    for _ in range(n):
        before = [el(r.choice(["nav", "nav", "div"]), 0, links(0, r.randint(3, 9)), "nav", "menu", "navbar", "navigation", "breadcrumb")]
        if r.random() < 0.5:
            before.insert(0, el("header", 0, r.choice([el("h1", 0, say(1, 3, "")), el("p", 0, say(1, 6, "")), links(0, 3)]), "header", "masthead", "top"))
        before += [f() for f in (ad, notice) if r.random() < 0.5]
        after = [comments()] if r.random() < 0.4 else []
        if r.random() < 0.5:
            after.append(el(r.choice(["aside", "div"]), 0, r.choice([links(0, 4), el("p", 0, say(4, 25)), el("h3", 0, say(1, 3, "")) + links(0, 4)]), "sidebar", "related", "widget", "aside", "share", "social"))
        if r.random() < 0.25:
            after.append(el("form", 0, el("p", 0, say(2, 9, "")) + "<input>", "search", "login", "form"))
        after += [f() for f in (ad, notice) if r.random() < 0.2]
        foot = el(r.choice(["footer", "footer", "div"]), 0, r.choice([f"&copy; {say(3, 20)}", el("p", 0, f"&copy; {say(2, 8)}") + links(0, 3), links(0, 4)]), "footer", "copyright", "legal", "bottom")
        pages.append(f'<!DOCTYPE html><html data-y="1"><head data-y="0"><title>{say(3, 8, "")}</title></head><body data-y="1">{"".join(before)}{article()}{"".join(after)}{foot}</body></html>')
    return pages


def extract(pages: DataFrame, page: str = "html", pages_to_train: int = TRAINING_PAGES, seed: int = SEED) -> DataFrame:
    """Add ``text`` and ``n_chars``, its code points, to every row."""
    model = Model(labelled_pages(pages_to_train, seed))

    @F.pandas_udf("text string, n_chars long")
    def main_text(found: pd.Series) -> pd.DataFrame:
        out = [model.main_text(x) for x in found]
        return pd.DataFrame({"text": out, "n_chars": [len(t) for t in out]})

    pages = pages.drop(*(c for c in ("text", "n_chars", "__cf_t") if c in pages.columns and c != page))
    return pages.withColumn("__cf_t", main_text(F.col(page))).select("*", "__cf_t.*").drop("__cf_t")
