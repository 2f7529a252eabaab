"""Results against brute force, planted cases and held-out accuracy."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from functools import reduce
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm import chat, decontaminate, htmltree, linededup, mixing, pii, quality, simhash, similar, urlfilter, warc
from cairnfield.llm.common import components
from tests.conftest import DATA

DOC = "doc_id long, text string"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- components


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 4), (4, 9), (1, 2), (9, 5), (7, 7)], []])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])


# ---- op1


def slow_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), len(lines))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n\t#\x0b \x1c", max_size=60))
def test_measures(text):
    assert quality.measure(text) == slow_measure(text)


def test_fences_reject_junk_and_keep_the_rest(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(r.randint(60, 200))]
        if i % 30 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in out.where("not kept").collect()} == {i for i in range(300) if i % 30 == 0}


def test_sketch_buckets(spark):
    v = spark.createDataFrame([(x,) for x in [0, 1, 63, 64, 65, 127, 128, 1000, 10**9]], "v long")
    rows = v.select("v", quality.bucket(F.col("v")).alias("b")).select("v", "b", quality.lowest(F.col("b")).alias("low")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert all(r.low <= r.v < r.low * (1 + 1 / 31) + 1 for r in rows)


# ---- op2

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ 25é(9", max_size=40))
def test_base_spans(text):
    want = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    want += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    assert [s for s in pii.base_spans(text) if s[0] in ("email", "ip")] == want


def test_cards_and_phones():
    text = "pay 4111 1111-1111 1111 or 4111 1111 1111 1112, call +1 (499) 555-6503 or +12 34"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("card", "4111 1111-1111 1111"), ("phone", "+1 (499) 555-6503")]


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 300_000) == [] and pii.base_spans("@" * 300_000) == []


def test_disclosing_terms(spark):
    r = random.Random(2)
    stock = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(600):
        words = [r.choice(stock) for _ in range(40)]
        if i % 5 == 0:
            words[20:20] = ["mailbox", f"u{i}@example.com"]
        rows.append((i, " ".join(words)))
    rows += [(i, "copied words around same@example.com and others") for i in range(601, 640, 2)]  # copies are no evidence
    out = pii.detect(spark.createDataFrame(rows, DOC)).collect()
    text = dict(rows)
    for x in out:
        base = [s.split(":") for s in x.spans.split(",") if s]
        kinds = {(k, text[x.doc_id][int(a) : int(b)].split("@")[-1]) for k, a, b in base}
        planted = {("email", "example.com"), ("reveal", "mailbox")}
        assert kinds == (planted if x.doc_id % 5 == 0 and x.doc_id < 600 else {("email", "example.com")} if x.doc_id > 600 else set())
    clean = pii.sanitise(spark.createDataFrame(rows, DOC)).where("doc_id = 0").first().text
    assert "[EMAIL]" in clean and "mailbox" not in clean


def test_disclosure_counts_different_texts(spark):
    """Copies do not hide a term, and one entity beside a term in many different texts discloses it."""
    r = random.Random(9)
    stock = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    texts = []
    for i in range(1200):
        words = [r.choice(stock) for _ in range(40)]
        if i % 20 == 0:
            words[20:20] = ["mailbox", f"u{i}@example.com"]
        elif i % 20 == 1:
            words[20:20] = ["zebediah", "same@example.com"]
        texts.append(" ".join(words))
    texts += [texts[0]] * 300
    out = pii.detect(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()
    told = {(x.doc_id, texts[x.doc_id][int(a) : int(b)]) for x in out for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k in ("reveal", "term")}
    want = {(i, w) for i, t in enumerate(texts) for w in ("mailbox", "zebediah") if w in t}
    assert told == want


def test_pii_secrets_and_the_word_before_them(spark):
    """Random keys are secrets, names and paths are not; the word that stands only beside keys is removed, a common one stays."""
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    plain = ["over/the/2024/05/12/long-way-to-the-sea", "a" * 40, "1" * 40, "release-notes-2024-05-12-final", "x" * 200_000]
    for t in plain:
        assert pii.secrets(t, []) == []
    assert [pii.secrets(f"a {key(i)}.", []) for i in range(300)] == [[("secret", 2, 42)]] * 300
    rows = [(i, f"some words here then apikey = {key(i)} and some more words") for i in range(40)]
    rows += [(i, f"some words here number {i} and then some more words") for i in range(40, 400)]
    docs = spark.createDataFrame(rows, DOC)
    out = {r.doc_id: r for r in pii.detect(docs).collect()}
    for i, t in rows:
        at = t.find("apikey")
        assert out[i].spans == (f"secret:{at + 9}:{at + 49},reveal:{at}:{at + 6}" if i < 40 else "")
        assert (out[i].n_secret, out[i].n_terms) == ((1, 1) if i < 40 else (0, 0))
    assert pii.sanitise(docs).where("text rlike 'apikey|[0-9a-f]{40}'").isEmpty()


def test_redact():
    assert pii.redact("abc def ghi", "email:4:7") == "abc [EMAIL] ghi"
    assert pii.redact("abcdef", "ip:1:4,card:2:5,reveal:5:6") == "a[IP]" and pii.redact(None, "ip:0:1") is None


# ---- op3


def test_vocabulary_needs_boundaries():
    v = urlfilter.Vocabulary(urlfilter.WEIGHTS)
    assert v.hits("a.casino-win.com/x") == {"casino", "win", "x"} and v.hits("casinos.com/winner") == set() and v.hits("free_bets") == {"free", "bets"}


# ---- op4


def test_marginals_are_exact():
    model = htmltree.Model(htmltree.labelled_pages(60))
    page = "<body><nav><ul><li><a href=x>one</a></li></ul></nav><div><p>Some text here.</p><p>More.</p></div></body>"
    nodes, _ = htmltree.parse(page)
    odds = np.array(model.evidence(nodes))
    total = np.zeros((len(nodes), 2))
    for y in np.ndindex(*[2] * len(nodes)):
        p = model.root[y[0]]
        for i in range(1, len(nodes)):
            p *= model.edge[nodes[i].tag in htmltree.SECTIONING][y[nodes[i].up]][y[i]] * (np.exp(odds[i]) if y[i] else 1)
        for i, v in enumerate(y):
            total[i, v] += p
    assert np.allclose(model.marginals(nodes), total[:, 1] / total.sum(axis=1))


def test_held_out_pages():
    model, right, n = htmltree.Model(htmltree.labelled_pages()), 0, 0
    for page in htmltree.labelled_pages(150, seed=77):
        nodes, runs = htmltree.parse(page)
        p = model.marginals(nodes)
        label = []
        for x in nodes:
            label.append(x.label if x.label >= 0 else label[x.up] if x.up >= 0 else 1)
        right += sum((p[i] > 0.5) == bool(label[i]) for i, _ in runs)
        n += len(runs)
    assert right / n > 0.93


def test_blocks_and_references():
    model = htmltree.Model(htmltree.labelled_pages())
    body = "<article><h1>Title &amp; more</h1><p>First  long\n line of the text here.<p>Second &lt;b&gt; one<br>with a break in it.</article>"
    page = f"<html><head><title>no</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- x --><div class=ad>Buy it now.</div>{body}<footer>&copy; 2020 us</footer>"
    assert model.main_text(page) == "Title & more\nFirst long line of the text here.\nSecond <b> one with a break in it."


# ---- op5


def test_windows_against_brute_force(spark):
    r = random.Random(4)
    stock = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(80)]
    items = [(i, " ".join(r.choice(stock) for _ in range(r.randint(16, 60)))) for i in range(12)]
    rows = []
    for d in range(80):
        words = [r.choice(stock) for _ in range(r.randint(20, 150))]
        if d % 3 == 0:
            piece = items[d % 12][1].split()
            for _ in range(d % 4):
                piece[r.randrange(len(piece))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = piece
        rows.append((d, " ".join(words)))
    want = set()
    for d, t in rows:
        words = decontaminate.tokens(t)
        for i, item in items:
            own = decontaminate.tokens(item)
            c = Counter(decontaminate.shingles(own))
            best = max((decontaminate.similarity(Counter(decontaminate.shingles(words[s : s + len(own)])), c) for s in range(len(words) - len(own) + 1)), default=0)
            if best >= decontaminate.THRESHOLD:
                want.add((d, i))
    out = decontaminate.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in out.collect()} == want and len(want) >= 10


def test_texts_shorter_than_the_item(spark):
    r = random.Random(14)
    items = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(5, 60)))) for i in range(120)]
    rows = []
    for i, t in items:
        w = t.split()
        for less in range(1, 4 + len(w) // 5):
            rows += [(len(rows), " ".join(w[:-less])), (len(rows) + 1, " ".join(w[less:]))]
    want = set()
    for d, t in rows:
        words = decontaminate.tokens(t)
        for i, item in items:
            own = decontaminate.tokens(item)
            size, c = min(len(own), len(words)), Counter(decontaminate.shingles(own))
            windows = (Counter(decontaminate.shingles(words[s : s + size])) for s in range(len(words) - size + 1))
            if max((decontaminate.similarity(x, c) for x in windows if x), default=0) >= decontaminate.THRESHOLD:
                want.add((d, i))
    out = decontaminate.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in out} == want and len(want) > 300
    assert all(x.start_word == 0 and x.n_words == len(dict(rows)[x.doc_id].split()) for x in out)


def test_small_item_blocks(spark):
    b = spark.createDataFrame([(i, f"text of item number {i} with words") for i in range(20)], "item_id long, text string")
    parts = list(decontaminate.item_blocks(b, "item_id", "text", 200))
    assert len(parts) > 2 and sorted(i for p, _ in parts for i, _ in p) == list(range(20)) and [last for _, last in parts] == [False] * (len(parts) - 1) + [True]


def test_several_blocks_find_the_same(spark, monkeypatch):
    b = spark.createDataFrame([(i, f"text of item number {i} with some words") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before text of item number {i} with some words after") for i in range(0, 30, 3)] + [(99, "clean")], DOC)
    hits = lambda: sorted((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, b).collect())
    kept = lambda: sorted(x.doc_id for x in decontaminate.decontaminate(docs, b).collect())
    want = hits(), kept()
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (200,))
    assert (hits(), kept()) == want and len(want[0]) >= 7 and 99 in want[1]


# ---- op6


def test_each_source_is_near_its_target(spark):
    got = mixing.taken(spark.read.parquet(str(DATA.parent / "sf0.01" / "documents.parquet"))).join(spark.read.parquet(str(DATA.parent / "sf0.01" / "documents.parquet")).select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.max("size").alias("most")).collect():
        assert abs(r.n - r.t) <= max(0.1 * r.t, 2 * r.most)


def test_targets_hit_their_cap(spark):
    rows = [("a", 10), ("b", 1000), ("c", 10), (None, 500)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    # a and c stop at three times their size; the rest goes to b and the null source by 2 to 1
    assert got["a"] == 30 and got["c"] == 30 and abs(got["b"] - 1460 * 2 / 3) < 1e-6 and abs(got[None] - 1460 / 3) < 1e-6


def test_mix_is_near_its_targets_and_repeats(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    one, two = mixing.taken(docs), mixing.taken(docs)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    total = one.agg(F.sum("size"), F.sum("taken")).first()
    assert abs(total[1] / total[0] - 1) < 0.1
    copies = mixing.mix(docs).groupBy("doc_id").count()
    both = one.join(copies, "doc_id", "left").where("taken <> coalesce(count, 0) * size")
    assert both.isEmpty()


# ---- op7


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    name = "x.arc"
    raw = warc.arc_description(version, name) + b"\n" + warc.arc_record(version, 7, "http://a/b c", "pay\nload WARC/1.1\r\n".encode(), name) + b"\n" + warc.arc_record(version, None, None, b"", name) + b"\n"
    (f, a), (g, b) = warc.read_arc(raw)
    assert f["URL"] == "http://a/b%20c" and warc.split_http(a)[1] == b"pay\nload WARC/1.1\r\n" and warc.http_value(warc.split_http(a)[0], "x-page-id") == "7"
    assert g["URL"] == "unknown:" and warc.split_http(b)[1] == b"" and len(f) == len(warc.FIELDS[version])


def test_broken_archives_are_errors():
    raw = warc.arc_description(1, "x.arc") + b"\n" + warc.arc_record(1, 1, "http://a/", b"payload", "x")
    for bad in (raw[:-3], b"http://a/ 0.0.0.0 20200101000000 text/html 3\nabc", warc.arc_description(1, "x.arc") + b"\nhttp://a/ too few 0\n"):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))
    with pytest.raises(ValueError):
        list(warc.read_warc(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_warc_dates_and_ids():
    assert warc.warc_date("20040506070809") == "2004-05-06T07:08:09Z"
    assert warc.record_id("u", "d", 1, "x") == warc.record_id("u", "d", 1, "x") != warc.record_id("u", "d", 2, "x")


# ---- op8


def slow_fingerprint(text, k=3):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB É\n\t.", max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint_of(text) == slow_fingerprint(text)


def test_spark_hashes_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("aé b"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("aé b".encode(), 42)


def test_links_are_all_found(spark):
    r = random.Random(8)
    fps = [r.getrandbits(64) for _ in range(150)]
    for f in list(fps):
        for n in (1, 2, 3, 4, 5):
            g = f
            for b in r.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 400


def test_components_of_documents(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    fp = {i: slow_fingerprint(t) for i, t in text.items()}
    edges = [(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 3]
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == roots(fp, edges)
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == fp


def test_similar_documents_against_brute_force(spark):
    r = random.Random(12)
    stock = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(900)]
    texts = []
    for i in range(40):
        words = [r.choice(stock) for _ in range(r.randint(60, 300))]
        texts.append(" ".join(words))
        for _ in range(3):
            w = list(words)
            for at in r.sample(range(len(w)), round(len(w) * r.choice([0.01, 0.015, 0.02, 0.05]))):
                w[at] = r.choice(stock)
            texts.append(" ".join(w))
    sets = [set(similar.shingles_of(t)) for t in texts]
    edges = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(range(len(texts)), edges)
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    kept = {x.doc_id for x in similar.keep_first(docs).collect()}
    assert len(edges) > 60 and kept >= set(want.values()) and len(kept - set(want.values())) <= 1


def test_similar_with_a_repeated_passage(spark):
    words = [f"word{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[:30])), (3, " ".join(f"other{i}" for i in range(100)))]
    assert {x.doc_id for x in similar.keep_first(spark.createDataFrame(rows, DOC)).collect()} == {1, 3}


@pytest.mark.parametrize("kind", ["scattered", "replaced", "appended"])
def test_similar_whatever_the_edit(spark, kind):
    r, rows = random.Random(5), []
    for i in range(150):
        size = r.choice([100, 300, 1000])
        old = [f"{i}w{k}" for k in range(size)]
        new, fresh = list(old), [f"{i}v{k}" for k in range(size)]
        if kind == "scattered":
            for at in range(20, size, 48):
                new[at] = fresh[at]
        elif kind == "replaced":
            most = (size - 4) // 9 - 4
            at = r.randrange(4, size - most - 4)
            new[at : at + most] = fresh[:most]
        else:
            new += fresh[: size // 5 + size // 50]
        a, b = set(similar.shingles_of(" ".join(old))), set(similar.shingles_of(" ".join(new)))
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
        rows += [(2 * i, " ".join(old)), (2 * i + 1, " ".join(new))]
    kept = {x.doc_id for x in similar.keep_first(spark.createDataFrame(rows, DOC)).collect()}
    assert kept == set(range(0, 300, 2))


# ---- op9


def slow_lines(rows):
    """First occurrences by brute force over all pairs of lines, held to edit similarity alone."""
    at = []
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            n = " ".join(re.findall("[a-z0-9]+", line.lower()))
            if n:
                at.append((d, i, n))
    lines = sorted({n for _, _, n in at})
    near = lambda a, b: abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
    edges = [(a, b) for a, b in combinations(lines, 2) if near(a, b)]
    group = roots(lines, edges)
    seen, gone = set(), Counter()
    for d, i, n in sorted(at):
        if group[n] in seen:
            gone[d] += 1
        seen.add(group[n])
    return gone, len(edges)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines_against_brute_force(spark):
    r = random.Random(3)
    stock = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(300)]
    base = [[r.choice(stock) for _ in range(r.randint(1, 40))] for _ in range(25)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(base))
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(stock)
            lines.append(" ".join(w).capitalize() + r.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    gone, links = slow_lines(rows)
    out = linededup.dedup(spark.createDataFrame(rows, DOC)).collect()
    got = {x.doc_id: x.n_removed for x in out if x.n_removed}
    assert all(n <= gone[d] for d, n in got.items()) and sum(got.values()) >= 0.97 * gone.total() and links > 5
    assert all(len((x.text or "").split("\n")) == x.n_lines - x.n_removed for x in out if x.n_removed < x.n_lines)


def test_long_and_frequent_lines(spark):
    long = " ".join(f"w{i % 701}" for i in range(20_000))
    rows = [(1, long), (2, long + " end"), (3, "x\n" * 30_000 + "y"), (4, "unrelated")]
    got = {x.doc_id: x.n_removed for x in linededup.dedup(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: 0, 2: 1, 3: 29_999, 4: 0}


def test_lines_differ_in_punctuation_and_typos(spark):
    rows = [(1, "All rights reserved."), (2, "- all\trights   reserved!"), (3, "All rights reserved"), (4, "please contact the administrator"), (5, "please contact teh administrator"), (6, "-- !!"), (7, "-- !!")]
    got = {x.doc_id: x.n_removed for x in linededup.dedup(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0}


def test_edits_count_characters(spark):
    links = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    texts = spark.createDataFrame([(1, "please contact the administrator"), (2, "please contact teh administrator"), (3, "please contact our headquarters")], "h long, line string")
    assert [(x.a, x.b) for x in linededup.verified(links, texts).collect()] == [(1, 2)]


def test_similar_lines_of_all_lengths_are_found(spark):
    """Held to edit similarity alone: a changed line goes, whatever its fingerprint."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    rows, want = [], set()
    for i in range(300):
        n = r.choice([4, 6, 10, 20, 40, 80])
        old = [word() for _ in range(n)]
        new = list(old)
        for at in r.sample(range(n), max(1, n // 6)):
            new[at] = word()
        a, b = " ".join(old), " ".join(new)
        rows += [(2 * i, a), (2 * i + 1, b)]
        if edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
            want.add(2 * i + 1)
    gone = {x.doc_id for x in linededup.dedup(spark.createDataFrame(rows, DOC)).where("n_removed > 0").collect()}
    assert gone <= want and len(want) > 150 and len(gone) >= 0.98 * len(want)


def test_lines_that_share_frequent_words_do_not_meet(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    often = ["of the", "in a", "to be", "it was", "on the", "at an", "as if", "by the", "he had", "and the", "is it", "or no", "we do", "so far", "but not"]
    rows = [(i, " ".join(f"{word()} {pair}" for pair in often)) for i in range(60)]
    lines = linededup.cut(linededup.lines_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), "lines")
    held = linededup.sketches(lines)
    assert sum(linededup.meetings(held, k).count() for k in range(3)) == 0


def test_archives_take_the_least_work_of_gzip(spark, tmp_path):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400)]
    pages = [(i, f"http://e.org/{i}", "<p>" + " ".join(r.choice(words) for _ in range(2000)) + "</p>") for i in range(40)]
    warc.write_arc(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "arc"))
    (path,) = (tmp_path / "arc").glob("part-*")
    raw = gzip.decompress(path.read_bytes())
    assert {c.split(b"\r\n\r\n", 1)[1].decode() for _, c in warc.read_arc(path.read_bytes())} == {h for _, _, h in pages}
    assert len(zlib.compress(raw, 6)) * 1.03 < path.stat().st_size < len(raw)


def test_short_lines_that_meet_are_told_by_edits_alone(spark):
    r = random.Random(9)
    parts = ["the", "an", "er", "in", "on", "tion", "re", "st", "ed", "ha"]
    texts = {" ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(r.randint(4, 7)))[: linededup.SHORT].strip() for _ in range(300)}
    texts |= {t[:-1] + "q" for t in list(texts)[::10]} | {"q" + t for t in list(texts)[::15]}
    texts = {t for t in texts if len(t) <= linededup.SHORT}
    lines = linededup.cut(linededup.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"), "lines")
    met = lines.select(F.lit(1).alias("cell"), "h", F.col("h").alias("root")).distinct()
    made = {(x.a, x.b) for x in linededup.other_links(met, linededup.sketches(lines), 0.8).collect()}
    l, o = (lines.select(F.col("h").alias(c), F.col("line").alias(f"line_{c}")).distinct() for c in "ab")
    alike = F.levenshtein("line_a", "line_b") <= F.floor(0.2 * F.greatest(F.length("line_a"), F.length("line_b")) + 1e-9)
    assert made == {(x.a, x.b) for x in l.join(o, F.col("a") < F.col("b")).where(alike).collect()} and len(made) > 30


def test_lines_that_share_a_passage_make_no_pairs_but_links(spark, monkeypatch):
    """A crowd of lines with one passage: only pairs that hold come out of the cells, and all that do."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 8)))
    passage, texts = " ".join(word() for _ in range(30)), []
    for _ in range(90):
        own = [word() for _ in range(r.choice((14, 20, 24)))]
        texts.append(" ".join(own[:9] + [passage] + own[9:]))
        if r.random() < 0.3:
            own[r.randrange(len(own))] = word()
            texts.append(" ".join(own[:9] + [passage] + own[9:]))
    lines = linededup.cut(linededup.lines_of(spark.createDataFrame(list(enumerate(texts)), DOC), "doc_id", "text"), "lines")
    made, other_links = [], linededup.other_links

    def seen(*args):
        made.append({(x.a, x.b) for x in other_links(*args).collect()})
        return other_links(*args)

    monkeypatch.setattr(linededup, "other_links", seen)
    root = {x.node: x.root for x in linededup.groups_of(lines).collect()}
    held = linededup.sketches(lines)
    met = reduce(DataFrame.unionByName, (linededup.meetings(held, k) for k in range(linededup.BATCHES))).select("cell", "h", F.col("h").alias("root"))
    pairs = met.alias("l").join(met.alias("r"), "cell").where("l.h < r.h").select(F.col("l.h").alias("a"), F.col("r.h").alias("b"))
    near = linededup.cut(linededup.alike(pairs, held, 0.8), "near")
    text = lines.select("h", "line").distinct()
    want = {(x.a, x.b) for x in linededup.verified(near, text).collect()}
    assert near.count() > 1000 and 20 < len(want) < 300
    assert {(x.a, x.b) for x in other_links(met, held, 0.8, text).collect()} == want
    assert all(root[a] == root[b] for a, b in want) and made and all(m <= want for m in made)


def test_crowds_are_dealt_in_blocks(spark, monkeypatch):
    """Each pair of a cell meets in one block that compares it, and no block holds the crowd; links are the same."""
    monkeypatch.setattr(linededup, "CROWD", 8)
    met = spark.createDataFrame([(1, k, k) for k in range(120)] + [(2, k, k) for k in range(5)], "cell long, h long, root long")
    blocks = {}
    for x in linededup.in_blocks(met).collect():
        blocks.setdefault((x.cell, x.block), []).append(x)
    held = Counter((c, a.h, b.h) for (c, _), rows in blocks.items() for a in rows for b in rows if a.h < b.h and (a.alone or a.own != b.own))
    assert held == Counter((c, a, b) for c, n in ((1, 120), (2, 5)) for a, b in combinations(range(n), 2))
    assert max(map(len, blocks.values())) < 60 and len(blocks) > 50

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 8)))
    passage, texts = " ".join(word() for _ in range(30)), []
    for _ in range(40):
        own = [word() for _ in range(14)]
        texts += [" ".join(own[:9] + [passage] + own[9:]), " ".join(own[:9] + [passage] + own[9:13] + [word()])]
    lines = linededup.cut(linededup.lines_of(spark.createDataFrame(list(enumerate(texts)), DOC), "doc_id", "text"), "lines")
    sketch = linededup.sketches(lines)
    met = reduce(DataFrame.unionByName, (linededup.meetings(sketch, k) for k in range(linededup.BATCHES))).select("cell", "h", F.col("h").alias("root"))
    found = lambda: {(x.a, x.b) for x in linededup.other_links(met, sketch, 0.8, lines.select("h", "line")).collect()}
    dealt = found()
    monkeypatch.setattr(linededup, "CROWD", 10**6)
    assert dealt == found() and len(dealt) >= 30


def test_only_texts_of_wanted_lines_are_fetched(spark):
    lines = spark.createDataFrame([(f"line {k % 5000}",) for k in range(6000)], "line string").withColumn("h", F.xxhash64("line"))
    lines = linededup.cut(lines, "lines")
    wanted = linededup.cut(lines.where("line like '%7'").select("h").distinct(), "wanted")
    got = linededup.texts_of(wanted, lines).collect()
    assert sorted(x.line for x in got) == sorted(f"line {k}" for k in range(5000) if k % 10 == 7)


def test_edits_are_counted_as_by_plain_distance(spark, monkeypatch):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    rows = []
    for k in range(400):
        x = [word() for _ in range(r.choice((3, 8, 20, 60)))]
        y = [word() if r.random() < r.choice((0.02, 0.1, 0.2, 0.3)) else w[:-1] + "z" if r.random() < 0.1 else w for w in x]
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join(y))]
    texts = linededup.cut(spark.createDataFrame(rows, "h long, line string"), "texts")
    links = linededup.cut(spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(400)], "a long, b long"), "links")
    l, o = (texts.select(F.col("h").alias(c), F.col("line").alias(f"line_{c}")) for c in "ab")
    plain = links.join(l, "a").join(o, "b").where(F.levenshtein("line_a", "line_b") <= F.floor(0.2 * F.greatest(F.length("line_a"), F.length("line_b")) + 1e-9))
    want = {(x.a, x.b) for x in plain.collect()}
    assert {(x.a, x.b) for x in linededup.verified(links, texts).collect()} == want and 50 < len(want) < 350
    monkeypatch.setattr(linededup, "PAIRS", 150)
    assert {(x.a, x.b) for x in linededup.verified_in_parts(links, texts, 0.8).collect()} == want


def test_real_lines_against_brute_force(spark):
    """Lines of up to 120 characters of the table itself, paired by edit distance alone."""
    lines = linededup.lines_of(spark.read.parquet(str(DATA / "documents.parquet")), "doc_id", "text").where("length(line) <= 120")
    held = linededup.cut(lines, "lines")
    t = linededup.cut(held.groupBy("h").agg(F.min("line").alias("line")), "texts")
    a, b = t.select(F.col("h").alias("a"), F.col("line").alias("x")), t.select(F.col("h").alias("b"), F.col("line").alias("y"))
    longer = F.greatest(F.length("x"), F.length("y"))
    want = a.join(b, (F.col("a") < F.col("b")) & (F.least(F.length("x"), F.length("y")) >= 0.8 * longer)).where(F.expr("levenshtein(x, y, cast(floor(0.2 * greatest(length(x), length(y)) + 1e-9) as int)) >= 0"))
    want = [(x.a, x.b) for x in want.select("a", "b").collect()]
    root = {x.node: x.root for x in linededup.groups_of(held).collect()}
    found = sum(root.get(a, a) == root.get(b, b) for a, b in want)
    assert len(want) >= 4 and found >= 0.9 * len(want)


# ---- op10


def test_roles_are_recovered_without_labels(spark):
    rows = spark.read.parquet(str(DATA / "conversations.parquet"))
    hidden = rows.where("role <> 'system'").withColumn("seen", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) > 0, F.col("role")))
    out = chat.parse(hidden, role="seen").where("part = 0").alias("o").join(hidden.alias("h"), ["conv_id", "turn"])
    right = out.where("o.role = h.role").count() / out.count()
    lost = out.where("h.seen is null")
    assert right > 0.97 and lost.where("o.role = h.role").count() / lost.count() > 0.8


def test_transcripts_by_a_model_of_other_conversations(spark):
    rows = spark.read.parquet(str(DATA / "conversations.parquet"))
    hidden = chat.transcripts(rows)
    assert hidden.where("role is not null").isEmpty() and 0 < hidden.alias("h").join(rows.alias("r"), ["conv_id", "turn"]).where("h.text = r.text").count() < 0.5 * rows.count()
    out = chat.parse(hidden, labelled=rows, folds=2).where("part = 0").alias("o").join(rows.alias("r"), ["conv_id", "turn"])
    right, n = out.where("o.role = r.role and o.text = r.text").count(), out.count()
    assert n == rows.count() and right > 0.95 * n


def test_decode_against_all_paths(spark):
    import pandas as pd
    from itertools import product

    rows = spark.read.parquet(str(DATA / "conversations.parquet"))
    model = chat.Model(chat.train(rows)[0])
    for texts in (["what is it?", "a thing\nof sorts"], ["User: so?\nyes", "it is"], ["be kind", "Human: hello", "welcome"]):
        pdf = pd.DataFrame({"role": [None] * len(texts), "text": texts})
        emitted = [e for _, _, e in chat.lines_of(model, pdf)]

        def worth(path):
            total, last = 0.0, None
            for s, e in zip(path, emitted):
                r, goes = s // 2, s % 2
                if goes and (last is None or last // 2 != r):
                    return -1e40
                total += (model.more if goes else model.first[r] if last is None else model.move[last // 2][r]) + e[goes][r]
                last = s
            return total

        assert tuple(s for _, _, s in chat.decode(model, pdf)) == max(product(range(6), repeat=len(emitted)), key=worth)


def test_inline_transcript(spark):
    text = "System: be kind\nUser: what is it?\nIt seems odd.\nAssistant: it is a test.\n### Human: thanks\n**AI:** welcome"
    rows = spark.createDataFrame([(1, 0, None, text)], "conv_id long, turn long, role string, text string")
    many = spark.read.parquet(str(DATA / "conversations.parquet")).withColumn("conv_id", F.col("conv_id") + 100)
    got = [(r.role, r.text) for r in chat.parse(many.unionByName(rows)).where("conv_id = 1").orderBy("part").collect()]
    assert got == [("system", "be kind"), ("user", "what is it?\nIt seems odd."), ("assistant", "it is a test."), ("user", "thanks"), ("assistant", "welcome")]


def test_blocks_give_the_path_of_the_whole(spark):
    r = random.Random(6)
    rows = [(r.choice(["user", "assistant", None, None]), r.choice(["is it so?", "a longer answer to it all", "ok\nand more"])) for _ in range(60)]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(rows)], "conv_id long, turn long, role string, text string")
    model = chat.Model(chat.train(df)[0])
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["role", "text"])
    whole = [s for _, _, s in chat.decode(model, pdf)]
    parts = [pdf[i : i + 7] for i in range(0, len(pdf), 7)]
    ends = chat.borders([chat.matrix_of(model, p) for p in parts])
    assert [s for p, (a, b) in zip(parts, ends) for _, _, s in chat.decode(model, p, a, b)] == whole
