"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from cairnfield.llm import chat, decontaminate, htmltree, linededup, mixing, pii, quality, simhash, similar, urlfilter, warc

LONG = "word and other words " * 60_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, _key string, copies int"
ROWS = [
    (1, "a clean line of some words\nanother line here", "en", "s", 10, "x", "y", "z", 3),
    (1, "a clean line of some words\nanother line here", "en", "s", 10, "x", "y", "z", 3),
    (2, None, None, None, None, None, None, None, None),
    (None, "", "en", "s", 0, "x", "y", "z", 3),
    (3, "   \n\n\t", "en", None, 5, "x", "y", "z", 3),
    (4, LONG, "de", "t", len(LONG), "x", "y", "z", 3),
    (5, "é" * 100_000, None, "t", 1, "x", "y", "z", 3),
]
BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(docs, none):
    out = quality.quality_rules(docs)
    assert out.count() == len(ROWS) and set(docs.columns) - {"kept"} <= set(out.columns)
    assert {r.doc_id: (r.n_words, r.base_failed) for r in out.collect()}[2] == (0, True)
    assert quality.verdicts(docs).count() == len(ROWS)
    assert quality.keep(docs).columns == docs.columns
    assert quality.quality_rules(none).count() == 0 == quality.verdicts(none).count()


def test_pii(docs, none):
    out = pii.detect(docs)
    assert out.count() == len(ROWS) and {r.spans for r in out.collect()} == {""}
    assert pii.detect(none).count() == 0
    assert sorted(pii.sanitise(docs).columns) == sorted(docs.columns) and pii.sanitise(docs).exceptAll(docs).isEmpty()


def test_pii_digit_runs_of_any_length(spark):
    text = "at 10.0.0." + "0" * 6000 + "1 and " + "9" * 6000 + ".1.1.1 " + "1." * 3000
    assert [k for k, _, _ in pii.base_spans(text)] == ["ip"] + ["ip"] * 750


def test_urlfilter(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "no scheme/at all", "c"), (4, "http://X.net", "d"), (5, "http://X.NET/", "e"), (6, "ftp://a.example.net/en/x?casino", "f"), (6, "ftp://a.example.net/en/x?casino", "f"), (7, "http://h/" + "adult-free/" * 20_000, "g")]
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string"))
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in out.collect()}
    assert got == {1: ("", None, "allow"), 2: ("", None, "allow"), 3: ("", None, "allow"), 4: ("x.net", None, "allow"), 5: ("x.net", "net/", "block"), 6: ("a.example.net", "example.net/en/", "allow"), 7: ("h", None, "block")}
    assert out.count() == 8
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_htmltree(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "<p"), (5, "<article><p>" + "x " * 300_000), (5, "<article><p>" + "x " * 300_000), (6, "<div>" * 3000 + "<p>deep words in here.</p>")]
    out = htmltree.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")))
    got = {r.page_id: (r.text, r.n_chars) for r in out.collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [("", 0)] * 4 and got[5][1] == 599_999 and out.count() == 7
    assert htmltree.extract(spark.createDataFrame([], "html string")).count() == 0


def test_decontaminate(spark, docs, none):
    text = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "tiny item"), (4, text)], BENCH)
    more = docs.unionByName(spark.createDataFrame([(9, "before " + text.upper() + " after", "en", "s", 1, "x", "y", "z", 1), (8, "a tiny item", "en", "s", 1, "x", "y", "z", 1)], DOCS))
    hits = sorted((r.doc_id, r.item_id or 0, r.similarity, r.start_word) for r in decontaminate.contaminated(more, bench).collect())
    assert hits == [(8, 0, 1.0, 1), (9, 1, 1.0, 1), (9, 4, 1.0, 1)]
    assert decontaminate.decontaminate(more, bench).exceptAll(docs).isEmpty()
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], BENCH)).count() == 0
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], BENCH)).count() == len(ROWS)


def test_mixing(docs, none):
    out = mixing.mix(docs)
    assert "copy" in out.columns and out.where("copy >= copies or source_size = 0").isEmpty() and set(docs.columns) <= set(out.columns)
    t = mixing.taken(docs)
    assert t.count() == len(ROWS) and t.where("taken > 3 * size").isEmpty()
    assert mixing.mix(none).count() == 0 == mixing.taken(none).count()


def test_warc(spark):
    big = "<p>" + "ü" * 200_000
    rows = [(1, "http://a/ b\n", big), (0, "http://a/", big), (2, None, None), (3, "", ""), (None, "http://n/", "x" * 200), (4, "http://c/", "small"), (5, "http://d/", "small"), (1, "http://a/ b\n", big)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("x")))
    got = sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out.collect())
    n = len(big.encode())
    assert got == [(-1, 200, "response", None), (0, n, "response", None), (1, n, "revisit", 0), (1, n, "revisit", 0), (2, 0, "response", None), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None)]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_simhash(docs, none):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert simhash.near_duplicates(docs).count() == len(ROWS)
    assert {v for (k, fp), v in got.items() if fp == 0} == {2}  # null, empty and blank texts
    assert simhash.near_duplicates(none).count() == 0


def test_similar(docs, none):
    out = similar.keep_first(docs)
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 4, 5]  # texts without words are one group
    assert similar.keep_first(none).count() == 0


def test_keep_first_keeps_one_row_of_each_group(spark):
    t = "some words that are the same in all of these texts and more"
    d = spark.createDataFrame([(1, t), (1, t), (2, t), (3, "entirely different words here to be kept alone"), (None, "nothing to do with the others at all")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in similar.keep_first(d).collect()) == [0, 1, 3]


def test_linededup(docs, none):
    out = linededup.dedup(docs)
    assert out.count() == len(ROWS)
    by = {r.doc_id: r for r in out.collect()}
    assert by[2].text is None and by[3].text == "   \n\n\t" and by[1].n_removed == 0 and by[4].text == LONG
    rest = linededup.without_repeats(docs.withColumn("n_lines", F.lit("mine")))
    assert rest.columns == [*docs.columns, "n_lines"] and rest.where("n_lines = 'mine'").count() == len(ROWS)
    assert linededup.dedup(none).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, part string"
    rows = [(1, 0, "user", "hello", "p"), (1, 0, "user", "hello", "p"), (1, None, None, None, "p"), (None, None, None, "", "p"), (2, 1, "Human", "x" * 300_000, "p"), (3, 0, "robot", "strange label", "p"), (3, 1, "bot", "Assistant: marked twice", "p")]
    out = chat.parse(spark.createDataFrame(rows, schema))
    assert out.count() == len(rows)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in out.collect()}
    assert got[2, 1] == ("user", "x" * 300_000) and got[3, 1] == ("assistant", "marked twice") and got[1, 0] == ("user", "hello")
    assert chat.parse(spark.createDataFrame([], schema)).count() == 0
