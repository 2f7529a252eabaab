"""Fuzzy line dedup in DataFrame functions only.

Lines are lower-cased and cut into words at ASCII characters that are neither
letter nor digit; lines of equal words are one from the start.  The features of a
line are its pairs of neighbouring words, with its ends as words; a line of at most
``SHORT`` characters also has its runs of ``GRAM`` characters, as a changed word
leaves too few pairs there.  Each line's row is turned into a sketch by itself, of
the ``KEPT`` least hashes of its features:

* a 64-bit SimHash, by the votes of the ``VOTES`` least (all, in lines with no more),
* a map of 256 bits with one for each, which tells how many two lines share, and
* the ``VIEWED`` least.

Short lines also keep a map of all their runs, and themselves.

Hashes of pairs that begin with a short word come after all others: such pairs are in
too many lines.  Nothing is left out by that order, as lines of such pairs alone are
told by them.  Equal lines are one before anything is shuffled but once per task.

Lines meet in two ways.  Fingerprints at most ``RADIUS`` bit apart agree in one of
two 32-bit blocks.  SimHash alone can't serve the similarity asked for: one changed
word of ten already moves 12 bits.  So lines also meet in the pairs of their
``VIEWED`` least hashes, and go on if their maps share ``ALIKE`` of their bits; two
short lines are compared where they meet, as each edit changes ``GRAM`` runs at most and
the maps of all runs leave few pairs to it, so pairs that don't hold are never written.  Lines
that meet are not paired with each other at once: in each cell all are held against
one of them, then, in cells whose lines are still in different groups, against
another one and their neighbours in random order, and only cells that are mixed
after that are looked at pair by pair.  There the lines' texts go to the cells, each pair
is compared in one of the cells that it shares, drawn by the pair, and only pairs that
hold are written.  Links are kept where the edit similarity of
the two lines, 1 - edits / length of the longer one, is at least ``SIMILARITY``, in
characters up to ``LONG`` of them and in words beyond, as the cost grows with the
square of the length; only texts of lines that are compared are fetched for this, and
before the last step at most ``PAIRS`` pairs have theirs beside them at once.  Each connected
group keeps its first occurrence by (doc_id, position), and the others are cut from
their documents.  Finding a pair is likely, not certain; edits scattered over most
words of a line are missed.

Cases: null and empty texts stay as they are; lines without words are neither
matched nor removed; lines of any length are compared whole; a null ``doc_id``
comes before all others; rows that agree in id and text are one document and are
cut alike; other columns stay; an empty table gives an empty result.  Lines that
differ but share a 64-bit hash would be taken as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, components, cut, drop, popcount, shielded

RADIUS = 1
SIMILARITY = 0.8
BLOCKS = 2
#: ASCII that is in no word, but for the line feed; single spaces stay as they are.
#: Characters are listed one by one, as Java looks them up in a table then.
GAP = "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum() and i != 10)
GAPS = rf"[{GAP}](?:(?<!\x20)[{GAP}]*+|[{GAP}]++)"
#: Least hashes of a line that are kept, those that vote on its fingerprint, and those whose pairs are views.
KEPT, VOTES, VIEWED = 16, 15, 6
#: Words of 64 bits in the map of the least hashes.
MAPS = 4
#: Words of 64 bits in the map of all runs of a short line.
RUN_MAPS = 8
#: Of the bits of the fuller map as many are to be in both, in lines that are to be compared, unless both are short.
ALIKE = 0.4
#: Pairs that are compared at once, as each has two texts beside it.
PAIRS = 1 << 20
#: Lines of larger cells are dealt to groups of about so many, and the pairs of each two groups are a block.
CROWD = 256
#: Cells are dealt to so many batches by their hash; what one batch shuffles is removed before the next.
BATCHES = 3
#: Pairs that begin with a word of at most so many bytes come after others.
COMMON = 3
#: Lines of at most SHORT characters are also told by their runs of GRAM characters.
SHORT, GRAM = 40, 3
#: Edits of lines longer than LONG characters are counted in words.
LONG = 1000
#: Bytes of code in one of Spark's methods at most.
METHODS = "spark.sql.codegen.hugeMethodLimit"
#: Words of 64 bits in the filter of wanted lines: by their number, between these powers of two (8 MB at most).
LEAST_WORDS, MOST_WORDS = 10, 20


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, doc, line_no, line, h)``: each line with a word, normalised; ``h`` names its normalised form."""
    plain = F.split(F.regexp_replace(F.lower(text), GAPS, " "), "\n")
    d = docs.select(F.col(doc_id).alias("doc_id"), doc_key(doc_id, text).alias("doc"), F.posexplode(plain).alias("line_no", "line"))
    return d.withColumn("line", F.btrim("line")).where("line <> ''").withColumn("h", F.xxhash64("line"))


def doc_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(doc_id, text)


def low_features(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables ``(h, short, size, low)``: ascending, the ``KEPT`` least hashes of a line's pairs of neighbouring words, and of short lines those of its runs.

    Pairs that begin with a short word come after all others, as they are in too many lines to tell them apart.
    The table of short lines has all runs, ``runs``, and ``line`` beside that.
    """
    least = lambda xs: F.slice(F.sort_array(F.array_distinct(xs)), 1, KEPT).alias("low")
    d = lines.select("h", F.length("line").alias("size"), F.concat(F.array(F.lit("")), F.split("line", " ")).alias("words"))

    def pair(w: Column, i: Column) -> Column:
        first = F.when(F.octet_length(w) <= COMMON, F.lit(0).cast("long")).otherwise(F.lit(-(1 << 63)))
        return F.shiftrightunsigned(F.xxhash64(w, F.get("words", i + 1)), 1).bitwiseOR(first)

    of_words = d.select("h", F.lit(False).alias("short"), "size", least(F.transform("words", pair)))
    held = F.concat(F.lit("\n"), "line", F.lit("\n"))
    s = lines.where(F.length("line") <= SHORT).select("h", "line", F.length("line").alias("size"), held.alias("held"))
    runs = F.transform(F.sequence(F.lit(1), F.col("size") + 3 - GRAM), lambda i: F.xxhash64(F.substring("held", i, F.lit(GRAM))))
    s = s.select("h", "line", "size", runs.alias("runs"))
    return of_words, s.select("h", F.lit(True).alias("short"), "size", least(F.col("runs")), "runs", "line")


def map_of_runs(q: int) -> Column:
    """Word ``q`` of the map of all runs of a line."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    here = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(RUN_MAPS - 1)) == q
    return F.aggregate("runs", F.lit(0).cast("long"), lambda held, h: F.when(here(h), held.bitwiseOR(bit(h))).otherwise(held))


def majority(x: list[Column]) -> Column:
    """The SimHash of ``VOTES`` hashes: eight counters of eight bits to a sum, bit 3 of which tells a majority."""
    mask, fp = F.lit(0x0101010101010101), F.lit(0).cast("long")
    for j in range(8):
        votes = reduce(lambda a, b: a + b, (F.shiftrightunsigned(v, j).bitwiseAND(mask) for v in x[:VOTES]))
        fp = fp.bitwiseOR(F.shiftleft(F.shiftrightunsigned(votes, 3).bitwiseAND(mask), j))
    return fp


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Java never compiles methods of over 8000 bytes; Spark cuts its code into smaller ones then."""
    before = spark.conf.get(METHODS, None)
    spark.conf.set(METHODS, "8000")
    try:
        yield
    finally:
        spark.conf.unset(METHODS) if before is None else spark.conf.set(METHODS, before)


def sketches(lines: DataFrame) -> DataFrame:
    """``(h, short, size, fp, m0, ..., x0, ..., r0, ..., line)`` of each distinct line, and of short ones a second row for their runs.

    ``m`` is a map of ``64 * MAPS`` bits with one for each of the least hashes, ``x`` are
    the ``VIEWED`` least of them; rows for runs have the map ``r`` of all of them and the
    line.  All is worked out in the line's own row.
    """
    of_words, of_runs = low_features(lines)
    of_runs = of_runs.withColumns({f"r{q}": map_of_runs(q) for q in range(RUN_MAPS)}).drop("runs")
    with small_methods(lines.sparkSession):
        # apart, as a text can't be in the buffers of the quick aggregate
        return cut(sketched(of_words).unionByName(sketched(of_runs), allowMissingColumns=True), "held")


def sketched(low: DataFrame) -> DataFrame:
    """The sketches of features ``low``, one for each line, with all other columns."""
    own = [c for c in low.columns if c not in ("h", "short", "size", "low")]
    # a line with fewer features repeats them, so that each has about as many votes
    p = low.select("h", "short", "size", "low", *own, *(F.coalesce(F.get("low", F.pmod(F.lit(k), F.size("low"))), F.lit(0)).alias(f"p{k}") for k in range(KEPT)))
    # the hashes' top bit tells pairs of short words and the one below orders them, so both vote by others
    mixed = [F.xxhash64(f"p{k}").alias(f"p{k}") for k in range(KEPT)]
    p = p.select("h", "short", "size", *own, *(F.get("low", F.lit(k)).alias(f"x{k}") for k in range(VIEWED)), *mixed)
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"p{k}").bitwiseAND(F.lit(63)).cast("int"))
    at = lambda k: F.shiftrightunsigned(f"p{k}", 6).bitwiseAND(F.lit(MAPS - 1))
    maps = [reduce(lambda a, b: a.bitwiseOR(b), (F.when(at(k) == q, one(k)).otherwise(F.lit(0).cast("long")) for k in range(KEPT))).alias(f"m{q}") for q in range(MAPS)]
    rows = p.select("h", "short", "size", majority([F.col(f"p{k}") for k in range(VOTES)]).alias("fp"), *maps, *(f"x{k}" for k in range(VIEWED)), *own)
    held = [c for c in rows.columns if c not in ("h", "short")]
    return rows.groupBy("h", "short").agg(*(F.any_value(c).alias(c) for c in held))


def cells_of_prints() -> list[Column]:
    """The cells that a line's fingerprint is in."""
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(BLOCKS)]
    return [F.xxhash64(F.lit(n), *(block[k] for k in way)) for n, way in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))]


def every_cell() -> Column:
    """The cells that a row of ``sketches`` is in, and nulls."""
    views = [F.when(F.col(f"x{j}").isNotNull(), F.xxhash64("short", f"x{i}", f"x{j}")) for i, j in combinations(range(VIEWED), 2)]
    return F.array(*views, *(F.when(~F.col("short"), key) for key in cells_of_prints()))


def meetings(held: DataFrame, batch: int) -> DataFrame:
    """``(cell, h, one)``: the lines of each cell that more than one line is in and the least of them, for one batch of cells."""
    cells = held.select("h", F.explode(every_cell()).alias("cell")).where(F.pmod("cell", F.lit(BATCHES)) == batch)
    row = Window.partitionBy("cell").orderBy("h")
    met = cells.select("cell", "h", F.first("h").over(row).alias("one"), F.lead("h").over(row).alias("after"))
    return met.where("one <> h or after is not null").drop("after")


def may_be_alike(l: str, r: str, similarity: float) -> Column:
    """Whether sizes, least hashes and fingerprints allow the similarity; of two short lines, whether they have it."""

    def share(least: float) -> Column:
        bits = lambda of: reduce(lambda a, b: a + b, (popcount(of(f"m{q}")) for q in range(MAPS)))
        both = bits(lambda c: F.col(f"{l}.{c}").bitwiseAND(F.col(f"{r}.{c}")))
        return both >= least * F.greatest(*(bits(lambda c, e=e: F.col(f"{e}.{c}")) for e in (l, r)))

    def only_in(x: str, y: str) -> Column:
        return reduce(lambda a, b: a + b, (popcount(F.col(f"{x}.r{q}").bitwiseAND(F.bitwise_not(F.col(f"{y}.r{q}")))) for q in range(RUN_MAPS)))

    bits = popcount(F.col(f"{l}.fp").bitwiseXOR(F.col(f"{r}.fp")))
    longer = F.greatest(f"{l}.size", f"{r}.size")
    fits = F.least(f"{l}.size", f"{r}.size") >= similarity * longer - 1e-9
    most = most_edits(longer, similarity)
    held = (only_in(l, r) <= GRAM * most) & (only_in(r, l) <= GRAM * most) & (F.call_function("levenshtein", F.col(f"{l}.line"), F.col(f"{r}.line"), most) >= 0)
    return fits & F.when(longer <= SHORT, held).otherwise((bits <= RADIUS) | share(ALIKE))


def most_edits(longer: Column, similarity: float) -> Column:
    return F.floor((1 - similarity) * longer + 1e-9).cast("int")


def told_by(held: DataFrame, *more: Column) -> DataFrame:
    """What ``may_be_alike`` asks of each line, and ``more``; ``r0``, ... are the map of its runs and ``line`` its text, or null."""
    runs = held.where("short").select("h", *(f"r{q}" for q in range(RUN_MAPS)), "line")
    return held.where("not short").select("h", "size", "fp", *(f"m{q}" for q in range(MAPS)), *more).join(runs, "h", "left")


def alike(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Those pairs ``a < b`` that ``may_be_alike`` lets through."""
    x, y = (told_by(held).withColumnRenamed("h", f"h{c}").alias(c) for c in "lr")
    return pairs.distinct().join(x, F.col("a") == F.col("hl")).join(y, F.col("b") == F.col("hr")).where(may_be_alike("l", "r", similarity)).select("a", "b")


def star_links(met: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """Pairs ``a < b``: all lines of a cell with those in columns ``ends``, but within groups."""
    pairs = (met.where((F.col(c) != F.col("h")) & (F.col(f"{c}_root") != F.col("root"))).select(F.least(c, "h").alias("a"), F.greatest(c, "h").alias("b")) for c in ends)
    return reduce(DataFrame.unionByName, pairs)


def compared_here(l: str, r: str) -> Column:
    """Whether the cell is the one, of all that two lines meet in by their words, in which they are compared.

    It is drawn by the pair, so that the pairs of a crowd are dealt over its cells.
    """
    both = F.array_intersect(f"{l}.views", f"{r}.views")
    n, drawn = F.size(both), F.xxhash64(f"{l}.h", f"{r}.h")
    i = F.pmod(drawn, n)
    j = F.pmod(i + 1 + F.pmod(F.shiftright(drawn, 20), n - 1), n)
    view = F.xxhash64(F.lit(False), *(F.get(both, f(i, j).cast("int")) for f in (F.least, F.greatest)))
    keys = range(len(cells_of_prints()))
    block = F.coalesce(*(F.when(F.col(f"{l}.key{k}") == F.col(f"{r}.key{k}"), F.col(f"{l}.key{k}")) for k in keys))
    return F.col(f"{l}.cell").eqNullSafe(F.when(n > 1, view).otherwise(block))


def in_blocks(met: DataFrame) -> DataFrame:
    """``(cell, h, root, own, block, alone)``: each line of a cell in all blocks of its group ``own``; ``alone`` tells the block of the group itself.

    Any two lines of a cell are held against each other in one block: ``alone`` if they are
    of one group, else the block of both.  So a crowd is dealt over many tasks, and each of
    its lines is in as many blocks as there are groups.
    """
    n = F.ceil(F.count("*").over(Window.partitionBy("cell")) / CROWD)
    d = met.select("cell", "h", "root", n.alias("n")).withColumn("own", F.pmod(F.xxhash64("h"), "n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    d = d.select("*", other.alias("other")).withColumn("block", F.least("own", "other") * F.col("n") + F.greatest("own", "other"))
    return d.select("cell", "h", "root", "own", "block", (F.col("own") == F.col("other")).alias("alone"))


def other_links(met: DataFrame, held: DataFrame, similarity: float, texts: DataFrame | None = None) -> DataFrame:
    """Links ``a < b``: all lines of a cell that are in different groups, compared by ``texts`` in one cell of each pair.

    Texts go to the cells, by ``in_blocks``, and no pair is written that doesn't hold.  Without texts only pairs of short lines are compared.
    """
    spark = met.sparkSession
    views = F.array_compact(F.array(*(f"x{k}" for k in range(VIEWED)))).alias("views")
    told = in_blocks(met).join(told_by(held, views, *(c.alias(f"key{k}") for k, c in enumerate(cells_of_prints()))), "h")
    if texts is not None:
        told = told.join(measured(texts).select("h", F.struct("line", "coded", "longest", "size").alias("t")), "h")
    # as many parts as are set, whatever their size, as it is the comparisons that take time
    told = cut(told, "told")
    dealt = told.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "block")
    l, r = dealt.alias("l"), dealt.alias("r").hint("merge")
    here = (F.col("l.cell") == F.col("r.cell")) & (F.col("l.block") == F.col("r.block"))
    apart = here & (F.col("l.alone") | (F.col("l.own") != F.col("r.own"))) & (F.col("l.h") < F.col("r.h")) & (F.col("l.root") != F.col("r.root"))
    long = F.greatest("l.size", "r.size") > SHORT
    links = may_be_alike("l", "r", similarity) & F.when(long, compared_here("l", "r")).otherwise(True)
    if texts is not None:
        links = links & F.when(long, edits_hold("l.t", "r.t", similarity)).otherwise(True)
    with small_methods(spark):
        out = cut(l.join(r, apart & links).select(F.col("l.h").alias("a"), F.col("r.h").alias("b")).distinct(), "made")
    drop(told)
    return out


def texts_of(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """``(h, line)`` of the lines whose ``h`` is in ``wanted``, which names each once.

    A filter, made by an aggregate and sized by the number of wanted lines within
    fixed bounds, keeps most other lines from the shuffle; copies are summed up
    before it, so a hot line is one row per task.
    """
    words = 1 << min(MOST_WORDS, max(LEAST_WORDS, (wanted.count() // 2).bit_length()))
    slot, bit = F.pmod(F.col("h"), F.lit(words)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    none = wanted.sparkSession.range(words).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bits"))
    filled = bits.unionByName(none).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    array = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "bits"))), lambda w: w["bits"]).alias("a"))
    held = cut(array, "filter").scalar()
    passed = lines.where(F.call_function("shiftright", F.element_at(held, slot.cast("int") + 1), bit).bitwiseAND(F.lit(1)) == 1)
    return passed.groupBy("h").agg(F.min("line").alias("line")).join(wanted, "h", "left_semi")


def coded(line: str) -> Column:
    """A line with one character for each word, told by a hash into 49,152 letters outside the surrogates."""
    letters = F.transform(F.split(line, " "), lambda w: F.hex(F.lit(0x1000) + F.pmod(F.xxhash64(w), F.lit(0xC000))))
    return F.decode(F.unhex(F.array_join(letters, "")), "UTF-16BE")


def measured(texts: DataFrame) -> DataFrame:
    """``(h, line, coded, longest, size)``: what ``edits_hold`` asks of each line; tables that have it stay."""
    if "coded" in texts.columns:
        return texts
    longest = F.array_max(F.transform(F.split("line", " "), lambda w: F.length(w)))
    return texts.select("h", "line", coded("line").alias("coded"), longest.alias("longest"), F.length("line").alias("size"))


def edits_hold(x: str, y: str, similarity: float) -> Column:
    """Whether two lines have the edit similarity asked for.

    Edits in characters are at most those in words times the longest word and its
    space, so few changed words settle a pair; one word more is reckoned, lest two
    words of the same letter count.  Where words let expect few edits, half as many
    are tried first, as the cost grows with the edits that are allowed.
    """
    longer, shorter = (f(f"{x}.size", f"{y}.size") for f in (F.greatest, F.least))
    n = lambda f: f(F.length(f"{x}.coded"), F.length(f"{y}.coded"))
    word, most, words = F.greatest(f"{x}.longest", f"{y}.longest") + 1, most_edits(longer, similarity), most_edits(n(F.greatest), similarity)
    within = lambda c, k: F.call_function("levenshtein", F.col(f"{x}.{c}"), F.col(f"{y}.{c}"), k.cast("int")) >= 0
    by_words = (2 * word <= most) & within("coded", F.floor(most / word) - 1)
    likely = within("coded", F.floor(most / 10)) & within("line", F.floor(most / 2))
    by_coded = (n(F.greatest) - n(F.least) <= words) & within("coded", words)
    return (shorter >= similarity * longer - 1e-9) & F.when(longer > LONG, by_coded).otherwise(by_words | likely | within("line", most))


def verified(links: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links whose lines have the edit similarity asked for."""
    held = measured(texts).select("h", F.struct("line", "coded", "longest", "size").alias("t"))
    x, y = (held.select(F.col("h").alias(h), F.col("t").alias(c)) for h, c in (("a", "x"), ("b", "y")))
    return links.join(x, "a").join(y, "b").where(edits_hold("x", "y", similarity)).select("a", "b")


def verified_in_parts(links: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``verified``, with texts beside at most about ``PAIRS`` pairs at once; what one part shuffles is removed before the next."""
    n = -(-links.count() // PAIRS) or 1
    part = F.pmod(F.xxhash64("a", "b"), F.lit(n))
    found = [cut(verified(links.where(part == k) if n > 1 else links, texts, similarity), "holds") for k in range(n)]
    if n == 1:
        return found[0]
    out = cut(reduce(DataFrame.unionByName, found), "holds")
    drop(*found)
    return out


def groups_of(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, root)``: the connected groups of lines with the edit similarity; ``lines`` are as from ``lines_of``."""
    held = sketches(lines)
    # by hash, as two lines may have the same cell at different places
    batches = [cut(meetings(held, batch), "met") for batch in range(BATCHES)]
    met = reduce(DataFrame.unionByName, batches)
    found, tried, groups = [], [], None
    # first the least line of each cell, then another one and neighbours in cells left, then all pairs
    for k in range(3):
        if k == 2:
            texts = cut(measured(texts_of(met.select("h").distinct(), lines)), "texts")
            found.append(other_links(met, held, similarity, texts))
            drop(texts)
        else:
            starred = star_links(met, ("one", "last")) if k else star_links(met.withColumns({"root": F.col("h"), "one_root": F.col("one")}), ("one",))
            made = alike(starred, held, similarity)
            links = made
            for t in tried:
                links = links.join(t, ["a", "b"], "left_anti")
            tried.append(cut(links, "links"))
            drop(made)
            ends = cut(tried[-1].select(F.col("a").alias("h")).unionByName(tried[-1].select(F.col("b").alias("h"))).distinct(), "ends")
            texts = cut(measured(texts_of(ends, lines)), "texts")
            found.append(verified_in_parts(tried[-1], texts, similarity))
            drop(ends, texts)
        if k and found[-1].isEmpty():
            if k == 2:
                break
        else:
            groups, old = components(reduce(DataFrame.unionByName, found)), groups
            drop(old)
        if k < 2:
            left = cells_apart(met, groups, 2 + k)
            drop(*batches)
            met, batches = left, [left]
    drop(held, *batches, *found, *tried)
    return groups


def cells_apart(met: DataFrame, groups: DataFrame, done: int) -> DataFrame:
    """The lines of those cells of ``met`` that hold different groups, with another line as ``one`` and the one before as ``last``.

    In cells of at most ``done`` lines all pairs have been looked at.
    """
    now = met.select("cell", "h").join(groups.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    mixed = now.groupBy("cell").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where(f"least <> most and n > {done}").select("cell")
    row = Window.partitionBy("cell").orderBy(F.xxhash64("h", "cell"))
    of = {f"{c}{r}": f(v).over(row) for c, f in (("one", F.first), ("last", F.lag)) for r, v in (("", "h"), ("_root", "root"))}
    return cut(now.join(mixed, "cell").select("cell", "h", "root", *(v.alias(c) for c, v in of.items())), "met")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, doc, gone)``: for each document with repeats the positions of the lines to cut."""
    lines = cut(lines_of(docs, doc_id, text), "lines")
    groups = groups_of(lines, similarity)
    at = lines.select("doc_id", "doc", "line_no", "h")
    # the first occurrence and number of each line, then of each group: hot lines are one row per task before the shuffle
    each = at.groupBy("h").agg(F.min(F.struct("doc_id", "doc", "line_no")).alias("first"), F.count("*").alias("n"))
    each = each.join(groups.select(F.col("node").alias("h"), "root"), "h", "left").select("h", F.coalesce("root", "h").alias("root"), "first", "n")
    each = cut(each, "each")
    whole = each.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where("n > 1")
    again = cut(each.join(whole.select("root", "kept"), "root").select("h", "kept"), "again")
    here = F.struct("doc_id", "doc", "line_no")
    gone = at.join(again, "h").where(~here.eqNullSafe(F.col("kept")))
    out = cut(gone.groupBy("doc_id", "doc").agg(F.collect_set("line_no").alias("gone")), "gone")
    drop(lines, each, again, groups)
    return out


def flags_of(positions: Column) -> Column:
    """For each position up to the last of ``positions`` whether it is one of them."""
    others = F.array_except(F.sequence(F.lit(0), F.array_max(positions)), positions)
    marked = F.concat(F.transform(others, lambda i: F.struct(i.alias("i"), F.lit(False).alias("gone"))), F.transform(positions, lambda i: F.struct(i.alias("i"), F.lit(True).alias("gone"))))
    return F.transform(F.sort_array(marked), lambda m: m["gone"])


def with_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``__cf_gone``, whether each line is to be cut, and their number, or nulls."""
    found = repeats(docs, doc_id, text, similarity)
    found = found.select(F.col("doc_id").alias("__cf_id"), F.col("doc").alias("__cf_doc"), F.size("gone").alias("__cf_n"), flags_of(F.col("gone")).alias("__cf_gone"))
    met = docs.withColumn("__cf_key", doc_key(doc_id, text)).join(found, (F.col("__cf_key") == F.col("__cf_doc")) & F.col(doc_id).eqNullSafe(F.col("__cf_id")), "left")
    return met.drop("__cf_id", "__cf_doc", "__cf_key")


def left_over(text: str, gone: str) -> Column:
    """The text without the lines that are marked."""
    rest = F.filter(F.split(text, "\n"), lambda line, i: ~F.coalesce(F.get(F.col(gone), i), F.lit(False)))
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeats cut from ``text``, and ``n_lines`` before and ``n_removed``."""
    docs = docs.drop(*(c for c in ("n_lines", "n_removed") if c in docs.columns))
    met = with_repeats(docs, doc_id, text, similarity)
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    return met.withColumns({"n_lines": n, "n_removed": F.coalesce("__cf_n", F.lit(0)).cast("long"), text: left_over(text, "__cf_gone")}).drop("__cf_gone", "__cf_n")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with repeats cut; documents that lose their last word by it go, all others stay."""

    def rest(d: DataFrame) -> DataFrame:
        out = dedup(d, doc_id, text).where((F.col("n_removed") == 0) | F.col(text).rlike(WORD))
        if n_chars in d.columns:
            out = out.withColumn(n_chars, F.when(F.col("n_removed") > 0, F.length(text).cast(d.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
        return out.select(*d.columns)

    return shielded(docs, (doc_id, text, n_chars), rest)
