"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than space and U+0009..U+000D.  In
UTF-8 those six bytes never occur inside another character, so ``bytes.split()``
yields exactly these words.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same word pattern for Java, RE2 and Python regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; a null text has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers of this machine find the package, whatever folder the session was started in.

    On a cluster the package is shipped with ``--py-files``; a path that is missing there is passed over.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session of one process (master ``local``) that names none gets a
    temporary folder; on a cluster executors could not see it, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext.getCheckpointDir()
        at = held.rsplit("/", 1)[0] if held else None
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="cairnfield-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/cairnfield/{label}-{uuid.uuid4().hex}"


#: Spark then removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The lineage ends there, so a lost executor costs only the tasks that ran on
    it, and what was computed is not computed again by each of its readers.  The
    shuffle files of the write have no further use and are removed with its end.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_cf_path"] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` made, once all that reads them is written."""
    for t in tables:
        if t is not None and "_cf_path" in t.__dict__:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
            path = jvm.org.apache.hadoop.fs.Path(t.__dict__["_cf_path"])
            path.getFileSystem(conf).delete(path, True)


def shielded(docs: DataFrame, own: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``f`` while all columns but ``own`` have names that clash with none; names with ``__cf`` are reserved."""
    names = {c: f"__cf_kept_{i}" for i, c in enumerate(docs.columns) if c not in own}
    return f(docs.withColumnsRenamed(names)).withColumnsRenamed({v: k for k, v in names.items()})


def popcount(c: Column) -> Column:
    return F.bit_count(c)


def null_safe(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Connected components of an undirected graph as ``(node, root)``.

    ``root`` is the smallest node of the component; only nodes with an edge are
    returned.  Each round hooks every node to its smallest neighbour, follows
    those pointers to their ends by doubling, and contracts the graph, so the
    number of nodes at least halves.  Everything stays in DataFrames; the driver
    sees counts only.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e, "edges")
    labels = None
    for _ in range(most):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to")), "hooks")
        while True:
            on = to.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
            nxt = cut(to.join(on, to["to"] == on["n2"]).select("node", F.col("t2").alias("to"), (F.col("t2") != F.col("to")).alias("moved")), "jump")
            moved = not nxt.where("moved").isEmpty()
            drop(to)
            to = nxt
            if not moved:
                break
        now = to.select("node", "to")
        last, old = labels, e
        if labels is None:
            labels = cut(now, "labels")
        else:
            labels = cut(
                labels.alias("l").join(now.alias("t"), F.col("l.to") == F.col("t.node"), "left")
                .select(F.col("l.node").alias("node"), F.coalesce("t.to", "l.to").alias("to")), "labels")
        p, q = now.select(F.col("node").alias("u"), F.col("to").alias("pu")), now.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        e = cut(e.join(p, "u").join(q, "v").where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
        drop(to, last, old)
    else:
        raise RuntimeError("the components did not settle")
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    drop(e)
    out = labels.select("node", F.col("to").alias("root"))
    out.__dict__["_cf_path"] = labels.__dict__["_cf_path"]
    return out


#: Rounds in which each node is checked against one other, before all pairs left are.
STARS = 2


def connected(links: DataFrame, check: Callable[[DataFrame], DataFrame], stars: int = STARS) -> DataFrame:
    """``(node, root)``: components of those pairs ``a < b`` of ``links`` that ``check`` lets through.

    Whether a pair holds matters only while its ends are in different components.
    So each node is first checked against the least of those that it met, and pairs
    within the components that this makes need no check any more: a crowd of nodes
    that are all alike costs as many checks as it has nodes.  The result is that of
    checking all pairs.  ``links`` is a table of ``cut`` and is deleted.
    """
    found, groups = [], None
    for k in range(stars + 1):
        if links.isEmpty() and found:
            break
        tried = links.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if k < stars else links
        found.append(cut(check(tried), "holds"))
        groups, old = components(reduce(DataFrame.unionByName, found)), groups
        drop(old)
        if k < stars:
            x, y = groups.select(F.col("node").alias("a"), F.col("root").alias("ra")), groups.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            apart = links.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
            links, old = cut(apart.join(tried, ["a", "b"], "left_anti"), "links"), links
            drop(old)
    drop(links, *found)
    return groups
