"""Pixel tables: read from Parquet, or derived from the order tables for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NODATA


def read_pixels(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """An aligned pixel table; an extent becomes a filter that Parquet can skip by."""
    px = spark.read.parquet(path)
    for name, span in (("row", rows), ("col", cols)):
        if span:
            px = px.where(F.col(name).between(*span))
    return px


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel grid made from ``lineitem`` and ``part``: side, depths by half of the date range, terrain.

    Quantities are summed up by cell and half before they meet the grid, so the
    joins move one row per cell; the side is a scalar aggregate.
    """
    line, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    s = line.agg(F.floor(F.sqrt(F.count("*") / 6.0)).cast("int")).scalar()
    n = part.agg(F.count("*").cast("int")).scalar()
    half = F.when(F.to_date("l_shipdate") < F.to_date(F.lit("1998-06-01")), 1).otherwise(2)
    q = F.col("l_quantity").cast("int")
    sums = line.groupBy((F.col("l_partkey") % s).cast("int").alias("row"), (F.col("l_orderkey") % s).cast("int").alias("col")).agg(
        F.sum(F.when(half == 1, q)).cast("int").alias("q1"), F.sum(F.when(half == 2, q)).cast("int").alias("q2"))
    axis = part.where(F.col("p_partkey") < s).select(F.col("p_partkey").cast("int").alias("row"))
    cells = axis.select("row", F.explode(F.sequence(F.lit(0), F.least(s, n) - 1)).alias("col"))
    cells = cells.withColumn("_p", (F.col("row") * s + F.col("col")) % n)
    veg = part.select(F.col("p_partkey").alias("_p"), (F.col("p_size") % 12).alias("veg"))
    slope = F.floor(F.col("row") * 1500 / s).cast("int")

    def depth(total: str, square: tuple[int, int, int, int]):
        top, bottom, left, right = (F.floor(s * x / 10) for x in square)
        planted = F.col("row").between(top, bottom) & F.col("col").between(left, right)
        return F.when(F.col(total).isNull(), NODATA).when(planted, 0).otherwise(F.greatest(F.lit(0), F.col(total) * 10 - 1600 + slope))

    px = cells.join(sums, ["row", "col"], "left").join(veg, "_p")
    return px.select(
        "row", "col", depth("q1", (6, 7, 6, 7)).alias("d1"), depth("q2", (7, 8, 2, 3)).alias("d2"),
        (1800 + F.floor(F.col("row") * 1000 / s).cast("int") + (F.col("col") * 7) % 50).alias("dem"), "veg",
    )
