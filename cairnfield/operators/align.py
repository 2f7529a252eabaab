"""Grid alignment: a header table, keyed projections and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NODATA
from ..functions import half_pixel, snap

SIDES = ("left", "bottom", "right", "top")


def snapped(headers: DataFrame) -> DataFrame:
    return headers.withColumns({s: snap(F.col(s), F.col("rez")) for s in SIDES})


def shifted(headers: DataFrame, layers: tuple[str, ...] = ("dem", "veg")) -> DataFrame:
    """Bounds of the topography layers moved from pixel edges to pixel positions."""
    topo = F.col("layer").isin(*layers)
    return headers.withColumns({s: F.when(topo, half_pixel(F.col(s), F.col("rez"), s)).otherwise(F.col(s)) for s in SIDES})


def common_extent(headers: DataFrame) -> DataFrame:
    """One row with the bounds common to all layers, snapped to the grid of date2."""
    rez = F.max(F.when(F.col("layer") == "date2", F.col("rez")))
    got = headers.agg(F.max("left").alias("left"), F.max("bottom").alias("bottom"), F.min("right").alias("right"), F.min("top").alias("top"), rez.alias("rez"))
    got = got.withColumns({s: snap(F.col(s), F.col("rez")) for s in SIDES})
    empty = (F.col("right") <= F.col("left")) | (F.col("top") <= F.col("bottom"))
    return got.withColumn("left", F.when(empty, F.raise_error(F.lit("the layers have no common extent"))).otherwise(F.col("left")))


def same_extent(headers: DataFrame) -> DataFrame:
    """One row: whether all layers have the same four bounds."""
    return headers.agg(*((F.min(s) == F.max(s)).alias(s) for s in SIDES)).select((F.col("left") & F.col("bottom") & F.col("right") & F.col("top")).alias("extents_same"))


def check_resolution(headers: DataFrame) -> DataFrame:
    """One row: depth layers must agree on the rounded resolution; ``topo_same`` tells of the topography."""
    r = F.rint("rez")
    depth = F.col("layer").isin("date1", "date2")
    got = headers.agg(F.min(F.when(depth, r)).alias("lo"), F.max(F.when(depth, r)).alias("hi"), F.min(r).alias("a"), F.max(r).alias("b"))
    rez = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("the depth layers have different resolutions"))).otherwise(F.col("lo"))
    return got.select(rez.alias("rez"), (F.col("a") == F.col("b")).alias("topo_same"))


def grid_keys(layer: DataFrame, left: Column, top: Column, rez: Column, right: Column | None = None, bottom: Column | None = None) -> DataFrame:
    """``(row, col, value)`` of point values; points outside the extent are dropped before any join."""
    keyed = layer.select(F.floor((top - F.col("y")) / rez).cast("int").alias("row"), F.floor((F.col("x") - left) / rez).cast("int").alias("col"), "value", "x", "y")
    keep = (F.col("row") >= 0) & (F.col("col") >= 0)
    if right is not None:
        keep = keep & (F.col("x") < right) & (F.col("y") > bottom)
    return keyed.where(keep).select("row", "col", "value")


def coregister(date1: DataFrame, date2: DataFrame, dem: DataFrame, veg: DataFrame) -> DataFrame:
    """One wide pixel table from four keyed layers; all joins share their key and so their exchange."""
    out = date1.withColumnRenamed("value", "d1")
    for name, layer in (("d2", date2), ("dem", dem), ("veg", veg)):
        out = out.join(layer.withColumnRenamed("value", name), ["row", "col"])
    return out.select("row", "col", "d1", "d2", "dem", "veg")


def resample_nearest(target: DataFrame, source: DataFrame, factor: Column) -> DataFrame:
    """Values of a coarser or finer layer at the centres of target cells.

    ``factor`` is the target's resolution over the source's; the cell that holds a
    target's centre is found by arithmetic, so the lookup is an equi-join.
    """
    at = lambda c: F.floor((F.col(c) + 0.5) * factor).cast("int")
    keyed = target.withColumns({"_r": at("row"), "_c": at("col")})
    s = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    return keyed.join(s, ["_r", "_c"]).drop("_r", "_c")


def spine(spark, height: Column, width: Column) -> DataFrame:
    """Every cell of a grid."""
    one = spark.range(1).select(height.cast("int").alias("h"), width.cast("int").alias("w"))
    rows = one.select("w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row"))
    return rows.select("row", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col"))


def pad(clipped: DataFrame, cells: DataFrame, row_offset: int | Column, col_offset: int | Column) -> DataFrame:
    """Clipped values in the original grid, null around them."""
    moved = clipped.withColumns({"row": (F.col("row") + row_offset).cast("int"), "col": (F.col("col") + col_offset).cast("int")})
    return cells.join(moved, ["row", "col"], "left")


def original_shape(header: DataFrame) -> DataFrame:
    """Rows and columns of a layer from its bounds and resolution."""
    span = lambda a, b: F.rint((F.col(a) - F.col(b)) / F.col("rez")).cast("int")
    return header.withColumns({"height": span("top", "bottom"), "width": span("right", "left")})


def missing_to_nodata(c: str) -> Column:
    return F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), NODATA).otherwise(F.col(c))
