"""Counts over square windows of a grid.

Two plans give the same counts.  ``dense`` sums along rows, then along columns,
with range frames: two exchanges for any number of masks and any window size,
but every cell must be there.  ``sparse`` sends each hit to the cells whose windows
hold it and sums there with a partial aggregate: one exchange of hits times
window cells, fit for few hits or tables with missing cells.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interior(k: int, height: Column, width: Column) -> Column:
    """Cells with all of their window inside the grid."""
    return F.col("row").between(F.lit(k), height - 1 - k) & F.col("col").between(F.lit(k), width - 1 - k)


def dense_counts(px: DataFrame, masks: Mapping[str, Column], k: int) -> DataFrame:
    along_row = Window.partitionBy("row").orderBy("col").rangeBetween(-k, k)
    along_col = Window.partitionBy("col").orderBy("row").rangeBetween(-k, k)
    hits = px.withColumns({f"_{n}": F.coalesce(m, F.lit(False)).cast("int") for n, m in masks.items()})
    lines = hits.withColumns({f"_{n}": F.sum(f"_{n}").over(along_row) for n in masks})
    return lines.withColumns({n: F.sum(f"_{n}").over(along_col).cast("long") for n in masks}).drop(*(f"_{n}" for n in masks))


def sparse_counts(px: DataFrame, masks: Mapping[str, Column], k: int) -> DataFrame:
    hits = px.select("row", "col", *(F.coalesce(m, F.lit(False)).alias(n) for n, m in masks.items()))
    some = F.lit(False)
    for n in masks:
        some = some | F.col(n)
    span = F.sequence(F.lit(-k), F.lit(k))
    sent = hits.where(some).withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    sums = sent.groupBy((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(*(F.count_if(n).alias(n) for n in masks))
    return px.join(sums, ["row", "col"], "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in masks})


def counts(px: DataFrame, masks: Mapping[str, Column], size: int, strategy: str = "dense") -> DataFrame:
    """Add, for each mask, how many cells of the window around a cell it holds for."""
    k = size // 2
    return (dense_counts if strategy == "dense" else sparse_counts)(px, masks, k)


def crowded(count: str, size: int, threshold: float, height: Column, width: Column) -> Column:
    """More than ``threshold`` of the window holds; never so for cells near the border."""
    return interior(size // 2, height, width) & (F.col(count) > threshold * size * size)


def grid_shape(px: DataFrame) -> tuple[Column, Column]:
    """Height and width of a complete grid, as scalar subqueries."""
    return px.agg(F.max("row") + 1).scalar(), px.agg(F.max("col") + 1).scalar()
