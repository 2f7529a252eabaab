"""Elevation bands, their statistics and the snowline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BANDS = 254


def lowest_edge(px: DataFrame, mask: str, res: int, dem: str = "dem") -> Column:
    """The multiple of ``res`` at or below the lowest masked elevation, as a scalar subquery."""
    low = F.min(F.when(F.col(mask), F.col(dem)))
    return px.agg((low - F.pmod(low, F.lit(res))).alias("edge")).scalar()


def with_band(px: DataFrame, mask: str, res: int, name: str = "band", dem: str = "dem", edge: Column | int | None = None) -> DataFrame:
    """Add the band number from the lowest edge, null outside the mask; a known edge saves an aggregate."""
    edge = lowest_edge(px, mask, res, dem) if edge is None else edge
    return px.withColumn(name, F.when(F.col(mask), F.floor((F.col(dem) - edge) / res).cast("int")))


def band_edges(banded: DataFrame, px: DataFrame, mask: str, res: int, band: str = "band") -> DataFrame:
    """``(band, edge)`` of the occupied bands."""
    return banded.where(F.col(band).isNotNull()).groupBy(F.col(band).alias("band")).agg(F.lit(1)).select("band", (lowest_edge(px, mask, res) + F.col("band") * res).alias("edge"))


def smallest_resolution(low: Column, high: Column) -> Column:
    """The finest band height for which MAX_BANDS bands are enough."""
    return F.ceil((high - low) / MAX_BANDS)


def check_bands(px: DataFrame, mask: str, res: int, most: int = MAX_BANDS) -> DataFrame:
    """``(n_bands, least_res, fits)`` over the masked elevations."""
    lo, hi = F.min(F.when(F.col(mask), F.col("dem"))), F.max(F.when(F.col(mask), F.col("dem")))
    got = px.agg(lo.alias("lo"), hi.alias("hi"))
    n = F.floor((F.col("hi") - (F.col("lo") - F.pmod("lo", F.lit(res)))) / res).cast("int") + 1
    return got.select(n.alias("n_bands"), smallest_resolution(F.col("lo"), F.col("hi")).cast("int").alias("least_res"), (n <= most).alias("fits"))


def whole(p: Column) -> Column:
    """Towards zero, after taking off what floating point put below a whole number."""
    p = F.round(p, 6)
    return F.when(p < 0, F.ceil(p)).otherwise(F.floor(p)).cast("int")


def band_stats(banded: DataFrame, percentiles: Sequence[int], band: str = "band") -> DataFrame:
    """Exact percentiles, counts and mean depths of each band: the thresholds table.

    One aggregate with a partial stage; its state is the distinct values of a band.
    """
    up_raw, up_norm, low_raw, low_norm = (p / 100 for p in percentiles)
    got = banded.where(F.col(band).isNotNull()).groupBy(F.col(band).alias("band")).agg(
        F.expr(f"percentile(diff, array({up_raw}D, {low_raw}D, 0.5D))").alias("raw"),
        F.expr(f"percentile(norm, array({up_norm}D, {low_norm}D))").alias("rel"),
        F.count("*").alias("elevation_count"),
        F.avg("d1").alias("mean_d1"),
        F.avg("d2").alias("mean_d2"),
    )
    return got.select(
        "band",
        whole(F.col("raw")[0]).alias("thresh_upper_raw"),
        F.col("rel")[0].alias("thresh_upper_norm"),
        whole(F.col("raw")[1]).alias("thresh_lower_raw"),
        F.col("rel")[1].alias("thresh_lower_norm"),
        whole(F.col("raw")[2]).alias("median_raw"),
        "elevation_count", "mean_d1", "mean_d2",
    )


def snowline_of(rows: list, edge: int, threshold: float, res: int, mean: str = "mean_d2") -> int:
    """The same from collected band rows."""
    for place, r in enumerate(sorted(rows, key=lambda r: r["band"])):
        if r[mean] > threshold:
            return edge + place * res
    raise ValueError("no elevation band is deeper than the snowline threshold")


def snowline(stats: DataFrame, edge: Column, threshold: float, res: int, mean: str = "mean_d2") -> DataFrame:
    """One row: the elevation of the lowest band whose mean depth exceeds the threshold.

    The band's place among the occupied ones counts, not its number.  The window
    runs over the bands alone, a few hundred rows at most.
    """
    placed = stats.select("band", F.col(mean).alias("mean"), (F.row_number().over(Window.orderBy("band")) - 1).alias("place"))
    first = placed.agg(F.min(F.when(F.col("mean") > threshold, F.col("place"))).alias("place"))
    return first.select(F.when(F.col("place").isNull(), F.raise_error(F.lit("no elevation band is deeper than the snowline threshold"))).otherwise(edge + F.col("place") * res).cast("int").alias("snowline"))
