"""Flags over the pixel table; each stays a full-grid boolean column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QCConfig
from ..functions import within
from ..schema import column_of
from . import bands, histogram, neighborhood

TREE_METRES = 5


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def elevation_loss(names: Sequence[str]) -> Column:
    """Below the band's lower threshold in every array named, where snow is present."""
    low = {"diff": "thresh_lower_raw", "norm": "thresh_lower_norm"}
    return all_of([F.col(column_of(n)) < F.col(low[column_of(n)]) for n in names]) & F.col("sp")


def elevation_gain(names: Sequence[str]) -> Column:
    high = {"diff": "thresh_upper_raw", "norm": "thresh_upper_norm"}
    return all_of([F.col(column_of(n)) > F.col(high[column_of(n)]) for n in names]) & F.col("sp")


def tree(logic: str, side: str) -> Column:
    """The block flags combined as asked for, on cells with trees."""
    basin, elevation = F.col(f"flag_basin_{side}"), F.col(f"flag_elevation_{side}")
    both = {"or": basin | elevation, "and": basin & elevation, "basin": basin, "elevation": elevation}
    return both[logic] & (F.col("veg") > TREE_METRES)


@dataclass(frozen=True)
class Summary:
    """What flags need to know of the whole grid: one row of one aggregate."""

    height: int
    width: int
    low: int | None
    high: int | None
    low_sp: int | None
    spans: tuple[tuple, tuple]

    def edge(self, res: int) -> int | None:
        return None if self.low is None else self.low - self.low % res

    def edge_sp(self, res: int) -> int | None:
        return None if self.low_sp is None else self.low_sp - self.low_sp % res


def summarise(px: DataFrame, cfg: QCConfig) -> Summary:
    """Grid shape, elevation range and histogram range in one pass; one row reaches the driver."""
    inside = within(cfg.name, cfg.operator, cfg.value)
    x, y = (F.when(inside, F.col(column_of(n)).cast("double")) for n in cfg.histogram_mats)
    dem = lambda m: F.when(F.col(m), F.col("dem"))
    r = px.agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.min(dem("ok")).alias("lo"), F.max(dem("ok")).alias("hi"), F.min(dem("sp")).alias("lo_sp"),
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
    ).first()
    return Summary(r.h or 0, r.w or 0, r.lo, r.hi, r.lo_sp, ((r.x0, r.x1), (r.y0, r.y1)))


#: Up to so many bands, which the elevation range proves, thresholds are collected and broadcast.
COLLECTED_BANDS = 10_000
THRESHOLDS = ("thresh_upper_raw", "thresh_upper_norm", "thresh_lower_raw", "thresh_lower_norm", "median_raw")


def with_bands(px: DataFrame, cfg: QCConfig, known: Summary) -> tuple[DataFrame, int]:
    """Join each pixel's band thresholds, and the snowline."""
    res, edge = cfg.elevation_band_resolution, known.edge(cfg.elevation_band_resolution)
    if edge is None:
        raise ValueError("no pixel has data on both dates")
    banded = bands.with_band(px, "ok", res, edge=edge)
    stats = bands.band_stats(banded, cfg.outlier_percentiles)
    if (known.high - edge) // res < COLLECTED_BANDS:
        rows = stats.collect()
        line = bands.snowline_of(rows, edge, cfg.snowline_threshold, res, deeper(rows, cfg))
        table = F.broadcast(px.sparkSession.createDataFrame(rows, stats.schema))
    else:
        table = stats.persist(StorageLevel.MEMORY_AND_DISK)
        totals = table.agg(*(F.sum(F.col(c) * F.col("elevation_count")).alias(c) for c in ("mean_d1", "mean_d2")), F.lit(1).alias("elevation_count")).collect()
        line = bands.snowline(table, F.lit(edge), cfg.snowline_threshold, res, deeper(totals, cfg)).first().snowline
    return banded.join(table.select("band", *THRESHOLDS), "band", "left"), line


def with_flags(px: DataFrame, cfg: QCConfig, known: Summary, strategy: str = "dense") -> DataFrame:
    """Add every flag asked for, and ``median_elevation``, to a pixel table with basics.

    All windows of one call are counted together, so any set of block flags costs
    the two exchanges of one window.
    """
    flags = cfg.with_required_flags().flags
    if "histogram" in flags:
        px = with_histogram_flag(px, cfg, known)
    hits: dict[str, Column] = {}
    if {"basin_block", "elevation_block"} & set(flags):
        px, line = with_bands(px, cfg, known)
        px = px.withColumn("median_elevation", F.coalesce("median_raw", F.lit(0)))
        if "basin_block" in flags:
            hits["basin_loss"] = F.col("ok") & F.col("all_loss") & (F.col("dem") > line)
            hits["basin_gain"] = F.col("ok") & F.col("all_gain")
        if "elevation_block" in flags:
            hits["elevation_loss"] = F.coalesce(elevation_loss(cfg.elevation_loss), F.lit(False))
            hits["elevation_gain"] = F.coalesce(elevation_gain(cfg.elevation_gain), F.lit(False))
        px = px.withColumns({f"_hit_{n}": c for n, c in hits.items()})
        windowed = [n for n in hits if (cfg.apply_moving_window_basin if n.startswith("basin") else cfg.apply_moving_window_elevation)]
        if windowed:
            px = neighborhood.counts(px, {f"_near_{n}": F.col(f"_hit_{n}") for n in windowed}, cfg.block_window, strategy)
        made = {}
        for n in hits:
            hit = F.col(f"_hit_{n}")
            if n in windowed:
                near = neighborhood.crowded(f"_near_{n}", cfg.block_window, cfg.neighbor_threshold, F.lit(known.height), F.lit(known.width))
                # basin flags hold for any cell of complete loss or gain in the crowd unless strict
                own = F.col("all_loss" if n == "basin_loss" else "all_gain") if n.startswith("basin") and not cfg.strict else hit
                hit = near & own
            if n == "elevation_loss":
                hit = hit & ~(F.col("dem") < line)
            made[f"flag_{n}"] = F.coalesce(hit, F.lit(False))
        px = px.withColumns(made).drop(*(f"_hit_{n}" for n in hits), *(f"_near_{n}" for n in windowed))
    if "tree" in flags:
        px = px.withColumns({f"flag_tree_{side}": tree(logic, side) for side, logic in (("loss", cfg.tree_loss), ("gain", cfg.tree_gain))})
    if "zero_and_nan" in flags:
        px = px.withColumn("flag_zero_and_nan", F.col("zero_and_nan"))
    return px


def deeper(rows: list, cfg: QCConfig) -> str:
    """Which date's mean depth defines the snowline."""
    if cfg.snowline_source == "date2":
        return "mean_d2"
    total = lambda c: sum(r[c] * r["elevation_count"] for r in rows)
    return "mean_d1" if total("mean_d1") > total("mean_d2") else "mean_d2"


def with_histogram_flag(px: DataFrame, cfg: QCConfig, known: Summary) -> DataFrame:
    px = px.withColumn("conditional", within(cfg.name, cfg.operator, cfg.value))
    binned = histogram.with_bins(px, "conditional", cfg.histogram_mats, cfg.num_bins, known.spans)
    found = histogram.outlier_bins(histogram.histogram(binned), cfg.num_bins, cfg.histogram_window, cfg.threshold_histogram_space[0], cfg.min_bin_count)
    return histogram.with_flag(binned, found, cfg.num_bins)
