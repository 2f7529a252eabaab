"""The whole check of a pixel table, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import QCConfig, flag_columns
from ..functions import with_basics
from ..operators import bands, histogram, report
from ..operators import flags as flag_ops
from ..sources import sinks


@dataclass
class QCResult:
    """Frames of one run, computed when they are used; ``known`` is the summary that their plans are made with."""

    pixels: DataFrame
    cfg: QCConfig
    flags: list[str]
    known: flag_ops.Summary

    def wide(self) -> DataFrame:
        return sinks.flags_wide(self.pixels, self.flags, self.cfg.include_masks)

    def long(self) -> DataFrame:
        return sinks.flags_long(self.pixels, self.flags)

    def arrays(self) -> DataFrame:
        return sinks.arrays_masked(self.pixels, self.cfg.include_arrays)

    def report(self) -> DataFrame:
        res = self.cfg.elevation_band_resolution
        return report.stats_report(self.pixels, self.flags, res, self.known.edge_sp(res))

    def band_table(self) -> DataFrame:
        res = self.cfg.elevation_band_resolution
        edge = self.known.edge(res)
        stats = bands.band_stats(bands.with_band(self.pixels, "ok", res, "_b", edge=edge), self.cfg.outlier_percentiles, "_b")
        return report.band_table(stats, F.lit(edge), res)

    def histogram(self) -> DataFrame:
        """Bins with their counts and whether they are outliers, for plots: bounded by the settings."""
        binned = histogram.with_bins(self.pixels.select("conditional", "d1", "d2", "diff", "norm"), "conditional", self.cfg.histogram_mats, self.cfg.num_bins, self.known.spans)
        share = histogram.occupied_share(histogram.histogram(binned), self.cfg.num_bins, self.cfg.histogram_window)
        return share.select("bx", "by", "cnt", (F.col("pct") < self.cfg.threshold_histogram_space[0]).alias("outlier"))

    def save(self, folder: str, overwrite: bool = False) -> None:
        sinks.save(self.pixels, self.cfg, folder, overwrite)
        if {"basin_block", "elevation_block"} & set(self.cfg.with_required_flags().flags):
            sinks.save_bands(self.band_table(), f"{folder}/bands", overwrite)


def run_qc(px: DataFrame, cfg: QCConfig | None = None, strategy: str = "dense", keep: bool = True) -> QCResult:
    """Flags of a pixel table.

    Two small results are needed before the flags can be planned: a one-row
    summary of the grid and, for block flags, the table of bands.  ``keep`` holds
    the basics in memory and on disk meanwhile, so that the input is read once.
    """
    cfg = (cfg or QCConfig()).with_required_flags()
    basics = with_basics(px)
    if keep:
        basics = basics.persist(StorageLevel.MEMORY_AND_DISK)
    known = flag_ops.summarise(basics, cfg)
    return QCResult(flag_ops.with_flags(basics, cfg, known, strategy), cfg, flag_columns(cfg.flags), known)
