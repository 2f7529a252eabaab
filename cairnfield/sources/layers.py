"""From layer files to one aligned pixel table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NODATA, QCConfig
from ..functions import to_cm
from ..operators import align
from . import raster, sinks


def headers(spark: SparkSession, cfg: QCConfig) -> DataFrame:
    """One header row per layer."""
    rows = [
        raster.read_header(spark, cfg.file_path_in_date1, "date1"), raster.read_header(spark, cfg.file_path_in_date2, "date2"),
        raster.read_header(spark, cfg.file_path_topo, "dem", "dem"), raster.read_header(spark, cfg.file_path_topo, "veg", "veg_height"),
    ]
    return reduce(DataFrame.unionByName, rows)


def aligned(spark: SparkSession, cfg: QCConfig) -> DataFrame:
    """``(row, col, d1, d2, dem, veg)`` over the common extent, depths in whole centimetres.

    Four header rows decide the extent.  Cells are then keyed by arithmetic,
    filtered to the extent before any join, and joined on their keys; topography
    of another resolution is looked up at the centres of the target's cells.
    """
    head = headers(spark, cfg)
    checked = align.check_resolution(head).first()
    box = align.common_extent(align.shifted(head)).first()
    rez = float(round(box.rez))
    left, top, right, bottom = (F.lit(float(getattr(box, s))) for s in ("left", "top", "right", "bottom"))

    def keyed(points: DataFrame, step: float) -> DataFrame:
        return align.grid_keys(points, left, top, F.lit(step), right, bottom)

    depth = [keyed(raster.read_raster(spark, p).withColumn("value", to_cm(F.col("value"), cfg.round_mode)), rez) for p in (cfg.file_path_in_date1, cfg.file_path_in_date2)]
    topo = []
    for name in ("dem", "veg_height"):
        points = raster.read_raster(spark, cfg.file_path_topo, name).withColumn("value", F.coalesce("value", F.lit(float(NODATA))))
        if checked.topo_same:
            topo.append(keyed(points, rez))
        else:
            step = float(round(head.where("layer = 'dem'").first().rez))
            topo.append(align.resample_nearest(depth[0].select("row", "col"), keyed(points, step), F.lit(rez / step)).select("row", "col", "value"))
    return align.coregister(depth[0], depth[1], topo[0], topo[1])


def frame_of(spark: SparkSession, cfg: QCConfig) -> sinks.Frame:
    """The second depth layer's grid, and the place of the common extent in it: outputs have its original extent."""
    head = headers(spark, cfg)
    box = align.common_extent(align.shifted(head)).first()
    own = align.original_shape(align.snapped(head.where("layer = 'date2'"))).first()
    rez = float(round(box.rez))
    return sinks.Frame(own.left, own.top, rez, own.height, own.width, round((own.top - box.top) / rez), round((box.left - own.left) / rez))
