"""Outputs: wide and long flags, masked arrays, band tables, settings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NODATA, QCConfig, config_json, flag_columns, format_config
from . import raster

FLAG_NODATA = 255


def flags_wide(px: DataFrame, flags: Sequence[str], masks: Sequence[str] = ()) -> DataFrame:
    """One boolean per flag and per mask; ``mask_overlap_nan`` is true where data are missing."""
    m = {"overlap_nan": ~F.col("ok")}
    return px.select("row", "col", *flags, *(m[x].alias(f"mask_{x}") for x in masks))


def flags_long(px: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row per pixel and flag that holds."""
    return px.select("row", "col", *flags).unpivot(["row", "col"], list(flags), "flag", "value").where("value").drop("value")


def flag_codes(px: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Flags as 0 and 1, no data where a cell lies outside the clipped grid."""
    return px.select("row", "col", *(F.coalesce(F.col(f).cast("int"), F.lit(FLAG_NODATA)).alias(f) for f in flags))


def arrays_masked(px: DataFrame, names: Sequence[str] = ("difference", "difference_normalized", "date1", "date2", "median_elevation")) -> DataFrame:
    """Arrays with null for no data: changes only where snow is present."""
    made = {
        "difference": F.when(F.col("sp"), F.col("diff")), "difference_normalized": F.when(F.col("sp"), F.col("norm")),
        "date1": F.nullif(F.col("d1"), F.lit(NODATA)), "date2": F.nullif(F.col("d2"), F.lit(NODATA)),
    }
    if "median_elevation" in names:
        made["median_elevation"] = F.when(F.col("sp"), F.col("median_elevation"))
    return px.select("row", "col", *(made[n].alias(n) for n in names))


def with_nodata(arrays: DataFrame) -> DataFrame:
    """Nulls as the no-data value, for sinks that know no null."""
    return arrays.select("row", "col", *(F.coalesce(F.col(c).cast("float"), F.lit(float(NODATA)).cast("float")).alias(c) for c in arrays.columns if c not in ("row", "col")))


def save(px: DataFrame, cfg: QCConfig, folder: str, overwrite: bool = False) -> None:
    """Write flags and arrays as Parquet and the settings as INI and JSON text beside them.

    Rows are written in ranges of grid rows, so that later reads of an extent skip files.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    laid = px.repartitionByRange("row")
    flags_wide(laid, flag_columns(cfg.with_required_flags().flags), cfg.include_masks).write.mode(mode).parquet(f"{folder}/flags")
    if cfg.include_arrays:
        arrays_masked(laid, cfg.include_arrays).write.mode(mode).parquet(f"{folder}/arrays")
    spark = px.sparkSession
    for name, text in (("config_ini", format_config(cfg)), ("config_json", config_json(cfg))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/{name}")


def save_bands(table: DataFrame, path: str, overwrite: bool = False) -> None:
    """The band table as one CSV; it has a row per band."""
    table.orderBy("elevation").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


@dataclass(frozen=True)
class Frame:
    """The grid that rasters are written in, and where the clipped grid's first cell lies in it."""

    left: float
    top: float
    rez: float
    height: int
    width: int
    row: int = 0
    col: int = 0


def save_rasters(cells: DataFrame, folder: str, name: str, frame: Frame, nodata: float, dtype: str) -> DataFrame:
    """Write the columns beside ``row`` and ``col`` as bands of GeoTIFF tiles, padded to the whole frame.

    Each tile is a stripe of grid rows, written by the task that holds it to a folder
    that all executors share; a tile without cells is written too, so that the tiles
    cover the frame.  A tile is written under another name first, so a task that is
    run again leaves whole files only.  Returns ``(path, top, height)`` of the tiles.
    """
    bands = [c for c in cells.columns if c not in ("row", "col")]
    stripes = -(-frame.height // raster.STRIPE)
    moved = cells.select((F.col("row") + frame.row).alias("row"), (F.col("col") + frame.col).alias("col"), *(F.col(c).cast("double").alias(c) for c in bands))
    moved = moved.where(F.col("row").between(0, frame.height - 1) & F.col("col").between(0, frame.width - 1)).withColumn("stripe", F.floor(F.col("row") / raster.STRIPE))
    none = cells.sparkSession.range(stripes).select(F.lit(-1).alias("row"), F.lit(-1).alias("col"), *(F.lit(None).cast("double").alias(c) for c in bands), F.col("id").alias("stripe"))

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stripe, pdf in _runs(it, "stripe"):
            first = stripe * raster.STRIPE
            h = min(raster.STRIPE, frame.height - first)
            held = np.full((len(bands), h, frame.width), nodata, dtype)
            for part in pdf:
                part = part[part["row"] >= 0]
                for k, c in enumerate(bands):
                    held[k, part["row"].to_numpy() - first, part["col"].to_numpy()] = part[c].fillna(nodata).to_numpy().astype(dtype)
            top = frame.top - first * frame.rez
            fs, at = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))
            fs.create_dir(at)
            path = f"{at}/{name}_{stripe:06d}.tif"
            with fs.open_output_stream(f"{path}.part") as f:
                f.write(raster.encode_tiff(held, frame.left, top, frame.rez, nodata))
            fs.move(f"{path}.part", path)
            yield pd.DataFrame({"path": [path], "top": [top], "height": [h]})

    laid = moved.unionByName(none).repartition(max(1, min(stripes, 10_000)), "stripe").sortWithinPartitions("stripe")
    made = laid.mapInPandas(write, "path string, top double, height long").collect()  # a row per stripe
    return cells.sparkSession.createDataFrame(made, "path string, top double, height long")


def _runs(it: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, list[pd.DataFrame]]]:
    """Sorted rows by key; a stripe's cells are held together, other rows pass through."""
    last, held = None, []
    for pdf in it:
        for k, part in pdf.groupby(key, sort=True):
            if held and k != last:
                yield int(last), held
                held = []
            last = k
            held.append(part)
    if held:
        yield int(last), held


def save_flag_rasters(px: DataFrame, cfg: QCConfig, folder: str, name: str, frame: Frame) -> tuple[DataFrame, DataFrame | None]:
    """Flags as bytes with 255 for no data, and the arrays asked for as floats, in the original extent."""
    flags = flag_columns(cfg.with_required_flags().flags)
    out = save_rasters(flag_codes(px, flags), folder, f"{name}_flags", frame, FLAG_NODATA, "uint8")
    if not cfg.include_arrays:
        return out, None
    return out, save_rasters(with_nodata(arrays_masked(px, cfg.include_arrays)), folder, f"{name}_arrays", frame, NODATA, "float32")
