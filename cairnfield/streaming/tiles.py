"""Checks of pixels as they arrive.

An extension: a survey may come in as tiles over days.  Masks need nothing but
the pixel itself and run on the stream; counts by elevation band are a stateful
aggregate with a watermark on the arrival time, so late tiles are still counted
and old windows are let go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import with_basics


def masked(stream: DataFrame) -> DataFrame:
    """Basics of arriving pixels; no state."""
    return with_basics(stream)


def band_counts(stream: DataFrame, res: int = 50, arrived: str = "arrived", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Valid, lost and gained pixels by arrival window and absolute elevation band."""
    px = with_basics(stream.withWatermark(arrived, late))
    return px.groupBy(F.window(arrived, window), (F.floor(F.col("dem") / res) * res).cast("int").alias("elevation")).agg(
        F.count_if("ok").alias("n_ok"), F.count_if("all_loss").alias("n_loss"), F.count_if("all_gain").alias("n_gain"), F.count_if("zero_and_nan").alias("n_zero_and_nan"))
