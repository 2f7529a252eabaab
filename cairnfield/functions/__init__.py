"""Scalar expressions over pixel columns; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NODATA
from ..schema import column_of

#: Smallest denominator of the normalised difference, in centimetres.
FLOOR_CM = 25


def to_cm(depth: Column, mode: str = "truncate") -> Column:
    """Metres to whole centimetres; NaN and null become no data.

    ``truncate`` cuts what rounding to two decimals left below a whole
    centimetre, which loses one for some values; ``nearest`` does not.
    """
    missing = depth.isNull() | F.isnan(depth.cast("double")) | (depth == NODATA)
    rounded = F.rint(depth.cast("double") * 100)
    cm = rounded if mode == "nearest" else rounded / 100 * 100
    return F.when(missing, F.lit(NODATA)).otherwise(cm.cast("int"))


def to_cm_float(depth: Column) -> Column:
    """As ``to_cm`` in truncating mode, with the steps of single precision."""
    missing = depth.isNull() | F.isnan(depth) | (depth == NODATA)
    step = (F.rint(depth.cast("float") * F.lit(100).cast("float")).cast("float") / F.lit(100).cast("float")).cast("float")
    return F.when(missing, F.lit(NODATA)).otherwise((step * F.lit(100).cast("float")).cast("float").cast("int"))


def difference() -> Column:
    return F.col("d2") - F.col("d1")


def all_loss() -> Column:
    """Depth on the first date and none on the second; true for no data on the first."""
    return (F.abs("d1") > 0) & (F.abs("d2") == 0)


def all_gain() -> Column:
    return (F.abs("d1") == 0) & (F.abs("d2") > 0)


def valid() -> Column:
    """Data on both dates."""
    return (F.col("d1") != NODATA) & (F.col("d2") != NODATA)


def zero_and_nan() -> Column:
    return ((F.col("d1") == NODATA) & (F.col("d2") == 0)) | ((F.col("d1") == 0) & (F.col("d2") == NODATA))


def snow_present() -> Column:
    """Valid, with depth on at least one date."""
    return ~((F.col("d1") == 0) & (F.col("d2") == 0)) & valid()


def denominator() -> Column:
    return F.when(~all_loss() & (F.col("d1") < FLOOR_CM), FLOOR_CM).otherwise(F.col("d1"))


def round2(x: Column) -> Column:
    """Two decimals, halves to even, as ``rint(100 x) / 100``."""
    return F.rint(x * 100) / 100


def normalised() -> Column:
    return round2(difference().cast("double") / denominator())


def compare(column: Column, operator: str, value: float) -> Column:
    return column < value if operator == "less_than" else column > value


def within(names: Sequence[str], operators: Sequence[str], values: Sequence[float]) -> Column:
    """All comparisons, two for each named array, on valid pixels."""
    out = valid()
    for k, (op, value) in enumerate(zip(operators, values)):
        out = out & compare(F.col(column_of(names[k // 2])), op, value)
    return out


def snap(coord: Column, rez: Column) -> Column:
    """The nearest multiple of the rounded resolution; halves go down.

    Remainders are floored, also for negative coordinates.
    """
    step = F.rint(rez)
    m = F.pmod(F.rint(coord), step)
    rest = coord - F.floor(coord / step) * step
    return F.when(m == 0, coord).when(m > 0.5 * rez, coord + (step - rest)).otherwise(coord - rest)


def half_pixel(bound: Column, rez: Column, side: str) -> Column:
    """Outer bounds to pixel positions: left and bottom move up by half a pixel, right and top down."""
    return bound + rez / 2 if side in ("left", "bottom") else bound - rez / 2


def with_basics(px):
    """Differences and masks, each computed once, as columns of the pixel table."""
    px = px.withColumns({"ok": valid(), "sp": snow_present(), "all_loss": all_loss(), "all_gain": all_gain(), "zero_and_nan": zero_and_nan(), "diff": difference()})
    return px.withColumn("norm", normalised())
