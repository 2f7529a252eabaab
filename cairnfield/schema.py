"""Names and types of the pixel relation."""

from __future__ import annotations

from pyspark.sql import types as T

PIXELS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("row", "col", "d1", "d2", "dem", "veg")])
LAYER = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "value")])
HEADER = T.StructType(
    [T.StructField("layer", T.StringType()), T.StructField("acq_date", T.DateType())]
    + [T.StructField(n, T.DoubleType()) for n in ("left", "bottom", "right", "top", "rez")]
    + [T.StructField(n, T.IntegerType()) for n in ("width", "height", "epsg")]
    + [T.StructField("nodata", T.DoubleType())]
)

#: Names in settings and the pixel columns that they stand for.
COLUMNS = {"date1": "d1", "date2": "d2", "difference": "diff", "difference_normalized": "norm", "median_elevation": "median_elevation"}


def column_of(name: str) -> str:
    """The pixel column of a configured name; other names pass through."""
    return COLUMNS.get(name, name)


def translate(names: list[str], table: dict[str, str]) -> list[str]:
    return [table.get(n, n) for n in names]


def output_names(date1: str, date2: str) -> dict[str, str]:
    """Names of arrays in outputs, by configured name."""
    return {"date1": f"depth_{date1}", "date2": f"depth_{date2}", "difference": "difference", "difference_normalized": "difference_normalized", "median_elevation": "median_diff_elev"}
