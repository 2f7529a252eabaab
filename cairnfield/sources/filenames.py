"""What names of survey files tell, and names of outputs."""

from __future__ import annotations

import os
import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEM = r"([^/_]*)(\d{8})_[^/]*$"


def basin_of(path: Column) -> Column:
    return F.regexp_extract(path, STEM, 1)


def date_of(path: Column) -> Column:
    """The acquisition date: the eight digits before the first underscore of the name."""
    return F.to_date(F.regexp_extract(path, STEM, 2), "yyyyMMdd")


def parse_name(path: str) -> tuple[str, date]:
    stem = os.path.basename(path).split("_")[0]
    return stem[:-8], datetime.strptime(stem[-8:], "%Y%m%d").date()


def check_order(first: str, second: str) -> tuple[date, date]:
    """Both dates; an error unless the first is earlier."""
    a, b = parse_name(first)[1], parse_name(second)[1]
    if a >= b:
        raise ValueError(f"date1 ({a}) must be before date2 ({b})")
    return a, b


def with_order_check(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """The same inside a plan: a row out of order fails the query."""
    bad = date_of(F.col(first)) >= date_of(F.col(second))
    return pairs.withColumn(first, F.when(bad, F.raise_error(F.lit("date1 must be before date2"))).otherwise(F.col(first)))


def clipped_names(first: str, second: str, folder: str = "") -> tuple[str, str]:
    """Names of the two clipped layers; the date starts at the first ``2`` of a name."""
    a, b = (re.sub(r"\.[^.]*$", "", os.path.basename(p)) for p in (first, second))
    at = a.index("2")
    name = lambda x, y: os.path.join(folder, f"{x[: at + 8]}_clipped_to_{y[at:]}.tif")
    return name(a, b), name(b, a)


def clip_state(first: str, second: str) -> str:
    """``clip`` for original layers, ``reuse`` for two clipped ones; a mixture is an error."""
    n = sum("clipped_to" in os.path.basename(p) for p in (first, second))
    if n == 1:
        raise ValueError("one layer is clipped and the other is not")
    return "reuse" if n else "clip"


def output_folder(root: str, first: str, second: str, basin: str | None = None) -> str:
    (abbr, a), (_, b) = parse_name(first), parse_name(second)
    return os.path.join(root, basin or abbr, f"{a:%Y%m%d}_{b:%Y%m%d}")


def output_name(root: str, first: str, second: str, kind: str, modifier: str = "diff", basin: str | None = None) -> str:
    (abbr, a), (_, b) = parse_name(first), parse_name(second)
    return os.path.join(output_folder(root, first, second, basin), f"{abbr}{a:%Y%m%d}_{b:%Y%m%d}_{modifier}_{kind}")
