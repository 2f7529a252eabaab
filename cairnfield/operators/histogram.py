"""Two-dimensional histogram, its sparse regions, and the pixels in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import column_of


def bin_of(v: Column, low: Column | float, high: Column | float, n: int) -> Column:
    """Equal-width bin of the data's range, the last one closed."""
    low, high = (x if isinstance(x, Column) else F.lit(x).cast("double") for x in (low, high))
    wide = F.when(high > low, F.floor((v - low) / (high - low) * n)).otherwise(F.lit(n // 2))
    return F.least(wide, F.lit(n - 1)).cast("int")


def with_bins(px: DataFrame, mask: str, names: Sequence[str], num_bins: Sequence[int], spans: Sequence[tuple] | None = None) -> DataFrame:
    """Add ``bx`` and ``by``, null outside the mask; known spans save scalar aggregates."""
    cols = [F.col(column_of(n)).cast("double") for n in names]
    if spans is None:
        inside = px.where(F.col(mask))
        spans = [(inside.agg(F.min(c)).scalar(), inside.agg(F.max(c)).scalar()) for c in cols]
    out = {}
    for name, c, n, (low, high) in zip(("bx", "by"), cols, num_bins, spans):
        out[name] = F.when(F.col(mask), bin_of(c, low, high, n))
    return px.withColumns(out)


def histogram(binned: DataFrame) -> DataFrame:
    """``(bx, by, cnt)`` of the occupied bins."""
    return binned.where("bx is not null").groupBy("bx", "by").agg(F.count("*").alias("cnt"))


def reach(size: int) -> int:
    return (size + 1) // 2 - 1


def occupied_share(bins: DataFrame, num_bins: Sequence[int], size: int) -> DataFrame:
    """``(bx, by, cnt, occupied, cells, pct)``: the share of occupied bins in windows cut at the edges."""
    k = reach(size)
    span = F.sequence(F.lit(-k), F.lit(k))
    sent = bins.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
    seen = sent.groupBy((F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by")).agg(F.count("*").alias("occupied"))
    side = lambda c, n: F.least(F.col(c) + k, F.lit(n - 1)) - F.greatest(F.col(c) - k, F.lit(0)) + 1
    cells = side("bx", num_bins[0]) * side("by", num_bins[1])
    return bins.join(seen, ["bx", "by"]).withColumn("cells", cells).withColumn("pct", F.col("occupied") / F.col("cells"))


def outlier_bins(bins: DataFrame, num_bins: Sequence[int], size: int, threshold: float, min_count: int = 0) -> DataFrame:
    """The occupied bins in sparse surroundings; ``min_count`` can also ask for a bin's own count."""
    out = occupied_share(bins, num_bins, size).where(F.col("pct") < threshold)
    return out.where(F.col("cnt") >= min_count) if min_count else out


#: Histograms of up to so many bins may be broadcast: their rows are bounded by the settings.
BROADCAST_BINS = 250_000


def with_flag(binned: DataFrame, outliers: DataFrame, num_bins: Sequence[int], name: str = "flag_histogram") -> DataFrame:
    """Mark pixels whose bin is an outlier.

    The settings bound the outliers by the number of bins (12,000 by default);
    under BROADCAST_BINS they are broadcast, else joined by key.
    """
    marks = outliers.select("bx", "by", F.lit(True).alias(name))
    if num_bins[0] * num_bins[1] <= BROADCAST_BINS:
        marks = F.broadcast(marks)
    return binned.join(marks, ["bx", "by"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
