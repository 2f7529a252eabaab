"""Coverage and influence of each flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bands


def stats_report(px: DataFrame, flags: Sequence[str], res: int, edge: int | None = None) -> DataFrame:
    """``(flag, cell_count, pct_coverage, delta_pct)`` for each flag column.

    ``delta_pct`` is how much the summed difference changes, over pixels with snow,
    if flagged pixels get the median of the unflagged ones of their band.  One
    aggregate by band and one over all bands serve all flags: the adjusted sum of
    a band is its unflagged sum plus the number of flagged pixels times that median.
    """
    banded = bands.with_band(px, "sp", res, "band_sp", edge=edge)
    per_flag = []
    for f in flags:
        per_flag += [
            F.count_if(f).alias(f"{f}__cells"),
            F.count_if(F.col(f) & F.col("sp")).alias(f"{f}__in_sp"),
            F.sum(F.when(F.col("sp") & ~F.col(f), F.col("diff").cast("long"))).alias(f"{f}__rest"),
            F.expr(f"percentile(diff, 0.5D) FILTER (WHERE sp AND NOT {f})").alias(f"{f}__median"),
        ]
    by_band = banded.groupBy("band_sp").agg(F.count_if("sp").alias("n_sp"), F.sum(F.when(F.col("sp"), F.col("diff").cast("long"))).alias("sum_diff"), *per_flag)
    zero = F.lit(0).cast("long")
    sums = [F.sum("n_sp").alias("n_sp"), F.sum(F.coalesce("sum_diff", zero)).alias("sum_diff")]
    for f in flags:
        adjusted = F.coalesce(f"{f}__rest", zero) + F.col(f"{f}__in_sp") * F.coalesce(bands.whole(F.col(f"{f}__median")).cast("long"), zero)
        sums += [F.sum(f"{f}__cells").alias(f"{f}__cells"), F.sum(F.when(F.col("band_sp").isNotNull(), adjusted)).alias(f"{f}__adjusted")]
    total = by_band.agg(*sums)
    rows = F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f"{f}__cells").alias("cell_count"), F.coalesce(F.col(f"{f}__adjusted"), zero).alias("adjusted")) for f in flags))
    one = lambda x: F.rint(x * 10) / 10
    return total.select("n_sp", "sum_diff", F.inline(rows)).select(
        "flag",
        "cell_count",
        F.when(F.col("n_sp") > 0, one(F.col("cell_count") / F.col("n_sp") * 100)).alias("pct_coverage"),
        F.when(F.col("sum_diff") != 0, one(100 * ((F.col("sum_diff") - F.col("adjusted")) / F.col("sum_diff")))).alias("delta_pct"),
    )


def band_table(stats: DataFrame, edge, res: int) -> DataFrame:
    """The thresholds of each band with its elevation, rounded to two decimals."""
    two = lambda c: (F.rint(F.col(c) * 100) / 100).alias(c)
    return stats.select(
        (edge + F.col("band") * res).cast("int").alias("elevation"), "thresh_upper_raw", two("thresh_upper_norm"),
        "thresh_lower_raw", two("thresh_lower_norm"), "median_raw", "elevation_count",
    )


def format_report(report: DataFrame) -> str:
    """The report as a text table; it has one row per flag."""
    head = ("flag", "cell count", "percent coverage", "delta")
    rows = [(r.flag, str(r.cell_count), f"{r.pct_coverage}%", f"{r.delta_pct}%") for r in report.collect()]
    wide = [max(len(x[i]) for x in [head, *rows]) for i in range(4)]
    line = lambda r: "| " + " | ".join(c.ljust(w) if i % 2 == 0 and i < 2 else c.rjust(w) for i, (c, w) in enumerate(zip(r, wide))) + " |"
    return "\n".join([line(head), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, rows)])
