"""One query per operator over the derived pixel grid, each with SQL that must give the same rows.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` maps it to
SQL for DuckDB.  The SQL is written on its own, from the semantics, as one chain of
named steps that each query selects from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .config import QCConfig
from .operators import align, bands, histogram, neighborhood, report
from .operators import flags as flag_ops
from .plans.qc import run_qc
from .sources import filenames, pixels, sinks

CFG = QCConfig()
RES = CFG.elevation_band_resolution
BLOCKS = QCConfig(flags=("basin_block", "elevation_block", "tree"))
#: Percentiles that flag the extremes; the defaults name the fifth as the upper one.
SPREAD = (95, 80, 10, 10)

CHAIN = """
WITH g AS (SELECT CAST(FLOOR(SQRT(COUNT(*) / 6.0)) AS INT) AS s FROM lineitem),
n AS (SELECT CAST(COUNT(*) AS INT) AS n FROM part),
o AS (SELECT CAST(l_partkey % s AS INT) AS r, CAST(l_orderkey % s AS INT) AS c,
      CASE WHEN CAST(l_shipdate AS DATE) < DATE '1998-06-01' THEN 1 ELSE 2 END AS d,
      CAST(SUM(CAST(l_quantity AS INT)) AS INT) AS q FROM lineitem CROSS JOIN g GROUP BY 1, 2, 3),
ax AS (SELECT CAST(p_partkey AS INT) AS i FROM part CROSS JOIN g WHERE p_partkey < s),
grid AS (SELECT a.i AS r, b.i AS c, s, n FROM ax a CROSS JOIN ax b CROSS JOIN g CROSS JOIN n),
px AS (SELECT grid.r AS row, grid.c AS col,
 CAST(CASE WHEN o1.q IS NULL THEN -9999
      WHEN grid.r BETWEEN FLOOR(s*0.6) AND FLOOR(s*0.7) AND grid.c BETWEEN FLOOR(s*0.6) AND FLOOR(s*0.7) THEN 0
      ELSE GREATEST(0, o1.q*10 - 1600 + CAST(FLOOR(grid.r*1500 / s) AS INT)) END AS INT) AS d1,
 CAST(CASE WHEN o2.q IS NULL THEN -9999
      WHEN grid.r BETWEEN FLOOR(s*0.7) AND FLOOR(s*0.8) AND grid.c BETWEEN FLOOR(s*0.2) AND FLOOR(s*0.3) THEN 0
      ELSE GREATEST(0, o2.q*10 - 1600 + CAST(FLOOR(grid.r*1500 / s) AS INT)) END AS INT) AS d2,
 CAST(1800 + CAST(FLOOR(grid.r*1000 / s) AS INT) + (grid.c*7) % 50 AS INT) AS dem,
 CAST(p.p_size % 12 AS INT) AS veg
FROM grid
LEFT JOIN o o1 ON o1.r = grid.r AND o1.c = grid.c AND o1.d = 1
LEFT JOIN o o2 ON o2.r = grid.r AND o2.c = grid.c AND o2.d = 2
JOIN part p ON p.p_partkey = (grid.r*s + grid.c) % n),
m0 AS (SELECT *, (d1 <> -9999 AND d2 <> -9999) AS ok, (d1 <> 0 AND d2 = 0) AS all_loss, (d1 = 0 AND d2 <> 0) AS all_gain,
  ((d1 = -9999 AND d2 = 0) OR (d1 = 0 AND d2 = -9999)) AS zero_and_nan,
  (NOT (d1 = 0 AND d2 = 0) AND d1 <> -9999 AND d2 <> -9999) AS sp, d2 - d1 AS diff FROM px),
m1 AS (SELECT *, ROUND_EVEN(CAST(diff AS DOUBLE) / (CASE WHEN NOT all_loss AND d1 < 25 THEN 25 ELSE d1 END) * 100, 0) / 100 AS norm FROM m0),
m AS (SELECT *, (d1 < 1700 AND d1 > -0.01 AND norm < 10 AND norm > -1.01 AND ok) AS conditional FROM m1),
hw AS (SELECT MAX(row) + 1 AS h, MAX(col) + 1 AS w FROM px),
ed AS (SELECT MIN(dem) - MIN(dem) % 50 AS e FROM m WHERE ok),
es AS (SELECT MIN(dem) - MIN(dem) % 50 AS e FROM m WHERE sp),
b AS (SELECT m.*, CASE WHEN ok THEN CAST(FLOOR((dem - ed.e) / 50.0) AS INT) END AS band,
  CASE WHEN sp THEN CAST(FLOOR((dem - es.e) / 50.0) AS INT) END AS band_sp FROM m CROSS JOIN ed CROSS JOIN es),
st AS (SELECT band, COUNT(*) AS elevation_count, AVG(d1) AS mean_d1, AVG(d2) AS mean_d2,
  {STATS}
  CAST(TRUNC(ROUND(QUANTILE_CONT(CAST(diff AS DOUBLE), 0.5), 6)) AS INT) AS median_raw FROM b WHERE band IS NOT NULL GROUP BY band),
sl0 AS (SELECT mean_d2, ROW_NUMBER() OVER (ORDER BY band) - 1 AS place FROM st),
sl AS (SELECT CAST(MIN(ed.e) + MIN(place) * 50 AS INT) AS snowline FROM sl0 CROSS JOIN ed WHERE mean_d2 > 40),
t AS (SELECT b.*, st.thresh_upper_raw, st.thresh_upper_norm, st.thresh_lower_raw, st.thresh_lower_norm, COALESCE(st.median_raw, 0) AS median_elevation, sl.snowline
  FROM b LEFT JOIN st ON st.band = b.band CROSS JOIN sl),
h AS (SELECT t.*, (ok AND all_loss AND dem > snowline) AS bl, (ok AND all_gain) AS bg,
  COALESCE(diff < thresh_lower_raw AND sp, FALSE) AS el, COALESCE(diff > thresh_upper_raw AND norm > thresh_upper_norm AND sp, FALSE) AS eg FROM t),
w AS (SELECT a.row, a.col, COUNT(*) FILTER (WHERE z.bl) AS nbl, COUNT(*) FILTER (WHERE z.bg) AS nbg, COUNT(*) FILTER (WHERE z.el) AS nel, COUNT(*) FILTER (WHERE z.eg) AS neg
  FROM h z CROSS JOIN (SELECT UNNEST(RANGE(-2, 3)) AS dr) x CROSS JOIN (SELECT UNNEST(RANGE(-2, 3)) AS dc) y
  JOIN px a ON a.row = z.row + dr AND a.col = z.col + dc WHERE z.bl OR z.bg OR z.el OR z.eg GROUP BY 1, 2),
hn AS (SELECT h.*, (h.row BETWEEN 2 AND hw.h - 3 AND h.col BETWEEN 2 AND hw.w - 3) AS inside,
  COALESCE(nbl, 0) AS nbl, COALESCE(nbg, 0) AS nbg, COALESCE(nel, 0) AS nel, COALESCE(neg, 0) AS neg
  FROM h LEFT JOIN w ON w.row = h.row AND w.col = h.col CROSS JOIN hw),
cr AS (SELECT MIN(d1)::DOUBLE AS x0, MAX(d1)::DOUBLE AS x1, MIN(norm) AS y0, MAX(norm) AS y1 FROM m WHERE conditional),
pb AS (SELECT m.*, CASE WHEN conditional THEN CAST(LEAST(FLOOR((d1 - x0) / (x1 - x0) * 60), 59) AS INT) END AS bx,
  CASE WHEN conditional THEN CAST(LEAST(FLOOR((norm - y0) / (y1 - y0) * 200), 199) AS INT) END AS by_ FROM m CROSS JOIN cr),
hist AS (SELECT bx, by_ AS by, COUNT(*) AS cnt FROM pb WHERE conditional GROUP BY 1, 2),
share AS (SELECT p.bx, p.by, ANY_VALUE(p.cnt) AS cnt, COUNT(*) AS occupied,
  (LEAST(p.bx + 1, 59) - GREATEST(p.bx - 1, 0) + 1) * (LEAST(p.by + 1, 199) - GREATEST(p.by - 1, 0) + 1) AS cells
  FROM hist p JOIN hist q ON q.bx BETWEEN p.bx - 1 AND p.bx + 1 AND q.by BETWEEN p.by - 1 AND p.by + 1 GROUP BY p.bx, p.by),
outl AS (SELECT * EXCLUDE (occupied, cells) FROM share WHERE CAST(occupied AS DOUBLE) / cells < 0.45),
f AS (SELECT hn.*, (o2.bx IS NOT NULL) AS flag_histogram, zero_and_nan AS flag_zero_and_nan,
  (inside AND nbl > 5 AND all_loss) AS flag_basin_loss, (inside AND nbg > 5 AND all_gain) AS flag_basin_gain,
  (inside AND nel > 5 AND el AND NOT dem < snowline) AS flag_elevation_loss, (inside AND neg > 5 AND eg) AS flag_elevation_gain
  FROM hn LEFT JOIN (SELECT pb.row AS r, pb.col AS c, outl.bx FROM pb JOIN outl ON pb.bx = outl.bx AND pb.by_ = outl.by) o2 ON o2.r = hn.row AND o2.c = hn.col),
ff AS (SELECT *, ((flag_basin_loss OR flag_elevation_loss) AND veg > 5) AS flag_tree_loss, ((flag_basin_gain OR flag_elevation_gain) AND veg > 5) AS flag_tree_gain FROM f)
"""


def chain(percentiles: tuple[int, int, int, int] = CFG.outlier_percentiles) -> str:
    a, b, c, d = (p / 100 for p in percentiles)
    raw = lambda p, n: f"CAST(TRUNC(ROUND(QUANTILE_CONT(CAST(diff AS DOUBLE), {p}), 6)) AS INT) AS {n},"
    rel = lambda p, n: f"QUANTILE_CONT(norm, {p}) AS {n},"
    return CHAIN.replace("{STATS}", " ".join((raw(a, "thresh_upper_raw"), rel(b, "thresh_upper_norm"), raw(c, "thresh_lower_raw"), rel(d, "thresh_lower_norm"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, percentiles: tuple[int, int, int, int] | None = None):
    """Register a query with the last steps of its SQL; SQL that starts with WITH stands alone."""

    def put(f):
        QUERIES[name] = f
        alone = sql.lstrip().upper().startswith("WITH")
        ORACLES[name] = sql if alone else (chain(percentiles) if percentiles else chain()) + sql
        return f

    return put


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel grid, held in memory and on disk: one plan, so one copy for all queries of a session."""
    return pixels.derived(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)


def basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.with_basics(grid(spark, sf_dir))


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.with_band(basics(spark, sf_dir), "ok", RES)


def stats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.band_stats(banded(spark, sf_dir), CFG.outlier_percentiles)


def qc(spark: SparkSession, sf_dir: str, **change) -> DataFrame:
    return run_qc(grid(spark, sf_dir), replace(CFG, **change), keep=False).pixels


def cells(df: DataFrame, *cols: str | Column) -> DataFrame:
    return df.select("row", "col", *cols)


# ---- sources and alignment


@query("grid_fixture", "SELECT * FROM px")
def grid_fixture(spark, sf_dir):
    return grid(spark, sf_dir)


def _paths(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", F.concat(F.lit("/data/survey/"), F.lower(F.substring("o_orderpriority", 3, 4)), F.lit("basin"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_depth_50m.tif")).alias("path"))


@query("filename_metadata", """
WITH p AS (SELECT o_orderkey, '/data/survey/' || LOWER(SUBSTR(o_orderpriority, 3, 4)) || 'basin' || STRFTIME(o_orderdate, '%Y%m%d') || '_depth_50m.tif' AS path FROM orders)
SELECT o_orderkey, REGEXP_EXTRACT(path, '([^/_]*)([0-9]{8})_[^/]*$', 1) AS basin, STRFTIME(STRPTIME(REGEXP_EXTRACT(path, '([^/_]*)([0-9]{8})_[^/]*$', 2), '%Y%m%d'), '%Y-%m-%d') AS acq_date FROM p""")
def filename_metadata(spark, sf_dir):
    return _paths(spark, sf_dir).select("o_orderkey", filenames.basin_of(F.col("path")).alias("basin"), filenames.date_of(F.col("path")).cast("string").alias("acq_date"))


HEADERS_SQL = """
WITH h AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'date1' WHEN c_custkey % 4 = 1 THEN 'date2' WHEN c_custkey % 4 = 2 THEN 'dem' ELSE 'veg' END AS layer,
  c_custkey // 4 AS scene, CAST(50 AS DOUBLE) AS rez, CAST(FLOOR(c_acctbal) - 2000 AS DOUBLE) AS "left", CAST(FLOOR(c_acctbal * 3) - 9000 AS DOUBLE) AS bottom FROM customer),
hh AS (SELECT *, "left" + 20000 AS "right", bottom + 50000 AS top FROM h)"""


def _headers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey") % 4
    h = c.select(
        F.when(k == 0, "date1").when(k == 1, "date2").when(k == 2, "dem").otherwise("veg").alias("layer"), F.expr("c_custkey div 4").alias("scene"), F.lit(50.0).alias("rez"),
        (F.floor("c_acctbal") - 2000).cast("double").alias("left"), (F.floor(F.col("c_acctbal") * 3) - 9000).cast("double").alias("bottom"),
    )
    return h.withColumns({"right": F.col("left") + 20000, "top": F.col("bottom") + 50000})


def _snap_sql(c: str) -> str:
    m = f"((ROUND_EVEN({c}, 0) % 50 + 50) % 50)"
    r = f"({c} - FLOOR({c} / 50) * 50)"
    return f"CASE WHEN {m} = 0 THEN {c} WHEN {m} > 25 THEN {c} + (50 - {r}) ELSE {c} - {r} END"


@query("snap_extents", HEADERS_SQL + "SELECT layer, scene, " + ", ".join(f'{_snap_sql(c)} AS {c}' for c in ('"left"', "bottom", '"right"', "top")) + " FROM hh")
def snap_extents(spark, sf_dir):
    return align.snapped(_headers(spark, sf_dir)).select("layer", "scene", *align.SIDES)


@query("half_pixel_shift", HEADERS_SQL + """SELECT layer, scene, CASE WHEN layer IN ('dem', 'veg') THEN "left" + 25 ELSE "left" END AS "left", CASE WHEN layer IN ('dem', 'veg') THEN bottom + 25 ELSE bottom END AS bottom,
  CASE WHEN layer IN ('dem', 'veg') THEN "right" - 25 ELSE "right" END AS "right", CASE WHEN layer IN ('dem', 'veg') THEN top - 25 ELSE top END AS top FROM hh""")
def half_pixel_shift(spark, sf_dir):
    return align.shifted(_headers(spark, sf_dir)).select("layer", "scene", *align.SIDES)


@query("extent_intersection", HEADERS_SQL + """, x AS (SELECT MAX("left") AS l, MAX(bottom) AS b, MIN("right") AS r, MIN(top) AS t FROM hh)
SELECT """ + ", ".join(f"{_snap_sql(a)} AS {b}" for a, b in (("l", '"left"'), ("b", "bottom"), ("r", '"right"'), ("t", "top"))) + " FROM x")
def extent_intersection(spark, sf_dir):
    return align.common_extent(_headers(spark, sf_dir)).select(*align.SIDES)


@query("resolution_check", "SELECT CAST(50 AS DOUBLE) AS rez, TRUE AS topo_same, (SELECT COUNT(DISTINCT c_acctbal) = 1 FROM customer) AS extents_same")
def resolution_check(spark, sf_dir):
    h = _headers(spark, sf_dir)
    return align.check_resolution(h).withColumn("extents_same", align.same_extent(h).scalar())


def _layer(px: DataFrame, value: str, rez: float = 50.0) -> DataFrame:
    """A pixel column as point values in map coordinates, from (1000, 90000) right and down."""
    return px.select((1000 + (F.col("col") + 0.5) * rez).alias("x"), (90000 - (F.col("row") + 0.5) * rez).alias("y"), F.col(value).alias("value"))


@query("coregister_join", "SELECT CAST(row - 3 AS INT) AS row, CAST(col - 2 AS INT) AS col, d1, d2, dem, veg FROM px WHERE row >= 3 AND col >= 2")
def coregister_join(spark, sf_dir):
    px = grid(spark, sf_dir)
    keyed = [align.grid_keys(_layer(px, c), F.lit(1100.0), F.lit(89850.0), F.lit(50.0)) for c in ("d1", "d2", "dem", "veg")]
    return align.coregister(*keyed)


@query("resample_topo_nearest", "SELECT p.row, p.col, q.dem AS value FROM px p JOIN px q ON q.row = CAST(FLOOR((p.row + 0.5) / 3) AS INT) AND q.col = CAST(FLOOR((p.col + 0.5) / 3) AS INT)")
def resample_topo_nearest(spark, sf_dir):
    px = grid(spark, sf_dir)
    return align.resample_nearest(px.select("row", "col"), px.select("row", "col", F.col("dem").alias("value")), F.lit(1) / 3).select("row", "col", "value")


@query("pad_to_original", """, sp0 AS (SELECT a.row, b.col FROM (SELECT UNNEST(RANGE(0, h + 5)) AS row FROM hw) a CROSS JOIN (SELECT UNNEST(RANGE(0, w + 7)) AS col FROM hw) b)
SELECT CAST(sp0.row AS INT) AS row, CAST(sp0.col AS INT) AS col, px.d2 FROM sp0 LEFT JOIN px ON px.row = sp0.row - 2 AND px.col = sp0.col - 4""")
def pad_to_original(spark, sf_dir):
    px = grid(spark, sf_dir)
    h, w = neighborhood.grid_shape(px)
    return align.pad(cells(px, "d2"), align.spine(spark, h + 5, w + 7), 2, 4)


# ---- arithmetic and masks


@query("depth_m_to_cm", "SELECT row, col, CASE WHEN d1 = -9999 THEN -9999 ELSE CAST(TRUNC(ROUND_EVEN(d1 * 0.0123 * 100, 0) / 100 * 100) AS INT) END AS cm, CASE WHEN d1 = -9999 THEN -9999 ELSE CAST(TRUNC(ROUND_EVEN(d1 * 0.0123 * 100, 0)) AS INT) END AS cm_nearest FROM (SELECT row, col, CAST(d1 AS DOUBLE) AS d1 FROM px)")
def depth_m_to_cm(spark, sf_dir):
    m = F.when(F.col("d1") == -9999, F.lit(-9999.0)).otherwise(F.col("d1").cast("double") * 0.0123)
    return cells(grid(spark, sf_dir), fn.to_cm(m).alias("cm"), fn.to_cm(m, "nearest").alias("cm_nearest"))


@query("difference", "SELECT row, col, diff FROM m")
def difference(spark, sf_dir):
    return cells(grid(spark, sf_dir), fn.difference().alias("diff"))


@query("difference_normalized", "SELECT row, col, norm FROM m")
def difference_normalized(spark, sf_dir):
    return cells(basics(spark, sf_dir), "norm")


@query("mask_basic", "SELECT row, col, ok, sp, all_loss, all_gain, zero_and_nan FROM m")
def mask_basic(spark, sf_dir):
    return cells(basics(spark, sf_dir), "ok", "sp", "all_loss", "all_gain", "zero_and_nan")


@query("mask_advanced_default", "SELECT row, col, conditional FROM m")
def mask_advanced_default(spark, sf_dir):
    return cells(basics(spark, sf_dir), fn.within(CFG.name, CFG.operator, CFG.value).alias("conditional"))


@query("mask_advanced_custom", "SELECT row, col, (d2 > 100 AND d2 < 900 AND diff < 300 AND diff > -300 AND norm > -0.5 AND norm < 2.5 AND ok) AS conditional FROM m")
def mask_advanced_custom(spark, sf_dir):
    rule = fn.within(("date2", "difference", "difference_normalized"), ("greater_than", "less_than", "less_than", "greater_than", "greater_than", "less_than"), (100, 900, 300, -300, -0.5, 2.5))
    return cells(basics(spark, sf_dir), rule.alias("conditional"))


# ---- bands


@query("elevation_bands", "SELECT row, col, band FROM b")
def elevation_bands(spark, sf_dir):
    return cells(banded(spark, sf_dir), "band")


@query("band_edges", "SELECT DISTINCT band, CAST(e + band * 50 AS INT) AS edge FROM b CROSS JOIN ed WHERE band IS NOT NULL")
def band_edges(spark, sf_dir):
    return bands.band_edges(banded(spark, sf_dir), basics(spark, sf_dir), "ok", RES)


@query("band_cardinality", "SELECT CAST(FLOOR((MAX(dem) - (MIN(dem) - MIN(dem) % 50)) / 50.0) AS INT) + 1 AS n_bands, CAST(CEIL((MAX(dem) - MIN(dem)) / 254.0) AS INT) AS least_res, (CAST(FLOOR((MAX(dem) - (MIN(dem) - MIN(dem) % 50)) / 50.0) AS INT) + 1 <= 254) AS fits FROM m WHERE ok")
def band_cardinality(spark, sf_dir):
    return bands.check_bands(basics(spark, sf_dir), "ok", RES)


@query("band_percentiles", "SELECT band, thresh_upper_raw, ROUND(thresh_upper_norm, 4) AS thresh_upper_norm, thresh_lower_raw, ROUND(thresh_lower_norm, 4) AS thresh_lower_norm, median_raw FROM st")
def band_percentiles(spark, sf_dir):
    return stats_of(spark, sf_dir).select("band", "thresh_upper_raw", F.round("thresh_upper_norm", 4).alias("thresh_upper_norm"), "thresh_lower_raw", F.round("thresh_lower_norm", 4).alias("thresh_lower_norm"), "median_raw")


@query("band_counts", "SELECT band, elevation_count FROM st")
def band_counts(spark, sf_dir):
    return stats_of(spark, sf_dir).select("band", "elevation_count")


@query("band_mean_depth", "SELECT band, ROUND(mean_d2, 4) AS mean_d2 FROM st")
def band_mean_depth(spark, sf_dir):
    return stats_of(spark, sf_dir).select("band", F.round("mean_d2", 4).alias("mean_d2"))


@query("basin_mean_depth", "SELECT ROUND(AVG(d1), 4) AS mean_d1, ROUND(AVG(d2), 4) AS mean_d2 FROM m WHERE ok")
def basin_mean_depth(spark, sf_dir):
    return basics(spark, sf_dir).where("ok").agg(F.round(F.avg("d1"), 4).alias("mean_d1"), F.round(F.avg("d2"), 4).alias("mean_d2"))


@query("snowline", "SELECT snowline FROM sl")
def snowline(spark, sf_dir):
    return bands.snowline(stats_of(spark, sf_dir), bands.lowest_edge(basics(spark, sf_dir), "ok", RES), CFG.snowline_threshold, RES)


@query("snowline_losses", "SELECT CAST(e + band * 50 AS INT) AS elevation, COUNT(*) AS n_ok, COUNT(*) FILTER (WHERE all_loss) AS n_loss, COUNT(*) FILTER (WHERE flag_basin_loss) AS n_block FROM f CROSS JOIN ed WHERE ok AND dem >= snowline GROUP BY 1")
def snowline_losses(spark, sf_dir):
    b = basics(spark, sf_dir)
    edge = bands.lowest_edge(b, "ok", RES)
    line = bands.snowline(stats_of(spark, sf_dir), edge, CFG.snowline_threshold, RES).scalar()
    px = qc(spark, sf_dir, flags=("basin_block",)).where(F.col("ok") & (F.col("dem") >= line))
    return px.groupBy((edge + F.col("band") * RES).alias("elevation")).agg(F.count("*").alias("n_ok"), F.count_if("all_loss").alias("n_loss"), F.count_if("flag_basin_loss").alias("n_block"))


# ---- histogram


def _binned(spark, sf_dir):
    px = basics(spark, sf_dir).withColumn("conditional", fn.within(CFG.name, CFG.operator, CFG.value))
    return histogram.with_bins(px, "conditional", CFG.histogram_mats, CFG.num_bins)


@query("histogram_2d", "SELECT * FROM hist")
def histogram_2d(spark, sf_dir):
    return histogram.histogram(_binned(spark, sf_dir))


@query("pixel_bins", "SELECT row, col, bx, by_ AS by FROM pb")
def pixel_bins(spark, sf_dir):
    return cells(_binned(spark, sf_dir), "bx", "by")


@query("neighbor_fraction_truncated", "SELECT share.bx, share.by, cnt, occupied, CAST(cells AS INT) AS cells, ROUND(CAST(occupied AS DOUBLE) / cells, 4) AS pct FROM share")
def neighbor_fraction_truncated(spark, sf_dir):
    return histogram.occupied_share(histogram.histogram(_binned(spark, sf_dir)), CFG.num_bins, 3).withColumn("pct", F.round("pct", 4))


@query("histogram_outlier_bins", "SELECT * FROM outl")
def histogram_outlier_bins(spark, sf_dir):
    return histogram.outlier_bins(histogram.histogram(_binned(spark, sf_dir)), CFG.num_bins, 3, CFG.threshold_histogram_space[0]).select("bx", "by", "cnt")


# ---- windows and flags


def _fraction_sql(k: int) -> str:
    return f"""SELECT p.row, p.col, CASE WHEN p.row BETWEEN {k} AND h - {k + 1} AND p.col BETWEEN {k} AND w - {k + 1} THEN ROUND(COALESCE(c.n, 0) / {(2 * k + 1) ** 2}.0, 4)::DOUBLE ELSE 0 END AS pct
FROM px p CROSS JOIN hw LEFT JOIN (SELECT m.row + dr AS r, m.col + dc AS c, COUNT(*) AS n FROM m CROSS JOIN (SELECT UNNEST(RANGE({-k}, {k + 1})) AS dr) x CROSS JOIN (SELECT UNNEST(RANGE({-k}, {k + 1})) AS dc) y
  WHERE ok AND all_gain GROUP BY 1, 2) c ON c.r = p.row AND c.c = p.col"""


def _fraction(size: int, strategy: str = "dense"):
    def run(spark, sf_dir):
        b = basics(spark, sf_dir)
        px = neighborhood.counts(b.select("row", "col", "ok", "all_gain"), {"n": F.col("ok") & F.col("all_gain")}, size, strategy)
        inside = neighborhood.interior(size // 2, *neighborhood.grid_shape(b))
        return cells(px, F.when(inside, F.round(F.col("n") / (size * size), 4)).otherwise(0.0).alias("pct"))

    return run


for _size in (3, 5, 7):
    query(f"neighbor_fraction_zero_border_{_size}", _fraction_sql(_size // 2))(_fraction(_size))
query("neighbor_fraction_sparse_5", _fraction_sql(2))(_fraction(5, "sparse"))


def flag(name: str, sql: str, columns: tuple[str, ...], percentiles=None, **change):
    """Register a query of flag columns."""

    def run(spark, sf_dir):
        return cells(qc(spark, sf_dir, **change, **({"outlier_percentiles": percentiles} if percentiles else {})), *columns)

    query(name, sql, percentiles)(run)


flag("flag_histogram", "SELECT row, col, flag_histogram FROM f", ("flag_histogram",), flags=("histogram",))
flag("flag_zero_and_nan", "SELECT row, col, zero_and_nan AS flag_zero_and_nan FROM m", ("flag_zero_and_nan",), flags=("zero_and_nan",))
for _side in ("loss", "gain"):
    flag(f"flag_basin_{_side}", f"SELECT row, col, flag_basin_{_side} FROM f", (f"flag_basin_{_side}",), flags=("basin_block",))
    flag(f"flag_elevation_{_side}", f"SELECT row, col, flag_elevation_{_side} FROM f", (f"flag_elevation_{_side}",), flags=("elevation_block",))
    flag(f"flag_elevation_{_side}_spread", f"SELECT row, col, flag_elevation_{_side} FROM f", (f"flag_elevation_{_side}",), SPREAD, flags=("elevation_block",))
flag("flag_basin_nowindow", "SELECT row, col, bl AS flag_basin_loss, bg AS flag_basin_gain FROM h", ("flag_basin_loss", "flag_basin_gain"), flags=("basin_block",), apply_moving_window_basin=False)
flag("flag_basin_strict", "SELECT row, col, (inside AND nbl > 5 AND bl) AS flag_basin_loss, (inside AND nbg > 5 AND bg) AS flag_basin_gain FROM hn", ("flag_basin_loss", "flag_basin_gain"), flags=("basin_block",), strict=True)
flag("flag_elevation_nowindow", "SELECT row, col, (el AND NOT dem < snowline) AS flag_elevation_loss, eg AS flag_elevation_gain FROM h", ("flag_elevation_loss", "flag_elevation_gain"), flags=("elevation_block",), apply_moving_window_elevation=False)
flag("median_elevation_map", "SELECT row, col, median_elevation FROM t", ("median_elevation",), flags=("elevation_block",))
for _logic, _expr in (("or", "{b} OR {e}"), ("and", "{b} AND {e}"), ("basin", "{b}"), ("elevation", "{e}")):
    _sql = ", ".join(f"(({_expr.format(b=f'flag_basin_{s}', e=f'flag_elevation_{s}')}) AND veg > 5) AS flag_tree_{s}" for s in ("loss", "gain"))
    flag(f"flag_tree_{_logic}", f"SELECT row, col, {_sql} FROM f", ("flag_tree_loss", "flag_tree_gain"), SPREAD, flags=("tree",), tree_loss=_logic, tree_gain=_logic)

# ---- reports and sinks

ALL_FLAGS = ("flag_histogram", "flag_basin_loss", "flag_basin_gain", "flag_elevation_loss", "flag_elevation_gain", "flag_tree_loss", "flag_tree_gain", "flag_zero_and_nan")


def _report_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{f}' AS flag, {f} AS hit, sp, diff, band_sp FROM ff" for f in ALL_FLAGS)
    return f""", u AS ({each}),
med AS (SELECT flag, band_sp, CAST(TRUNC(ROUND(QUANTILE_CONT(CAST(diff AS DOUBLE), 0.5), 6)) AS INT) AS md FROM u WHERE sp AND NOT hit GROUP BY 1, 2)
SELECT u.flag, COUNT(*) FILTER (WHERE hit) AS cell_count, ROUND_EVEN(COUNT(*) FILTER (WHERE hit)::DOUBLE / COUNT(*) FILTER (WHERE sp) * 100 * 10, 0) / 10 AS pct_coverage,
 ROUND_EVEN(100 * ((SUM(diff) FILTER (WHERE sp) - SUM(CASE WHEN hit THEN COALESCE(md, 0) ELSE diff END) FILTER (WHERE sp))::DOUBLE / SUM(diff) FILTER (WHERE sp)) * 10, 0) / 10 AS delta_pct
FROM u LEFT JOIN med ON med.flag = u.flag AND med.band_sp = u.band_sp GROUP BY u.flag"""


@query("stats_report", _report_sql())
def stats_report(spark, sf_dir):
    return run_qc(grid(spark, sf_dir), CFG, keep=False).report()


@query("band_threshold_table", "SELECT CAST(e + band * 50 AS INT) AS elevation, thresh_upper_raw, ROUND_EVEN(thresh_upper_norm * 100, 0) / 100 AS thresh_upper_norm, thresh_lower_raw, ROUND_EVEN(thresh_lower_norm * 100, 0) / 100 AS thresh_lower_norm, median_raw, elevation_count FROM st CROSS JOIN ed")
def band_threshold_table(spark, sf_dir):
    return report.band_table(stats_of(spark, sf_dir), bands.lowest_edge(basics(spark, sf_dir), "ok", RES), RES)


@query("flags_wide", "SELECT row, col, " + ", ".join(ALL_FLAGS) + ", NOT ok AS mask_overlap_nan FROM ff")
def flags_wide(spark, sf_dir):
    return sinks.flags_wide(qc(spark, sf_dir), ALL_FLAGS, ("overlap_nan",))


@query("flags_long", ", u AS (" + " UNION ALL ".join(f"SELECT row, col, '{f}' AS flag FROM ff WHERE {f}" for f in ALL_FLAGS) + ") SELECT row, col, flag FROM u")
def flags_long(spark, sf_dir):
    return sinks.flags_long(qc(spark, sf_dir), ALL_FLAGS)


@query("arrays_masked", "SELECT row, col, CASE WHEN sp THEN diff END AS difference, CASE WHEN sp THEN norm END AS difference_normalized, NULLIF(d1, -9999) AS date1, NULLIF(d2, -9999) AS date2, CASE WHEN sp THEN median_elevation END AS median_elevation FROM t")
def arrays_masked(spark, sf_dir):
    return sinks.arrays_masked(qc(spark, sf_dir, flags=("elevation_block",)))


@query("flag_codes", "SELECT row, col, CAST(flag_zero_and_nan AS INT) AS flag_zero_and_nan, CAST(flag_histogram AS INT) AS flag_histogram FROM ff")
def flag_codes(spark, sf_dir):
    return sinks.flag_codes(qc(spark, sf_dir, flags=("histogram", "zero_and_nan")), ("flag_zero_and_nan", "flag_histogram"))


FULL_SQL = "SELECT row, col, d1, d2, diff, norm, dem, veg, ok, sp, " + ", ".join(ALL_FLAGS) + " FROM ff"


@query("full_qc", FULL_SQL)
def full_qc(spark, sf_dir):
    return qc(spark, sf_dir).select("row", "col", "d1", "d2", "diff", "norm", "dem", "veg", "ok", "sp", *ALL_FLAGS)
