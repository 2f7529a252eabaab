import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield import functions as fn
from cairnfield.config import QCConfig
from cairnfield.operators import align, bands, histogram, neighborhood, report
from cairnfield.plans.qc import run_qc
from cairnfield.sources import sinks
from cairnfield.streaming import tiles

ND = -9999


def px_of(spark, d1, d2, dem=None, veg=None):
    d1, d2 = np.asarray(d1), np.asarray(d2)
    dem = np.full(d1.shape, 2000) if dem is None else np.asarray(dem)
    veg = np.zeros(d1.shape, int) if veg is None else np.asarray(veg)
    rows = [(r, c, int(d1[r, c]), int(d2[r, c]), int(dem[r, c]), int(veg[r, c])) for r in range(d1.shape[0]) for c in range(d1.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, d1 int, d2 int, dem int, veg int")


def column(df, name, shape):
    out = np.empty(shape, dtype=object)
    for r in df.select("row", "col", name).collect():
        out[r[0], r[1]] = r[2]
    return out


def window_sum(mask, k):
    h, w = mask.shape
    return np.array([[mask[max(0, r - k) : r + k + 1, max(0, c - k) : c + k + 1].sum() for c in range(w)] for r in range(h)])


def zero_border_fraction(mask, size):
    k = size // 2
    out = window_sum(mask, k) / size**2
    inner = np.zeros_like(out)
    inner[k : mask.shape[0] - k, k : mask.shape[1] - k] = out[k : mask.shape[0] - k, k : mask.shape[1] - k]
    return inner


@pytest.mark.parametrize(
    "d1, d2, loss, gain, ok, sp, zn, diff, norm",
    [
        (100, 0, True, False, True, True, False, -100, -1.0),
        (0, 100, False, True, True, True, False, 100, 4.0),
        (ND, 0, True, False, False, False, True, 9999, -1.0),
        (0, ND, False, True, False, False, True, -9999, -399.96),
        (0, 0, False, False, True, False, False, 0, 0.0),
        (ND, ND, False, False, False, False, False, 0, 0.0),
        (200, 203, False, False, True, True, False, 3, 0.02),
    ],
)
def test_basics(spark, d1, d2, loss, gain, ok, sp, zn, diff, norm):
    r = fn.with_basics(px_of(spark, [[d1]], [[d2]])).first()
    assert (r.all_loss, r.all_gain, r.ok, r.sp, r.zero_and_nan, r["diff"], r.norm) == (loss, gain, ok, sp, zn, diff, norm)


def test_rounding_is_half_even_of_the_product(spark):
    r = fn.with_basics(px_of(spark, [[200]], [[403]])).first()
    assert r.norm == np.round(203 / 200, 2)


def test_loss_and_gain_swap_with_the_dates(spark):
    rng = np.random.default_rng(1)
    a, b = rng.choice([ND, 0, 50], (5, 6)), rng.choice([ND, 0, 50], (5, 6))
    one, two = fn.with_basics(px_of(spark, a, b)), fn.with_basics(px_of(spark, b, a))
    assert (column(one, "all_loss", a.shape) == column(two, "all_gain", a.shape)).all()


def test_metres_to_centimetres(spark):
    r = spark.range(1).select(
        fn.to_cm(F.lit(None).cast("double")).alias("a"), fn.to_cm(F.lit(float("nan"))).alias("b"), fn.to_cm(F.lit(-9999.0)).alias("c"), fn.to_cm(F.lit(1.23)).alias("d"),
        fn.to_cm_float(F.lit(0.53).cast("float")).alias("e"), fn.to_cm(F.lit(0.53), "nearest").alias("f")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (ND, ND, ND, 123, 52, 53)


@pytest.mark.parametrize("coord, rez, want", [(2026, 49.99, 2050), (2024, 49.99, 2000), (2050, 50, 2050), (2025, 50, 2000), (-30, 50, -50), (-10, 50, 0)])
def test_snap(spark, coord, rez, want):
    assert spark.range(1).select(fn.snap(F.lit(float(coord)), F.lit(float(rez)))).first()[0] == want


def test_half_pixel(spark):
    h = spark.createDataFrame([("dem", 100.0, 100.0, 200.0, 200.0, 50.0), ("date1", 100.0, 100.0, 200.0, 200.0, 50.0)], "layer string, left double, bottom double, right double, top double, rez double")
    got = {r.layer: (r.left, r.bottom, r.right, r.top) for r in align.shifted(h).collect()}
    assert got == {"dem": (125, 125, 175, 175), "date1": (100, 100, 200, 200)}


def test_extent_of_disjoint_layers_is_an_error(spark):
    h = spark.createDataFrame([("date1", 0.0, 0.0, 100.0, 100.0, 50.0), ("date2", 500.0, 0.0, 600.0, 100.0, 50.0)], "layer string, left double, bottom double, right double, top double, rez double")
    with pytest.raises(Exception, match="no common extent"):
        align.common_extent(h).collect()
    assert align.same_extent(h).first()[0] is False


def test_different_resolutions_are_an_error(spark):
    h = spark.createDataFrame([("date1", 50.0), ("date2", 3.0)], "layer string, rez double")
    with pytest.raises(Exception, match="different resolutions"):
        align.check_resolution(h).collect()


def test_pad(spark):
    small = spark.createDataFrame([(0, 0, 7)], "row int, col int, v int")
    out = align.pad(small, align.spine(spark, F.lit(3), F.lit(2)), 1, 1)
    assert {(r.row, r.col): r.v for r in out.collect()} == {(r, c): 7 if (r, c) == (1, 1) else None for r in range(3) for c in range(2)}


@pytest.mark.parametrize("size", [3, 5, 7])
def test_windows_agree_with_numpy_and_with_each_other(spark, size):
    rng = np.random.default_rng(size)
    mask = rng.random((9, 11)) < 0.4
    px = px_of(spark, mask.astype(int), mask.astype(int) * 0)
    for strategy in ("dense", "sparse"):
        got = column(neighborhood.counts(px, {"n": F.col("d1") > 0}, size, strategy), "n", mask.shape).astype(int)
        assert (got == window_sum(mask, size // 2)).all()


def test_five_of_twenty_five_is_not_crowded(spark):
    mask = np.zeros((5, 5), int)
    mask[0, :5] = 1
    px = neighborhood.counts(px_of(spark, mask, mask), {"n": F.col("d1") > 0}, 5)
    flag = px.select("row", "col", neighborhood.crowded("n", 5, 0.2, F.lit(5), F.lit(5)).alias("f"))
    assert not column(flag, "f", mask.shape).any()


def test_truncated_window_share(spark):
    bins = spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "bx int, by int, cnt long")
    got = {(r.bx, r.by): r.pct for r in histogram.occupied_share(bins, (3, 3), 3).collect()}
    assert got == {(0, 0): 0.5, (1, 1): 2 / 9}


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 900, (12, 12)), rng.integers(0, 900, (12, 12))
    px = fn.with_basics(px_of(spark, a, b)).withColumn("conditional", F.lit(True))
    got = histogram.histogram(histogram.with_bins(px, "conditional", ("date1", "date2"), (7, 5)))
    want, _, _ = np.histogram2d(a.ravel(), b.ravel(), (7, 5))
    h = np.zeros((7, 5))
    for r in got.collect():
        h[r.bx, r.by] = r.cnt
    assert (h == want).all() and h.sum() == a.size


def test_bands(spark):
    dem = np.arange(2000, 3001, 50).reshape(1, -1)
    px = fn.with_basics(px_of(spark, dem * 0 + 5, dem * 0 + 9, dem))
    b = bands.with_band(px, "ok", 50)
    assert sorted(r.band for r in b.select("band").collect()) == list(range(21))
    r = bands.check_bands(px, "ok", 50).first()
    assert (r.n_bands, r.least_res, r.fits) == (21, 4, True)


def test_negative_elevations(spark):
    px = fn.with_basics(px_of(spark, [[5, 5]], [[5, 5]], [[-70, 20]]))
    assert sorted(r.band for r in bands.with_band(px, "ok", 50).select("band").collect()) == [0, 2]


def test_snowline_counts_occupied_bands(spark):
    dem = [[1000, 1200, 1250]]
    px = px_of(spark, [[10, 10, 90]], [[10, 20, 90]], dem)
    known = run_qc(px, QCConfig(flags=("basin_block",)), keep=False)
    stats = bands.band_stats(bands.with_band(fn.with_basics(px), "ok", 50), (5, 95, 5, 95))
    # the third occupied band counts as band 2, though it stands 250 m above the first
    assert bands.snowline(stats, F.lit(1000), 40, 50).first().snowline == 1100
    assert known.known.edge(50) == 1000


def test_no_band_above_the_snowline_threshold(spark):
    with pytest.raises(ValueError, match="no elevation band"):
        run_qc(px_of(spark, [[1, 2]], [[1, 2]]), QCConfig(flags=("basin_block",)), keep=False)


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 500, (10, 10)), rng.integers(0, 500, (10, 10))
    px = fn.with_basics(px_of(spark, a, b))
    r = bands.band_stats(bands.with_band(px, "ok", 50), (95, 80, 10, 20)).first()
    diff = (b - a).ravel()
    assert r.thresh_upper_raw == int(np.trunc(np.round(np.percentile(diff, 95), 6)))
    assert r.thresh_lower_raw == int(np.trunc(np.round(np.percentile(diff, 10), 6)))
    assert r.median_raw == int(np.trunc(np.percentile(diff, 50)))


def reference_basin(a, b, dem, line, size=5, strict=False):
    ok = (a != ND) & (b != ND)
    loss, gain = (a != 0) & (b == 0), (a == 0) & (b != 0)
    bl, bg = ok & loss & (dem > line), ok & gain
    own = (bl, bg) if strict else (loss, gain)
    return tuple((zero_border_fraction(m, size) > 0.2) & o for m, o in zip((bl, bg), own))


@pytest.mark.parametrize("strict", [False, True])
def test_basin_flags_match_numpy(spark, strict):
    rng = np.random.default_rng(7)
    a, b = rng.choice([ND, 0, 0, 80, 120], (14, 13)), rng.choice([ND, 0, 0, 80, 120], (14, 13))
    dem = 2000 + 20 * np.arange(14)[:, None] + np.zeros((1, 13), int)
    qc = run_qc(px_of(spark, a, b, dem), QCConfig(flags=("basin_block",), strict=strict, snowline_threshold=5), keep=False)
    stats = bands.band_stats(bands.with_band(fn.with_basics(px_of(spark, a, b, dem)), "ok", 50), (5, 95, 5, 95))
    line = bands.snowline(stats, F.lit(2000), 5, 50).first().snowline
    loss, gain = reference_basin(a, b, dem, line, strict=strict)
    assert (column(qc.pixels, "flag_basin_loss", a.shape) == loss).all()
    assert (column(qc.pixels, "flag_basin_gain", a.shape) == gain).all()


def test_the_deeper_date_sets_the_snowline_however_many_bands(spark, monkeypatch):
    from cairnfield.operators import flags as flag_ops

    rng = np.random.default_rng(2)
    dem = np.repeat(np.arange(10)[:, None] * 50 + 2000, 12, 1).astype(float)
    a, b = rng.integers(50, 90, (10, 12)) * (dem >= 2200), rng.integers(20, 49, (10, 12)) * (dem >= 2350)
    cfg = QCConfig(flags=("basin_block",), snowline_source="deeper", snowline_threshold=5)
    lines = []
    for most in (10_000, 0):
        monkeypatch.setattr(flag_ops, "COLLECTED_BANDS", most)
        basics = fn.with_basics(px_of(spark, a, b, dem))
        lines.append(flag_ops.with_bands(basics, cfg, flag_ops.summarise(basics, cfg))[1])
    assert lines[0] == lines[1]


def test_flags_are_within_their_candidates_and_strategies_agree(spark):
    rng = np.random.default_rng(9)
    a, b = rng.choice([ND, 0, 60, 300], (12, 12)), rng.choice([ND, 0, 60, 300], (12, 12))
    px = px_of(spark, a, b, 2000 + 10 * np.arange(144).reshape(12, 12), rng.integers(0, 12, (12, 12)))
    cfg = QCConfig(outlier_percentiles=(60, 60, 40, 40), neighbor_threshold=0.1)
    dense, sparse = run_qc(px, cfg, "dense", keep=False), run_qc(px, cfg, "sparse", keep=False)
    assert dense.flags == sparse.flags and len(dense.flags) == 8
    one = sorted(map(tuple, dense.wide().collect()))
    assert one == sorted(map(tuple, sparse.wide().collect()))
    for flag, base in (("flag_basin_loss", "all_loss"), ("flag_basin_gain", "all_gain"), ("flag_elevation_loss", "sp"), ("flag_elevation_gain", "sp"), ("flag_zero_and_nan", "zero_and_nan")):
        assert dense.pixels.where(F.col(flag) & ~F.col(base)).isEmpty()
    assert dense.pixels.where("flag_tree_loss and veg <= 5").isEmpty()
    long = dense.long().groupBy("flag").count().collect()
    wide = dense.wide().agg(*(F.count_if(f).alias(f) for f in dense.flags)).first().asDict()
    assert {r.flag: r["count"] for r in long} == {k: v for k, v in wide.items() if v}


def test_report_matches_numpy(spark):
    a = np.full((4, 4), 100)
    b = np.full((4, 4), 150)
    b[0, 0] = 400
    px = fn.with_basics(px_of(spark, a, b)).withColumn("flag_x", F.col("diff") > 200)
    r = report.stats_report(px, ["flag_x"], 50).first()
    assert (r.cell_count, r.pct_coverage) == (1, round(100 / 16, 1))
    assert r.delta_pct == round(100 * (1050 - 800) / 1050, 1)
    assert "flag_x" in report.format_report(report.stats_report(px, ["flag_x"], 50))


def test_masked_arrays(spark):
    px = fn.with_basics(px_of(spark, [[0, ND, 10]], [[0, 5, 30]]))
    got = {r.col: tuple(r)[2:] for r in sinks.arrays_masked(px, ("difference", "date1")).collect()}
    assert got == {0: (None, 0), 1: (None, None), 2: (20, 10)}
    assert sorted(r.difference for r in sinks.with_nodata(sinks.arrays_masked(px, ("difference",))).collect()) == [-9999, -9999, 20]


def test_save(spark, tmp_path):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, (8, 8)), rng.integers(0, 300, (8, 8))
    qc = run_qc(px_of(spark, a, b), QCConfig(include_masks=("overlap_nan",)), keep=False)
    qc.save(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/flags"))
    assert back.count() == 64 and "mask_overlap_nan" in back.columns
    assert spark.read.option("header", True).csv(str(tmp_path / "out/bands")).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        qc.save(str(tmp_path / "out"))
    qc.save(str(tmp_path / "out"), overwrite=True)


def test_empty_grid(spark):
    px = spark.createDataFrame([], "row int, col int, d1 int, d2 int, dem int, veg int")
    assert run_qc(px, QCConfig(flags=("zero_and_nan", "histogram")), keep=False).wide().count() == 0
    with pytest.raises(ValueError, match="no pixel"):
        run_qc(px, QCConfig(flags=("basin_block",)), keep=False)


def test_stream_of_tiles(spark, tmp_path):
    for k in range(3):
        px_of(spark, [[100, 0]], [[0, 100]]).withColumn("row", F.lit(k)).withColumn("arrived", F.to_timestamp(F.lit(f"2024-01-0{k + 1} 00:10:00"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "tiles"))
    schema = spark.read.parquet(str(tmp_path / "tiles")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "tiles"))
    q = tiles.band_counts(stream).writeStream.outputMode("complete").format("memory").queryName("tile_counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(n_ok) a, sum(n_loss) b, sum(n_gain) c, count(*) n from tile_counts").first()
    assert tuple(got) == (6, 3, 3, 3)
