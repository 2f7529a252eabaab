import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield import cli
from cairnfield.config import QCConfig, format_config
from cairnfield.sources import layers, raster


def netcdf(variables, x, y):
    """A classic NetCDF file with dimensions y and x."""
    name = lambda s: struct.pack(">I", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    none = struct.pack(">II", 0, 0)
    dims = struct.pack(">II", 10, 2) + name("y") + struct.pack(">I", len(y)) + name("x") + struct.pack(">I", len(x))
    items = [("x", (1,), x), ("y", (0,), y), *((k, (0, 1), v) for k, v in variables.items())]

    def header(offsets):
        out = b"CDF\x01" + struct.pack(">I", 0) + dims + none + struct.pack(">II", 11, len(items))
        for (k, d, v), at in zip(items, offsets):
            out += name(k) + struct.pack(">I", len(d)) + b"".join(struct.pack(">I", i) for i in d) + none + struct.pack(">III", 5, v.size * 4, at)
        return out

    at, offsets = len(header([0] * len(items))), []
    for _, _, v in items:
        offsets.append(at)
        at += v.size * 4
    return header(offsets) + b"".join(np.asarray(v, ">f4").tobytes() for _, _, v in items)


def write(path, data):
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32"])
def test_tiff_round_trip(compress, dtype):
    bands = np.arange(2 * 300 * 5).reshape(2, 300, 5).astype(dtype)
    g = raster.decode_tiff(raster.encode_tiff(bands, 1000.0, 9000.0, 50.0, 255, compress))
    assert (g.values == bands[0]).all() and (g.left, g.top, g.rez, g.nodata) == (1000.0, 9000.0, 50.0, 255.0)


def test_broken_rasters_are_errors():
    for f, bad in ((raster.decode_tiff, b"nothing here"), (lambda b: raster.decode_netcdf(b, "dem"), b"nothing")):
        with pytest.raises(ValueError):
            f(bad)


def test_raster_points(spark, tmp_path):
    v = np.array([[1.5, np.nan], [-9999, 4]], "float32")
    p = write(tmp_path / "a.tif", raster.encode_tiff(v[None], 100.0, 400.0, 50.0, -9999))
    got = {(r.x, r.y): r.value for r in raster.read_raster(spark, p).collect()}
    assert got == {(125.0, 375.0): 1.5, (175.0, 375.0): None, (125.0, 325.0): None, (175.0, 325.0): 4.0}
    h = raster.read_header(spark, p, "date1").first()
    assert (h.left, h.bottom, h.right, h.top, h.rez, h.width, h.height) == (100, 300, 200, 400, 50, 2, 2)


@pytest.fixture
def survey(tmp_path):
    """Two depth files, the second one cell further right and down, and a wider topography."""
    rng = np.random.default_rng(4)
    d1, d2 = rng.integers(0, 300, (12, 12)) / 100, rng.integers(0, 300, (12, 12)) / 100
    a = write(tmp_path / "BASIN20170402_depth.tif", raster.encode_tiff(d1[None].astype("float32"), 1000.0, 5000.0, 50.0, -9999))
    b = write(tmp_path / "BASIN20170605_depth.tif", raster.encode_tiff(d2[None].astype("float32"), 1050.0, 4950.0, 50.0, -9999))
    x, y = 925 + 50.0 * np.arange(20), 4300 + 50.0 * np.arange(20) - 225
    dem = np.add.outer(np.arange(20) * 20, np.arange(20)) + 2000.0
    topo = write(tmp_path / "topo.nc", netcdf({"dem": dem, "veg_height": dem * 0 + 6}, x, y))
    return QCConfig(file_path_in_date1=a, file_path_in_date2=b, file_path_topo=topo, file_path_out=str(tmp_path / "out"), snowline_threshold=5), d1, d2


def test_layers_are_aligned(spark, survey):
    cfg, d1, d2 = survey
    px = layers.aligned(spark, cfg)
    rows = px.collect()
    assert px.columns == ["row", "col", "d1", "d2", "dem", "veg"] and 100 <= len(rows) <= 121
    one, two = np.float32(d1).astype(float), np.float32(d2).astype(float)
    top, left = min(r.row for r in rows), min(r.col for r in rows)
    assert (top, left) == (0, 0)
    for r in rows:
        assert r.d1 in {int(np.rint(v * 100) / 100 * 100) for v in one.ravel()} and r.veg == 6
    # the common extent starts at the second file's corner: one cell into the first
    found = {(r.row, r.col): (r.d1, r.d2) for r in rows}
    cm = lambda v: int(np.rint(float(v) * 100) / 100 * 100)
    assert found[0, 0] == (cm(one[1, 1]), cm(two[0, 0])) and found[5, 7] == (cm(one[6, 8]), cm(two[5, 7]))


def test_command_line(spark, survey, tmp_path, capsys):
    cfg, _, _ = survey
    (tmp_path / "run.ini").write_text(format_config(cfg))
    text = cli.main(["--config", str(tmp_path / "run.ini")], spark)
    assert "flag_basin_loss" in text and text in capsys.readouterr().out
    folder = tmp_path / "out/BASIN/20170402_20170605"
    assert (folder / "flags").is_dir() and (folder / "arrays").is_dir() and (folder / "bands").is_dir()
    tiles = sorted(x.name for x in (folder / "rasters").iterdir())
    assert tiles == ["BASIN20170402_20170605_diff_arrays_000000.tif", "BASIN20170402_20170605_diff_flags_000000.tif"]
    # padded to the second file's grid; flags equal the table's, and no data lies around them
    grid = raster.decode_tiff((folder / "rasters" / tiles[1]).read_bytes())
    wide = spark.read.parquet(str(folder / "flags")).collect()
    values = np.asarray(grid.values).reshape(12, 12, -1)
    names = [c for c in wide[0].asDict() if c.startswith("flag_")]
    at = [(r.row, r.col) for r in wide]
    assert (grid.left, grid.top, grid.rez) == (1050.0, 4950.0, 50.0) and values.shape[2] in (1, len(names))
    assert all(values[r.row, r.col, 0] == int(r[names[0]]) for r in wide)
    assert all(values[i, j, 0] == 255 for i in range(12) for j in range(12) if (i, j) not in at)
    assert "outlier_percentiles = 5 95 5 95" in "".join(r.value + "\n" for r in spark.read.text(str(folder / "config_ini")).collect())


def test_pixel_table_by_extent(spark, tmp_path):
    from cairnfield.sources import pixels

    px = spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    px.write.parquet(str(tmp_path / "px"))
    got = pixels.read_pixels(spark, str(tmp_path / "px"), rows=(2, 3), cols=(0, 4))
    assert got.count() == 10
