from datetime import date

import pytest

from cairnfield import schema
from cairnfield.config import FLAGS, QCConfig, flag_columns, format_config, parse_config, read_config, required_flags
from cairnfield.sources import filenames


def test_round_trip():
    cfg = QCConfig(flags=("tree",), outlier_percentiles=(95, 80, 10, 10), basin="tuolumne", include_masks=("overlap_nan",))
    assert parse_config(format_config(cfg)) == cfg


def test_values_are_typed():
    cfg = parse_config("[difference_arrays]\nvalue = [1700 -1, 20 -1.1]\n[flags]\nflags = all\napply_moving_window_basin = False\n[options]\ninclude_arrays = [None]\n")
    assert cfg.value == (1700.0, -1.0, 20.0, -1.1) and cfg.flags == FLAGS and cfg.apply_moving_window_basin is False and cfg.include_arrays == ()


@pytest.mark.parametrize("text", ["[nowhere]\na = 1\n", "[flags]\nfoo = 1\n", "[flags]\nflags = nonsense\n", "[flags]\ntree_loss = xor\n", "[block_behavior]\nmoving_window_size = 4\n", "[difference_arrays]\noperator = equals equals equals equals\n"])
def test_problems_are_errors(text):
    with pytest.raises(ValueError):
        parse_config(text)


def test_missing_file(tmp_path):
    with pytest.raises(FileNotFoundError):
        read_config(tmp_path / "none.ini")


@pytest.mark.parametrize(
    "flags, loss, gain, want",
    [
        (("tree",), "or", "or", {"tree", "basin_block", "elevation_block"}),
        (("tree",), "basin", "basin", {"tree", "basin_block"}),
        (("tree", "basin_block"), "basin", "elevation", {"tree", "basin_block", "elevation_block"}),
        (("histogram",), "or", "or", {"histogram"}),
        (("all",), "or", "or", set(FLAGS)),
    ],
)
def test_required_flags(flags, loss, gain, want):
    assert set(required_flags(flags, loss, gain)) == want


def test_flag_columns():
    assert flag_columns(("basin_block", "histogram", "tree")) == ["flag_basin_loss", "flag_basin_gain", "flag_histogram", "flag_tree_loss", "flag_tree_gain"]


def test_names():
    assert schema.column_of("difference_normalized") == "norm" and schema.column_of("other") == "other"
    assert schema.translate(["date1", "x"], schema.output_names("20170402", "20170605")) == ["depth_20170402", "x"]


def test_filenames():
    a, b = "/x/BASIN20170402_depth.tif", "/x/BASIN20170605_depth.tif"
    assert filenames.parse_name(a) == ("BASIN", date(2017, 4, 2))
    assert filenames.check_order(a, b) == (date(2017, 4, 2), date(2017, 6, 5))
    for x, y in ((b, a), (a, a)):
        with pytest.raises(ValueError):
            filenames.check_order(x, y)
    assert filenames.clipped_names(a, b, "/o") == ("/o/BASIN20170402_clipped_to_20170605_depth.tif", "/o/BASIN20170605_clipped_to_20170402_depth.tif")
    assert filenames.clip_state(a, b) == "clip" and filenames.clip_state(*filenames.clipped_names(a, b)) == "reuse"
    with pytest.raises(ValueError):
        filenames.clip_state(a, filenames.clipped_names(a, b)[0])
    assert filenames.output_name("/r", a, b, "flags.tif") == "/r/BASIN/20170402_20170605/BASIN20170402_20170605_diff_flags.tif"
