"""Settings of a quality-control run: typed, with defaults, read from INI text."""

from __future__ import annotations

import configparser
import json
from dataclasses import asdict, dataclass, replace
from pathlib import Path

NODATA = -9999
FLAGS = ("histogram", "basin_block", "elevation_block", "tree", "zero_and_nan")
OPERATORS = ("less_than", "greater_than")
TREE_LOGIC = ("or", "and", "basin", "elevation")
PAIRED = ("basin_block", "elevation_block", "tree")


@dataclass(frozen=True)
class QCConfig:
    """All settings with their defaults; ``section.key`` of the INI form is in ``SECTIONS``."""

    file_path_in_date1: str | None = None
    file_path_in_date2: str | None = None
    file_path_topo: str | None = None
    file_path_out: str | None = None
    basin: str | None = None
    file_name_modifier: str = "diff"
    name: tuple[str, ...] = ("date1", "difference_normalized")
    action: tuple[str, ...] = ("compare", "compare")
    operator: tuple[str, ...] = ("less_than", "greater_than", "less_than", "greater_than")
    value: tuple[float, ...] = (1700.0, -0.01, 10.0, -1.01)
    flags: tuple[str, ...] = FLAGS
    apply_moving_window_basin: bool = True
    apply_moving_window_elevation: bool = True
    elevation_loss: tuple[str, ...] = ("difference",)
    elevation_gain: tuple[str, ...] = ("difference", "difference_normalized")
    tree_loss: str = "or"
    tree_gain: str = "or"
    histogram_mats: tuple[str, ...] = ("date1", "difference_normalized")
    num_bins: tuple[int, ...] = (60, 200)
    threshold_histogram_space: tuple[float, ...] = (0.45, 1.0)
    moving_window_name: str = "bins"
    histogram_window: int = 3
    block_window: int = 5
    neighbor_threshold: float = 0.2
    snowline_threshold: float = 40.0
    elevation_band_resolution: int = 50
    outlier_percentiles: tuple[int, ...] = (5, 95, 5, 95)
    include_arrays: tuple[str, ...] = ("difference_normalized",)
    include_masks: tuple[str, ...] = ()
    plot: str = "save"
    remove_clipped_files: bool = False
    #: Extensions: what the code of the original leaves out or does against its own text.
    strict: bool = False
    snowline_source: str = "date2"
    min_bin_count: int = 0
    round_mode: str = "truncate"

    def __post_init__(self) -> None:
        bad = [f for f in self.flags if f not in FLAGS]
        if bad:
            raise ValueError(f"unknown flags: {', '.join(bad)}")
        if any(o not in OPERATORS for o in self.operator):
            raise ValueError(f"operators are {' and '.join(OPERATORS)}")
        if len(self.operator) != len(self.value) or len(self.operator) != 2 * len(self.name):
            raise ValueError("each array needs two operators and two values")
        for k in ("tree_loss", "tree_gain"):
            if getattr(self, k) not in TREE_LOGIC:
                raise ValueError(f"{k} is one of {', '.join(TREE_LOGIC)}")
        for k in ("histogram_window", "block_window"):
            if getattr(self, k) not in (3, 5, 7):
                raise ValueError(f"{k} is 3, 5 or 7")
        if self.snowline_source not in ("date2", "deeper"):
            raise ValueError("snowline_source is date2 or deeper")
        if self.round_mode not in ("truncate", "nearest"):
            raise ValueError("round_mode is truncate or nearest")
        if len(self.outlier_percentiles) != 4:
            raise ValueError("outlier_percentiles has four values")

    def with_required_flags(self) -> QCConfig:
        """The flags asked for and those that they are made from."""
        return replace(self, flags=required_flags(self.flags, self.tree_loss, self.tree_gain))


#: Where each setting stands in the INI form.
SECTIONS: dict[str, dict[str, str]] = {
    "paths": {k: k for k in ("file_path_in_date1", "file_path_in_date2", "file_path_topo", "file_path_out", "basin", "file_name_modifier")},
    "difference_arrays": {k: k for k in ("name", "action", "operator", "value")},
    "flags": {k: k for k in ("flags", "apply_moving_window_basin", "apply_moving_window_elevation", "elevation_loss", "elevation_gain", "tree_loss", "tree_gain")},
    "histogram_outliers": {"histogram_mats": "histogram_mats", "num_bins": "num_bins", "threshold_histogram_space": "threshold_histogram_space", "moving_window_name": "moving_window_name", "moving_window_size": "histogram_window"},
    "block_behavior": {"moving_window_size": "block_window", "neighbor_threshold": "neighbor_threshold", "snowline_threshold": "snowline_threshold", "elevation_band_resolution": "elevation_band_resolution", "outlier_percentiles": "outlier_percentiles"},
    "options": {k: k for k in ("include_arrays", "include_masks", "plot", "remove_clipped_files")},
    "extensions": {k: k for k in ("strict", "snowline_source", "min_bin_count", "round_mode")},
}


def required_flags(flags: tuple[str, ...], tree_loss: str = "or", tree_gain: str = "or") -> tuple[str, ...]:
    """Add the block flags that the tree flag combines: both for ``or`` and ``and``, else the one named."""
    out = list(FLAGS) if "all" in flags else list(dict.fromkeys(flags))
    if "tree" in out:
        for logic in (tree_loss, tree_gain):
            for block in ("basin", "elevation"):
                if logic in ("or", "and", block) and f"{block}_block" not in out:
                    out.append(f"{block}_block")
    return tuple(out)


def flag_columns(flags: tuple[str, ...]) -> list[str]:
    """Output columns of flags: block and tree flags have a loss and a gain part."""
    out: list[str] = []
    for f in FLAGS if "all" in flags else flags:
        stem = f"flag_{f.removesuffix('_block')}"
        out += [f"{stem}_loss", f"{stem}_gain"] if f in PAIRED else [stem]
    return out


def _parse(text: str, like: object) -> object:
    text = text.strip()
    if isinstance(like, tuple):
        items = text.strip("[]").replace(",", " ").split()
        if [i.lower() for i in items] in (["none"], []):
            return ()
        kind = type(like[0]) if like else str
        return tuple(kind(i) for i in items)
    if isinstance(like, bool):
        if text.lower() not in ("true", "false", "yes", "no", "1", "0"):
            raise ValueError(f"{text!r} is not a truth value")
        return text.lower() in ("true", "yes", "1")
    if isinstance(like, int | float):
        return type(like)(text)
    return None if text.lower() == "none" else text


def parse_config(text: str) -> QCConfig:
    """Settings from INI text; unknown sections and keys are errors."""
    ini = configparser.ConfigParser()
    ini.read_string(text)
    default, got = QCConfig(), {}
    for section in ini.sections():
        if section not in SECTIONS:
            raise ValueError(f"unknown section [{section}]")
        for key, value in ini.items(section):
            if key not in SECTIONS[section]:
                raise ValueError(f"unknown setting {section}.{key}")
            name = SECTIONS[section][key]
            got[name] = _parse(value, getattr(default, name))
    if "all" in got.get("flags", ()):
        got["flags"] = FLAGS
    return QCConfig(**got)


def read_config(path: str | Path) -> QCConfig:
    p = Path(path).expanduser()
    if not p.is_file():
        raise FileNotFoundError(f"no configuration at {p}")
    return parse_config(p.read_text())


def format_config(cfg: QCConfig) -> str:
    """INI text with every setting resolved; reading it gives the same settings."""
    show = lambda v: " ".join(map(str, v)) if isinstance(v, tuple) and v else "None" if v is None or v == () else str(v)
    return "\n".join(f"[{s}]\n" + "".join(f"{k} = {show(getattr(cfg, a))}\n" for k, a in keys.items()) for s, keys in SECTIONS.items())


def config_json(cfg: QCConfig) -> str:
    return json.dumps(asdict(cfg), indent=1)
