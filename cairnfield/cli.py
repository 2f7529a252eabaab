"""Command line: ``python -m cairnfield.cli --config run.ini [--pixels table] [--out folder]``.

``--pixels`` names an aligned pixel table; without it the layers named in the
settings are read and aligned first.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from .config import read_config
from .operators.report import format_report
from .plans.qc import run_qc
from .sources import filenames, layers, pixels, sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cairnfield", description="Quality control of two gridded depth surveys.")
    p.add_argument("--config", required=True, help="INI file with the settings")
    p.add_argument("--pixels", help="Parquet table of aligned pixels")
    p.add_argument("--out", help="folder for outputs; else it follows from the settings")
    p.add_argument("--overwrite", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = arguments(argv)
    cfg = read_config(args.config)
    out = args.out
    if cfg.file_path_in_date1 and cfg.file_path_in_date2:
        filenames.check_order(cfg.file_path_in_date1, cfg.file_path_in_date2)
        out = out or filenames.output_folder(cfg.file_path_out or ".", cfg.file_path_in_date1, cfg.file_path_in_date2, cfg.basin)
    if out is None:
        raise SystemExit("give --out or name both depth files in the settings")
    spark = spark or SparkSession.builder.appName("cairnfield").getOrCreate()
    px = pixels.read_pixels(spark, args.pixels) if args.pixels else layers.aligned(spark, cfg)
    qc = run_qc(px, replace(cfg))
    qc.save(out, args.overwrite)
    if not args.pixels:
        name = filenames.output_name("", cfg.file_path_in_date1, cfg.file_path_in_date2, "", cfg.file_name_modifier, cfg.basin).rsplit("/", 1)[-1].rstrip("_")
        sinks.save_flag_rasters(qc.pixels, qc.cfg, f"{out}/rasters", name, layers.frame_of(spark, cfg))
    text = format_report(qc.report())
    print(text)
    return text


if __name__ == "__main__":
    main()
