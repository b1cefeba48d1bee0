"""Command line: ``python -m estatelens --estates FILE | --input FILE [--format F --root R] --output DIR [--config DIR --industry I --no-cluster --as-of DATE]``."""

from __future__ import annotations

import argparse
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession

from estatelens.config import default_config, load_config
from estatelens.operators import reports
from estatelens.plans.pipeline import Estate, run_estates
from estatelens.sources import sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="estatelens")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--estates", help="YAML list of estates: name, path, format_name, root_prefix")
    source.add_argument("--input", help="one listing")
    p.add_argument("--format", default="csv")
    p.add_argument("--root", default="")
    p.add_argument("--output", required=True)
    p.add_argument("--config")
    p.add_argument("--industry", default="")
    p.add_argument("--as-of", type=datetime.fromisoformat, default=None)
    p.add_argument("--no-cluster", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("estatelens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.estates:
        import yaml

        estates = [Estate(**e) for e in yaml.safe_load(Path(a.estates).read_text(encoding="utf-8"))]
    else:
        estates = [Estate(Path(a.input).stem, a.input, a.format, a.root)]
    config = load_config(a.config, a.industry) if a.config else default_config()
    files, sidecar = run_estates(spark, estates, a.as_of or datetime.now(), config, not a.no_cluster)
    sinks.write_jsonl(files, f"{a.output}/files.jsonl")
    written = spark.read.schema(files.schema).json(f"{a.output}/files.jsonl")
    sinks.write_csv(written, f"{a.output}/files.csv", titles=sinks.FULL)
    sinks.write_csv(written, f"{a.output}/files_slim.csv", titles=sinks.SLIM)
    sinks.write_sidecar(sidecar, f"{a.output}/scheme_candidates.json")
    sinks.write_report(reports.scheme_report(written), f"{a.output}/schemes.csv", "file_count", "full_path")
    sinks.duplicate_report(written, f"{a.output}/duplicates.txt")
    if not a.no_cluster:
        for e, other in (("address", "plot"), ("plot", "address")):
            sinks.write_report(reports.entity_report(written, e, other), f"{a.output}/{e}.csv", "file_count", e)
        sinks.review_report(written, f"{a.output}/clusters.txt")


if __name__ == "__main__":
    main()
