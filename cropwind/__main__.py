"""Command line: ``python -m cropwind full-run --root DIR [--commodity wheat] ...``."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from cropwind.operators.hedge import PROFILES, ROLES
from cropwind.plans.runs import Run
from cropwind.sources.config import DEFAULT_CONFIG, RegionConfig

STEPS = ("ingest", "climate-index", "market-model", "hedge", "report", "full-run")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cropwind", description="Climate risk, price forecast and hedge tables")
    out.add_argument("step", choices=STEPS)
    out.add_argument("--root", required=True, help="data folder with landing/, silver/, gold/")
    out.add_argument("--commodity", action="append", help="one commodity; repeat for more; default: all")
    out.add_argument("--config", help="region config file (JSON or YAML)")
    out.add_argument("--force", action="store_true", help="replace silver tables instead of merging")
    out.add_argument("--profile", choices=sorted(PROFILES), action="append")
    out.add_argument("--role", choices=ROLES, action="append")
    out.add_argument("--exposure", type=float, default=10000.0)
    out.add_argument("--as-of", type=dt.datetime.fromisoformat, help="run time in UTC; default: now")
    out.add_argument("--batch-id", help="repeat a failed ingest under its old id")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    as_of = args.as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    config = RegionConfig.from_file(args.config) if args.config else DEFAULT_CONFIG
    spark = spark or SparkSession.builder.appName("cropwind").getOrCreate()
    run = Run(spark, args.root, as_of, config)
    batch = args.batch_id or as_of.strftime("%Y%m%dT%H%M%S")
    wanted = {"profiles": args.profile or list(PROFILES), "roles": args.role or list(ROLES), "exposure": args.exposure}
    steps = {
        "ingest": lambda: run.ingest(batch, args.force),
        "climate-index": lambda: run.climate_index(args.commodity),
        "market-model": lambda: run.market_model(args.commodity),
        "hedge": lambda: run.hedge(args.commodity, **wanted),
        "report": run.report,
        "full-run": lambda: run.full(batch, args.commodity, args.force, **wanted),
    }
    steps[args.step]()


if __name__ == "__main__":
    main()
