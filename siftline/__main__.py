"""The command line: scan, capabilities, health, verify-offline, validate-config, validate-rules, storage."""

from __future__ import annotations

import argparse
import json
import sys

from . import config, engine, offline
from .operators import lifecycle
from .plans import modes
from .schemas import PROFILES


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("siftline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _say(value: object) -> None:
    print(json.dumps(value, indent=2, sort_keys=True, default=str))


def _scan(args: argparse.Namespace) -> None:
    offline.reject_remote(args.path, config.load()["offline"]["strict"])
    spark = _spark()
    texts = spark.read.parquet(args.path)
    got = engine.scan(texts, args.id, args.text, profiles=[args.profile], mode=args.mode)
    reports = engine.reports(got)
    if args.output:
        reports.select("report").write.mode("errorifexists").text(args.output)
    else:
        for row in reports.toLocalIterator():
            print(row.report)


def _storage(args: argparse.Namespace) -> None:
    """The store's tables are folders under the configured data folder: files, artifacts, release_grants, reports."""
    from pyspark.sql import functions as F

    settings = config.load()
    spark, at = _spark(), settings["data_dir"].rstrip("/")
    files = spark.read.parquet(f"{at}/files")
    _say({"before": lifecycle.usage(files, ["objects", "reports", "forensic"], settings["storage"]["maximum_total_store_bytes"]).first().asDict()})
    if args.action == "cleanup":
        tables = {t: spark.read.parquet(f"{at}/{t}") for t in ("artifacts", "release_grants", "reports")}
        left = lifecycle.maintenance(tables, files, F.current_timestamp())
        _say({t: {"before": tables[t].count(), "after": left[t].count()} for t in tables} | {"orphans": left["orphaned_artifacts"].count(), "written": f"{at}/cleaned"})
        for name, table in left.items():
            table.write.mode("overwrite").parquet(f"{at}/cleaned/{name}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftline")
    sub = top.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="scan a Parquet table of texts")
    scan.add_argument("path")
    scan.add_argument("--id", default="doc_id")
    scan.add_argument("--text", default="text")
    scan.add_argument("--mode", choices=sorted(modes.MODES), default="fast")
    scan.add_argument("--profile", choices=PROFILES, default="AGENT_WITH_TOOLS")
    scan.add_argument("--output")
    for name in ("capabilities", "health", "verify-offline", "validate-config", "validate-rules"):
        sub.add_parser(name)
    sub.add_parser("storage").add_argument("action", choices=["status", "cleanup"])
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "scan":
            _scan(args)
        elif args.command == "storage":
            _storage(args)
        elif args.command == "capabilities":
            _say(engine.capabilities())
        elif args.command == "health":
            _say(engine.health())
        elif args.command == "verify-offline":
            _say(offline.self_test(config.load()["offline"]["strict"]))
        elif args.command == "validate-config":
            _say({"status": "ok", "configuration_hash": config.config_hash(config.load()), "policies": len(config.load_policies()), "detectors": len(config.load_registry())})
        else:
            _say({"status": "ok", "rules": len(config.load_rules())})
    except (config.ConfigurationError, offline.OfflineError) as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
