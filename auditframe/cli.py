"""Command line: profile a source, store the run, write a report."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .models import CleansingConfig, ConnectionConfig, PipelineConfig
from .operators.cleanse import apply_cleansing
from .operators.profile import table_completeness
from .report import bucket


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="auditframe")
    run = p.add_subparsers(dest="command", required=True).add_parser("profile")
    run.add_argument("--source", required=True, help="folder of tables, catalog:<database> or jdbc: url")
    run.add_argument("--schema", action="append", default=[])
    run.add_argument("--rules", action="append", default=[])
    run.add_argument("--store")
    run.add_argument("--report-dir", default="reports")
    run.add_argument("--config", help="file with include/exclude lists and rule files")
    run.add_argument("--connection-id", default="default")
    how = run.add_mutually_exclusive_group()
    how.add_argument("--dry-run", action="store_true", default=True, help="change nothing (the default)")
    how.add_argument("--commit", dest="dry_run", action="store_false", help="apply the cleansing of the configuration and write its tables under --output")
    run.add_argument("--output", help="folder for the tables of a committed cleansing")
    return p


def print_summary(result) -> None:
    """Tables with their completeness, then issues from the end of the alphabet of severities, on standard error."""
    rows = table_completeness(result.profiles).orderBy("schema_name", "table_name").collect()
    print(f"run {result.run_id}: {result.status}, {len(rows)} tables", file=sys.stderr)
    for row in rows:
        print(f"{row.schema_name}.{row.table_name:30} {100 * row.score:5.1f} % {bucket(row.score, 0.9, 0.7)}", file=sys.stderr)
    for row in result.issues.orderBy(F.desc("severity"), "table_name", "column_name").collect():
        print(f"{row.severity:9}{row.message}", file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        from .config import expand_env, read_mapping

        data = expand_env(read_mapping(args.config)) if args.config else {}
        data = dict(data.get("pipeline", data))
        data["rule_files"] = [*data.get("rule_files", []), *args.rules]
        data["include_schemas"] = [*data.get("include_schemas", []), *args.schema]
        data["connection_id"] = args.connection_id
        spark = spark or SparkSession.builder.appName("auditframe").getOrCreate()
        engine = Engine(spark, ConnectionConfig(args.connection_id, args.source), PipelineConfig.from_mapping(data), args.store, args.report_dir)
        result, report = engine.run()
        changes = None
        if configs := [CleansingConfig.from_mapping(c) for c in data.get("cleansing") or []]:
            changes = apply_cleansing(spark, result.run_id, engine.connection, engine.tables(sampled=False), configs, data.get("keys") or {}, args.dry_run, args.output, data.get("max_affected_rows"))
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    print_summary(result)
    if changes is not None:
        print(f"cleansing: {changes.total_changes} changes in {changes.tables_affected} tables" + "".join(f"; {e}" for e in changes.errors), file=sys.stderr)
    print(report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
