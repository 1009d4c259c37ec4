"""One run: discover, profile, diagnose, apply rules, summarise, store, report."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import expand_env, load_rules, read_mapping
from .models import ISSUE, METRIC, PROFILE, RULE_RUN, RUN, ConnectionConfig, PipelineConfig, RuleConfig
from .operators import extra, profile, rules
from .report import write_report
from .sources.catalog import Table, discover, select_tables
from .store import RunStore

log = logging.getLogger(__name__)


@dataclass
class RunResult:
    run_id: str
    connection_id: str
    started_at: datetime
    ended_at: datetime | None
    status: str
    tables: list[Table]
    profiles: DataFrame
    metrics: DataFrame
    issues: DataFrame
    rule_runs: DataFrame
    analyses: dict[str, DataFrame] = field(default_factory=dict)

    def run_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.run_id, self.connection_id, self.started_at, self.ended_at, self.status)], RUN)

    def tree(self) -> DataFrame:
        """(schema_name, table_name, row_count, columns, metrics, issues): a table's columns, each with its own metrics and issues, and those of the table itself."""
        place, metric, issue = ["schema_name", "table_name"], F.struct("dimension", "score", "value"), F.struct("dimension", "severity", "rule_name", "message")

        def gathered(df: DataFrame, what: Column, name: str, of_columns: bool) -> DataFrame:
            by = [*place, "column_name"] if of_columns else place
            return df.where(F.col("column_name").isNotNull() if of_columns else F.col("column_name").isNull()).groupBy(*by).agg(F.sort_array(F.collect_list(what)).alias(name))

        cols = self.profiles
        for df, what, name in ((self.metrics, metric, "metrics"), (self.issues, issue, "issues")):
            cols = cols.join(gathered(df, what, name, True), [*place, "column_name"], "left")
        entry = F.when(F.col("column_name").isNotNull(), F.struct("column_name", "data_type", "nullable", "null_count", "metrics", "issues"))
        out = cols.groupBy(*place).agg(F.max("row_count").alias("row_count"), F.sort_array(F.collect_list(entry)).alias("columns"))
        for df, what, name in ((self.metrics, metric, "metrics"), (self.issues, issue, "issues")):
            out = out.join(gathered(df, what, name, False), place, "left")
        return out


def cleanse(result: RunResult) -> RunResult:
    """Part of a run by contract; a run never changes data."""
    return result


def monitor(metrics: DataFrame) -> DataFrame:
    """Part of a run by contract; drift over stored runs is operators.extra.drift."""
    return metrics


def build_result(spark: SparkSession, tables: list[Table], run_id: str, some_rules: list[RuleConfig], thresholds: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(profiles, metrics, issues, rule_runs).

    The profiles are one row a column; they are computed once and kept by the driver.
    """
    profiles = spark.createDataFrame(profile.profile_tables(spark, tables).collect(), PROFILE)
    found, runs = rules.apply_rules(spark, run_id, some_rules, tables)
    issues = profile.completeness_issues(profiles, run_id).unionByName(found)
    metrics = monitor(profile.profile_metrics(profiles, run_id).unionByName(profile.run_metrics(profiles, run_id)))
    if thresholds:
        low = extra.below_thresholds(metrics, thresholds)
        rows = low.select(F.concat_ws(":", "run_id", "schema_name", "table_name", "column_name", "dimension", F.lit("threshold")).alias("issue_id"), "run_id", "schema_name", "table_name", "column_name", "dimension", F.lit("warning").alias("severity"), F.concat("dimension", F.lit(" is "), F.round("score", 4), F.lit(", under "), "threshold").alias("message"), F.to_json(F.struct("score", "threshold")).alias("evidence"))
        issues = issues.unionByName(profile._conform(rows, ISSUE))
    return profiles, profile._conform(metrics, METRIC), issues, runs


class Engine:
    def __init__(self, spark: SparkSession, connection: ConnectionConfig, config: PipelineConfig | None = None, store: str | None = None, report_dir: str | None = None, analyses: dict[str, Callable[[SparkSession, list[Table]], DataFrame]] | None = None):
        self.analyses = analyses or {}
        self.spark, self.connection, self.config = spark, connection, config or PipelineConfig(connection.id)
        self.store, self.report_dir = store, report_dir

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, connection_id: str = "default", config: PipelineConfig | None = None, **places) -> Engine:
        return cls(spark, ConnectionConfig(connection_id, path), config, **places)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, **places) -> Engine:
        """From a file with ``connection`` and ``pipeline`` sections, or a flat one."""
        data = expand_env(read_mapping(path))
        flat = {"id": "default", **data}
        return cls(spark, ConnectionConfig.from_mapping(data.get("connection", flat)), PipelineConfig.from_mapping(data.get("pipeline", flat)), **places)

    def rules(self) -> list[RuleConfig]:
        """The rules of all files one after the other; a missing file is a warning."""
        out: list[RuleConfig] = []
        for path in self.config.rule_files:
            if Path(path).exists():
                out += load_rules(path)
            else:
                log.warning("rule file %s doesn't exist", path)
        return out

    def tables(self, sampled: bool = True) -> list[Table]:
        """The tables in scope, or a sample of each if the configuration asks for one."""
        found = select_tables(discover(self.spark, self.connection), self.config)
        how = self.config.sampling
        return [Table(t.schema_name, t.table_name, extra.sample(t.df, how)) for t in found] if how and sampled else found

    def run(self) -> tuple[RunResult, str | None]:
        """The run's result and its report.

        Its status is ``partial`` if a rule couldn't be evaluated somewhere; a run that
        breaks off is stored as ``failed``, with nothing but its times, and raises.
        """
        run_id, started = f"run-{uuid.uuid4().hex[:8]}", datetime.now(UTC)
        try:
            tables = self.tables()
            parts = build_result(self.spark, tables, run_id, self.rules(), self.config.metric_thresholds)
            result = cleanse(RunResult(run_id, self.connection.id, started, None, "success", tables, *parts))
            if result.rule_runs.where("targets_error > 0").take(1):
                result.status = "partial"
            result.analyses = {name: analyse(self.spark, tables) for name, analyse in self.analyses.items()}
        except Exception:
            if self.store:
                empty = [self.spark.createDataFrame([], s) for s in (PROFILE, METRIC, ISSUE, RULE_RUN)]
                RunStore(self.spark, self.store).save_run(RunResult(run_id, self.connection.id, started, datetime.now(UTC), "failed", [], *empty))
            raise
        result.ended_at = datetime.now(UTC)
        if self.store:
            RunStore(self.spark, self.store).save_run(result)
        report = write_report(result, f"{self.report_dir}/report-{run_id}.html")["report_path"] if self.report_dir else None
        return result, report
