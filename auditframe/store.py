"""Run history: append-only Parquet tables, partitioned by run but for the runs themselves, and the reads on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import ISSUE, METRIC, RULE_RUN, RUN
from .operators.extra import drift
from .operators.profile import _conform
from .sources.catalog import column

_KEYS = {"runs": ["run_id"], "metrics": ["run_id", "schema_name", "table_name", "column_name", "dimension"], "issues": ["issue_id"], "rule_runs": ["run_id", "rule_name"]}
_SCHEMAS = {"runs": RUN, "metrics": METRIC, "issues": ISSUE, "rule_runs": RULE_RUN}
_PARTITIONED = ("metrics", "issues", "rule_runs")
_PART, _BUCKETS = 64 << 20, 1 << 16


def _weighed(rows: DataFrame, names: list[str]) -> tuple[int, list[int]]:
    """The bytes of rows, texts and bytes at their lengths, and the buckets of keys (of ``_BUCKETS``) that are too many for one task."""
    texts = [column(f.name) for f in rows.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    nested = sum(isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType) for f in rows.schema)
    each = reduce(Column.__add__, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts], F.lit(32 + 8 * len(rows.columns) + 256 * nested).cast("long"))
    buckets = rows.select(_bucket(names).alias("b"), each.alias("n")).groupBy("b").agg(F.sum("n").alias("n"))
    total = buckets.agg(F.sum("n").alias("total"))
    large = buckets.where(F.col("n") > _PART).crossJoin(F.broadcast(total)).where(F.col("n") > 16 / _BUCKETS * F.col("total"))
    row = total.crossJoin(large.agg(F.collect_list("b").alias("hot"))).first()
    return row.total or 0, row.hot


def _bucket(names: list[str]) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(_BUCKETS))


def insert_absent(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of batch whose key isn't stored yet, one of each key: the first by ``order``, any if none is given.

    Nulls in a key are equal, and equal to empty texts, which come first where order
    doesn't decide.  Stored keys and batch are weighed first, then dealt by key into
    partitions of bounded bytes and sorted, a stored key before the batch's rows; keys with
    very many rows are reduced before they move.  So both are read twice, or three times.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    coalesced = dict(zip(names, [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    # a text isn't carried twice, but given back from the coalesced one and a mark for null, unless order may need it
    plain = all(isinstance(o, str) for o in order or [])
    asked = {o.strip("`").lower() for o in order or []} if plain else set()
    kinds = {f.name: f.dataType for f in batch.schema}
    texts = {k: i for i, k in enumerate(keys[:62]) if plain and kinds.get(k) == T.StringType() and k.lower() not in asked}
    marks = reduce(Column.__add__, [F.when(F.col(k).isNull(), 1 << i).otherwise(0).cast("long") for k, i in texts.items()], F.lit(0).cast("long"))
    new = batch.select(*[c.alias(n) for n, c in coalesced.items()], marks.alias("__nulls"), *[column(c) for c in batch.columns if c not in texts])
    old = stored.select(*[c.alias(n) for n, c in coalesced.items()], F.lit(-1).cast("long").alias("__nulls"))
    both = new.unionByName(old, allowMissingColumns=True)

    total, hot = _weighed(both, names)
    cores = batch.sparkSession.sparkContext.defaultParallelism
    # up to 200 partitions a shuffle writes without sorting
    n = max(1, min(cores, total >> 20), min(total // _PART, 200), total // (4 * _PART))
    first = F.row_number().over(Window.partitionBy(*names).orderBy(F.col("__nulls") >= 0, *(order or []), "__nulls"))
    kept_of = lambda df: df.withColumn("__n", first).where("__n = 1 and __nulls >= 0").drop("__n")
    if hot:
        some = both.where(_bucket(names).isin(hot))
        # the planner reduces these before the shuffle: keys alone by hash, else by a sort of each task's rows
        reduced = some.groupBy(*names).agg(F.min("__nulls").alias("__nulls")).where("__nulls >= 0") if not order and len(texts) == len(batch.columns) else kept_of(some)
        kept = kept_of(both.where(~_bucket(names).isin(hot)).repartition(n, *names)).unionByName(reduced)
    else:
        kept = kept_of(both.repartition(n, *names))
    back = lambda i: F.when(F.col("__nulls").bitwiseAND(F.lit(1 << i)) == 0, F.col(names[i]))
    return kept.select(*[back(texts[c]).alias(c) if c in texts else column(c) for c in batch.columns])


def latest(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)


def ranked(severity: str = "severity"):
    return F.array_position(F.array(*map(F.lit, ("info", "warning", "error", "critical"))), F.col(severity))


def decoded(df: DataFrame, name: str) -> DataFrame:
    """A JSON column read as a map from names to values; what isn't a JSON object becomes null."""
    return df.withColumn(name, F.from_json(name, "map<string,string>"))


def metrics_of(metrics: DataFrame) -> DataFrame:
    return decoded(metrics, "metadata").orderBy("schema_name", "table_name", "column_name", "dimension")


def issues_of(issues: DataFrame, by_rank: bool = False) -> DataFrame:
    """By severity from the end of the alphabet, or by its rank, then table and column."""
    return decoded(issues, "evidence").orderBy(ranked().desc() if by_rank else F.desc("severity"), "table_name", "column_name", "issue_id")


class RunStore:
    """The history under one folder.  Connection strings are never stored."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        writer = df.write.mode(mode)
        (writer.partitionBy("run_id") if name in _PARTITIONED else writer).parquet(self._path(name))

    def init_schema(self) -> None:
        for name, schema in _SCHEMAS.items():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
            if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
                self._write(name, self.spark.createDataFrame([], schema), "ignore")

    def table(self, name: str) -> DataFrame:
        """A table; a filter on run_id reads that run's folder only."""
        return self.spark.read.schema(_SCHEMAS[name]).parquet(self._path(name)).select(*_SCHEMAS[name].names)

    def _append(self, name: str, batch: DataFrame, run_id: str) -> None:
        batch = _conform(batch, _SCHEMAS[name])
        if name == "metrics":
            batch = batch.where("score is not null and not isnan(score)")
        self._write(name, insert_absent(self.table(name).where(F.col("run_id") == run_id), batch, _KEYS[name]), "append")

    def save_run(self, result) -> None:
        """Append what isn't stored yet; saving twice adds nothing.

        An issue of another run is a ValueError, with nothing written.  The run's own row
        comes last, so a run that is listed is whole.
        """
        if result.issues.where(~F.col("run_id").eqNullSafe(F.lit(result.run_id))).take(1):
            raise ValueError(f"an issue of run {result.run_id} names another run")
        self.init_schema()
        self._append("metrics", result.metrics.withColumn("run_id", F.lit(result.run_id)), result.run_id)
        self._append("issues", result.issues, result.run_id)
        self._append("rule_runs", result.rule_runs.withColumn("run_id", F.lit(result.run_id)), result.run_id)
        self._append("runs", result.run_frame(self.spark), result.run_id)

    def _where(self, df: DataFrame, **filters) -> DataFrame:
        for name, value in filters.items():
            if value is not None:
                df = df.where(F.col(name) == value)
        return df

    def load_runs(self, connection_id: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
        return latest(self._where(self.table("runs"), connection_id=connection_id, status=status), limit)

    def load_metrics(self, run_id: str, table_name: str | None = None, dimension: str | None = None) -> DataFrame:
        """A run's metrics in order, with their metadata as maps."""
        return metrics_of(self._where(self.table("metrics"), run_id=run_id, table_name=table_name, dimension=dimension))

    def load_issues(self, run_id: str, severity: str | None = None, table_name: str | None = None, by_rank: bool = False) -> DataFrame:
        """A run's issues in order, with their evidence as maps."""
        return issues_of(self._where(self.table("issues"), run_id=run_id, severity=severity, table_name=table_name), by_rank)

    def load_rule_runs(self, run_id: str) -> DataFrame:
        return self._where(self.table("rule_runs"), run_id=run_id).orderBy("rule_name")

    def drift(self, runs: int = 7, least: int = 3) -> DataFrame:
        """Each stored score against those of the runs before it on the same connection (:func:`operators.extra.drift`)."""
        at = self.table("runs").select("run_id", "connection_id", "started_at")
        place = ["connection_id", "schema_name", "table_name", "column_name", "dimension"]
        return drift(self.table("metrics").join(at, "run_id"), place, "started_at", "score", runs, least)

    def run_summaries(self) -> DataFrame:
        return run_summaries(self.table("runs"), self.table("metrics"), self.table("issues"))

    def get_run_summary(self, run_id: str) -> dict:
        one = lambda name: self._where(self.table(name), run_id=run_id)
        row = run_summaries(one("runs"), one("metrics"), one("issues")).first()
        return row.asDict() if row else {"error": f"no run {run_id}"}

    def list_tables(self, run_id: str) -> list[str]:
        return [r[0] for r in tables_of(self.table("metrics").where(F.col("run_id") == run_id)).collect()]


def run_summaries(runs: DataFrame, metrics: DataFrame, issues: DataFrame) -> DataFrame:
    """Each run with its numbers of metrics and issues and the mean completeness."""
    m = metrics.groupBy("run_id").agg(F.count(F.lit(1)).alias("metric_count"), F.avg(F.when(F.col("dimension") == "completeness", F.col("score"))).alias("overall_completeness"))
    i = issues.groupBy("run_id").agg(F.count(F.lit(1)).alias("issue_count"))
    out = runs.join(m, "run_id", "left").join(i, "run_id", "left")
    return out.withColumns({"metric_count": F.coalesce("metric_count", F.lit(0)), "issue_count": F.coalesce("issue_count", F.lit(0))})


def tables_of(metrics: DataFrame) -> DataFrame:
    return metrics.where("coalesce(table_name, '') <> ''").select("table_name").distinct().orderBy("table_name")
