"""Row and null counts of all columns in one aggregate a table, and the metrics from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import ISSUE, METRIC, PROFILE
from ..sources.catalog import Table, column


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def profile(table: Table) -> DataFrame:
    """One row a column, counted in a single scan; a table without columns gives one row without a column name."""
    cols = table.columns
    counted = table.df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(column(c)).alias(f"c{i}") for i, (c, _, _) in enumerate(cols)])
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"), F.lit(nullable).alias("nullable"), (F.col("rows") - F.col(f"c{i}")).alias("null_count")) for i, (c, kind, nullable) in enumerate(cols)]
    if not entries:
        return _conform(counted.select(F.lit(table.schema_name).alias("schema_name"), F.lit(table.table_name).alias("table_name"), F.col("rows").alias("row_count")), PROFILE)
    flat = counted.select("rows", F.explode(F.array(*entries)).alias("e"))
    return _conform(flat.select(F.lit(table.schema_name).alias("schema_name"), F.lit(table.table_name).alias("table_name"), "e.*", F.col("rows").alias("row_count")), PROFILE)


def profile_tables(spark: SparkSession, tables: list[Table]) -> DataFrame:
    """All tables' profiles in one job."""
    return reduce(DataFrame.unionByName, map(profile, tables)) if tables else spark.createDataFrame([], PROFILE)


def completeness():
    return F.when(F.col("row_count") > 0, 1 - F.col("null_count") / F.col("row_count")).otherwise(1.0)


def profile_metrics(profiles: DataFrame, run_id: str) -> DataFrame:
    """row_count of each table and completeness of each column (1 for an empty table)."""
    tables = profiles.groupBy("schema_name", "table_name").agg(F.max("row_count").cast("double").alias("value"))
    tables = tables.select(F.lit(run_id).alias("run_id"), "schema_name", "table_name", F.lit("row_count").alias("dimension"), F.lit(1.0).alias("score"), "value", F.lit("{}").alias("metadata"))
    columns = profiles.where("column_name is not null").select(F.lit(run_id).alias("run_id"), "schema_name", "table_name", "column_name", F.lit("completeness").alias("dimension"), completeness().alias("score"), F.col("null_count").cast("double").alias("value"), F.to_json(F.struct("null_count", "row_count")).alias("metadata"))
    return _conform(tables, METRIC).unionByName(_conform(columns, METRIC))


def run_metrics(profiles: DataFrame, run_id: str) -> DataFrame:
    """table_count, column_count and the unweighted average_completeness of a run."""
    one = profiles.agg(F.count_distinct(F.struct("schema_name", "table_name")).cast("double").alias("tables"), F.count("column_name").cast("double").alias("columns"), F.coalesce(F.avg(F.when(F.col("column_name").isNotNull(), completeness())), F.lit(1.0)).alias("mean"))
    entry = lambda name, score, value: F.struct(F.lit(name).alias("dimension"), score.alias("score"), value.alias("value"))
    rows = one.select(F.explode(F.array(entry("table_count", F.lit(1.0), F.col("tables")), entry("column_count", F.lit(1.0), F.col("columns")), entry("average_completeness", F.col("mean"), F.col("mean")))).alias("m"))
    return _conform(rows.select(F.lit(run_id).alias("run_id"), "m.*", F.lit("{}").alias("metadata")), METRIC)


def completeness_issues(profiles: DataFrame, run_id: str) -> DataFrame:
    """An issue for each column with nulls: a warning, an error from one half on."""
    p = profiles.where("null_count > 0")
    share = F.col("null_count") / F.col("row_count")
    rows = p.select(
        F.concat_ws(":", F.lit(run_id), "schema_name", "table_name", "column_name", F.lit("nulls")).alias("issue_id"), F.lit(run_id).alias("run_id"), "schema_name", "table_name", "column_name",
        F.lit("completeness").alias("dimension"), F.when(share >= 0.5, "error").otherwise("warning").alias("severity"),
        F.concat(F.col("column_name"), F.lit(" holds "), "null_count", F.lit(" nulls in "), "row_count", F.lit(" rows")).alias("message"), F.to_json(F.struct("null_count", "row_count")).alias("evidence"),
    )
    return _conform(rows, ISSUE)


def table_completeness(profiles: DataFrame, ok: float = 0.95, fair: float = 0.8) -> DataFrame:
    """(schema_name, table_name, score, bucket): the unweighted mean over a table's columns."""
    per = profiles.groupBy("schema_name", "table_name").agg(F.coalesce(F.avg(F.when(F.col("column_name").isNotNull(), completeness())), F.lit(1.0)).alias("score"))
    return per.withColumn("bucket", F.when(F.col("score") >= ok, "ok").when(F.col("score") >= fair, "warn").otherwise("err"))
