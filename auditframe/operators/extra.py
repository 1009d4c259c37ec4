"""Checks that go beyond column rules: statistics, references, patterns of nulls, drift, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..models import SamplingConfig
from ..sources.catalog import column


def column_stats(df: DataFrame, names: list[str], exact: bool = False) -> DataFrame:
    """(column_name, min_value, max_value, mean_value, approx_distinct) of numeric columns, in one scan; ``exact`` counts distinct values exactly, at the cost of a shuffle of them."""
    aggs, distinct = [], F.count_distinct if exact else F.approx_count_distinct
    for i, c in enumerate(names):
        x = column(c).cast("double") + F.lit(0.0)
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"m{i}"), distinct(column(c)).alias(f"d{i}")]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value"), F.col(f"m{i}").alias("mean_value"), F.col(f"d{i}").alias("distinct_values" if exact else "approx_distinct")) for i, c in enumerate(names)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose non-null foreign key has no parent."""
    return child.where(column(foreign_key).isNotNull()).join(parent.select(column(key).alias("__key")), column(foreign_key) == F.col("__key"), "left_anti")


def outside_domain(df: DataFrame, name: str, domain: DataFrame, value: str) -> DataFrame:
    """(value, rows) of the non-null values that the domain doesn't list; counted before the join."""
    return df.where(column(name).isNotNull()).groupBy(column(name).alias("value")).agg(F.count(F.lit(1)).alias("rows")).join(domain.select(column(value).alias("value")), "value", "left_anti")


def null_patterns(df: DataFrame, names: list[str]) -> DataFrame:
    """(pattern, rows): which of the columns are null together, as their names joined by commas."""
    marks = F.concat_ws(",", *[F.when(column(c).isNull(), F.lit(c)) for c in names])
    return df.groupBy(marks.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def conditional(df: DataFrame, condition: Column, check: Column) -> DataFrame:
    """(total_rows, violations) among the rows that meet the condition; an unknown check is no violation."""
    return df.where(condition).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~check).alias("violations"))


def drift(history: DataFrame, keys: list[str], at: str, value: str, runs: int = 7, least: int = 3) -> DataFrame:
    """Each value with mean, deviation and z-score against the runs before it; null with fewer than ``least``."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(-runs, -1)
    n, mean, dev = F.count(value).over(before), F.avg(value).over(before), F.stddev_samp(value).over(before)
    out = history.withColumns({"base_mean": F.when(n >= least, mean), "base_dev": F.when(n >= least, dev)})
    return out.withColumn("z", F.when(F.col("base_dev") > 0, (F.col(value) - F.col("base_mean")) / F.col("base_dev")))


def below_thresholds(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Metrics whose score is under their dimension's threshold."""
    if not thresholds:
        return metrics.withColumn("threshold", F.lit(None).cast("double")).where("false")
    t = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in (pair[0], float(pair[1]))])
    return metrics.withColumn("threshold", F.element_at(t, F.col("dimension"))).where("score < threshold")


def lateness(df: DataFrame, at: str, group: list[str], reference: str | None = None, allowed: str = "1 day") -> DataFrame:
    """(group, latest, rows) and, given a reference time, (age_seconds, late): how fresh each group is."""
    out = df.groupBy(*group).agg(F.max(at).alias("latest"), F.count(F.lit(1)).alias("rows"))
    if reference is None:
        return out
    by = F.to_timestamp_ntz(F.lit(reference))
    latest = F.col("latest").cast("timestamp_ntz")
    return out.withColumns({"age_seconds": F.timestamp_diff("SECOND", latest, by), "late": latest < by - F.expr(f"INTERVAL {allowed}")})


def inconsistent(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(check_name, total_rows, violations) of conditions over several columns, as SQL, in one scan; an unknown one is no violation."""
    aggs = [F.count_if(~F.expr(sql)).alias(f"v{i}") for i, sql in enumerate(checks.values())]
    rows = [F.struct(F.lit(name).alias("check_name"), F.col("n").alias("total_rows"), F.col(f"v{i}").alias("violations")) for i, name in enumerate(checks)]
    return df.agg(F.count(F.lit(1)).alias("n"), *aggs).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


SEMANTIC_TYPES = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "url": r"^[a-z][a-z0-9+.-]*://\S+$", "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "integer": r"^[+-]?[0-9]+$", "decimal": r"^[+-]?[0-9]+[.][0-9]+$", "phone": r"^[+]?[0-9][0-9 ()/-]{6,18}[0-9]$",
}


def semantic_types(df: DataFrame, names: list[str], least: float = 0.9) -> DataFrame:
    """(column_name, semantic_type, match_rate) of string columns, in one scan: the type that most non-null values match, if ``least`` of them do."""
    aggs = [F.count_if(column(c).rlike(p)).alias(f"m{i}_{k}") for i, c in enumerate(names) for k, p in enumerate(SEMANTIC_TYPES.values())]
    counted = df.agg(*[F.count(column(c)).alias(f"n{i}") for i, c in enumerate(names)], *aggs)
    rows = []
    for i, c in enumerate(names):
        # of equal counts the type named first
        best = F.array_max(F.array(*[F.struct(F.col(f"m{i}_{k}").alias("m"), F.lit(-k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(SEMANTIC_TYPES)]))
        rate = F.try_divide(best["m"], F.col(f"n{i}"))
        rows.append(F.struct(F.lit(c).alias("column_name"), F.when(rate >= least, best["t"]).alias("semantic_type"), rate.alias("match_rate")))
    return counted.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def sample(df: DataFrame, config: SamplingConfig) -> DataFrame:
    """The sampled rows: a feature of its own, no other operator reads less than whole tables."""
    keys = config.keys or df.columns
    if config.method == "first_n":
        return df.orderBy(*map(column, keys)).limit(config.limit)
    chance = F.md5(F.concat_ws("|", F.lit(str(config.seed)), *[F.coalesce(column(k).cast("string"), F.lit("")) for k in keys]))
    return df.orderBy(chance, *map(column, keys)).limit(config.limit)


def revert(cleansed: DataFrame, changes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The column's earlier values put back from a change log (standardize or lookup_correct)."""
    log = changes.where(F.col("column_name") == name).select(F.col("row_key").alias("__key"), F.struct(F.col("before_value").alias("was")).alias("__was"))
    keyed = cleansed.withColumn("__key", F.to_json(F.struct(*map(column, keys)))).join(log, "__key", "left")
    was = F.col("__was.was").cast(cleansed.schema[name].dataType)
    return keyed.withColumn(name, F.when(F.col("__was").isNotNull(), was).otherwise(column(name))).select(*map(column, cleansed.columns))


def restore_rows(cleansed: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows that deduplicate removed, put back from its change log."""
    gone = changes.where("operation = 'deduplicate'").select(F.from_json("before_value", cleansed.schema).alias("r")).select("r.*")
    return cleansed.unionByName(gone)
