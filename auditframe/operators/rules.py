"""Column rules compiled to expressions: one fused aggregate a table, and one union for uniqueness.

NOT NULL, RANGE and REGEX of all targets of a table are conditional counts in a single
scan; so is CONDITION, a SQL ``check`` for the rows that meet a SQL ``condition``.  UNIQUE
groups by its column, each distinct column once, whatever the number of rules.  REFERENCES
counts non-null values that ``ref_table`` doesn't hold in ``ref_column``.  What can't be evaluated for a column's type, or a pattern that doesn't compile,
is found before any job and gives an error row; the reasons are in ``detail``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..models import ISSUE, RULE_RUN, TARGET, RuleConfig
from ..plans.scope import targets as all_targets
from ..sources.catalog import Table, column
from .profile import _conform

KINDS = ("NOT NULL", "UNIQUE", "RANGE", "REGEX", "REFERENCES", "CONDITION")
Target = tuple[RuleConfig, Table, str]


def fault(spark: SparkSession, rule: RuleConfig, table: Table, name: str, tables: dict[str, DataFrame]) -> str | None:
    """Why a rule can't be evaluated on a column, or None."""
    kind = table.df.schema[name].dataType
    if rule.kind == "REFERENCES":
        parent, key = tables.get(rule.params.get("ref_table")), rule.params.get("ref_column")
        if parent is None or key not in parent.columns:
            return f"REFERENCES finds no column {key} of a table {rule.params.get('ref_table')}"
    if rule.kind == "CONDITION":
        if not rule.params.get("check"):
            return "CONDITION has no check"
        try:
            table.df.where(F.expr(rule.params.get("condition") or "true")).where(F.expr(rule.params["check"]))
        except PySparkException as e:
            return f"CONDITION can't be read: {str(e).splitlines()[0]}"
    if rule.kind == "RANGE":
        if rule.params.get("min") is None and rule.params.get("max") is None:
            return "RANGE has neither min nor max"
        if not isinstance(kind, T.NumericType):
            return f"RANGE needs a number, not {kind.simpleString()}"
    if rule.kind == "REGEX":
        pattern = rule.params.get("pattern")
        if not pattern:
            return "REGEX has no pattern"
        if not isinstance(kind, T.StringType):
            return f"REGEX needs a string, not {kind.simpleString()}"
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:  # noqa: BLE001  the JVM's exception type isn't known here
            return f"the pattern doesn't compile: {str(e).splitlines()[0]}"
    if rule.kind == "UNIQUE" and isinstance(kind, T.MapType | T.VariantType):
        return f"UNIQUE can't compare {kind.simpleString()}"
    return None


def violates(rule: RuleConfig, c: Column) -> Column:
    """The condition of a violating row; nulls violate NOT NULL only, bounds are inclusive, patterns match anywhere."""
    if rule.kind == "NOT NULL":
        return c.isNull()
    if rule.kind == "CONDITION":
        return F.expr(rule.params.get("condition") or "true") & ~F.expr(rule.params["check"])
    if rule.kind == "REGEX":
        return ~c.rlike(rule.params["pattern"])
    low, high = rule.params.get("min"), rule.params.get("max")
    tests = ([c < low] if low is not None else []) + ([c > high] if high is not None else [])
    return reduce(Column.__or__, tests)


def _row(rule: RuleConfig, table: Table, name: str, total: Column, violations: Column, status: Column, detail: str | None = None) -> Column:
    text = lambda x: F.lit(x).cast("string")
    return F.struct(text(rule.name).alias("rule_name"), text(rule.dimension).alias("dimension"), text(rule.severity).alias("severity"), text(rule.kind).alias("kind"), text(table.schema_name).alias("schema_name"), text(table.table_name).alias("table_name"), text(name).alias("column_name"), total.cast("long").alias("total_rows"), violations.cast("long").alias("violations"), status.alias("status"), text(detail).alias("detail"))


def _static(spark: SparkSession, rows: list[tuple[Target, str, str]]) -> DataFrame:
    data = [(r.name, r.dimension, r.severity, r.kind, t.schema_name, t.table_name, c, None, None, status, why) for (r, t, c), status, why in rows]
    return spark.createDataFrame(data, TARGET)


def evaluate(spark: SparkSession, some: list[Target], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A TARGET row for each target: status pass, fail, unknown (expression) or error.

    ``tables`` are those that REFERENCES may name; by default the targets' own.
    """
    broken, scans, uniques, references = [], {}, {}, []
    tables = tables or {t.table_name: t.df for _, t, _ in some}
    for target in some:
        rule, table, name = target
        if rule.kind not in KINDS:
            broken.append((target, "unknown", f"unknown expression {rule.expression!r}"))
        elif why := fault(spark, rule, table, name, tables):
            broken.append((target, "error", why))
        elif rule.kind == "REFERENCES":
            references.append(target)
        elif rule.kind == "UNIQUE":
            uniques.setdefault((id(table), name), []).append(target)
        else:
            scans.setdefault(id(table), []).append(target)
    frames = [_static(spark, broken)] if broken else []
    for group in scans.values():
        counted = group[0][1].df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(violates(r, column(c))).alias(f"v{i}") for i, (r, _, c) in enumerate(group)])
        frames.append(_unfold(counted, group))
    for group in uniques.values():
        _, table, name = group[0]
        each = table.df.select(column(name).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
        counted = each.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias(f"v{i}") for i in range(len(group))])
        frames.append(_unfold(counted, group))
    for target in references:
        rule, table, name = target
        values = table.df.select(column(name).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
        parent = tables[rule.params["ref_table"]].select(column(rule.params["ref_column"]).alias("p")).distinct()
        held = values.join(parent, F.col("v") == F.col("p"), "left")
        counted = held.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("k"))), F.lit(0)).alias("v0"))
        frames.append(_unfold(counted, [target]))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], TARGET)


def _unfold(counted: DataFrame, group: list[Target]) -> DataFrame:
    rows = [_row(r, t, c, F.col("n"), F.col(f"v{i}"), F.when(F.col(f"v{i}") > 0, "fail").otherwise("pass")) for i, (r, t, c) in enumerate(group)]
    return _conform(counted.select(F.explode(F.array(*rows)).alias("t")).select("t.*"), TARGET)


def evaluate_safely(spark: SparkSession, some: list[Target], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """evaluate(), run now; if the job fails, target by target, with the failing ones as errors.

    The result has one row a target and is held by the driver.
    """
    try:
        return spark.createDataFrame(evaluate(spark, some, tables).collect(), TARGET)
    except PySparkException:
        rows = []
        for target in some:
            try:
                rows += evaluate(spark, [target], tables).collect()
            except PySparkException as e:
                rows += _static(spark, [(target, "error", str(e).splitlines()[0])]).collect()
        return spark.createDataFrame(rows, TARGET)


def issues(results: DataFrame, run_id: str) -> DataFrame:
    """An issue for each target that isn't passed; unknown and error have severity error."""
    bad = results.where("status <> 'pass'")
    place = F.concat_ws(".", "schema_name", "table_name", "column_name")
    message = F.when(F.col("status") == "error", F.concat(F.col("rule_name"), F.lit(": evaluation error on "), place, F.lit(": "), F.col("detail"))).when(F.col("status") == "unknown", F.concat(F.col("rule_name"), F.lit(": "), F.col("detail"))).otherwise(F.concat(F.col("rule_name"), F.lit(": "), F.col("violations"), F.lit(" of "), F.col("total_rows"), F.lit(" rows of "), place))
    key = F.when(F.col("kind") == "NOT NULL", "null_count").when(F.col("kind") == "UNIQUE", "duplicate_extra_rows").otherwise("violations")
    evidence = F.when(F.col("status") == "fail", F.to_json(F.map_from_arrays(F.array(key, F.lit("total_rows")), F.array("violations", "total_rows")))).otherwise(F.to_json(F.struct(F.col("detail").alias("error"))))
    rows = bad.select(F.concat_ws(":", F.lit(run_id), "rule_name", "schema_name", "table_name", "column_name").alias("issue_id"), F.lit(run_id).alias("run_id"), "schema_name", "table_name", "column_name", "dimension", F.when(F.col("status") == "fail", F.col("severity")).otherwise("error").alias("severity"), message.alias("message"), evidence.alias("evidence"), "rule_name")
    return _conform(rows, ISSUE)


def summaries(spark: SparkSession, rules: list[RuleConfig], results: DataFrame, run_id: str) -> DataFrame:
    """Targets checked, failed and in error of every rule, with or without targets."""
    names = spark.createDataFrame([(i, r.name) for i, r in enumerate(rules)], "at int, rule_name string")
    per = results.groupBy("rule_name").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status").isin("fail", "unknown")).alias("failed"), F.count_if(F.col("status") == "error").alias("error"))
    rows = names.join(per, "rule_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return _conform(rows.select(F.lit(run_id).alias("run_id"), "rule_name", zero("checked").alias("targets_checked"), zero("failed").alias("targets_failed"), zero("error").alias("targets_error")), RULE_RUN)


def apply_rules(spark: SparkSession, run_id: str, rules: list[RuleConfig], tables: list[Table]) -> tuple[DataFrame, DataFrame]:
    """(issues, summaries) of all rules on all columns in their scope."""
    if not rules or not tables:
        return spark.createDataFrame([], ISSUE), spark.createDataFrame([], RULE_RUN)
    results = evaluate_safely(spark, all_targets(rules, tables), {t.table_name: t.df for t in tables})
    return issues(results, run_id), summaries(spark, rules, results, run_id)


def evidence(issue_json: str) -> dict:
    return json.loads(issue_json)
