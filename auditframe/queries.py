"""The engine's operators as queries over the test tables, each with DuckDB SQL for the same rows.

The tables are clean, so most checks run over ``dirty``, a view of ``customer`` with
defects planted by the same SQL text in both engines.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import RunResult
from .models import ISSUE, METRIC, PROFILE, CleansingConfig, ConnectionConfig, RuleConfig, RuleScope, SamplingConfig
from .operators import cleanse, extra, profile, rules
from .plans.scope import in_scope, targets
from .sources.catalog import Table, columns_frame, discover
from .store import RunStore, insert_absent, issues_of, latest, run_summaries, tables_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIRTY = """SELECT c_custkey AS row_key,
 CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_custkey END AS id,
 CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'not_an_email'
      WHEN c_custkey % 7 = 0 THEN concat('  User', CAST(c_custkey % 50 AS STRING), '@Example.COM ')
      ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
 c_acctbal AS balance,
 CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN concat(' ', c_mktsegment)
      WHEN 2 THEN c_mktsegment ELSE concat(c_mktsegment, '   x') END AS segment,
 CASE WHEN c_custkey % 2 = 0 THEN c_name END AS nickname FROM customer"""
DUPS = f"""SELECT row_key, CASE WHEN row_key % 10 = 0 THEN NULL ELSE concat('k', CAST(row_key % 100 AS STRING)) END AS k1,
 row_key % 3 AS k2, balance FROM ({DIRTY})"""
SEGMAP = """SELECT * FROM (VALUES (1,'BUILDING','building'),(2,'building','building'),(3,'AUTOMOBILE','auto'),(4,'AUTOMOBILE','car'),
 (5,'MACHINERY',CAST(NULL AS STRING)),(6,CAST(NULL AS STRING),'none')) AS v(ord, from_value, to_value)"""
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
TABLES = {
    "benchmark": "item_id text", "conversations": "conv_id turn role text", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "events": "event_id ts user_id event_type value props", "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "pages": "page_id url html", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "region": "r_regionkey r_name", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer")) if "FROM customer" in sql else spark.sql(sql)


def dirty(spark: SparkSession, sf_dir: str) -> Table:
    return Table("main", "dirty", _view(spark, sf_dir, DIRTY))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(dirty(spark, sf_dir))


_COLS = ["row_key", "id", "email", "balance", "segment", "nickname"]
_NULLS = f"WITH dirty AS ({DIRTY}), p AS (" + " UNION ALL ".join(f"SELECT 'dirty' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count FROM dirty" for c in _COLS) + ") "


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count FROM {t}" for t, cols in TABLES.items() for c in cols.split()))
def profile_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [t for t in discover(spark, ConnectionConfig("test", sf_dir)) if t.table_name in TABLES]
    return profile.profile_tables(spark, tables).select("table_name", "column_name", "row_count", "null_count")


@query(_NULLS + "SELECT * FROM p")
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).select("table_name", "column_name", "row_count", "null_count")


@query(_NULLS + "SELECT column_name, 'completeness' AS dimension, round(1.0::DOUBLE - null_count::DOUBLE / row_count, 6) AS score, null_count::DOUBLE AS value FROM p UNION ALL SELECT NULL, 'row_count', 1.0::DOUBLE, max(row_count)::DOUBLE FROM p")
def completeness_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_metrics(_profile(spark, sf_dir), "r").select("column_name", "dimension", F.round("score", 6).alias("score"), "value")


@query(_NULLS + "SELECT 'table_count' AS dimension, 1.0::DOUBLE AS score, 1.0::DOUBLE AS value UNION ALL SELECT 'column_count', 1.0::DOUBLE, count(*)::DOUBLE FROM p UNION ALL SELECT 'average_completeness', round(avg(1.0::DOUBLE - null_count::DOUBLE / row_count), 6), round(avg(1.0::DOUBLE - null_count::DOUBLE / row_count), 6) FROM p")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.run_metrics(_profile(spark, sf_dir), "r").select("dimension", F.round("score", 6).alias("score"), F.round("value", 6).alias("value"))


@query(_NULLS + "SELECT concat('r:main:dirty:', column_name, ':nulls') AS issue_id, column_name, null_count, CASE WHEN null_count::DOUBLE / row_count >= 0.5 THEN 'error' ELSE 'warning' END AS severity FROM p WHERE null_count > 0")
def diag_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.completeness_issues(_profile(spark, sf_dir), "r").select("issue_id", "column_name", F.get_json_object("evidence", "$.null_count").cast("long").alias("null_count"), "severity")


@query(_NULLS + "SELECT table_name, round(avg(1.0::DOUBLE - null_count::DOUBLE / row_count), 6) AS score, CASE WHEN avg(1.0::DOUBLE - null_count::DOUBLE / row_count) >= 0.95 THEN 'ok' WHEN avg(1.0::DOUBLE - null_count::DOUBLE / row_count) >= 0.8 THEN 'warn' ELSE 'err' END AS bucket FROM p GROUP BY table_name")
def table_avg_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_completeness(_profile(spark, sf_dir)).select("table_name", F.round("score", 6).alias("score"), "bucket")


def _rule(name: str, expression: str, column: str, table: str | None = None, **params) -> RuleConfig:
    return RuleConfig(name, expression, scope=RuleScope(None, table, column), params=params)


RULES = [
    _rule("email_given", "NOT NULL", "email"), _rule("ids_given", "not null", "*id"), _rule("email_unique", "UNIQUE", "email"), _rule("balance_range", "RANGE", "balance", min=0, max=5000),
    _rule("balance_min", "RANGE", "balance", min=0), _rule("balance_max", "RANGE", "balance", max=9000.5), _rule("email_form", "REGEX", "email", pattern=EMAIL),
    _rule("no_such", "not_null", "email"), _rule("no_bounds", "RANGE", "balance"), _rule("text_range", "RANGE", "segment", min=1), _rule("bad_pattern", "REGEX", "email", pattern="("), _rule("no_target", "UNIQUE", "nothing*"),
]


def _rule_results(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    some = [r for r in RULES if not names or r.name in names]
    return rules.evaluate(spark, targets(some, [dirty(spark, sf_dir)]))


_D = f"WITH dirty AS ({DIRTY}) "
_SINGLE = {
    "rule_not_null": ("email_given", "SELECT 'email' AS column_name, count(*) AS total_rows, count(*) - count(email) AS violations FROM dirty"),
    "rule_unique": ("email_unique", "SELECT 'email' AS column_name, count(email) AS total_rows, count(email) - count(DISTINCT email) AS violations FROM dirty"),
    "rule_range": ("balance_range", "SELECT 'balance' AS column_name, count(*) AS total_rows, count(*) FILTER (balance < 0 OR balance > 5000) AS violations FROM dirty"),
    "rule_range_min_only": ("balance_min", "SELECT 'balance' AS column_name, count(*) AS total_rows, count(*) FILTER (balance < 0) AS violations FROM dirty"),
    "rule_range_max_only": ("balance_max", "SELECT 'balance' AS column_name, count(*) AS total_rows, count(*) FILTER (balance > 9000.5) AS violations FROM dirty"),
    "rule_regex": ("email_form", f"SELECT 'email' AS column_name, count(*) AS total_rows, count(*) FILTER (email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL}')) AS violations FROM dirty"),
}
for _name, (_of, _sql) in _SINGLE.items():
    QUERIES[_name] = lambda spark, sf_dir, of=_of: _rule_results(spark, sf_dir, of).select("column_name", "total_rows", "violations")
    SQL[_name] = _D + _sql


# what can't be evaluated follows from the column's type, the bounds given and the pattern
@query(_D + """, t AS (SELECT typeof(any_value(balance)) AS of_balance, typeof(any_value(segment)) AS of_segment, typeof(any_value(email)) AS of_email FROM dirty),
r AS (SELECT * FROM (VALUES ('no_such', 'not_null', 'email', NULL, NULL), ('no_bounds', 'RANGE', 'balance', NULL, NULL), ('text_range', 'RANGE', 'segment', 1, NULL), ('bad_pattern', 'REGEX', 'email', NULL, '(')) v(rule_name, kind, column_name, low, pattern)),
s AS (SELECT rule_name, column_name, CASE WHEN kind NOT IN ('NOT NULL', 'UNIQUE', 'RANGE', 'REGEX') THEN 'unknown'
  WHEN kind = 'RANGE' AND (low IS NULL OR (CASE column_name WHEN 'balance' THEN of_balance WHEN 'segment' THEN of_segment ELSE of_email END) NOT IN ('DOUBLE', 'BIGINT', 'INTEGER')) THEN 'error'
  WHEN kind = 'REGEX' AND length(replace(pattern, '(', '')) - length(replace(pattern, ')', '')) <> 0 THEN 'error' ELSE 'pass' END AS status FROM r, t)
SELECT rule_name, column_name, status, CASE WHEN status IN ('unknown', 'error') THEN 'error' END AS severity FROM s""")
def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _rule_results(spark, sf_dir, "no_such", "no_bounds", "text_range", "bad_pattern")
    found = rules.issues(got, "r").select("rule_name", "column_name", "severity")
    return got.select("rule_name", "column_name", "status").join(found, ["rule_name", "column_name"])


@query(_D + f""", v AS (SELECT count(*) - count(email) AS email_given, count(*) - count(id) AS ids_given, count(email) - count(DISTINCT email) AS email_unique, count(*) FILTER (balance < 0 OR balance > 5000) AS balance_range,
  count(*) FILTER (balance < 0) AS balance_min, count(*) FILTER (balance > 9000.5) AS balance_max, count(*) FILTER (email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL}')) AS email_form, typeof(any_value(segment)) AS of_segment FROM dirty),
n AS (SELECT rule_name, violations FROM v UNPIVOT (violations FOR rule_name IN (email_given, ids_given, email_unique, balance_range, balance_min, balance_max, email_form)))
SELECT rule_name, 1 AS targets_checked, (violations > 0)::INT AS targets_failed, 0 AS targets_error FROM n
UNION ALL SELECT 'no_such', 1, 1, 0 UNION ALL SELECT 'no_bounds', 1, 0, 1 UNION ALL SELECT 'text_range', 1, 0, (of_segment = 'VARCHAR')::INT FROM v UNION ALL SELECT 'bad_pattern', 1, 0, 1
UNION ALL SELECT 'no_target', count(*)::INT, 0, 0 FROM (SELECT unnest(['{"', '".join(_COLS)}']) AS c) WHERE c LIKE 'nothing%'""")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.summaries(spark, RULES, _rule_results(spark, sf_dir), "r").drop("run_id").select("rule_name", *[F.col(c).cast("int").alias(c) for c in ("targets_checked", "targets_failed", "targets_error")])


_SCOPED = [(t, c) for t, cols in TABLES.items() for c in cols.split()]


@query("SELECT table_name, column_name FROM (VALUES " + ",".join(f"('{t}','{c}')" for t, c in _SCOPED) + ") v(table_name, column_name) WHERE regexp_matches(table_name, '^.*s$') AND regexp_matches(column_name, '^[co]_?.*key$')")
def scope_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = RuleConfig("keys", "UNIQUE", scope=RuleScope("MAIN", "*S", "[co]*KEY"))
    tables = [t for t in discover(spark, ConnectionConfig("test", sf_dir)) if t.table_name in TABLES]
    hits = [(t.table_name, c) for t in tables for c, _, _ in t.columns if in_scope(rule, t.schema_name, t.table_name, c)]
    names = columns_frame(spark, tables)
    return names.join(spark.createDataFrame(hits, "table_name string, column_name string"), ["table_name", "column_name"], "left_semi").select("table_name", "column_name")


def _changes(log: DataFrame) -> DataFrame:
    return log.select(F.get_json_object("row_key", "$.row_key").cast("long").alias("row_key"), "before_value", "after_value")


def _std(name: str, column: str, new_sql: str, **params) -> None:
    QUERIES[name] = lambda spark, sf_dir: _changes(cleanse.standardize(dirty(spark, sf_dir).df, column, ["row_key"], **params)[1])
    SQL[name] = _D + f"SELECT row_key, {column} AS before_value, {new_sql} AS after_value FROM dirty WHERE {column} IS NOT NULL AND {new_sql} <> {column}"


_std("std_trim_lower", "email", "lower(trim(email))", case="lower")
_std("std_spaces", "segment", "regexp_replace(segment, ' +', ' ', 'g')", trim=False, normalize_spaces=True)
_std("std_upper", "segment", "upper(segment)", trim=False, case="upper")
_std("std_title", "email", "list_aggregate(list_transform(regexp_extract_all(email, '[A-Za-z]+|[^A-Za-z]+'), lambda r: concat(upper(r[1]), lower(r[2:]))), 'string_agg', '')", trim=False, case="title")
_U = f"WITH d AS ({DUPS}) "
_RANKED = "SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY row_key {way}) AS rk, ({test}) AS filled FROM d"


def _dedup(name: str, keys: list[str], keep: str) -> None:
    sql = _RANKED.format(keys=", ".join(keys), way="ASC" if keep == "first" else "DESC", test=" AND ".join(f"{k} IS NOT NULL" for k in keys))
    QUERIES[name] = lambda spark, sf_dir: cleanse.deduplicate(_view(spark, sf_dir, DUPS), keys, ["row_key"], keep)[0]
    SQL[name] = _U + f"SELECT row_key, k1, k2, balance FROM ({sql}) WHERE NOT filled OR rk = 1"


_dedup("dedup_first", ["k1"], "first")
_dedup("dedup_last", ["k1"], "last")
_dedup("dedup_two_keys", ["k1", "k2"], "first")


@query(_U + f"SELECT row_key FROM ({_RANKED.format(keys='k1, k2', way='ASC', test='k1 IS NOT NULL')}) WHERE filled AND rk > 1")
def dedup_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(cleanse.deduplicate(_view(spark, sf_dir, DUPS), ["k1", "k2"], ["row_key"])[1]).select("row_key")


@query(_U + "SELECT row_key, k1 FROM d WHERE k1 IS NULL")
def dedup_null_keys_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.deduplicate(_view(spark, sf_dir, DUPS), ["k1"], ["row_key"])[0].where("k1 is null").select("row_key", "k1")


_L = f"WITH dirty AS ({DIRTY}), segmap AS ({SEGMAP}), m AS (SELECT from_value, arg_max(row(to_value), ord) AS hit FROM segmap WHERE from_value IS NOT NULL GROUP BY 1) "


def _lookup(spark: SparkSession, sf_dir: str):
    return cleanse.lookup_correct(dirty(spark, sf_dir).df, "segment", ["row_key"], spark.sql(SEGMAP), order=["ord"])


@query(_L + "SELECT d.row_key, CASE WHEN m.from_value IS NOT NULL THEN m.hit[1] ELSE d.segment END AS segment FROM dirty d LEFT JOIN m ON d.segment = m.from_value")
def lookup_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir)[0].select("row_key", "segment")


@query(_L + "SELECT d.row_key, d.segment AS before_value, m.hit[1] AS after_value FROM dirty d JOIN m ON d.segment = m.from_value")
def lookup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(_lookup(spark, sf_dir)[1])


# -- run history made from orders (runs), lineitem (metrics) and events (issues)

_RUNS = "SELECT concat('run', CAST(o_orderkey AS STRING)) AS run_id, concat('c', CAST(o_custkey AS STRING)) AS connection_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'partial' END AS status FROM {orders}"
_METRICS = "SELECT concat('run', CAST(l_orderkey AS STRING)) AS run_id, concat('t', CAST(l_linenumber AS STRING)) AS table_name, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('c', CAST(l_suppkey % 5 AS STRING)) END AS column_name, CASE WHEN l_returnflag = 'A' THEN 'row_count' ELSE 'completeness' END AS dimension, 1 - abs(l_discount) AS score FROM {lineitem}"
_ISSUES = "SELECT event_id AS issue_id, concat('run', CAST(user_id AS STRING)) AS run_id, event_type AS table_name, CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS severity FROM {events}"


def _history(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: read(spark, sf_dir, n) for n in ("orders", "lineitem", "events") if "{" + n + "}" in sql})


_H = f"WITH runs AS ({_RUNS}), metrics AS ({_METRICS}), issues AS ({_ISSUES}) ".replace("{orders}", "orders").replace("{lineitem}", "lineitem").replace("{events}", "events")


@query(_H + "SELECT run_id, connection_id, status FROM runs WHERE status = 'success' ORDER BY started_at DESC, run_id LIMIT 100")
def store_top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_history(spark, sf_dir, _RUNS).where("status = 'success'"), 100).select("run_id", "connection_id", "status")


def _numbered(df: DataFrame) -> DataFrame:
    """The rows of one run with their place in the order they come in."""
    return df.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


_ONE_RUN = "SELECT CAST(event_id AS STRING) AS issue_id, 'r' AS run_id, event_type AS table_name, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('c', CAST(user_id % 7 AS STRING)) END AS column_name, CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS severity, props AS evidence FROM {events} WHERE user_id % 10 = 3"


@query(f"WITH i AS ({_ONE_RUN.replace('{events}', 'events')}) SELECT issue_id, severity, row_number() OVER (ORDER BY severity DESC, table_name, column_name NULLS FIRST, issue_id) AS place FROM i")
def store_issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of one run, as load_issues orders them."""
    return _numbered(issues_of(_history(spark, sf_dir, _ONE_RUN))).select("issue_id", "severity", "place")


@query(f"WITH i AS ({_ONE_RUN.replace('{events}', 'events')}) SELECT issue_id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, table_name, column_name NULLS FIRST, issue_id) AS place FROM i")
def store_issue_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(issues_of(_history(spark, sf_dir, _ONE_RUN), by_rank=True)).select("issue_id", "place")


_STORED = "SELECT 'main' AS schema_name, concat('t', CAST(o_custkey % 9 AS STRING)) AS table_name, concat('c', CAST(o_orderkey AS STRING)) AS column_name, 'completeness' AS dimension, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey % 11 AS DOUBLE) / 11 END AS score, CAST(o_custkey AS DOUBLE) AS value, concat('{{\"null_count\": ', CAST(o_custkey AS STRING), ', \"row_count\": ', CAST(o_orderkey AS STRING), '}}') AS metadata FROM {orders}"
_STORED_ISSUES = "SELECT concat('i', CAST(event_id AS STRING)) AS issue_id, 'r' AS run_id, event_type AS table_name, CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS severity, concat('{{\"total_rows\": ', CAST(user_id AS STRING), '}}') AS evidence, concat('rule', CAST(user_id % 5 AS STRING)) AS rule_name FROM {events}"


def _saved(spark: SparkSession, sf_dir: str, times: int = 1) -> RunStore:
    """A store in a fresh folder with one run, saved so many times."""
    store = RunStore(spark, f"{_scratch(spark)}/store-{uuid.uuid4().hex}")
    metrics, issues = profile._conform(_history(spark, sf_dir, _STORED), METRIC), profile._conform(_history(spark, sf_dir, _STORED_ISSUES), ISSUE)
    rule_runs = issues.groupBy("rule_name").agg(F.count(F.lit(1)).alias("targets_checked"), F.count_if(F.col("severity") == "error").alias("targets_failed"), F.lit(0).alias("targets_error"))
    at = datetime(2024, 1, 1, tzinfo=UTC)
    for _ in range(times):
        store.save_run(RunResult("r", "c", at, at, "success", [], spark.createDataFrame([], PROFILE), metrics, issues, rule_runs))
    return store


def _scratch(spark: SparkSession) -> str:
    """The folder all executors share, or one of this machine's where the session is purely local and names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="auditframe-"))
    return spark.conf.get("spark.checkpoint.dir")


_S = f"WITH m AS ({_STORED}), i AS ({_STORED_ISSUES}) ".replace("{orders}", "orders").replace("{events}", "events").replace("{{", "{").replace("}}", "}")


@query(_S + "SELECT table_name, column_name, score, CAST(json_extract(metadata, '$.null_count') AS BIGINT) AS null_count, CAST(json_extract(metadata, '$.row_count') AS BIGINT) AS row_count FROM m WHERE score IS NOT NULL AND table_name = 't3' AND dimension = 'completeness'")
def store_load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _saved(spark, sf_dir).load_metrics("r", "t3", "completeness")
    return got.select("table_name", "column_name", "score", F.col("metadata")["null_count"].cast("long").alias("null_count"), F.col("metadata")["row_count"].cast("long").alias("row_count"))


@query(_S + "SELECT issue_id, table_name, CAST(json_extract(evidence, '$.total_rows') AS BIGINT) AS total_rows FROM i WHERE severity = 'error'")
def store_load_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _saved(spark, sf_dir).load_issues("r", severity="error")
    return got.select("issue_id", "table_name", F.col("evidence")["total_rows"].cast("long").alias("total_rows"))


@query(_S + "SELECT rule_name, count(*) AS targets_checked, count(*) FILTER (severity = 'error') AS targets_failed FROM i GROUP BY 1")
def store_rule_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).load_rule_runs("r").select("rule_name", "targets_checked", "targets_failed")


@query(_S + "SELECT 'metrics' AS stored, count(*) AS rows FROM m WHERE score IS NOT NULL UNION ALL SELECT 'issues', count(*) FROM i UNION ALL SELECT 'runs', 1 UNION ALL SELECT 'rule_runs', count(DISTINCT rule_name) FROM i")
def store_save_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _saved(spark, sf_dir, times=2)
    return reduce(DataFrame.unionByName, [store.table(n).groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("stored"), "rows") for n in ("metrics", "issues", "runs", "rule_runs")])


@query(_H + """SELECT r.run_id, r.status, coalesce(m.n, 0) AS metric_count, coalesce(i.n, 0) AS issue_count, round(m.mean, 6) AS overall_completeness FROM runs r
LEFT JOIN (SELECT run_id, count(*) AS n, avg(score) FILTER (dimension = 'completeness') AS mean FROM metrics GROUP BY 1) m USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n FROM issues GROUP BY 1) i USING (run_id)""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = run_summaries(_history(spark, sf_dir, _RUNS), _history(spark, sf_dir, _METRICS), _history(spark, sf_dir, _ISSUES))
    return got.select("run_id", "status", "metric_count", "issue_count", F.round("overall_completeness", 6).alias("overall_completeness"))


@query(_H + "SELECT DISTINCT table_name FROM metrics WHERE table_name <> '' ORDER BY 1")
def tables_for_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_of(_history(spark, sf_dir, _METRICS))


_ABSENT = "FROM metrics n WHERE NOT EXISTS (SELECT 1 FROM metrics o WHERE o.table_name = 't1' AND o.run_id = n.run_id AND o.table_name = n.table_name AND coalesce(o.column_name, '') = coalesce(n.column_name, '') AND o.dimension = n.dimension)"


def _absent(spark: SparkSession, sf_dir: str, *order: str) -> DataFrame:
    keys = ["run_id", "table_name", "column_name", "dimension"]
    batch = _history(spark, sf_dir, _METRICS).select(*keys, *order)
    return insert_absent(batch.where("table_name = 't1'"), batch, keys, list(order))


@query(_H + f"SELECT DISTINCT run_id, table_name, column_name, dimension {_ABSENT}")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _absent(spark, sf_dir)


@query(_H + f"SELECT run_id, table_name, column_name, dimension, min(score) AS score {_ABSENT} GROUP BY ALL")
def insert_ignore_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the row that wins: that of the least score."""
    return _absent(spark, sf_dir, "score")


# -- cleansing as a whole

_CONFIGS = [
    CleansingConfig("standardize", "dirty", column_name="segment", params={"trim": True, "case": "upper"}), CleansingConfig("lookup_correct", "dirty", column_name="segment", params={"lookup_table": "segmap", "order": ["ord"]}),
    CleansingConfig("deduplicate", "dirty", params={"key_columns": ["email"]}), CleansingConfig("standardize", "dirty", params={}), CleansingConfig("standardize", "dirty", column_name="email", enabled=False),
]
_UP = "upper(trim(segment))"
_FIRST = f"first_ AS (SELECT row_key, segment AS before_value, {_UP} AS after_value FROM dirty WHERE segment IS NOT NULL AND {_UP} <> segment)"
_KEPT = "SELECT *, row_number() OVER (PARTITION BY email ORDER BY row_key) AS rk FROM"


def _cleansed(spark: SparkSession, sf_dir: str, dry_run: bool) -> cleanse.CleansingResult:
    tables = [dirty(spark, sf_dir), Table("main", "segmap", spark.sql(SEGMAP))]
    return cleanse.apply_cleansing(spark, "r", ConnectionConfig("test", sf_dir), tables, _CONFIGS, {"dirty": ["row_key"]}, dry_run, None if dry_run else f"{_scratch(spark)}/cleansed-{uuid.uuid4().hex}")


def _all_changes(log: DataFrame) -> DataFrame:
    return log.select("operation", F.get_json_object("row_key", "$.row_key").cast("long").alias("row_key"), F.when(F.col("operation") != "deduplicate", F.col("before_value")).alias("before_value"), "after_value")


@query(_L + f", {_FIRST} SELECT 'standardize' AS operation, * FROM first_ UNION ALL SELECT 'lookup_correct', d.row_key, d.segment, m.hit[1] FROM dirty d JOIN m ON d.segment = m.from_value UNION ALL SELECT 'deduplicate', row_key, NULL, NULL FROM ({_KEPT} dirty) WHERE email IS NOT NULL AND rk > 1")
def cleanse_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each operation would change in the table as it is."""
    return _all_changes(_cleansed(spark, sf_dir, True).changes)


@query(_L + f", {_FIRST}, u AS (SELECT * REPLACE ({_UP} AS segment) FROM dirty) SELECT 'standardize' AS operation, * FROM first_ UNION ALL SELECT 'lookup_correct', u.row_key, u.segment, m.hit[1] FROM u JOIN m ON u.segment = m.from_value UNION ALL SELECT 'deduplicate', row_key, NULL, NULL FROM ({_KEPT} u) WHERE email IS NOT NULL AND rk > 1")
def cleanse_commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chain of operations changed, each in what the one before left."""
    return _all_changes(_cleansed(spark, sf_dir, False).changes)


@query(_L + f", u AS (SELECT * REPLACE ({_UP} AS segment) FROM dirty), w AS (SELECT u.* REPLACE (CASE WHEN m.from_value IS NOT NULL THEN m.hit[1] ELSE u.segment END AS segment) FROM u LEFT JOIN m ON u.segment = m.from_value) SELECT row_key, email, segment FROM ({_KEPT} w) WHERE email IS NULL OR rk = 1")
def cleanse_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleansed(spark, sf_dir, False).tables["dirty"].select("row_key", "email", "segment")


@query(_U + "SELECT row_key, k1, k2, balance FROM d")
def dedup_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, log = cleanse.deduplicate(_view(spark, sf_dir, DUPS), ["k1"], ["row_key"])
    return extra.restore_rows(kept, log)


# -- checks beyond column rules

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c} + 0.0::DOUBLE) AS min_value, max({c}) AS max_value, round(avg({c}), 9) AS mean_value, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in _NUMBERS))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.column_stats(read(spark, sf_dir, "lineitem"), _NUMBERS, exact=True).select("column_name", "min_value", "max_value", F.round("mean_value", 9).alias("mean_value"), "distinct_values")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.orphans(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", read(spark, sf_dir, "labels"), "doc_id")


@query(_D + "SELECT segment AS value, count(*) AS rows FROM dirty WHERE segment IS NOT NULL AND segment NOT IN (SELECT c_mktsegment FROM customer) GROUP BY 1")
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.outside_domain(dirty(spark, sf_dir).df, "segment", read(spark, sf_dir, "customer"), "c_mktsegment")


@query(_D + "SELECT concat_ws(',', CASE WHEN id IS NULL THEN 'id' END, CASE WHEN email IS NULL THEN 'email' END, CASE WHEN nickname IS NULL THEN 'nickname' END) AS pattern, count(*) AS rows FROM dirty GROUP BY 1")
def null_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.null_patterns(dirty(spark, sf_dir).df, ["id", "email", "nickname"])


@query("SELECT count(*) AS total_rows, count(*) FILTER (l_discount > 0.05) AS violations FROM lineitem WHERE l_returnflag = 'R'")
def conditional_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.conditional(read(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", F.col("l_discount") <= 0.05)


_DAILY = "SELECT event_type, date_trunc('day', ts) AS day, CAST(count(*) AS DOUBLE) AS n FROM {events} GROUP BY ALL"


@query(f"WITH h AS ({_DAILY.replace('{events}', 'events')}), w AS (SELECT *, count(n) OVER b AS k, avg(n) OVER b AS mean, stddev_samp(n) OVER b AS dev FROM h WINDOW b AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT event_type, n, round(CASE WHEN k >= 3 THEN mean END, 6) AS base_mean, round(CASE WHEN k >= 3 AND dev > 0 THEN (n - mean) / dev END, 6) AS z FROM w")
def drift_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extra.drift(_history(spark, sf_dir, _DAILY), ["event_type"], "day", "n")
    return got.select("event_type", "n", F.round("base_mean", 6).alias("base_mean"), F.round("z", 6).alias("z"))


@query(_NULLS + "SELECT column_name, round(1.0::DOUBLE - null_count::DOUBLE / row_count, 6) AS score FROM p WHERE 1.0::DOUBLE - null_count::DOUBLE / row_count < 0.95")
def threshold_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = extra.below_thresholds(profile.profile_metrics(_profile(spark, sf_dir), "r"), {"completeness": 0.95})
    return low.select("column_name", F.round("score", 6).alias("score"))


_BY = "2024-06-01 00:00:00"


@query(f"SELECT event_type, CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) AS latest, count(*) AS rows, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '{_BY}') AS age_seconds, max(ts) < TIMESTAMP '{_BY}' - INTERVAL 1 DAY AS late FROM events GROUP BY 1")
def timeliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extra.lateness(read(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")), "ts", ["event_type"], _BY)
    return got.select("event_type", F.unix_seconds(F.col("latest").cast("timestamp")).alias("latest"), "rows", "age_seconds", "late")


@query("SELECT 'dates' AS check_name, count(*) AS total_rows, count(*) FILTER (NOT (l_shipdate >= TIMESTAMP '1995-01-01')) AS violations FROM lineitem UNION ALL SELECT 'discounted', count(*), count(*) FILTER (NOT (l_discount * l_extendedprice <= l_tax * l_extendedprice + 500)) FROM lineitem")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.inconsistent(read(spark, sf_dir, "lineitem"), {"dates": "l_shipdate >= TIMESTAMP_NTZ '1995-01-01'", "discounted": "l_discount * l_extendedprice <= l_tax * l_extendedprice + 500"})


@query("SELECT * FROM (SELECT 'url' AS column_name, CASE WHEN avg(regexp_matches(url, '^[a-z][a-z0-9+.-]*://\\S+$')::INT) >= 0.9 THEN 'url' END AS semantic_type, round(avg(regexp_matches(url, '^[a-z][a-z0-9+.-]*://\\S+$')::INT), 6) AS match_rate FROM pages) UNION ALL SELECT 'html', NULL, 0.0")
def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.semantic_types(read(spark, sf_dir, "pages"), ["url", "html"]).select("column_name", "semantic_type", F.round("match_rate", 6).alias("match_rate"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(concat('7|', CAST(c_custkey AS VARCHAR))), c_custkey LIMIT 100")
def sample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.sample(read(spark, sf_dir, "customer"), SamplingConfig("random", 100, 7, ["c_custkey"])).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
def sample_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.sample(read(spark, sf_dir, "customer"), SamplingConfig("first_n", 25, keys=["c_custkey"])).select("c_custkey", "c_name")


@query("SELECT 'order_customer' AS rule_name, count(o_custkey) AS total_rows, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)) AS violations FROM orders UNION ALL SELECT 'big_status', count(*), count(*) FILTER (o_totalprice > 100000 AND NOT o_orderstatus IN ('O', 'F')) FROM orders")
def rule_across_columns_and_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = [_rule("order_customer", "REFERENCES", "o_custkey", "orders", ref_table="customer", ref_column="c_custkey"), _rule("big_status", "CONDITION", "o_orderstatus", "orders", condition="o_totalprice > 100000", check="o_orderstatus IN ('O', 'F')")]
    tables = [Table("main", "orders", read(spark, sf_dir, "orders")), Table("main", "customer", read(spark, sf_dir, "customer").where("c_custkey % 3 = 0"))]
    return rules.evaluate(spark, targets(some, tables), {t.table_name: t.df for t in tables}).select("rule_name", "total_rows", "violations")


_LINE = TABLES["lineitem"].split()


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count FROM lineitem" for c in _LINE))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(Table("main", "lineitem", read(spark, sf_dir, "lineitem"))).select("column_name", "row_count", "null_count")


_TITLE = "SELECT c_custkey AS row_key, concat(CASE c_custkey % 5 WHEN 0 THEN 'ßäule ' WHEN 1 THEN 'ÉCOLE d''été ' WHEN 2 THEN 'ﬁrst x2y ' WHEN 3 THEN 'ĳssel ' ELSE '' END, lower(c_name)) AS name FROM customer"


@query(f"WITH d AS ({_TITLE}) SELECT row_key, name AS before_value, concat(CASE row_key % 5 WHEN 0 THEN 'Ssäule ' WHEN 1 THEN 'École D''Été ' WHEN 2 THEN 'First X2Y ' WHEN 3 THEN 'Ĳssel ' ELSE '' END, upper(substr(n, 1, 1)), substr(n, 2)) AS after_value FROM (SELECT *, regexp_extract(name, 'customer#.*$') AS n FROM d)")
def std_title_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(cleanse.standardize(_view(spark, sf_dir, _TITLE), "name", ["row_key"], trim=False, case="title")[1])


@query(_D + "SELECT row_key, email FROM dirty")
def cleansing_reverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, log = cleanse.standardize(dirty(spark, sf_dir).df, "email", ["row_key"], case="lower")
    return extra.revert(new, log, ["row_key"], "email").select("row_key", "email")
