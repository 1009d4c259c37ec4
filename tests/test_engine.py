import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from auditframe import cli, config
from auditframe.engine import Engine
from auditframe.functions.strings import strip, title
from auditframe.models import ConnectionConfig, PipelineConfig, ReadOnlyError, RuleConfig, RuleScope
from auditframe.models import CleansingConfig as Cleanse
from auditframe.operators import cleanse, profile, rules
from auditframe.plans.scope import glob_matches, targets
from auditframe.report import duration, render, severity_class
from auditframe.sources.catalog import Table, dialect, discover, qualified, quote, select_tables
from auditframe.store import RunStore


@pytest.fixture(scope="module")
def users(spark):
    rows = [(1, "a@x.org", 25), (2, "b@x.org", 30), (3, None, 17), (None, "a@x.org", -1), (5, "c@x.org", 22)]
    return Table("main", "users", spark.createDataFrame(rows, "id int, email string, age int"))


def check(spark, table, expression, column, **params):
    rule = RuleConfig("r", expression, scope=RuleScope(None, None, column), params=params)
    row = rules.evaluate(spark, targets([rule], [table])).first()
    return row.total_rows, row.violations, row.status


def test_rule_semantics(spark, users):
    assert check(spark, users, "NOT NULL", "email") == (5, 1, "fail")
    assert check(spark, users, " not null ", "age") == (5, 0, "pass")
    assert check(spark, users, "UNIQUE", "email") == (4, 1, "fail")
    assert check(spark, users, "UNIQUE", "age") == (5, 0, "pass")
    assert check(spark, users, "RANGE", "age", min=0) == (5, 1, "fail")
    assert check(spark, users, "RANGE", "age", max=100) == (5, 0, "pass")
    assert check(spark, users, "RANGE", "age", min=18, max=100) == (5, 2, "fail")
    assert check(spark, users, "REGEX", "email", pattern="^[ab]@") == (5, 1, "fail")
    assert check(spark, users, "REGEX", "email", pattern="x") == (5, 0, "pass")
    assert check(spark, users, "RANGE", "age")[2] == "error"
    assert check(spark, users, "RANGE", "email", min=1)[2] == "error"
    assert check(spark, users, "REGEX", "email", pattern="(")[2] == "error"
    assert check(spark, users, "not_null", "age")[2] == "unknown"


def test_rules_on_empty_table_and_fused_equals_single(spark, users):
    empty = Table("main", "empty", users.df.where("false"))
    assert check(spark, empty, "UNIQUE", "email") == (0, 0, "pass")
    assert check(spark, empty, "NOT NULL", "email") == (0, 0, "pass")
    some = [RuleConfig("a", "NOT NULL"), RuleConfig("b", "UNIQUE"), RuleConfig("c", "RANGE", scope=RuleScope(None, None, "age"), params={"min": 0})]
    fused = {tuple(r) for r in rules.evaluate(spark, targets(some, [users])).collect()}
    single = {tuple(rules.evaluate(spark, [t]).first()) for t in targets(some, [users])}
    assert fused == single and len(fused) == 7


def test_runtime_error_is_kept_to_its_target(spark, users):
    bad = Table("main", "bad", users.df.withColumn("boom", F.expr("cast(if(id = 1, 'x', '1') as int)")))
    some = [RuleConfig("r", "NOT NULL", scope=RuleScope(None, None, "boom")), RuleConfig("s", "NOT NULL", scope=RuleScope(None, None, "age"))]
    got = {r.rule_name: r.status for r in rules.evaluate_safely(spark, targets(some, [bad])).collect()}
    assert got == {"r": "error", "s": "pass"}


def test_issues_and_summaries(spark, users):
    some = [RuleConfig("given", "NOT NULL", "completeness", "critical", RuleScope(None, "us*", "email")), RuleConfig("nothing", "UNIQUE", scope=RuleScope("x", None, None)), RuleConfig("odd", "??", scope=RuleScope(None, None, "id"))]
    found, runs = rules.apply_rules(spark, "run", some, [users])
    by = {i.rule_name: i for i in found.collect()}
    assert by["given"].severity == "critical" and json.loads(by["given"].evidence) == {"null_count": 1, "total_rows": 5}
    assert by["odd"].severity == "error" and "evaluation error" not in by["odd"].message
    assert {tuple(r)[1:] for r in runs.collect()} == {("given", 1, 1, 0), ("nothing", 0, 0, 0), ("odd", 1, 1, 0)}
    assert rules.apply_rules(spark, "run", [], [users])[0].count() == 0


def test_hostile_names(spark):
    table = Table("main", 'x"; DROP TABLE y', spark.createDataFrame([(1,), (None,)], "`a.b``c; --` int"))
    assert check(spark, table, "NOT NULL", "*") == (2, 1, "fail")
    assert [r.null_count for r in profile.profile(table).collect()] == [1]
    assert quote("a`b") == "`a``b`" and qualified("main", "t") == "`t`" and qualified("s", "t") == "`s`.`t`"


def test_profile_diagnose_metrics(spark, users):
    half = Table("main", "half", spark.createDataFrame([(None, 1), (2, None), (None, 3), (4, 4)], "a int, b int"))
    none = Table("main", "none", spark.range(3).select())
    p = profile.profile_tables(spark, [users, half, none, Table("main", "empty", users.df.where("false"))])
    sev = {(r.table_name, r.column_name): r.severity for r in profile.completeness_issues(p, "r").collect()}
    assert sev == {("users", "id"): "warning", ("users", "email"): "warning", ("half", "a"): "error", ("half", "b"): "warning"}
    m = {r.dimension: r.value for r in profile.run_metrics(p, "r").collect()}
    assert m["table_count"] == 4 and m["column_count"] == 8
    assert m["average_completeness"] == pytest.approx((0.8 + 0.8 + 1 + 0.5 + 0.75 + 3) / 8)
    scores = [r.score for r in profile.profile_metrics(p, "r").where("table_name = 'empty' and dimension = 'completeness'").collect()]
    assert scores == [1.0, 1.0, 1.0]
    assert profile.table_completeness(p).where("table_name = 'none'").first().score == 1.0


def test_strings(spark):
    texts = ["  a\t\n", " x ", "\x1cq\x1f", "o'neil mc-donald 3rd", "ßTRASSE éa", "", " in ner "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"), title(F.col("t")).alias("u")).collect()
    for r in rows:
        assert r.s == r.t.strip()
        if "ß" not in r.t:
            assert r.u == r.t.title()


def test_standardize(spark):
    df = spark.createDataFrame([(1, " A@X.org "), (2, "B@X.ORG"), (3, None), (4, "c@x.org")], "id int, email string")
    new, log = cleanse.standardize(df, "email", ["id"], case="lower")
    assert {(r.row_key, r.before_value, r.after_value) for r in log.collect()} == {('{"id":1}', " A@X.org ", "a@x.org"), ('{"id":2}', "B@X.ORG", "b@x.org")}
    assert [r.email for r in new.orderBy("id").collect()] == ["a@x.org", "b@x.org", None, "c@x.org"]
    assert cleanse.standardize(df, "email", ["id"], trim=False)[1].count() == 0
    assert cleanse.standardize(df, "id", ["id"], case="upper")[1].count() == 0


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "a"), (6, None), (7, None)], "id int, email string")
    new, log = cleanse.deduplicate(df, ["email"], ["id"])
    assert sorted(r.id for r in new.collect()) == [1, 2, 4, 6, 7]
    assert {json.loads(r.before_value)["id"] for r in log.collect()} == {3, 5} and log.first().after_value is None
    last, _ = cleanse.deduplicate(df, ["email"], ["id"], keep="whatever")
    assert sorted(r.id for r in last.collect()) == [2, 4, 5, 6, 7]
    assert cleanse.deduplicate(new, ["email"], ["id"])[1].count() == 0
    with pytest.raises(ValueError):
        cleanse.deduplicate(df, [], ["id"])


def test_lookup(spark):
    orders = spark.createDataFrame([(1, "new"), (2, "NEW"), (3, "old"), (4, "x"), (5, None)], "id int, status string")
    lookup = spark.createDataFrame([(1, "NEW", "no"), (2, "NEW", "new"), (3, "old", None), (4, "x", "x"), (5, None, "never")], "ord int, from_value string, to_value string")
    new, log = cleanse.lookup_correct(orders, "status", ["id"], lookup, order=["ord"])
    assert [r.status for r in new.orderBy("id").collect()] == ["new", "new", None, "x", None]
    assert log.count() == 3
    numbers = lookup.withColumn("from_value", F.lit(1))
    assert cleanse.lookup_correct(orders, "status", ["id"], numbers)[1].count() == 0


def test_apply_cleansing(spark, tmp_path):
    df = spark.createDataFrame([(1, " a "), (2, "a")], "id int, v string")
    tables = [Table("main", "t", df), Table("main", "u", df)]
    configs = [Cleanse("standardize", "t", column_name="v"), Cleanse("deduplicate", "t", params={"key_columns": ["v"]}), Cleanse("standardize", "u", column_name="v"), Cleanse("standardize", "u"), Cleanse("lookup_correct", "t", column_name="v"), Cleanse("nope", "t"), Cleanse("standardize", "t", column_name="v", enabled=False)]
    keys = {"t": ["id"], "u": ["id"]}
    dry = cleanse.apply_cleansing(spark, "r", ConnectionConfig("c", "x"), tables, configs, keys)
    assert dry.total_changes == 2 and dry.tables_affected == 2 and len(dry.errors) == 3
    wet = cleanse.apply_cleansing(spark, "r", ConnectionConfig("c", "x"), tables, configs, keys, dry_run=False, output=str(tmp_path / "out"))
    assert wet.total_changes == 3 and spark.read.parquet(str(tmp_path / "out/r/t.parquet")).count() == 1
    for dry_run in (True, False):
        with pytest.raises(ReadOnlyError):
            cleanse.apply_cleansing(spark, "r", ConnectionConfig("c", "x", True), tables, configs, keys, dry_run)


def test_scope_and_filters(users):
    assert glob_matches("Email", "e*L") and glob_matches(None, None) and glob_matches("a", "[!b]") and not glob_matches("a", "b")
    other = Table("x", "orders", users.df)
    pick = lambda **k: [t.table_name for t in select_tables([users, other], PipelineConfig(**k))]
    assert pick() == ["users", "orders"] and pick(include_tables=["users"]) == ["users"] and pick(exclude_schemas=["x"]) == ["users"] and pick(include_tables=["Users"]) == []
    with pytest.raises(ValueError):
        PipelineConfig(include_tables=["a"], exclude_tables=["a"])


def test_models_and_config(tmp_path, monkeypatch):
    for bad in (dict(name="a b", expression="x"), dict(name="a", expression=" "), dict(name="a", expression="x", severity="bad"), dict(name="a", expression="RANGE", params={"min": True}), dict(name="a", expression="RANGE", params={"max": "1; DROP TABLE t"})):
        with pytest.raises(ValueError):
            RuleConfig(**bad)
    with pytest.raises(ValueError):
        ConnectionConfig("a", "  ")
    with pytest.raises(ValueError):
        PipelineConfig(metric_thresholds={"completeness": 2})
    monkeypatch.setenv("HERE", "/data")
    (tmp_path / "c.json").write_text('{"id": "a", "dsn": "${HERE}/${NOWHERE}", "other": 1}')
    assert config.load_connection(tmp_path / "c.json").dsn == "/data/${NOWHERE}"
    (tmp_path / "a.json").write_text('{"rules": [{"name": "x", "expression": "UNIQUE"}, {"name": "y", "expression": "NOT NULL"}]}')
    (tmp_path / "b.yaml").write_text("rules:\n  - {name: x, expression: REGEX, params: {pattern: a}, scope: {column_pattern: c}}\n")
    merged = config.load_rules_from_files([tmp_path / "a.json", tmp_path / "b.yaml"])
    assert [(r.name, r.kind) for r in merged] == [("x", "REGEX"), ("y", "NOT NULL")] and merged[0].scope.column_pattern == "c"
    for text in ("[1]", '{"rules": 1}', '{"rules": [{"name": "a b", "expression": "x"}]}'):
        (tmp_path / "d.json").write_text(text)
        with pytest.raises(ValueError):
            config.load_rules(tmp_path / "d.json")
    (tmp_path / "e.json").write_text("{}")
    assert config.load_rules(tmp_path / "e.json") == []


def test_dialect_and_discovery(spark, tmp_path):
    assert [dialect(x) for x in ("/a", "file:///a", "catalog:default", "jdbc:postgresql://h/d")] == ["files", "files", "catalog", "jdbc"]
    with pytest.raises(ValueError):
        dialect("mongo://x")
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    spark.range(2).write.json(str(tmp_path / "a.json"))
    (tmp_path / "notes.txt").write_text("x")
    assert [(t.schema_name, t.table_name, t.df.count()) for t in discover(spark, ConnectionConfig("c", str(tmp_path)))] == [("main", "a", 2), ("main", "b", 3)]
    spark.range(1).createOrReplaceTempView("seen")
    assert "seen" in [t.table_name for t in discover(spark, ConnectionConfig("c", "catalog:default"))]


@pytest.fixture()
def source(spark, tmp_path):
    spark.createDataFrame([(1, "a@x", "n"), (2, None, "m"), (3, "b@x", "k")], "id int, email string, name string").write.parquet(str(tmp_path / "in/customers.parquet"))
    spark.createDataFrame([(1, 1, 5.0), (2, 2, -1.0)], "id int, customer_id int, amount double").write.parquet(str(tmp_path / "in/orders.parquet"))
    (tmp_path / "rules.json").write_text('{"rules": [{"name": "amount", "expression": "RANGE", "scope": {"column_pattern": "amount"}, "params": {"min": 0}}]}')
    return tmp_path


def test_run_store_report(spark, source):
    engine = Engine.from_path(spark, str(source / "in"), "c1", PipelineConfig("c1", rule_files=[str(source / "rules.json"), "/missing.json"], metric_thresholds={"completeness": 0.9}), store=str(source / "store"), report_dir=str(source / "reports"))
    result, report = engine.run()
    found = {(i.table_name, i.rule_name, i.message.split()[0]) for i in result.issues.collect()}
    assert ("orders", "amount", "amount:") in found and ("customers", None, "email") in found and ("customers", None, "completeness") in found
    store = RunStore(spark, str(source / "store"))
    n = store.table("metrics").count(), store.table("issues").count()
    assert n == (result.metrics.count(), result.issues.count())
    store.save_run(result)
    assert (store.table("metrics").count(), store.table("issues").count(), store.table("runs").count()) == (*n, 1)
    summary = store.get_run_summary(result.run_id)
    assert summary["metric_count"] == n[0] and summary["overall_completeness"] == pytest.approx((5 + 2 / 3) / 6)
    assert "error" in store.get_run_summary("nope")
    assert store.list_tables(result.run_id) == ["customers", "orders"]
    assert store.load_runs("c1", "success").count() == 1 and store.load_runs("c2").count() == 0
    assert store.load_metrics(result.run_id, "orders", "row_count").first().value == 2
    assert [r.severity for r in store.load_issues(result.run_id, by_rank=False).collect()] == sorted((i.severity for i in result.issues.collect()), reverse=True)
    assert str(source / "in") not in str(store.table("runs").collect())
    page = open(report).read()
    assert "customers" in page and "&lt;" not in result.run_id and render(result) == page
    assert {(r.table_name, len(r.columns)) for r in result.tree().collect()} == {("customers", 3), ("orders", 3)}


def test_report_pieces():
    assert severity_class("critical") == "err" and severity_class("warning") == "warn" and severity_class("info") == "ok"
    a = datetime(2024, 1, 1, tzinfo=UTC)
    assert duration(None, a) == "-" and duration(a, a.replace(second=5)) == "5.0s" and duration(a, a.replace(minute=2, second=3)) == "2m 3s"


def test_command_line(spark, source, capsys):
    assert cli.main(["profile", "--source", str(source / "in"), "--rules", str(source / "rules.json"), "--report-dir", str(source / "r")], spark) == 0
    out = capsys.readouterr()
    assert out.out.strip().endswith(".html") and "amount" in out.err
    assert cli.main(["profile", "--source", "mongo://x"], spark) == 1


def test_engine_from_file(spark, source):
    (source / "all.yaml").write_text(f"connection: {{id: c9, dsn: '{source}/in'}}\npipeline: {{include_tables: [orders]}}\n")
    engine = Engine.from_file(spark, str(source / "all.yaml"))
    assert engine.connection.id == "c9" and [t.table_name for t in engine.tables()] == ["orders"]
    (source / "flat.yaml").write_text(f"id: c8\ndsn: '{source}/in'\nexclude_tables: [orders]\n")
    assert [t.table_name for t in Engine.from_file(spark, str(source / "flat.yaml")).tables()] == ["customers"]


def test_stream(spark, source):
    from auditframe.streaming.checks import watch, windowed_nulls

    schema = spark.read.parquet(str(source / "in/orders.parquet")).schema
    stream = spark.readStream.schema(schema).parquet(str(source / "in/orders.parquet"))
    watch(stream, "orders", [RuleConfig("amount", "RANGE", scope=RuleScope(None, None, "amount"), params={"min": 0})], str(source / "res"), str(source / "cp")).awaitTermination()
    assert [(r.rule_name, r.violations) for r in spark.read.parquet(str(source / "res")).collect()] == [("amount", 1)]
    assert windowed_nulls(stream.withColumn("ts", F.current_timestamp()), "ts", ["amount"]).isStreaming
