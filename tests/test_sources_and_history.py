"""Sources, run history, HTTP answers, and cleansing runs as a whole."""

import json
import sqlite3
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from auditframe import api, cli
from auditframe.engine import Engine
from auditframe.models import CleansingConfig, ConnectionConfig, PipelineConfig, ReadOnlyError, RowCeilingError, SamplingConfig
from auditframe.operators import cleanse, extra, rules
from auditframe.operators.cleanse import apply_cleansing, current
from auditframe.plans.scope import targets
from auditframe.sources import sqlite
from auditframe.sources.catalog import Table, dialect, discover, jdbc_options, jdbc_reads
from auditframe.store import RunStore, insert_absent


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    """A SQLite file with an awkward name, values of other kinds, a view and a table without a rowid."""
    path = str(tmp_path_factory.mktemp("db") / "shop.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "odd ""name""; DROP TABLE x" (id INTEGER PRIMARY KEY, email TEXT, amount REAL, raw BLOB)')
        db.executemany('INSERT INTO "odd ""name""; DROP TABLE x" VALUES (?, ?, ?, ?)', [(i, None if i % 4 == 0 else f"u{i}@x.org", i * 1.5, b"\x00" if i % 2 else None) for i in range(1, 101)])
        db.execute("CREATE TABLE plain (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
        db.executemany("INSERT INTO plain VALUES (?, ?)", [("a", 1), ("b", "not a number"), ("c", None)])
        db.execute("CREATE VIEW few AS SELECT k FROM plain WHERE n IS NOT NULL")
        db.execute("CREATE TABLE empty_one (x INTEGER)")
    return path


def test_sqlite_tables(spark, shop):
    found = {t.table_name: t.df for t in discover(spark, ConnectionConfig("s", f"sqlite:///{shop}"))}
    assert set(found) == {'odd "name"; DROP TABLE x', "plain", "few", "empty_one"}
    odd = found['odd "name"; DROP TABLE x']
    assert odd.dtypes == [("id", "bigint"), ("email", "string"), ("amount", "double"), ("raw", "binary")] and odd.rdd.getNumPartitions() > 1
    assert odd.agg(F.count("*"), F.count("email"), F.sum("amount"), F.count("raw")).first() == (100, 75, 7575.0, 50)
    assert {tuple(r) for r in found["plain"].collect()} == {("a", 1), ("b", None), ("c", None)} and found["few"].count() == 2 and found["empty_one"].count() == 0
    with pytest.raises(sqlite3.OperationalError), sqlite.connect(shop) as db:
        db.execute("DELETE FROM plain")
    result, _ = Engine(spark, ConnectionConfig("s", f"sqlite:///{shop}")).run()
    assert result.status == "success" and result.profiles.where("column_name = 'email'").first().null_count == 25
    assert sqlite.path_of("sqlite:///a/b.db") == "/a/b.db" or sqlite.path_of("sqlite:///a/b.db") == "a/b.db"


def test_jdbc_options():
    assert dialect("postgresql://h/d") == "jdbc" and dialect("jdbc:x:y") == "jdbc" and dialect("sqlite:///f") == "sqlite"
    c = ConnectionConfig("p", "postgresql://me:p%40ss@host:5433/db?connect_timeout=3", True, {"ssl": {"mode": "require"}, "fetchsize": 1000, "partitionColumn": "id", "lowerBound": 0, "upperBound": 9, "numPartitions": 3, "partitioned": "orders"})
    got = jdbc_options(c)
    assert got["url"] == "jdbc:postgresql://host:5433/db?connect_timeout=3" and (got["user"], got["password"]) == ("me", "p@ss")
    assert got["ssl"] == "true" and got["sslmode"] == "require" and "READ ONLY" in got["sessionInitStatement"] and "p@ss" not in repr(ConnectionConfig("p", "jdbc:x", options={"password": "p@ss"}))
    reads = {t: o for _, t, o in jdbc_reads(None, got, [("s", 'a"b'), ("s", "orders")])}
    assert reads['a"b']["dbtable"] == '"s"."a""b"' and "partitionColumn" not in reads['a"b'] and reads["orders"]["numPartitions"] == "3"


def test_csv_has_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,amount\n1,2.5\n2,-1\n")
    table = discover(spark, ConnectionConfig("c", str(tmp_path)))[0]
    assert dict(table.df.dtypes) == {"id": "int", "amount": "double"}


@pytest.fixture()
def people(spark, tmp_path):
    rows = [(i, f"  P{i % 5} ", i % 7, True) for i in range(40)]
    spark.createDataFrame(rows, "id long, name string, n long, ok boolean").repartition(3, "id").write.parquet(str(tmp_path / "in/people.parquet"))
    return ConnectionConfig("f", str(tmp_path / "in"))


def test_history(spark, people, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"name": "n_range", "expression": "RANGE", "scope": {"column_pattern": "n"}, "params": {"min": 1}}, {"name": "bad", "expression": "RANGE", "scope": {"column_pattern": "name"}, "params": {"min": 1}}]}))
    store = str(tmp_path / "store")
    engine = Engine(spark, people, PipelineConfig("f", rule_files=[str(tmp_path / "r.json")]), store, analyses={"names": lambda s, tables: tables[0].df.groupBy("name").count()})
    result, _ = engine.run()
    assert result.status == "partial" and result.analyses["names"].count() == 5
    tree = result.tree().first()
    n = next(c for c in tree.columns if c.column_name == "n")
    assert [m.dimension for m in n.metrics] == ["completeness"] and [i.rule_name for i in n.issues] == ["n_range"] and [m.dimension for m in tree.metrics] == ["row_count"]
    history = RunStore(spark, store)
    assert history.load_issues(result.run_id, table_name="people").first().evidence is not None and history.load_metrics(result.run_id).where("metadata['row_count'] = '40'").count() == 4
    assert [tuple(r)[1:] for r in history.load_rule_runs(result.run_id).collect()] == [("bad", 1, 0, 1), ("n_range", 1, 1, 0)]
    plan = history.table("issues").where(F.col("run_id") == result.run_id)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    before = {n: history.table(n).count() for n in ("runs", "metrics", "issues", "rule_runs")}
    history.save_run(result)
    assert {n: history.table(n).count() for n in before} == before
    result.issues = result.issues.withColumn("run_id", F.lit("another"))
    with pytest.raises(ValueError, match="another run"):
        history.save_run(result)
    broken = Engine(spark, ConnectionConfig("f", str(tmp_path / "nowhere")), store=store)
    with pytest.raises(Exception):  # noqa: B017
        broken.run()
    assert [r.status for r in history.load_runs().collect()] == ["failed", "partial"]
    assert history.drift().count() == before["metrics"] and history.drift().where("z is not null").count() == 0

    serve = api.server(spark, store, port=0)
    threading.Thread(target=serve.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{serve.server_address[1]}{path}") as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert get("/health") == (200, {"status": "ok"}) and [r["status"] for r in get("/runs?limit=1")[1]] == ["failed"]
        assert get("/runs?limit=501")[0] == 422 and get("/runs/none")[0] == 404 and get("/nothing")[0] == 404
        assert get(f"/runs/{result.run_id}")[1]["metric_count"] == before["metrics"] and get(f"/runs/{result.run_id}/tables")[1] == ["people"]
        assert {m["column_name"] for m in get(f"/runs/{result.run_id}/metrics?dimension=completeness")[1]} == {"id", "name", "n", "ok"}
        assert [i["evidence"]["violations"] for i in get(f"/runs/{result.run_id}/issues?severity=warning")[1]] == ["6"]
    finally:
        serve.shutdown()


def test_insert_absent_deals_rows_by_their_bytes(spark, monkeypatch):
    """No partition grows with the input, however well its keys compress, and no key's rows all meet in one task."""
    monkeypatch.setattr("auditframe.store._PART", 1 << 20, raising=False)
    row = [F.lit("t").alias("table_name"), F.lit(None).cast("string").alias("column_name"), F.lit("completeness").alias("dimension")]
    named = lambda i: F.concat(F.lit("run"), i.cast("string")).alias("run_id")
    batch = spark.range(300_000).select(named(F.col("id")), *row)
    got = insert_absent(batch.limit(0), batch.unionByName(batch.where("run_id like '%7'")), batch.columns)
    assert got.groupBy().agg(F.count("run_id"), F.count_distinct("run_id"), F.count("column_name")).first() == (300_000, 300_000, 0)
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 20_000

    hot = spark.range(100_000).select(named(F.when(F.col("id") % 2 == 1, F.col("id")).otherwise(F.col("id") % 4)), *row, (100_000 - F.col("id")).alias("score"))
    stored, keys = hot.where("run_id = 'run2' or run_id like '%7'").drop("score"), hot.columns[:-1]
    for order in ([], ["score"]):
        got = insert_absent(stored, hot if order else hot.drop("score"), keys, order)
        assert got.count() == 40_001 == got.select("run_id").distinct().count() and got.where("run_id = 'run2' or run_id like '%7'").count() == 0
        assert not order or got.where("run_id = 'run0'").first().score == 4
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # the hot keys' rows apart


def test_insert_absent_gives_rows_of_the_batch(spark):
    kind = "a string, b string, n long, tags array<string>"
    batch = spark.createDataFrame([(None, "", 1, ["x"]), ("", None, 1, ["y"]), ("", "", None, None), (None, "k", 2, []), ("u", "k", 2, ["z"]), ("u", "k", 2, ["w"]), ("s", None, 3, []), ("s", "", 4, [])], kind)
    stored = spark.createDataFrame([("s", "", 3, 0.5), ("s", "", 3, None), ("gone", "k", None, 1.0)], "a string, b string, n int, score double")
    listed = lambda df: sorted(map(str, map(tuple, df.collect())))
    got = insert_absent(stored, batch, ["a", "b", "n"], ["tags"])
    assert got.columns == batch.columns and [f.dataType for f in got.schema] == [f.dataType for f in batch.schema]
    assert listed(got) == sorted(map(str, [(None, "", 1, ["x"]), ("", "", None, None), (None, "k", 2, []), ("u", "k", 2, ["w"]), ("s", "", 4, [])]))
    assert listed(insert_absent(stored, batch, ["a", "b", "n"], [F.desc("tags")])) == sorted(map(str, [("", None, 1, ["y"]), ("", "", None, None), (None, "k", 2, []), ("u", "k", 2, ["z"]), ("s", "", 4, [])]))
    assert listed(insert_absent(stored, batch, ["a", "b", "n"], ["b", "tags"])) == sorted(map(str, [("", None, 1, ["y"]), ("", "", None, None), (None, "k", 2, []), ("u", "k", 2, ["w"]), ("s", "", 4, [])]))
    bare = insert_absent(stored.select("a", "b"), batch.select("b", "a"), ["a", "b"])
    assert bare.columns == ["b", "a"] and listed(bare) == sorted(map(str, [("", ""), ("k", None), ("k", "u")]))
    mixed = insert_absent(stored.select("a", "b"), batch.where("n = 1").select("a", "b"), ["a", "b"])
    assert [tuple(r) for r in mixed.collect()] == [(None, "")]


def test_committed_cleansing_is_whole_or_not_at_all(spark, people, tmp_path):
    tables, out = discover(spark, people), str(tmp_path / "out")
    configs = [CleansingConfig("standardize", "people", column_name="name"), CleansingConfig("deduplicate", "people", params={"key_columns": ["name"]}), CleansingConfig("standardize", "people", column_name="n", params={"case": "upper"}), CleansingConfig("standardize", "people", column_name="none")]
    dry = apply_cleansing(spark, "r0", people, tables, configs, {}, True, out)
    assert dry.total_changes == 40 + 35 and len(dry.errors) == 1 and not (tmp_path / "out").exists()
    done = apply_cleansing(spark, "r1", people, tables, configs, {}, False, out, quarantine=True)
    assert done.total_changes == 75 and done.tables_affected == 1
    assert sorted(r.name for r in spark.read.parquet(f"{out}/r1/people.parquet").collect()) == [f"P{i}" for i in range(5)] and done.tables["people"].columns == ["id", "name", "n", "ok"]
    assert spark.read.parquet(f"{out}/r1/_quarantine/people.parquet").count() == 35 and current(spark, out).endswith("/r1")
    assert json.loads(done.changes.first().row_key).keys() == {"__file", "__row"}
    with pytest.raises(RowCeilingError):
        apply_cleansing(spark, "r2", people, tables, configs, {"people": ["id"]}, False, out, max_affected_rows=10)
    with pytest.raises(ValueError, match="exists"):
        apply_cleansing(spark, "r1", people, tables, configs, {}, False, out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["CURRENT", "r1"]
    with pytest.raises(ReadOnlyError):
        apply_cleansing(spark, "r3", ConnectionConfig("f", people.dsn, True), tables, configs, {}, False, out)
    made = Table("main", "people", spark.createDataFrame([(1, "a")], "id long, name string"))
    assert "key columns" in apply_cleansing(spark, "r4", people, [made], configs[:1], {}).errors[0]


def test_values_that_are_no_strings(spark):
    df = spark.createDataFrame([(1, True), (2, None)], "id long, ok boolean")
    new, log = cleanse.standardize(df, "ok", ["id"], case="upper")
    assert [(r.before_value, r.after_value) for r in log.collect()] == [("true", "TRUE")] and new.dtypes == df.dtypes and new.collect() == df.collect()
    assert cleanse.standardize(df, "id", ["id"])[1].count() == 0
    with pytest.raises(ValueError):
        cleanse.standardize(df.withColumn("a", F.array("id")), "a", ["id"])


def test_rules_of_files_reach_other_tables(spark):
    from pathlib import Path

    from auditframe.config import load_rules

    some = load_rules(Path(__file__).parents[1] / "rules/advanced.yaml")
    d = "/root/testdata/sf0.001"
    tables = [Table("main", n, spark.read.parquet(f"{d}/{n}.parquet")) for n in ("orders", "customer", "lineitem")]
    got = {(r.rule_name, r.column_name): r for r in rules.evaluate(spark, targets(some, tables)).collect()}
    assert got["order_customer", "o_custkey"].violations == 0 and got["returned_discount", "l_discount"].violations > 0 and got["balance_not_negative", "c_acctbal"].status == "fail"
    bad = [r for r in some if r.name == "order_customer"]
    assert rules.evaluate(spark, targets(bad, tables[:1])).first().status == "error"


def test_samples(spark, people):
    config = PipelineConfig("f", sampling={"method": "random", "limit": 10, "seed": 3, "keys": ["id"]})
    assert Engine(spark, people, config).tables()[0].df.count() == 10 and Engine(spark, people, config).tables(sampled=False)[0].df.count() == 40
    df = spark.range(100)
    ids = lambda seed: [r.id for r in extra.sample(df, SamplingConfig("random", 10, seed)).collect()]
    assert ids(1) == ids(1) != ids(2)
    for bad in ({"method": "other"}, {"limit": 0}):
        with pytest.raises(ValueError):
            PipelineConfig("f", sampling=bad)


def test_command_line_cleanses(spark, people, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps({"cleansing": [{"operation": "standardize", "table_name": "people", "column_name": "name"}], "keys": {"people": ["id"]}}))
    args = ["profile", "--source", people.dsn, "--config", str(tmp_path / "c.json"), "--report-dir", str(tmp_path), "--output", str(tmp_path / "clean")]
    assert cli.main(args, spark) == 0 and not (tmp_path / "clean").exists()
    assert "cleansing: 40 changes in 1 tables" in capsys.readouterr().err
    assert cli.main([*args, "--commit"], spark) == 0
    text = capsys.readouterr()
    assert "main.people" in text.err and "100.0 % ok" in text.err and text.out.strip().endswith(".html") and (tmp_path / "clean/CURRENT").exists()
