"""Every stage of the pipeline against a plain version on the smallest tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditframe.llm import mixing, near_dedup, packing, quality_crf, secrets

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(str(root / name))
        docs = out[name] = spark.read.parquet(str(root / name))
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    for name in ("quality", "near_dedup", "secrets", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_keeps_what_the_classifier_keeps(spark, stages):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    judged = quality_crf.classify(stages["documents"], quality_crf.train(stages["documents"], labels))
    assert sorted(r.doc_id for r in stages["quality"].collect()) == sorted(r.doc_id for r in judged.where("keep").collect())
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {r.doc_id for r in stages["quality"].collect()}
    assert len(good - kept) <= 0.03 * len(good)


def test_one_of_each_group_stays(stages):
    groups = {r.doc_id: r.keep_id for r in near_dedup.near_groups(stages["quality"]).collect()}
    assert sorted(r.doc_id for r in stages["near_dedup"].collect()) == sorted(set(groups.values()))


def test_secrets_are_masked_and_nothing_else_changes(stages):
    novelty = secrets.Novelty(secrets.vocabulary(secrets.VOCABULARIES))
    before = {r.doc_id: r for r in stages["near_dedup"].collect()}
    after = {r.doc_id: r for r in stages["secrets"].collect()}
    assert set(before) == set(after)
    for i, r in before.items():
        text = r.text
        for a, b, *_ in reversed(secrets.scan(text, novelty)):
            text = text[:a] + secrets.MASK + text[b:]
        assert after[i].text == text and after[i].n_chars == (len(text) if text != r.text else r.n_chars)


def test_mixture(stages):
    con = duckdb.connect()
    con.register("documents", stages["secrets"].toPandas())
    want = Counter((d, s) for d, s, _ in con.execute(mixing.sql()).fetchall())
    assert Counter((r.doc_id, r.source) for r in stages["mixing"].collect()) == want
    assert {r.doc_id for r in stages["mixing"].collect()} == {r.doc_id for r in stages["secrets"].collect()}


def test_bins(spark, stages):
    want = Counter()
    for r in stages["mixing"].collect():
        want[r.doc_id] += len(r.text)
    got = stages["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {k: n for k, n in want.items() if n}
    assert stages["packing"].groupBy("bin_id").agg(F.sum("length").alias("n")).where(f"n > {packing.CAPACITY}").count() == 0


def test_run_equals_stages(spark, stages):
    assert Counter(map(str, corpus_pipeline.run(spark, DIR).collect())) == Counter(map(str, stages["packing"].collect()))


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_documents(spark, tmp_path):
    """Nulls in every column, repeated rows, ties, a very long and empty texts, columns with names used inside."""
    good = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").join(spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(5).collect()]
    rows = [
        (1, good[0], "en", "a", 1), (1, good[0], "en", "a", 1), (2, good[0], None, None, None), (None, good[1], "en", None, 5), (None, good[1], "en", "b", 5), (3, None, "en", "a", None), (4, "", "en", "a", 0),
        (None, None, None, None, None), (5, (good[2] + "\n") * 40, "en", "c", 7), (6, good[3] + ' token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "en", "c", 8), (7, "\n\n", "en", "c", 2), (8, good[4], "en", "c", 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("row", "node", "rank", "copies", "copy", "epochs", "key", "grp", "a.b", "bucket", "root", "nth", "times")})
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    folder = tmp_path / "in"
    spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id > 20").unionByName(docs, allowMissingColumns=True).write.parquet(str(folder / "documents.parquet"))
    labels.where("doc_id > 20").write.parquet(str(folder / "labels.parquet"))
    now, counts = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(folder)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == now.columns
        now = after
        counts[name] = Counter((r.doc_id, r.text) for r in after.where("row = 'row'").collect())
    assert not [k for k in counts["quality"] if not (k[1] or "").strip()]
    kept = counts["near_dedup"]
    assert kept[(1, good[0])] <= 1 and kept[(2, good[0])] == 0 and kept[(None, good[1])] <= 1 and set(kept) <= set(counts["quality"])
    assert all("0641917e" not in t for _, t in counts["secrets"]) and sum(counts["secrets"].values()) == sum(kept.values())
    assert set(counts["mixing"]) == set(counts["secrets"])
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(folder))
    assert packed.agg(F.sum("length")).first()[0] == now.agg(F.sum(F.length("text"))).first()[0]
