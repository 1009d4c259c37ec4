"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, media, mixing, packing, quality_crf, quality_rules, secrets, sharding, toxicity
from .common import spread, table
from .near_dedup import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, decision and line labels of every document."""
    docs = spread(table(spark, sf_dir, "documents"))
    return quality_crf.classify(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that isn't kept, with the one kept for its group."""
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probability, tier and decision of every document."""
    docs = spread(table(spark, sf_dir, "documents"))
    return quality_rules.score(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every toxic document with its score, hits and terms."""
    docs = spread(table(spark, sf_dir, "documents"))
    ordinary = toxicity.ordinary_words(docs)
    return toxicity.toxic_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), ordinary=ordinary), ordinary=ordinary)


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.assign(table(spark, sf_dir, "documents"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mixture."""
    return mixing.mix(table(spark, sf_dir, "documents"), copy_column="copy").select("doc_id", "source", "copy")


SQL["op4_mixing"] = mixing.sql()


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every conversation."""
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


SQL["op5_chat"] = chat.sql()


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret of every document."""
    return secrets.find(spread(table(spark, sf_dir, "documents")))


@query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of every page's payload as rebuilt from stored chunks, held against the payload that came in."""
    return media.verify(media.ingest(spread(table(spark, sf_dir, "pages"))))


SQL["op8_media"] = media.sql()


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))
