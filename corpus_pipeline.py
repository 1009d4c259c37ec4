"""The corpus pipeline: documents to packed training bins.

Five stages, each over all rows its predecessor kept.  Documents that the quality
classifier rejects go, one document of each near-duplicate group stays, secrets are
masked in the texts, sources are repeated to their target weights, and the result is
packed into bins.  The labelled rows that the classifier is fitted on are those of the
table ``labels`` beside the documents; without usable labels every text is kept.

Defined results: a document with a null, empty or wordless text has no quality and goes,
unless there are no labels.  Documents with a null doc_id are documents like others; rows
equal in doc_id and text are copies, of which one stays until the mixture repeats it.  A
null source is a source.  Extra columns are kept by all stages but the last, whatever their
names.  Empty tables give an empty result.

All stages but the last return the columns of documents.  Mixing needs whole tables and
packing is a search, so there is no SQL for run(); tests hold it against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditframe.llm import mixing, near_dedup, packing, quality_crf, secrets
from auditframe.llm.common import materialize, release, spread, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.keep_good(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", dedup),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spread(table(spark, sf_dir, "documents")), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            release(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
