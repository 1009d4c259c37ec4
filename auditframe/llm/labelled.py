"""A bounded, reproducible sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN_BYTES = 32 << 20


def sample_labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int, size: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled doc_ids, those of least hash, and of at most ``size`` bytes of text.

    A null label or doc_id isn't used; a doc_id labelled more than once has its least
    label, one with several texts that of least hash; a document without text isn't used.
    Documents are whole: one that would go beyond ``size`` and those after it are left out.
    """
    y = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("y"))
    some = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # so the broadcast has a fixed bound
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # of at most ``bound`` rows
    kept = one.withColumn("sofar", F.sum(F.octet_length("text")).over(before)).where(F.col("sofar") <= size)
    return kept.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id").select("doc_id", "text", "y")
