"""Column rules on a stream: every micro-batch is evaluated by the same fused aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..models import RuleConfig
from ..operators.rules import evaluate
from ..plans.scope import targets
from ..sources.catalog import Table


def watch(stream: DataFrame, table_name: str, rules: list[RuleConfig], output: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each batch's results to its own folder under output, so that a repeated batch replaces itself."""

    def one(batch: DataFrame, epoch: int) -> None:
        table = Table("stream", table_name, batch)
        results = evaluate(batch.sparkSession, targets(rules, [table])).withColumn("epoch", F.lit(epoch))
        results.write.mode("overwrite").parquet(f"{output}/epoch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_nulls(stream: DataFrame, at: str, columns: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, rows, nulls of each column) by event time, with late rows up to ``late``."""
    w = F.window(at, width)
    counted = stream.withWatermark(at, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])
    return counted.select(F.col("w.start").alias("window_start"), "rows", *[f"{c}_nulls" for c in columns])
