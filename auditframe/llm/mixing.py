"""Sources mixed to target weights by capped water-filling.

Source s holds ``size`` characters and has a target weight.  A level is raised until
the mixture holds ``budget`` characters: each source contributes ``level * weight``
but never more than ``max_epochs`` times its size; what a clamped source can't give is
spread over the others in proportion to their weights, until all fit (found at once
from the sources in the order in which they clamp).  A source's epochs are its
contribution over its size: every document is repeated by the whole part, and once
more if its seeded hash falls under the fraction.

Without given weights a source weighs ``size ** ALPHA``; without a given budget it is
the least at which every source is seen at least once, so nothing is dropped.  A
budget beyond what the caps allow gives every source ``max_epochs``.

Defined results: a null source is a source of its own.  Null and empty texts hold no
characters and follow their source's epochs; a source without characters has one epoch.
A source without a weight, or with one that is null or not above 0, contributes nothing.
A source given several weights has their sum.  Rows with equal doc_id and text are
repeated alike; a null doc_id hashes like an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MAX_EPOCHS, ALPHA, SEED = 4.0, 0.7, 17


def sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("size"))


def epochs(sized: DataFrame, weights: DataFrame | None = None, budget: float | None = None, max_epochs: float = MAX_EPOCHS, alpha: float = ALPHA) -> DataFrame:
    """(source, size, epochs) from (source, size) and, if given, (source, weight)."""
    if weights is None:
        w = sized.withColumn("weight", F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(float(alpha)))))
    else:
        given = weights.groupBy(F.col("source").alias("__s")).agg(F.sum(F.when(F.col("weight") > 0, F.col("weight").cast("double"))).alias("weight"))
        w = sized.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    live = (F.col("size") > 0) & (F.col("weight") > 0)
    full = F.when(live, F.lit(float(max_epochs)) * F.col("size"))
    at = F.when(live, F.col("size") / F.col("weight"))  # the level at which the source is seen once
    everyone = Window.partitionBy()  # one row a source
    before = Window.partitionBy().orderBy(F.col("at").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("at", at).withColumn("full", full).withColumn("live_weight", F.when(live, F.col("weight")))
    total = F.sum("live_weight").over(everyone)
    if budget is None:
        lowest = F.max("at").over(everyone)
        w = w.withColumn("__lowest", lowest).withColumn("__budget", F.sum(F.least(F.col("full"), F.col("__lowest") * F.col("live_weight"))).over(everyone))
    else:
        w = w.withColumn("__budget", F.lit(float(budget)))
    # with the sources before this one clamped, the level at which the budget is met
    w = w.withColumn("__level", F.try_divide(F.col("__budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0)), total - F.coalesce(F.sum("live_weight").over(before), F.lit(0.0))))
    # the first source, in that order, that isn't clamped at its own level sets the level for all
    level = F.min(F.when(F.col("__level") <= float(max_epochs) * F.col("at"), F.struct(F.col("at"), F.col("source"), F.col("__level").alias("level")))).over(everyone)["level"]
    w = w.withColumn("level", level)
    e = F.when(live, F.when(F.col("level").isNull(), F.lit(float(max_epochs))).otherwise(F.least(F.lit(float(max_epochs)), F.col("level") / F.col("at")))).when(F.col("size") == 0, 1.0 if weights is None else F.when(F.col("weight") > 0, 1.0).otherwise(0.0)).otherwise(0.0)
    return w.select("source", "size", F.round(e, 9).alias("epochs"))


def copies(docs: DataFrame, per_source: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, copies): each row of docs as a struct, so that its columns can't clash, and how often it is repeated."""
    per = per_source.select(F.col("source").alias("named"), "epochs")
    rows = docs.select(F.struct("*").alias("row"))
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(16**12)
    whole = F.floor("epochs")
    joined = rows.join(per, F.col("row.source").eqNullSafe(F.col("named")))
    return joined.select("row", (whole + F.when(chance < F.col("epochs") - whole, 1).otherwise(0)).cast("int").alias("copies"))


def mix(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, max_epochs: float = MAX_EPOCHS, alpha: float = ALPHA, seed: int = SEED, copy_column: str | None = None) -> DataFrame:
    """The rows of docs, each as often as its source's epochs say, numbered from 1 in ``copy_column`` if that is given.

    The table of epochs has one row a source and is written first, so that the planner
    knows its size when it chooses the join.
    """
    per = materialize(epochs(sizes(docs), weights, budget, max_epochs, alpha), "epochs")
    rows = copies(docs, per, seed).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("row.*", *([F.col("copy").alias(copy_column)] if copy_column else []))


def sql(docs: str = "documents", max_epochs: float = MAX_EPOCHS, alpha: float = ALPHA, seed: int = SEED) -> str:
    """DuckDB SQL for mix(docs) without given weights or budget: (doc_id, source, copy)."""
    return f"""
WITH sized AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS size FROM {docs} GROUP BY source),
w AS (SELECT source, size, CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), {alpha}) END AS weight FROM sized),
a AS (SELECT *, size / weight AS at_, {max_epochs} * size AS full_ FROM w WHERE size > 0),
b AS (SELECT (SELECT sum(least(full_, (SELECT max(at_) FROM a) * weight)) FROM a) AS budget, (SELECT sum(weight) FROM a) AS total),
l AS (SELECT a.*, (budget - coalesce(sum(full_) OVER before, 0)) / (total - coalesce(sum(weight) OVER before, 0)) AS lvl, row_number() OVER (ORDER BY at_, source NULLS FIRST) AS rn
      FROM a, b WINDOW before AS (ORDER BY at_, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(lvl, rn) AS lvl FROM l WHERE lvl <= {max_epochs} * at_),
e AS (SELECT w.source, round(CASE WHEN w.size = 0 THEN 1.0 WHEN c.lvl IS NULL THEN {max_epochs} ELSE least({max_epochs}, c.lvl / (w.size / w.weight)) END, 9) AS epochs FROM w, c),
n AS (SELECT d.doc_id, d.source, floor(epochs) + CASE WHEN CAST(concat('0x', substr(md5(concat('{seed}:', coalesce(CAST(d.doc_id AS VARCHAR), ''))), 1, 12)) AS BIGINT) / {float(16**12)} < epochs - floor(epochs) THEN 1 ELSE 0 END AS copies
      FROM {docs} d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, CAST(unnest(range(1, CAST(copies AS BIGINT) + 1)) AS INTEGER) AS copy FROM n"""
