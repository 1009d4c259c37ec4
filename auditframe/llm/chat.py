"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of one
role are merged with a line break between them; each merged turn becomes a block with
its role, and the blocks are joined to one text.  ``<|`` inside a text is written
``< |`` so that no text can open a block.

Defined results: rows without conv_id belong to no conversation and are left out.
Turns with equal numbers are ordered by role, then text; a null turn, role or text
sorts first.  Repeated identical rows count once.  A null role is written ``unknown``
and merges with that role; a null text is written as an empty one.  Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def _runs(turns: Column) -> Column:
    """Where, from 1, a role begins that differs from the one before."""
    at = F.sequence(F.lit(1), F.size(turns))
    return F.filter(at, lambda i: (i == 1) | (turns[i - 1]["role"] != turns[F.greatest(i - 2, F.lit(0))]["role"]))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_merged, roles, text) of each conversation."""
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    rows = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    every = F.sequence(F.lit(1), F.size("all"))
    fresh = F.filter(every, lambda i: (i == 1) | ~F.col("all")[i - 1].eqNullSafe(F.col("all")[F.greatest(i - 2, F.lit(0))]))
    text = lambda t: F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|"), F.lit("< |"))
    role = lambda t: F.replace(F.coalesce(t["role"], F.lit("unknown")), F.lit("<|"), F.lit("< |"))
    rows = rows.select("conv_id", F.transform(fresh, lambda i: F.struct(role(F.col("all")[i - 1]).alias("role"), text(F.col("all")[i - 1]).alias("text"))).alias("turns"))
    rows = rows.select("conv_id", "turns", _runs(F.col("turns")).alias("first"))
    size, n = F.size("turns"), F.size("first")

    def block(start: Column, k: Column) -> Column:
        stop = F.when(k + 1 < n, F.col("first")[F.least(k + 1, n - 1)]).otherwise(size + 1)
        merged = F.array_join(F.slice(F.col("turns.text"), start, stop - start), "\n")
        return F.struct(F.col("turns")[start - 1]["role"].alias("role"), merged.alias("text"))

    rows = rows.select("conv_id", size.alias("n_turns"), F.transform("first", block).alias("merged"))
    blocks = F.transform("merged", lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(MIDDLE), m["text"], F.lit(CLOSE)))
    return rows.select("conv_id", "n_turns", F.size("merged").alias("n_merged"), F.array_join("merged.role", ",").alias("roles"), F.array_join(blocks, "").alias("text"))


def sql(conversations: str = "conversations") -> str:
    """DuckDB SQL with the same rows."""
    return f"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM {conversations} WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
             replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM d),
c AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY k) THEN 0 ELSE 1 END AS starts FROM o),
g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY k) AS grp FROM c),
m AS (SELECT conv_id, grp, min(role) AS role, string_agg(text, chr(10) ORDER BY k) AS text, count(*) AS n FROM g GROUP BY conv_id, grp)
SELECT conv_id, CAST(sum(n) AS INTEGER) AS n_turns, CAST(count(*) AS INTEGER) AS n_merged, string_agg(role, ',' ORDER BY grp) AS roles,
       string_agg(concat('<|', role, '|>', chr(10), text, chr(10), '<|end|>', chr(10)), '' ORDER BY grp) AS text
FROM m GROUP BY conv_id"""
