"""Cleansing: standardise text, remove duplicates, correct by lookup.

Each operation returns (new table, change log) as lazy frames; rows are named by key
columns of the table, or by file and row number where a table of Parquet files has none.
A dry run logs every operation against the original tables; a committed run chains them,
lookups included, and writes the new tables beside the old ones, never over what it
reads, all or none of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import standardized
from ..models import CHANGE, CleansingConfig, ConnectionConfig, ReadOnlyError, RowCeilingError
from ..sources.catalog import Table, column
from .profile import _conform

Result = tuple[DataFrame, DataFrame]


def _log(rows: DataFrame, operation: str, keys: list[str], before: Column, after: Column, column_name: str | None) -> DataFrame:
    out = rows.select(F.lit(operation).alias("operation"), F.lit(column_name).cast("string").alias("column_name"), F.to_json(F.struct(*[column(k) for k in keys])).alias("row_key"), before.cast("string").alias("before_value"), after.cast("string").alias("after_value"))
    return _conform(out, CHANGE)


def standardize(df: DataFrame, name: str, keys: list[str], trim: bool = True, normalize_spaces: bool = False, case: str | None = None) -> Result:
    """Trim, collapse spaces, change case, in this order; nulls stay, and only changed rows are logged.

    A column that holds no strings is treated as text and read back as its own type.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.BinaryType | T.VariantType):
        raise ValueError(f"standardize can't treat {kind.simpleString()}")
    text = column(name).cast("string")
    new = standardized(text, trim, normalize_spaces, case)
    changed = df.where(column(name).isNotNull() & (new != text))
    return df.withColumn(name, new.cast(kind)), _log(changed, "standardize", keys, column(name), new, name)


def rank_duplicates(df: DataFrame, key_columns: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """df with ``__rank``: 1 for rows that stay."""
    if not key_columns:
        raise ValueError("key_columns is empty")
    filled = reduce(Column.__and__, [column(k).isNotNull() for k in key_columns])
    by = [column(c).asc() if keep == "first" else column(c).desc() for c in order]
    # rows without a full key are spread by their order columns instead of all meeting in one task
    spread = [F.when(~filled, F.xxhash64(*map(column, order)))]
    rank = F.row_number().over(Window.partitionBy(*map(column, key_columns), *spread).orderBy(*by))
    return df.withColumn("__rank", F.when(filled, rank).otherwise(1))


def deduplicate(df: DataFrame, key_columns: list[str], order: list[str], keep: str = "first", settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> Result:
    """One row of each key: the first by ``order``, or the last if keep isn't ``first``; rows with a null in the key all stay.

    The whole removed row is logged as JSON.  Both results come from one ranked table;
    ``settle`` may write it, so that it is ranked once and read twice.
    """
    ranked = settle(rank_duplicates(df, key_columns, order, keep))
    gone = ranked.where("__rank > 1").drop("__rank")
    whole = [column(c) for c in df.columns if not c.startswith("__")]
    return ranked.where("__rank = 1").drop("__rank"), _log(gone, "deduplicate", order, F.to_json(F.struct(*whole), {"ignoreNullFields": "false"}), F.lit(None), None)


def lookup_correct(df: DataFrame, name: str, keys: list[str], lookup: DataFrame, from_column: str = "from_value", to_column: str = "to_value", order: list[str] | None = None) -> Result:
    """Values found in the lookup replaced by its target, which may be null; of equal sources the last by ``order`` wins; null sources match nothing.

    Identity replacements are logged too.  The planner broadcasts the lookup if it is
    small enough.  Sources of another type family than the column match nothing.
    """
    family = lambda t: "number" if isinstance(t, T.NumericType) else t.typeName()
    if family(df.schema[name].dataType) != family(lookup.schema[from_column].dataType):
        return df, df.sparkSession.createDataFrame([], CHANGE)
    last = F.struct(*[column(c) for c in (order or [to_column])])
    chosen = lookup.where(column(from_column).isNotNull()).groupBy(column(from_column).alias("__from")).agg(F.max_by(F.struct(column(to_column).alias("to")), last).alias("__hit"))
    joined = df.join(chosen, column(name) == F.col("__from"), "left")
    target = F.col("__hit.to").cast(df.schema[name].dataType)
    hits = joined.where("__hit is not null")
    log = _log(hits, "lookup_correct", keys, column(name), target, name)
    return joined.withColumn(name, F.when(F.col("__hit").isNotNull(), target).otherwise(column(name))).select(*map(column, df.columns)), log


@dataclass
class CleansingResult:
    changes: DataFrame
    tables: dict[str, DataFrame]
    errors: list[str] = field(default_factory=list)

    @property
    def total_changes(self) -> int:
        return self.changes.count()

    @property
    def tables_affected(self) -> int:
        return self.changes.select("table_name").distinct().count()


def with_row_identity(df: DataFrame) -> DataFrame:
    """A table of Parquet files with each row's file and number in it."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException as e:
        raise ValueError("the table needs key columns, as its rows have no place in a Parquet file") from e


def _one(config: CleansingConfig, df: DataFrame, keys: list[str], tables: dict[str, DataFrame], settle: Callable[[DataFrame], DataFrame]) -> Result:
    p = dict(config.params)
    if config.operation in ("standardize", "lookup_correct") and not config.column_name:
        raise ValueError(f"{config.operation} needs a column_name")
    if config.column_name and config.column_name not in df.columns:
        raise ValueError(f"no column {config.column_name}")
    if config.operation == "standardize":
        return standardize(df, config.column_name, keys, p.get("trim", True), p.get("normalize_spaces", False), p.get("case"))
    if config.operation == "deduplicate":
        return deduplicate(df, p.get("key_columns") or [], keys, p.get("keep", "first"), settle)
    if config.operation == "lookup_correct":
        if not p.get("lookup_table"):
            raise ValueError("lookup_correct needs a lookup_table")
        return lookup_correct(df, config.column_name, keys, tables[p["lookup_table"]], p.get("from_column", "from_value"), p.get("to_column", "to_value"), p.get("order"))
    raise ValueError(f"unknown operation {config.operation!r}")


class _Output:
    """A run's folder, written aside and given its name when it is whole."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id
        self.aside, self.final, self.steps = f"{self.root}/_{run_id}", f"{self.root}/{run_id}", 0
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.exists(self._path(self.final)):
            raise ValueError(f"{self.final} exists already")

    def settle(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        path = f"{self.aside}/_steps/{self.steps}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def done(self) -> None:
        """The folder gets its name, and ``CURRENT`` names it as the last whole run."""
        self._fs.delete(self._path(f"{self.aside}/_steps"), True)
        if not self._fs.rename(self._path(self.aside), self._path(self.final)):
            raise OSError(f"{self.aside} can't be renamed")
        out = self._fs.create(self._path(f"{self.root}/CURRENT"), True)
        try:
            out.write(bytearray(self.run_id.encode()))
        finally:
            out.close()

    def undo(self) -> None:
        self._fs.delete(self._path(self.aside), True)


def apply_cleansing(spark: SparkSession, run_id: str, connection: ConnectionConfig, tables: list[Table], configs: list[CleansingConfig], keys: dict[str, list[str]], dry_run: bool = True, output: str | None = None, max_affected_rows: int | None = None, quarantine: bool = False) -> CleansingResult:
    """All enabled operations in order; one that can't be applied is reported in ``errors`` and skipped whole.

    ``keys`` names each table's key columns; a table that isn't named there has its rows named by
    file and number.  A read-only connection is refused before anything is read.  Without
    dry_run the changed tables and the log are written as Parquet under ``output``, with the
    removed rows as tables under ``_quarantine`` if wanted.  More changes than
    ``max_affected_rows`` are a RowCeilingError.  If anything fails, nothing is left.
    """
    if connection.read_only:
        raise ReadOnlyError(f"connection {connection.id} is read-only")
    target = _Output(spark, output, run_id) if output and not dry_run else None
    try:
        return _apply(spark, run_id, tables, configs, keys, dry_run, target, max_affected_rows, quarantine)
    except BaseException:
        if target:
            target.undo()
        raise


def _apply(spark: SparkSession, run_id: str, tables: list[Table], configs: list[CleansingConfig], keys: dict[str, list[str]], dry_run: bool, target: _Output | None, most: int | None, quarantine: bool) -> CleansingResult:
    original = {t.table_name: t.df for t in tables}
    schemas = {t.table_name: t.schema_name for t in tables}
    now, logs, errors, touched, removed = dict(original), [], [], [], {}
    keys, named = dict(keys), {}
    for config in configs:
        if not config.enabled:
            continue
        name = config.table_name
        try:
            if name not in keys:
                named[name] = now[name] = with_row_identity(original[name])
                keys[name] = ["__file", "__row"]
            base = named.get(name, original[name]) if dry_run else now[name]
            new, log = _one(config, base, keys[name], original if dry_run else now, target.settle if target else lambda df: df)
        except (KeyError, ValueError) as e:
            errors.append(f"{config.operation} on {name}: {e}")
            continue
        now[name] = new
        touched.append(name)
        log = log.withColumns({"run_id": F.lit(run_id), "schema_name": F.lit(config.schema_name or schemas[name]), "table_name": F.lit(name)})
        logs.append(log)
        if config.operation == "deduplicate":
            removed.setdefault(name, []).append(log)
    changes = reduce(DataFrame.unionByName, logs) if logs else spark.createDataFrame([], CHANGE)
    for name in named:
        now[name] = now[name].drop("__file", "__row")
    if target:
        changes.write.parquet(f"{target.aside}/_changes")
        changes = spark.read.schema(CHANGE).parquet(f"{target.aside}/_changes")
    if most is not None and changes.limit(most + 1).count() > most:
        raise RowCeilingError(f"run {run_id} would change more than {most} rows")
    if target:
        for name in dict.fromkeys(touched):
            now[name].write.parquet(f"{target.aside}/{name}.parquet")
        for name, log in removed.items() if quarantine else ():
            gone = changes.where((F.col("table_name") == name) & (F.col("operation") == "deduplicate")).select(F.from_json("before_value", original[name].schema).alias("r")).select("r.*")
            gone.write.parquet(f"{target.aside}/_quarantine/{name}.parquet")
        target.done()
        changes = spark.read.schema(CHANGE).parquet(f"{target.final}/_changes")
        now |= {name: spark.read.schema(now[name].schema).parquet(f"{target.final}/{name}.parquet") for name in dict.fromkeys(touched)}
    return CleansingResult(changes, original if dry_run else now, errors)


def current(spark: SparkSession, output: str) -> str | None:
    """The folder of the last whole run under ``output``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{output.rstrip('/')}/CURRENT")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return f"{output.rstrip('/')}/{spark.read.text(path.toString()).first()[0]}"
