"""SQLite files as a Spark data source: read-only, each table in ranges of its rowid.

The standard library reads the file, so no JDBC driver is needed; all executors must see
the path.  A table without a rowid, or a view, is one range.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_BATCH = 8192


def quoted(name: str) -> str:
    """A name in double quotes, embedded ones doubled."""
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    """A connection that can't write."""
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def path_of(dsn: str) -> str:
    """The file of a ``sqlite:///`` or ``sqlite://`` name."""
    path = dsn.removeprefix("sqlite://")
    return path[1:] if path.startswith("//") or (path.startswith("/") and not dsn.startswith("sqlite:///")) else path


def tables(path: str) -> list[str]:
    """Tables and views by name, without the system's own."""
    with connect(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def spark_type(declared: str) -> T.DataType:
    """By the rules of column affinity."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")) or not d:
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    return T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.StringType()


def schema_of(path: str, table: str) -> T.StructType:
    with connect(path) as db:
        return T.StructType([T.StructField(r[1], spark_type(r[2]), not r[3]) for r in db.execute(f"PRAGMA table_info({quoted(table)})")])


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names, self.kinds = schema.names, [f.dataType for f in schema]
        self.path, self.table, self.parts = options["path"], options["dbtable"], int(options.get("numpartitions", "8"))

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # no rowid
                return [Range(None, None)]
        if not isinstance(low, int) or not isinstance(high, int):
            return [Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where = "" if partition.low is None else " WHERE rowid >= ? AND rowid < ?"
        bounds = () if partition.low is None else (partition.low, partition.high)
        kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BinaryType(): pa.binary()}
        as_kind = {pa.int64(): int, pa.float64(): float, pa.string(): str}
        with connect(self.path) as db:
            cursor = db.execute(f"SELECT {', '.join(map(quoted, self.names))} FROM {quoted(self.table)}{where}", bounds)
            while rows := cursor.fetchmany(_BATCH):
                arrays = []
                for values, kind in zip(zip(*rows), self.kinds):
                    arrow = kinds.get(kind, pa.string())
                    cast = as_kind.get(arrow, lambda v: v if isinstance(v, bytes) else str(v).encode())
                    arrays.append(pa.array([_given(v, cast) for v in values], arrow))
                yield pa.RecordBatch.from_arrays(arrays, names=self.names)


def _given(value, cast):
    """The value as its column's kind; one that isn't of that kind, which SQLite allows, is null."""
    try:
        return None if value is None else cast(value)
    except (TypeError, ValueError):
        return None


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "auditframe_sqlite"

    def schema(self) -> T.StructType:
        return schema_of(self.options["path"], self.options["dbtable"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def load(spark: SparkSession, path: str, table: str, parts: int = 8):
    spark.dataSource.register(SqliteSource)
    return spark.read.format("auditframe_sqlite").option("path", path).option("dbtable", table).option("numpartitions", parts).load()
