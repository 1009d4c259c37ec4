"""Where tables come from: folders of files, Spark's catalog, SQLite files, JDBC databases."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import ConnectionConfig, PipelineConfig
from . import sqlite
from .sqlite import quoted

_READERS = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json"}


@dataclass
class Table:
    schema_name: str
    table_name: str
    df: DataFrame

    @property
    def columns(self) -> list[tuple[str, str, bool]]:
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.df.schema]


def dialect(dsn: str) -> str:
    """files, catalog, sqlite or jdbc; an unknown scheme is a ValueError."""
    if dsn.startswith("sqlite://"):
        return "sqlite"
    if dsn.startswith(("jdbc:", "postgresql://", "postgres://")):
        return "jdbc"
    if dsn.startswith("catalog:"):
        return "catalog"
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", dsn)
    if scheme is None or scheme[1] in ("file", "hdfs", "s3a", "abfss", "gs"):
        return "files"
    raise ValueError(f"unknown kind of source: {scheme[1]}")


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def qualified(schema_name: str | None, table_name: str) -> str:
    return quote(table_name) if not schema_name or schema_name == "main" else f"{quote(schema_name)}.{quote(table_name)}"


def column(name: str):
    return F.col(quote(name))


def _files(spark: SparkSession, root: str) -> list[Table]:
    """Every table file or folder right under root, by name; hidden ones and other suffixes are left out."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)
    found = []
    for path in sorted(str(e.getPath()) for e in entries):
        name = path.rstrip("/").rpartition("/")[2]
        kind = _READERS.get(Path(name).suffix)
        if kind and not name.startswith((".", "_")):
            reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
            found.append(Table("main", Path(name).stem, reader.format(kind).load(path)))
    return found


def _catalog(spark: SparkSession, database: str | None) -> list[Table]:
    names = [database] if database else sorted(d.name for d in spark.catalog.listDatabases())
    return [Table(d, t.name, spark.table(qualified(None if t.isTemporary else d, t.name))) for d in names for t in sorted(spark.catalog.listTables(d), key=lambda t: t.name)]


def jdbc_options(connection: ConnectionConfig) -> dict[str, str]:
    """Options of a JDBC read: URL, credentials and TLS from a ``postgresql://`` name and the connection's options."""
    dsn, options = connection.dsn, {k: str(v) for k, v in connection.options.items() if k != "ssl"}
    if not dsn.startswith("jdbc:"):
        url = urlsplit(dsn)
        place = url.hostname or "localhost"
        query = f"?{url.query}" if url.query else ""
        options = {"url": f"jdbc:postgresql://{place}{f':{url.port}' if url.port else ''}{url.path}{query}"} | options
        options |= {k: unquote(v) for k, v in (("user", url.username), ("password", url.password)) if v and k not in options}
    else:
        options = {"url": dsn} | options
    ssl = connection.options.get("ssl")
    if ssl:
        options |= {"ssl": "true"} | {f"ssl{k}": str(v) for k, v in (ssl.items() if isinstance(ssl, dict) else ())}
    if connection.read_only:
        options.setdefault("sessionInitStatement", "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY")
    return options


def jdbc_reads(spark: SparkSession, options: dict[str, str], names: list[tuple[str, str]]) -> list[tuple[str, str, dict[str, str]]]:
    """(schema, table, read options) of each table; ``partitionColumn``, bounds and ``numPartitions`` apply to the tables named in ``partitioned`` (all, if it isn't given)."""
    only = options.get("partitioned")
    split = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    out = []
    for schema, table in names:
        own = {k: v for k, v in options.items() if k != "partitioned" and (k not in split or only is None or table in only.split(","))}
        out.append((schema, table, own | {"dbtable": f"{quoted(schema)}.{quoted(table)}"}))
    return out


def _jdbc(spark: SparkSession, connection: ConnectionConfig) -> list[Table]:
    """Tables and views of the information schema; needs the database's JDBC driver on the class path."""
    options = jdbc_options(connection)
    plain = {k: v for k, v in options.items() if k in ("url", "user", "password", "driver", "sessionInitStatement") or k.startswith("ssl")}
    rows = spark.read.format("jdbc").options(**plain).option("query", "SELECT DISTINCT table_schema, table_name FROM information_schema.columns WHERE table_schema NOT IN ('pg_catalog', 'information_schema')").load().collect()
    return [Table(s, t, spark.read.format("jdbc").options(**own).load()) for s, t, own in jdbc_reads(spark, options, sorted((r[0], r[1]) for r in rows))]


def _sqlite(spark: SparkSession, dsn: str) -> list[Table]:
    path = sqlite.path_of(dsn)
    return [Table("main", t, sqlite.load(spark, path, t)) for t in sqlite.tables(path)]


def discover(spark: SparkSession, connection: ConnectionConfig) -> list[Table]:
    kind = dialect(connection.dsn)
    if kind == "jdbc":
        return _jdbc(spark, connection)
    if kind == "sqlite":
        return _sqlite(spark, connection.dsn)
    if kind == "catalog":
        return _catalog(spark, connection.dsn.removeprefix("catalog:") or None)
    return _files(spark, connection.dsn)


def select_tables(tables: list[Table], config: PipelineConfig) -> list[Table]:
    """Include lists first, then exclude lists; names are exact and an empty list doesn't filter."""

    def passes(name: str, include: list[str], exclude: list[str]) -> bool:
        return (not include or name in include) and name not in exclude

    return [t for t in tables if passes(t.schema_name, config.include_schemas, config.exclude_schemas) and passes(t.table_name, config.include_tables, config.exclude_tables)]


def columns_frame(spark: SparkSession, tables: list[Table]) -> DataFrame:
    rows = [(t.schema_name, t.table_name, *c) for t in tables for c in t.columns]
    return spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, data_type string, nullable boolean")
