"""Shared pieces: tables, shared scratch folder, and byte-level text kernels.

The text kernels work on the UTF-8 buffer of a whole Arrow batch with numpy, so
no Python code runs per character or per word.  Byte-wide temporaries are made
in pieces of ``BLOCK`` bytes whatever the length of a text.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BLOCK = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with its rows spread over all cores if it has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --------------------------------------------------------------------------
# scratch tables in the folder all executors share


def scratch_base(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a purely local session without that setting gets a temporary folder;
    on a cluster the setting is required.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="auditframe-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when their write ends; what is written is what later steps read."""
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    atexit.register(forget, path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize` once nothing reads it any more."""
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, root)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def forget(path: str, table_name: str | None = None) -> None:
    """At the end of the driver's process: drop a scratch table, wherever the shared folder is, if it is still there."""
    spark = SparkSession._instantiatedSession
    try:
        if spark is not None and spark._jsc.sc() is not None and not spark._jsc.sc().isStopped():
            if table_name:
                spark.sql(f"DROP TABLE IF EXISTS {table_name}")
            _delete(spark, path)
            return
    except (OSError, RuntimeError, Py4JError):
        pass  # the JVM is gone
    local = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(local):
        shutil.rmtree(local, ignore_errors=True)


def map_rows(df: DataFrame, run) -> DataFrame:
    """df.mapInArrow(run) with df's own columns, whatever their names."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


# --------------------------------------------------------------------------
# hashing


def _splitmix(n: int, seed: int) -> np.ndarray:
    out, x, m = [], seed, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & m
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = _splitmix(256, 11)
POWER_BASE = 0x9E3779B97F4A7C15 | 1
IS_WORD = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


# --------------------------------------------------------------------------
# Arrow batches as bytes


def as_table(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``rows`` rows and about ``size`` bytes (one row at least)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        per_row = max(1, batch.nbytes // n)
        step = max(1, min(rows, size // per_row))
        while at < n:
            yield batch.slice(at, step)
            at += step


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string or binary array; a null is an empty text."""
    wide = pa.large_binary()
    array = array.cast(pa.large_string()).cast(wide) if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else array.cast(wide)
    valid = np.asarray(array.is_valid())
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, off_buf, data = array.buffers()
    off = np.frombuffer(off_buf, np.int64)[array.offset : array.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if not valid.all():  # a null slot may span bytes
        lens = np.where(valid, np.diff(off), 0)
        keep = np.repeat(valid, np.diff(off))
        buf, off = buf[keep], np.concatenate([[0], np.cumsum(lens)])
    return buf, off, valid


def pieces(buf: np.ndarray, off: np.ndarray, block: int = BLOCK, inside: np.ndarray = IS_WORD) -> Iterator[tuple[int, int]]:
    """Ranges of about ``block`` bytes that cut no word."""
    n, a = len(buf), 0
    while a < n:
        b = min(n, a + block)
        if b < n:
            back = np.flatnonzero(~inside[buf[a:b]])
            if len(back):
                b = a + int(back[-1]) + 1
            else:  # one word longer than a block
                while b < n:
                    ahead = np.flatnonzero(~inside[buf[b : b + block]])
                    if len(ahead):
                        b += int(ahead[0])
                        break
                    b = min(n, b + block)
        yield a, b
        a = b


def runs_of(buf: np.ndarray, off: np.ndarray, block: int = BLOCK, inside: np.ndarray = IS_WORD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, start, length) of every run of bytes of a class within one text, piece by piece; ASCII and Latin-1 letters are lower-cased first."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    for a, b in pieces(buf, off, block, inside):
        p = buf[a:b]
        m = inside[p]
        st = m.copy()
        st[1:] &= ~m[:-1] | edge[a + 1 : b]
        s = np.flatnonzero(st)
        if not len(s):
            continue
        low = LOWER[p]
        high = np.flatnonzero(p[:-1] == 0xC3) + 1
        high = high[(p[high] >= 0x80) & (p[high] <= 0x9E) & (p[high] != 0x97)]
        low[high] += 32
        first = (np.cumsum(m) - 1)[s]
        c = low[m]
        lens = np.diff(np.append(first, len(c)))
        pos = np.arange(len(c)) - np.repeat(first, lens)
        power = np.cumprod(np.full(int(lens.max()), POWER_BASE, np.uint64))
        yield mix64(np.add.reduceat(BYTE_VALUE[c] * power[pos], first)), s + a, lens


def words(buf: np.ndarray, off: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of the batch.

    A word is a run of ASCII letters, digits and non-ASCII bytes within one text.
    """
    found = [(h, start) for h, start, _ in runs_of(buf, off, block)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; an empty segment is 0.

    Each segment is summed on its own, so a row's result doesn't depend on the
    rows it shares a batch with.
    """
    out = np.zeros(len(bounds) - 1, values.dtype if values.dtype != bool else np.int64)
    if len(values):
        full = bounds[1:] > bounds[:-1]
        if full.any():
            out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out
