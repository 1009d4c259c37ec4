"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring.  A key goes to the first point at or
after its own position; a shard takes at most ``ceil((1 + slack) * keys / shards)``
keys, and a key that meets a full shard continues clockwise to the next point of a
shard that isn't full.  Keys arrive in the order of a second hash, so the outcome is a
function of the set of keys alone.

The sequence is simulated without visiting keys one by one: between the moments at
which shards become full (at most one a shard) every point of the ring has a fixed
taker.  A histogram of keys by arrival slice and ring point tells the slices in which a
shard fills; only those are looked at again in finer slices, down to single keys.  Keys
are written in the order of arrival, so a slice reads its part of the files only.  A
histogram has ``_CELLS`` cells at most (one slice of all points at least), whatever the
number of keys and shards.  Then one pass finds each key's taker, for which tasks get the
ring and the moment at which each shard became full.

Defined results: a key is a distinct value of the key column; null is a key like any
other, and repeated rows get their key's shard.  Keys equal in both hashes arrive in
the order of their value.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHARDS, VNODES, SLACK = 16, 64, 0.1
_DIGITS = 15  # hex digits of a position or an arrival
_SPAN = 16**_DIGITS
_CELLS, _EXACT = 1 << 22, 20_000
_NEVER = np.iinfo(np.int32).max


def ring(shards: list[str], vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order, number of the shard of each)."""
    points = sorted((int(hashlib.md5(f"{name}#{v}".encode()).hexdigest()[:_DIGITS], 16), i) for i, name in enumerate(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([i for _, i in points], np.int32)


def takers(owner: np.ndarray, full: np.ndarray) -> np.ndarray:
    """For each point, the first shard clockwise from it that isn't full."""
    open_at = np.flatnonzero(~full[owner])
    if not len(open_at):
        raise ValueError("every shard is full")
    at = np.searchsorted(open_at, np.arange(len(owner)))
    return owner[open_at[at % len(open_at)]]


def takers_at(point: np.ndarray, epoch: np.ndarray, owner: np.ndarray, full_from: np.ndarray) -> np.ndarray:
    """The taker of each key that meets ``point`` in ``epoch``; ``full_from``: the first epoch in which a shard is full."""
    at, out = point.copy(), owner[point]
    todo = np.flatnonzero(full_from[out] <= epoch)
    while len(todo):
        at[todo] = (at[todo] + 1) % len(owner)
        out[todo] = owner[at[todo]]
        todo = todo[full_from[out[todo]] <= epoch[todo]]
    return out


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _keys(docs: DataFrame, key: str) -> DataFrame:
    digest = F.md5(F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit("null")))
    part = lambda a: F.conv(F.substring(digest, a, _DIGITS), 16, 10).cast("long")
    return docs.select(_column(key).alias("key")).distinct().select("key", part(1).alias("position"), part(17).alias("arrival"))


def _in_order(keys: DataFrame) -> DataFrame:
    """keys in the order of arrival, in ranges as arrivals are spread evenly."""
    return keys.repartition(F.expr(f"arrival div {_SPAN // 1024}L")).sortWithinPartitions("arrival")


def _with_point(keys: DataFrame, positions: np.ndarray) -> DataFrame:
    """Replace the position by the number of the ring point that the key meets first."""
    fields = [(f.name, f.dataType.simpleString()) for f in keys.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(positions, batch.column(1).to_numpy()) % len(positions)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), batch.column(2)], ["key", "point", "arrival"])

    return keys.mapInArrow(run, f"key {fields[0][1]}, point int, arrival long")


def _histogram(keys: DataFrame, low: int, high: int, n_points: int) -> tuple[int, np.ndarray]:
    """(slice width, slices x points counts) of the keys arriving from low to below high."""
    slices = max(2, min(256, _CELLS // n_points))
    width = max(1, -(-(high - low) // slices))
    where = keys if (low, high) == (0, _SPAN) else keys.where((F.col("arrival") >= low) & (F.col("arrival") < high))
    got = where.groupBy(F.expr(f"cast((arrival - {low}L) div {width}L as int)").alias("slice"), "point").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros((slices, n_points), np.int64)
    counts[got.column("slice").to_numpy(), got.column("point").to_numpy()] = got.column("n").to_numpy()
    return width, counts


def fill_times(keys: DataFrame, owner: np.ndarray, n_shards: int, slack: float) -> tuple[list[tuple[int, object]], np.ndarray]:
    """([(arrival, key) of the key that filled a shard], the epoch from which each shard is full)."""
    load, full_from = np.zeros(n_shards, np.int64), np.full(n_shards, _NEVER, np.int32)
    events: list[tuple[int, object]] = []
    now = [takers(owner, full_from != _NEVER)]
    most = [0]

    def mark(shard: int) -> None:
        """Begin an epoch; the last shard may be filled by the last key only, with no epoch after it."""
        full_from[shard] = len(events)
        full = full_from != _NEVER
        if not full.all():
            now[0] = takers(owner, full)

    def walk(low: int, high: int) -> None:
        width, counts = _histogram(keys, low, high, len(owner))
        if (low, high) == (0, _SPAN):
            most[0] = math.ceil(round((1 + slack) * int(counts.sum()) / n_shards, 9))
        for i in range(len(counts)):
            if not (n := int(counts[i].sum())):
                continue
            add = np.bincount(now[0], weights=counts[i], minlength=n_shards).astype(np.int64)
            if ((load + add)[full_from == _NEVER] < most[0]).all():
                load[:] += add
            elif n <= _EXACT or width == 1:
                one_by_one(low + i * width, low + (i + 1) * width)
            else:
                walk(low + i * width, low + (i + 1) * width)

    def one_by_one(low: int, high: int) -> None:
        some = keys.where((F.col("arrival") >= low) & (F.col("arrival") < high)).orderBy("arrival", F.col("key").asc_nulls_first()).select("key", "point", "arrival").toArrow()
        for key, point, arrival in zip(some.column("key").to_pylist(), some.column("point").to_pylist(), some.column("arrival").to_pylist()):
            shard = int(now[0][point])
            load[shard] += 1
            if load[shard] >= most[0]:
                events.append((arrival, key))
                mark(shard)

    walk(0, _SPAN)
    return events, full_from


def assign(docs: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """(key, shard) for each distinct value of the key column; shard is the shard's number."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    positions, owner = ring(names, vnodes)
    keys = materialize(_in_order(_with_point(_keys(docs, key), positions)), "ring-keys")
    events, full_from = fill_times(keys, owner, len(names), slack)
    times = np.array([t for t, _ in events], np.int64)
    last = [k for _, k in events]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrival = batch.column(2).to_numpy()
            epoch = np.searchsorted(times, arrival, "left")  # the key that fills a shard still goes there
            again = np.flatnonzero(np.searchsorted(times, arrival, "right") > epoch)
            for i in again:  # equal arrivals: in the order of the keys
                k = batch.column(0)[int(i)].as_py()
                while epoch[i] < len(times) and times[epoch[i]] == arrival[i] and (k is not None and (last[epoch[i]] is None or last[epoch[i]] < k)):
                    epoch[i] += 1
            shard = takers_at(batch.column(1).to_numpy(), epoch, owner, full_from)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard.astype(np.int32))], [key, "shard"])

    kind = keys.schema["key"].dataType.simpleString()
    return keys.mapInArrow(run, f"`{key.replace('`', '``')}` {kind}, shard int")


def shard_rows(docs: DataFrame, key: str = "doc_id", shard_column: str = "__shard", **options) -> DataFrame:
    """The rows of docs with the number of their shard in ``shard_column``."""
    got = assign(docs, key, **options).select(_column(key).alias("assigned"), "shard")
    rows = docs.select(F.struct("*").alias("row"))  # so that no column of docs can clash
    return rows.join(got, F.col("row").getField(key).eqNullSafe(F.col("assigned"))).select("row.*", F.col("shard").alias(shard_column))
