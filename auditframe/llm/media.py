"""Payload columns cut by content, stored once and rebuilt from chunk lists.

A rolling gear hash runs over each payload (``h = 2 h + gear[byte]`` modulo 2**32, so
32 bytes decide); a chunk ends where the hash's top bits are zero, but not before
``MIN`` and at last after ``MAX`` bytes.  Equal passages give equal chunks wherever
they stand.  A chunk's digest is 16 bytes of BLAKE2b, a payload's its SHA-256.

:func:`ingest` moves no payloads: a first pass over them writes the ordered chunk list
of each, a second the chunks, each compressed with a
dictionary and at most once a task; they are shuffled once, by digest, and stored once a
digest, in buckets of the digest.  Larger tables go through the second pass in up to
``ROUNDS`` rounds, a part of the payloads (by hash) each: a round cuts and compresses its
part only, leaves out what the store has, and its shuffle files go before the next one
starts, so that never a second copy of all chunks is on disk.  :func:`verify` works in
rounds of groups for the same reason.  :func:`rebuild` joins the lists with the store, whose
buckets stay where they are, and puts every payload together again.  Payloads are
rebuilt in groups of about ``GROUP_BYTES``; a group gets each chunk it needs once, so a
chunk that stands in very many payloads is sent once a group and not once a payload.
``verified`` holds the rebuilt bytes against the digest of those that came in.

The dictionary is trained on at most ``SAMPLE`` payloads, ``SAMPLE_BYTES`` of each; it
changes the size of the stored chunks only.

Defined results: repeated rows with equal id and payload count once.  A null payload
has no list and isn't verified (all null) and is rebuilt as null; an empty payload
has an empty list.  A null id is an id of its own.  Equal ids with different payloads
stay apart.  Extra columns are ignored.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, BYTE_VALUE, as_table, forget, materialize, scratch_path, tidy, utf8

MIN, BITS, MAX, LEVEL = 512, 11, 8192, 9
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1500, 16384, 1 << 18
GROUP_BYTES, MOST_BUCKETS, ROUNDS = 16 << 20, 100_000, 4
GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)
_WINDOW = 32


class Store(NamedTuple):
    """What :func:`ingest` wrote: chunk lists, chunks, and what their compression was primed with."""

    lists: DataFrame  # key, whole, n_bytes, chunks, lengths
    chunks: DataFrame  # digest, data
    dictionary: bytes
    n_bytes: int  # of all payloads


def digest(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def cut_points(buf: np.ndarray, bits: int = BITS, block: int = BLOCK) -> np.ndarray:
    """Ends (exclusive) of possible chunks: where the hash of the last 32 bytes has ``bits`` zeros on top."""
    out = []
    for a in range(0, len(buf), block):
        lo = max(0, a - _WINDOW + 1)
        h = GEAR[buf[lo : a + block]]
        step = 1
        while step < _WINDOW:
            shifted = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += shifted
            step *= 2
        out.append(np.flatnonzero(h[a - lo :] < np.uint32(1 << (32 - bits))) + a + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunk_ends(ends: list[int], start: int, stop: int, least: int = MIN, most: int = MAX) -> list[int]:
    """Ends of the chunks of the payload buf[start:stop], given the possible ends."""
    out, at = [], start
    while stop - at > least:
        k = bisect_left(ends, at + least)
        end = ends[k] if k < len(ends) else stop
        at = min(end, at + most, stop)
        out.append(at)
    if at < stop:
        out.append(stop)
    return out


def train_dictionary(samples: list[bytes]) -> bytes:
    """A compression dictionary for chunks like those of the samples; empty if there are too few to train one."""
    cut = [s[a:b] for s in samples for ends in [[0, *chunk_ends(cut_points(np.frombuffer(s, np.uint8)).tolist(), 0, len(s))]] for a, b in zip(ends, ends[1:])]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, cut)) // 8), cut).as_bytes() if len(cut) >= 64 else b""
    except zstandard.ZstdError:
        return b""


def _packer(dictionary: bytes):
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    primed = zstandard.ZstdCompressionDict(dictionary)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_dict_id=False, write_checksum=False)


def _unpacker(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def _list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The list of each payload; repeated rows of a task once."""
    met: set[tuple[object, bytes | None]] = set()
    for batch in as_table(batches):
        buf, off, valid = utf8(batch.column(1))
        ends, view, rows, ids = cut_points(buf).tolist(), memoryview(buf), [], batch.column(0).to_pylist()
        for i in range(batch.num_rows):
            a, b = int(off[i]), int(off[i + 1])
            whole = hashlib.sha256(view[a:b]).digest() if valid[i] else None
            if (ids[i], whole) in met:
                continue
            met.add((ids[i], whole))
            if whole is None:
                rows.append((i, None, None, None, None))
                continue
            cuts = [a, *chunk_ends(ends, a, b)]
            rows.append((i, whole, b - a, [digest(view[x:y]) for x, y in zip(cuts, cuts[1:])], [y - x for x, y in zip(cuts, cuts[1:])]))
        if rows:
            at, *columns = zip(*rows)
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", "whole", "n_bytes", "chunks", "lengths"])


def _chunk_batches(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(digest, data) of every chunk that the task hasn't met before."""
        met, pack = set(), _packer(dictionary)
        for batch in as_table(batches, rows=512):
            buf, off, valid = utf8(batch.column(0))
            ends, view, names, data = cut_points(buf).tolist(), memoryview(buf), [], []
            for i in np.flatnonzero(valid):
                cuts = [int(off[i]), *chunk_ends(ends, int(off[i]), int(off[i + 1]))]
                for x, y in zip(cuts, cuts[1:]):
                    if (name := digest(view[x:y])) not in met:
                        met.add(name)
                        names.append(name)
                        data.append(pack.compress(view[x:y]))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])

    return run


def rounds(n_bytes: int) -> int:
    """In how many rounds chunks are moved; one if there is little to move."""
    return max(1, min(ROUNDS, n_bytes // GROUP_BYTES))


def groups(spark: SparkSession, n_bytes: int, parts: int = 1) -> int:
    """How many groups of about ``GROUP_BYTES`` there are; smaller ones if these are too few for the cores in each of the parts."""
    return max(1, -(-n_bytes // GROUP_BYTES), min(2 * parts * spark.sparkContext.defaultParallelism, n_bytes >> 18))


def _stored(payloads: DataFrame, dictionary: bytes, n_bytes: int) -> DataFrame:
    """(digest, data) of the payloads' chunks, once a digest, in buckets of the digest, so that a join on the digest doesn't move them."""
    spark, name = payloads.sparkSession, f"chunks_{uuid.uuid4().hex}"
    path, parts, n = scratch_path(spark, name), rounds(n_bytes), min(MOST_BUCKETS, groups(spark, n_bytes))
    atexit.register(forget, path, name)
    for part in range(parts):
        some = payloads.where(F.pmod(F.xxhash64("payload"), F.lit(parts)) == part) if parts > 1 else payloads
        chunks = some.mapInArrow(_chunk_batches(dictionary), "digest binary, data binary")
        chunks = chunks.repartition(n, "digest").dropDuplicates(["digest"])  # equal digests have equal bytes, so any copy will do
        if part:
            chunks = chunks.join(spark.table(name).select("digest").hint("shuffle_hash"), "digest", "left_anti")
        with tidy(spark):
            chunks.write.mode("append").bucketBy(n, "digest").option("path", path).option("compression", "uncompressed").saveAsTable(name)
        spark.catalog.refreshTable(name)
    return spark.table(name)


def ingest(df: DataFrame, key: str = "page_id", payload: str = "html") -> Store:
    """The lists and chunks of every row, written to the shared folder."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{payload}`").cast("binary").alias("payload"))
    given = rows.select("payload").where("payload is not null")
    some = given.select(F.substring("payload", 1, SAMPLE_BYTES).alias("p")).limit(SAMPLE).toArrow()
    dictionary = train_dictionary(some.column("p").to_pylist())
    lists = rows.mapInArrow(_list_batches, f"key {kind}, whole binary, n_bytes long, chunks array<binary>, lengths array<int>")
    lists = materialize(lists.dropDuplicates(["key", "whole"]), "lists")
    n_bytes = lists.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return Store(lists, _stored(given, dictionary, n_bytes), dictionary, n_bytes)


def manifest(store: Store, key: str = "page_id") -> DataFrame:
    """(key, n_bytes, digest, n_chunks, chunks, new_bytes) of every payload.

    ``new_bytes`` counts the chunks that occur in no payload of a smaller key (null
    first, then by digest) and, within the payload, not before: one aggregate names the
    first place of each chunk.
    """
    each = store.lists.select("key", "whole", F.posexplode(F.arrays_zip(F.col("chunks").alias("digest"), F.col("lengths").alias("length"))).alias("at", "chunk"))
    place = F.struct(F.col("key").isNotNull().alias("some"), "key", "whole", "at", F.col("chunk.length").alias("length"))
    first = each.groupBy("chunk.digest").agg(F.min(place).alias("f"))
    new = first.groupBy(F.col("f.key").alias("__key"), F.col("f.whole").alias("__whole")).agg(F.sum("f.length").alias("new"))
    rows = store.lists.join(new, F.col("key").eqNullSafe(F.col("__key")) & (F.col("whole") == F.col("__whole")), "left")
    given = F.col("whole").isNotNull()
    return rows.select(
        F.col("key").alias(key), "n_bytes", F.lower(F.hex("whole")).alias("digest"), F.when(given, F.size("chunks")).alias("n_chunks"),
        F.transform("chunks", lambda c: F.lower(F.hex(c))).alias("chunks"), F.when(given, F.coalesce("new", F.lit(0))).alias("new_bytes"),
    )


def _rebuilt(store: Store, schema: str, finish, part: int = 0, parts: int = 1) -> DataFrame:
    """finish(key, payload, whole) of every payload of a part of the groups, put together from the store."""
    lists = store.lists.withColumn("grp", F.pmod(F.xxhash64("key", "whole"), F.lit(groups(store.lists.sparkSession, store.n_bytes, parts))))
    if parts > 1:
        lists = lists.where(F.col("grp") % parts == part)
    need = lists.select(F.col("grp").alias("of"), F.explode("chunks").alias("digest")).distinct()
    sent = store.chunks.join(need.hint("shuffle_hash"), "digest").select("of", "digest", "data")
    dictionary = store.dictionary

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack, held = _unpacker(dictionary), dict(zip(right.column("digest").to_pylist(), right.column("data").to_pylist()))
        made = []
        for whole, names in zip(left.column("whole").to_pylist(), left.column("chunks").to_pylist()):
            parts = None if whole is None else [held.get(n) for n in names]
            made.append(None if parts is None or None in parts else b"".join(map(unpack.decompress, parts)))
        return finish(left.column("key"), made, left.column("whole").to_pylist())

    return lists.groupBy("grp").cogroup(sent.groupBy("of")).applyInArrow(run, schema)


def rebuild(store: Store, key: str = "page_id") -> DataFrame:
    """(key, payload binary, verified) of every payload, put together from the store's chunks; one with a lost chunk is null and not verified."""

    def finish(keys: pa.ChunkedArray, made: list[bytes | None], wholes: list[bytes | None]) -> pa.Table:
        same = [None if w is None else m is not None and hashlib.sha256(m).digest() == w for m, w in zip(made, wholes)]
        return pa.table([keys, pa.array(made, pa.binary()), pa.array(same, pa.bool_())], names=["key", "payload", "verified"])

    kind = store.lists.schema["key"].dataType.simpleString()
    return _rebuilt(store, f"key {kind}, payload binary, verified boolean", finish).select(F.col("key").alias(key), "payload", "verified")


def verify(store: Store, key: str = "page_id") -> DataFrame:
    """(key, n_bytes, digest, verified) of every payload, as measured on the bytes put together from the store.

    All rounds but the last run at once and leave what they measured; the last runs with the result.
    """

    def finish(keys: pa.ChunkedArray, made: list[bytes | None], wholes: list[bytes | None]) -> pa.Table:
        sizes = [None if m is None else len(m) for m in made]
        names = [None if m is None else hashlib.sha256(m).digest() for m in made]
        same = [None if w is None else n == w for n, w in zip(names, wholes)]
        return pa.table([keys, pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(same, pa.bool_())], names=["key", "n_bytes", "digest", "verified"])

    kind, parts = store.lists.schema["key"].dataType.simpleString(), rounds(store.n_bytes)
    each = [_rebuilt(store, f"key {kind}, n_bytes long, digest binary, verified boolean", finish, part, parts) for part in range(parts)]
    measured = reduce(DataFrame.unionAll, [*(materialize(e, "measured") for e in each[:-1]), each[-1]])
    return measured.select(F.col("key").alias(key), "n_bytes", F.lower(F.hex("digest")).alias("digest"), "verified")


def sql(pages: str = "pages") -> str:
    """DuckDB SQL for what :func:`verify` must find: the payloads themselves."""
    return f"SELECT DISTINCT page_id, octet_length(encode(html)) AS n_bytes, sha256(html) AS digest, CASE WHEN html IS NOT NULL THEN true END AS verified FROM {pages}"
