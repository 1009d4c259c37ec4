"""Near-duplicate documents: MinHash bands propose, odd sketches verify.

Each text becomes the set of its word 3-grams (lower-cased words; a text of
fewer than three words is one shingle).  One-permutation MinHash splits the hash
range into ``BINS`` bins and keeps the least value of each.  From those samples:

* band keys, ``ROWS`` samples each, propose candidates (empty bins borrow from
  the next filled one);
* an odd sketch, ``ODD_BITS`` parity bits into which every (bin, sample) pair is
  folded.  The XOR of two sketches has popcount p, so the two sample sets differ
  in about ``-m/2 * ln(1 - 2p/m)`` members (m bits), and with the bitmaps of filled
  bins that gives the Jaccard similarity.

Documents whose estimate is at or over ``threshold`` less ``MARGIN`` are linked, so that
the noise of the sketches loses few pairs at the threshold itself; a group is a connected component.
Inside a bucket the links are found by breadth-first search against the members
not reached yet, which gives exactly the bucket's components without comparing
every pair of a large group.  No bucket, group or candidate list is capped.

A bucket of more than about ``HOT`` members isn't one task's work: a sample of the
documents (one in ``SAMPLE``) shows which keys are that common, and their buckets are
cut into parts by a hash.  The parts are searched each on its own, then one member of
each component found so far against those of the others, and last every member outside a
bucket's largest component against all members of the bucket, in blocks
(:func:`hot_links`).  Any two members of a bucket are then in one component or have been
compared, as in a bucket of one task; the sample decides on the way only.

Defined results: a null text belongs to no group.  Equal texts (including empty
ones) are exact copies; a text without words has no other partner.  Identity of
texts is their 64-bit xxhash.  Of a group the row with the smallest doc_id stays
(a null doc_id sorts last); repeated rows of one doc_id and text count as copies, so one
stays: that whose columns have the least hash.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, materialize, mix64, release, utf8, words

BINS, ROWS, BANDS, ODD_BITS, SHINGLE, THRESHOLD, MARGIN = 256, 4, 64, 1024, 3, 0.45, 0.07
HOT, SAMPLE = 16384, 64
_VAL_BITS = np.uint64(40)
_VAL_MASK = np.uint64((1 << 40) - 1)
_SKETCH = "node long, sketch binary, bands array<long>"


# -- sketches ---------------------------------------------------------------


def shingle_hashes(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every word n-gram; documents shorter than that give one."""
    h, start = words(buf, off)
    if not len(h):
        return h, np.zeros(0, np.int64)
    at = np.searchsorted(start, off)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    left = np.repeat(at[1:], count) - np.arange(len(h))  # words from here to the end
    grams = h.copy()
    for k in range(1, size):
        mult = np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64))
        nxt = np.zeros(len(h), np.uint64)
        nxt[:-k] = h[k:]
        nxt[left <= k] = 0
        grams += nxt * mult
    keep = (left >= size) | ((count[doc] < size) & (left == count[doc]))
    return mix64(grams[keep]), doc[keep]


def samples(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents x BINS matrix of one-permutation MinHash samples; the top value marks an empty bin."""
    n = len(off) - 1
    out = np.full((n, BINS), np.iinfo(np.uint64).max, np.uint64)
    h, doc = shingle_hashes(buf, off)
    if len(h):
        key = (doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(56) << _VAL_BITS) | (h & _VAL_MASK)
        key.sort()
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] >> _VAL_BITS) != (key[:-1] >> _VAL_BITS)
        key = key[head]
        out[(key >> np.uint64(48)).astype(np.int64), ((key >> _VAL_BITS) & np.uint64(255)).astype(np.int64)] = key & _VAL_MASK
    return out


def odd_sketches(s: np.ndarray) -> np.ndarray:
    """Documents x bytes: the parity bitmap, then the bitmap of filled bins."""
    n = len(s)
    filled = s != np.iinfo(np.uint64).max
    row, b = np.nonzero(filled)
    bit = mix64(s[row, b] * np.uint64(BINS) + b.astype(np.uint64)) & np.uint64(ODD_BITS - 1)
    parity = np.bincount(row * ODD_BITS + bit.astype(np.int64), minlength=n * ODD_BITS).reshape(n, ODD_BITS) & 1
    return np.hstack([np.packbits(parity.astype(bool), axis=1), np.packbits(filled, axis=1)])


def band_keys(s: np.ndarray) -> np.ndarray:
    """Documents x BANDS keys (int64); rows without samples give meaningless keys."""
    n = len(s)
    filled = s != np.iinfo(np.uint64).max
    place = np.where(np.hstack([filled, filled]), np.arange(2 * BINS), 4 * BINS)
    nxt = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, : BANDS * ROWS]
    far = (nxt - np.arange(BANDS * ROWS)).astype(np.uint64)
    v = mix64(np.take_along_axis(s, nxt % BINS, axis=1) + (far << _VAL_BITS)).reshape(n, BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = np.broadcast_to(key, (n, BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(31) + v[:, :, r])
    return key.view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in as_table(batches):
        buf, off, _ = utf8(batch.column(1))
        s = samples(buf, off)
        some = (s != np.iinfo(np.uint64).max).any(axis=1)
        sketch, bands = odd_sketches(s), band_keys(s)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(bands[some].ravel()))
        width = sketch.shape[1]
        data = pa.array([r.tobytes() if ok else None for r, ok in zip(sketch, some)], pa.binary())
        assert width == (ODD_BITS + BINS) // 8
        yield pa.RecordBatch.from_arrays([batch.column(0), data, lists], ["node", "sketch", "bands"])


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of one sketch to each row of ``many`` (uint8 rows)."""
    w = ODD_BITS // 64
    a, b = one.view(np.uint64), many.view(np.uint64)
    apart = np.bitwise_count(a[:w] ^ b[:, :w]).sum(axis=1).astype(float)
    differ = -ODD_BITS / 2 * np.log(np.maximum(1 - 2 * apart / ODD_BITS, 1e-9))
    na = np.bitwise_count(a[w:]).sum().astype(float)
    nb = np.bitwise_count(b[:, w:]).sum(axis=1).astype(float)
    union = np.bitwise_count(a[w:] | b[:, w:]).sum(axis=1).astype(float)
    return np.clip((na + nb - differ) / 2 / np.maximum(union, 1), 0, 1)


# -- buckets ----------------------------------------------------------------


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray | list]]:
    """Whole runs of equal keys (column 0) of sorted batches; the last run waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if held and held[0].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(key, key[-1]))
        if cut == 0:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, node) to the distinct nodes of each key that has several."""
    for t in runs(batches):
        key, node = t.column(0).to_numpy(), t.column(1).to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        several = np.repeat(size > 1, size)
        if several.any():
            ends = np.concatenate([[0], np.cumsum(size[size > 1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(node[several]))], ["members"])


def links(node: np.ndarray, sketch: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """A spanning forest of the bucket's graph of pairs at or over the threshold."""
    out, left = [], np.arange(len(node))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            sim = similarity(sketch[at], sketch[left])
            hit = sim >= threshold
            out += [(int(node[at]), int(node[j]), float(x)) for j, x in zip(left[hit], sim[hit])]
            queue += list(left[hit])
            left = left[~hit]
    return out


def _link_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = (ODD_BITS + BINS) // 8
        for t in runs(batches):
            key, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            buf, _, _ = utf8(t.column(2).combine_chunks())
            sketch = np.ascontiguousarray(buf).reshape(-1, width)
            first = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            size = np.diff(first)
            two = first[:-1][size == 2]
            out = []
            if len(two):  # all pairs of the table at once
                sim = _pairwise(sketch[two], sketch[two + 1])
                hit = sim >= threshold
                out += zip(node[two[hit]].tolist(), node[two[hit] + 1].tolist(), sim[hit].tolist())
            for a, b in zip(first[:-1][size > 2], first[1:][size > 2]):
                out += links(node[a:b], sketch[a:b], threshold)
            if out:
                a, b, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return run


def _pairwise(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    w = ODD_BITS // 64
    a, b = one.view(np.uint64), other.view(np.uint64)
    pop = lambda x: np.bitwise_count(x).sum(axis=1).astype(float)
    differ = -ODD_BITS / 2 * np.log(np.maximum(1 - 2 * pop(a[:, :w] ^ b[:, :w]) / ODD_BITS, 1e-9))
    return np.clip((pop(a[:, w:]) + pop(b[:, w:]) - differ) / 2 / np.maximum(pop(a[:, w:] | b[:, w:]), 1), 0, 1)


def _cross_batches(threshold: float):
    """Sorted (key, asks, node, root, sketch) to the links between asking members and the others of each key; a pair of one root isn't compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = (ODD_BITS + BINS) // 8
        for t in runs(batches):
            key, asks, node, root = (t.column(i).to_numpy() for i in range(4))
            buf, _, _ = utf8(t.column(4).combine_chunks())
            sketch = np.ascontiguousarray(buf).reshape(-1, width)
            ends = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            out = []
            for a, b in zip(ends[:-1], ends[1:]):
                own, others = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                for i in own:
                    other = others[root[others] != root[i]]
                    sim = similarity(sketch[i], sketch[other]) if len(other) else np.zeros(0)
                    hit = sim >= threshold
                    out += [(int(node[i]), int(node[j]), float(x)) for j, x in zip(other[hit], sim[hit])]
            if out:
                a, b, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return run


def _different(members: DataFrame) -> DataFrame:
    """(key, node) without the buckets that have the same members as another one, by number and sum of hashes."""
    members = materialize(members, "hot")
    sums = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    return members.join(sums.groupBy("n", "h").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def hot_links(members: DataFrame, once: DataFrame, found: DataFrame, threshold: float, part: int | None = None) -> DataFrame:
    """Links that make the buckets of ``members`` (key, node) whole, given all links found so far; with those.

    First one member of each component of a bucket against those of the others, in parts.
    Then the members outside the bucket's largest component ask all its members: both are
    cut into parts by a hash, and each pair of parts is one group.  Only members of
    different components are compared.
    """
    part = part or HOT // 4
    def with_roots(links_: DataFrame) -> DataFrame:
        roots = components(links_)
        return members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))

    def parts(n: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(n) / part)).cast("int")

    each = with_roots(found).groupBy("key", "root").agg(F.min("node").alias("node"))
    several = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = each.join(several, "key").withColumn("bucket", F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), parts("n"))))
    checked = firsts.join(once, "node").select("bucket", "node", "sketch").repartition("bucket").sortWithinPartitions("bucket", "node")
    found = materialize(found.unionByName(checked.mapInArrow(_link_batches(threshold), "a long, b long, similarity double")), "links")
    rooted = materialize(with_roots(found), "hot")
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("rest"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    rows = rooted.join(sizes, "key").join(once, "node")
    of = lambda n: F.pmod(F.xxhash64("node", "key"), parts(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    asking = rows.where("root <> largest").withColumns({"mine": of("rest")}).withColumn("other", every("n")).withColumn("asks", F.lit(True))
    asked = rows.withColumns({"other": of("n")}).withColumn("mine", every("rest")).withColumn("asks", F.lit(False))
    both = asking.unionByName(asked.select(asking.columns)).select(F.xxhash64("key", "mine", "other").alias("key"), "asks", "node", "root", "sketch")
    last = both.repartition("key").sortWithinPartitions("key", "asks", "node").mapInArrow(_cross_batches(threshold), "a long, b long, similarity double")
    return found.unionByName(last)


# -- components -------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Large-star and small-star steps in turn until nothing changes; the number of
    rounds grows with the logarithm of the longest chain.  Each round's edges are
    a table in the shared folder.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # each node links to its least neighbour, which its other neighbours link to as well
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.where("u <> v").distinct(), "edges")
        release(edges)
        edges = after
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


# -- operator ---------------------------------------------------------------


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, keep_id, similarity, kept, times) of every distinct doc_id and text.

    ``keep_id`` is the doc_id of the row of its group that stays, ``kept`` marks that
    one, ``times`` counts equal rows, ``similarity`` is the best estimate among
    the links found of the text (1 for exact copies, null for a row that is alone): as
    :func:`links` compares a member it has reached with those not reached yet only, it
    needn't be the similarity to ``keep_id`` and can be under the best in the group.
    """
    base = docs.select("doc_id", "text").where("text is not null").select("doc_id", F.xxhash64("text").alias("node"), "text")
    sketches = materialize(base.select("node", "text").mapInArrow(_sketch_batches, _SKETCH), "sketches")
    keyed = sketches.select(F.explode("bands").alias("key"), "node")
    some = keyed.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).distinct()
    common = materialize(some.groupBy("key").agg((F.count(F.lit(1)) * SAMPLE).alias("about")).where(F.col("about") >= HOT), "hot")
    any_hot = len(common.take(1)) > 0
    if any_hot:  # the table's size is known to the planner, which broadcasts it or not
        rows = keyed.join(common, "key", "left")
        salt = F.when(F.col("about").isNotNull(), F.pmod(F.xxhash64("node"), F.ceil(F.col("about") / (HOT // 4))))
        hot = materialize(_different(rows.where("about is not null").select("key", "node").distinct()), "hot")
        keyed = rows.select(F.when(salt.isNotNull(), F.xxhash64("key", salt)).otherwise(F.col("key")).alias("key"), "node")
    members = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_members, "members array<long>").distinct()
    members = members.select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("node"))
    once = sketches.where("sketch is not null").groupBy("node").agg(F.first("sketch").alias("sketch"))
    checked = members.join(once, "node").select("bucket", "node", "sketch").repartition("bucket").sortWithinPartitions("bucket", "node")
    edges = materialize(checked.mapInArrow(_link_batches(threshold - MARGIN), "a long, b long, similarity double"), "links")
    if any_hot:
        edges = materialize(hot_links(hot, once, edges, threshold - MARGIN), "links")
    roots = components(edges)
    best = edges.select(F.col("a").alias("node"), "similarity").unionByName(edges.select(F.col("b").alias("node"), "similarity")).groupBy("node").agg(F.max("similarity").alias("similarity"))
    roots = roots.join(best, "node")
    # repeated rows are counted first, and groups are aggregates, so no task sees a whole group of copies
    ids = base.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("times"))
    rows = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    groups = rows.groupBy("root").agg(first.alias("first"), F.sum("times").alias("members"))
    rows = rows.join(groups, "root")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return rows.select("doc_id", "node", F.col("first.doc_id").alias("keep_id"), F.when(F.col("members") > 1, F.coalesce("similarity", F.lit(1.0))).alias("similarity"), kept.alias("kept"), "times")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keep_id, similarity) of each row that isn't kept, with the doc_id kept for its group.

    ``similarity`` is that of the link found (:func:`near_groups`), not that to keep_id.
    """
    rows = near_groups(docs, threshold).withColumn("gone", (F.col("times") - F.col("kept").cast("int")).cast("int")).where("gone > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("gone")))).select("doc_id", "keep_id", "similarity")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without near-duplicates; rows with a null text all stay.

    The texts move once: the join and the choice among repeated rows share their keys.
    """
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    kept = near_groups(docs, threshold).where("kept").select("node", *key)
    # the row as one struct, so that no column of docs can clash with these
    rows = docs.where("text is not null").select(F.xxhash64("text").alias("node"), *key, F.struct("*").alias("row"))
    rows = rows.join(kept, ["node", "none", "id"], "left_semi")
    first = Window.partitionBy("node", "none", "id").orderBy(F.xxhash64("row"))
    rows = rows.withColumn("rank", F.row_number().over(first)).where("rank = 1")
    return rows.select("row.*").unionByName(docs.where("text is null"))
