"""Documents packed into bins of fixed capacity by bin completion.

A text longer than a bin is cut into full bins and a rest.  Rests are packed in groups
of about ``GROUP``, by a hash of the row and of its number among equal rows, so a group
is a fair sample of all lengths whatever is repeated.  In a group, best fit on decreasing
lengths gives the first incumbent.  While it needs more bins than the lower bound
(:func:`lower_bound`), four descents complete bin after bin around the largest document
left and may better the incumbent (:func:`descent`, :func:`first_ways`).  Then branch
and bound enumerates, around the largest document left, the undominated fillings of its
bin (a filling is dominated if a
document left out could take the place of some of those in it that are no longer
together), and gives a branch up when its waste so far exceeds what a
solution with one bin fewer may waste.  Fillings are made as they are asked for, none
is left out: in portions of steps, each twice the last, fullest first in a portion.
``STEPS`` bounds this search of a group, whose first portions are so small that a walk
over all bins takes about half of them; when they are used up the best incumbent
stands, so every document is always packed.

Defined results: the size of a document is its number of characters; null and empty
texts have nothing to pack and are left out.  Repeated rows are packed each.  Rows with
equal lengths are ordered by doc_id (null first), then by a hash of the text and the
number among equal rows.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITY, GROUP, STEPS, PORTION, COUNTED = 16384, 2000, 20000, 256, 60
_REPEATS = 10_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; sizes in decreasing order, each to the fullest bin with room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        insort(room, (left - size, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The largest of four bounds (sizes decreasing), each over all their parameters.

    The total over the capacity; for every least size, the items over half a bin and what
    the others of that size or more need beside the room that those leave; for every k up to
    ``COUNTED``, sizes rounded down to k-ths of a bin by a dual feasible function (an item
    of more than a (k+1)-th of a bin fills a k-th); and how many items bins can hold (:func:`counted_bound`).
    """
    s = np.array(sizes, np.int64)
    best = -(-int(s.sum()) // capacity)
    n_large = int((2 * s > capacity).sum())
    small = s[n_large:]
    if len(small):
        total = np.concatenate([[0], np.cumsum(s)])
        last = np.flatnonzero(np.append(small[1:] != small[:-1], True)) + n_large + 1  # items of at least each small size
        alone = np.searchsorted(-s[:n_large], -(capacity - s[last - 1]), "left")  # those that no such item fits beside
        room = (n_large - alone) * capacity - (total[n_large] - total[alone])
        need = np.maximum(0, total[last] - total[n_large] - room)
        best = max(best, n_large + int((-(-need // capacity)).max()))
    best = max(best, n_large, counted_bound(s[::-1], capacity))
    for k in range(1, COUNTED + 1):
        whole = s * (k + 1) // capacity
        share = np.where(s * (k + 1) % capacity == 0, k * s, whole * capacity)  # k times the function's value
        best = max(best, -(-int(share.sum()) // (k * capacity)))
    return best


def counted_bound(ascending: np.ndarray, capacity: int) -> int:
    """Bins with k items or more are at most the T for which the k*T smallest items fit into T bins on the whole; so many bins, over all k, must hold all items."""
    total, n = np.concatenate([[0], np.cumsum(ascending)]), len(ascending)
    most = []  # T of each k
    for k in range(1, int(np.searchsorted(total[1:], capacity, "right")) + 1):
        t = np.arange(n // k + 1)
        most.append(int(np.flatnonzero(total[k * t] <= t * capacity)[-1]))
    low, high = 1, n
    while low < high:
        b = (low + high) // 2
        low, high = (low, b) if sum(min(b, t) for t in most) >= n else (b + 1, high)
    return low


def bits(sizes: list[int] | tuple[int, ...]) -> int:
    out = 0
    for s in set(sizes):
        out |= 1 << s
    return out


def dominated(filling: list[int], left_out: int, room: int) -> bool:
    """Whether a document left out (a bit for each size) can replace a part of the filling of no larger sum, with ``room`` to spare.

    A single document of its own size is no such part.  Sums of parts are bits of a number, so all parts are tried.
    """
    some, several = 0, 0  # sums of parts; of those with two documents or more
    for size in filling:
        several |= (several | some) << size
        some |= some << size | 1 << size
    if several & left_out:
        return True
    reach, wide = some, 1  # from s to s + wide - 1
    while wide < room:
        step = min(wide, room - wide)
        reach |= reach << step
        wide += step
    return room > 0 and bool((reach << 1) & left_out)


def fillings(rest: list[int], room: int, waste: int, steps: list[int], portion: int) -> Iterator[list[int]]:
    """Undominated sets of sizes from rest (decreasing) that leave at most ``waste`` of the room; fullest first in each portion of steps."""
    found: list[tuple[int, list[int]]] = []
    seen: set[tuple[int, ...]] = set()
    ascending = [-x for x in rest]  # for bisect on the decreasing list
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    used = 0
    while stack and steps[0] > 0:
        if found and used >= portion:
            yield from _undominated(found, rest)
            found, used, portion = [], 0, 2 * portion
        steps[0] -= 1
        used += 1
        at, left, chosen = stack.pop()
        k = max(at, bisect_left(ascending, -left))  # the first that fits
        if k >= len(rest):
            if left <= waste and chosen not in seen:
                seen.add(chosen)
                found.append((left, list(chosen)))
            continue
        after = bisect_left(ascending, -rest[k] + 1)  # past all of this size
        if left <= waste and after >= len(rest) and chosen not in seen and rest[-1] > left:
            seen.add(chosen)
            found.append((left, list(chosen)))
        if after < len(rest):
            stack.append((after, left, chosen))  # without this size
        stack.append((k + 1, left - rest[k], (*chosen, rest[k])))
    yield from _undominated(found, rest)


def _undominated(found: list[tuple[int, list[int]]], rest: list[int]) -> Iterator[list[int]]:
    there, many = bits(rest), Counter(rest)
    for left, chosen in sorted(found):
        out_of_it = there
        for size, n in Counter(chosen).items():
            if many[size] == n:
                out_of_it ^= 1 << size
        if not dominated(chosen, out_of_it, left):
            yield chosen


def without(rest: list[int], way: list[int]) -> list[int]:
    left = list(rest)
    for size in way:
        left.remove(size)
    return left


def completion(rest: np.ndarray, room: int, counts: range) -> list[int]:
    """Places in rest (ascending) of the fullest filling found with one of these numbers of documents, tried in turn.

    The largest that leave room for as many of the smallest as are missing are taken until
    two are; these are the best of all pairs.
    """
    best: tuple[int, list[int]] = (-1, [])
    for n in counts:
        got, left, end = [], room, len(rest)
        lowest = np.concatenate([[0], np.cumsum(rest[:n])])
        for missing in range(n, 2, -1):
            end = int(np.searchsorted(rest[:end], left - int(lowest[missing - 1]), "right")) - 1
            got.append(end)
            left -= int(rest[end])
        if n == 1:
            pair = [int(np.searchsorted(rest, left, "right")) - 1]
        else:
            j = np.minimum(np.searchsorted(rest[:end], left - rest[:end], "right") - 1, end - 1)
            i = np.flatnonzero(j > np.arange(end))
            k = int(i[np.argmax(rest[i] + rest[j[i]])])
            pair = [k, int(j[k])]
        got += pair
        left -= int(rest[pair].sum())
        if room - left > best[0]:
            best = (room - left, got)
        if left == 0:
            break
    return best[1]


def descent(sizes: list[int], capacity: int, way: str) -> list[list[int]]:
    """Bins of sizes: one after the other, around the largest left.

    ``fullest``: the fullest completion for any number of documents.  ``counted``: for the
    largest number of documents with which as many of the smallest left as make up whole bins
    fit into these on the whole, so small documents aren't spent on the largest ones.
    """
    bins, rest = [], np.array(sizes[::-1], np.int64)
    while n := len(rest):
        total, largest, others = np.cumsum(rest), int(rest[-1]), rest[:-1]
        fits = int(np.searchsorted(total[:-1], capacity - largest, "right"))
        counts = range(fits, 0, -1)
        if way == "counted" and fits:
            k = next((k for k in range(fits + 1, 1, -1) if n >= k and int(total[k * (n // k) - 1]) <= n // k * capacity), 1)
            counts = range(max(1, k - 1), 0, -1)[:1]
        chosen = completion(others, capacity - largest, counts)
        bins.append([largest, *others[chosen].tolist()])
        rest = np.delete(others, chosen)
    return bins


def first_ways(sizes: list[int], capacity: int, portion: int) -> list[list[int]]:
    """Bins of sizes: around the largest left the first filling in turn, which is the fullest of a portion of steps."""
    bins, rest = [], sizes
    while rest:
        room = capacity - rest[0]
        way = next(fillings(rest[1:], room, room, [1 << 60], portion))
        bins.append([rest[0], *way])
        rest = without(rest[1:], way)
    return bins


def pack(sizes: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> list[list[int]]:
    """Bins of item numbers for sizes in decreasing order, each from 1 to capacity."""
    best = best_fit(sizes, capacity)
    least = lower_bound(sizes, capacity)
    if len(best) <= least:
        return best
    budget, total, better = [steps], sum(sizes), None
    n_best = len(best)
    descents = [lambda: descent(sizes, capacity, "counted"), lambda: descent(sizes, capacity, "fullest"), lambda: first_ways(sizes, capacity, PORTION), lambda: first_ways(sizes, capacity, 4 * PORTION)]
    for walk in descents:
        if n_best > least and len(full := walk()) < n_best:
            better, n_best = full, len(full)
    portion = max(1, min(PORTION, steps // (2 * n_best)))
    frames = [(sizes, 0, fillings(sizes[1:], capacity - sizes[0], (n_best - 1) * capacity - total, budget, portion))]
    path: list[list[int]] = []
    while frames and budget[0] > 0 and n_best > least:
        rest, waste, ways = frames[-1]
        allowed = (n_best - 1) * capacity - total
        way = next(ways, None) if waste <= allowed else None
        if way is None:
            frames.pop()
            if path:
                path.pop()
            continue
        budget[0] -= 1
        now = waste + capacity - rest[0] - sum(way)
        if now > allowed:
            continue
        left = without(rest[1:], way)
        bin_ = [rest[0], *way]
        if not left:
            if len(path) + 1 < n_best:
                better, n_best = [*path, bin_], len(path) + 1
            continue
        path.append(bin_)
        frames.append((left, now, fillings(left[1:], capacity - left[0], allowed - now, budget, portion)))
    if better is None:
        return best
    where: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        where.setdefault(sizes[i], []).append(i)
    return [[where[s].pop() for s in b] for b in better]


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, times) of the texts that hold something; repeated rows are counted before they move."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), F.length("text").cast("long").alias("n")).where("n > 0")
    return rows.groupBy("doc_id", "mark", "n").agg(F.count(F.lit(1)).alias("times"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, steps: int = STEPS) -> DataFrame:
    """(bin_id, doc_id, start, length, bin_fill) of every piece of every document."""
    items = materialize(lengths(docs), "lengths")
    groups = max(1, -(-items.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0] // group))
    # each repeat is numbered and hashed by its number too, so that equal rows don't meet in one group
    some = items.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("long"), F.lit(_REPEATS))))
    each = some.withColumn("nth", F.explode(F.sequence("k", F.least(F.col("k") + (_REPEATS - 1), F.col("times") - 1))))
    grouped = each.select(F.pmod(F.xxhash64("mark", "nth"), F.lit(groups)).alias("grp"), "doc_id", "mark", "n", "nth")
    grouped = grouped.repartition("grp").sortWithinPartitions("grp", F.desc(F.col("n") % capacity), "doc_id", "mark", "n", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column(0).to_numpy()
            ends = [*np.flatnonzero(grp[1:] != grp[:-1]) + 1, len(grp)]
            if held and held[0].column(0)[0].as_py() != grp[0]:
                yield one(pa.Table.from_batches(held))
                held = []
            at = 0
            for end in ends[:-1]:
                yield one(pa.Table.from_batches([*held, batch.slice(at, end - at)]))
                held, at = [], end
            held.append(batch.slice(at))
        if held:
            yield one(pa.Table.from_batches(held))

    def one(t: pa.Table) -> pa.RecordBatch:
        grp, n = t.column(0)[0].as_py(), t.column(3).to_numpy()
        full, rest = n // capacity, n % capacity
        k = int((rest > 0).sum())  # the rests come first, largest first
        bins = pack(rest[:k].tolist(), capacity, steps) if k else []
        row = np.concatenate([np.array([i for b in bins for i in b], np.int64), np.repeat(np.arange(len(n)), full)])
        number = np.concatenate([np.repeat(np.arange(len(bins)), [len(b) for b in bins]).astype(np.int64), len(bins) + np.arange(int(full.sum()))])
        nth = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
        start = np.concatenate([(full * capacity)[row[:k]], nth * capacity])
        length = np.concatenate([rest[row[:k]], np.full(int(full.sum()), capacity)])
        fill = np.bincount(number, weights=length).astype(np.int64)[number]
        return pa.RecordBatch.from_arrays([pa.array(number + (grp << 32)), t.column(1).combine_chunks().take(pa.array(row)), pa.array(start), pa.array(length), pa.array(fill)], ["bin_id", "doc_id", "start", "length", "bin_fill"])

    kind = items.schema["doc_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"bin_id long, doc_id {kind}, start long, length long, bin_fill long")
