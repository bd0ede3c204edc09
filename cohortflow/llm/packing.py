"""Best-fit packing of tokenised documents into sequences, after a dominance reduction.

The instance is its histogram: how many pieces have each length, at most `capacity` numbers however large the corpus.
Dominance reduction walks from the longest length down and fixes, as often as the counts allow, sets that no other set
holding that length can beat; what is left is packed best-fit, longest first, a whole group of equal pieces at a time.
The result is a short list of patterns with multiplicities. Pieces of one length are interchangeable, so the k-th piece of
a length takes the k-th place that the patterns offer to it; ranks come from per-partition counts, never from one sorted task.

Defined cases: a null text is the empty text, one piece of the end id alone; rows that repeat an id are packed each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import spread
from .orc_tokens import END
from .tokens import TOKENIZER, encoder

CAPACITY = 2048
SLICE = 512  # texts whose ids a task holds at a time
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece; `place` counts the pieces of that length before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of earlier jobs of this worker
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            raw = [ids + END for ids in encoder(tokenizer).encode(batch.column("text").to_pylist())]
            sizes = np.array([len(r) // 4 for r in raw], np.int64)
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(raw)), count)
            piece = spread(np.zeros(len(raw), np.int64), count)
            first = sizes - (count - 1) * capacity  # only the first piece may be shorter than the capacity
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            own = [raw[r][4 * a : 4 * b] if n > 1 else raw[r] for r, a, b, n in zip(row.tolist(), start.tolist(), (start + length).tolist(), count[row].tolist())]
            order = np.argsort(length, kind="stable")
            same = np.bincount(length, minlength=capacity + 1)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(np.cumsum(same) - same, same) + seen[length[order]]
            seen += same
            columns = [
                batch.column("doc_id").take(pa.array(row)),
                *[pa.array(c) for c in (piece.astype(np.int32), start, length)],
                pa.array([zlib.crc32(x) for x in own], pa.int64()),
                pa.array(np.full(len(row), part, np.int32)),
                pa.array(place),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names=names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return slim.mapInArrow(run, schema)


def reduce_by_dominance(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets and take them out of counts (counts[L]: pieces of length L).

    For the longest length j with room r beside it: if nothing fits, {j} is fixed. Otherwise let k be the longest that
    fits. {j, k} dominates when k fills the room, or when any other way to use the room has a total of at most k, for its
    pieces could then change places with k: no two pieces fit, or no three fit and no two exceed k.
    """
    fixed = []
    for j in range(capacity, 0, -1):
        while counts[j] > 0:
            room = capacity - j
            counts[j] -= 1  # one j is being placed
            lengths = [x for x in range(1, room + 1) if counts[x]]
            if not lengths:
                fixed.append(((j,), counts[j] + 1))
                counts[j] = 0
                break
            k = lengths[-1]
            smallest = [x for x in lengths[:3] for _ in range(min(3, counts[x]))][:3]
            dominated = k == room or len(smallest) < 2 or smallest[0] + smallest[1] > room
            if not dominated and (len(smallest) < 3 or sum(smallest) > room):
                dominated = _best_pair(lengths, counts, room) <= k
            if not dominated:
                counts[j] += 1
                break
            times = 1 + (counts[j] - 1) // 2 if k == j else min(counts[j] + 1, counts[k])
            counts[j] -= times - 1
            counts[k] -= times
            fixed.append(((j, k), times))
    return fixed


def _best_pair(lengths: list[int], counts: list[int], room: int) -> int:
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > room or (low == high and counts[lengths[low]] < 2):
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def best_fit(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: each piece goes to the open sequence that it leaves least room in."""
    open_rooms: list[int] = []  # sorted rooms that some sequences have
    groups: dict[int, list] = defaultdict(list)

    def put(pattern, times):
        if times:
            room = capacity - sum(pattern)
            if not groups[room]:
                insort(open_rooms, room)
            groups[room].append((pattern, times))

    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):  # no open sequence has the room
                each = capacity // length
                full, rest = divmod(left, each)
                put((length,) * each, full)
                put((length,) * rest, 1 if rest else 0)
                left = 0
                break
            room = open_rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                open_rooms.pop(at)
            each = room // length  # having taken one, the same sequence is the tightest again
            full = min(times, left // each)
            put(pattern + (length,) * each, full)
            left -= full * each
            times -= full
            if times and 0 < left < each:
                put(pattern + (length,) * left, 1)
                left, times = 0, times - 1
            put(pattern, times)
        counts[length] = 0
    return [g for room in open_rooms for g in groups[room]]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence) and how many sequences follow each."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] += n
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks per length: where they start, the first sequence they go to, the offset there."""
    taken, rows, sequence = defaultdict(int), [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece (and its ids, if asked for)."""
    cut = cut_lineage(pieces(docs, capacity, tokenizer, with_ids))
    sizes = cut_lineage(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = placements(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        first = np.searchsorted(table["length"], length.to_numpy(), "left")
        last = np.searchsorted(table["length"], length.to_numpy(), "right")
        at = np.empty(len(length), np.int64)
        for value in np.unique(length.to_numpy()):
            own = length.to_numpy() == value
            a, b = first[own][0], last[own][0]
            at[own] = a + np.searchsorted(table["rank"][a:b], rank.to_numpy()[own], "right") - 1
        return pd.DataFrame({"sequence_id": table["sequence"][at] + rank.to_numpy() - table["rank"][at], "offset": table["offset"][at]})

    placed = cut.join(bases, ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("place")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return placed.select(*names, "at.sequence_id", "at.offset")
