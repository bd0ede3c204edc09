"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs, long paragraphs further at places that the words themselves choose, so that an edit moves
only the pieces around it. The digests of the pieces are hashed into cells (count, sum of digests, sum of check values).
The sketches of two versions subtract cell by cell; peeling cells that hold one digest recovers what only one version has.
When peeling gets stuck, both sketches are built again with four times the cells.

Defined cases: a null text is the empty text, whose sketch is empty; two empty texts have likeness 1; repeated pieces of a text
count as often as they occur; the document order is descending by id with rows without an id last and equal ids in
order of their text; a table of one row is its own next document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

CELLS = 12
HASHES = 3
GROWTH = 4
ROWS_PER_RANGE = 3000
ROWS_AT_ONCE = 500  # documents whose sketches are peeled together
CHARS_AT_ONCE = 4_000_000
MOST_RANGES = 50_000
FINE = 64  # bytes at the start that are cut after every word
LONGEST = 96  # bytes in a piece
LOWEST = -(2**63)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)  # odd, any will do


def _mix(values: np.ndarray, k: int) -> np.ndarray:
    mixed = (values ^ (values >> np.uint64(29))) * np.uint64(MULTIPLIERS[k])
    return mixed ^ (mixed >> np.uint64(32))


def digests(text: str | None) -> np.ndarray:
    """One 64-bit digest for each piece; the k-th copy of a piece has its own."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(data, np.uint8)
    spaces = np.flatnonzero(codes == 32)
    spaces = spaces[spaces >= 3]
    chosen = (codes[spaces - 1].astype(np.uint32) * 7 + codes[spaces - 2].astype(np.uint32) * 31 + codes[spaces - 3].astype(np.uint32) * 57) % 6 == 0
    chosen |= spaces < FINE  # a short text has a piece for each word
    ends = np.union1d(np.flatnonzero(codes == 10), spaces[chosen]) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:  # where the words choose no place, one at every LONGEST bytes from the last
        parts = -(-gaps // LONGEST)
        of = np.repeat(np.arange(len(ends)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.minimum((ends - gaps)[of] + (k + 1) * LONGEST, ends[of])
    digest, start, values = xxhash.xxh3_64_intdigest, 0, []
    for end in ends.tolist():
        values.append(digest(data[start:end]))
        start = end
    values = np.array(values, dtype=np.uint64)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not new.all():
        copy = np.arange(len(values)) - np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
        ordered = np.where(copy > 0, _mix(ordered + copy.astype(np.uint64), 3), ordered)
    return ordered


class Sketches:
    """Sketches of many texts side by side: HASHES tables of cells for each; a digest has one cell in every table."""

    def __init__(self, cells: np.ndarray) -> None:
        self.side = cells // HASHES
        self.begin = np.concatenate([[0], np.cumsum(self.side * HASHES)])
        self.count = np.zeros(self.begin[-1], np.int64)
        self.total = np.zeros(self.begin[-1], np.uint64)
        self.check = np.zeros(self.begin[-1], np.uint64)

    @classmethod
    def of(cls, texts: list[np.ndarray], cells: np.ndarray) -> Sketches:
        """One sketch for each list of digests."""
        out = cls(cells)
        sizes = [len(t) for t in texts]
        values = np.concatenate([np.zeros(0, np.uint64), *texts])
        out.change(values, np.repeat(np.arange(len(texts)), sizes), np.ones(len(values), np.int64))
        return out

    def change(self, values: np.ndarray, owner: np.ndarray, times: np.ndarray) -> None:
        side, begin, by = self.side[owner], self.begin[owner], times.astype(np.uint64)
        totals, checks = values * by, _mix(values, 3) * by
        for k in range(HASHES):
            at = (_mix(values, k) % side.astype(np.uint64)).astype(np.int64) + k * side + begin
            np.add.at(self.count, at, times)
            np.add.at(self.total, at, totals)
            np.add.at(self.check, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.side * HASHES)
        out.count, out.total, out.check = self.count - other.count, self.total - other.total, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, +1 or -1) of everything recovered, and which sketches came apart whole. Empties those.

        A cell with a count of one either way whose check value fits holds one digest; taking it out of its cells frees others.
        """
        owner_of = np.repeat(np.arange(len(self.side)), self.side * HASHES)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            values = self.total[at] * sign.astype(np.uint64)
            pure = np.flatnonzero(self.check[at] * sign.astype(np.uint64) == _mix(values, 3))
            if not len(pure):
                break
            owner, values, sign = owner_of[at[pure]], values[pure], sign[pure]
            order = np.lexsort((values, owner))
            owner, values, sign = owner[order], values[order], sign[order]
            first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])])
            owner, values, sign = owner[first], values[first], sign[first]
            self.change(values, owner, -sign)
            found.append((owner, values, sign))
        mixed = (self.count != 0) | (self.total != 0) | (self.check != 0)
        whole = np.ones(len(self.side), bool)
        whole[owner_of[mixed]] = False
        return *(np.concatenate(x) for x in zip(*found)), whole

    def to_text(self, i: int, n: int) -> str:
        """Pieces, cells and cell contents of one sketch: equal texts give equal strings."""
        a, b = self.begin[i], self.begin[i + 1]
        raw = self.count[a:b].astype("<i4").tobytes() + self.total[a:b].astype("<u8").tobytes() + self.check[a:b].astype("<u8").tobytes()
        return f"{n}:{b - a}:{base64.b64encode(raw).decode()}"

    @classmethod
    def from_text(cls, text: str) -> Sketches:
        _, cells, raw = text.split(":")
        m, data = int(cells), base64.b64decode(raw)
        out = cls(np.array([m]))
        out.count = np.frombuffer(data, "<i4", m).astype(np.int64)
        out.total = np.frombuffer(data, "<u8", m, 4 * m).copy()
        out.check = np.frombuffer(data, "<u8", m, 12 * m).copy()
        return out


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest lists what only one has (digests, +1 left or -1 right).

    Starts with the cells that the counts alone show to be needed; pairs that get stuck are sketched again, GROWTH times as large.
    """
    out: list = [None] * len(left)
    need = np.array([abs(len(a) - len(b)) for a, b in zip(left, right)])
    size = np.full(len(left), cells)
    while (small := size < 1.3 * need).any():
        size[small] *= GROWTH
    waiting = np.arange(len(left))
    while len(waiting):
        a = Sketches.of([left[i] for i in waiting], size[waiting])
        owner, values, sign, whole = a.minus(Sketches.of([right[i] for i in waiting], size[waiting])).peel()
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(waiting) + 1))
        for k in np.flatnonzero(whole):
            own = order[edges[k] : edges[k + 1]]
            out[waiting[k]] = (values[own], sign[own])
        waiting = waiting[~whole]
        size[waiting] *= GROWTH
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    """For each pair the shared pieces over all pieces of both, from the recovered difference."""
    out = []
    for a, b, (values, _) in zip(left, right, differences(left, right)):
        both = len(a) + len(b)
        out.append((both - len(values)) / (both + len(values)) if both else 1.0)
    return out


def edited_text(text: str, following: str) -> str:
    """The last third of text replaced by as many leading code points of the next document, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_pieces long"
)


def _report(rows: list[tuple]) -> pd.DataFrame:
    """rows: (doc_id, text, digests, next text, next digests)."""
    ids, texts, own, following, others = map(list, zip(*rows))
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    changed = [digests(e) for e in edited]
    size = np.full(len(rows), CELLS)
    before, after = Sketches.of(own, size), Sketches.of(changed, size)
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, dtype="Int64"), "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            "fingerprint": [before.to_text(i, len(d)) for i, d in enumerate(own)],
            "edited_fingerprint": [after.to_text(i, len(d)) for i, d in enumerate(changed)],
            "near_edited": likeness(own, changed), "near_next": likeness(own, others), "n_pieces": [len(d) for d in own],
        }
    )


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows, size = None, [], 0
    for frame in frames:
        for area, guest, doc_id, text in zip(frame["area"], frame["guest"], frame["doc_id"], frame["text"]):
            text = text or ""
            now = (area, guest, None if pd.isna(doc_id) else int(doc_id), text, digests(text))
            if held is not None and held[0] == area and not held[1]:
                rows.append((*held[2:], *now[3:]))
                size += len(held[3])
                if len(rows) >= ROWS_AT_ONCE or size >= CHARS_AT_ONCE:
                    yield _report(rows)
                    rows, size = [], 0
            held = now
    if rows:
        yield _report(rows)


def version_fingerprints(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Every document against its edited version and against the next document.

    Rows are dealt into ranges of ids (cut points from approximate quantiles, which balance and decide nothing). The first row
    of a range also goes, as a guest, to the range above it, the very first row to the lowest range. Texts are shuffled once,
    guests apart; the driver holds two numbers per range, of which there are MOST_RANGES at most.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    ranges = min(MOST_RANGES, max(1, -(-keyed.count() // rows_per_range)))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = np.array(sorted(set(keyed.approxQuantile("key", shares, 0.2 / ranges))) if shares else [], dtype=np.float64)

    @F.pandas_udf("long")
    def area_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy().astype(np.float64), "right"))

    placed = keyed.withColumn("area", area_of("key"))
    firsts = sorted((r["area"], r["first"]) for r in placed.groupBy("area").agg(F.max("key").alias("first")).collect())
    areas = [a for a, _ in firsts]
    host = {first: above for (_, first), above in zip(firsts, areas[1:] + areas[:1])}

    @F.pandas_udf("long")
    def host_of(keys: pd.Series) -> pd.Series:
        return keys.map(host).astype("Int64")

    own = F.struct("area", F.lit(False).alias("guest"))
    visit = F.struct(F.col("host").alias("area"), F.lit(True).alias("guest"))
    spots = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, visit))
    rows = placed.withColumn("host", host_of("key")).select("doc_id", "text", "key", F.explode(spots).alias("spot")).select("doc_id", "text", "key", "spot.*")
    dealt = rows.repartition("area").sortWithinPartitions("area", "guest", F.desc("key"), "text")
    return dealt.select("area", "guest", "doc_id", "text").mapInPandas(_compare, SCHEMA)
