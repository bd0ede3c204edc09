"""Prefix trie of conversations, counted in minimal-perfect-hash node tables.

Turns are numbered inside their conversation, conversations rebuilt as rows (conversation, depth, 128-bit turn digest), and a
prefix is the exclusive-or of the digests of its (depth, turn) pairs, so a prefix of any length is a running total. Rows are
dealt out by ranges of (depth band, conversation): a path lies in one shard, but for conversations deeper than a band.

A shard enumerates its distinct prefix digests, gives each a slot by a minimal perfect hash (levels of marked cells; every key is
checked against the digest stored in its slot) and scatters its counts into flat arrays. Shards agree on global counts by
digest. Every node belongs to its smallest member, so exactly one shard adds its contribution; shards then accumulate their
contributions through the parent slots, deepest level first, and the shards' sums of a node are added up. What deeper bands
contribute enters at the last node of the band above, by conversation.

Defined cases: turns of equal number are ordered by a hash of role and text, null turns first; repeated rows are turns of their
own; a null role or text is the empty text; rows without a conversation id belong to no conversation; an empty table has no
nodes; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

BASES = 5  # conversations that share the opening turns of the first of them
OPENINGS = 9  # openings have 0 to 8 turns
BAND = 4096  # depths of a band: bounds a path inside a shard
SHARD_ROWS = 200_000  # a shard ends with the path that reaches this many rows
EMPTY = hashlib.sha256(b"").hexdigest()
TABLE = "shard long, slot int, parent_slot int, depth long, d1 long, d2 long, p1 long, p2 long, bytes long, members long, first long, goes_on array<long>"


def _lanes(*columns: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def _opening(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % OPENINGS


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), lanes t1, t2 of the turn's digest, bytes of its text.

    Rows are sorted by ranges, so a conversation of any length spreads over tasks; ranges add up their counts by conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t1, t2 = _lanes(role, text)
    slim = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), t1.alias("t1"), t2.alias("t2"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), "t1", "t2"]
    ranged = slim.filter("conv is not null").repartitionByRange("conv", *order)
    placed = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("conv", "part").orderBy(*order)
    counts = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    # more than one row of counts only where a conversation runs over the edge of a range
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv", "part", F.sum("n").over(earlier).alias("before")).filter("before is not null")
    local = placed.withColumn("pos", F.row_number().over(inside))
    return local.join(before, ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv, depth, t1, t2, bytes: the first h turns of the first conversation of five, then the own turns after the h-th."""
    numbered = cut_lineage(numbered_turns(turns))
    sizes = cut_lineage(numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    base = F.col("conv") - F.pmod("conv", F.lit(BASES))
    heads = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = sizes.withColumn("base", base).join(heads, "base", "left").select("conv", "base", _opening(F.col("conv")).alias("h"), F.coalesce("base_n", F.lit(0)).alias("base_n"))
    known = known.withColumn("taken", F.least("h", "base_n").cast("long"))
    own = numbered.filter(F.col("pos") > _opening(F.col("conv"))).join(known.select("conv", "taken", "h"), "conv")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "t1", "t2", "bytes")
    opening = numbered.filter((F.pmod("conv", F.lit(BASES)) == 0) & (F.col("pos") < OPENINGS)).withColumnRenamed("conv", "base")
    shared = known.filter("taken > 0").select("conv", "base", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("pos"))
    shared = shared.join(opening, ["base", "pos"]).select("conv", F.col("pos").alias("depth"), "t1", "t2", "bytes")
    root = sizes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(shared).unionByName(root)


def prefixes(paths: DataFrame, band_depth: int = BAND) -> DataFrame:
    """conv, band, depth, bytes, d1, d2 (the digest of each prefix), p1, p2 (of the prefix before it).

    A band's digests start from the totals of the bands above.
    """
    one, two = _lanes("depth", "t1", "t2")
    band = (F.col("depth") / band_depth).cast("long")
    rows = paths.select("conv", "depth", "bytes", band.alias("band"), *[F.when(F.col("depth") > 0, x).otherwise(0).alias(n) for x, n in ((one, "x1"), (two, "x2"))])
    deep = rows.groupBy("conv", "band").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    earlier = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    above = deep.select("conv", "band", *[F.bit_xor(s).over(earlier).alias(o) for s, o in (("s1", "o1"), ("s2", "o2"))]).filter("band > 0")
    inside = Window.partitionBy("band", "conv").orderBy("depth")
    local = rows.select("*", F.bit_xor("x1").over(inside).alias("l1"), F.bit_xor("x2").over(inside).alias("l2"))
    joined = local.join(above, ["conv", "band"], "left")
    digests = {f"d{k}": F.coalesce(f"o{k}", F.lit(0)).bitwiseXOR(F.col(f"l{k}")) for k in (1, 2)}
    before = {f"p{k}": digests[f"d{k}"].bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)}
    return joined.select("conv", "band", "depth", "bytes", *[c.alias(n) for n, c in (digests | before).items()])


class NodeTable:
    """A minimal perfect hash of distinct 128-bit digests: n digests, slots 0 to n - 1, each slot holding its digest.

    On each level every digest left marks a cell; digests alone in theirs are settled, and a cell's rank among the settled
    ones is its slot. Digests that meet in a cell go to the next level, which hashes anew.
    """

    CELLS = 2  # for each digest left

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        left, placed = np.arange(len(high)), 0
        while len(left):
            size, level = self.CELLS * len(left) + 1, len(self.levels)
            cell = self._cell(high[left], low[left], level, size)
            alone = np.bincount(cell, minlength=size) == 1
            self.levels.append((placed, size, alone, np.cumsum(alone) - alone))
            placed += int(alone.sum())
            left = left[~alone[cell]]
        self.high, self.low = np.empty(placed, np.uint64), np.empty(placed, np.uint64)
        slots = self._slots(high, low)
        self.high[slots], self.low[slots] = high, low
        if (self.find(high, low) < 0).any():
            raise ValueError("digests that are given to a node table must be distinct")

    @staticmethod
    def _cell(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (high ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31)) ^ low) * np.uint64(0x94D049BB133111EB)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, (base, size, alone, rank) in enumerate(self.levels):
            cell = self._cell(high[left], low[left], level, size)
            found = alone[cell]
            out[left[found]] = base + rank[cell[found]]
            left = left[~found]
        return out

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for digests that the table does not hold."""
        slot = self._slots(high, low)
        same = (slot >= 0) & (self.high[slot] == high) & (self.low[slot] == low) if len(self.high) else np.zeros(len(high), bool)
        return np.where(same, slot, -1)


def node_rows(shard: int, rows: pd.DataFrame, band_depth: int) -> pd.DataFrame:
    """The shard's nodes by slot, with counts of its path rows, which are sorted by band, conv and depth."""
    high, low = rows["d1"].to_numpy().view(np.uint64), rows["d2"].to_numpy().view(np.uint64)
    distinct = np.unique(np.stack([high, low], axis=1), axis=0)
    table = NodeTable(distinct[:, 0].copy(), distinct[:, 1].copy())
    slot = table.find(high, low)
    conv, depth, band = (rows[c].to_numpy() for c in ("conv", "depth", "band"))
    n = len(distinct)
    follows = np.append(False, (conv[1:] == conv[:-1]) & (band[1:] == band[:-1]))
    parent = np.full(n, -1, np.int64)
    parent[slot[follows]] = slot[:-1][follows[1:]]
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, slot, conv)
    out = pd.DataFrame({"shard": shard, "slot": np.arange(n, dtype=np.int32), "parent_slot": parent.astype(np.int32)})
    for name in ("depth", "bytes", "p1", "p2"):  # alike in all rows of a node
        out[name] = np.zeros(n, np.int64)
        out.loc[slot, name] = rows[name].to_numpy()
    out["d1"], out["d2"] = table.high.view(np.int64), table.low.view(np.int64)
    out["members"], out["first"] = np.bincount(slot, minlength=n), first
    last = depth % band_depth == band_depth - 1
    reaching = pd.Series(conv[last]).groupby(slot[last]).agg(list) if last.any() else {}
    out["goes_on"] = [reaching[k] if k in reaching else None for k in range(n)] if last.any() else None
    return out[[c.split()[0] for c in TABLE.split(", ")]]


def _cut_shards(band_depth: int, shard_rows: int):
    """Sorted rows of a partition to nodes, in shards that end with a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size < shard_rows:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows["conv"] == rows["conv"].iat[-1]) & (rows["band"] == rows["band"].iat[-1])
            if not last.all():
                yield node_rows(shard, rows[~last], band_depth)
                shard += 1
            held, size = [rows[last]], int(last.sum())
        if size:
            yield node_rows(shard, pd.concat(held, ignore_index=True), band_depth)

    return run


def accumulate(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over subtrees: values (slots x measures) go to their parents' slots, deepest level first."""
    total = values.copy()
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order], prepend=np.iinfo(np.int64).min, append=np.iinfo(np.int64).min))
    for a, b in zip(edges[:-1], edges[1:]):
        level = order[a:b]
        level = level[parent[level] >= 0]
        np.add.at(total, parent[level], total[level])
    return total


def _sum_shard(rows: pd.DataFrame) -> pd.DataFrame:
    nodes = rows[rows["depth"] >= 0].sort_values("slot")
    given = rows[rows["depth"] < 0]
    values = nodes[["leaves", "saved"]].to_numpy(np.int64)
    np.add.at(values, given["slot"].to_numpy(), given[["leaves", "saved"]].to_numpy(np.int64))
    parent = nodes["parent_slot"].to_numpy()
    total = accumulate(parent, nodes["depth"].to_numpy(), values)
    conv = nodes["conv_id"].to_numpy()
    return pd.DataFrame(
        {
            "conv_id": conv,
            "depth": nodes["depth"].to_numpy(),
            "parent_conv_id": np.where(parent >= 0, conv[parent], np.iinfo(np.int64).min),
            "leaves": total[:, 0],
            "saved": total[:, 1],
        }
    )


def ends(paths: DataFrame) -> DataFrame:
    """conv, depth, d1, d2 of the last prefix of each conversation, hashed by node: d1, d2, ends_sha256.

    Ids are joined in parallel, by ranges of (node, conversation); only the hash itself, which has to take a node's ids one after
    another, passes over the joined pieces in one task.
    """
    sort = ["d1", "d2", "conv"]

    def join_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId(), 0
        for frame in frames:
            new = (frame["d1"].diff() != 0) | (frame["d2"].diff() != 0)
            pieces = frame.assign(id=frame["conv"].astype(str)).groupby(new.cumsum(), sort=False).agg(d1=("d1", "first"), d2=("d2", "first"), ids=("id", ",".join))
            pieces["part"], pieces["k"] = part, np.arange(k, k + len(pieces))
            k += len(pieces)
            yield pieces

    def hash_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            done = []
            for d1, d2, ids in zip(frame["d1"].tolist(), frame["d2"].tolist(), frame["ids"]):
                if (d1, d2) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (d1, d2), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["d1", "d2", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["d1", "d2", "ends_sha256"])

    joined = paths.repartitionByRange(*sort).sortWithinPartitions(*sort).select(*sort).mapInPandas(join_ids, "d1 long, d2 long, ids string, part int, k long")
    return joined.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "part", "k").mapInPandas(hash_ids, "d1 long, d2 long, ends_sha256 string")


def node_table(turns: DataFrame, band_depth: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie."""
    paths = cut_lineage(prefixes(rebuilt(turns), band_depth))
    dealt = paths.repartitionByRange("band", "conv").sortWithinPartitions("band", "conv", "depth")
    shards = cut_lineage(dealt.mapInPandas(_cut_shards(band_depth, shard_rows), TABLE))
    alike = [F.max(c).alias(c) for c in ("depth", "bytes", "p1", "p2")]
    found = cut_lineage(shards.groupBy("d1", "d2").agg(F.sum("members").alias("n_convs"), F.min("first").alias("conv_id"), *alike))
    children = found.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(found.join(children, ["d1", "d2"], "left").na.fill(0, ["n_children"]))
    gain = (F.col("n_convs") - 1) * F.col("bytes")
    leaf = (F.col("n_children") == 0).cast("long")
    asked = shards.select("shard", "slot", "parent_slot", "d1", "d2", "first").join(nodes.drop("p1", "p2"), ["d1", "d2"])
    mine = F.col("first") == F.col("conv_id")
    own = asked.select("shard", "slot", "parent_slot", "depth", "conv_id", F.when(mine, leaf).otherwise(0).alias("leaves"), F.when(mine, gain).otherwise(0).alias("saved"))
    band = (F.col("depth") / band_depth).cast("long")
    deeper = nodes.filter(F.col("depth") >= band_depth).groupBy("conv_id", band.alias("band")).agg(F.sum(leaf).alias("leaves"), F.sum(gain).alias("saved"))
    goes_on = shards.filter("goes_on is not null").select("shard", "slot", band.alias("above"), F.explode("goes_on").alias("conv_id"))
    given = goes_on.join(deeper, "conv_id").filter("band > above").groupBy("shard", "slot").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    given = given.select("shard", "slot", F.lit(-1).alias("parent_slot"), F.lit(-1).cast("long").alias("depth"), F.lit(0).cast("long").alias("conv_id"), "leaves", "saved")
    sums = own.unionByName(given).groupBy("shard").applyInPandas(_sum_shard, "conv_id long, depth long, parent_conv_id long, leaves long, saved long")
    totals = sums.groupBy("conv_id", "depth").agg(F.max("parent_conv_id").alias("within"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    # nodes whose band begins with them have their parent in another shard
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("across"))
    starts = nodes.filter((F.col("depth") % band_depth == 0) & (F.col("depth") > 0)).join(parents, ["p1", "p2"]).select("conv_id", "depth", "across")
    last = paths.groupBy("conv").agg(F.max("depth").alias("depth"))
    ended = ends(paths.join(last, ["conv", "depth"]).select("conv", "d1", "d2"))
    out = nodes.select("d1", "d2", "conv_id", "depth", "n_convs", "n_children").join(ended, ["d1", "d2"], "left").join(totals, ["conv_id", "depth"]).join(starts, ["conv_id", "depth"], "left")
    parent = F.coalesce("across", F.when(F.col("depth") > 0, F.col("within")))
    digest = F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", digest)
