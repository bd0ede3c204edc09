"""SimHash near-duplicates found with BK-trees.

Fingerprints that differ in at most `radius` bits agree on at least one of radius + 1 blocks of bits, so each distinct
fingerprint is sent to one shard per block. A shard builds a BK-tree (children keyed by their Hamming distance to the
parent) and each of its fingerprints descends only the edges within the radius of its own distance. Shards that are too
full are cut again by blocks of their remaining bits, then into tiles, so nothing is dropped and no task is unbounded.
The trees go to their shard by a shuffle: a broadcast of all trees would grow with the corpus.
A shard returns spanning links, at most one per member, and components are found over these.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; equal fingerprints are one node, so
copies never meet pairwise; rows without an id get the smallest id of their component, null if it has none; rows
that repeat an id are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .buckets import Labels, groups, tiled
from .common import fresh

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
CROWDED = 2048


def shingle_values(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of `size` words; of all words where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The bits set in over half of the shingles' XXH64 values."""
    return majority(shingle_values(text, size))


def majority(values: list[int] | np.ndarray) -> int:
    """The bits set in over half of the values; zero for none."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(values), 1 << 16):  # bounds the unpacked bits of a very long text
        some = np.array(values[i : i + (1 << 16)], dtype="<u8")
        votes += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    bits = votes * 2 > len(values)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def simhash_udf(size: int = SHINGLE):
    """A column function: the 64 bits as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row."""
    return docs.select("doc_id", simhash_udf(size)("text").alias("fp"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class BKTree:
    """children[i][d]: the child of node i at distance d. Values are unsigned 64-bit integers, all different."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        waiting = [(0, np.arange(1, len(values)))] if len(values) else []
        while waiting:
            node, below = waiting.pop()
            distance = np.bitwise_count(values[below] ^ values[node])
            for d in set(distance.tolist()):
                own = below[distance == d]
                self.children[node][d] = int(own[0])
                if len(own) > 1:
                    waiting.append((int(own[0]), own[1:]))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indices of the queries within the radius of it); many queries descend together."""
        waiting = [(0, np.arange(len(queries)))] if len(self.values) else []
        while waiting:
            node, asking = waiting.pop()
            distance = np.bitwise_count(queries[asking] ^ self.values[node]).astype(np.int64)
            hits = asking[distance <= radius]
            if len(hits):
                yield node, hits
            for d, child in self.children[node].items():
                near = asking[np.abs(distance - d) <= radius]
                if len(near):
                    waiting.append((child, near))


def masks(bits: list[int], count: int) -> list[int]:
    """The bit positions cut into `count` runs, each as a mask (a signed long)."""
    out = []
    for run in np.array_split(np.array(bits), count):
        out.append(int(np.array(sum(1 << int(b) for b in run), dtype=np.uint64).view(np.int64)))
    return out


def _blocks(own: list[int], fp: Column, name: str) -> Column:
    return F.array(*[F.struct(F.lit(i).alias(name), fp.bitwiseAND(F.lit(m)).alias(f"{name}_bits")) for i, m in enumerate(own)])


def shards(nodes: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """nodes (fp) keyed by block, block_bits and, where that shard is crowded, by sub, sub_bits of the other bits."""
    count = radius + 1
    outer = masks(list(range(BITS)), count)
    rows = nodes.select("fp", F.explode(_blocks(outer, F.col("fp"), "block")).alias("k")).select("fp", "k.*")
    full = rows.groupBy("block", "block_bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded)
    marked = rows.join(full, ["block", "block_bits"], "left")
    inner = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_bits")))
    choice = None
    for i, run in enumerate(np.array_split(np.arange(BITS), count)):
        rest = [b for b in range(BITS) if b not in set(run.tolist())]
        cut = _blocks(masks(rest, count), F.col("fp"), "sub")
        test = F.col("n").isNotNull() & (F.col("block") == i)
        choice = F.when(test, cut) if choice is None else choice.when(test, cut)
    return marked.select("fp", "block", "block_bits", F.explode(choice.otherwise(inner)).alias("k")).select("fp", "block", "block_bits", "k.*")


KEYS = ["block", "block_bits", "sub", "sub_bits"]


def links(nodes: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that span every group of fingerprints connected within a shard."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(frames, [*KEYS, "tile_a", "tile_b"]):
            values = np.sort(group["fp"].to_numpy())
            own = values.view(np.uint64)
            if group["tile_a"].iat[0] != group["tile_b"].iat[0]:
                first = group["tile"].to_numpy() == group["tile_a"].iat[0]
                inside, outside = group["fp"].to_numpy()[first], group["fp"].to_numpy()[~first]
                values = np.concatenate([inside, outside])
                own = values.view(np.uint64)
                tree, offset = BKTree(own[: len(inside)]), len(inside)
            else:
                tree, offset = BKTree(own), 0
            labels = Labels(len(values))
            for node, hits in tree.search(own[offset:], radius):
                labels.join(node, hits + offset)
            roots = labels.of
            linked = roots != np.arange(len(values))
            if linked.any():
                yield pd.DataFrame({"a": values[linked], "b": values[roots[linked]]})

    return tiled(shards(nodes, radius, crowded), KEYS, "fp", crowded).mapInPandas(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, group_fp, component_id) for every row.

    component_id is the smallest id reachable over links; group_fp names the component even where no row has an id.
    """
    rows = cut_lineage(fingerprints(docs, size))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = cut_lineage(links(nodes.select("fp"), radius))
    ends = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct()
    labels = connected_components(ends, found).select(F.col("id").alias("fp"), F.col("component").alias("group_fp"))
    named = nodes.join(labels, "fp", "left").withColumn("group_fp", F.coalesce("group_fp", "fp"))
    smallest = named.groupBy("group_fp").agg(F.min("first").alias("component_id"))
    by_fp = cut_lineage(named.join(smallest, "group_fp").select("fp", "group_fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "group_fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component, the one with the smallest id (any, if none has an id); all columns kept."""
    found = near_duplicates(docs, size, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("group_fp").agg(F.min(F.struct("doc_id", "fp")).alias("k"))
    chosen = cut_lineage(chosen.select(F.col("k.doc_id").alias("kept_id"), F.col("k.fp").alias("kept_fp")))
    (name,) = fresh(docs, "fp")
    marked = docs.withColumn(name, simhash_udf(size)("text"))
    match = F.col("doc_id").eqNullSafe(chosen["kept_id"]) & (F.col(name) == chosen["kept_fp"])
    return marked.join(chosen, match, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
