"""Near-duplicate embeddings by lattice hashing.

Every table projects unit vectors orthogonally to eight dimensions and decodes them to the nearest point of a scaled E8
lattice. A vector lives in its own cell of each table and also visits the nearest neighbouring cells; members and visitors
of a cell are compared by their exact cosine in double precision. A link found in several cells counts only in the first, which
both vectors' cell lists tell, so cells return sums and spanning links, never pairs. Crowded cells are cut into tiles.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components link with nothing and are their
own component; equal vectors are one node with a multiplicity; vectors of different length never link; rows
without an id are kept, with the smallest id of their component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .buckets import Labels, groups, tiled

COSINE = 0.95
TABLES = 6
PROBES = 2
SCALE = 0.2
SEED = 17
CROWDED = 2048
ROW_BLOCK = 128


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 (integers with even sum, or all halves with even sum), times two as integers."""

    def nearest_d8(y):
        rounded = np.rint(y)
        error = y - rounded
        worst = np.abs(error).argmax(axis=1)
        rows = np.arange(len(y))
        odd = rounded.sum(axis=1) % 2 != 0
        step = np.where(error[rows, worst] >= 0, 1.0, -1.0)
        rounded[rows[odd], worst[odd]] += step[odd]
        return rounded

    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = np.square(x - whole).sum(axis=1) <= np.square(x - half).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], whole, half)).astype(np.int64)


@functools.cache
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, times two: (±1, ±1, 0...) and (±1/2...) with an even number of minus signs."""
    rows = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            rows.append(v)
    rows += [list(s) for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(rows, dtype=np.int64)


@functools.cache
def projections(dim: int, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """tables x 8 x dim with orthonormal rows in each table."""
    rng = np.random.default_rng((seed, dim))
    return np.stack([np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0].T[:, :dim] for _ in range(tables)])


def cell_keys(points: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit number per lattice point; a clash only adds a comparison."""
    weights = np.random.default_rng((SEED, table)).integers(1, 2**63, size=points.shape[-1], dtype=np.uint64) | np.uint64(1)
    mixed = (points.astype(np.uint64) * weights).sum(axis=-1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def cells(units: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """n x tables x (1 + probes) keys: the own cell, then the neighbouring cells nearest to the vector."""
    out = np.empty((len(units), tables, 1 + probes), dtype=np.int64)
    around = shortest_vectors()
    for t, basis in enumerate(projections(units.shape[1], tables)):
        x = units @ basis.T / scale
        home = nearest_e8(x)
        out[:, t, 0] = cell_keys(home, t)
        toward = (x - home / 2) @ around.T
        nearest = np.argpartition(-toward, probes, axis=1)[:, :probes]
        out[:, t, 1:] = cell_keys(home[:, None, :] + around[nearest], t)
    return out


def unit_rows(vectors: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision from the bytes of floats or doubles."""
    x = np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8") for v in vectors]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str = "embedding"):
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0), F.lit(False))


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        raw = [np.asarray(v, dtype="<f4" if getattr(v, "dtype", None) == np.float32 else "<f8").tobytes() for v in frame["embedding"]]
        size = np.array([len(v) for v in frame["embedding"]])
        keys = [b""] * len(raw)
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            for i, k in zip(at, cells(unit_rows([raw[i] for i in at], int(dim)))):
                keys[i] = k.astype("<i8").tobytes()
        yield pd.DataFrame({"node": frame["node"], "copies": frame["copies"], "dim": size, "vector": raw, "cells": keys})


def _visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if not len(frame):
            continue
        keys = np.stack([np.frombuffer(c, "<i8") for c in frame["cells"]]).reshape(len(frame), TABLES, 1 + PROBES)
        for t in range(TABLES):
            for p in range(1 + PROBES):
                yield frame.assign(t=t, cell=keys[:, t, p], visitor=p > 0)


KEYS = ["t", "dim", "cell"]


def _earlier(keys: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Whether the pairs (i, j) already meet in table t: one's own cell is the other's own or visited cell."""
    met = keys[i, t, 0] == keys[j, t, 0]
    rest = np.flatnonzero(~met)
    a, b = i[rest], j[rest]
    met[rest] = (keys[a, t, 1:] == keys[b, t, :1]).any(axis=1) | (keys[b, t, 1:] == keys[a, t, :1]).any(axis=1)
    return met


def _compare(cosine: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups(frames, [*KEYS, "tile_a", "tile_b"]):
            visitor = group["visitor"].to_numpy()
            if visitor.all():
                continue
            units = unit_rows(list(group["vector"]), int(group["dim"].iat[0]))
            keys = np.stack([np.frombuffer(c, "<i8") for c in group["cells"]]).reshape(len(group), TABLES, 1 + PROBES)
            node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            tile, apart = group["tile"].to_numpy(), group["tile_a"].iat[0] != group["tile_b"].iat[0]
            t = int(group["t"].iat[0])
            counts, labels = np.zeros(len(group), np.int64), Labels(len(group))
            homes = np.flatnonzero(~visitor)
            for at in range(0, len(homes), ROW_BLOCK):
                rows = homes[at : at + ROW_BLOCK]
                close = units[rows] @ units.T >= cosine
                close &= visitor[None, :] | (rows[:, None] < np.arange(len(group))[None, :])  # two members meet once
                if apart:
                    close &= tile[rows][:, None] != tile[None, :]
                for r, i in enumerate(rows):
                    hits = np.flatnonzero(close[r])
                    if len(hits):
                        labels.join(i, hits)
                i, j = np.nonzero(close)
                i = rows[i]
                # a visitor that is itself visited by the member: the pair also meets in the other cell
                mutual = visitor[j] & (keys[i, t, 1:] == keys[j, t, :1]).any(axis=1)
                keep = ~mutual | (node[i] < node[j])
                i, j = i[keep], j[keep]
                for earlier in range(t if len(i) else 0):
                    new = ~_earlier(keys, i, j, earlier)
                    i, j = i[new], j[new]
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
            told = (labels.of != np.arange(len(group))) | (counts > 0)
            if told.any():
                yield pd.DataFrame({"node": node[told], "links": counts[told], "root": node[labels.of[told]]})

    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id for every row of rows (vec_id, embedding)."""
    rows = rows.select("vec_id", "embedding").withColumn("usable", usable())
    distinct = rows.filter("usable").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()))
    hashed = cut_lineage(nodes.select("node", "copies", "embedding").mapInPandas(_hashed, "node long, copies long, dim int, vector binary, cells binary"))
    visits = hashed.mapInPandas(_visits, "node long, copies long, dim int, vector binary, cells binary, t int, cell long, visitor boolean")
    met = cut_lineage(tiled(visits, KEYS, "node", CROWDED).mapInPandas(_compare(cosine), "node long, links long, root long"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    edges = cut_lineage(met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = connected_components(ends, edges).select(F.col("id").alias("node"), F.col("component"))
    named = nodes.join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # to itself a copy is no link
    known = named.join(smallest, "component").select(
        F.col("embedding").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    found = rows.join(known, F.col("usable") & (F.col("embedding") == F.col("_vector")), "left")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")
    )
