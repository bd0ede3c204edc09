"""Comparing all members of a bucket in tasks of bounded size.

A bucket above `limit` rows is cut into tiles by a hash of the member; every two tiles meet in one task, so every two
members still meet exactly once and no task holds more than two tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT = 4096


def tiled(rows: DataFrame, keys: list[str], member: str, limit: int = LIMIT) -> DataFrame:
    """rows with `tile`, `tile_a`, `tile_b` (tile_a <= tile_b), dealt out by keys and tile pair."""
    crowded = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    tiles = F.coalesce(F.ceil(F.col("_n") / limit), F.lit(1)).cast("int")
    placed = rows.join(crowded, keys, "left").withColumn("_tiles", tiles).withColumn("tile", F.pmod(F.xxhash64(member), F.col("_tiles")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    placed = placed.withColumns({"tile_a": F.least("tile", "_other"), "tile_b": F.greatest("tile", "_other")})
    return placed.drop("_n", "_tiles", "_other").repartition(*keys, "tile_a", "tile_b")


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The partition's rows, one frame per value of keys with two rows or more. Holds one shuffle partition."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    frame = pd.concat(parts, ignore_index=True)
    frame = frame.iloc[np.lexsort([frame[k].to_numpy() for k in reversed(keys)])]
    changed = np.zeros(len(frame), bool)
    changed[0] = True
    for k in keys:
        values = frame[k].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    edges = np.append(np.flatnonzero(changed), len(frame))
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:
            yield frame.iloc[a:b]


class Labels:
    """Connected groups of n members, labelled by the smallest index; a merge costs one pass over the labels."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, member: int, others: np.ndarray) -> None:
        """member is linked with each of the others."""
        met = self.of[others]
        own = self.of[member]
        if (met == own).all():
            return
        groups_met = np.unique(np.append(met, own))
        self.of[np.isin(self.of, groups_met)] = groups_met[0]
