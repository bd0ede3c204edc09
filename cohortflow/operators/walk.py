"""Walk-forward forests over stacked subjects: the forest of every time step from shared scans.

The model of a step is fitted on all rows of earlier steps. A row's weight in a tree does not depend on the step, so the
histograms of a node, kept by the rows' own step and summed up along the steps, hold the training data of that node for every
step at once. Steps whose splits agree share their nodes; where they part, the node is counted once per group of
steps. One scan grows one level of all trees of all steps.

What reaches the driver are the steps (calendar days of a panel), the bin edges and the trees: trees x steps x 2^depth numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, release

SLICE_ROWS = 200_000  # rows that a task counts before it sends sums
TASKS = 32  # small tables are spread by trees instead
# Cumulative probabilities of the Poisson distribution with mean 1, for 0 to 8.
POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def row_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row stands in the tree's resample: a Poisson number from a hash of its key and the tree."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(((seed << 20) + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    uniform = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    weights = np.zeros(len(uniform))
    for step in POISSON:
        weights += uniform >= step
    return weights


class Trees:
    """Feature (-1: leaf), cut and value by tree, step and node; node 1 is the root, the children of i are 2i and 2i + 1."""

    def __init__(self, trees: int, steps: int, depth: int):
        shape = (trees, steps, 2 ** (depth + 1))
        self.feature, self.cut, self.value = np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape)
        self.depth = depth

    def slots(self, tree: int, level: int, bins: np.ndarray, after: np.ndarray) -> Iterator[tuple[int, list[int], np.ndarray]]:
        """(node, steps that share it, its rows) of a level, in a fixed order. `after` is a row's first step with it in the past."""
        open_ = [(1, list(range(self.feature.shape[1])), np.flatnonzero(after < self.feature.shape[1]))]
        for _ in range(level):
            below = []
            for node, steps, rows in open_:
                groups: dict[tuple[int, int], list[int]] = {}
                for h in steps:
                    if self.feature[tree, h, node] >= 0:
                        groups.setdefault((int(self.feature[tree, h, node]), int(self.cut[tree, h, node])), []).append(h)
                for (feature, cut), same in sorted(groups.items()):
                    own = rows[after[rows] <= same[-1]]
                    left = bins[own, feature] <= cut
                    below += [(2 * node, same, own[left]), (2 * node + 1, same, own[~left])]
            open_ = below
        yield from open_

    def predict(self, bins: np.ndarray, step: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(bins)), np.arange(len(bins))
        for tree in range(len(self.feature)):
            node = np.ones(len(bins), np.int64)
            for _ in range(self.depth):
                f = self.feature[tree, step, node]
                node = np.where(f >= 0, 2 * node + (bins[every, np.maximum(f, 0)] > self.cut[tree, step, node]), node)
            total += self.value[tree, step, node]
        return total / len(self.feature)


def cells(bins: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each cell, each row's cell); the rows of a cell have equal bins and the same first step and share all nodes."""
    order = np.lexsort([*bins.T, after])
    own = np.column_stack([bins, after])[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]).any(axis=1)
    cell = np.empty(len(own), np.int64)
    cell[order] = np.cumsum(fresh) - 1
    return order[fresh], cell


def histograms(bins, after, wy, w, rows, steps: int, width: int) -> np.ndarray:
    """2 x steps x features x bins: weights and weighted targets of a node's rows by the first step that may use them."""
    out = np.empty((2, steps, bins.shape[1], width))
    for f in range(bins.shape[1]):
        cell = after[rows] * width + bins[rows, f]
        out[0, :, f] = np.bincount(cell, w[rows], steps * width).reshape(steps, width)
        out[1, :, f] = np.bincount(cell, wy[rows], steps * width).reshape(steps, width)
    return out


def best_splits(hist: np.ndarray, steps: list[int], min_leaf: float):
    """Of a node's histograms: (step, own mean, feature or -1, cut, left mean, right mean) for each of the steps."""
    past = hist.cumsum(axis=1)[:, steps]  # the sums of every step's training rows
    n, s = past.cumsum(axis=3)
    total_n, total_s = n[:, :1, -1:], s[:, :1, -1:]
    left_n, left_s, right_n, right_s = n, s, total_n - n, total_s - s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + right_s**2 / right_n - total_s**2 / total_n
        mean = np.where(total_n > 0, total_s / np.maximum(total_n, 1e-300), 0.0)[:, 0, 0]
    usable = (left_n >= min_leaf) & (right_n >= min_leaf)
    gain = np.where(usable, gain, 0.0).reshape(len(steps), -1)
    top = gain.max(axis=1, keepdims=True)
    # equal gains take the first place, whatever the order of summation
    at = (gain >= top * (1 - 1e-9)).argmax(axis=1)
    floor = 1e-9 * np.maximum(total_s**2 / np.maximum(total_n, 1e-300), 1e-300)[:, 0, 0]
    for i, h in enumerate(steps):
        f, cut = divmod(int(at[i]), hist.shape[3])
        if top[i, 0] <= floor[i]:
            yield h, mean[i], -1, 0, 0.0, 0.0
        else:
            yield h, mean[i], f, cut, left_s[i, f, cut] / left_n[i, f, cut], right_s[i, f, cut] / right_n[i, f, cut]


def _binned(frame: pd.DataFrame, edges: list[np.ndarray]) -> np.ndarray:
    x = np.array(frame["_x"].tolist(), float).reshape(len(frame), len(edges))
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.int16)


def _compact(frames: Iterator[pd.DataFrame], edges, held: np.ndarray):
    """(group of trees, small arrays) of each slice in turn: bins, first usable step, key and target of its rows."""
    at, parts = None, []
    for frame in frames:
        for own, piece in frame.groupby(["_slice", "_group"], sort=False):
            if own != at and parts:
                yield at[1], tuple(np.concatenate(p) for p in zip(*parts))
                parts = []
            at = own
            after = np.searchsorted(held, piece["_step"].to_numpy(), side="right")
            parts.append((_binned(piece, edges), after, piece["_key"].to_numpy(), piece["y"].to_numpy(float)))
    if parts:
        yield at[1], tuple(np.concatenate(p) for p in zip(*parts))


def walk_forward_stacked(
    df: DataFrame, cols: list[str], target: str, step: str, keys: list[str], share: float = 0.3, trees: int = 500, depth: int = 4,
    bins: int = 32, min_leaf: float = 2.0, seed: int = 42,
) -> DataFrame:
    """keys, step, y, prediction for the rows of the last steps, `share` of all rows, each from a forest refitted on all earlier steps.

    Steps are the values of an integer or date column with few distinct values. A step is held out from the one on that
    holds the first row of the last `share`, never the very first. Bin edges are quantiles of the rows before it, so no
    forest has read a row of its own or a later step. Rows with a gap are left out; an empty table gives no rows.
    """
    plain = df.select(*keys, F.col(step).alias("_at"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)], F.col(target).cast("double").alias("y"))
    plain = plain.na.drop(subset=["_at", *[f"_x{i}" for i in range(len(cols))], "y"])
    number = F.unix_date("_at") if plain.schema["_at"].dataType.typeName() == "date" else F.col("_at")
    rows = cut_lineage(plain.select(
        *keys, "_at", number.cast("long").alias("_step"), F.array(*[f"_x{i}" for i in range(len(cols))]).alias("_x"), "y", F.xxhash64(*keys).alias("_key")
    ))
    sizes = sorted((r["_step"], r["n"]) for r in rows.groupBy("_step").agg(F.count(F.lit(1)).alias("n")).collect())
    values, counts = np.array([s for s, _ in sizes], np.int64), np.array([n for _, n in sizes], np.int64)
    total = int(counts.sum())
    held = values[1:][counts.cumsum()[1:] > total - int(total * share)]
    out = [*[k for k in keys if k != step], F.col("_at").alias(step), "y"]
    if not len(held):
        return rows.select(*out, F.lit(None).cast("double").alias("prediction")).limit(0)
    early = rows.filter(F.col("_step") < int(held[0]))
    marks = [i / bins for i in range(1, bins)]
    found = early.agg(F.avg("y").alias("y"), *[F.percentile_approx(F.col("_x")[i], F.array(*[F.lit(m) for m in marks]), F.lit(10000)).alias(f"q{i}") for i in range(len(cols))]).first()
    shift, edges = found["y"], [np.unique(found[f"q{i}"]) for i in range(len(cols))]
    slices = -(-total // SLICE_ROWS)
    groups = min(max(1, TASKS // slices), trees)
    used = rows.filter(F.col("_step") < int(held[-1])).select(
        "_step", "_x", "y", "_key", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).alias("_slice"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group")
    )
    model, steps = Trees(trees, len(held), depth), len(held)

    def counted(level: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for group, (x, after, key, y) in _compact(frames, edges, held):
                first, cell = cells(x, after)
                x, after, gap = x[first], after[first], y - shift
                for tree in range(group, trees, groups):
                    # a tree weighs rows, then counts cells
                    w = row_weights(key, tree, seed)
                    n, s = np.bincount(cell, w, len(first)), np.bincount(cell, w * gap, len(first))
                    nodes = [histograms(x, after, s, n, at, steps, bins).ravel() for _, _, at in model.slots(tree, level, x, after)]
                    if nodes:
                        yield pd.DataFrame({"tree": [tree], "h": [np.concatenate(nodes)]})

        return run

    none = np.zeros((0, len(cols)), np.int16), np.zeros(0, np.int64)

    def decided(level: int):
        def finish(tree: int, sums: np.ndarray) -> pd.DataFrame:
            found = []
            nodes = sums.reshape(-1, 2, steps, len(cols), bins)
            for hist, (node, same, _) in zip(nodes, model.slots(tree, level, *none)):
                found += [(tree, node, *split) for split in best_splits(hist, same, min_leaf)]
            return pd.DataFrame(found, columns=["tree", "node", "step", "mean", "feature", "cut", "low", "high"])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, sums = None, None
            for frame in frames:
                for own, h in zip(frame["tree"], frame["h"]):
                    if own == tree:
                        sums += h
                        continue
                    if tree is not None:
                        yield finish(tree, sums)
                    tree, sums = own, np.array(h, float)
            if tree is not None:
                yield finish(tree, sums)

        return run

    for level in range(depth):
        work = used.repartition(slices * groups, "_slice", "_group").sortWithinPartitions("_slice", "_group")
        parts = work.mapInPandas(counted(level), "tree int, h array<double>").repartition("tree").sortWithinPartitions("tree")
        splits = parts.mapInPandas(decided(level), "tree int, node int, step int, mean double, feature int, cut int, low double, high double").toPandas()
        if not len(splits):
            break
        t, h, node = (splits[c].to_numpy() for c in ("tree", "step", "node"))
        if level == 0:
            model.value[t, h, node] = splits["mean"]
        model.feature[t, h, node], model.cut[t, h, node] = splits["feature"], splits["cut"]
        model.value[t, h, 2 * node], model.value[t, h, 2 * node + 1] = splits["low"], splits["high"]
        if (splits["feature"] < 0).all():
            break

    @F.pandas_udf("double")
    def predicted(at: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(shift + model.predict(_binned(pd.DataFrame({"_x": x}), edges), np.searchsorted(held, at.to_numpy())))

    late = rows.filter(F.col("_step") >= int(held[0]))
    done = cut_lineage(late.select(*out, predicted("_step", "_x").alias("prediction")))
    release(rows)
    return done


def walk_metrics(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    """mae, mse, r2 and the number of predictions, per key or overall; r2 is null where the target does not vary."""
    gap = F.col("y") - F.col("prediction")
    spread = F.var_pop("y") * F.count("y")
    return predictions.groupBy(*by).agg(
        F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"),
        F.when(F.min("y") < F.max("y"), 1 - F.sum(gap * gap) / spread).alias("r2"), F.count(F.lit(1)).alias("n_rows"),
    )
