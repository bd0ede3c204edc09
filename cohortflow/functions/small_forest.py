"""Small random forests for one subject's rows inside a Spark task.

A subject of a panel has at most one row per calendar day. Larger tables use Spark's own forests.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ROWS = 1 << 17  # resampled rows of forests that grow together
KEPT = 1 << 16  # resamples up to this size are kept for the next subject with as many rows
CUTS = 4  # tried per column


class _Draws:
    """A forest's resamples and the uniform numbers that follow them; both depend on the seed and the number of rows only."""

    def __init__(self, seed: int, rows: int, trees: int):
        self.rng = np.random.default_rng(seed)
        self.pick = self.rng.integers(0, rows, (trees, rows)).ravel()
        self.numbers = np.zeros(0)

    def uniform(self, start: int, end: int) -> np.ndarray:
        if end > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, self.rng.random(max(end - len(self.numbers), len(self.numbers)))])
        return self.numbers[start:end]


_kept = lru_cache(maxsize=32)(_Draws)


def forest_predict(x, y, x_new, trees=30, depth=6, min_rows=4, seed=0):
    """Mean prediction of bootstrapped randomised trees."""
    return forests_predict([(x, y, x_new, seed)], trees, depth, min_rows)[0]


def forests_predict(jobs, trees=30, depth=6, min_rows=4):
    """Predictions of a forest per job (x, y, x_new, seed); some forests grow together, level by level, on flat arrays.

    Jobs have the same columns. A job's result does not depend on the others.
    """
    out, some, size = [], [], 0
    for job in jobs:
        rows = trees * len(job[1])
        if some and size + rows > ROWS:
            out += _grown(some, trees, depth, min_rows)
            some, size = [], 0
        some.append(job)
        size += rows
    return out + (_grown(some, trees, depth, min_rows) if some else [])


def _grown(jobs, trees, depth, min_rows):
    draws = [(_kept if trees * len(y) <= KEPT else _Draws)(seed, len(y), trees) for _, y, _, seed in jobs]
    width, used = jobs[0][0].shape[1], [0] * len(jobs)
    tries = max(1, (width + 2) // 3)
    # rows and new rows are numbered through all jobs; a column's values stand together
    x, y, x_new = (np.concatenate([np.asarray(job[i], float) for job in jobs]) for i in range(3))
    if not np.isfinite(x).all():
        raise OverflowError("a predictor is not finite")
    ahead = [len(job[2]) for job in jobs]
    first, first_new = np.cumsum([0, *(len(job[1]) for job in jobs)]), np.cumsum([0, *ahead])
    flat, flat_new = x.T.ravel(), x_new.T.ravel()
    # the rows of a node stand together, in node order, and among them in the order of the resample: sums are taken in it
    row = np.concatenate([d.pick + at for d, at in zip(draws, first)])
    sizes = np.repeat(np.diff(first), trees)
    ys, out = y.take(row), np.zeros(len(x_new))
    new = np.concatenate([np.tile(np.arange(a, b), trees) for a, b in zip(first_new, first_new[1:])])
    at = np.concatenate([np.repeat(np.arange(j * trees, (j + 1) * trees), n) for j, n in enumerate(ahead)])
    own = np.full(len(jobs), trees)  # nodes of each job
    for level in range(depth + 1):
        starts = np.cumsum(sizes) - sizes
        n, s = sizes, np.bincount(np.repeat(np.arange(len(sizes)), sizes), ys, len(sizes))
        split = np.zeros(len(sizes), bool)
        if level < depth:
            kinds, places = [], []
            for j, d in enumerate(draws):
                mid, end = used[j] + own[j] * width, used[j] + own[j] * (width + CUTS * tries)
                numbers = d.uniform(used[j], end)
                kinds.append(numbers[: mid - used[j]].reshape(-1, width))
                places.append(numbers[mid - used[j] :].reshape(-1, CUTS * tries))
                used[j] = end
            # nodes that may split are numbered anew: enough rows, targets that differ
            may = (n >= min_rows) & (np.maximum.reduceat(ys, starts) > np.minimum.reduceat(ys, starts))
            which = np.flatnonzero(may)
            inside, sizes = np.flatnonzero(np.repeat(may, sizes)), sizes[which]
            row, ys = row.take(inside), ys.take(inside)
        if level < depth and len(which):
            inner, starts = len(which), np.cumsum(sizes) - sizes
            node = np.repeat(np.arange(inner), sizes)
            kinds, places = np.concatenate(kinds)[which], np.concatenate(places)[which]
            tried = kinds.argsort(axis=1)[:, :tries] if tries > 1 else kinds.argmin(axis=1)[:, None]
            total, gain, border = s[which], np.empty((CUTS * tries, inner)), np.empty((CUTS * tries, inner))
            for t in range(tries):
                value = flat.take(np.repeat(tried[:, t] * len(x), sizes) + row)
                low = np.minimum.reduceat(value, starts)
                span = np.maximum.reduceat(value, starts) - low
                for c in range(CUTS * t, CUTS * t + CUTS):
                    border[c] = low + span * places[:, c]
                    left = (value <= border[c].take(node)).astype(float)
                    ln, ls = np.add.reduceat(left, starts), np.bincount(node, left * ys, inner)
                    # the largest between-side sum of squares is the smallest remaining variance
                    both = ls**2 / np.maximum(ln, 1) + (total - ls) ** 2 / np.maximum(sizes - ln, 1)
                    both[(ln == 0) | (ln == sizes)] = -np.inf
                    gain[c] = both
            best, every = gain.argmax(axis=0), np.arange(inner)
            feature, cut, good = tried[every, best // CUTS], border[best, every], np.isfinite(gain[best, every])
            split[which] = good
        ends = ~split[at]
        out += np.bincount(new[ends], (s / np.maximum(n, 1))[at[ends]], len(x_new))
        if not split.any():
            break
        feature, cut, place = feature[good], cut[good], split.cumsum() - 1
        inside = np.flatnonzero(np.repeat(good, sizes))
        row, ys, sizes = row.take(inside), ys.take(inside), sizes[good]
        node = np.repeat(np.arange(len(sizes)), sizes)
        right = flat.take((feature * len(x)).take(node) + row) > cut.take(node)
        node = 2 * node + right
        sizes = np.bincount(node, minlength=2 * len(sizes))
        order = np.argsort(node.astype(np.uint16) if len(sizes) <= 1 << 16 else node, kind="stable")
        row, ys = row.take(order), ys.take(order)
        new, at = new[~ends], place[at[~ends]]
        at = 2 * at + (flat_new[feature[at] * len(x_new) + new] > cut[at])
        own = 2 * np.array([part.sum() for part in np.split(split, np.cumsum(own)[:-1])])
    return [part / trees for part in np.split(out, first_new[1:-1])]
