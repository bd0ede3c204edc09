"""The in-task forest."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions import small_forest
from cohortflow.functions.small_forest import forest_predict, forests_predict
from cohortflow.operators import models


def plain_forest(x, y, x_new, trees=30, depth=6, min_rows=4, seed=0):
    """One forest on its own, every row of every level counted anew."""
    rng = np.random.default_rng(seed)
    pick = rng.integers(0, len(y), (trees, len(y))).ravel()
    xs, ys, node = x[pick], y[pick], np.repeat(np.arange(trees), len(y))
    new, at = np.tile(np.arange(len(x_new)), trees), np.repeat(np.arange(trees), len(x_new))
    out, count, width = np.zeros(len(x_new)), trees, x.shape[1]
    for level in range(depth + 1):
        n, s = np.bincount(node, minlength=count), np.bincount(node, ys, count)
        mean = s / np.maximum(n, 1)
        split = np.zeros(count, bool)
        if level < depth and count:
            tried = rng.random((count, width)).argsort(axis=1)[:, : max(1, (width + 2) // 3)].repeat(4, axis=1)
            low, high = np.full((count, width), np.inf), np.full((count, width), -np.inf)
            np.minimum.at(low, node, xs)
            np.maximum.at(high, node, xs)
            every = np.arange(count)[:, None]
            cuts = rng.uniform(low[every, tried], high[every, tried])
            ranges = np.full(count, np.inf), np.full(count, -np.inf)
            np.minimum.at(ranges[0], node, ys)
            np.maximum.at(ranges[1], node, ys)
            rows, gain = np.arange(len(ys)), np.full(tried.shape, -np.inf)
            for c in range(tried.shape[1]):
                left = (xs[rows, tried[node, c]] <= cuts[node, c]).astype(float)
                ln, ls = np.bincount(node, left, count), np.bincount(node, left * ys, count)
                # the largest between-side sum of squares is the smallest remaining variance
                both = ls**2 / np.maximum(ln, 1) + (s - ls) ** 2 / np.maximum(n - ln, 1)
                gain[:, c] = np.where((ln > 0) & (ln < n), both, -np.inf)
            best = gain.argmax(axis=1)
            split = np.isfinite(gain.max(axis=1)) & (n >= min_rows) & (ranges[1] > ranges[0])
        ends = ~split[at]
        out += np.bincount(new[ends], mean[at[ends]], len(x_new))
        if not split.any():
            break
        feature, cut = tried[np.arange(count), best], cuts[np.arange(count), best]
        number = 2 * (split.cumsum() - 1)
        keep, stay = split[node], split[at]
        xs, ys, node, new, at = xs[keep], ys[keep], node[keep], new[stay], at[stay]
        node = number[node] + (xs[np.arange(len(ys)), feature[node]] > cut[node])
        at = number[at] + (x_new[new, feature[at]] > cut[at])
        count = 2 * int(split.sum())
    return out / trees


def test_learns_a_step_and_stays_in_range():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = np.where(x[:, 0] > 0.3, 5.0, 1.0) + 0.1 * rng.normal(size=200)
    new = rng.normal(size=(300, 2))
    got = forest_predict(x, y, new, trees=100, seed=1)
    far = np.abs(new[:, 0] - 0.3) > 0.3
    assert np.abs(got - np.where(new[:, 0] > 0.3, 5.0, 1.0))[far].mean() < 0.3
    assert got.min() >= y.min() - 1e-9 and got.max() <= y.max() + 1e-9
    assert np.array_equal(got, forest_predict(x, y, new, trees=100, seed=1))


def test_trees_without_a_split_return_resample_means():
    x, y = np.ones((50, 1)), np.arange(50.0)
    picks = np.random.default_rng(4).integers(0, 50, (300, 50))
    assert np.allclose(forest_predict(x, y, np.array([[1.0], [9.0]]), trees=300, seed=4), y[picks].mean())
    assert np.allclose(forest_predict(np.arange(9.0)[:, None], np.full(9, 2.5), np.array([[3.0]])), 2.5)
    assert forest_predict(x, y, np.zeros((0, 1))).shape == (0,)


def test_full_depth_reproduces_separable_rows():
    x = np.arange(8.0)[:, None]
    y = np.array([0.0, 0, 0, 0, 10, 10, 10, 10])
    got = forest_predict(x, y, x, trees=400, depth=6, min_rows=2)
    assert got[0] < 0.5 and got[-1] > 9.5 and (np.diff(got) >= -1e-9).all()


@pytest.mark.parametrize("width", [1, 2, 5])
def test_forests_that_grow_together_equal_forests_alone(width, monkeypatch):
    monkeypatch.setattr(small_forest, "ROWS", 1500)  # a few forests at a time
    rng = np.random.default_rng(width)
    jobs = []
    for seed in range(12):
        n = int(rng.integers(1, 40))
        x, y = rng.normal(size=(n, width)).round(seed % 3), (5 * rng.normal(size=n)).round(seed % 4)
        jobs.append((x, y, rng.normal(size=(seed % 4, width)), seed))
    got = forests_predict(jobs, 20, 5, 3)
    assert all(np.array_equal(g, plain_forest(x, y, new, 20, 5, 3, seed)) for g, (x, y, new, seed) in zip(got, jobs))


def test_a_small_panel_is_walked_by_all_cores(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(s, day + datetime.timedelta(d), float(d % 3), d, float(s + d % 5)) for s in range(40) for d in range(12)]
    panel = spark.createDataFrame(rows, "num_id long, dt date, a double, day int, y double")
    # the panel's own shuffle by subject must not stand in for the walk's
    panel = panel.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "num_id")
    walked = models.walk_forward_subjects(panel, ["a", "day"], "y", trees=5)
    assert walked.count() == 40 * 3
    assert walked.select(F.spark_partition_id()).distinct().count() > 4
