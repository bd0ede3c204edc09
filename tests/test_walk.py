"""Walk-forward forests from shared scans against forests fitted one by one."""

import datetime

import numpy as np
import pytest

from cohortflow.operators import walk

TREES, DEPTH, BINS, SEED = 6, 3, 8, 5


def _table(spark, late=0.0):
    rng = np.random.default_rng(3)
    rows = []
    for day in range(20):
        for subject in range(9):
            a, b = float(rng.normal()), float(rng.integers(0, 5))
            y = 3.0 * (a > 0.2) + 0.7 * b * (day > 8) + 0.1 * float(rng.normal())
            rows.append((subject, day, a, b, y + (late if day >= 17 else 0.0), "x"))
    rows.append((99, 3, None, 1.0, 5.0, "x"))
    return spark.createDataFrame(rows, "num_id long, day int, a double, b double, y double, prediction string").repartition(5)


def _grow(x, y, w, node, depth, min_leaf):
    """A plain tree on binned columns: weighted variance reduction, first of equal gains."""
    n, s = w.sum(), (w * y).sum()
    mean = s / n if n else 0.0
    best, gain = None, 1e-9 * s * s / max(n, 1e-300)
    for f in range(x.shape[1]) if depth else ():
        for c in range(BINS):
            go = x[:, f] <= c
            ln, ls = w[go].sum(), (w * y)[go].sum()
            if ln >= min_leaf and n - ln >= min_leaf:
                g = ls * ls / ln + (s - ls) ** 2 / (n - ln) - s * s / n
                if g > gain * (1 + 1e-9):
                    best, gain = (f, c), g
    if best is None:
        return mean
    go = x[:, best[0]] <= best[1]
    return (*best, _grow(x[go], y[go], w[go], 2 * node, depth - 1, min_leaf), _grow(x[~go], y[~go], w[~go], 2 * node + 1, depth - 1, min_leaf))


def _value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _run(df, **more):
    return walk.walk_forward_stacked(df, ["a", "b"], "y", "day", ["num_id", "day"], trees=TREES, depth=DEPTH, bins=BINS, seed=SEED, **more)


def test_every_step_equals_its_own_forest(spark):
    from pyspark.sql import functions as F

    table = _table(spark)
    got = {(r["num_id"], r["day"]): r["prediction"] for r in _run(table, share=0.3).collect()}
    rows = table.na.drop().withColumn("key", F.xxhash64("num_id", "day")).toPandas()
    assert set(got) == {(i, d) for i, d in zip(rows["num_id"], rows["day"]) if d >= 14}
    early = table.na.drop().filter("day < 14")
    marks = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    edges = [np.unique(early.agg(F.percentile_approx(c, marks, F.lit(10000))).first()[0]) for c in ("a", "b")]
    x = np.stack([np.searchsorted(e, rows[c], side="left") for e, c in zip(edges, ("a", "b"))], axis=1)
    y, day, key = rows["y"].to_numpy(), rows["day"].to_numpy(), rows["key"].to_numpy()
    shift = y[day < 14].mean()
    for h in range(14, 20):
        past = day < h
        trees = [_grow(x[past], y[past] - shift, walk.row_weights(key[past], t, SEED), 1, DEPTH, 2.0) for t in range(TREES)]
        for i in np.flatnonzero(day == h):
            want = shift + np.mean([_value(t, x[i]) for t in trees])
            assert got[rows["num_id"][i], h] == pytest.approx(want, abs=1e-9)


def test_later_rows_are_not_read(spark):
    plain, changed = (
        {(r["num_id"], r["day"]): r["prediction"] for r in _run(_table(spark, late)).collect() if r["day"] <= 17} for late in (0.0, 1000.0)
    )
    assert plain == pytest.approx(changed, abs=1e-9) and len(plain) == 9 * 4


def test_forecast_beats_the_mean_and_metrics(spark):
    out = _run(_table(spark))
    m = walk.walk_metrics(out).first()
    pdf = out.toPandas()
    gap = pdf["y"] - pdf["prediction"]
    assert m["mae"] == pytest.approx(gap.abs().mean()) and m["mse"] == pytest.approx((gap**2).mean())
    assert m["r2"] == pytest.approx(1 - (gap**2).sum() / ((pdf["y"] - pdf["y"].mean()) ** 2).sum())
    assert m["r2"] > 0.5  # the effect of b changes on the way, so a forest of all earlier rows stays below the noise limit
    assert walk.walk_metrics(out, ["num_id"]).count() == 9


def test_odd_tables(spark):
    empty = _table(spark).limit(0)
    assert _run(empty).count() == 0
    one = spark.createDataFrame([(i, 1, 1.0, 2.0, 3.0) for i in range(5)], "num_id long, day int, a double, b double, y double")
    assert _run(one).count() == 0
    first = datetime.date(2020, 1, 1)
    rows = [(i, first + datetime.timedelta(days=d), 1.0, 1.0, 2.5) for i in range(4) for d in range(5)]
    flat = spark.createDataFrame(rows, "num_id long, dt date, a double, b double, y double")
    got = walk.walk_forward_stacked(flat, ["a", "b"], "y", "dt", ["num_id", "dt"], trees=3).collect()
    assert len(got) == 8 and all(r["prediction"] == pytest.approx(2.5) for r in got)


def test_resample_weights_are_poisson():
    w = np.concatenate([walk.row_weights(np.arange(20000, dtype=np.int64) - 7, t, 1) for t in range(3)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04


def test_cells_hold_equal_rows():
    bins, after = np.array([[1, 2], [1, 2], [0, 2], [1, 2], [0, 2]], np.int16), np.array([0, 1, 0, 0, 0])
    first, cell = walk.cells(bins, after)
    assert len(first) == 3 and cell[0] == cell[3] and cell[2] == cell[4] and len(set(cell)) == 3
    assert all((bins[first[c]] == bins[i]).all() and after[first[c]] == after[i] for i, c in enumerate(cell))
