import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import timeline as tl


@pytest.fixture(scope="module")
def raw(spark):
    """Readings with tied times, gaps, one subject with most rows and one with a single row."""
    rng = np.random.default_rng(2)
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for i in range(600):
        who = 1 if rng.random() < 0.6 else int(rng.integers(2, 5))
        at = t0 + dt.timedelta(minutes=int(rng.integers(0, 4 * 24 * 6)) * 10)
        a = None if rng.random() < 0.6 else float(rng.integers(0, 50))
        b = None if rng.random() < 0.9 else float(rng.integers(0, 50))
        rows.append((who, at, i, a, b, None if rng.random() < 0.5 else f"t{i % 3}"))
    rows.append((9, t0, 600, 1.0, None, None))
    return spark.createDataFrame(rows, "num_id int, dt timestamp_ntz, event_id int, a double, b double, s string").repartition(4)


def frame(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("slot", [None, 600, 7200])
def test_fill_matches_pandas(raw, slot):
    got = frame(
        tl.fill_forward_backward(raw, ["num_id"], ["dt", "event_id"], ["a", "b"], None if slot is None else tl.time_slot("dt", slot)),
        "num_id", "dt", "event_id",
    )
    src = frame(raw, "num_id", "dt", "event_id")
    want = src.groupby("num_id")[["a", "b"]].ffill()
    want = want.fillna(src.groupby("num_id")[["a", "b"]].bfill())
    pd.testing.assert_frame_equal(got[["a", "b"]], want)


@pytest.mark.parametrize("slot", [600, 3600, 86400])
def test_same_day_matches_pandas(raw, slot):
    got = frame(tl.collapse_same_period(raw, ["a", "b"], ["s"], slot_seconds=slot), "num_id", "dt")
    src = frame(raw, "num_id", "dt", "event_id")
    src["day"] = src["dt"].dt.date
    keys = [src["num_id"], src["day"]]
    filled = src.groupby(keys)[["a", "b", "s"]].ffill()
    filled = filled.fillna(src.groupby(keys)[["a", "b", "s"]].bfill())
    want = filled.groupby(keys).agg({"a": "mean", "b": "mean", "s": "first"}).reset_index()
    assert np.allclose(got[["a", "b"]], want[["a", "b"]], equal_nan=True)
    assert got["s"].fillna("-").tolist() == want["s"].fillna("-").tolist()


@pytest.mark.parametrize("k", [-3, -1, 1, 2, 7])
@pytest.mark.parametrize("slot", [None, 600, 36000])
def test_lag_matches_pandas(raw, k, slot):
    got = frame(
        tl.add_lag(raw, ["a", "b"], k, order=["dt", "event_id"], slot=None if slot is None else tl.time_slot("dt", slot)), "num_id", "dt", "event_id"
    )
    src = frame(raw, "num_id", "dt", "event_id")
    for c in ("a", "b"):
        want = src.groupby("num_id")[c].shift(k)
        assert np.allclose(got[f"{c}_lag{k}"].astype(float), want, equal_nan=True)


def test_reindex_counts_every_day(spark):
    d = dt.date
    panel = spark.createDataFrame([(1, d(2024, 1, 1), 1.0), (1, d(2024, 1, 9), 2.0), (2, d(2024, 2, 1), None)], "num_id int, dt date, v double")
    got = frame(tl.reindex_days(panel), "num_id", "dt")
    assert len(got) == 10
    assert got["day"].tolist() == [*range(9), 0] and got["week"].tolist() == [0] * 7 + [1] * 2 + [0]


def test_interpolation_keeps_observed_values(spark):
    d = lambda i: dt.date(2024, 1, 1 + i)
    vals = [None, 1.0, None, 4.0, 5.0, None, None]
    panel = spark.createDataFrame([(1, d(i), 0, v) for i, v in enumerate(vals)], "num_id int, dt date, week int, v double")
    got = frame(tl.interpolate_weeks(panel, ["v"], 40), "dt")["v_int"]
    assert np.allclose(got, [np.nan, 1, 2.5, 4, 5, 5, 5], equal_nan=True)
    same = frame(tl.interpolate_weeks(panel, ["v"], 70), "dt")["v_int"]
    assert np.allclose(same, np.array(vals, float), equal_nan=True)


def test_week_counts_whole_24_hour_blocks(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 12)), (1, dt.datetime(2024, 1, 8, 11)), (1, dt.datetime(2024, 1, 8, 12))]
    got = frame(tl.assign_week(spark.createDataFrame(rows, "num_id int, dt timestamp_ntz")), "dt")
    assert got["week"].tolist() == [0, 0, 1]


def test_rmssd_and_slope_edges(spark):
    d = lambda i: dt.date(2024, 1, 1 + i)
    rows = [(1, d(0), 0, 1.0), (1, d(1), 1, 3.0), (1, d(2), 2, 2.0), (2, d(0), 0, 5.0), (3, d(0), 0, 1.0), (3, d(1), 1, None)]
    panel = spark.createDataFrame(rows, "num_id int, dt date, day int, v double")
    got = {r["num_id"]: r["v_rmssd"] for r in tl.rmssd(panel, ["v"]).collect()}
    assert got == {1: round(np.sqrt((4 + 1) / 2), 3), 2: None, 3: None}
    slope = {r["num_id"]: r["v_slope"] for r in tl.slopes(panel, ["v"]).collect()}
    assert slope[1] == pytest.approx(0.5) and slope[2] is None and slope[3] is None


def test_results_do_not_depend_on_partitioning(raw):
    one = frame(tl.collapse_same_period(raw.repartition(1), ["a"]), "num_id", "dt")
    many = frame(tl.collapse_same_period(raw.repartition(17), ["a"]), "num_id", "dt")
    pd.testing.assert_frame_equal(one, many)


def test_empty_frame(spark):
    empty = spark.createDataFrame([], "num_id int, dt timestamp_ntz, event_id int, a double")
    assert tl.collapse_same_period(empty, ["a"]).count() == 0
    assert tl.assign_week(empty).count() == 0
