"""Outlier removal: interquartile fences and the iterated Smirnov-Grubbs test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.special import t_upper_quantile
from .ordering import exact_quantiles, unpivot, value_counts


def _fences(df: DataFrame, cols: list[str], k: float) -> DataFrame:
    q = exact_quantiles(df, [], cols, [0.25, 0.75])
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return q.select("variable", (q1 - k * (q3 - q1)).alias("low"), (q3 + k * (q3 - q1)).alias("high"))


def drop_iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows inside the fences; missing values go as well."""
    fence = _fences(df, [column], k).select(F.struct("low", "high").alias("f")).scalar()
    return df.withColumn("_f", fence).filter(F.col(column).between(F.col("_f.low"), F.col("_f.high"))).drop("_f")


def null_iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Values outside their column's fences become NULL."""
    fences = _fences(df, cols, k).agg(
        F.map_from_entries(F.collect_list(F.struct("variable", F.struct("low", "high")))).alias("f")
    ).scalar()
    out = df.withColumn("_f", fences)
    inside = {c: F.when(F.col(c).between(F.col("_f")[c]["low"], F.col("_f")[c]["high"]), F.col(c)) for c in cols}
    return out.withColumns(inside).drop("_f")


def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    t = t_upper_quantile(alpha / (2.0 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def _trim(n, mean, m2, lows, highs, bounded_low, bounded_high, alpha):
    """Remove extremes one copy at a time while the test rejects.

    `lows`/`highs` are [value, copies] lists, most extreme first. Returns the updated moments, the
    kept range and whether the supplied extremes ran out.
    """
    lo = hi = 0
    low_cut, high_cut = -math.inf, math.inf
    while n > 2:
        if (lo >= len(lows) and bounded_low) or (hi >= len(highs) and bounded_high):
            return n, mean, m2, low_cut, high_cut, True
        if lo >= len(lows) or hi >= len(highs):
            break
        low, high = lows[lo][0], highs[hi][0]
        sd = math.sqrt(max(m2, 0.0) / (n - 1))
        from_low = mean - low >= high - mean
        value = low if from_low else high
        if sd == 0.0 or abs(value - mean) / sd <= grubbs_critical(n, alpha):
            break
        rest = (n * mean - value) / (n - 1)
        m2 -= (value - mean) * (value - rest)
        n, mean = n - 1, rest
        side, at = (lows, lo) if from_low else (highs, hi)
        side[at][1] -= 1
        if side[at][1] == 0:
            if from_low:
                low_cut, lo = value, lo + 1
            else:
                high_cut, hi = value, hi + 1
    return n, mean, m2, low_cut, high_cut, False


def grubbs_ranges(df: DataFrame, cols: list[str], alpha: float = 0.05, extremes: int = 256) -> dict[str, tuple[float, float]]:
    """Open interval of kept values per column.

    Spark reduces each column to its moments and its most extreme distinct values with their
    counts; the test is stepped on those few numbers. If a column's extremes run out, the next ones
    are fetched, so the result is exact however many outliers there are.
    """
    moments = df.agg(
        *[F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(c) for c in cols]
    ).first()
    state = {}
    for c in cols:
        n = moments[c]["n"]
        if n:
            state[c] = [n, moments[c]["m"], moments[c]["v"] * n, -math.inf, math.inf]
    pending = [c for c in state if state[c][0] > 2]
    long = unpivot(df, [], cols)
    counts = value_counts(long, ["variable"], "value", {"cnt": F.count(F.lit(1))})
    partly = {c: {} for c in cols}  # copies already removed of a value at the edge
    while pending:
        inside = F.lit(False)
        for c in pending:
            inside = inside | (
                (F.col("variable") == c) & (F.col("value") > state[c][3]) & (F.col("value") < state[c][4])
            )
        group = Window.partitionBy("variable")
        open_rows = counts.filter(inside)
        low = open_rows.withColumn("rk", F.row_number().over(group.orderBy("value"))).filter(F.col("rk") <= extremes)
        high = open_rows.withColumn("rk", F.row_number().over(group.orderBy(F.desc("value")))).filter(F.col("rk") <= extremes)
        rows = low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high"))).collect()
        again = []
        for c in pending:
            ends, shared = {}, {}  # one [value, copies] entry per value, even if both ends list it
            for side in ("low", "high"):
                mine = sorted((r["rk"], r["value"], r["cnt"]) for r in rows if r["variable"] == c and r["side"] == side)
                ends[side] = [shared.setdefault(v, [v, k - partly[c].get(v, 0)]) for _, v, k in mine]
            before = {v: k for v, k in shared.values()}
            more = {side: len(e) == extremes for side, e in ends.items()}
            n, mean, m2, low_cut, high_cut, out_of = _trim(
                *state[c][:3], ends["low"], ends["high"], more["low"], more["high"], alpha
            )
            for v, left in shared.values():
                if 0 < left < before[v]:
                    partly[c][v] = partly[c].get(v, 0) + before[v] - left
            state[c] = [n, mean, m2, max(state[c][3], low_cut), min(state[c][4], high_cut)]
            if out_of:
                again.append(c)
        pending = again
    return {c: (s[3], s[4]) for c, s in state.items()}


def null_grubbs_outliers(df: DataFrame, cols: list[str], alpha: float = 0.05, extremes: int = 256) -> DataFrame:
    ranges = grubbs_ranges(df, cols, alpha, extremes)
    kept = {
        c: F.when((F.col(c) > F.lit(low)) & (F.col(c) < F.lit(high)), F.col(c)) for c, (low, high) in ranges.items()
    }
    return df.withColumns(kept) if kept else df
