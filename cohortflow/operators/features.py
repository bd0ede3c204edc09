"""Wide per-subject features, reshaping and derived daily or weekly variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import safe_div, strict_slope
from ..functions.scores import truncate_to_int
from .ordering import exact_quantiles

# Name and inclusive week range of each wide statistic.
WIDE_AVERAGES = {"w1": (None, 1), "wu2": (None, 2), "wu4": (None, 4), "w4": (4, 4)}
WIDE_SLOPES = {"wu2": (None, 2), "wu4": (None, 4)}


def _weeks(low, high):
    test = F.col("week") <= high
    return test if low is None else test & (F.col("week") >= low)


def wide_features(df: DataFrame, cols: list[str], keep: list[str] = (), key: str = "num_id") -> DataFrame:
    """Averages and day slopes over week ranges, one row per subject.

    Every range is a conditional aggregate, so all variables share one partially combined shuffle.
    `keep` attributes are constant per subject.
    """
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in keep]
    for c in cols:
        for name, bounds in WIDE_AVERAGES.items():
            aggs.append(F.avg(F.when(_weeks(*bounds), F.col(c))).alias(f"{c}_avg_{name}"))
        for name, bounds in WIDE_SLOPES.items():
            aggs.append(strict_slope("day", c, _weeks(*bounds)).alias(f"{c}_slope_{name}"))
    return df.groupBy(key).agg(*aggs)


def truncate_flags(wide: DataFrame, flags: list[str]) -> DataFrame:
    """Averaged 0/1 flags back to whole classes."""
    names = [f"{f}_avg_{name}" for f in flags for name in WIDE_AVERAGES]
    return wide.withColumns({c: truncate_to_int(c) for c in names if c in wide.columns})


def label_wide(wide: DataFrame, clusters: DataFrame, flags: list[str], required: list[str] | None = None, key: str = "num_id") -> DataFrame:
    """Whole-number targets, complete rows only, cluster label attached."""
    labelled = truncate_flags(wide, flags).na.drop(subset=required)
    return labelled.join(clusters.dropDuplicates([key]), key, "inner")


def pivot_weeks(df: DataFrame, value: str, weeks: list[int], key: str = "num_id", fill: float | None = 0.0, prefix: str = "w") -> DataFrame:
    """Subject by week matrix of means; `fill=None` keeps missing weeks missing."""
    cells = [F.avg(F.when(F.col("week") == w, F.col(value))).alias(f"{prefix}{w}") for w in weeks]
    out = df.groupBy(key).agg(*cells)
    return out if fill is None else out.na.fill(fill, [f"{prefix}{w}" for w in weeks])


def melt(df: DataFrame, ids: list[str], values: list[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    return df.unpivot(ids, values, var_name, value_name)


def trajectory_matrix(df: DataFrame, value: str, weeks: list[int], key: str = "num_id", require_all: bool = True, fill: float | None = 0.0) -> DataFrame:
    """Weekly means of subjects seen in every required week, one column per week."""
    matrix = pivot_weeks(df.filter(F.col("week").isin(weeks)), value, weeks, key, fill=None)
    names = [f"w{w}" for w in weeks]
    if require_all:
        return matrix.na.drop(subset=names)
    return matrix if fill is None else matrix.na.fill(fill, names)


def week_coverage(df: DataFrame, cols: list[str], key: str = "num_id", week: str = "week") -> DataFrame:
    """Subjects seen per week, overall and per variable.

    One row per (week, subject) first, then a plain count: no distinct sets are held.
    """
    flags = [F.max(F.when(F.col(c).isNotNull(), 1).otherwise(0)).alias(c) for c in cols]
    per_subject = df.groupBy(week, key).agg(*flags)
    return per_subject.groupBy(week).agg(
        F.count(F.lit(1)).alias("subjects"), *[F.sum(c).alias(f"{c}_subjects") for c in cols]
    )


def missing_flags(df: DataFrame, cols: list[str], low: float = 0.0, high: float = 1.0, suffix: str = "_missing") -> DataFrame:
    """0/1 indicator columns for variables whose missing share lies in (low, high)."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    chosen = [c for c in cols if shares[c] is not None and low < shares[c] < high]
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in chosen})


def daily_stats(df: DataFrame, value: str, key: str = "num_id", time: str = "dt") -> DataFrame:
    """Mean, median, standard deviation, interquartile range and sum per subject and date."""
    rows = df.select(key, F.to_date(time).alias("dt"), F.col(value))
    plain = rows.groupBy(key, "dt").agg(
        F.avg(value).alias(f"{value}_mean"),
        F.stddev_samp(value).alias(f"{value}_std"),
        F.sum(value).alias(f"{value}_sum"),
    )
    spread = exact_quantiles(rows, [key, "dt"], [value], [0.25, 0.5, 0.75]).select(
        key, "dt", F.get("q", F.lit(1)).alias(f"{value}_median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias(f"{value}_IQR")
    )
    return plain.join(spread, [key, "dt"], "left")


def per_hour(df: DataFrame, cols: list[str], hours: str = "hours_accounted_for") -> DataFrame:
    return df.withColumns({f"{c}_hr": safe_div(c, hours) for c in cols})
