"""Grouped summaries of panel variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import sample_excess_kurtosis, sample_skewness
from .ordering import exact_quantiles


def _per_column(df: DataFrame, cols: list[str], fields: dict) -> DataFrame:
    """One pass over all columns, one result row per column."""
    packed = [F.struct(F.lit(c).alias("variable"), *[f(c).alias(n) for n, f in fields.items()]) for c in cols]
    return df.agg(F.array(*packed).alias("a")).select(F.inline("a"))


def group_mean(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def group_median(df: DataFrame, keys: list[str], cols: list[str], rounded: bool = False) -> DataFrame:
    """Exact medians; `rounded` rounds halves to the even integer."""
    q = exact_quantiles(df, keys, cols, [0.5])
    m = F.get("q", F.lit(0))
    m = F.bround(m, 0) if rounded else m
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("variable") == c, m)).alias(c) for c in cols])


def group_count(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])


def group_nunique(df: DataFrame, keys: list[str], column: str, out: str = "n_unique", approximate: bool = False) -> DataFrame:
    """Distinct values per group; the exact form shuffles by (group, value) before counting."""
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.groupBy(*keys).agg(count.alias(out))


def frequency(df: DataFrame, cols: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def mean_sem(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("variance"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
    )


def skewed_columns(df: DataFrame, cols: list[str], above: float | None = 1.0) -> DataFrame:
    out = _per_column(df, cols, {"skewness": sample_skewness})
    return out if above is None else out.filter(F.col("skewness") > above)


def heavy_tailed_columns(df: DataFrame, cols: list[str], above: float | None = 2.0) -> DataFrame:
    out = _per_column(df, cols, {"kurtosis": sample_excess_kurtosis})
    return out if above is None else out.filter(F.col("kurtosis") > above)


def undefined_shape(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns whose kurtosis does not exist, with the usual reasons."""
    fields = {
        "kurtosis": sample_excess_kurtosis,
        "n_missing": lambda c: F.count_if(F.col(c).isNull()),
        "variance": F.var_samp,
        "constant": lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True)),
    }
    return _per_column(df, cols, fields).filter(F.col("kurtosis").isNull()).drop("kurtosis")


def quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float]) -> DataFrame:
    q = exact_quantiles(df, keys, cols, list(probs.values()))
    return q.select(*keys, "variable", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(probs)])


def box_summary(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return quantiles(df, keys, cols, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def null_share(df: DataFrame, cols: list[str]) -> DataFrame:
    return _per_column(df, cols, {"null_share": lambda c: F.avg(F.col(c).isNull().cast("int"))})


def observed_share(cols: list[str]) -> Column:
    """Aggregate: share of non-missing cells over all the columns."""
    seen = sum((F.count(c) for c in cols[1:]), F.count(cols[0]))
    return seen / (F.count(F.lit(1)) * len(cols))


def missing_kind(df: DataFrame, cols: list[str]) -> DataFrame:
    """Is a column all missing, or never missing?"""
    return _per_column(
        df,
        cols,
        {
            "all_missing": lambda c: (F.count(c) == 0).cast("int"),
            "never_missing": lambda c: (F.count(c) == F.count(F.lit(1))).cast("int"),
        },
    )


def at_least(df: DataFrame, unit: str, counted: str) -> DataFrame:
    """How many units have at least x distinct `counted` values, for each x that occurs."""
    per_unit = df.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.count_distinct(counted).alias("at_least"))
    histogram = per_unit.groupBy("at_least").agg(F.count(F.lit(1)).alias("n"))
    # one row per distinct count: small whatever the table size
    above = Window.orderBy(F.desc("at_least")).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.select("at_least", F.sum("n").over(above).alias("n"))


def subject_span(df: DataFrame, key: str = "num_id", day: str = "day", more_than: int = 20) -> DataFrame:
    span = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )
    return span.filter(F.col("n_rows") > more_than)


def cluster_profile(df: DataFrame, cluster: str, value: str, week: str = "week") -> DataFrame:
    mean, std = F.avg(value), F.stddev_samp(value)
    return df.groupBy(cluster, week).agg(
        mean.alias("mean"), (mean - std).alias("lower"), (mean + std).alias("upper")
    )


def histogram(df: DataFrame, x: str, bins: int, split_by: list[str] = (), measure: str | None = None) -> DataFrame:
    """Count (and sum of a measure) by equal-width bin of x, closed on the left, last bin closed."""
    edge = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
    width = (edge["hi"] - edge["lo"]) / bins
    place = F.least(F.floor(F.try_divide(F.col(x) - edge["lo"], width)), F.lit(bins - 1)) + 1
    rows = df.filter(F.col(x).isNotNull()).withColumn("bin", F.when(width > 0, place).otherwise(1).cast("int"))
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(measure).alias("total")] if measure else [])
    return rows.groupBy(*split_by, "bin").agg(*aggs)
