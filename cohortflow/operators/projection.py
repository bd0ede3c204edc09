"""Column selection, coercion and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType


def select_matching(df: DataFrame, contains=None, prefix=None, suffix=None, keep=(), drop: bool = False) -> DataFrame:
    """Keep (or drop) columns by a literal piece of their name; `keep` columns always stay."""

    def hit(name: str) -> bool:
        return (
            (contains is not None and contains in name)
            or (prefix is not None and name.startswith(prefix))
            or (suffix is not None and name.endswith(suffix))
        )

    return df.select(*[c for c in df.columns if c in keep or hit(c) != drop])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def strip_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c[: -len(suffix)] for c in df.columns if c.endswith(suffix)})


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; values that do not parse become NULL instead of failing the job."""

    def cast(name: str, kind: str) -> Column:
        return F.try_to_timestamp(F.col(name)) if kind == "timestamp" else F.col(name).try_cast(kind)

    return df.withColumns({name: cast(name, kind) for name, kind in types.items()})


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=subset)


def in_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    tests = [F.lit(True)]
    if low is not None:
        tests.append(F.col(column) >= low)
    if high is not None:
        tests.append(F.col(column) <= high)
    return df.filter(reduce(lambda a, b: a & b, tests))


def keep_subjects_with_rows(df: DataFrame, at_least: int, key: str = "num_id") -> DataFrame:
    """Counts combine before the shuffle and the filter is a semi-join, so no subject is gathered."""
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least).select(key)
    return df.join(large, key, "left_semi")


def keep_complete_weeks(df: DataFrame, value: str, weeks: list[int], key: str = "num_id", week: str = "week") -> DataFrame:
    """Rows of subjects with a value in every required week."""
    seen = [F.max(F.when((F.col(week) == w) & F.col(value).isNotNull(), 1)).alias(f"_w{i}") for i, w in enumerate(weeks)]
    full = df.groupBy(key).agg(*seen).na.drop("any").select(key)
    return df.join(full, key, "left_semi")


def varying_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with more than one distinct value: `min < max`, one pass, no distinct sets."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def drop_constant(df: DataFrame, cols: list[str]) -> DataFrame:
    kept = varying_columns(df, cols)
    return df.drop(*[c for c in cols if c not in kept])


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
