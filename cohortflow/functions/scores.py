"""Survey score categories, clinical flags and binning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .numeric import col

# Inclusive score bands and their category. The first band that holds wins;
# scores in no band (fractions between bands, negatives, above the top) are NULL.
ALCOHOL_BANDS = [(0, 0, 0), (1, 3, 1), (4, 6, 2), (7, None, 3)]
GAD_BANDS = [(0, 5, 0), (5, 10, 1), (11, 15, 2), (16, None, 3)]
PHQ9_BANDS = [(0, 4, 0), (5, 9, 1), (10, 14, 2), (15, 19, 3), (20, 27, 4)]
PHQ9_BINARY_BANDS = [(0, 9, 0), (10, None, 1)]
PHQ2_BINARY_BANDS = [(0, 2, 0), (3, None, 1)]


def banded(value, bands) -> Column:
    value = col(value)
    tests = [
        F.when(value >= low if high is None else value.between(low, high), F.lit(category))
        for low, high, category in bands
    ]
    return F.coalesce(*tests)


def cat_alc(value) -> Column:
    return banded(value, ALCOHOL_BANDS)


def cat_gad(value) -> Column:
    return banded(value, GAD_BANDS)


def cat_phq9(value) -> Column:
    return banded(value, PHQ9_BANDS)


def bin_phq9(value) -> Column:
    return banded(value, PHQ9_BINARY_BANDS)


def bin_phq2(value) -> Column:
    return banded(value, PHQ2_BINARY_BANDS)


def bin_threshold(value, threshold: float = 0.3) -> Column:
    return F.coalesce((col(value) > threshold).cast("int"), F.lit(0))


def clinical_flag(limits: dict[str, float]) -> Column:
    """1 where any named score exceeds its limit; a missing score never does."""
    tests = [F.coalesce(F.col(c) > limit, F.lit(False)) for c, limit in limits.items()]
    return reduce(lambda a, b: a | b, tests).cast("int")


def truncate_to_int(value) -> Column:
    return col(value).cast("int")


def cut_equal_width(df: DataFrame, column: str, bins: int = 5, out: str | None = None) -> DataFrame:
    """Right-closed equal-width bins 1..bins over the whole column's range."""
    edges = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("edges")).scalar()
    x, lo, width = F.col(column), edges["lo"], (edges["hi"] - edges["lo"]) / bins
    # a column with one value has no width: everything sits in the middle bin
    inside = F.least(F.greatest(F.ceil(F.try_divide(x - lo, width)), F.lit(1)), F.lit(bins))
    number = F.when(width > 0, inside).otherwise((bins + 1) // 2)
    return df.withColumn(out or f"{column}_bin", F.when(x.isNotNull(), number).cast("int"))
