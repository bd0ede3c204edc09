"""Label encoding of categorical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordering import text_position


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 0; missing is its own last class.

    Only distinct values are ranked, in ranges of the whole value.
    """
    values = df.select(F.col(column).cast("string").alias("value")).distinct()
    known = values.filter(F.col("value").isNotNull())
    ranked = text_position(known, "value", out="_rank")
    total = known.agg(F.count(F.lit(1)).alias("n")).scalar()
    codes = ranked.select("value", (F.col("_rank") - 1).cast("bigint").alias("code"))
    missing = values.filter(F.col("value").isNull()).select("value", total.cast("bigint").alias("code"))
    return codes.unionByName(missing)


def label_encode(df: DataFrame, columns: list[str], suffix: str = "_code") -> DataFrame:
    out = df
    for c in columns:
        codes = label_codes(df, c).select(F.col("value").alias("_value"), F.col("code").alias(f"{c}{suffix}"))
        out = out.join(codes, F.col(c).cast("string").eqNullSafe(F.col("_value")), "left").drop("_value")
    return out


def label_decode(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """Codes (rounded) back to values."""
    back = codes.select(F.col("code").alias("_code"), F.col("value").alias(out))
    return df.join(back, F.bround(F.col(column), 0).cast("bigint") == F.col("_code"), "left").drop("_code")
