"""Train, validation and test splits that are stable, exact in size and free of subject leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordering import below_cut, global_position, hash_cut, position


def _three_way(df: DataFrame, pool: DataFrame, keys: list[str], test: float, val: float, seed: int) -> DataFrame:
    """Exactly ceil(test * n) keys to test, then ceil(val * rest) to validation, by hash order."""
    h = F.xxhash64(*keys, F.lit(seed))
    n = F.col("total")
    n_test = F.ceil(F.lit(test) * n)
    in_test = below_cut(h, keys, hash_cut(pool, h, keys, n_test))
    in_val = below_cut(h, keys, hash_cut(pool, h, keys, n_test + F.ceil(F.lit(val) * (n - n_test))))
    return df.withColumn("split", F.when(in_test, "test").when(in_val, "val").otherwise("train"))


def group_split(df: DataFrame, key: str = "num_id", test: float = 0.15, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole subjects per split; only distinct ids are ranked and rows are tagged in place."""
    return _three_way(df, df.select(key).distinct(), [key], test, val, seed)


def random_split(df: DataFrame, keys: list[str], test: float = 0.2, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Row split by the hash of a unique row key: the same rows whatever the partitioning."""
    return _three_way(df, df, keys, test, val, seed)


def positional_split(df: DataFrame, n_first: int, order: str, tie: str) -> DataFrame:
    """The first n rows in a stated order, and the rest."""
    placed = position(df, [], order, [tie])
    return placed.withColumn("split", F.when(F.col("position") <= n_first, "first").otherwise("rest")).drop("position")


def kfold(df: DataFrame, keys: list[str], folds: int = 5, seed: int = 40, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(folds)).cast("int"))


def day_window_split(df: DataFrame, train: tuple[int, int] = (0, 50), val: tuple[int, int] = (61, 80), day: str = "day") -> DataFrame:
    label = F.when(F.col(day).between(*train), "train").when(F.col(day).between(*val), "val")
    return df.withColumn("split", label).filter(F.col("split").isNotNull())


def tail_holdout(df: DataFrame, date: str, tie: str, share: float | None = None, rows: int | None = None) -> DataFrame:
    """Flag the last rows in (date, tie) order as the hold-out."""
    placed = global_position(df, date, tie)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.lit(rows).cast("bigint") if rows is not None else F.floor(total * F.lit(share))
    return placed.withColumn("holdout", (F.col("position") > total - size).cast("int")).drop("position")


def first_subjects(df: DataFrame, k: int, more_than: int = 8, key: str = "num_id") -> DataFrame:
    """Rows of the k smallest subject ids that have more than `more_than` rows."""
    ids = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > more_than)
    return df.join(ids.orderBy(key).limit(k).select(key), key, "left_semi")
