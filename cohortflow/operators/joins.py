"""Joins of the panel with its dimension tables. Large equi-joins are left to adaptive planning:
broadcast only below the checked size limit, hot keys split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return left.join(right, keys, how)


def keep_labelled(df: DataFrame, clusters: DataFrame, key: str = "num_id") -> DataFrame:
    """Rows of subjects that appear in the cluster map."""
    return df.join(clusters, key, "left_semi")


def coalesce_columns(df: DataFrame, out: str, *cols: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(*cols))


def join_baseline(spine: DataFrame, tables: list[DataFrame], key: str = "num_id") -> DataFrame:
    """Star join of baseline tables, duplicates removed once at the end."""
    out = spine
    for t in tables:
        out = out.join(t, key, "left")
    return out.dropDuplicates()


def outer_join_all(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of feature tables with one shuffle of their union instead of a join chain:
    each table adds its columns to a common schema and one grouped aggregate brings rows together.

    Needs at most one row per key in every table.
    """
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    values = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])
