"""Query registry: a Spark callable and, where SQL can state it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; + 0.0 turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = (DoubleType, FloatType)
    return df.select(
        *[r6(f.name, digits).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields]
    )


def sql_round(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)
