"""Exact ordered computations whose groups may be far larger than one task.

A plain window sorts each group in one task. Here a group with more than `split_rows`
ordered values is cut into value ranges: approximate quantiles give the cut points (they steer
balance only, never the result), every range is summed in its own task, and range totals
are added up. Groups below the limit stay one window partition. Rows are pre-aggregated to
one row per distinct value first, so a value that repeats in a third of the table is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..session import cut_lineage

SPLIT_ROWS = 1_000_000
_ALL = "_all"


def _search_steps(size: int) -> list[int]:
    step = 1
    while step * 2 <= size:
        step *= 2
    steps = []
    while step:
        steps.append(step)
        step //= 2
    return steps


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: list[str],
    tie_order: list[str] | None = None,
    split_rows: int = SPLIT_ROWS,
    ranges: int | None = None,
) -> DataFrame:
    """Add `before_<m>`: sum of m over earlier rows of the group, in `order`, then `tie_order`.

    `order` must be numeric, date or timestamp and (with `tie_order`) unique within a group. A value of `order` that more
    than `split_rows` rows share stands as one row among the values; its own rows are ordered by `tie_order` as a group of
    their own, which is cut into ranges in turn (where the first of `tie_order` can be).
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rangeable = (NumericType, DateType, TimestampType, TimestampNTZType)
    if not tie_order or not isinstance(kinds.get(tie_order[0]), rangeable):
        return _totals_by_range(df, keys, order, measures, tie_order, split_rows, ranges)
    group = [*keys, order]
    names = [f"_h{i}" for i in range(len(group))]
    heavy = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(m).alias(f"_s_{m}") for m in measures]).filter(F.col("_rows") > split_rows)
    heavy = heavy.select(*[F.col(c).alias(n) for c, n in zip(group, names)], *[f"_s_{m}" for m in measures])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names)]
    light = df.join(heavy.select(*names), same, "left_anti")
    stand_in = heavy.select(
        *[F.col(n).alias(c) for c, n in zip(group, names)], *[F.col(f"_s_{m}").alias(m) for m in measures], F.lit(True).alias("_stands")
    )
    every = light.withColumn("_stands", F.lit(False)).unionByName(stand_in, allowMissingColumns=True)
    outer = _totals_by_range(every, keys, order, measures, tie_order, split_rows, ranges)
    columns = [*df.columns, *[f"before_{m}" for m in measures]]
    done = outer.filter(~F.col("_stands")).select(*columns)
    inner = running_totals(df.join(heavy.select(*names), same, "left_semi"), group, tie_order[0], measures, tie_order[1:], split_rows, ranges)
    starts = outer.filter("_stands").select(*[F.col(c).alias(n) for c, n in zip(group, names)], *[F.col(f"before_{m}").alias(f"_b_{m}") for m in measures])
    shifted = inner.join(starts, same).select(*df.columns, *[(F.col(f"before_{m}") + F.col(f"_b_{m}")).alias(f"before_{m}") for m in measures])
    return done.unionByName(shifted)


def _totals_by_range(
    df: DataFrame, keys: list[str], order: str, measures: list[str], tie_order: list[str] | None, split_rows: int, ranges: int | None
) -> DataFrame:
    spark = df.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = df.columns
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn(_ALL, F.lit(0)), [_ALL]
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    on_keys = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]

    # the size test reads every column, so that all branches below share one shuffled input
    touched = F.lit(True)
    for m in [order, *measures]:
        touched = touched & F.max(m).isNotNull()
    large = (F.count(F.lit(1)) > split_rows) & touched
    oversized = df.groupBy(*keys).agg(large.alias("_large")).filter("_large").select(*renamed)
    points = [i / ranges for i in range(1, ranges)]
    cuts = (
        df.join(oversized, on_keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(order, points, max(10_000, 20 * ranges)).alias("_cuts"), touched.alias("_ok"))
        .filter("_ok")
        .select(*renamed, "_cuts")
    )
    steps = F.array(*[F.lit(s) for s in _search_steps(len(points))])
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= F.size("_cuts")) & (F.get(F.col("_cuts"), at + s - 1) < F.col(order)), at + s
        ).otherwise(at),
    )
    ranged = df.join(cuts, on_keys, "left").select(
        *df.columns,
        F.col("_cuts").isNotNull().alias("_split"),
        F.when(F.col("_cuts").isNotNull(), place).otherwise(0).alias("_range"),
    )
    inner = Window.partitionBy(*keys, "_range").orderBy(order, *(tie_order or []))
    inner = inner.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns(
        {f"before_{m}": F.coalesce(F.sum(m).over(inner), F.lit(0)) for m in measures}
    )
    # range totals exist for split groups only: at most `ranges` rows for each of them
    totals = ranged.filter("_split").groupBy(*keys, "_range").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    outer = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *renamed,
        F.col("_range").alias("_kr"),
        *[F.coalesce(F.sum(f"_t_{m}").over(outer), F.lit(0)).alias(f"_o_{m}") for m in measures],
    )
    joined = local.join(offsets, [*on_keys, F.col("_range") == F.col("_kr")], "left")
    return joined.select(
        *columns,
        *[(F.col(f"before_{m}") + F.coalesce(F.col(f"_o_{m}"), F.lit(0))).alias(f"before_{m}") for m in measures],
    )


def position(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie_order: list[str] | None = None,
    out: str = "position",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """1-based row number within `keys`, without sorting a large group in one task."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(one, keys, order, ["_one"], tie_order, split_rows)
    return ranked.withColumn(out, F.col("before__one") + 1).drop("_one", "before__one")


def text_position(df: DataFrame, column: str, out: str = "position") -> DataFrame:
    """1-based position of distinct texts in byte order over the whole table.

    Rows are dealt into ranges of the column and sorted there; a row's position is its place in its range after the
    rows of all ranges before. Written once, so that places and counts come from the same ranges.
    """
    ranged = df.repartitionByRange(column).sortWithinPartitions(column)
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = cut_lineage(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    return placed.join(offsets, "_part").withColumn(out, F.col("_at") + F.col("_o") + 1).drop("_part", "_at", "_o")


def value_counts(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per distinct non-null value of a group; combines on the map side."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[m.alias(name) for name, m in measures.items()]
    )


def unpivot(df: DataFrame, keys: list[str], cols: list[str], var: str = "variable", val: str = "value") -> DataFrame:
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot(keys, cols, var, val)


def exact_quantiles(
    df: DataFrame, keys: list[str], cols: list[str], probs: list[float], split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Linear-interpolated quantiles, one row per (keys, variable) with an array column `q`.

    Groups of any size: the two neighbouring order statistics are found by running counts over
    distinct values instead of collecting the group.
    """
    long = unpivot(df, keys, cols)
    group = [*keys, "variable"]
    counts = value_counts(long, group, "value", {"cnt": F.count(F.lit(1))})
    ranked = running_totals(counts, group, "value", ["cnt"], split_rows=split_rows)
    size = counts.groupBy(*group).agg(F.sum("cnt").alias("_n"))
    size = size.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(group)], "_n")
    rows = ranked.join(size, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(group)])

    aggs = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("before_cnt") <= rank) & (rank < F.col("before_cnt") + F.col("cnt"))
            aggs.append(F.max(F.when(holds, F.col("value"))).alias(f"_{name}{i}"))
    found = rows.groupBy(*group).agg(F.max("_n").alias("_n"), *aggs)
    quantile = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        quantile.append(lo + (hi - lo) * (at - F.floor(at)))
    return found.select(*group, F.array(*quantile).alias("q"))


def global_position(df: DataFrame, date: str, tie: str, out: str = "position") -> DataFrame:
    """1-based position in (date, tie) order over the whole table.

    Dates are few; rows of one date are ranked as a group that may be split, and each date adds
    the number of rows of all earlier dates.
    """
    ranked = position(df, [date], tie, out="_in_date")
    per_date = df.groupBy(date).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_date.select(date, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    return ranked.join(offsets, date, "left").withColumn(out, F.col("_in_date") + F.col("_o")).drop("_in_date", "_o")


def hash_cut(df: DataFrame, hashed: Column, ties: list[str], count: Column) -> Column:
    """Scalar (hash, ties) of the `count`-th smallest hash; `count` may use the aggregate column
    `total`, the number of rows.

    Hash values are uniform, so their leading 16 bits cut the table into equal slices: a
    65,536-row histogram finds the slice that holds the cut and only that slice is ranked.
    """
    rows = df.select(hashed.alias("_h"), *ties).withColumn("_slice", F.shiftright("_h", 48).cast("int"))
    histogram = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    marks = histogram.withColumns(
        {"_before": F.coalesce(F.sum("_c").over(upto), F.lit(0)), "total": F.sum("_c").over(whole)}
    ).withColumn("_k", F.least(count.cast("bigint"), F.col("total")))
    holds = (F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_c"))
    cut = marks.filter(holds).agg(
        F.struct(F.max("_slice").alias("slice"), F.max(F.col("_k") - F.col("_before")).alias("rest")).alias("c")
    )
    inside = rows.withColumn("_cut", cut.scalar()).filter(F.col("_slice") == F.col("_cut.slice"))
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_h", *ties))
    last = inside.withColumn("_rk", rank).filter(F.col("_rk") == F.col("_cut.rest"))
    return last.agg(F.max(F.struct("_h", *ties)).alias("c")).scalar()


def below_cut(hashed: Column, ties: list[str], cut: Column) -> Column:
    """True for exactly the rows at or below a `hash_cut`."""
    return F.coalesce(F.struct(hashed.alias("_h"), *ties) <= cut, F.lit(False))
