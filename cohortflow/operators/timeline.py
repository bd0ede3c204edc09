"""Operators along each subject's time axis.

Two grains. A *panel* has one row per (subject, date), so a subject's rows are bounded by the
calendar and one window partition per subject is safe. *Raw* readings are not bounded: one
subject or one day may hold a third of the table. Raw operators cut each group into time slots
(`slot`), work inside a slot, and pass only one summary row per slot between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from ..functions.numeric import strict_slope

DAY_SECONDS = 86_400


def micros(time: str | Column) -> Column:
    time = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(time.cast("timestamp"))


def time_slot(time: str, seconds: int) -> Column:
    """Order-preserving slot number of a timestamp or date."""
    return F.floor(micros(time) / F.lit(seconds * 1_000_000)).cast("bigint")


def with_group(df: DataFrame, keys: list[str], panel: bool = False, **aggs: Column) -> DataFrame:
    """Attach group aggregates.

    Raw rows: partial aggregation plus a join that can be split on hot keys, instead of a window
    that would gather each group. A panel's groups are bounded, so there one window does it, and
    later per-subject steps reuse its partitioning.
    """
    if panel:
        group = Window.partitionBy(*keys)
        return df.withColumns({name: a.over(group) for name, a in aggs.items()})
    stats = df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggs.items()])
    return df.join(stats, keys, "left")


def require_panel(df: DataFrame, key: str = "num_id", time: str = "dt") -> None:
    """Stop unless every (subject, date) occurs once: the bound that lets a subject be one group."""
    if not isinstance(df.schema[time].dataType, DateType):
        raise ValueError(f"{time} must be a date: collapse the readings of a day first")
    twice = df.groupBy(key, time).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    if not twice.isEmpty():
        raise ValueError(f"several rows share {key} and {time}: collapse them first")


def spread_subjects(df: DataFrame, key: str = "num_id") -> DataFrame:
    """A panel dealt by subject for heavy work per subject: few bytes, too, are work for all cores, so partitions are not joined."""
    spark = df.sparkSession
    # never the number of the shuffle before it: Spark would take both for the same one and join its partitions again
    spread = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) + 1)
    return df.repartition(spread, key)


def assign_week(df: DataFrame, key: str = "num_id", time: str = "dt", out: str = "week", panel: bool = False) -> DataFrame:
    """Whole 7-day blocks of 24 hours since the subject's first reading."""
    first = with_group(df, [key], panel, _first=F.min(time))
    elapsed = micros(time) - micros("_first")
    return first.withColumn(out, F.floor(elapsed / F.lit(7 * DAY_SECONDS * 1_000_000)).cast("int")).drop("_first")


def assign_day(df: DataFrame, key: str = "num_id", time: str = "dt", out: str = "day") -> DataFrame:
    """0-based position of each panel row in its subject's date order."""
    order = Window.partitionBy(key).orderBy(time)
    return df.withColumn(out, (F.row_number().over(order) - 1).cast("int"))


def to_date(df: DataFrame, time: str = "dt", out: str | None = None) -> DataFrame:
    return df.withColumn(out or time, F.to_date(time))


def _carry(rows: DataFrame, keys: list[str], order: list[str], cols: list[str], slot: Column | None):
    """Forward and backward fill columns `_f_c`, `_b_c` inside (keys, slot)."""
    part = [*keys, "_slot"]
    rows = rows.withColumn("_slot", slot if slot is not None else F.lit(0).cast("bigint"))
    ahead = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # reading the same order backwards is a frame, not a second sort
    behind = Window.partitionBy(*part).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(ahead) for c in cols})
    return rows.withColumns({f"_b_{c}": F.first(c, ignorenulls=True).over(behind) for c in cols})


def fill_forward_backward(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], slot: Column | None = None, backward_first: bool = False
) -> DataFrame:
    """Fill missing cells from the nearest earlier, then later, row of the group.

    `slot` (an order-preserving expression, e.g. `time_slot(time, 3600)`) splits large groups.
    """
    rows = _carry(df, keys, order, cols, slot)
    if slot is not None:
        summary = rows.groupBy(*keys, "_slot").agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_l_{c}") for c in cols],
            *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_e_{c}") for c in cols],
        )
        earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(1, Window.unboundedFollowing)
        edges = summary.select(
            *keys, "_slot",
            *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_pl_{c}") for c in cols],
            *[F.first(f"_e_{c}", ignorenulls=True).over(later).alias(f"_pe_{c}") for c in cols],
        )
        rows = rows.join(edges, [*keys, "_slot"], "left")
        ahead = {c: F.coalesce(f"_f_{c}", f"_pl_{c}") for c in cols}
        behind = {c: F.coalesce(f"_b_{c}", f"_pe_{c}") for c in cols}
    else:
        ahead = {c: F.col(f"_f_{c}") for c in cols}
        behind = {c: F.col(f"_b_{c}") for c in cols}
    pick = (lambda c: F.coalesce(behind[c], ahead[c])) if backward_first else (lambda c: F.coalesce(ahead[c], behind[c]))
    return rows.select(*[pick(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def collapse_same_period(
    df: DataFrame,
    numeric: list[str],
    other: list[str] = (),
    key: str = "num_id",
    time: str = "dt",
    tie: str = "event_id",
    grain: str = "day",
    slot_seconds: int = 3600,
) -> DataFrame:
    """One row per (subject, date) or (subject, week start): fill gaps inside the period forward,
    then backward, then average numbers and take the first of other columns.

    The fill weights each reading by the rows it covers. Each time slot reports the sum of its
    filled rows plus how many leading rows still wait for a value; the waiting rows get the last
    value of an earlier slot, or the period's first value. No period is gathered in one task.
    """
    period = F.to_date(time) if grain == "day" else F.to_date(F.date_trunc("week", time))
    rows = df.filter(F.col(time).isNotNull()).withColumn("_period", period).withColumn("_slot", time_slot(time, slot_seconds))
    order = [time, tie]
    ahead = (
        Window.partitionBy(key, "_period", "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(ahead) for c in numeric})
    at = F.struct(*order)
    per_slot = rows.groupBy(key, "_period", "_slot").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_f_{c}").alias(f"_s_{c}") for c in numeric],
        *[F.count_if(F.col(f"_f_{c}").isNull()).alias(f"_w_{c}") for c in numeric],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_l_{c}") for c in numeric],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_e_{c}") for c in [*numeric, *other]],
    )
    earlier = Window.partitionBy(key, "_period").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key, "_period").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_slot = per_slot.withColumns(
        {f"_c_{c}": F.last(f"_l_{c}", ignorenulls=True).over(earlier) for c in numeric}
    ).withColumns({f"_e_{c}": F.first(f"_e_{c}", ignorenulls=True).over(whole) for c in [*numeric, *other]})

    def total(c: str) -> Column:
        waiting = F.col(f"_w_{c}") * F.coalesce(f"_c_{c}", f"_e_{c}")
        return F.sum(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) + F.coalesce(waiting, F.lit(0.0)))

    return (
        per_slot.groupBy(key, F.col("_period").alias(time))
        .agg(
            *[F.when(F.max(f"_e_{c}").isNotNull(), total(c) / F.sum("_n")).alias(c) for c in numeric],
            *[F.max(f"_e_{c}").alias(c) for c in other],
        )
    )


def reindex_days(df: DataFrame, key: str = "num_id", time: str = "dt") -> DataFrame:
    """Every calendar date from each subject's first to last, then week and day numbers.

    On a complete calendar both numbers are date differences; no window is needed.
    """
    span = df.groupBy(key).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    grid = span.select(
        key, "_first", F.explode(F.sequence("_first", "_last", F.expr("interval 1 day"))).alias(time)
    )
    values = df.drop("week", "day")
    day = F.datediff(F.col(time), F.col("_first"))
    return (
        grid.join(values, [key, time], "left")
        .withColumn("week", F.floor(day / 7).cast("int"))
        .withColumn("day", day.cast("int"))
        .drop("_first")
    )


def interpolate_weeks(
    df: DataFrame, cols: list[str], threshold: float, key: str = "num_id", time: str = "dt", week: str = "week"
) -> DataFrame:
    """Add `<c>_int`: time-linear interpolation inside subject-weeks that are at least `threshold`
    percent (but not fully) observed; other weeks keep the original.

    Leading gaps stay, trailing gaps take the last value. A week of a panel has at most 7 rows.
    """
    whole = Window.partitionBy(key, week)
    back = whole.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    forth = whole.orderBy(time).rowsBetween(0, Window.unboundedFollowing)
    at = micros(time)
    out = df
    for c in cols:
        point = F.when(F.col(c).isNotNull(), F.struct(at.alias("t"), F.col(c).cast("double").alias("v")))
        out = out.withColumns(
            {
                f"_p_{c}": F.last(point, ignorenulls=True).over(back),
                f"_q_{c}": F.first(point, ignorenulls=True).over(forth),
                f"_share_{c}": F.count(c).over(whole) / F.count(F.lit(1)).over(whole) * 100,
            }
        )
    helpers = []
    for c in cols:
        p, q, share = F.col(f"_p_{c}"), F.col(f"_q_{c}"), F.col(f"_share_{c}")
        line = p["v"] + F.try_divide((q["v"] - p["v"]) * (at - p["t"]), q["t"] - p["t"])
        # no later point: carry the last value; no earlier point: stay missing
        inside = F.when(p.isNotNull() & q.isNull(), p["v"]).otherwise(line)
        eligible = (share >= threshold) & (share < 100)
        value = F.when(F.col(c).isNull() & eligible, inside).otherwise(F.col(c).cast("double"))
        out = out.withColumn(f"{c}_int", value)
        helpers += [f"_p_{c}", f"_q_{c}", f"_share_{c}"]
    return out.drop(*helpers)


def add_lag(
    df: DataFrame, cols: list[str], rows_lagged: int = -1, key: str = "num_id", order: list[str] = ("dt",), slot: Column | None = None
) -> DataFrame:
    """Add `<c>_lag<k>`: the value k rows earlier (k > 0) or later (k < 0) of the same subject.

    With `slot`, a subject is split into time slots and only the |k| edge rows of each slot travel.
    """
    k, order = abs(rows_lagged), list(order)
    direction = [F.asc(c) for c in order] if rows_lagged > 0 else [F.desc(c) for c in order]
    names = {c: f"{c}_lag{rows_lagged}" for c in cols}
    if k == 0:
        return df.withColumns({names[c]: F.col(c) for c in cols})
    if slot is None:
        w = Window.partitionBy(key).orderBy(*direction)
        return df.withColumns({names[c]: F.lag(c, k).over(w) for c in cols})

    part = Window.partitionBy(key, "_slot")
    w = part.orderBy(*direction)
    rows = df.withColumn("_slot", slot).withColumns(
        {
            **{names[c]: F.lag(c, k).over(w) for c in cols},
            "_rn": F.row_number().over(w),
            "_n": F.count(F.lit(1)).over(part),
        }
    )
    # the last k rows (in lag direction) of every slot: at most k per slot
    tails = rows.filter(F.col("_n") - F.col("_rn") < k).groupBy(key, "_slot").agg(
        F.sort_array(F.collect_list(F.struct("_rn", *cols))).alias("_tail")
    )
    slots = Window.partitionBy(key).orderBy(F.asc("_slot") if rows_lagged > 0 else F.desc("_slot")).rowsBetween(-k, -1)
    before = tails.select(key, "_slot", F.flatten(F.collect_list("_tail").over(slots)).alias("_before"))
    joined = rows.join(before, [key, "_slot"], "left")
    index = F.size("_before") - (F.lit(k) - F.col("_rn") + 1)
    edge = F.when(index >= 0, F.get("_before", index))
    picked = {names[c]: F.when(F.col("_rn") > k, F.col(names[c])).otherwise(edge[c]) for c in cols}
    return joined.withColumns(picked).select(*df.columns, *names.values())


def rmssd(df: DataFrame, cols: list[str], key: str = "num_id", order: list[str] = ("dt",), strict: bool = True) -> DataFrame:
    """Root mean square of successive differences per subject, 3 decimals.

    Strict: one undefined difference makes the result NULL; so does a single row.
    """
    stepped = add_lag(df, cols, 1, key, list(order))

    def one(c: str) -> Column:
        diff = F.col(c) - F.col(f"{c}_lag1")
        value = F.sqrt(F.avg(F.pow(diff, F.lit(2))))
        if strict:
            value = F.when((F.count(c) == F.count(F.lit(1))) & (F.count(F.lit(1)) >= 2), value)
        return F.round(value, 3).alias(f"{c}_rmssd")

    return stepped.groupBy(key).agg(*[one(c) for c in cols])


def slopes(df: DataFrame, cols: list[str], x: str = "day", keys: list[str] = ("num_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(*[strict_slope(x, c).alias(f"{c}_slope") for c in cols])


def person_centered(df: DataFrame, cols: list[str], key: str = "num_id", panel: bool = False) -> DataFrame:
    centred = with_group(df, [key], panel, **{f"_m_{c}": F.avg(c) for c in cols})
    return centred.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def subject_halves(df: DataFrame, key: str = "num_id", order: list[str] = ("dt",), min_rows: int = 30) -> DataFrame:
    """Mark each panel row as half 1 or 2 of its subject's rows; short subjects are left out."""
    group = Window.partitionBy(key)
    ranked = df.withColumns(
        {"_rn": F.row_number().over(group.orderBy(*order)), "_n": F.count(F.lit(1)).over(group)}
    ).filter(F.col("_n") >= min_rows)
    half = F.when(F.col("_rn") <= F.floor(F.col("_n") / 2), 1).otherwise(2)
    return ranked.withColumn("half", half.cast("int")).drop("_rn", "_n")


def subject_fill(df: DataFrame, cols: list[str], key: str = "num_id", order: list[str] = ("dt",)) -> DataFrame:
    """Backward, then forward fill of subject-level attributes."""
    return fill_forward_backward(df, [key], list(order), cols, backward_first=True)
