"""Operators along the time axis, splits by order and subject."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits, timeline
from ..operators.joins import join_on
from . import fixtures as fx
from .registry import query, r6, round_doubles, sql_round


@query(
    "ts_week",
    """SELECT event_id, user_id AS num_id, CAST(floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 604800000000.0) AS INT) AS week FROM events""",
)
def ts_week(spark, folder):
    return timeline.assign_week(fx.sensor_raw(spark, folder)).select("event_id", "num_id", "week")


@query("ts_day", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, dt, day FROM sensor_day")
def ts_day(spark, folder):
    return timeline.assign_day(fx.sensor_day(spark, folder).select("num_id", "dt"))


@query("ts_date", "SELECT event_id, CAST(ts AS DATE) AS dt FROM events")
def ts_date(spark, folder):
    return timeline.to_date(fx.sensor_raw(spark, folder).select("event_id", "dt"))


def _fill(c, part):
    w = f"PARTITION BY {part} ORDER BY dt, event_id"
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""


_FILLED = "filled AS (SELECT num_id, dt, event_id, event_type, " + ", ".join(_fill(c, "num_id, CAST(dt AS DATE)") for c in fx.SENSORS) + " FROM sensor_raw)"


@query("ts_ffill_bfill", fx.with_views(fx.SENSOR_RAW, _FILLED) + f"SELECT num_id, event_id, {', '.join(fx.SENSORS)} FROM filled")
def ts_ffill_bfill(spark, folder):
    raw = fx.sensor_raw(spark, folder).withColumn("date", F.to_date("dt"))
    filled = timeline.fill_forward_backward(
        raw, ["num_id", "date"], ["dt", "event_id"], fx.SENSORS, slot=timeline.time_slot("dt", 3600)
    )
    return filled.select("num_id", "event_id", *fx.SENSORS)


_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in fx.SENSORS)


@query(
    "ts_same_day",
    fx.with_views(fx.SENSOR_RAW, _FILLED)
    + f"SELECT num_id, CAST(dt AS DATE) AS dt, {_MEANS}, arg_min(event_type, (dt, event_id)) AS event_type FROM filled GROUP BY 1, 2",
)
def ts_same_day(spark, folder):
    raw = fx.sensor_raw(spark, folder)
    return round_doubles(timeline.collapse_same_period(raw, fx.SENSORS, ["event_type"]))


_FILLED_WEEK = "filled AS (SELECT num_id, dt, event_id, event_type, " + ", ".join(_fill(c, "num_id, date_trunc('week', dt)") for c in fx.SENSORS) + " FROM sensor_raw)"


@query(
    "ts_same_week",
    fx.with_views(fx.SENSOR_RAW, _FILLED_WEEK)
    + f"SELECT num_id, CAST(date_trunc('week', dt) AS DATE) AS dt, {_MEANS} FROM filled GROUP BY 1, 2",
)
def ts_same_week(spark, folder):
    return round_doubles(timeline.collapse_same_period(fx.sensor_raw(spark, folder), fx.SENSORS, grain="week"))


@query("imp_weekly", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, week, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in [*fx.SENSORS, "all_mean"]) + " FROM sensor_day GROUP BY 1, 2")
def imp_weekly(spark, folder):
    cols = [*fx.SENSORS, "all_mean"]
    return round_doubles(fx.sensor_day(spark, folder).groupBy("num_id", "week").agg(*[F.avg(c).alias(c) for c in cols]))


@query("ts_reindex", fx.with_views(fx.SENSOR_GRID) + f"SELECT num_id, dt, week, day, {sql_round('all_mean', 'n_events')} FROM sensor_grid")
def ts_reindex(spark, folder):
    return round_doubles(fx.sensor_grid(spark, folder).select("num_id", "dt", "week", "day", "all_mean", "n_events"))


def _interp(c, pct):
    w = "PARTITION BY num_id, week ORDER BY dt"
    return f"""interp_{pct} AS (
      SELECT num_id, dt, week, {c}, count({c}) OVER (PARTITION BY num_id, week) * 100.0 / count(*) OVER (PARTITION BY num_id, week) AS share,
        last_value(CASE WHEN {c} IS NOT NULL THEN dt END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d0,
        last_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
        first_value(CASE WHEN {c} IS NOT NULL THEN dt END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d1,
        first_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
      FROM sensor_grid)"""


def _interp_sql(c, pct):
    return fx.with_views(fx.SENSOR_GRID, _interp(c, pct)) + f"""SELECT num_id, dt, week, round(CASE WHEN {c} IS NULL AND share >= {pct} AND share < 100
      THEN CASE WHEN d0 IS NOT NULL AND d1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (dt - d0) / (d1 - d0) END ELSE {c} END, 6) AS {c}_int FROM interp_{pct}"""


@query("ts_interp", _interp_sql("v_click", 40))
def ts_interp(spark, folder):
    grid = timeline.interpolate_weeks(fx.sensor_grid(spark, folder).select("num_id", "dt", "week", "v_click"), ["v_click"], 40)
    return round_doubles(grid.select("num_id", "dt", "week", "v_click_int"))


@query("ts_interp_70", _interp_sql("all_mean", 70))
def ts_interp_70(spark, folder):
    grid = timeline.interpolate_weeks(fx.sensor_grid(spark, folder).select("num_id", "dt", "week", "all_mean"), ["all_mean"], 70)
    return round_doubles(grid.select("num_id", "dt", "week", "all_mean_int"))


@query(
    "ts_lag",
    fx.with_views(fx.SENSOR_DAY)
    + 'SELECT num_id, dt, round(lead(all_mean) OVER w, 6) AS "all_mean_lag-1", round(lead(v_click) OVER w, 6) AS "v_click_lag-1" FROM sensor_day WINDOW w AS (PARTITION BY num_id ORDER BY dt)',
)
def ts_lag(spark, folder):
    day = timeline.add_lag(fx.sensor_day(spark, folder), ["all_mean", "v_click"], -1)
    return round_doubles(day.select("num_id", "dt", "all_mean_lag-1", "v_click_lag-1"))


@query(
    "ts_lag_raw",
    "SELECT l_orderkey, l_linenumber, l_suppkey AS num_id, lag(l_quantity, 3) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS quantity_lag3 FROM lineitem",
)
def ts_lag_raw(spark, folder):
    rows = fx.lineitem(spark, folder).select("num_id", "dt", "l_orderkey", "l_linenumber", "l_partkey", "quantity")
    lagged = timeline.add_lag(
        rows, ["quantity"], 3, order=["dt", "l_orderkey", "l_linenumber", "l_partkey"], slot=timeline.time_slot("dt", 30 * timeline.DAY_SECONDS)
    )
    return lagged.select("l_orderkey", "l_linenumber", "num_id", "quantity_lag3")


@query(
    "md_forecast_target",
    fx.with_views(fx.SENSOR_DAY, fx.SURVEY_WEEK, "t AS (SELECT num_id, week, lead(phq9_1) OVER (PARTITION BY num_id ORDER BY dt) AS nxt FROM survey_week)")
    + 'SELECT d.num_id, d.dt, round(d.all_mean, 6) AS all_mean, nxt AS "phq9_1_lag-1" FROM sensor_day d JOIN t ON d.num_id = t.num_id AND d.week = t.week WHERE nxt IS NOT NULL',
)
def md_forecast_target(spark, folder):
    target = timeline.add_lag(fx.survey_week(spark, folder).select("num_id", "week", "dt", "phq9_1"), ["phq9_1"], -1)
    target = target.select("num_id", "week", "phq9_1_lag-1").na.drop()
    day = fx.sensor_day(spark, folder).select("num_id", "week", "dt", "all_mean")
    return round_doubles(join_on(day, target, ["num_id", "week"], "inner").drop("week"))


_STEP = "step AS (SELECT num_id, all_mean, v_click, all_mean - lag(all_mean) OVER w AS da, v_click - lag(v_click) OVER w AS dc FROM sensor_day WINDOW w AS (PARTITION BY num_id ORDER BY dt))"


@query(
    "ts_rmssd",
    fx.with_views(fx.SENSOR_DAY, _STEP)
    + """SELECT num_id, CASE WHEN count(all_mean) = count(*) AND count(*) >= 2 THEN round(sqrt(avg(da * da)), 3) END AS all_mean_rmssd,
      CASE WHEN count(v_click) = count(*) AND count(*) >= 2 THEN round(sqrt(avg(dc * dc)), 3) END AS v_click_rmssd FROM step GROUP BY 1""",
)
def ts_rmssd(spark, folder):
    return timeline.rmssd(fx.sensor_day(spark, folder), ["all_mean", "v_click"])


@query(
    "ts_slope",
    fx.with_views(fx.SENSOR_DAY)
    + """SELECT num_id, CASE WHEN count(all_mean) = count(*) AND count(*) >= 2 THEN round(regr_slope(all_mean, day), 6) + 0.0 END AS all_mean_slope,
      CASE WHEN count(v_view) = count(*) AND count(*) >= 2 THEN round(regr_slope(v_view, day), 6) + 0.0 END AS v_view_slope FROM sensor_day GROUP BY 1""",
)
def ts_slope(spark, folder):
    return round_doubles(timeline.slopes(fx.sensor_day(spark, folder), ["all_mean", "v_view"]))


@query("ts_center", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, dt, round(all_mean - avg(all_mean) OVER (PARTITION BY num_id), 8) + 0.0 AS all_mean FROM sensor_day")
def ts_center(spark, folder):
    return round_doubles(timeline.person_centered(fx.sensor_day(spark, folder).select("num_id", "dt", "all_mean"), ["all_mean"], panel=True), 8)


@query(
    "ts_halves",
    fx.with_views(fx.SENSOR_DAY, "r AS (SELECT num_id, dt, row_number() OVER (PARTITION BY num_id ORDER BY dt) AS rn, count(*) OVER (PARTITION BY num_id) AS n FROM sensor_day)")
    + "SELECT num_id, dt, CASE WHEN rn <= n // 2 THEN 1 ELSE 2 END AS half FROM r WHERE n >= 25",
)
def ts_halves(spark, folder):
    return timeline.subject_halves(fx.sensor_day(spark, folder).select("num_id", "dt"), min_rows=25)


_SUBJ = "PARTITION BY num_id ORDER BY dt"


@query(
    "ts_subject_fill",
    fx.with_views(fx.SENSOR_DAY)
    + f"""SELECT num_id, dt, round(coalesce(first_value(v_signup IGNORE NULLS) OVER ({_SUBJ} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      last_value(v_signup IGNORE NULLS) OVER ({_SUBJ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS v_signup FROM sensor_day""",
)
def ts_subject_fill(spark, folder):
    return round_doubles(timeline.subject_fill(fx.sensor_day(spark, folder).select("num_id", "dt", "v_signup"), ["v_signup"]))


@query(
    "ts_tail",
    fx.with_views(fx.SENSOR_DAY)
    + "SELECT num_id, dt, CAST(row_number() OVER (ORDER BY dt, num_id) > count(*) OVER () - floor(count(*) OVER () * 0.2) AS INT) AS holdout FROM sensor_day",
)
def ts_tail(spark, folder):
    return splits.tail_holdout(fx.sensor_day(spark, folder).select("num_id", "dt"), "dt", "num_id", share=0.2)


@query(
    "st_first_subjects",
    fx.with_views(fx.SENSOR_DAY, "ok AS (SELECT num_id FROM sensor_day GROUP BY 1 HAVING count(*) > 8 ORDER BY 1 LIMIT 7)")
    + "SELECT num_id, dt FROM sensor_day WHERE num_id IN (SELECT num_id FROM ok)",
)
def st_first_subjects(spark, folder):
    return splits.first_subjects(fx.sensor_day(spark, folder).select("num_id", "dt"), 7)


@query("sp_positional", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY value, event_id) <= 2500 THEN 'first' ELSE 'rest' END AS split FROM events")
def sp_positional(spark, folder):
    rows = fx.table(spark, folder, "events").select("event_id", "value")
    return splits.positional_split(rows, 2500, "value", "event_id").select("event_id", "split")


@query(
    "sp_day_window",
    fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, dt, CASE WHEN day BETWEEN 0 AND 15 THEN 'train' ELSE 'val' END AS split FROM sensor_day WHERE day BETWEEN 0 AND 15 OR day BETWEEN 20 AND 30",
)
def sp_day_window(spark, folder):
    rows = fx.sensor_day(spark, folder).select("num_id", "dt", "day")
    return splits.day_window_split(rows, (0, 15), (20, 30)).drop("day")


_SPLIT_SIZES = """SELECT CASE s WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split,
  CAST(CASE s WHEN 1 THEN ceil({t} * n) WHEN 2 THEN ceil({v} * (n - ceil({t} * n))) ELSE n - ceil({t} * n) - ceil({v} * (n - ceil({t} * n))) END AS BIGINT) AS size
  FROM n, (VALUES (1), (2), (3)) v(s)"""


@query("sp_group", "WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events) " + _SPLIT_SIZES.format(t=0.15, v=0.2))
def sp_group(spark, folder):
    """Subjects per split; a subject that crossed splits would be counted twice."""
    tagged = splits.group_split(fx.sensor_day(spark, folder).select("num_id", "dt"))
    return tagged.groupBy("split").agg(F.count_distinct("num_id").alias("size"))


@query("sp_random", "WITH n AS (SELECT count(*) AS n FROM lineitem) " + _SPLIT_SIZES.format(t=0.2, v=0.15))
def sp_random(spark, folder):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    rows = fx.table(spark, folder, "lineitem").select(*keys)
    return splits.random_split(rows, keys).groupBy("split").agg(F.count(F.lit(1)).alias("size"))


@query("sp_kfold")
def sp_kfold(spark, folder):
    rows = splits.kfold(fx.sensor_day(spark, folder).select("num_id", "dt"), ["num_id", "dt"], 5)
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
