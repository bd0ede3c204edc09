"""Wide features, reshaping and derived variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numeric import row_sum
from ..operators import features
from ..operators.projection import keep_complete_weeks
from . import fixtures as fx
from .registry import query, r6, round_doubles, sql_round

VALUES = [*fx.SENSORS, *fx.DENSE]


def _wide_sql(cols, source):
    parts = []
    for c in cols:
        for name, cond in (("w1", "week <= 1"), ("wu2", "week <= 2"), ("wu4", "week <= 4"), ("w4", "week = 4")):
            parts.append(f"round(avg({c}) FILTER ({cond}), 6) + 0.0 AS {c}_avg_{name}")
        for name, cond in (("wu2", "week <= 2"), ("wu4", "week <= 4")):
            parts.append(
                f"""CASE WHEN count({c}) FILTER ({cond}) = count(*) FILTER ({cond}) AND count(*) FILTER ({cond}) >= 2
                THEN round(regr_slope({c}, day) FILTER ({cond}), 6) + 0.0 END AS {c}_slope_{name}"""
            )
    return f"SELECT num_id, {', '.join(parts)} FROM {source} GROUP BY num_id"


@query("wide", fx.with_views(fx.SENSOR_DAY) + _wide_sql(VALUES, "sensor_day"))
def wide(spark, folder):
    return round_doubles(features.wide_features(fx.sensor_day(spark, folder), VALUES))


_FLAG = "CASE WHEN all_mean > 20 THEN 1 ELSE 0 END"
_SEG = "dense_rank() OVER (ORDER BY segment) - 1"


@query(
    "wide_labels",
    fx.with_views(
        fx.SENSOR_DAY,
        fx.DEMOGRAPHICS,
        f"flagged AS (SELECT *, {_FLAG} AS phq2_bin FROM sensor_day)",
        """agg AS (SELECT num_id, avg(all_mean) FILTER (week <= 1) AS am_w1, avg(all_mean) FILTER (week <= 2) AS am_wu2,
            avg(all_mean) FILTER (week <= 4) AS am_wu4, avg(all_mean) FILTER (week = 4) AS am_w4,
            trunc(avg(phq2_bin) FILTER (week <= 1)) AS p1, trunc(avg(phq2_bin) FILTER (week <= 2)) AS p2,
            trunc(avg(phq2_bin) FILTER (week <= 4)) AS p3, trunc(avg(phq2_bin) FILTER (week = 4)) AS p4,
            regr_slope(all_mean, day) FILTER (week <= 2) AS s2, regr_slope(all_mean, day) FILTER (week <= 4) AS s4
            FROM flagged GROUP BY num_id)""",
    )
    + """SELECT a.num_id, round(am_w1, 6) AS all_mean_avg_w1, round(am_wu2, 6) AS all_mean_avg_wu2, round(am_wu4, 6) AS all_mean_avg_wu4,
      round(am_w4, 6) AS all_mean_avg_w4, round(s2, 6) + 0.0 AS all_mean_slope_wu2, round(s4, 6) + 0.0 AS all_mean_slope_wu4,
      CAST(p1 AS INT) AS phq2_bin_avg_w1, CAST(p2 AS INT) AS phq2_bin_avg_wu2, CAST(p3 AS INT) AS phq2_bin_avg_wu4,
      CAST(p4 AS INT) AS phq2_bin_avg_w4, segment AS demo_cluster
    FROM agg a JOIN demographics d ON a.num_id = d.num_id AND segment IS NOT NULL
    WHERE am_w1 IS NOT NULL AND am_wu2 IS NOT NULL AND am_wu4 IS NOT NULL AND am_w4 IS NOT NULL
      AND s2 IS NOT NULL AND s4 IS NOT NULL""",
)
def wide_labels(spark, folder):
    panel = fx.sensor_day(spark, folder).withColumn("phq2_bin", (F.col("all_mean") > 20).cast("int"))
    wide = features.wide_features(panel, ["all_mean", "phq2_bin"]).drop("phq2_bin_slope_wu2", "phq2_bin_slope_wu4")
    clusters = fx.demographics(spark, folder).select("num_id", F.col("segment").alias("demo_cluster")).na.drop()
    return round_doubles(features.label_wide(wide, clusters, ["phq2_bin"]))


_PIVOT = ", ".join(f"round(coalesce(avg(all_mean) FILTER (week = {w}), 0), 6) AS w{w}" for w in fx.ALL_WEEKS)


@query("rs_pivot", fx.with_views(fx.SENSOR_DAY) + f"SELECT num_id, {_PIVOT} FROM sensor_day GROUP BY num_id")
def rs_pivot(spark, folder):
    return round_doubles(features.pivot_weeks(fx.sensor_day(spark, folder), "all_mean", fx.ALL_WEEKS))


@query(
    "rs_melt",
    fx.with_views(fx.SENSOR_DAY)
    + " UNION ALL ".join(f"SELECT num_id, dt, '{c}' AS variable, round({c}, 6) AS value FROM sensor_day" for c in VALUES),
)
def rs_melt(spark, folder):
    return round_doubles(features.melt(fx.sensor_day(spark, folder).select("num_id", "dt", *VALUES), ["num_id", "dt"], VALUES))


_TRAJ = ", ".join(f"avg(v_view) FILTER (week = {w}) AS w{w}" for w in fx.WEEKS)


@query(
    "cl_process",
    fx.with_views(fx.SENSOR_DAY, f"m AS (SELECT num_id, {_TRAJ} FROM sensor_day GROUP BY num_id)")
    + f"SELECT num_id, {sql_round(*[f'w{w}' for w in fx.WEEKS])} FROM m WHERE "
    + " AND ".join(f"w{w} IS NOT NULL" for w in fx.WEEKS),
)
def cl_process(spark, folder):
    return round_doubles(features.trajectory_matrix(fx.sensor_day(spark, folder), "v_view", fx.WEEKS))


@query(
    "flt_complete_weeks",
    fx.with_views(
        fx.SENSOR_DAY,
        "ok AS (SELECT num_id FROM sensor_day WHERE v_click IS NOT NULL AND week IN (0, 1, 2, 3) GROUP BY 1 HAVING count(DISTINCT week) = 4)",
    )
    + "SELECT num_id, dt, week, round(v_click, 6) AS v_click FROM sensor_day WHERE num_id IN (SELECT num_id FROM ok)",
)
def flt_complete_weeks(spark, folder):
    rows = fx.sensor_day(spark, folder).select("num_id", "dt", "week", "v_click")
    return round_doubles(keep_complete_weeks(rows, "v_click", fx.WEEKS))


@query(
    "imp_missing_flag",
    fx.with_views(fx.SENSOR_GRID)
    + "SELECT num_id, dt, " + ", ".join(f"CAST({c} IS NULL AS INT) AS {c}_missing" for c in VALUES) + " FROM sensor_grid",
)
def imp_missing_flag(spark, folder):
    flagged = features.missing_flags(fx.sensor_grid(spark, folder), VALUES)
    return flagged.select("num_id", "dt", *[c for c in flagged.columns if c.endswith("_missing")])


@query(
    "imp_daily_stats",
    """SELECT user_id AS num_id, CAST(ts AS DATE) AS dt, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median,
      round(stddev_samp(value), 6) AS value_std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 AS "value_IQR",
      round(sum(value), 6) AS value_sum FROM events GROUP BY 1, 2""",
)
def imp_daily_stats(spark, folder):
    rows = fx.table(spark, folder, "events").select(F.col("user_id").alias("num_id"), F.col("ts").alias("dt"), "value")
    return round_doubles(features.daily_stats(rows, "value"))


@query(
    "imp_per_hour",
    fx.with_views(fx.SENSOR_DAY)
    + """SELECT num_id, dt, round(v_click / nullif(n_events - 1, 0), 6) AS v_click_hr,
      round(v_view / nullif(n_events - 1, 0), 6) AS v_view_hr FROM sensor_day""",
)
def imp_per_hour(spark, folder):
    day = fx.sensor_day(spark, folder).withColumn("hours_accounted_for", F.col("n_events") - 1)
    return round_doubles(features.per_hour(day, ["v_click", "v_view"]).select("num_id", "dt", "v_click_hr", "v_view_hr"))


@query(
    "imp_survey_sum",
    fx.with_views(fx.SURVEY_WEEK)
    + "SELECT num_id, week, " + " + ".join(f"coalesce({c}, 0)" for c in fx.PHQ2_ITEMS) + " AS phq2_sum, "
    + " + ".join(f"coalesce({c}, 0)" for c in fx.PHQ9_ITEMS) + " AS phq9_sum FROM survey_week",
)
def imp_survey_sum(spark, folder):
    survey = fx.survey_week(spark, folder)
    return survey.select("num_id", "week", row_sum(*fx.PHQ2_ITEMS).alias("phq2_sum"), row_sum(*fx.PHQ9_ITEMS).alias("phq9_sum"))


@query(
    "imp_coverage",
    fx.with_views(fx.SENSOR_GRID)
    + "SELECT week, count(DISTINCT num_id) AS subjects, "
    + ", ".join(f"count(DISTINCT CASE WHEN {c} IS NOT NULL THEN num_id END) AS {c}_subjects" for c in VALUES)
    + " FROM sensor_grid GROUP BY week",
)
def imp_coverage(spark, folder):
    return features.week_coverage(fx.sensor_grid(spark, folder), VALUES)
