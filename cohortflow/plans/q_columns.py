"""Sources, projections, filters, scalar functions and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numeric, scores
from ..operators import encoding, joins, ordering, projection
from ..operators.aggregates import group_median
from ..operators.transform import boxcox_expr, log1p_columns
from ..session import ensure_checkpoint_dir
from ..sources import tables, variables
from . import fixtures as fx
from .registry import query, r6, round_doubles, sql_round

SENSOR_GROUPS = {"id": variables.ID_COLUMNS, "sensor": fx.SENSORS, "dense": fx.DENSE}


# ------------------------------------------------------------------- sources


@query("src_parquet", "SELECT event_id, user_id, event_type, value FROM events")
def src_parquet(spark, folder):
    return tables.read_parquet(spark, f"{folder}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query(
    "src_multi",
    fx.with_views(fx.SENSOR_DAY, fx.SURVEY_WEEK)
    + """SELECT 'v1_day' AS dataset, count(*) AS n, count(DISTINCT num_id) AS subjects FROM sensor_day
    UNION ALL SELECT 'v1_week', count(*), count(DISTINCT num_id) FROM survey_week""",
)
def src_multi(spark, folder):
    both = tables.union_datasets({"v1_day": fx.sensor_day(spark, folder), "v1_week": fx.survey_week(spark, folder)})
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("num_id").alias("subjects"))


@query("src_index_clean", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, dt, week, day FROM sensor_day")
def src_index_clean(spark, folder):
    day = fx.sensor_day(spark, folder).select("num_id", "dt", "week", "day", F.col("day").alias("Unnamed: 0"))
    return tables.drop_index_columns(day)


def _shared_folder(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


@query("src_csv", "SELECT event_id, user_id, event_type, value FROM events")
def src_csv(spark, folder):
    """Written as CSV, read back with a declared schema."""
    events = fx.table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    path = tables.save_table(events, _shared_folder(spark), "events", fmt="csv")
    return tables.read_csv(spark, path, "event_id long, user_id long, event_type string, value double")


@query("snk_csv", fx.with_views(fx.SENSOR_DAY) + "SELECT week, count(*) AS n, count(v_click) AS clicks FROM sensor_day GROUP BY 1")
def snk_csv(spark, folder):
    """Missing cells survive the round trip as missing."""
    day = fx.sensor_day(spark, folder).select("num_id", "week", "v_click")
    path = tables.save_table(day, _shared_folder(spark), "v1_day", fmt="csv")
    back = tables.read_csv(spark, path, "num_id long, week int, v_click double")
    return back.groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.count("v_click").alias("clicks"))


@query("snk_json", "SELECT count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM events")
def snk_json(spark, folder):
    row = fx.table(spark, folder, "events").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("value")).alias("mean_value")).first()
    return spark.read.schema("n_rows long, mean_value double").json(tables.save_json_row(spark, row.asDict(), _shared_folder(spark), "summary"))


# --------------------------------------------------------------- projections


@query("prj_groups", fx.with_views(fx.SENSOR_DAY) + f"SELECT num_id, dt, week, day, {sql_round(*fx.SENSORS)} FROM sensor_day")
def prj_groups(spark, folder):
    return round_doubles(variables.select_group(fx.sensor_day(spark, folder), "id", "sensor", catalogue=SENSOR_GROUPS))


@query("prj_pattern", fx.with_views(fx.SURVEY_WEEK) + "SELECT num_id, week, " + ", ".join(fx.PHQ9_ITEMS) + " FROM survey_week")
def prj_pattern(spark, folder):
    return projection.select_matching(fx.survey_week(spark, folder), prefix="phq9_", keep=("num_id", "week"))


@query("prj_drop", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, dt, week, day, n_events FROM sensor_day")
def prj_drop(spark, folder):
    return projection.drop_columns(fx.sensor_day(spark, folder), *fx.SENSORS, "all_mean", "not_there")


@query("prj_rename", fx.with_views(fx.SENSOR_DAY) + f"SELECT num_id, dt, {sql_round('v_click', 'v_view')} FROM sensor_day")
def prj_rename(spark, folder):
    day = fx.sensor_day(spark, folder).select("num_id", "dt", F.col("v_click").alias("v_click_nonoutliers"), F.col("v_view").alias("v_view_nonoutliers"))
    return round_doubles(projection.strip_suffix(day, "_nonoutliers"))


@query("prj_numeric", "SELECT event_id, user_id, value FROM events")
def prj_numeric(spark, folder):
    return projection.numeric_only(fx.table(spark, folder, "events"))


@query(
    "prj_coerce",
    """SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS type_number, TRY_CAST(props->>'$.k' AS DOUBLE) AS k_number,
      TRY_CAST(event_type AS TIMESTAMP) AS type_time FROM events""",
)
def prj_coerce(spark, folder):
    rows = fx.table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("type_number"), F.get_json_object("props", "$.k").alias("k_number"), F.col("event_type").alias("type_time")
    )
    return projection.coerce(rows, {"type_number": "double", "k_number": "double", "type_time": "timestamp"})


# ------------------------------------------------------------------- filters


@query("flt_dropna", fx.with_views(fx.SENSOR_DAY) + f"SELECT num_id, dt, {sql_round('v_click', 'v_view')} FROM sensor_day WHERE v_click IS NOT NULL AND v_view IS NOT NULL")
def flt_dropna(spark, folder):
    rows = fx.sensor_day(spark, folder).select("num_id", "dt", "v_click", "v_view")
    return round_doubles(projection.drop_missing(rows, ["v_click", "v_view"]))


@query("flt_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20")
def flt_range(spark, folder):
    rows = fx.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return projection.in_range(rows, "l_quantity", 10, 20)


@query(
    "flt_min_rows",
    fx.with_views(fx.SENSOR_DAY, "ok AS (SELECT num_id FROM sensor_day GROUP BY 1 HAVING count(*) >= 27)")
    + "SELECT num_id, dt, day FROM sensor_day WHERE num_id IN (SELECT num_id FROM ok)",
)
def flt_min_rows(spark, folder):
    return projection.keep_subjects_with_rows(fx.sensor_day(spark, folder).select("num_id", "dt", "day"), 27)


@query("flt_non_constant", fx.with_views(fx.SENSOR_DAY) + f"SELECT num_id, dt, {sql_round('all_mean', 'v_click')} FROM sensor_day")
def flt_non_constant(spark, folder):
    rows = fx.sensor_day(spark, folder).select("num_id", "dt", "all_mean", "v_click", F.lit(3.0).alias("flat"))
    return round_doubles(projection.drop_constant(rows, ["all_mean", "v_click", "flat"]))


@query("flt_overlap_check", "SELECT o_custkey AS num_id FROM orders INTERSECT SELECT user_id FROM events")
def flt_overlap_check(spark, folder):
    orders = fx.table(spark, folder, "orders").select(F.col("o_custkey").alias("num_id"))
    users = fx.table(spark, folder, "events").select(F.col("user_id").alias("num_id"))
    return projection.shared_keys(orders, users, ["num_id"])


@query("set_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, folder):
    customers = fx.table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"))
    suppliers = fx.table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"))
    return projection.shared_keys(customers, suppliers, ["nation"])


# ---------------------------------------------------------- scalar functions

_K = "(CAST(props->>'$.k' AS INT) - 8) / 2.0"


def _score(spark, folder):
    k = (F.get_json_object("props", "$.k").cast("int") - 8) / 2
    return fx.table(spark, folder, "events").select("event_id", k.alias("s"))


def _case(bands):
    tests = " ".join(f"WHEN s >= {lo}{'' if hi is None else f' AND s <= {hi}'} THEN {c}" for lo, hi, c in bands)
    return f"SELECT event_id, s, CASE {tests} END AS category FROM (SELECT event_id, {_K} AS s FROM events)"


@query("fn_cat_alc", _case([(0, 0, 0), (1, 3, 1), (4, 6, 2), (7, None, 3)]))
def fn_cat_alc(spark, folder):
    return _score(spark, folder).withColumn("category", scores.cat_alc("s"))


@query("fn_cat_gad", _case([(0, 5, 0), (5, 10, 1), (11, 15, 2), (16, None, 3)]))
def fn_cat_gad(spark, folder):
    return _score(spark, folder).withColumn("category", scores.cat_gad("s"))


@query("fn_cat_phq9", _case([(0, 4, 0), (5, 9, 1), (10, 14, 2), (15, 19, 3), (20, 27, 4)]))
def fn_cat_phq9(spark, folder):
    return _score(spark, folder).withColumn("category", scores.cat_phq9("s"))


@query("fn_bin_phq9", _case([(0, 9, 0), (10, None, 1)]))
def fn_bin_phq9(spark, folder):
    return _score(spark, folder).withColumn("category", scores.bin_phq9("s"))


@query("fn_bin_phq2", _case([(0, 2, 0), (3, None, 1)]))
def fn_bin_phq2(spark, folder):
    return _score(spark, folder).withColumn("category", scores.bin_phq2("s"))


@query("fn_bin_threshold", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, dt, CASE WHEN v_click > 0.3 THEN 1 ELSE 0 END AS flag FROM sensor_day")
def fn_bin_threshold(spark, folder):
    return fx.sensor_day(spark, folder).select("num_id", "dt", scores.bin_threshold("v_click").alias("flag"))


@query(
    "fn_clin_flag",
    fx.with_views(fx.SURVEY_WEEK)
    + "SELECT num_id, week, CASE WHEN screen_1 > 0 OR gad7_sum > 10 OR phq9_1 > 2 THEN 1 ELSE 0 END AS clinical FROM survey_week",
)
def fn_clin_flag(spark, folder):
    flag = scores.clinical_flag({"screen_1": 0, "gad7_sum": 10, "phq9_1": 2})
    return fx.survey_week(spark, folder).select("num_id", "week", flag.alias("clinical"))


@query("fn_row_sum", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, dt, coalesce(CAST(trunc(v_click) AS INT), 0) + coalesce(CAST(trunc(v_view) AS INT), 0) AS total FROM sensor_day")
def fn_row_sum(spark, folder):
    return fx.sensor_day(spark, folder).select("num_id", "dt", numeric.row_sum("v_click", "v_view").alias("total"))


@query("fn_log1p", "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, round(ln(1 + c_nationkey), 6) AS nation FROM customer")
def fn_log1p(spark, folder):
    # the balance holds negative values, so that column stays as it is
    rows = fx.table(spark, folder, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return round_doubles(log1p_columns(rows, ["c_acctbal", "nation"]))


@query("fn_boxcox_fixed", "SELECT event_id, round((pow(value + 0.000001, 0.25) - 1) / 0.25, 6) + 0.0 AS value_bc FROM events")
def fn_boxcox_fixed(spark, folder):
    return fx.table(spark, folder, "events").select("event_id", r6(boxcox_expr(F.col("value") + 1e-6, 0.25)).alias("value_bc"))


@query(
    "fn_cut",
    """WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS w FROM events)
    SELECT event_id, value, CAST(least(greatest(ceil((value - lo) / w), 1), 5) AS INT) AS value_bin FROM events, e""",
)
def fn_cut(spark, folder):
    return scores.cut_equal_width(fx.table(spark, folder, "events").select("event_id", "value"), "value", 5)


_CODES = """codes AS (SELECT segment, CASE WHEN segment IS NULL THEN (SELECT count(DISTINCT segment) FROM demographics)
  ELSE dense_rank() OVER (ORDER BY segment NULLS LAST) - 1 END AS code FROM (SELECT DISTINCT segment FROM demographics))"""


@query("fn_label_encode", fx.with_views(fx.DEMOGRAPHICS, _CODES) + "SELECT d.num_id, d.segment, code AS segment_code FROM demographics d JOIN codes c ON d.segment IS NOT DISTINCT FROM c.segment")
def fn_label_encode(spark, folder):
    return encoding.label_encode(fx.demographics(spark, folder).select("num_id", "segment"), ["segment"])


@query(
    "fn_label_decode",
    fx.with_views(fx.DEMOGRAPHICS, _CODES, "m AS (SELECT d.nation, round_even(median(code), 0) AS code FROM demographics d JOIN codes c ON d.segment IS NOT DISTINCT FROM c.segment GROUP BY 1)")
    + "SELECT m.nation, m.code AS segment_code, c.segment AS segment_label FROM m LEFT JOIN codes c ON CAST(m.code AS BIGINT) = c.code",
)
def fn_label_decode(spark, folder):
    rows = fx.demographics(spark, folder).select("nation", "segment")
    codes = encoding.label_codes(rows, "segment")
    medians = group_median(encoding.label_encode(rows, ["segment"]), ["nation"], ["segment_code"], rounded=True)
    return encoding.label_decode(medians, "segment_code", codes, "segment_label")


@query("fn_trunc_int", "SELECT c_custkey, CAST(trunc(c_acctbal / 100) AS INT) AS units FROM customer")
def fn_trunc_int(spark, folder):
    return fx.table(spark, folder, "customer").select("c_custkey", scores.truncate_to_int(F.col("c_acctbal") / 100).alias("units"))


@query(
    "fn_inf_fix",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN -1.0 WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE value END AS r
    FROM events""",
)
def fn_inf_fix(spark, folder):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", float("inf")).when(kind == "view", float("-inf")).when(kind == "error", float("nan"))
        .when(kind == "signup", F.lit(None)).otherwise(F.col("value"))
    )
    return fx.table(spark, folder, "events").select("event_id", numeric.finite_correlation(raw).alias("r"))


@query("fn_rmse", "SELECT round(sqrt(avg((l_tax - l_discount) ** 2)), 6) AS rmse FROM lineitem")
def fn_rmse(spark, folder):
    return fx.table(spark, folder, "lineitem").agg(r6(numeric.rmse("l_tax", "l_discount")).alias("rmse"))


# --------------------------------------------------------------------- joins


@query("jn_left", fx.with_views(fx.SENSOR_DAY, fx.SURVEY_WEEK) + "SELECT d.num_id, d.dt, d.week, phq9_1 FROM sensor_day d LEFT JOIN survey_week s ON d.num_id = s.num_id AND d.week = s.week")
def jn_left(spark, folder):
    survey = fx.survey_week(spark, folder).select("num_id", "week", "phq9_1")
    return joins.join_on(fx.sensor_day(spark, folder).select("num_id", "dt", "week"), survey, ["num_id", "week"], "left")


@query("jn_inner", fx.with_views(fx.SENSOR_DAY, fx.ID_KEY) + "SELECT d.num_id, d.dt, participant_id FROM sensor_day d JOIN id_key k ON d.num_id = k.num_id")
def jn_inner(spark, folder):
    return joins.join_on(fx.sensor_day(spark, folder).select("num_id", "dt"), fx.id_key(spark, folder), ["num_id"], "inner")


@query(
    "jn_outer",
    fx.with_views(fx.ID_KEY, "u AS (SELECT user_id AS num_id, count(*) AS n FROM events GROUP BY 1)")
    + "SELECT num_id, participant_id, n FROM id_key FULL OUTER JOIN u USING (num_id)",
)
def jn_outer(spark, folder):
    seen = fx.table(spark, folder, "events").groupBy(F.col("user_id").alias("num_id")).agg(F.count(F.lit(1)).alias("n"))
    return joins.join_on(fx.id_key(spark, folder), seen, ["num_id"], "outer")


@query(
    "jn_multi_outer",
    fx.with_views(fx.SENSOR_DAY)
    + """SELECT num_id, round(avg(all_mean) FILTER (week <= 1), 6) AS a1, round(avg(all_mean) FILTER (week IN (2, 3)), 6) AS a3,
      round(avg(v_click) FILTER (week >= 4), 6) AS c4 FROM sensor_day GROUP BY num_id""",
)
def jn_multi_outer(spark, folder):
    day = fx.sensor_day(spark, folder)
    parts = [
        day.filter("week <= 1").groupBy("num_id").agg(F.avg("all_mean").alias("a1")),
        day.filter("week in (2, 3)").groupBy("num_id").agg(F.avg("all_mean").alias("a3")),
        day.filter("week >= 4").groupBy("num_id").agg(F.avg("v_click").alias("c4")),
    ]
    return round_doubles(joins.outer_join_all(parts, ["num_id"]))


@query("jn_semi", fx.with_views(fx.SENSOR_DAY, fx.DEMOGRAPHICS) + "SELECT num_id, dt FROM sensor_day WHERE num_id IN (SELECT num_id FROM demographics WHERE segment = 'BUILDING')")
def jn_semi(spark, folder):
    chosen = fx.demographics(spark, folder).filter("segment = 'BUILDING'").select("num_id")
    return joins.keep_labelled(fx.sensor_day(spark, folder).select("num_id", "dt"), chosen)


@query("jn_positional", fx.with_views(fx.SENSOR_DAY) + f"SELECT num_id, dt, {sql_round('v_click', 'all_mean')} FROM sensor_day")
def jn_positional(spark, folder):
    day = fx.sensor_day(spark, folder)
    features, target = day.select("num_id", "dt", "v_click"), day.select("num_id", "dt", "all_mean")
    return round_doubles(joins.join_on(features, target, ["num_id", "dt"], "inner"))


@query("jn_coalesce", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, dt, round(coalesce(v_click, v_view), 6) AS filled FROM sensor_day")
def jn_coalesce(spark, folder):
    day = joins.coalesce_columns(fx.sensor_day(spark, folder), "filled", "v_click", "v_view")
    return day.select("num_id", "dt", r6("filled").alias("filled"))


@query(
    "jn_baseline",
    fx.with_views(fx.ID_KEY, fx.DEMOGRAPHICS, fx.SURVEY_WEEK)
    + """SELECT DISTINCT k.num_id, k.participant_id, segment, region, gad7_sum, alc_sum
    FROM id_key k LEFT JOIN demographics d ON k.num_id = d.num_id
    LEFT JOIN (SELECT num_id, gad7_sum FROM survey_week WHERE week = 0) g ON k.num_id = g.num_id
    LEFT JOIN (SELECT num_id, alc_sum FROM survey_week WHERE week = 0) a ON k.num_id = a.num_id""",
)
def jn_baseline(spark, folder):
    first = fx.survey_week(spark, folder).filter("week = 0")
    parts = [
        fx.demographics(spark, folder).select("num_id", "segment", "region"),
        first.select("num_id", "gad7_sum"),
        first.select("num_id", "alc_sum"),
    ]
    return joins.join_baseline(fx.id_key(spark, folder), parts)


@query("set_union", fx.with_views(fx.SENSOR_DAY, fx.SURVEY_WEEK) + "SELECT num_id, week, round(all_mean, 6) AS all_mean, NULL::INT AS phq9_1 FROM sensor_day UNION ALL SELECT num_id, week, NULL, phq9_1 FROM survey_week")
def set_union(spark, folder):
    day = fx.sensor_day(spark, folder).select("num_id", "week", "all_mean")
    both = day.unionByName(fx.survey_week(spark, folder).select("num_id", "week", "phq9_1"), allowMissingColumns=True)
    return round_doubles(both)


@query("st_distinct", "SELECT DISTINCT user_id AS num_id, event_type FROM events")
def st_distinct(spark, folder):
    return fx.sensor_raw(spark, folder).select("num_id", "event_type").dropDuplicates()


@query("st_sort", "SELECT event_id, user_id, ts FROM events ORDER BY user_id, ts, event_id")
def st_sort(spark, folder):
    return fx.table(spark, folder, "events").select("event_id", "user_id", "ts").orderBy("user_id", "ts", "event_id")
