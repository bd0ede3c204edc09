"""Named variable groups of the study tables, and selection by group."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Data set names and column names of the study tables, in their published order.
DATASETS = ["v1_day", "v2_day", "v1_week", "v2_week"]
DATASETS_WITH_MISSING = DATASETS + [f"{name}_mis" for name in DATASETS]

ID_COLUMNS = ["num_id", "dt", "week", "day"]
ROW_ID = "idx"

MHS = [f"mhs_{i}" for i in range(1, 6)]
GAD = [f"gad7_{i}" for i in range(1, 9)] + ["gad7_sum", "gad_cat"]
PHQ9_BASE = [f"phq9_{i}_base" for i in range(1, 10)] + ["phq9_sum_base"]
MANIA = [f"screen_{i}" for i in range(1, 5)]
DEMOGRAPHICS = [
    "gender", "education", "working", "income_satisfaction", "income_lastyear", "marital_status",
    "race", "age", "heard_about_us", "device",
]
ALCOHOL = ["alc_1", "alc_2", "alc_3", "alc_sum"]

PHQ9 = [f"phq9_{i}" for i in range(1, 10)] + ["phq9_sum", "phq9_bin"]
SDS = ["sds_1", "sds_2", "sds_3", "stress", "support"]
SLEEP = ["sleep_1", "sleep_2", "sleep_3"]
GIC = ["mood_1"]
WEEKLY = PHQ9 + SDS + SLEEP + GIC
PHQ2 = ["phq2_1", "phq2_2", "phq2_sum"]

DAILY_V1 = [
    "aggregate_communication", "call_count", "call_duration", "interaction_diversity",
    "missed_interactions", "mobility", "mobility_radius", "sms_count", "sms_length", "unreturned_calls",
]
SENSOR_V2 = [
    "distance_walking", "hours_active", "distance_active", "came_to_work", "distance_powered_vehicle",
    "hours_high_speed_transportation", "hours_of_sleep", "distance_high_speed_transportation",
    "hours_powered_vehicle", "hours_stationary", "hours_stationary_nhw", "hours_walking", "location_variance",
]
PHONE_V2 = [
    "callDuration_incoming", "callCount_missed", "callCount_outgoing", "callCount_incoming",
    "callDuration_outgoing", "textCount", "textCount_received", "textCount_sent", "textLength_received",
    "textLength_sent", "uniqueNumbers_calls_incoming", "uniqueNumbers_calls_missed",
    "uniqueNumbers_calls_outgoing", "uniqueNumbers_texts", "uniqueNumbers_texts_received",
    "uniqueNumbers_texts_sent",
]
WEATHER_V2 = [
    "cloud_cover_mean", "dew_point_mean", "humidity_mean", "temp_mean", "dew_point_IQR", "humidity_IQR",
    "temp_IQR", "cloud_cover_IQR", "cloud_cover_std", "dew_point_std", "humidity_std", "temp_std",
    "cloud_cover_median", "dew_point_median", "humidity_median", "temp_median", "precip_sum",
]
COMMON_V2 = [
    "distance_walking", "hours_active", "distance_active", "distance_powered_vehicle", "hours_of_sleep",
    "hours_powered_vehicle", "hours_stationary", "hours_stationary_nhw", "hours_walking",
]
MOBILITY = ["mobility", "mobility_radius"]
HOURS_BASE = "hours_accounted_for"
SENSOR_V2_PER_HOUR = [f"{name}_hr" for name in SENSOR_V2 if name != "came_to_work"]

GROUPS = {
    "id": ID_COLUMNS,
    "mhs": MHS,
    "gad": GAD,
    "phq9_base": PHQ9_BASE,
    "mania": MANIA,
    "demographics": DEMOGRAPHICS,
    "alcohol": ALCOHOL,
    "phq9": PHQ9,
    "sds": SDS,
    "sleep": SLEEP,
    "gic": GIC,
    "weekly": WEEKLY,
    "phq2": PHQ2,
    "daily_v1": DAILY_V1,
    "sensor_v2": SENSOR_V2,
    "phone_v2": PHONE_V2,
    "weather_v2": WEATHER_V2,
    "common_v2": COMMON_V2,
    "mobility": MOBILITY,
    "sensor_v2_per_hour": SENSOR_V2_PER_HOUR,
    "daily": PHQ2 + DAILY_V1 + SENSOR_V2_PER_HOUR + PHONE_V2 + WEATHER_V2,
    "passive": DAILY_V1 + SENSOR_V2 + PHONE_V2,
    "survey": PHQ2 + WEEKLY,
    "numeric": DAILY_V1 + SENSOR_V2 + PHONE_V2 + PHQ2 + WEEKLY,
}


def select_group(df: DataFrame, *groups: str, ids: list[str] | tuple = (), catalogue: dict | None = None) -> DataFrame:
    """Columns of the named groups that the table has, after the id columns."""
    catalogue = catalogue or GROUPS
    wanted = [c for g in groups for c in catalogue[g]]
    chosen = list(dict.fromkeys([*ids, *[c for c in wanted if c in df.columns]]))
    return df.select(*chosen)
