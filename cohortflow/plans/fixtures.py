"""Panel views over the star-schema tables, and the same views as SQL text.

Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.timeline import assign_day, assign_week, reindex_days
from ..session import configure

TYPES = ["click", "view", "purchase", "signup", "error"]
SENSORS = [f"v_{t}" for t in TYPES]
DENSE = ["all_mean", "n_events"]
PHQ9_ITEMS = [f"phq9_{i}" for i in range(1, 10)]
PHQ2_ITEMS = ["phq2_1", "phq2_2"]
ALL_WEEKS = [0, 1, 2, 3, 4]
WEEKS = [0, 1, 2, 3]  # the weeks a trajectory must have: week 4 holds two days only


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def sensor_raw(spark, folder) -> DataFrame:
    """One reading per row: the variable of its type is set, the others are missing."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").alias("num_id"),
        F.col("ts").alias("dt"),
        "event_id",
        "event_type",
        *[F.when(F.col("event_type") == t, F.col("value")).alias(f"v_{t}") for t in TYPES],
    )


def sensor_day(spark, folder) -> DataFrame:
    """Panel: one row per subject and observed date, with week and day numbers."""
    events = table(spark, folder, "events").withColumn("dt", F.to_date("ts"))
    daily = events.groupBy(F.col("user_id").alias("num_id"), "dt").agg(
        *[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(f"v_{t}") for t in TYPES],
        F.avg("value").alias("all_mean"),
        F.count(F.lit(1)).cast("double").alias("n_events"),
    )
    return assign_day(assign_week(daily, panel=True))


def sensor_grid(spark, folder) -> DataFrame:
    """The panel on the full calendar of each subject."""
    return reindex_days(sensor_day(spark, folder).drop("week", "day"))


def survey_week(spark, folder) -> DataFrame:
    """Weekly questionnaire items per subject, some missing."""
    events = assign_week(table(spark, folder, "events").select(F.col("user_id").alias("num_id"), F.col("ts").alias("dt"), "event_id", "props"))
    first = events.groupBy("num_id", "week").agg(
        F.to_date(F.min("dt")).alias("dt"),
        F.min_by(F.struct("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "event_id").alias("e"),
    )
    e, k = F.col("e.event_id"), F.col("e.k")

    def item(i: int):
        return F.when((e + i) % 13 != 0, ((e + 7 * i + k) % 4).cast("int"))

    return first.select(
        "num_id", "dt", "week",
        *[item(i).alias(c) for i, c in enumerate(PHQ9_ITEMS, 1)],
        *[item(i + 20).alias(c) for i, c in enumerate(PHQ2_ITEMS, 1)],
        (k % 21).cast("int").alias("gad7_sum"),
        (k % 11).cast("int").alias("alc_sum"),
        (k % 2).cast("int").alias("screen_1"),
    )


def demographics(spark, folder) -> DataFrame:
    """Attributes of the observed subjects."""
    subjects = table(spark, folder, "events").select(F.col("user_id").alias("num_id")).distinct()
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    known = F.col("c_custkey") % 11 != 0
    return (
        customer.join(subjects, customer.c_custkey == subjects.num_id, "inner")
        .join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, nation.n_regionkey == region.r_regionkey, "left")
        .select(
            "num_id",
            F.col("c_name").alias("participant_id"),
            F.when(known, F.col("c_mktsegment")).alias("segment"),
            F.when(known, F.col("r_name")).alias("region"),
            F.when(known, F.col("c_acctbal")).alias("balance"),
            F.col("n_nationkey").alias("nation"),
        )
    )


def id_key(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("num_id"), F.col("c_name").alias("participant_id")
    )


def lineitem(spark, folder) -> DataFrame:
    """The large numeric table: supplier as subject, ship date as time."""
    return table(spark, folder, "lineitem").withColumnsRenamed(
        {"l_suppkey": "num_id", "l_shipdate": "dt", "l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount", "l_tax": "tax"}
    )


def two_class(spark, folder) -> DataFrame:
    """Labelled documents with size features."""
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    return documents.join(labels, "doc_id").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.col("toxic").cast("double").alias("toxic"),
        F.col("quality").cast("int").alias("y"),
    )


# ------------------------------------------------------------------ SQL twins

_SENSORS_RAW = ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS v_{t}" for t in TYPES)
_SENSORS_DAY = ", ".join(f"avg(CASE WHEN event_type = '{t}' THEN value END) AS v_{t}" for t in TYPES)

SENSOR_RAW = f"sensor_raw AS (SELECT user_id AS num_id, ts AS dt, event_id, event_type, {_SENSORS_RAW} FROM events)"
SENSOR_DAY = f"""sensor_daily AS (
  SELECT user_id AS num_id, CAST(ts AS DATE) AS dt, {_SENSORS_DAY}, avg(value) AS all_mean,
         CAST(count(*) AS DOUBLE) AS n_events
  FROM events GROUP BY 1, 2),
sensor_day AS (
  SELECT *, CAST((dt - min(dt) OVER (PARTITION BY num_id)) // 7 AS INT) AS week,
         CAST(row_number() OVER (PARTITION BY num_id ORDER BY dt) - 1 AS INT) AS day
  FROM sensor_daily)"""
SENSOR_GRID = SENSOR_DAY + """,
sensor_span AS (SELECT num_id, min(dt) AS d0, max(dt) AS d1 FROM sensor_daily GROUP BY 1),
sensor_cal AS (
  SELECT num_id, d0, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS dt FROM sensor_span),
sensor_grid AS (
  SELECT c.num_id, c.dt, s.* EXCLUDE (num_id, dt), CAST((c.dt - c.d0) // 7 AS INT) AS week, CAST(c.dt - c.d0 AS INT) AS day
  FROM sensor_cal c LEFT JOIN sensor_daily s ON s.num_id = c.num_id AND s.dt = c.dt)"""


def _item(i: int, name: str) -> str:
    return f"CASE WHEN (event_id + {i}) % 13 <> 0 THEN CAST((event_id + 7 * {i} + k) % 4 AS INT) END AS {name}"


SURVEY_WEEK = f"""survey_ev AS (
  SELECT user_id AS num_id, ts, event_id, CAST(props->>'$.k' AS INT) AS k,
         CAST(floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 604800000000.0) AS INT) AS week
  FROM events),
survey_first AS (
  SELECT num_id, week, CAST(min(ts) AS DATE) AS dt, min(event_id) AS event_id, arg_min(k, event_id) AS k
  FROM survey_ev GROUP BY 1, 2),
survey_week AS (
  SELECT num_id, dt, week, {", ".join(_item(i, c) for i, c in enumerate(PHQ9_ITEMS, 1))},
         {", ".join(_item(i + 20, c) for i, c in enumerate(PHQ2_ITEMS, 1))},
         k % 21 AS gad7_sum, k % 11 AS alc_sum, k % 2 AS screen_1
  FROM survey_first)"""
DEMOGRAPHICS = """demographics AS (
  SELECT s.num_id, c_name AS participant_id,
         CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment,
         CASE WHEN c_custkey % 11 <> 0 THEN r_name END AS region,
         CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS balance,
         n_nationkey AS nation
  FROM customer JOIN (SELECT DISTINCT user_id AS num_id FROM events) s ON c_custkey = s.num_id
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
ID_KEY = "id_key AS (SELECT c_custkey AS num_id, c_name AS participant_id FROM customer)"
LINEITEM = """li AS (
  SELECT l_orderkey, l_partkey, l_suppkey AS num_id, l_linenumber, l_quantity AS quantity, l_extendedprice AS price,
         l_discount AS discount, l_tax AS tax, l_returnflag, l_linestatus, l_shipdate AS dt FROM lineitem)"""
TWO_CLASS = """two_class AS (
  SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words,
         CAST(toxic AS DOUBLE) AS toxic, CAST(quality AS INT) AS y
  FROM documents JOIN labels USING (doc_id))"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
