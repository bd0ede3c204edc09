"""Aggregates, correlation structure, group comparison and metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.numeric import strict_slope
from ..operators import aggregates, outliers, stats
from ..operators.timeline import subject_halves
from . import fixtures as fx
from .registry import query, r6, round_doubles, sql_round

VARS = ["all_mean", "n_events", "v_click", "v_view"]
LI = ["quantity", "price", "discount", "tax"]


# ---------------------------------------------------------------- aggregates


@query("ag_mean", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, week, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in VARS) + " FROM sensor_day GROUP BY 1, 2")
def ag_mean(spark, folder):
    return round_doubles(aggregates.group_mean(fx.sensor_day(spark, folder), ["num_id", "week"], VARS))


@query(
    "ag_median",
    fx.with_views(fx.LINEITEM) + "SELECT num_id, round_even(median(quantity), 0) AS quantity, round_even(median(price), 0) AS price FROM li GROUP BY 1",
)
def ag_median(spark, folder):
    return aggregates.group_median(fx.lineitem(spark, folder), ["num_id"], ["quantity", "price"], rounded=True)


@query("ag_count", fx.with_views(fx.SENSOR_DAY) + "SELECT week, " + ", ".join(f"count({c}) AS {c}" for c in VARS) + " FROM sensor_day GROUP BY 1")
def ag_count(spark, folder):
    return aggregates.group_count(fx.sensor_day(spark, folder), ["week"], VARS)


@query("ag_nunique", "SELECT l_suppkey AS num_id, count(DISTINCT l_partkey) AS n_unique FROM lineitem GROUP BY 1")
def ag_nunique(spark, folder):
    return aggregates.group_nunique(fx.lineitem(spark, folder), ["num_id"], "l_partkey")


@query("ag_value_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def ag_value_counts(spark, folder):
    return aggregates.frequency(fx.table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "ag_sem_std",
    """SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
      round(var_samp(l_quantity), 6) AS variance, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS sem FROM lineitem GROUP BY 1""",
)
def ag_sem_std(spark, folder):
    return round_doubles(aggregates.mean_sem(fx.table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity"))


def _long(cols, expr, source, where=""):
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, {expr.format(c=c)} FROM {source} {where}" for c in cols)


@query(
    "ag_skew",
    fx.with_views(fx.SENSOR_DAY) + "SELECT * FROM (" + _long([*VARS, "v_error"], "round(skewness({c}), 6) AS skewness", "sensor_day") + ") WHERE skewness > 1",
)
def ag_skew(spark, folder):
    return round_doubles(aggregates.skewed_columns(fx.sensor_day(spark, folder), [*VARS, "v_error"], 1.0))


@query(
    "ag_kurt",
    fx.with_views(fx.SENSOR_DAY) + "SELECT * FROM (" + _long([*VARS, "v_error"], "round(kurtosis({c}), 6) AS kurtosis", "sensor_day") + ") WHERE kurtosis > 2",
)
def ag_kurt(spark, folder):
    return round_doubles(aggregates.heavy_tailed_columns(fx.sensor_day(spark, folder), [*VARS, "v_error"], 2.0))


@query("ag_kurt_undefined", fx.with_views(fx.SENSOR_DAY) + "SELECT 'flat' AS variable, CAST(0 AS BIGINT) AS n_missing, 0.0::DOUBLE AS variance, 1 AS constant UNION ALL SELECT 'empty', count(*), NULL, 1 FROM sensor_day")
def ag_kurt_undefined(spark, folder):
    rows = fx.sensor_day(spark, folder).withColumns({"flat": F.lit(2.5), "empty": F.lit(None).cast("double")})
    out = aggregates.undefined_shape(rows, ["all_mean", "flat", "empty"])
    return round_doubles(out.withColumn("constant", F.col("constant").cast("int")))


@query(
    "ag_quantile",
    fx.with_views(fx.LINEITEM)
    + _long(LI, "round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3, round(quantile_cont({c}, 0.999), 6) AS top", "li"),
)
def ag_quantile(spark, folder):
    return round_doubles(aggregates.quantiles(fx.lineitem(spark, folder), [], LI, {"q1": 0.25, "q3": 0.75, "top": 0.999}))


@query(
    "ag_box",
    fx.with_views(fx.LINEITEM)
    + " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS variable, min({c}) AS low, round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median,
        round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS high FROM li GROUP BY 1""" for c in ("quantity", "price")
    ),
)
def ag_box(spark, folder):
    return round_doubles(aggregates.box_summary(fx.lineitem(spark, folder), ["l_returnflag"], ["quantity", "price"]))


_ALLV = [*fx.SENSORS, *fx.DENSE]


@query("ag_null_share", fx.with_views(fx.SENSOR_GRID) + _long(_ALLV, "round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share", "sensor_grid"))
def ag_null_share(spark, folder):
    return round_doubles(aggregates.null_share(fx.sensor_grid(spark, folder), _ALLV))


@query(
    "ag_fully_missing",
    fx.with_views(fx.SENSOR_DAY) + _long(_ALLV, "CAST(count({c}) = 0 AS INT) AS all_missing, CAST(count({c}) = count(*) AS INT) AS never_missing", "sensor_day"),
)
def ag_fully_missing(spark, folder):
    return aggregates.missing_kind(fx.sensor_day(spark, folder), _ALLV)


def _at_least_sql(unit, counted):
    return fx.with_views(
        fx.SENSOR_DAY, f"c AS (SELECT {unit}, count(DISTINCT {counted}) AS x FROM sensor_day GROUP BY 1)", "h AS (SELECT x, count(*) AS k FROM c GROUP BY 1)"
    ) + "SELECT x AS at_least, CAST(sum(k) OVER (ORDER BY x DESC) AS BIGINT) AS n FROM h"


@query("ag_at_least", _at_least_sql("num_id", "day"))
def ag_at_least(spark, folder):
    return aggregates.at_least(fx.sensor_day(spark, folder), "num_id", "day")


@query("ag_at_least_t", _at_least_sql("dt", "num_id"))
def ag_at_least_t(spark, folder):
    return aggregates.at_least(fx.sensor_day(spark, folder), "dt", "num_id")


@query("ag_subject_span", fx.with_views(fx.SENSOR_DAY) + "SELECT num_id, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day FROM sensor_day GROUP BY 1 HAVING count(*) > 20")
def ag_subject_span(spark, folder):
    return aggregates.subject_span(fx.sensor_day(spark, folder))


@query(
    "ag_cluster_profile",
    fx.with_views(fx.SENSOR_DAY, fx.DEMOGRAPHICS)
    + """SELECT segment, week, round(avg(all_mean), 6) AS mean, round(avg(all_mean) - stddev_samp(all_mean), 6) AS lower,
      round(avg(all_mean) + stddev_samp(all_mean), 6) AS upper FROM sensor_day d JOIN demographics g ON d.num_id = g.num_id GROUP BY 1, 2""",
)
def ag_cluster_profile(spark, folder):
    rows = fx.sensor_day(spark, folder).join(fx.demographics(spark, folder).select("num_id", "segment"), "num_id")
    return round_doubles(aggregates.cluster_profile(rows, "segment", "all_mean"))


@query(
    "ag_hist",
    """WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events)
    SELECT event_type, CAST(least(floor((value - lo) / w), 9) + 1 AS INT) AS bin, count(*) AS n, round(sum(value), 4) AS total FROM events, e GROUP BY 1, 2""",
)
def ag_hist(spark, folder):
    return round_doubles(aggregates.histogram(fx.table(spark, folder, "events"), "value", 10, ["event_type"], "value"), 4)


# --------------------------------------------------------------- correlation


def _corr(a, b):
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def _edges_sql(cols, source, group=""):
    head = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{a}' AS var_i, '{b}' AS var_j, {_corr(a, b)} AS r FROM {source} {tail}" for a, b in combinations(cols, 2)
    )


@query("st_corr", fx.with_views(fx.LINEITEM, f"e AS ({_edges_sql(LI, 'li')})") + "SELECT var_i, var_j, round(r, 6) + 0.0 AS r FROM e")
def st_corr(spark, folder):
    return round_doubles(stats.correlation_edges(fx.lineitem(spark, folder), LI))


@query(
    "st_target_corr",
    fx.with_views(fx.SENSOR_DAY) + _long(fx.SENSORS, "round(" + "corr({c}, all_mean)" + ", 6) + 0.0 AS r", "sensor_day"),
)
def st_target_corr(spark, folder):
    return round_doubles(stats.target_correlation(fx.sensor_day(spark, folder), fx.SENSORS, "all_mean").orderBy(F.desc_nulls_last("r"), "variable"))


_SUBJ_EDGES = f"e AS ({_edges_sql(VARS, 'sensor_day', 'num_id')})"


@query("st_subj_corr", fx.with_views(fx.SENSOR_DAY, _SUBJ_EDGES) + "SELECT num_id, var_i, var_j, round(coalesce(r, 0), 6) + 0.0 AS r FROM e")
def st_subj_corr(spark, folder):
    return round_doubles(stats.subject_correlation(fx.sensor_day(spark, folder), VARS))


@query(
    "st_subj_corr_half",
    fx.with_views(
        fx.SENSOR_DAY,
        "r AS (SELECT *, row_number() OVER (PARTITION BY num_id ORDER BY dt) AS rn, count(*) OVER (PARTITION BY num_id) AS n FROM sensor_day)",
        "half AS (SELECT * FROM r WHERE n >= 25 AND rn <= n // 2)",
        f"e AS ({_edges_sql(['all_mean', 'n_events', 'v_click'], 'half', 'num_id')})",
    )
    + "SELECT num_id, var_i, var_j, round(coalesce(r, 0), 6) + 0.0 AS r FROM e",
)
def st_subj_corr_half(spark, folder):
    first = subject_halves(fx.sensor_day(spark, folder), min_rows=25).filter("half = 1")
    return round_doubles(stats.subject_correlation(first, ["all_mean", "n_events", "v_click"]))


_PAIRS = list(combinations(VARS, 2))


@query(
    "st_flatten",
    fx.with_views(fx.SENSOR_DAY, _SUBJ_EDGES)
    + "SELECT num_id, "
    + ", ".join(f"max(CASE WHEN var_i = '{a}' AND var_j = '{b}' THEN round(coalesce(r, 0), 6) + 0.0 END) AS r{i}" for i, (a, b) in enumerate(_PAIRS))
    + " FROM e GROUP BY 1",
)
def st_flatten(spark, folder):
    flat = stats.flatten_correlation(stats.subject_correlation(fx.sensor_day(spark, folder), VARS), VARS)
    return flat.select("num_id", *[r6(F.get("vector", F.lit(i))).alias(f"r{i}") for i in range(len(_PAIRS))])


@query("st_avg_corr", fx.with_views(fx.SENSOR_DAY, _SUBJ_EDGES) + "SELECT var_i, var_j, round(1 - avg(coalesce(r, 0)), 6) + 0.0 AS dist FROM e GROUP BY 1, 2")
def st_avg_corr(spark, folder):
    return round_doubles(stats.average_distance(stats.subject_correlation(fx.sensor_day(spark, folder), VARS)))


@query("fn_dist_from_corr", fx.with_views(fx.LINEITEM, f"e AS ({_edges_sql(LI, 'li')})") + "SELECT var_i, var_j, round(1 - r, 6) + 0.0 AS dist FROM e")
def fn_dist_from_corr(spark, folder):
    return round_doubles(stats.distance_from_correlation(stats.correlation_edges(fx.lineitem(spark, folder), LI)))


@query(
    "st_condensed",
    fx.with_views(fx.LINEITEM, "m AS (SELECT num_id, " + ", ".join(f"avg({c}) AS {c}" for c in LI) + " FROM li GROUP BY 1)", f"e AS ({_edges_sql(LI, 'm')})")
    + "SELECT var_i, var_j, round(1 - r, 6) + 0.0 AS dist FROM e",
)
def st_condensed(spark, folder):
    return round_doubles(stats.condensed_distance(fx.lineitem(spark, folder), LI))


@query(
    "st_network",
    fx.with_views(fx.SENSOR_DAY, f"e AS ({_edges_sql([*fx.SENSORS, 'all_mean', 'n_events'], 'sensor_day')})", "s AS (SELECT *, r * 5 AS weight FROM e WHERE abs(r) > 0.2)")
    + """SELECT var_i, var_j, round(r, 6) + 0.0 AS r, round(weight, 6) + 0.0 AS weight, CASE WHEN r < 0 THEN -1 ELSE 1 END AS sign,
      round(CASE WHEN max(weight) OVER () = min(weight) OVER () THEN 5.0 ELSE (weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()) * 9 + 1 END, 6) AS width FROM s""",
)
def st_network(spark, folder):
    edges = stats.correlation_edges(fx.sensor_day(spark, folder), [*fx.SENSORS, "all_mean", "n_events"])
    return round_doubles(stats.network_edges(edges, 0.2, scale=True))


@query("st_var_threshold", fx.with_views(fx.LINEITEM) + "SELECT * FROM (" + _long(LI, "round(var_pop({c}), 2) AS variance", "li") + ") WHERE variance > 0.005")
def st_var_threshold(spark, folder):
    return round_doubles(stats.variance_kept(fx.lineitem(spark, folder), LI, 0.005), 2)


_PRUNE = ["quantity", "price", "double_quantity", "tax"]


@query(
    "st_corr_prune",
    fx.with_views(
        fx.LINEITEM, "l2 AS (SELECT *, quantity * 2 + tax * 20 AS double_quantity FROM li)", f"e AS ({_edges_sql(_PRUNE, 'l2')})",
        "t AS (" + _long(_PRUNE, "abs(corr({c}, discount)) AS s", "l2") + ")",
    )
    + """SELECT DISTINCT CASE WHEN a.s < b.s THEN var_i WHEN a.s > b.s THEN var_j ELSE greatest(var_i, var_j) END AS variable
    FROM e JOIN t a ON a.variable = var_i JOIN t b ON b.variable = var_j WHERE abs(r) > 0.9""",
)
def st_corr_prune(spark, folder):
    rows = fx.lineitem(spark, folder).withColumn("double_quantity", F.col("quantity") * 2 + F.col("tax") * 20)
    return stats.prune_correlated(rows, _PRUNE, "discount", 0.9)


# ------------------------------------------------------------------ outliers

_IQR = """q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"""


@query("st_iqr_drop", f"WITH {_IQR} SELECT event_id, value FROM events, q WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)")
def st_iqr_drop(spark, folder):
    return outliers.drop_iqr_outliers(fx.table(spark, folder, "events").select("event_id", "value"), "value")


@query(
    "st_iqr_null",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3 FROM events)
    SELECT event_id, CASE WHEN value BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1) THEN value END AS value,
      CASE WHEN user_id BETWEEN u1 - 0.5 * (u3 - u1) AND u3 + 0.5 * (u3 - u1) THEN user_id END AS user_id FROM events, q""",
)
def st_iqr_null(spark, folder):
    rows = fx.table(spark, folder, "events").select("event_id", "value", "user_id")
    return outliers.null_iqr_outliers(rows, ["value", "user_id"], 0.5)


@query("st_grubbs")
def st_grubbs(spark, folder):
    rows = fx.table(spark, folder, "events").select("event_id", "value")
    return outliers.null_grubbs_outliers(rows, ["value"])


# ---------------------------------------------------------- group comparison

_GM = """m AS (SELECT l_returnflag AS g, count(l_quantity) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1)"""


@query(
    "st_welch",
    f"""WITH {_GM} SELECT a.g AS cluster_a, b.g AS cluster_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) + 0.0 AS t,
      round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS dof FROM m a JOIN m b ON a.g < b.g""",
)
def st_welch(spark, folder):
    out = stats.welch_test(fx.table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", p_values=False)
    return out.select("cluster_a", "cluster_b", r6("t").alias("t"), r6("dof", 4).alias("dof"))


@query("st_welch_p")
def st_welch_p(spark, folder):
    return stats.welch_test(fx.table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice")


@query(
    "st_cohen_d",
    f"""WITH {_GM} SELECT a.g AS cluster_a, b.g AS cluster_b,
      round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) + 0.0 AS d FROM m a JOIN m b ON a.g < b.g""",
)
def st_cohen_d(spark, folder):
    return round_doubles(stats.cohen_d(fx.table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice"))


@query(
    "st_cluster_cmp",
    fx.with_views(fx.SENSOR_DAY, fx.DEMOGRAPHICS)
    + """SELECT segment, round(avg(v_click), 6) AS mean, round(stddev_samp(v_click) / sqrt(count(v_click)), 6) AS sem, count(DISTINCT d.num_id) AS subjects
    FROM sensor_day d JOIN demographics g ON d.num_id = g.num_id WHERE v_click IS NOT NULL AND segment IS NOT NULL GROUP BY 1""",
)
def st_cluster_cmp(spark, folder):
    rows = fx.sensor_day(spark, folder).join(fx.demographics(spark, folder).select("num_id", "segment"), "num_id")
    return round_doubles(stats.compare_clusters(rows, "segment", "v_click"))


def _kw(c):
    return f"""(WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk,
        count(*) OVER () AS n FROM li WHERE {c} IS NOT NULL),
      tie AS (SELECT sum(CAST(t AS DOUBLE) ** 3 - t) AS tt FROM (SELECT count(*) AS t FROM li WHERE {c} IS NOT NULL GROUP BY {c})),
      g AS (SELECT g, n, sum(rk) AS rs, count(*) AS k FROM r GROUP BY 1, 2)
      SELECT '{c}' AS variable, round((12.0 / (n * (n + 1.0)) * sum(rs * rs / k) - 3 * (n + 1.0)) / (1 - max(tt) / (CAST(n AS DOUBLE) ** 3 - n)), 5) + 0.0 AS h,
        count(*) - 1 AS dof FROM g, tie GROUP BY n)"""


@query("st_kruskal", fx.with_views(fx.LINEITEM) + " UNION ALL ".join(f"SELECT * FROM {_kw(c)}" for c in LI))
def st_kruskal(spark, folder):
    rows = fx.lineitem(spark, folder).withColumn("flat", F.lit(1.0))
    return round_doubles(stats.kruskal_wallis(rows, "l_returnflag", [*LI, "flat"], p_values=False), 5)


# three groups: the upper tail of chi-squared with two degrees of freedom is exp(-h / 2)
_KW_P = " UNION ALL ".join(f"SELECT variable, h, dof, round(exp(-h / 2), 4) AS p FROM {_kw(c)}" for c in LI)


@query("st_kruskal_p", fx.with_views(fx.LINEITEM) + _KW_P)
def st_kruskal_p(spark, folder):
    out = stats.kruskal_wallis(fx.lineitem(spark, folder), "l_returnflag", LI)
    return out.select("variable", r6("h", 5).alias("h"), "dof", r6("p", 4).alias("p"))


@query(
    "st_ks2",
    """WITH v AS (SELECT value, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type <> 'click') AS b FROM events GROUP BY 1),
    c AS (SELECT sum(a) OVER (ORDER BY value) * 1.0 / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY value) * 1.0 / sum(b) OVER () AS fb,
      sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM v)
    SELECT round(max(abs(fa - fb)), 6) AS d, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2 FROM c""",
)
def st_ks2(spark, folder):
    return round_doubles(stats.ks_two_sample(fx.table(spark, folder, "events"), "event_type", "value", "click", p_values=False))


_PRED = "p AS (SELECT l_extendedprice AS y, 2000 * l_quantity AS p FROM lineitem)"


@query(
    "st_r2",
    f"""WITH {_PRED} SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 4) AS mae,
      round(sqrt(avg((y - p) ** 2)), 4) AS rmse FROM p""",
)
def st_r2(spark, folder):
    rows = fx.table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("y"), (2000 * F.col("l_quantity")).alias("p"))
    m = stats.regression_metrics(rows, "y", "p")
    return m.select("n", r6("r2").alias("r2"), r6("mae", 4).alias("mae"), r6("rmse", 4).alias("rmse"))


_CLS = "c AS (SELECT y, CAST(n_words > 100 AS INT) AS p, n_words AS s FROM two_class)"


@query(
    "st_accuracy",
    fx.with_views(fx.TWO_CLASS, _CLS)
    + """SELECT count(*) AS n, round(avg(CAST(y = p AS INT)), 6) AS accuracy, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp,
      count(*) FILTER (y = 1 AND p <> 1) AS fn, count(*) FILTER (y <> 1 AND p <> 1) AS tn,
      round(2.0 * count(*) FILTER (y = 1 AND p = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (p = 1)), 6) AS f1 FROM c""",
)
def st_accuracy(spark, folder):
    rows = fx.two_class(spark, folder).withColumn("p", (F.col("n_words") > 100).cast("int"))
    return round_doubles(stats.classification_metrics(rows, "y", "p"))


@query(
    "st_auc",
    fx.with_views(fx.TWO_CLASS, _CLS, "r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM c)")
    + "SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auc FROM r",
)
def st_auc(spark, folder):
    return round_doubles(stats.auc(fx.two_class(spark, folder), "y", "n_words"))
