"""Scaling, imputation and predictive models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, features, impute, models, ordering, resampled, splits, stats, timeline, transform, walk
from ..sources import tables
from . import fixtures as fx
from .q_cluster import WEEK_COLS, trajectories, vectors
from .registry import query, r6, round_doubles, sql_round

LI = ["quantity", "price", "discount", "tax"]
KEYS = ["l_orderkey", "l_linenumber"]
# order and line number repeat in the given table; these columns together identify a row
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "num_id", "dt"]
DOC = ["n_chars", "n_words", "toxic"]


@query("src_fallback", "SELECT event_id, user_id FROM events")
def src_fallback(spark, folder):
    return tables.read_first_existing(spark, [f"{folder}/events_pca.parquet", f"{folder}/events.parquet"]).select("event_id", "user_id")


# ------------------------------------------------------------------- scaling


@query(
    "sc_standard",
    fx.with_views(fx.LINEITEM)
    + "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in LI) + " FROM li",
)
def sc_standard(spark, folder):
    return round_doubles(transform.standardize(fx.lineitem(spark, folder).select(*KEYS, *LI), LI))


@query(
    "sc_residual",
    fx.with_views(
        fx.LINEITEM, "b AS (SELECT regr_slope(price, quantity) AS p1, regr_intercept(price, quantity) AS p0, regr_slope(tax, quantity) AS t1, regr_intercept(tax, quantity) AS t0 FROM li)"
    )
    + "SELECT l_orderkey, l_linenumber, round(price - p0 - p1 * quantity, 4) + 0.0 AS price, round(tax - t0 - t1 * quantity, 6) + 0.0 AS tax FROM li, b",
)
def sc_residual(spark, folder):
    out = transform.regress_out(fx.lineitem(spark, folder), ["quantity"], ["price", "tax"])
    return out.select(*KEYS, r6("price", 4).alias("price"), r6("tax").alias("tax"))


@query("sc_residual_many")
def sc_residual_many(spark, folder):
    rows = fx.lineitem(spark, folder).select(*KEYS, *LI)
    return round_doubles(transform.regress_out(rows, ["quantity", "discount", "tax"], ["price"]), 4)


@query("fn_boxcox")
def fn_boxcox(spark, folder):
    rows = fx.table(spark, folder, "events").select("event_id", "value")
    return round_doubles(transform.boxcox(rows, ["value"])[0])


_COV = """m AS (SELECT avg(price / 1000) AS mp, avg(quantity) AS mq, var_samp(price / 1000) AS a, var_samp(quantity) AS c, covar_samp(price / 1000, quantity) AS b FROM li),
l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b ** 2) AS lam FROM m),
e AS (SELECT *, b / sqrt(b ** 2 + (lam - a) ** 2) AS ep, (lam - a) / sqrt(b ** 2 + (lam - a) ** 2) AS eq FROM l),
s AS (SELECT *, CASE WHEN (CASE WHEN abs(ep) >= abs(eq) THEN ep ELSE eq END) < 0 THEN -1 ELSE 1 END AS sg FROM e)"""


@query(
    "pca_clusters",
    fx.with_views(fx.LINEITEM, _COV) + "SELECT l_orderkey, l_linenumber, round(sg * ((price / 1000 - mp) * ep + (quantity - mq) * eq), 5) + 0.0 AS size, round(tax - avg(tax) OVER (), 5) + 0.0 AS c1 FROM li, s",
)
def pca_clusters(spark, folder):
    rows = fx.lineitem(spark, folder).select(*KEYS, (F.col("price") / 1000).alias("kprice"), "quantity", "tax")
    scored, _ = transform.pca_on_clusters(rows, {"kprice": 0, "quantity": 0, "tax": 1}, names={0: "size", 1: "c1"})
    return round_doubles(scored.select(*KEYS, "size", "c1"), 5)


@query("jn_pc_merge", fx.with_views(fx.LINEITEM, _COV) + "SELECT l_orderkey, l_linenumber, quantity, round(sg * ((price / 1000 - mp) * ep + (quantity - mq) * eq), 5) + 0.0 AS size FROM li, s")
def jn_pc_merge(spark, folder):
    """Cluster components sit next to the keys, so there is nothing to join."""
    rows = fx.lineitem(spark, folder).select(*KEYS, "quantity", (F.col("price") / 1000).alias("kprice"))
    scored, _ = transform.pca_on_clusters(rows, {"kprice": 0, "quantity": 0}, names={0: "size"})
    return round_doubles(scored.drop("kprice"), 5)


@query("pca_feature")
def pca_feature(spark, folder):
    scored, _ = transform.vector_components(vectors(spark, folder), "vec", 2)
    return scored.select("vec_id", r6(F.get("scores", F.lit(0))).alias("pc1"), r6(F.get("scores", F.lit(1))).alias("pc2"))


@query("imp_traj_pca")
def imp_traj_pca(spark, folder):
    scored, _ = transform.principal_components(trajectories(spark, folder).select("num_id", *WEEK_COLS), WEEK_COLS, 2)
    return round_doubles(scored.select("num_id", "PC1", "PC2"))


# ---------------------------------------------------------------- imputation


def row_key(*cols: str):
    """The composite key itself as text; hashes of keys would meet in large tables."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def indexed_grid(spark, folder):
    grid = fx.sensor_grid(spark, folder)
    return grid.withColumn("idx", row_key("num_id", "dt"))


def indexed_day(spark, folder):
    return fx.sensor_day(spark, folder).withColumn("idx", row_key("num_id", "dt"))


_SEEN = "sum(" + " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in fx.SENSORS) + ")"


@query(
    "im_mask",
    fx.with_views(fx.SENSOR_GRID)
    + f"SELECT CAST(floor(count(*) * 5 * 0.1) AS BIGINT) AS hidden, CAST({_SEEN} - floor(count(*) * 5 * 0.1) AS BIGINT) AS left_over FROM sensor_grid",
)
def im_mask(spark, folder):
    """Hidden and remaining cells of a 10 % mask over the whole grid."""
    masked, mask = impute.mask_cells(indexed_grid(spark, folder), fx.SENSORS)
    left = sum((F.count(c) for c in fx.SENSORS[1:]), F.count(fx.SENSORS[0]))
    hidden = mask.agg(F.count(F.lit(1)).alias("n")).scalar()
    return masked.agg(left.alias("left_over")).select(hidden.alias("hidden"), "left_over")


@query("im_mask_col", fx.with_views(fx.SENSOR_GRID) + "SELECT CAST(floor(count(*) * 0.1) AS BIGINT) AS hidden, CAST(count(v_view) - floor(count(*) * 0.1) AS BIGINT) AS left_over FROM sensor_grid")
def im_mask_col(spark, folder):
    masked, mask = impute.mask_column(indexed_grid(spark, folder), "v_view")
    hidden = mask.agg(F.count(F.lit(1)).alias("n")).scalar()
    return masked.agg(F.count("v_view").alias("left_over")).select(hidden.alias("hidden"), "left_over")


_LONG = " UNION ALL ".join(
    f"SELECT {c} AS v, avg({c}) OVER (PARTITION BY num_id) AS g FROM sensor_day WHERE {c} IS NOT NULL" for c in ("v_click", "v_view")
)


def _mean_imputed(spark, folder):
    """Every observed cell against its subject's mean."""
    cols = ["v_click", "v_view"]
    day = indexed_day(spark, folder).select("num_id", "idx", *cols)
    mask = ordering.unpivot(day, ["idx"], cols).filter("value IS NOT NULL")
    imputed = timeline.with_group(day, ["num_id"], g0=F.avg(cols[0]), g1=F.avg(cols[1]))
    return mask, imputed.select("idx", F.col("g0").alias(cols[0]), F.col("g1").alias(cols[1]))


@query(
    "im_error",
    fx.with_views(
        fx.SENSOR_DAY, f"c AS ({_LONG})",
        "x AS (SELECT v AS x, 1 AS o FROM c UNION ALL SELECT g, 0 FROM c)",
        "h AS (SELECT x, count(*) FILTER (o = 1) AS a, count(*) FILTER (o = 0) AS b FROM x GROUP BY 1)",
        "k AS (SELECT max(d) AS d FROM (SELECT abs(sum(a) OVER (ORDER BY x) * 1.0 / sum(a) OVER () - sum(b) OVER (ORDER BY x) * 1.0 / sum(b) OVER ()) AS d FROM h))",
    )
    + """SELECT count(*) AS cells, 'ok' AS status, round(sqrt(avg((v - g) ** 2)) / avg(v), 6) AS rmse_scaled,
      round(1 - sum((v - g) ** 2) / (var_pop(v) * count(*)), 6) AS r2, round(d, 6) AS ks_d FROM c, k GROUP BY d""",
)
def im_error(spark, folder):
    error = impute.imputation_error(*_mean_imputed(spark, folder), p_values=False)
    return round_doubles(error.select("cells", "status", "rmse_scaled", "r2", "ks_d"))


@query(
    "im_error_base",
    fx.with_views(fx.SENSOR_DAY, f"c AS ({_LONG})") + "SELECT round(greatest(1 - sum((v - g) ** 2) / (var_pop(v) * count(*)), 0), 6) AS baseline_r2 FROM c",
)
def im_error_base(spark, folder):
    return round_doubles(impute.imputation_error(*_mean_imputed(spark, folder), p_values=False).select("baseline_r2"))


_OBS = " + ".join(f"count({c})" for c in fx.SENSORS)
_USE = " + ".join(f"CAST(count({c}) > 0 AS INT)" for c in fx.SENSORS)


@query(
    "im_gates",
    fx.with_views(fx.SENSOR_DAY)
    + f"""SELECT num_id, count(*) AS n_rows, round(({_OBS}) / nullif(count(*) * ({_USE}), 0), 6) AS observed,
      CAST(count(*) >= 20 AND ({_OBS}) / nullif(count(*) * ({_USE}), 0) >= 0.4 AS INT) AS passes FROM sensor_day GROUP BY 1""",
)
def im_gates(spark, folder):
    return round_doubles(impute.subject_gates(fx.sensor_day(spark, folder), fx.SENSORS, min_observed=0.4))


@query(
    "im_gates_col",
    fx.with_views(fx.SENSOR_GRID)
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, round(avg(CAST({c} IS NULL AS INT)), 6) AS missing,
        CAST(avg(CAST({c} IS NULL AS INT)) > 0 AND avg(CAST({c} IS NULL AS INT)) < 0.3 AS INT) AS passes FROM sensor_grid""" for c in [*fx.SENSORS, *fx.DENSE]
    ),
)
def im_gates_col(spark, folder):
    return round_doubles(impute.column_gates(fx.sensor_grid(spark, folder), [*fx.SENSORS, *fx.DENSE]))


def _gappy(spark, folder):
    """Line items with related columns; a tenth of the totals is missing."""
    rows = fx.lineitem(spark, folder).withColumn("idx", row_key(*ROW))
    cut = ordering.hash_cut(rows, F.xxhash64("idx", F.lit(7)), ["idx"], F.floor(F.col("total") / 10))
    gone = ordering.below_cut(F.xxhash64("idx", F.lit(7)), ["idx"], cut)
    rows = rows.withColumn("charge", F.when(~gone, F.col("price") * (1 + F.col("tax"))))
    return rows.select("idx", "quantity", "price", "tax", "charge")


@query("im_forest")
def im_forest(spark, folder):
    """Imputed table of two related columns; both have gaps."""
    rows = _gappy(spark, folder)
    cut = ordering.hash_cut(rows, F.xxhash64("idx", F.lit(8)), ["idx"], F.floor(F.col("total") / 10))
    gone = ordering.below_cut(F.xxhash64("idx", F.lit(8)), ["idx"], cut)
    rows = rows.withColumn("price", F.when(~gone, F.col("price")))
    out, _ = impute.forest_impute(rows, ["price", "charge"], rounds=2, trees=5, depth=6)
    return round_doubles(out, 3)


@query("im_forest_col")
def im_forest_col(spark, folder):
    out, _ = impute.forest_impute_columns(_gappy(spark, folder), ["charge"], ["charge", "price", "quantity"], rounds=1, trees=5, depth=8)
    return round_doubles(out, 3)


@query("im_forest_subj")
def im_forest_subj(spark, folder):
    day = fx.sensor_day(spark, folder).select("num_id", "dt", "day", *fx.SENSORS, "all_mean")
    out = impute.forest_impute_subjects(day, [*fx.SENSORS, "all_mean"], min_observed=0.4, min_r2=0.0, rounds=2, trees=10)
    return round_doubles(out)


# -------------------------------------------------------------------- models


@query(
    "md_linreg",
    fx.with_views(fx.LINEITEM)
    + """SELECT 'intercept' AS term, round(regr_intercept(price, quantity), 4) AS estimate, round(regr_r2(price, quantity), 6) AS r2 FROM li
    UNION ALL SELECT 'quantity', round(regr_slope(price, quantity), 4), round(regr_r2(price, quantity), 6) FROM li""",
)
def md_linreg(spark, folder):
    out = models.linear_regression(fx.lineitem(spark, folder), ["quantity"], "price")
    return out.select("term", r6("estimate", 4).alias("estimate"), r6("r2").alias("r2"))


_PAST = "OVER (PARTITION BY num_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "md_walk_linear",
    fx.with_views(
        fx.SENSOR_DAY,
        f"""w AS (SELECT num_id, dt, ln(all_mean + 1) AS y, n_events, count(*) {_PAST} AS n, regr_slope(ln(all_mean + 1), n_events) {_PAST} AS b,
        regr_intercept(ln(all_mean + 1), n_events) {_PAST} AS a FROM sensor_day)""",
    )
    + "SELECT num_id, dt, round(y, 6) AS y, round(a + b * n_events, 6) + 0.0 AS prediction FROM w WHERE n >= 8 AND b IS NOT NULL AND NOT isnan(b)",
)
def md_walk_linear(spark, folder):
    day = fx.sensor_day(spark, folder).withColumn("log_mean", F.log(F.col("all_mean") + 1))
    return round_doubles(models.walk_forward_linear(day, "n_events", "log_mean"))


@query("md_walk")
def md_walk(spark, folder):
    day = fx.sensor_day(spark, folder)
    return round_doubles(models.walk_forward_subjects(day, ["n_events", "day"], "all_mean"))


@query("md_walk_metrics")
def md_walk_metrics(spark, folder):
    """Error of each subject's own walk."""
    day = fx.sensor_day(spark, folder)
    return round_doubles(walk.walk_metrics(models.walk_forward_subjects(day, ["n_events", "day"], "all_mean"), ["num_id"]))


@query("md_walk_stacked")
def md_walk_stacked(spark, folder):
    day = fx.sensor_day(spark, folder)
    return round_doubles(walk.walk_forward_stacked(day, ["n_events", "day"], "all_mean", "day", ["num_id", "dt"]).drop("day"))


@query("md_dt_reg")
def md_dt_reg(spark, folder):
    return round_doubles(models.tree_regressor(fx.lineitem(spark, folder), ["quantity", "discount", "tax"], "price", ROW, folds=3))


@query("md_dt_cls")
def md_dt_cls(spark, folder):
    return round_doubles(models.tree_classifier(fx.two_class(spark, folder), DOC, "y", ["doc_id"], folds=3))


@query("md_rf")
def md_rf(spark, folder):
    day = fx.sensor_day(spark, folder)
    return round_doubles(models.forest_tail(day, ["n_events", "day"], "all_mean", trees=20))


@query("md_mixed")
def md_mixed(spark, folder):
    return round_doubles(models.mixed_model(fx.sensor_day(spark, folder), ["n_events", "day"], "all_mean", "num_id"), 5)


@query("md_rlr")
def md_rlr(spark, folder):
    return round_doubles(resampled.randomized_logistic(fx.two_class(spark, folder), DOC, "y", ["doc_id"]))


@query("md_logit_subj")
def md_logit_subj(spark, folder):
    day = fx.sensor_day(spark, folder).withColumn("high", (F.col("all_mean") > 20).cast("int"))
    return round_doubles(models.logistic_subjects(day, ["n_events", "day"], "high", train=(0, 15), val=(16, 30)))


@query("md_svm")
def md_svm(spark, folder):
    rows = transform.standardize(fx.two_class(spark, folder), DOC).withColumn("y", 2 * F.col("y") - 1)
    parts = []
    for kernel in ("linear", "rbf"):
        model = models.train_svm(rows, DOC, "y", kernel, n_random=50, max_iter=30)
        hit = model.predict(rows).agg(F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("accuracy"))
        parts.append(hit.select(F.lit(kernel).alias("kernel"), r6("accuracy").alias("accuracy")))
    return parts[0].unionByName(parts[1])


@query(
    "md_knn",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, vec_id % 10 AS fold FROM embeddings),
    n AS (SELECT a.vec_id AS id, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rk FROM v a JOIN v b ON a.fold <> b.fold),
    t AS (SELECT id, lb, count(*) AS k FROM n WHERE rk <= 5 GROUP BY 1, 2)
    SELECT v.vec_id, v.label AS y, arg_max(lb, (k, -lb)) AS prediction FROM v LEFT JOIN t ON v.vec_id = t.id GROUP BY 1, 2""",
)
def md_knn(spark, folder):
    rows = vectors(spark, folder).withColumn("fold", F.col("vec_id") % 10)
    return models.knn_cross_predict(rows, "vec_id", "vec", "label", "fold", 5)


@query("md_ada")
def md_ada(spark, folder):
    return models.adaboost(fx.two_class(spark, folder), DOC, "y", ["doc_id"], rounds=4)[0]


@query("md_compare")
def md_compare(spark, folder):
    return round_doubles(models.compare_classifiers(fx.two_class(spark, folder), DOC, "y", ["doc_id"]))


@query("md_boost_search")
def md_boost_search(spark, folder):
    rows = splits.random_split(fx.two_class(spark, folder), ["doc_id"], test=0.2, val=0.0)
    axes = {"maxIter": [4, 6, 8], "maxDepth": [2, 3, 4], "stepSize": [0.05, 0.1, 0.2], "maxBins": [16, 32]}
    best, accuracy = models.boosting_search(rows.filter("split <> 'test'"), rows.filter("split = 'test'"), DOC, "y", ["doc_id"], axes, n_draws=2, folds=2)
    return round_doubles(spark.createDataFrame([(*best.values(), accuracy)], [*best, "accuracy"]))
