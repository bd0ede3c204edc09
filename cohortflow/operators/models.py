"""Predictive models on panel features, evaluated without leakage between splits."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.small_forest import forests_predict
from ..session import cut_lineage, release
from .cells import in_cells, meetings
from .distance import SUMMED, block_pairs, map_pairs, paired
from .splits import kfold, random_split, tail_holdout
from .stats import auc, regression_metrics
from .timeline import require_panel, spread_subjects

# --------------------------------------------------------------------- trees


def _assembled(df: DataFrame, cols: list[str], target: str, keys: list[str]) -> DataFrame:
    rows = df.select(*keys, *cols, F.col(target).cast("double").alias("y")).na.drop(subset=[*cols, "y"])
    return VectorAssembler(inputCols=cols, outputCol="features").transform(rows).select(*keys, "features", "y")


def _cross_validated(estimator, train: DataFrame, keys: list[str], folds: int, evaluator, seed: int = 40) -> float:
    """Mean fold metric with folds fixed by the row key."""
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=[{}], evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=2
    )
    return float(cv.fit(kfold(train, keys, folds, seed)).avgMetrics[0])


def _scores(model, df: DataFrame) -> dict:
    row = regression_metrics(model.transform(df), "y", "prediction").first()
    return {"mae": row["mae"], "r2": row["r2"], "rows": row["n"]} if row else {"mae": None, "r2": None, "rows": 0}


def tree_regressor(df: DataFrame, cols: list[str], target: str, keys: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Depth-2 regression tree: cross-validated MSE on train, then MAE and R2 on test and validation."""
    data = random_split(_assembled(df, cols, target, keys), keys, test=0.15, val=0.2, seed=seed).persist()
    part = lambda name: data.filter(F.col("split") == name).drop("split")
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=2, minInstancesPerNode=2, seed=seed)
    cv = _cross_validated(tree, part("train"), keys, folds, RegressionEvaluator(labelCol="y", metricName="mse"))
    model = tree.fit(part("train"))
    rows = [(name, cv, *(_scores(model, part(name))[k] for k in ("mae", "r2", "rows"))) for name in ("test", "val")]
    return df.sparkSession.createDataFrame(rows, "split string, cv_mse double, mae double, r2 double, n_rows bigint")


def _class_codes(data: DataFrame) -> tuple[DataFrame, list[float]]:
    """Labels `y` replaced by 0..k-1 in their order, and the labels: learners need codes, tables may hold -1 and 1."""
    names = sorted(r["y"] for r in data.select("y").distinct().collect())
    if names == [float(i) for i in range(len(names))]:
        return data, names
    code = F.create_map(*[F.lit(x) for i, v in enumerate(names) for x in (v, float(i))]) if names else F.lit(None)
    return data.withColumn("y", code[F.col("y")] if names else F.col("y")), names


def _class_names(codes: list[float], column: str):
    return F.create_map(*[F.lit(x) for i, v in enumerate(codes) for x in (float(i), v)])[F.col(column)]


def balanced_weights(df: DataFrame, label: str = "y", out: str = "weight") -> DataFrame:
    """n / (classes * class size), as one small aggregate joined back."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    totals = sizes.agg(F.struct(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    weights = sizes.withColumn("_t", totals).select(label, (F.col("_t.n") / (F.col("_t.k") * F.col("_c"))).alias(out))
    return df.join(weights, label, "left")


def tree_classifier(df: DataFrame, cols: list[str], target: str, keys: list[str], folds: int = 5, seed: int = 42, impurity: str = "gini") -> DataFrame:
    """Depth-2 classification tree with balanced classes: CV MSE, then accuracy, MAE, R2 and AUC."""
    data = random_split(_assembled(df, cols, target, keys), keys, test=0.15, val=0.2, seed=seed).persist()
    part = lambda name: balanced_weights(data.filter(F.col("split") == name).drop("split"))
    train = part("train").persist()
    tree = DecisionTreeClassifier(
        featuresCol="features", labelCol="y", weightCol="weight", maxDepth=2, minInstancesPerNode=7, impurity=impurity, seed=seed
    )
    cv = _cross_validated(tree, train, keys, folds, RegressionEvaluator(labelCol="y", metricName="mse"))
    model = tree.fit(train)
    rows = []
    for name in ("test", "val"):
        scored = model.transform(part(name)).withColumn("score", vector_to_array("probability")[1]).persist()
        s = scored.agg(F.avg((F.col("y") == F.col("prediction")).cast("int")).alias("a")).first()["a"]
        m = regression_metrics(scored, "y", "prediction").first()
        rows.append((name, cv, s, m and m["mae"], m and m["r2"], auc(scored, "y", "score").first()["auc"]))
        scored.unpersist()
    return df.sparkSession.createDataFrame(rows, "split string, cv_mse double, accuracy double, mae double, r2 double, auc double")


def forest_tail(
    df: DataFrame, cols: list[str], target: str, date: str = "dt", tie: str = "num_id", share: float = 0.2, trees: int = 100,
    classify: bool = False, seed: int = 42,
) -> DataFrame:
    """Random forest fitted on the early rows; returns hold-out rows with their prediction."""
    data = tail_holdout(_assembled(df, cols, target, [date, tie]), date, tie, share=share).persist()
    kind = RandomForestClassifier if classify else RandomForestRegressor
    model = kind(featuresCol="features", labelCol="y", numTrees=trees, seed=seed).fit(data.filter("holdout = 0"))
    return model.transform(data.filter("holdout = 1")).select(date, tie, "y", "prediction")


# -------------------------------------------------------------- walk-forward


def walk_forward_subjects(
    panel: DataFrame, cols: list[str], target: str, share: float = 0.3, more_than: int = 8, trees: int = 500,
    key: str = "num_id", time: str = "dt", seed: int = 42,
) -> DataFrame:
    """Per subject: refit a forest on all earlier days and predict the next, over the last `share`.

    Panel rows per subject are bounded by the calendar, so one subject fits one task.
    """
    rows = panel.select(key, time, *[F.col(c).cast("double").alias(c) for c in cols], F.col(target).cast("double").alias("y"))
    require_panel(panel, key, time)
    rows = rows.na.drop(subset=[*cols, "y"])
    schema = StructType([rows.schema[key], rows.schema[time], StructField("y", DoubleType()), StructField("prediction", DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        pdf = pdf.sort_values(time)
        start = n - int(n * share)
        if n <= more_than:
            start = n
        x, y = pdf[cols].to_numpy(), pdf["y"].to_numpy()
        guess = forests_predict([(x[:i], y[:i], x[i : i + 1], seed + i) for i in range(start, n)], trees)
        return pdf.iloc[start:][[key, time, "y"]].assign(prediction=[float(g[0]) for g in guess])

    return spread_subjects(rows, key).groupBy(key).applyInPandas(one, schema)


def walk_forward_blocks(df: DataFrame, cols: list[str], target: str, block: str = "week", start: int = 1, trees: int = 50, keys: list[str] = ("num_id", "dt"), seed: int = 42) -> DataFrame:
    """All subjects stacked: for each block, a forest fitted on every earlier block predicts it."""
    keys = list(keys)
    data = _assembled(df, cols, target, [*keys, block]).persist()
    blocks = sorted(r[block] for r in data.select(block).distinct().collect())
    parts = []
    for b in blocks:
        train = data.filter(F.col(block) < b)
        if b < start or b == blocks[0]:
            continue
        model = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=trees, seed=seed).fit(train)
        parts.append(model.transform(data.filter(F.col(block) == b)).select(*keys, block, "y", "prediction"))
    if not parts:
        return data.select(*keys, block, "y", F.lit(None).cast("double").alias("prediction")).limit(0)
    return reduce(lambda a, b: a.unionByName(b), parts)


def walk_forward_linear(panel: DataFrame, x: str, target: str, key: str = "num_id", time: str = "dt", more_than: int = 8) -> DataFrame:
    """Expanding one-variable regression as running aggregates: every row is predicted from the
    subject's earlier rows, exactly, in one window."""
    past = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    rows = panel.na.drop(subset=[x, target])
    n = F.count(F.lit(1)).over(past)
    fitted = rows.withColumns(
        {"_n": n, "_b": F.regr_slope(target, x).over(past), "_a": F.regr_intercept(target, x).over(past)}
    )
    guess = F.col("_a") + F.col("_b") * F.col(x)
    return fitted.filter((F.col("_n") >= more_than) & F.col("_b").isNotNull()).select(key, time, F.col(target).alias("y"), guess.alias("prediction"))


# --------------------------------------------------------------- linear fits


def linear_regression(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Coefficients, intercept and R2 of ordinary least squares, one row per term."""
    data = _assembled(df, cols, target, [])
    model = LinearRegression(featuresCol="features", labelCol="y", solver="normal").fit(data)
    r2 = float(model.summary.r2)
    rows = [("intercept", float(model.intercept), r2)] + [(c, float(b), r2) for c, b in zip(cols, model.coefficients)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, r2 double")


def mixed_model(df: DataFrame, cols: list[str], target: str, group: str) -> DataFrame:
    """Random-intercept linear model by REML.

    Rows reduce to cross-products overall and to sums per group; sums of groups of equal size
    combine further, so what reaches the driver grows with the number of distinct group sizes, not
    with rows or groups. The variance ratio is then profiled on those sums.
    """
    names = ["intercept", *cols]
    rows = df.select(group, *[F.col(c).cast("double").alias(c) for c in cols], F.col(target).cast("double").alias("_y"))
    rows = rows.na.drop(subset=[*cols, "_y"]).withColumn("intercept", F.lit(1.0))
    every = [*names, "_y"]
    pairs = [(a, b) for i, a in enumerate(every) for b in every[i:]]
    per_group = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"s_{c}") for c in every],
        *[F.sum(F.col(a) * F.col(b)).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)],
    )
    sized = per_group.groupBy("_n").agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.sum(F.col(f"s_{a}") * F.col(f"s_{b}")).alias(f"o_{i}") for i, (a, b) in enumerate(pairs)],
        *[F.sum(f"c_{i}").alias(f"c_{i}") for i in range(len(pairs))],
    ).collect()

    def square(prefix, row):
        m = np.zeros((len(every), len(every)))
        for i, (a, b) in enumerate(pairs):
            m[every.index(a), every.index(b)] = m[every.index(b), every.index(a)] = row[f"{prefix}_{i}"]
        return m

    cross = sum(square("c", r) for r in sized)
    outer = [(r["_n"], r["groups"], square("o", r)) for r in sized]
    total, p = sum(n * g for n, g, _ in outer), len(names)

    def profile(ratio):
        m = cross - sum(ratio / (1 + n * ratio) * o for n, _, o in outer)
        beta = np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=None)[0]
        rss = m[p, p] - beta @ m[:p, p]
        sigma2 = max(rss, 1e-300) / (total - p)
        logdet = sum(g * np.log1p(n * ratio) for n, g, _ in outer)
        loglik = -0.5 * ((total - p) * (np.log(2 * np.pi * sigma2) + 1) + logdet + np.linalg.slogdet(m[:p, :p])[1])
        return loglik, beta, sigma2, m[:p, :p]

    decades = 4
    while True:  # further out while the best ratio is the largest tried
        grid = np.concatenate([[0.0], np.logspace(-6, decades, 20 * (decades + 6) + 1)])
        best = int(np.argmax([profile(r)[0] for r in grid]))
        if best < len(grid) - 1 or decades >= 12:
            break
        decades += 2
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    for _ in range(100):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if profile(a)[0] < profile(b)[0] else (low, b)
    ratio = max((low + high) / 2, 0.0)
    if profile(0.0)[0] >= profile(ratio)[0]:
        ratio = 0.0
    loglik, beta, sigma2, information = profile(ratio)
    errors = np.sqrt(np.diag(np.linalg.pinv(information)) * sigma2)
    out = [(n, float(b), float(e), float(sigma2), float(ratio * sigma2), float(loglik)) for n, b, e in zip(names, beta, errors)]
    return df.sparkSession.createDataFrame(
        out, "term string, estimate double, std_error double, residual_variance double, group_variance double, loglik double"
    )


def logistic_subjects(
    panel: DataFrame, cols: list[str], target: str, key: str = "num_id", train: tuple[int, int] = (0, 50), val: tuple[int, int] = (61, 80),
    day: str = "day", time: str = "dt", steps: int = 25, ridge: float = 1e-2,
) -> DataFrame:
    """One logistic unit per subject, fitted on train days and scored on validation days.

    Newton steps on at most one row per calendar day of a subject.
    """
    require_panel(panel, key, time)
    inputs = [f"_x{i}" for i in range(len(cols))]
    rows = panel.select(key, day, *[F.col(c).cast("double").alias(x) for c, x in zip(cols, inputs)], F.col(target).cast("double").alias("y"))
    rows = rows.na.drop(subset=[*inputs, "y"]).filter(F.col(day).between(*train) | F.col(day).between(*val))
    schema = StructType([
        rows.schema[key], StructField("train_rows", IntegerType()), StructField("val_rows", IntegerType()),
        StructField("accuracy", DoubleType()), StructField("loss", DoubleType()),
    ])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        early = pdf[day].between(*train)
        late = pdf[day].between(*val) & ~early
        x = pdf[inputs].to_numpy()
        mean, sd = x[early].mean(axis=0) if early.any() else 0.0, x[early].std(axis=0) if early.any() else 1.0
        x = np.column_stack([np.ones(len(x)), (x - mean) / np.where(sd == 0, 1.0, sd)])
        y, beta = pdf["y"].to_numpy(), np.zeros(x.shape[1])
        xt, yt = x[early], y[early]
        for _ in range(steps if len(xt) else 0):
            p = 1 / (1 + np.exp(-np.clip(xt @ beta, -30, 30)))
            hessian = xt.T @ (xt * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta))
            beta += np.linalg.solve(hessian, xt.T @ (yt - p) - ridge * beta)
        p = np.clip(1 / (1 + np.exp(-np.clip(x[late] @ beta, -30, 30))), 1e-12, 1 - 1e-12)
        yv = y[late]
        hit = float(((p >= 0.5) == (yv >= 0.5)).mean()) if len(yv) else None
        loss = float(-(yv * np.log(p) + (1 - yv) * np.log(1 - p)).mean()) if len(yv) else None
        return pd.DataFrame({key: [pdf[key].iloc[0]], "train_rows": [len(xt)], "val_rows": [len(yv)], "accuracy": [hit], "loss": [loss]})

    return rows.groupBy(key).applyInPandas(one, schema)


# ----------------------------------------------------- support vectors and kNN


class SupportVectorModel:
    """Predicts +-1 labels for rows with the training columns."""

    def __init__(self, model, features):
        self._model, self._features = model, features

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        scored = self._model.transform(self._features(df))
        return scored.withColumn(out, F.when(scored["_pred"] > 0, 1.0).otherwise(-1.0)).drop("features", "_pred", "_raw")


def train_svm(df: DataFrame, cols: list[str], target: str, kernel: str = "linear", c: float = 1.0, gamma: float = 0.5, n_random: int = 200, max_iter: int = 100, seed: int = 42) -> SupportVectorModel:
    """Soft-margin classifier for +-1 labels; `rbf` maps rows to random Fourier features first
    (Rahimi and Recht 2007), so training stays linear in the number of rows."""
    assembler = VectorAssembler(inputCols=cols, outputCol="features")
    if kernel == "linear":
        features = assembler.transform
    elif kernel == "rbf":
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, np.sqrt(2 * gamma), (len(cols), n_random))
        shift = rng.uniform(0, 2 * np.pi, n_random)

        @F.pandas_udf(ArrayType(DoubleType()))
        def waves(x: pd.DataFrame) -> pd.Series:
            return pd.Series(list(np.sqrt(2.0 / n_random) * np.cos(x.to_numpy(float) @ w + shift)))

        def features(rows: DataFrame) -> DataFrame:
            inputs = F.struct(*[F.col(c).cast("double").alias(c) for c in cols])
            return rows.withColumn("features", array_to_vector(waves(inputs)))

    else:
        raise ValueError(f"unknown kernel {kernel}")
    rows = df.na.drop(subset=[*cols, target]).withColumn("_y", (F.col(target) > 0).cast("double"))
    ready = features(rows).select("features", "_y").persist()
    n = ready.count()
    svc = LinearSVC(featuresCol="features", labelCol="_y", predictionCol="_pred", rawPredictionCol="_raw", regParam=1.0 / (n * c), maxIter=max_iter)
    model = svc.fit(ready)
    ready.unpersist()
    return SupportVectorModel(model, features)


def knn_cross_predict(points: DataFrame, id_col: str, vec: str, label: str, fold: str, k: int = 5, metric: str = "euclidean") -> DataFrame:
    """Each point classified by its k nearest points of other folds.

    Equal distances go to the smaller id, equal votes to the smaller label. All distances are taken roughly, those up to the k-th
    smallest exactly. Vectors of at most `CELL_DIMS` numbers meet in cells (see `_cell_candidates`); longer ones meet all others in
    block pairs, which return k candidates per point and block, merged by rank.
    """
    rows = points.withColumns({"_label": F.col(label).cast("int"), "_fold": F.col(fold).cast("int"), "_v": F.col(vec).cast("array<double>")})
    out = [F.col(id_col), F.col("_label").alias("y")]
    dim = rows.filter(F.col("_v").isNotNull()).select(F.size("_v").alias("d")).first()
    if metric == "euclidean" and dim and 0 < dim["d"] <= CELL_DIMS:
        return _cell_predict(rows, id_col, k, out)
    kind = points.schema[id_col].dataType
    schema = StructType([StructField("id", kind), StructField("near", kind), StructField("label", IntegerType()), StructField("dist", DoubleType())])
    nearest = _nearest(k, metric)

    def work(a, b, same):
        one_way = lambda a, b: nearest(a.ids, a.v, a.column("_fold"), b.ids, b.v, b.column("_fold"), b.column("_label"))
        return one_way(a, b) if same else tuple(np.concatenate(x) for x in zip(one_way(a, b), one_way(b, a)))

    candidates = map_pairs(block_pairs(rows, id_col, vec, carried=["_label", "_fold"]), [], schema, work, tiled=False)
    winner = _winners(candidates, k)
    return rows.select(*out).join(winner, rows[id_col] == winner["id"], "left").drop("id")


def _nearest(k: int, metric: str):
    """(id, near, label, dist) of the k nearest points, of other folds, for every asking point."""
    measure = SUMMED[metric]

    def nearest(ids, v, own, others, there, other, label):
        _, rank = np.unique(others, return_inverse=True)  # ids may be texts
        step, out = max(1, (1 << 21) // len(others)), []
        for at in range(0, len(ids), step):
            some = slice(at, at + step)
            d = measure(v[some], there)
            d[own[some, None] == other] = np.inf
            last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
            i, j = np.nonzero((d <= last[:, None] * (1 + 1e-6)) & np.isfinite(d))
            dist = paired(metric, v[i + at], there[j])
            order = np.lexsort((rank[j], dist, i))
            i, j, dist = i[order], j[order], dist[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[first] + at, j[first]
            out.append((ids[i], others[j], label[j], dist[first]))
        return tuple(np.concatenate(x) for x in zip(*out))

    return nearest


def _first(candidates: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "near"))
    return candidates.withColumn("_rk", rank).filter(F.col("_rk") <= k)


def _winners(candidates: DataFrame, k: int) -> DataFrame:
    """(id, prediction) from some candidates of each point, the k nearest among them."""
    votes = _first(candidates, k).groupBy("id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("prediction"))


CELL_DIMS = 6  # longer vectors are about as far from most others: cells would not tell them apart
CELL_ROWS = 1024


def _cell_predict(rows: DataFrame, id_col: str, k: int, out: list) -> DataFrame:
    """Nearest points by cells. Rows of one vector and fold share their answer, and only the k smallest ids of them can be an answer."""
    rank = F.row_number().over(Window.partitionBy("_v", "_fold").orderBy("_key", "_label"))
    used = rows.select("_v", "_fold", F.col(id_col).alias("_key"), "_label").filter(F.col("_v").isNotNull()).withColumn("_rk", rank).filter(F.col("_rk") <= k)
    used = cut_lineage(used.withColumn("_no", F.monotonically_increasing_id()))
    winner = _winners(_cell_candidates(used, k), k)
    asked = used.filter("_rk = 1").select("_v", "_fold", F.col("_no").alias("id")).join(winner, "id", "left").drop("id")
    return rows.join(asked, ["_v", "_fold"], "left").select(*out, "prediction")


def _cell_candidates(used: DataFrame, k: int) -> DataFrame:
    """(id, near, label, dist): among others the k nearest points of other folds for every row with `_rk` 1, whose `_no` is id.

    The nearest in its own cell bound a point's search; it visits the other cells that reach into that bound, its edge
    included, so equal distances are all seen.
    """
    schema = StructType([StructField("id", LongType()), StructField("near", used.schema["_key"].dataType), StructField("label", IntegerType()), StructField("dist", DoubleType())])
    placed, cells = in_cells(used, "_v", CELL_ROWS)
    asking = placed.filter("_rk = 1").drop("_key", "_label", "_rk")
    carried = ["_fold", "_label", "_key"]
    nearest = _nearest(k, "euclidean")

    def work(a, b, same):
        return nearest(a.ids, a.v, a.column("_fold"), b.column("_key"), b.v, b.column("_fold"), b.column("_label"))

    def met(visitors: DataFrame) -> DataFrame:
        return cut_lineage(map_pairs(meetings(visitors, placed, "_cell", "_no", "_v", ["_fold"], carried), [], schema, work, tiled=False))

    own = met(asking)
    bound = _first(own, k).groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("_far"))
    further = asking.join(bound.withColumnRenamed("id", "_no"), "_no", "left").withColumn("_far", F.coalesce("_far", F.lit(float("inf"))))
    return own.unionByName(met(cells.visits(further, "_v", "_far")))


# ------------------------------------------------------------------ ensembles


def adaboost(df: DataFrame, cols: list[str], target: str, keys: list[str], rounds: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """SAMME boosting of depth-1 trees; (rows with prediction, round report).

    Every round fits one weighted tree; the weight update is a column expression.
    """
    data, names = _class_codes(_assembled(df, cols, target, keys))
    classes = len(names)
    current = cut_lineage(data.withColumns({"weight": F.lit(1.0), **{f"_vote_{c}": F.lit(0.0) for c in range(classes)}}))
    report = []
    for r in range(rounds):
        stump = DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxDepth=1, seed=seed + r, predictionCol="_p", rawPredictionCol="_raw", probabilityCol="_prob")
        scored = stump.fit(current).transform(current)
        wrong = F.col("_p") != F.col("y")
        stats = scored.agg((F.sum(F.when(wrong, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("e"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
        error = min(max(stats["e"], 1e-10), 1.0)
        if error >= 1 - 1 / classes:
            break
        alpha = float(np.log((1 - error) / error) + np.log(classes - 1)) if classes > 1 else 0.0
        report.append((r, float(error), alpha))
        scale = stats["n"] / (stats["w"] * (1 - error) + stats["w"] * error * np.exp(alpha))
        update = {"weight": F.col("weight") * F.when(wrong, float(np.exp(alpha))).otherwise(1.0) * float(scale)}
        votes = {f"_vote_{c}": F.col(f"_vote_{c}") + F.when(F.col("_p") == c, alpha).otherwise(0.0) for c in range(classes)}
        before, current = current, cut_lineage(scored.withColumns({**update, **votes}).drop("_p", "_raw", "_prob"))
        release(before)
        if error <= 1e-10:
            break
    best = F.greatest(*[F.struct(F.col(f"_vote_{c}").alias("v"), F.lit(-c).alias("c")) for c in range(classes)]) if classes > 1 else F.struct(F.lit(0).alias("c"))
    out = current.withColumn("prediction", (-best["c"]).cast("double")).select(*keys, "y", "prediction")
    if names != [float(i) for i in range(classes)]:
        out = out.withColumns({c: _class_names(names, c) for c in ("y", "prediction")})
    return out, df.sparkSession.createDataFrame(report, "round int, error double, alpha double")


FIT_ROWS = 50_000  # rows of a partition that learners read again and again
FITS = 6  # models fitted side by side
STUMP_BINS = 32


def _best_stump(hist: np.ndarray) -> tuple[int, int, int, int, float, float]:
    """(feature, cut, left class, right class, error, weight) of the split with the least Gini impurity; hist: features x bins x classes.

    Feature -1: no split separates anything, all rows get the left class.
    """
    left = hist.cumsum(axis=1)
    every = left[0, -1]
    right = every - left
    weight = every.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = (left**2).sum(axis=2) / left.sum(axis=2) + (right**2).sum(axis=2) / right.sum(axis=2)
    purity = np.where((left.sum(axis=2) > 0) & (right.sum(axis=2) > 1e-12 * weight), purity, -np.inf)
    f, cut = np.unravel_index(int(purity.argmax()), purity.shape)
    if not weight or purity[f, cut] <= (every**2).sum() / weight * (1 + 1e-12):
        c = int(every.argmax())
        return -1, 0, c, c, 1 - every[c] / weight if weight else 1.0, weight
    one, two = int(left[f, cut].argmax()), int(right[f, cut].argmax())
    return int(f), int(cut), one, two, 1 - (left[f, cut, one] + right[f, cut, two]) / weight, weight


def _stump_says(bins: np.ndarray, stump) -> np.ndarray:
    f, cut, one, two = stump[:4]
    return np.where(bins[:, f] <= cut, one, two) if f >= 0 else np.full(len(bins), one)


def _adaboost_folds(data: DataFrame, held: list[int], classes: int, rounds: int) -> float | None:
    """Accuracy of SAMME boosting of depth-1 trees, each fold boosted on the rows of the others; a round is one scan for all folds.

    A stump sees 32 quantile bins of a feature, so rows of equal bins, label and fold share their weights: they are counted once.
    What reaches the driver are weights by fold, feature, bin and class.
    """
    x = vector_to_array("features")
    dim = data.select(F.size(x).alias("d")).first()["d"]
    marks = F.array(*[F.lit(i / STUMP_BINS) for i in range(1, STUMP_BINS)])
    found = data.agg(*[F.percentile_approx(x[i], marks, F.lit(10000)).alias(f"q{i}") for i in range(dim)]).first()
    edges = [np.unique(found[f"q{i}"]) for i in range(dim)]

    @F.pandas_udf("array<int>")
    def binned(v: pd.Series) -> pd.Series:
        rows = np.array(v.tolist(), float).reshape(len(v), -1)
        return pd.Series(list(np.stack([np.searchsorted(e, rows[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype("int32")))

    counted = data.select(binned(x).alias("b"), F.col("y").cast("int").alias("y"), "fold").groupBy("b", "y", "fold").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = cut_lineage(counted)
    cells = cells.repartition(max(1, -(-cells.count() // FIT_ROWS)), "b", "y", "fold").persist()

    def summed(work, length: int) -> np.ndarray:
        def partial(frames):
            total = np.zeros(length)
            for f in frames:
                if len(f):
                    work(np.array(f["b"].tolist(), int).reshape(len(f), -1), f["y"].to_numpy(int), f["fold"].to_numpy(int), f["n"].to_numpy(float), total)
            yield pd.DataFrame({"h": [total]})

        return np.sum([r["h"] for r in cells.mapInPandas(partial, "h array<double>").collect()], axis=0)

    stumps: dict[int, list[tuple]] = {f: [] for f in held}  # (feature, cut, left, right, alpha, scale)
    active, sizes = list(held), {}
    width = dim * STUMP_BINS * classes
    for _ in range(rounds):

        def weighed(b, y, fold, n, total):
            for i, f in enumerate(active):
                own = fold != f
                w, mine, label = n[own].copy(), b[own], y[own]
                for stump in stumps[f]:
                    w *= np.where(_stump_says(mine, stump) != label, np.exp(stump[4]), 1.0) * stump[5]
                for k in range(dim):
                    at = (k * STUMP_BINS + mine[:, k]) * classes + label
                    total[i * width : (i + 1) * width] += np.bincount(at, w, width)

        hists = summed(weighed, len(active) * width).reshape(len(active), dim, STUMP_BINS, classes)
        rest = []
        for f, hist in zip(active, hists):
            *split, error, weight = _best_stump(hist)
            sizes.setdefault(f, weight)
            error = min(max(error, 1e-10), 1.0)
            if error >= 1 - 1 / classes:
                continue
            alpha = float(np.log((1 - error) / error) + np.log(classes - 1)) if classes > 1 else 0.0
            stumps[f].append((*split, alpha, sizes[f] / (weight * (1 - error) + weight * error * np.exp(alpha))))
            if error > 1e-10:
                rest.append(f)
        active = rest
        if not active:
            break

    def hits(b, y, fold, n, total):
        for f in held:
            own = fold == f
            votes = np.zeros((own.sum(), classes))
            for stump in stumps[f]:
                votes[np.arange(len(votes)), _stump_says(b[own], stump)] += stump[4]
            total += [n[own][votes.argmax(axis=1) == y[own]].sum(), n[own].sum()]

    right, total = summed(hits, 2) if held else (0.0, 0.0)
    cells.unpersist()
    return right / total if total else None


def _neighbour_accuracy(data: DataFrame, keys: list[str]) -> float | None:
    """Share of the rows that the five nearest rows of other folds name rightly."""
    placed = StandardScaler(inputCol="features", outputCol="_z", withMean=True).fit(data).transform(data)
    # the row's own key, not a hash of it: equal numbers would merge rows
    placed = placed.select(vector_to_array("_z").alias("_vec"), F.to_json(F.struct(*keys)).alias("_row"), "y", "fold")
    guessed = knn_cross_predict(placed, "_row", "_vec", "y", "fold", 5)
    return guessed.agg(F.avg((F.col("y") == F.col("prediction")).cast("int")).alias("a")).first()["a"]


def _learners(many: bool, seed: int) -> dict:
    rest = lambda est: OneVsRest(classifier=est, labelCol="y") if many else est.setLabelCol("y")
    return {
        "logistic": LogisticRegression(labelCol="y", maxIter=2000),
        "tree": DecisionTreeClassifier(labelCol="y", seed=seed),
        "forest": RandomForestClassifier(labelCol="y", numTrees=100, seed=seed),
        "bagging": RandomForestClassifier(labelCol="y", numTrees=10, featureSubsetStrategy="all", seed=seed),
        "svm": rest(LinearSVC(maxIter=1000)),
        "boosting": rest(GBTClassifier(maxIter=100, maxDepth=3, seed=seed)),
        "bayes": NaiveBayes(labelCol="y", modelType="gaussian"),
    }


def compare_classifiers(
    df: DataFrame, cols: list[str], target: str, keys: list[str], folds: int = 10, models: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """Cross-validated accuracy of several classifiers on the same folds: the mean over the folds that have rows.

    Sizes are the study's: 100 trees, 10 bagged trees, 100 boosting rounds of depth 3, 50 rounds of AdaBoost, and linear models run
    until they rest (at most 2,000 and 1,000 steps). Fits of all folds run side by side.
    """
    data, names = _class_codes(cut_lineage(_assembled(df, cols, target, keys)))
    rows = data.count()
    # few rows in many partitions would be work for the scheduler only; the order makes draws the same in every run
    data = kfold(data, keys, folds, seed).repartition(max(1, -(-rows // FIT_ROWS)), *keys).sortWithinPartitions(*keys, "y").persist()
    held = [r["fold"] for r in data.select("fold").distinct().orderBy("fold").collect()]
    classes = len(names)
    known = _learners(classes > 2, seed)

    def scored(name: str, fold: int | None) -> float | None:
        if name == "knn":
            return _neighbour_accuracy(data, keys)
        if name == "adaboost":
            return _adaboost_folds(data, held, classes, 50)
        model = known[name].copy().fit(data.filter(F.col("fold") != fold))
        return model.transform(data.filter(F.col("fold") == fold)).agg(F.avg((F.col("y") == F.col("prediction")).cast("int")).alias("a")).first()["a"]

    chosen = models or [*known, "knn", "adaboost"]
    # a fold's models stand next to each other: what runs at a time are different kinds, not ten forests
    folded = sorted((name for name in chosen if name in known), key=lambda name: name not in ("boosting", "svm"))
    jobs = [*((name, None) for name in chosen if name not in known), *((name, fold) for fold in held for name in folded)]
    with ThreadPoolExecutor(FITS) as pool:
        found = dict(zip(jobs, pool.map(lambda job: scored(*job), jobs)))
    data.unpersist()
    out = []
    for name in chosen:
        scores = [found[name, fold] for fold in (held if name in known else [None])]
        out.append((name, float(np.mean(scores)) if scores and None not in scores else None))
    return df.sparkSession.createDataFrame(out, "model string, accuracy double")


def boosting_search(
    train: DataFrame, test: DataFrame, cols: list[str], target: str, keys: list[str], axes: dict[str, list], n_draws: int = 100, folds: int = 5, seed: int = 42
) -> tuple[dict, float]:
    """Random search over boosting parameters; (best parameters, accuracy on test).

    `axes` names parameters of the tree booster: maxIter, stepSize, maxDepth, maxBins, subsamplingRate.
    """
    both = _assembled(train.withColumn("_test", F.lit(0)).unionByName(test.withColumn("_test", F.lit(1))), cols, target, [*keys, "_test"])
    coded, names = _class_codes(cut_lineage(both))
    data = kfold(coded.filter("_test = 0"), keys, folds, seed).persist()
    classes = len(names)
    booster = GBTClassifier(labelCol="y", seed=seed)
    rng = random.Random(seed)
    draws = [{name: rng.choice(values) for name, values in axes.items()} for _ in range(n_draws)]
    evaluator = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    if classes > 2:
        # parameters of the inner booster are set per draw on a copy
        maps = []
        estimator = OneVsRest(labelCol="y", classifier=booster)
        for draw in draws:
            inner = booster.copy({booster.getParam(k): v for k, v in draw.items()})
            maps.append({estimator.classifier: inner})
    else:
        estimator = booster
        maps = [{booster.getParam(k): v for k, v in draw.items()} for draw in draws]
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=4)
    fitted = cv.fit(data)
    best = int(np.argmax(fitted.avgMetrics))
    accuracy = evaluator.evaluate(fitted.bestModel.transform(coded.filter("_test = 1")))
    data.unpersist()
    return {**draws[best], "cv_accuracy": float(fitted.avgMetrics[best])}, float(accuracy)
