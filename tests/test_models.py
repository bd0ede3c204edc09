import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import impute, models, transform


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for who in range(12):
        shift = rng.normal(0, 2)
        for day in range(int(rng.integers(9, 30))):
            x = float(rng.normal())
            rows.append((who, dt.date(2024, 1, 1) + dt.timedelta(days=day), day, x, float(1 + 2 * x + shift + rng.normal(0, 0.5))))
    return spark.createDataFrame(rows, "num_id int, dt date, day int, x double, y double").repartition(3)


def test_mixed_model_matches_dense_likelihood(panel):
    got = {r["term"]: r for r in models.mixed_model(panel, ["x"], "y", "num_id").collect()}
    pdf = panel.toPandas()
    X, y = np.column_stack([np.ones(len(pdf)), pdf["x"]]), pdf["y"].to_numpy()
    same = (pdf["num_id"].to_numpy()[:, None] == pdf["num_id"].to_numpy()[None, :]).astype(float)

    def reml(ratio):
        v = np.linalg.inv(np.eye(len(y)) + ratio * same)
        a = X.T @ v @ X
        beta = np.linalg.solve(a, X.T @ v @ y)
        r = y - X @ beta
        s2 = r @ v @ r / (len(y) - 2)
        return -0.5 * ((len(y) - 2) * (np.log(2 * np.pi * s2) + 1) - np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), beta, s2

    best = max(np.logspace(-2, 3, 4001), key=lambda r: reml(r)[0])
    loglik, beta, s2 = reml(best)
    assert got["x"]["estimate"] == pytest.approx(beta[1], abs=1e-4)
    assert got["intercept"]["estimate"] == pytest.approx(beta[0], abs=1e-3)
    assert got["x"]["residual_variance"] == pytest.approx(s2, rel=1e-3)
    assert got["x"]["loglik"] >= loglik - 1e-6


def test_walk_forward_uses_the_past_only(panel):
    full = models.walk_forward_linear(panel, "x", "y").toPandas()
    cut = full["dt"].max()
    changed = panel.withColumn("y", F.when(F.col("dt") == F.lit(cut), 1e6).otherwise(F.col("y")))
    again = models.walk_forward_linear(changed, "x", "y").toPandas()
    both = full.merge(again, on=["num_id", "dt"])
    assert np.allclose(both["prediction_x"], both["prediction_y"])


def test_forest_walk_forward_beats_the_mean(panel):
    out = models.walk_forward_subjects(panel, ["x"], "y", share=0.3, trees=20).toPandas()
    sizes = panel.groupBy("num_id").count().toPandas().set_index("num_id")["count"].sort_index()
    assert (out.groupby("num_id").size() == (sizes * 0.3).astype(int)).all()
    assert ((out["y"] - out["prediction"]) ** 2).mean() < out["y"].var()


def test_svm_kernels(spark):
    rng = np.random.default_rng(6)
    angle, radius = rng.uniform(0, 2 * np.pi, 200), np.repeat([0.5, 2.0], 100)
    rows = [(float(r * np.cos(a)), float(r * np.sin(a)), 1 if r > 1 else -1, 1 if np.cos(a) > 0 else -1) for a, r in zip(angle, radius)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, ring int, half int").coalesce(1)

    def hit(target, kernel):
        model = models.train_svm(df, ["x1", "x2"], target, kernel, n_random=60, max_iter=20)
        return model.predict(df).agg(F.avg((F.col("prediction") == F.col(target)).cast("int"))).first()[0]

    assert hit("ring", "rbf") > 0.95
    assert hit("half", "linear") > 0.95


def test_adaboost_improves_on_one_stump(spark):
    rows = [(i, float(i % 20), float(i // 20), int(5 <= i % 20 < 14)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    score = lambda n: models.adaboost(df, ["a", "b"], "y", ["id"], n)[0].agg(F.avg((F.col("y") == F.col("prediction")).cast("int"))).first()[0]
    assert score(5) > score(1)


def test_residuals_are_uncorrelated_with_covariates(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(u), float(v), float(3 + 2 * u - v + e), None if i % 9 == 0 else float(u * v)) for i, (u, v, e) in enumerate(zip(a, b, rng.normal(size=200)))]
    df = spark.createDataFrame(rows, "a double, b double, t double, s double")
    out = transform.regress_out(df, ["a", "b"])
    row = out.agg(F.covar_pop("a", "t"), F.covar_pop("b", "t"), F.covar_pop(F.when(F.col("s").isNotNull(), F.col("a")), "s"), F.avg("t")).first()
    assert np.allclose(row, 0, atol=1e-10)


def test_boxcox_finds_the_exponent(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(0, 0.5, 2000))], "v double")
    assert abs(transform.boxcox(df, ["v"])[1]["v"]) < 0.15


def test_components_match_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got, info = transform.principal_components(df, ["a", "b", "c", "d"], 2)
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    mine = got.toPandas().sort_values("id")[["PC1", "PC2"]].to_numpy()
    assert np.allclose(np.abs(mine), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    assert info["explained_variance"] == pytest.approx(list(s[:2] ** 2 / (s**2).sum()))
    vec = df.select("id", F.array("a", "b", "c", "d").alias("v"))
    same, _ = transform.vector_components(vec, "v", 2)
    assert np.allclose(np.stack(same.toPandas().sort_values("id")["scores"]), mine, atol=1e-8)


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(10)
    rows = []
    for i in range(600):
        a = float(rng.normal())
        rows.append((i, i % 8, a, None if rng.random() < 0.15 else 2 * a + float(rng.normal(0, 0.05)), None if rng.random() < 0.1 else -a, None))
    return spark.createDataFrame(rows, "idx int, num_id int, a double, b double, c double, gone double").repartition(3)


def test_mask_hides_an_exact_number_of_observed_cells(gappy):
    masked, mask = impute.mask_cells(gappy, ["a", "b", "c"], "idx", 0.1)
    before, after = gappy.toPandas().set_index("idx"), masked.toPandas().set_index("idx")
    hidden = mask.toPandas()
    assert len(hidden) == 180 and not hidden.duplicated(["idx", "variable"]).any()
    for _, r in hidden.iterrows():
        assert before.loc[r["idx"], r["variable"]] == r["value"] and np.isnan(after.loc[r["idx"], r["variable"]])
    assert before[["a", "b", "c"]].notna().sum().sum() - after[["a", "b", "c"]].notna().sum().sum() == 180


def test_forest_imputation(gappy):
    out, status = impute.forest_impute(gappy, ["a", "b", "c", "gone"], min_r2=0.5, rounds=2, trees=8, depth=6)
    row = status.first()
    assert row["status"] == "imputed" and row["r2"] > 0.5
    before, after = gappy.toPandas().set_index("idx"), out.toPandas().set_index("idx")
    assert after[["a", "b", "c"]].notna().all().all() and after["gone"].isna().all()
    seen = before["b"].notna()
    assert (before.loc[seen, "b"] == after["b"][before.index][seen]).all()
    same, status = impute.forest_impute(gappy, ["gone"])
    assert status.first()["status"] == "nothing to impute" and same.count() == 600


def test_subject_imputation_keeps_rows_and_observed_values(gappy):
    df = gappy.withColumn("dt", F.expr("date_add(date'2024-01-01', idx)"))
    out = impute.forest_impute_subjects(df, ["a", "b", "c"], min_r2=0.3, trees=15).toPandas().set_index("idx")
    before = gappy.toPandas().set_index("idx").loc[out.index]
    assert len(out) == 600 and out["imputed"].sum() > 0
    for c in ("a", "b", "c"):
        seen = before[c].notna()
        assert (before.loc[seen, c] == out.loc[seen, c]).all()
    assert out.loc[out["imputed"] == 1, ["a", "b", "c"]].notna().all().all()


def test_labels_need_not_be_codes(spark):
    rows = [(i, float(i % 2), float(i % 7), 2 * (i % 2) - 1) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    scored = models.adaboost(df, ["a", "b"], "y", ["k"], rounds=1)[0].collect()
    assert {r["y"] for r in scored} == {-1.0, 1.0} and all(r["y"] == r["prediction"] for r in scored)


def test_one_block_has_nothing_to_walk(spark):
    df = spark.createDataFrame([(i, 0, float(i), 1.0) for i in range(5)], "k long, week int, x double, y double")
    assert models.walk_forward_blocks(df, ["x"], "y", "week", 1, 2, ["k"]).count() == 0


def test_rows_that_share_a_key_are_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 2.0, 3.0), (2, None, 4.0)], "idx long, a double, b double")
    with pytest.raises(ValueError):
        impute.forest_impute(df, ["a", "b"])


@pytest.mark.parametrize("width", [2, 16])
def test_neighbours_equal_brute_force_with_ties(spark, monkeypatch, width):
    """Text ids, many equal points and blocks of several tiles."""
    from cohortflow.operators import distance

    monkeypatch.setattr(distance, "BLOCK_ROWS", 8)
    monkeypatch.setattr(distance, "LEAST_BLOCKS", 2)
    rng = np.random.default_rng(width)
    x, y, fold = rng.integers(0, 4 if width == 2 else 2, (150, width)).astype(float), rng.integers(0, 3, 150), np.arange(150) % 4
    ids = [f"p{i:03d}" for i in rng.permutation(150)]
    df = spark.createDataFrame([(ids[i], x[i].tolist(), int(y[i]), int(fold[i])) for i in range(150)], "item string, vec array<double>, y int, fold int")
    got = {r["item"]: r["prediction"] for r in models.knn_cross_predict(df, "item", "vec", "y", "fold", 5).collect()}
    for i in range(150):
        order = sorted((j for j in range(150) if fold[j] != fold[i]), key=lambda j: (np.square(x[i] - x[j]).sum(), ids[j]))[:5]
        votes = np.bincount(y[order], minlength=3)
        assert got[ids[i]] == votes.argmax()


def test_imputation_keeps_truth_and_guess_in_one_row(spark):
    rows = [(f"r{i}", i % 7, None if i % 9 == 0 else float(i % 50), None if i % 8 == 1 else 2.0 * (i % 50), None if i == 5 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "idx string, n long, a double, b double, c double")
    one, status = impute.forest_impute(df, ["a", "b"], rounds=1, trees=4, depth=5)
    two, report = impute.forest_impute_columns(df, ["a", "b"], ["a", "b", "c"], min_r2=-9.0, rounds=1, trees=4, depth=5)
    assert status.first()["status"] == "imputed" and [r["status"] for r in report.collect()] == ["imputed"] * 2
    for out in (one, two):
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r["idx"]: r for r in out.collect()}
        assert out.columns == df.columns and len(got) == 400 and got["r5"]["c"] is None
        assert all(r[2] == got[r[0]]["a"] for r in rows if r[2] is not None) and all(r["a"] is not None and r["b"] is not None for r in got.values())


def test_subject_imputation_does_not_depend_on_batches(spark):
    day, rng = dt.date(2024, 1, 1), np.random.default_rng(4)
    rows = [(s, day + dt.timedelta(d), float(d), float(rng.normal()) if d % 4 else None, float(d * s)) for s in range(9) for d in range(24)]
    panel = spark.createDataFrame(rows, "num_id long, dt date, a double, b double, c double")
    run = lambda: impute.forest_impute_subjects(panel, ["a", "b", "c"], min_r2=-9.0, trees=4, rounds=2)
    whole = sorted(run().collect())
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        cut = sorted(run().collect())
    finally:
        spark.conf.set(name, before)
    assert whole == cut and len(whole) == 9 * 24 and {r["imputed"] for r in whole} == {1.0}
    assert run().select(F.spark_partition_id()).distinct().count() > 1


def test_comparison_runs_the_whole_study(spark, monkeypatch):
    """All nine classifiers, ten folds, and learners of the study's size."""
    from cohortflow.plans import fixtures, q_models

    monkeypatch.setattr(fixtures, "two_class", lambda *_: spark.range(1))
    monkeypatch.setattr(q_models, "round_doubles", lambda x: x)
    asked = {}
    monkeypatch.setattr(models, "compare_classifiers", lambda *args, **more: asked.update(more))
    q_models.md_compare(spark, "nowhere")
    assert asked.get("folds", 10) == 10 and asked.get("models") is None
    own = models._learners(False, 1)
    assert own["forest"].getNumTrees() == 100 and own["boosting"].getMaxIter() == 100
    assert own["svm"].getMaxIter() == 1000 and own["logistic"].getMaxIter() == 2000
    assert {"logistic", "tree", "forest", "bagging", "svm", "boosting", "bayes"} == set(own)


def test_comparison_scores_every_fold(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 2))
    rows = [(i, float(a), float(b), int(a > 0.2)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    got = {r["model"]: r["accuracy"] for r in models.compare_classifiers(df, ["a", "b"], "y", ["k"], folds=3, models=["tree", "knn", "adaboost", "bayes"]).collect()}
    assert list(got) == ["tree", "knn", "adaboost", "bayes"] and all(0.8 < a <= 1 for a in got.values())


def test_shared_boosting_equals_plain_boosting(spark):
    """Each fold boosted by itself on plain arrays, three classes."""
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (150, 2)).astype(float)
    y = (x[:, 0] > 7).astype(int) + ((x[:, 1] > 5) & (x[:, 0] > 3)).astype(int)
    y = np.where(rng.random(150) < 0.15, rng.integers(0, 3, 150), y)
    fold = np.arange(150) % 3
    df = spark.createDataFrame([(x[i].tolist(), float(y[i]), int(fold[i])) for i in range(150)], "v array<double>, y double, fold int")
    got = models._adaboost_folds(df.withColumn("features", array_to_vector("v")).repartition(4), [0, 1, 2], 3, 6)
    hits = 0
    for f in range(3):
        a, b, own = x[fold != f], y[fold != f], np.ones((fold != f).sum())
        votes = np.zeros(((fold == f).sum(), 3))
        for _ in range(6):
            best = (-1.0, None)
            for k in range(2):
                for cut in np.unique(x[:, k])[:-1]:
                    left = a[:, k] <= cut
                    sides = [np.bincount(b[s], own[s], 3) for s in (left, ~left)]
                    if all(s.sum() > 0 for s in sides):
                        purity = sum((s**2).sum() / s.sum() for s in sides)
                        if purity > best[0] * (1 + 1e-12):
                            best = (purity, (k, cut, *(s.argmax() for s in sides)))
            k, cut, one, two = best[1]
            guess = np.where(a[:, k] <= cut, one, two)
            error = own[guess != b].sum() / own.sum()
            if error >= 1 - 1 / 3:
                break
            alpha = np.log((1 - error) / error) + np.log(2)
            own = own * np.where(guess != b, np.exp(alpha), 1)
            own *= len(own) / own.sum()
            t = x[fold == f]
            votes[np.arange(len(t)), np.where(t[:, k] <= cut, one, two)] += alpha
        hits += (votes.argmax(axis=1) == y[fold == f]).sum()
    assert got == pytest.approx(hits / 150)


def test_cells_find_the_nearest_of_all(spark, monkeypatch):
    """Small cells, many equal points, a fold that fills its own corner."""
    monkeypatch.setattr(models, "CELL_ROWS", 8)
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.integers(0, 9, (160, 3)).astype(float), np.zeros((40, 3)), rng.normal(30, 0.5, (40, 3))])
    y, fold = rng.integers(0, 3, 240), np.where(np.arange(240) < 200, np.arange(240) % 4, 9)
    ids = rng.permutation(240)
    df = spark.createDataFrame([(int(ids[i]), x[i].tolist(), int(y[i]), int(fold[i])) for i in range(240)], "item long, vec array<double>, y int, fold int")
    got = {r["item"]: r["prediction"] for r in models.knn_cross_predict(df, "item", "vec", "y", "fold", 5).collect()}
    assert len(got) == 240
    for i in range(240):
        order = sorted((j for j in range(240) if fold[j] != fold[i]), key=lambda j: (np.sqrt(np.square(x[i] - x[j]).sum()), ids[j]))[:5]
        assert got[ids[i]] == np.bincount(y[order], minlength=3).argmax()
