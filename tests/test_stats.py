import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions import scores, special
from cohortflow.functions.numeric import safe_corr
from cohortflow.operators import outliers, stats


def test_tails_match_published_values():
    assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_upper_quantile(0.025, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    # Kolmogorov: P(K > 1.3581) = 0.05
    assert special.ks_sf(1.3581 * np.sqrt(2 / 1000), 1000, 1000) == pytest.approx(0.05, abs=1e-4)
    assert outliers.grubbs_critical(10) == pytest.approx(2.290, abs=1e-3)
    assert outliers.grubbs_critical(20) == pytest.approx(2.709, abs=1e-3)


def naive_grubbs(values, alpha=0.05):
    left = list(values)
    while len(left) > 2:
        x = np.array(left)
        far = int(np.argmax(np.abs(x - x.mean())))
        sd = x.std(ddof=1)
        if sd == 0 or abs(x[far] - x.mean()) / sd <= outliers.grubbs_critical(len(x), alpha):
            break
        left.pop(far)
    return set(left)


@pytest.mark.parametrize("extremes", [2, 3, 256])
def test_grubbs_matches_stepwise_removal(spark, extremes):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 200).round(2), [9.0, 9.0, 14.0, -12.0, 30.0, 55.0]])
    df = spark.createDataFrame([(i, float(v), 1.0, None) for i, v in enumerate(x)], "id int, v double, flat double, gone double")
    got = outliers.null_grubbs_outliers(df, ["v", "flat", "gone"], extremes=extremes).toPandas()
    kept = naive_grubbs(x)
    assert set(got["v"].dropna()) == kept
    assert got["v"].isna().sum() == sum(v not in kept for v in x)
    assert got["flat"].notna().all()


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert df.agg(safe_corr("a", "b").alias("r")).first()["r"] is None


def test_subject_without_variation_is_left_out(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 5.0), (2, 2.0, 3.0), (3, 1.0, 1.0), (3, 2.0, 1.0)], "num_id int, a double, b double")
    got = {r["num_id"]: r["r"] for r in stats.subject_correlation(df, ["a", "b"]).collect()}
    assert got == {2: pytest.approx(-1.0), 3: 0.0}


def test_score_bands(spark):
    vals = [None, -1.0, 0.0, 2.5, 4.5, 5.0, 9.5, 10.5, 16.0, 27.0, 28.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = df.select(scores.cat_phq9("v"), scores.cat_gad("v"), scores.bin_phq9("v"), scores.bin_phq2("v"), scores.cat_alc("v")).collect()
    assert [r[0] for r in got] == [None, None, 0, 0, None, 1, None, 2, 3, 4, None]
    assert [r[1] for r in got] == [None, None, 0, 0, 0, 0, 1, None, 3, 3, 3]
    assert [r[2] for r in got] == [None, None, 0, 0, 0, 0, None, 1, 1, 1, 1]
    assert [r[3] for r in got] == [None, None, 0, None, 1, 1, 1, 1, 1, 1, 1]
    assert [r[4] for r in got] == [None, None, 0, 1, 2, 2, 3, 3, 3, 3, 3]


def test_cut_of_a_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [r["v_bin"] for r in scores.cut_equal_width(df, "v").collect()] == [3, 3, None]


def test_welch_and_kruskal_p_values(spark):
    a, b = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "c string, v double")
    row = stats.welch_test(df, "c", "v").first()
    se = np.sqrt(np.var(a, ddof=1) / 6 + np.var(b, ddof=1) / 6)
    assert row["t"] == pytest.approx((np.mean(a) - np.mean(b)) / se)
    assert 0.1 < row["p"] < 0.4
    h = stats.kruskal_wallis(df, "c", ["v"]).first()
    assert 0 < h["p"] < 1 and h["dof"] == 1


def test_auc_counts_ties_as_half(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert stats.auc(df, "y", "s").first()["auc"] == pytest.approx((1 + 1 + 0.5 + 1) / 4)
