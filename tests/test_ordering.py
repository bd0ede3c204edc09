import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import encoding, ordering, splits


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and one value repeats in a third of them."""
    rng = np.random.default_rng(1)
    rows = [(0 if rng.random() < 0.7 else int(rng.integers(1, 5)), 5.0 if rng.random() < 0.33 else float(rng.integers(0, 400)) / 4) for _ in range(3000)]
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "id long, k int, v double").repartition(5)


@pytest.mark.parametrize("split_rows", [10, 100, 10**6])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_quantiles(skewed, keys, split_rows):
    pdf = skewed.toPandas()
    got = ordering.exact_quantiles(skewed, keys, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0], split_rows).collect()
    for row in got:
        want = pdf if not keys else pdf[pdf.k == row["k"]]
        assert np.allclose(row["q"], np.quantile(want["v"], [0, 0.25, 0.5, 0.9, 1]))
    assert len(got) == (5 if keys else 1)


@pytest.mark.parametrize("split_rows", [10, 10**6])
def test_position(skewed, split_rows):
    got = ordering.position(skewed, ["k"], "v", ["id"], split_rows=split_rows).toPandas()
    want = got.sort_values(["k", "v", "id"]).groupby("k").cumcount() + 1
    assert (got.sort_values(["k", "v", "id"])["position"].to_numpy() == want.to_numpy()).all()


def test_global_position(skewed):
    dated = skewed.withColumn("d", F.expr("date_add(date'2024-01-01', k)"))
    got = ordering.global_position(dated, "d", "id").toPandas().sort_values(["d", "id"])
    assert (got["position"].to_numpy() == np.arange(1, len(got) + 1)).all()


@pytest.mark.parametrize("count", [0, 1, 777, 3000, 5000])
def test_hash_cut_is_exact(skewed, count):
    h = F.xxhash64("id", F.lit(3))
    cut = ordering.hash_cut(skewed, h, ["id"], F.lit(count))
    taken = skewed.filter(ordering.below_cut(h, ["id"], cut))
    ids = {r["id"] for r in taken.collect()}
    assert len(ids) == min(count, 3000)
    again = skewed.repartition(17)
    cut = ordering.hash_cut(again, h, ["id"], F.lit(count))
    assert ids == {r["id"] for r in again.filter(ordering.below_cut(h, ["id"], cut)).collect()}


def test_group_split_keeps_subjects_whole(skewed):
    rows = skewed.withColumn("num_id", F.col("id") % 40)
    tagged = splits.group_split(rows).select("num_id", "split").distinct().toPandas()
    assert tagged["num_id"].is_unique and len(tagged) == 40
    assert tagged["split"].value_counts().to_dict() == {"train": 27, "val": 7, "test": 6}


def test_label_codes_handle_long_and_missing_values(spark):
    values = ["b", "a", None, "prefix-same-0", "prefix-same-1", "é", "", "Z"]
    df = spark.createDataFrame([(v,) for v in values * 3], "c string")
    codes = {r["value"]: r["code"] for r in encoding.label_codes(df, "c").collect()}
    known = sorted((v for v in set(values) if v is not None), key=lambda s: s.encode())
    assert codes == {**{v: i for i, v in enumerate(known)}, None: len(known)}


def test_tail_holdout_of_an_exact_size(skewed):
    dated = skewed.withColumn("d", F.expr("date_add(date'2024-01-01', k)"))
    got = splits.tail_holdout(dated, "d", "id", rows=10).toPandas().sort_values(["d", "id"])
    assert got["holdout"].tolist() == [0] * 2990 + [1] * 10


def test_a_value_in_most_rows_is_cut_by_its_ties(spark, monkeypatch):
    rows = [(i, 5.0 if i % 4 else float(i % 40)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(4)
    got = ordering.position(df, [], "v", ["id"], split_rows=50).toPandas().sort_values(["v", "id"])
    assert (got["position"].to_numpy() == np.arange(1, 2001)).all()
    seen = []
    whole = ordering._totals_by_range

    def watched(frame, keys, order, *rest):
        seen.append(frame.groupBy(*keys, order).count().agg(F.max("count")).first()[0] if order == "v" else 0)
        return whole(frame, keys, order, *rest)

    monkeypatch.setattr(ordering, "_totals_by_range", watched)
    ordering.position(df, [], "v", ["id"], split_rows=50)
    assert max(seen) <= 50


def test_text_position_deals_out_common_prefixes(spark):
    values = [f"https://example.org/{i * 7919 % 5000:05d}" for i in range(5000)] + ["", "é", "z"]
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(6)
    codes = {r["value"]: r["code"] for r in encoding.label_codes(df, "value").collect()}
    assert codes == {v: i for i, v in enumerate(sorted(values, key=lambda v: v.encode()))}
