"""Sources and sinks, and what the physical plans must (not) contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from cohortflow.operators import features, joins
from cohortflow.plans import fixtures as fx
from cohortflow.sources import tables, variables


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_round_trip_turns_nan_into_null(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, float("nan")), (3, None)], "num_id int, v double")
    path = tables.save_table(df, str(tmp_path), "panel", fmt="csv")
    back = tables.read_csv(spark, path, "num_id int, v double")
    assert sorted((r["num_id"], r["v"]) for r in back.collect() if r["v"] is not None) == [(1, 2.5)]
    assert back.count() == 3


def test_json_and_fallback(spark, tmp_path):
    path = tables.save_json_row(spark, {"depth": 3, "accuracy": 0.5}, str(tmp_path), "best")
    assert spark.read.json(path).first()["accuracy"] == 0.5
    kept = tables.save_table(spark.range(3), str(tmp_path), "v1_day_scaled")
    assert tables.read_first_existing(spark, [str(tmp_path / "v1_day_pca"), kept]).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_first_existing(spark, [str(tmp_path / "none")])


def test_partitioned_datasets_are_pruned(spark, tmp_path):
    both = tables.union_datasets({"v1_day": spark.range(3), "v2_day": spark.range(5)})
    path = tables.save_table(both, str(tmp_path), "all", partition_by=["dataset"])
    one = spark.read.parquet(path).filter("dataset = 'v2_day'")
    assert one.count() == 5 and "PartitionFilters: [isnotnull(dataset" in physical(one)


def test_groups_only_take_present_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "num_id int, phq2_1 int, other int")
    assert variables.select_group(df, "id", "phq2").columns == ["num_id", "phq2_1"]


def test_wide_adds_one_shuffle_and_prunes_columns(spark, folder):
    day = fx.sensor_day(spark, folder).withColumn("unused", F.rand())
    panel_path = physical(day).count("Exchange")
    plan = physical(features.wide_features(day, ["all_mean"]))
    assert plan.count("Exchange") <= panel_path + 1 and "rand(" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_range_filter_reaches_the_scan(spark, folder):
    plan = physical(registered.queries()["flt_range"](spark, folder))
    assert re.search(r"PushedFilters: \[IsNotNull\(l_quantity\), GreaterThanOrEqual", plan)
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan


def test_outer_join_chain_is_one_shuffle(spark):
    parts = [spark.range(10).select(F.col("id").alias("k"), F.lit(i).alias(f"c{i}")) for i in range(5)]
    plan = physical(joins.outer_join_all(parts, ["k"]))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_sql_operators_use_no_python(spark, folder):
    for name in ("ts_same_day", "ts_lag_raw", "st_subj_corr", "ag_box", "st_kruskal", "cl_comember", "sc_standard", "imp_coverage"):
        plan = physical(registered.queries()[name](spark, folder))
        assert "Python" not in plan and "Arrow" not in plan, name
