"""Every registered query against its SQL twin, or for rows where SQL cannot state it."""

import pytest

import __spark_entry__ as registered
import compare

QUERIES = registered.queries()
ORACLES = registered.oracle_sql()
# half an hour of model fits adds nothing to what test_models and test_cluster check
LONG = {"md_compare", "md_rlr", "im_forest", "im_forest_col", "im_forest_subj", "md_svm", "md_dt_cls", "cl_dbscan_sweep", "cl_stability", "md_walk", "md_walk_metrics"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query(spark, duck, folder, name):
    problem, rows = compare.difference(spark, duck, name, folder)
    if problem in ("no rows",) and rows == 0:
        pytest.skip("no rows at this scale")
    assert problem is None


def test_entry(spark):
    assert registered.entry(spark).columns[0] == "num_id"
