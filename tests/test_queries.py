"""Every registered query with SQL gives the rows of that SQL; the others keep their invariants."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check import compare
from tidemark.plans import regime_queries

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, folder, name):
    line = compare(spark, name, folder)
    assert line.startswith("ok"), line


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    result = contract.entry(spark)
    assert result.count() == 6 and "mean_balanced_accuracy" in result.columns


def test_hash_sample_is_repeatable(spark, folder):
    first, second = (QUERIES["hash_sample"](spark, folder) for _ in range(2))
    assert first.exceptAll(second).count() == 0
    share = first.count() / spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert 0.07 < share < 0.13


def test_walkforward_model(spark, folder):
    rows = regime_queries.block_results(spark, folder)[0].collect()
    assert rows
    for r in rows:
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == r["n_test"]
        assert 0 <= r["balanced_accuracy"] <= 1 and r["n_features"] == 40
        assert 0.05 <= r["threshold"] <= 0.95


def test_permutation_importance(spark, folder):
    rows = regime_queries.importances(spark, folder).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 7))
    assert all(a["importance"] >= b["importance"] for a, b in zip(rows, rows[1:]))


def test_regimes(spark, folder):
    labelled = regime_queries.change_labels(spark, folder)
    assert {r[0] for r in labelled.select("cluster").distinct().collect()} == set(range(7))
    joined = regime_queries.with_regimes(spark, folder)
    assert joined.count() == labelled.count() and joined.where(F.col("regime").isNull()).count() == 0
