"""Operators that once did a part of their job."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge.operators import protocol
from test_queries import TABLES, rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def equal(spark, sf_dir, duck, name):
    """The query's rows, once they equal those of its SQL."""
    got, cursor = entry.queries()[name](spark, sf_dir), duck.execute(entry.oracle_sql()[name])
    columns, have = [d[0] for d in cursor.description], got.collect()
    assert sorted(got.columns) == sorted(columns) and have
    assert rows(got.columns, [tuple(r) for r in have]) == rows(columns, cursor.fetchall())
    return have


def test_each_side_has_its_own_cost(spark):
    ics = spark.createDataFrame([("a", k, v) for k, v in enumerate((0.1, -0.2, 0.3, 0.0))], "formula_id string, sess int, ic double")
    costs = spark.createDataFrame([("a", s, k, 0.001 if s < 0 else 0.003) for k in range(4) for s in (1, -1)], "formula_id string, sign int, sess int, cost double")
    windows = spark.createDataFrame([(1, 0, 0, 4)], "fold int, window int, lo int, hi int")
    got = protocol.score_candidates(ics, costs, windows).first()
    assert got.sign == -1 and abs(got.val_reward - (got.val_icir - 0.252)) < 1e-9
