"""Codes of symbols with keys past a thousand."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge.operators import panel, returns
from panelforge.sources import fixtures


def test_large_keys_stay_on_their_board(spark):
    keys = [7, 999, 1_999, 2_380, 3_106, 88_002, 299_000, 301_000]
    got = spark.createDataFrame([(k,) for k in keys], "sym long").select("sym", returns.limit_rate(fixtures.code(F.col("sym"))).cast("double").alias("rate")).collect()
    assert {r.sym: r.rate for r in got} == {k: 0.2 if k % 3 == 1 else 0.1 for k in keys}


def test_a_key_that_reads_like_a_board(spark, sf_dir, monkeypatch):
    flags = spark.createDataFrame([(k, False) for k in (300, 301, 688, 6891)], "sym long, is_st boolean")
    monkeypatch.setattr(fixtures, "stocks", lambda *a: flags)
    monkeypatch.setattr(panel, "standard", lambda *a: flags.select("sym").crossJoin(fixtures.calendar(spark, sf_dir).select("dt")))
    got = entry.queries()["as_of_st_band"](spark, sf_dir).collect()
    assert got and {r.band for r in got} == {0.1}
