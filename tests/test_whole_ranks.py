"""Rank coefficients of sessions with many symbols."""

from pyspark.sql import functions as F

from panelforge.operators import quality


def test_a_constant_signal_has_no_coefficient_however_many_symbols(spark):
    n = 28_648  # the squared sum of ranks is past what a double holds exactly
    cells = spark.range(n).select(F.col("id").alias("sym"), F.lit("2020-01-01").cast("date").alias("dt"), F.lit(True).alias("elig"), (F.col("id") * 7919 % n).cast("double").alias("fwd"))
    both = cells.withColumn("formula_id", F.lit("flat")).withColumn("signal", F.lit(0.0)).unionByName(cells.withColumn("formula_id", F.lit("same")).withColumn("signal", F.col("fwd")))
    got = {r.formula_id: (r.ic, r.n) for r in quality.rank_ic(both, 5).collect()}
    assert got["flat"] == (None, n) and got["same"][1] == n and abs(got["same"][0] - 1) < 1e-12
