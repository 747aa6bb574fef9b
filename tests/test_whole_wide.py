"""Figures over a row a cell with all features beside each other, against those over a row a value."""

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import quality, returns

NAMES = [f"f{k}" for k in range(11)]


def cells(spark):
    """60 symbols on 4 sessions: gaps, ties, a constant feature, one without a value, a session without eligible cells."""
    rng = np.random.default_rng(5)
    rows = []
    for day in range(4):
        for s in range(60):
            x = [None if rng.random() < 0.2 else float(rng.normal() if k % 2 else rng.integers(0, 4)) for k in range(len(NAMES) - 2)]
            rows.append((f"s{s}", f"2024-01-0{day + 1}", day, day != 2 and bool(rng.random() < 0.8), *x, 7.0, None, float(rng.integers(0, 9))))
    return spark.createDataFrame(rows, "sym string, dt string, sess int, elig boolean, " + ", ".join(f"{n} double" for n in NAMES) + ", _fwd double")


def by_key(df, *values):
    keys = sorted(c for c in df.columns if c not in values)
    return {tuple(r[k] for k in keys): [r[v] for v in values] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys() and len(a)
    for k in a:
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[k], b[k], strict=True)), (k, a[k], b[k])


def test_wide_figures_equal_the_long_ones(spark):
    wide = cells(spark)
    tall = lambda df: df.unpivot(["sym", "dt", "sess", "elig"], NAMES, "factor_name", "value")
    z = returns.wide_robust_z(wide, NAMES).cache()
    assert z.columns == wide.columns or set(z.columns) == set(wide.columns)
    long = returns.winsor_robust_z(tall(wide))
    close(by_key(tall(z), "value"), by_key(long, "value"))
    close(by_key(quality.wide_coverage(z, NAMES), "coverage"), by_key(quality.coverage(long), "coverage"))
    close(by_key(quality.wide_corr(z, NAMES), "corr"), by_key(quality.factor_corr(long, NAMES), "corr"))
    signals = long.join(wide.select("sym", "sess", F.col("_fwd").alias("fwd")), ["sym", "sess"]).withColumnsRenamed({"factor_name": "formula_id", "value": "signal"})
    days = wide.select("dt", "sess").distinct()
    close(by_key(quality.wide_rank_ic(z, NAMES, "_fwd").join(days, "sess").drop("sess"), "ic", "n"), by_key(quality.rank_ic(signals.withColumn("signal", F.round("signal", 9))), "ic", "n"))


def test_no_eligible_cell(spark):
    none = cells(spark).withColumn("elig", F.lit(False))
    assert {v for r in returns.wide_robust_z(none, NAMES).select(NAMES).collect() for v in r} == {0.0}
    assert quality.wide_coverage(none, NAMES).count() == quality.wide_corr(none, NAMES).count() == quality.wide_rank_ic(none, NAMES, "_fwd").count() == 0
