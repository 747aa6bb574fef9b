"""Operators whose groups have no bound."""

import math

import numpy as np

from panelforge.operators import protocol, trades


def folded(rows):
    q = c = 0.0
    for _, side, n, price in sorted(rows):
        if side == "buy":
            q, c = q + n, (q * c + n * price) / (q + n)
        else:
            q = max(q - n, 0.0)
            c = c if q > 0 else 0.0
    return q, c


def test_average_cost_in_blocks(spark):
    """One symbol with most trades, cut into many blocks, with exits beyond what is held."""
    rng, rows = np.random.default_rng(3), {}
    for sym, n in ((1, 2000), (2, 30), (3, 1)):
        rows[sym] = [(k, "buy" if rng.random() < 0.6 - 0.2 * (k % 400 > 200) else "sell", float(rng.integers(1, 50)), float(rng.uniform(1, 9))) for k in range(n)]
    t = spark.createDataFrame([(s, *r) for s, own in rows.items() for r in own], "sym long, seq long, side string, quantity double, price double")
    assert trades.in_blocks(t).where("sym = 1").select("block").distinct().count() > 100
    for r in trades.avg_cost(t).collect():
        q, c = folded(rows[r.sym])
        assert math.isclose(r.quantity, q, abs_tol=1e-9) and math.isclose(r.avg_cost, c, rel_tol=1e-9, abs_tol=1e-9), r


def test_bootstrap_sees_every_trial(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(f"c{c}", 0, k, float(rng.normal(0.9 if c == 7 else 0.0))) for c in range(12) for k in range(60)]
    t = spark.createDataFrame(rows, "candidate string, fold int, sess int, excess double").cache()
    monkeypatch.setattr("pyspark.SparkContext.broadcast", None)  # nothing goes by the driver
    got = protocol.max_t_bootstrap(t, 250).first()
    x = np.array([r[3] for r in rows if r[0] == "c7"])
    assert got.n_trials == 12 and got.n_perms == 250 and got.p_value < 0.02 and math.isclose(got.observed, math.sqrt(60) * x.mean() / x.std(ddof=1))
    assert protocol.max_t_bootstrap(t.where("candidate <> 'c7'"), 250).first().p_value > 0.02
