"""Steps over a symbol's rows share one exchange, and their values are those of the steps one by one."""

import re

from pyspark.sql import functions as F

from panelforge.functions import factors as lib
from panelforge.functions import scan
from panelforge.operators import fundamentals, panel, returns
from panelforge.plans import panel_queries
from panelforge.sources import fixtures


def cells(spark):
    return spark.range(4 * 300).select((F.col("id") % 4).alias("sym"), F.floor(F.col("id") / 4).cast("int").alias("sess"), F.when(F.col("id") % 7 > 0, F.col("id") % 13).cast("double").alias("x"))


def test_rows_of_a_key_stay_where_they_are(spark):
    """Blocks' own means come back by key alone: a frame dealt by key was dealt again by key and block."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = scan.exponential_means(cells(spark).repartition("sym"), {"a": ("x", 0.3), "b": ("x", 0.1)})
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(sym#\d+L, _block", plan)
    got = {(r.sym, r.sess): (r.x, r.a, r.b) for r in made.collect()}
    assert len(got) == 1200
    for s in range(4):
        a = b = None
        for t in range(300):
            x, *both = got[s, t]
            if x is not None:
                a, b = (x if y is None else w * x + (1 - w) * y for y, w in ((a, 0.3), (b, 0.1)))
            assert all(p is q is None or abs(p - q) < 1e-9 for p, q in zip(both, (a, b)))


def test_reports_and_balances_in_one_pass(spark, sf_dir):
    own, reports, margin = panel.standard(spark, sf_dir), fixtures.fundamentals(spark, sf_dir), fixtures.margin(spark, sf_dir)
    made = reports.selectExpr("*", *(f"{x} AS {n}" for n, x in panel_queries.LEVEL.items()))
    names = [*panel_queries.LEVEL, "PE_TTM", "PB", "PS_TTM", "NET_MARGIN", "MARGIN_BALANCE_CHG"]
    got = fundamentals.reports_and_balances(own, made, margin, list(panel_queries.LEVEL))
    assert got.columns == [*own.columns, *(c for c in got.columns if c in names)] and set(names) <= set(got.columns)
    steps = fundamentals.balance_change(fundamentals.valuation(fundamentals.asof_ffill(own, made, "announce_date", list(panel_queries.LEVEL)), reports), margin)
    form = lambda df: sorted(map(str, df.select("sym", "dt", *names).collect()))
    assert form(got) == form(steps)


def test_standardised_values_are_not_kept_beside_the_features(spark, sf_dir):
    """Only four numbers a session and feature are; a second table of all values was."""
    panel.forget(spark)
    wide = panel_queries.standard_wide(spark, sf_dir)
    kept = {name for app, at, name in panel._written if app == spark.sparkContext.applicationId and at == sf_dir}
    assert kept == {"panel", "fed", "features", "figures"}
    some = list(lib.REGISTRY)[:3]
    whole = returns.wide_robust_z(panel_queries.all_wide(spark, sf_dir), some)
    form = lambda df: sorted(map(str, df.select("sym", "sess", *some).collect()))
    assert form(wide) == form(whole)


def test_tiers_of_blocks_are_not_joined_back(spark):
    """What enters a block is found in one pass over a key's blocks; it was made twice, for the tiers and for their join."""
    plan = scan.exponential_means(cells(spark), {"a": ("x", 0.3)})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
