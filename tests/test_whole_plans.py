"""What plans over the panel may cost: exchanges of cells and windows computed again."""

import re

from pyspark.sql import functions as F

from panelforge.functions import factors as lib
from panelforge.operators import panel, universe
from panelforge.sources import fixtures


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_cells_stay_with_their_symbol(spark, sf_dir):
    physical = plan(panel.derive(spark, sf_dir, daily=True))[1]
    assert not re.search(r"hashpartitioning\(sym#\d+L?, (dt|sess)#", physical)


def test_windows_are_computed_once(spark, sf_dir):
    cells = panel.standard(spark, sf_dir, daily=True)
    for name, most in (("IVOL_60", 8), ("SKEW_20", 4), ("VOL_60", 3), ("LIMIT_STREAK", 3), ("HIGH_52W", 2)):
        made = plan(lib.factors(cells, [name]).select("sym", "dt", name))[0]
        assert len(set(re.findall(r"windowspecdefinition\(.*?\)\) AS (\S+)", made))) <= most, name


def test_no_window_is_over_a_session(spark, sf_dir):
    cells = panel.standard(spark, sf_dir, daily=True)
    made = plan(lib.factors(cells, ["BETA_60", "AMOUNT_SHARE", "IND_REL_RET_5", "LIMIT_STREAK"]))[0]
    assert "windowspecdefinition(dt#" not in made


def test_dense_panel_with_gaps_repeated_bars_and_none(spark):
    day = lambda k: f"2024-01-0{k}"
    bars = spark.createDataFrame([("a", day(2), 1.0), ("a", day(4), 2.0), ("a", day(4), 3.0), ("b", day(1), 4.0), ("b", day(5), None)], "sym string, dt string, close double").withColumn("dt", F.to_date("dt"))
    axis = universe.session_axis(spark.createDataFrame([(day(k), True) for k in range(1, 8)], "dt string, is_open boolean").withColumn("dt", F.to_date("dt")))
    symbols = spark.createDataFrame([("a",), ("b",), ("c",)], "sym string")
    got = sorted((r.sym, r.sess, r.dt.day, r.close or 0.0) for r in universe.dense_panel(symbols, bars, axis).collect())
    value = {("a", 1): [1.0], ("a", 3): [2.0, 3.0], ("b", 0): [4.0]}
    assert got == [(s, k, k + 1, v) for s in "abc" for k in range(5) for v in value.get((s, k), [0.0])]
    assert universe.dense_panel(symbols, bars.where("false"), axis).count() == 0
