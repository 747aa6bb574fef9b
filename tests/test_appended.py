"""Sessions that are appended give what a whole run gives, from the sessions that the factors look back."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import factors as lib
from panelforge.functions import formula
from panelforge.operators import panel


@pytest.fixture(scope="module")
def cells(spark, sf_dir):
    return panel.standard(spark, sf_dir, daily=True).where("sym < 12").withColumn("ext_PB", F.col("close")).cache()


def test_appended_sessions_equal_a_whole_run(cells):
    names = list(lib.REGISTRY)
    since = cells.agg(F.max("sess")).first()[0] - 4
    got = lib.appended(cells, names, since).toPandas().sort_values(["sym", "sess"], ignore_index=True)
    want = lib.factors(cells, names).where(F.col("sess") >= since).toPandas().sort_values(["sym", "sess"], ignore_index=True)
    assert len(got) == 5 * cells.select("sym").distinct().count()
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_a_scan_reads_the_lookback_and_no_more(spark, cells):
    """Sessions before the lookback may hold anything; those within it count."""
    names = [n for n in lib.REGISTRY if lib.REGISTRY[n].lookback is not None]
    since, reach = cells.agg(F.max("sess")).first()[0] - 4, lib.lookback(names)
    assert reach == 249 and lib.lookback(["RET_1", "VOL_20"]) == 20 and lib.lookback(["LIST_AGE", "RET_1"]) is None
    print("rows read", cells.where(F.col("sess") >= since - reach).count(), "of", cells.count())
    odd = cells.where(F.col("sess") >= since - reach)
    a = lib.appended(odd, names, since).toPandas().sort_values(["sym", "sess"], ignore_index=True)
    b = lib.appended(cells, names, since).toPandas().sort_values(["sym", "sess"], ignore_index=True)
    pd.testing.assert_frame_equal(a, b, check_exact=True)
    text = lib.appended(cells, ["VOL_20"], since)._jdf.queryExecution().optimizedPlan().toString()
    assert f">= {since - 20}" in text


def test_formulas_add_up_what_they_look_back(cells):
    assert formula.reach(["x", "MA20", "DELTA5", "y", "DECAY", "ADD"], {"x": 3, "y": 0}) == 27
    assert formula.reach(["x", "JUMP"], {"x": 0}) is None and formula.reach(["x", "CS_RANK"], {"x": None}) is None
    own = cells.select("sym", "dt", "sess", "elig", "industry", F.coalesce("close", F.lit(0.0)).alias("x"), F.coalesce("volume", F.lit(0.0)).alias("y"))
    made = {"deep": ["x", "MA20", "TS_RANK60", "DELTA20"], "pair": ["x", "y", "CORR10", "DECAY"], "all": ["x", "JUMP_EXPANDING"], "bad": ["x", "y"]}
    since = cells.agg(F.max("sess")).first()[0] - 3
    order = ["formula_id", "sym", "sess"]
    got = formula.appended_signal(own, made, ["x", "y"], since).toPandas().sort_values(order, ignore_index=True)
    want = formula.formula_signal(own, made, ["x", "y"]).where(F.col("sess") >= since).toPandas().sort_values(order, ignore_index=True)
    assert set(got.formula_id) == {"deep", "pair", "all"}
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_nothing_new_and_nothing_at_all(cells):
    last = cells.agg(F.max("sess")).first()[0]
    assert lib.appended(cells, ["RET_5", "LIST_AGE"], last + 1).count() == 0
    assert lib.appended(cells.where("false"), ["RET_5", "LIST_AGE"], 0).count() == 0
    assert lib.appended(cells, ["RET_5"], 0).count() == cells.count()
    with pytest.raises(KeyError):
        lib.appended(cells, ["NONE"], 0)
    with pytest.raises(ValueError):
        lib.register_factor("X", "f", "close", lambda: F.lit(0.0), {}, lookback=-1)
