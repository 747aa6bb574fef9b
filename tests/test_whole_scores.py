"""Many candidates' signals scored from columns, against the row form."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import formula
from panelforge.operators import portfolio as pf
from panelforge.operators import protocol, quality


def test_figures_of_a_session_equal_the_row_form(spark):
    rng = random.Random(5)
    pick = lambda: rng.choice([None, 0.0, 1.0, rng.gauss(0, 1), 0.25])
    rows = [(sym, sess, rng.random() < 0.8, rng.choice([0.0, rng.gauss(0, 1)]), float(rng.random() < 0.7), *(pick() for _ in range(26)), 2.0, None) for sym in range(40) for sess in range(6)]
    names = [f"s{k}" for k in range(26)] + ["flat", "none"]
    wide = spark.createDataFrame(rows, "sym long, sess int, elig boolean, _fwd double, _ok double, " + ", ".join(f"{n} double" for n in names)).repartition(5).cache()
    figures = protocol.session_figures(wide, names, 5, 5).cache()
    tall = wide.unpivot(["sym", "sess", "elig", "_fwd", "_ok"], names, "formula_id", "signal").withColumn("signal", F.round("signal", 9)).withColumnsRenamed({"_fwd": "fwd"})
    tall = tall.withColumn("dt", F.col("sess")).cache()

    got = {(r.formula_id, r.sess): (r.ic and round(r.ic, 9), r.n) for r in figures.where("sign = 0 and n > 0").collect()}
    assert got == {(r.formula_id, r.dt): (r.ic and round(r.ic, 9), r.n) for r in quality.rank_ic(tall, 5).collect()} and any(v[0] for v in got.values())
    both = protocol.mirrored(tall.where("elig and signal is not null and _ok = 1"))
    want = {(*r.formula_id, r.sess, r.sym, r.signal, r.fwd) for r in pf.top_n(both, 5).collect()}
    assert {(r.formula_id, r.sign, r.sess, r.sym, r.signal, r.fwd) for r in figures.where("sign <> 0").collect()} == want
    ranges = spark.createDataFrame([(1, 0, 4), (2, 1, 6)], "fold int, train_start int, train_end int")
    days = wide.select(F.col("sess").alias("dt"), "sess").distinct()
    assert {tuple(r) for r in protocol.flat_figures(figures, ranges).collect()} == {tuple(r) for r in protocol.flat_signals(tall.where("formula_id <> 'none'"), days, ranges).collect()} == {(1, "flat"), (2, "flat")}
    first = tall.where("elig and signal <> 0").withColumn("k", F.row_number().over(Window.partitionBy("formula_id", "sess").orderBy("sym"))).where("k = 1")
    assert {(r.formula_id, r.sess, r.sym, r.signal) for r in figures.where("sign = 0 and sym is not null").collect()} == {(r.formula_id, r.sess, r.sym, r.signal) for r in first.collect()}


def test_sums_with_a_neutral_feature_are_left_out():
    made = lambda text: " ".join(formula.without_zero(text.split(), "N"))
    assert [made(x) for x in ("a N ADD", "N a ADD", "N N ADD", "a b ADD", "N a SUB", "a N N ADD ADD NEG", "a N MUL b ADD")] == ["a", "a", "N", "a b ADD", "N a SUB", "a NEG", "a N MUL b ADD"]


def test_many_candidates_are_not_shuffled_a_row_a_cell(spark, sf_dir, monkeypatch):
    """No step sees a row for each cell and candidate: all that is shuffled per candidate are blocks, figures and picks."""
    import __spark_entry__ as entry

    def never(*args, **kwargs):
        raise AssertionError("a row a cell and candidate")

    for name in ("rank_ic",):
        monkeypatch.setattr(quality, name, never)
    for name in ("selectable", "top_n"):
        monkeypatch.setattr(pf, name, never)
    assert entry.queries()["baseline_rows"](spark, sf_dir).count() > 0
