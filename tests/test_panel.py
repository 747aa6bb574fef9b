"""Definitions, ties and point-in-time properties of the panel operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import factors as lib
from panelforge.functions import formula, scan
from panelforge.operators import cleaning, fundamentals, panel, protocol, returns, trades, universe, upserts
from panelforge.operators import portfolio as pf
from panelforge.plans import portfolio_queries as pq


@pytest.fixture(scope="module")
def standard(spark, sf_dir):
    return panel.standard(spark, sf_dir).cache()


def test_no_factor_looks_ahead(spark, standard):
    """Changing the last sessions leaves earlier values alone."""
    names = [n for n in lib.REGISTRY if not n.startswith("RANGE")]
    cut = 60
    later = standard.withColumns({c: F.when(F.col("sess") >= cut, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume", "amount", "pre_close", "turnover_rate")})
    a = lib.factors(standard, names).where(F.col("sess") < cut).toPandas().sort_values(["sym", "sess"], ignore_index=True)
    b = lib.factors(later, names).where(F.col("sess") < cut).toPandas().sort_values(["sym", "sess"], ignore_index=True)
    pd.testing.assert_frame_equal(a[names], b[names], check_exact=False, rtol=1e-9)


def test_outsiders_do_not_move_cross_sections(spark, standard):
    """An extreme value of a row that is not eligible changes nobody else's standing."""
    own = standard.select("sym", "dt", "sess", "elig", "industry", F.coalesce("close", F.lit(0.0)).alias("x"))
    odd = own.withColumn("x", F.when(~F.col("elig"), 1e9).otherwise(F.col("x")))
    for name in ("CS_ZSCORE", "CS_RANK", "CS_DEMEAN", "CS_NEUTRALIZE"):
        get = lambda df: df.where("elig").select("sym", "sess", formula.OPERATORS[name].build("x").alias("v"), "elig")  # noqa: E731, B023
        made = [df.select("sym", "sess", "elig", formula.OPERATORS[name].build("x").alias("v")).where("elig").toPandas().sort_values(["sym", "sess"]).v.to_numpy() for df in (own, odd)]
        assert np.allclose(made[0], made[1]), (name, get)


def test_ewm_equals_pandas(spark, standard):
    got = lib.factors(standard, ["MACD_DIF", "RSI_14"]).where("sym = 3").toPandas().sort_values("sess")
    close = standard.where("sym = 3").toPandas().sort_values("sess").close.ffill()
    want = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    assert np.allclose(got.MACD_DIF.to_numpy(), want.to_numpy(), equal_nan=True)


def test_exponential_means_by_blocks_equal_the_recursion(spark):
    """Several tiers of blocks, a long stretch of zeros, gaps, late starts, short symbols and one without values."""
    rng = np.random.default_rng(0)
    n = 70_000  # more than 256 blocks of 64, several tiers
    x = rng.random(n)
    x[5_000:30_000] = 0
    long = pd.DataFrame({"sym": 1, "sess": np.arange(n), "x": x, "z": np.where(np.arange(n) < 700, np.nan, x - 0.5)})
    short = pd.DataFrame({"sym": np.repeat([2, 3, 4], [1, 257, 600]), "sess": np.concatenate([np.arange(1), np.arange(257) * 3, np.arange(600)])})
    short["x"] = rng.random(len(short))
    short["z"] = np.where((rng.random(len(short)) < 0.3) | (short.sym == 4), np.nan, short.x)
    own = pd.concat([long, short])
    means = {"a": ("x", 1 / 14), "b": ("z", 0.2), "d": ("x", 0.9), "e": ("z", 0.001)}
    rows = spark.createDataFrame(own).select("sym", "sess", *(F.when(~F.isnan(k), F.col(k)).alias(k) for k in "xz")).repartition(5)
    made = scan.exponential_means(rows, means)
    assert "Python" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.toPandas().sort_values(["sym", "sess"])
    for name, (k, alpha) in means.items():
        want = own.groupby("sym")[k].transform(lambda v, alpha=alpha: v.ewm(alpha=alpha, adjust=False, ignore_na=True).mean())
        assert np.allclose(got[name].to_numpy(float), want.to_numpy(), rtol=1e-8, atol=1e-12, equal_nan=True), name
    with pytest.raises(ValueError, match="weights"):
        scan.exponential_means(rows, {"a": ("x", 1.5)})


def test_skew_and_kurtosis_equal_pandas(spark, standard):
    got = lib.factors(standard, ["SKEW_20", "KURT_20"]).where("sym = 3").toPandas().sort_values("sess")
    r = standard.where("sym = 3").toPandas().sort_values("sess").close.pct_change(fill_method=None)
    assert np.allclose(got.SKEW_20, r.rolling(20, min_periods=3).skew(), equal_nan=True)
    assert np.allclose(got.KURT_20, r.rolling(20, min_periods=4).kurt(), equal_nan=True)


def test_ledger_equals_set_based_returns_when_nothing_blocks(spark, sf_dir):
    costs = pf.Costs(min_commission=0.0)
    w = pq.weights(spark, sf_dir)
    flat = {(r.formula_id, r.sess): r for r in pf.topn_returns(w, pq.last_session(spark, sf_dir), costs).collect()}
    cells = pq.tradable(spark, sf_dir).select("sess", "sym", "fwd", F.lit(False).alias("sell_blocked"))
    sessions = pq.axis(spark, sf_dir).select(F.lit(0).cast("long").alias("window"), "sess")
    for r in pf.topn_ledger(w.withColumn("window", F.lit(0).cast("long")), cells, sessions, costs=costs).collect():
        if (r.formula_id, r.sess) in flat:
            assert math.isclose(r.net, flat[r.formula_id, r.sess].net, rel_tol=1e-9, abs_tol=1e-9)


def test_interval_issues(spark):
    rows = [("A", "x", "2020-01-01", "2020-02-01"), ("A", "x", "2020-02-01", "2020-03-01"), ("A", "y", "2020-01-01", "2020-03-01"), ("A", "y", "2020-02-01", "2020-04-01"), ("A", "z", "2020-01-01", "2020-01-01"), (None, "w", "2020-01-01", "2020-02-01")]
    t = spark.createDataFrame(rows, "index_code string, sym string, a string, b string").select("index_code", "sym", F.to_date("a").alias("in_date"), F.to_date("b").alias("out_date"))
    assert {(r.issue, r.sym) for r in universe.interval_issues(t).collect()} == {("overlap", "y"), ("empty", "z"), ("blank", "w")}
    with pytest.raises(ValueError):
        upserts.intervals_validated(t.limit(0), t)


def test_interval_report_names_every_error_and_never_fails(spark):
    rows = [("A", " x ", "20200101", "2020-02-01"), ("A", "x", "20200115", "20200301"), ("A", "y", "20200230", "20200301"), ("A", "z", None, " "), ("B", "x", "20200101", "20200101"), ("A", "v", "1", "soon"), ("C", "x", "20200101", "99991231")]
    t = spark.createDataFrame(rows, "index_code string, sym string, in_date string, out_date string").withColumn("issue", F.lit("other"))
    got = {(r.issue, r.field, r.index_code, r.sym) for r in universe.interval_report(t).collect()}
    assert got == {("overlap", "in_date", "A", "x"), ("invalid date", "in_date", "A", "y"), ("blank", "in_date", "A", "z"), ("blank", "out_date", "A", "z"), ("empty", "in_date", "B", "x"), ("invalid date", "in_date", "A", "v"), ("invalid date", "out_date", "A", "v")}
    assert [(r.issue, r.field) for r in universe.interval_report(t.drop("sym")).collect()] == [("missing column", "sym")]
    assert [r.issue for r in universe.interval_report(t.limit(0)).collect()] == ["no rows"]
    typed = t.select("index_code", "sym", F.to_date(F.lit("2020-01-01")).alias("in_date"), F.to_timestamp(F.lit("2020-02-01")).alias("out_date")).limit(1)
    assert universe.interval_report(typed).count() == 0


def test_calendar_report_and_axis_of_untyped_dates(spark):
    rows = [("20200102", "true"), ("2020-01-01", "1"), ("20200103", "false"), ("20200102", "true"), ("none", "true"), ("never", None), (None, "true")]
    t = spark.createDataFrame(rows, "dt string, is_open string")
    assert sorted((r.issue, r.dt or "") for r in universe.calendar_report(t).collect()) == [("invalid date", ""), ("invalid date", "none")]
    assert [(str(r.dt), r.sess) for r in universe.session_axis_from(t).orderBy("sess").collect()] == [("2020-01-01", 0), ("2020-01-02", 1)]
    assert [r.issue for r in universe.calendar_report(t.where("dt = '20200103'")).collect()] == ["no open session"]
    assert [r.field for r in universe.calendar_report(t.drop("is_open")).collect()] == ["is_open"]
    assert universe.session_axis_from(t.limit(0)).count() == 0


def test_coalesced_intervals_cover_the_same_dates(spark):
    rows = [("a", 1, 3), ("a", 3, 5), ("a", 2, 4), ("a", 7, 9), ("a", 8, 8), ("a", 6, 5), ("b", 1, 2), ("b", 1, 2), ("c", None, 4), ("c", 2, None), ("d", 1, 20), ("d", 2, 3), ("d", 19, 21)]
    at = lambda c: F.expr(f"date_add(date'2020-01-01', {c})")
    t = spark.createDataFrame(rows, "sym string, a int, b int").select("sym", at("a").alias("in_date"), at("b").alias("out_date"))
    got = sorted((r.sym, r.in_date.day - 1, r.out_date.day - 1) for r in universe.coalesced(t).collect())
    assert got == [("a", 1, 5), ("a", 7, 9), ("b", 1, 2), ("d", 1, 21)]
    cells = spark.createDataFrame([(s, d) for s in "abcde" for d in range(25)], "sym string, d int").select("sym", at("d").alias("dt"))
    want = {(s, d) for s in "abcde" for d in range(25) if any(s == x and a is not None and b is not None and a <= d < b for x, a, b in rows)}
    assert {(r.sym, r.dt.day - 1) for r in universe.members_at(cells, t).collect()} == want
    assert universe.members_at(cells, t).count() == len(want)


def test_first_sessions_equal_a_search(spark):
    days = [0, 1, 4, 9, 10]
    at = lambda c: F.expr(f"date_add(date'2020-01-01', {c})")
    axis = spark.createDataFrame([(d, k) for k, d in enumerate(days)], "d int, sess int").select(at("d").alias("dt"), "sess")
    rows = spark.createDataFrame([(d,) for d in [-3, 0, 2, 4, 5, 9, 10, 11, 400, None]], "d int").withColumn("x", at("d"))
    got = {r.d: r.idx for r in universe.first_at_or_after(rows, axis, "x").collect()}
    assert got == {d: None if d is None else sum(x < d for x in days) for d in got}
    assert {r.idx for r in universe.first_at_or_after(rows, axis.limit(0), "x").where("d is not null").collect()} == {0}


def test_symbols_and_dates(spark):
    t = spark.createDataFrame([("600000.SH", "20200131"), ("000001.SH", "2020-01-31"), ("123456.SZ", "20209999"), (None, None), ("300001.SZ", "2020-01-31 00:00:00")], "s string, d string")
    got = t.select(cleaning.valid_symbol(F.col("s")).alias("v"), cleaning.clean_date(F.col("d")).cast("string").alias("d")).collect()
    assert [r.v for r in got] == [True, False, False, False, True]
    assert [r.d for r in got] == ["2020-01-31", "2020-01-31", None, None, "2020-01-31"]


def test_asof_takes_the_later_report_on_a_tie(spark):
    cells = spark.sql("select 1L sym, date'2020-05-01' dt, 0 sess union all select 1L, date'2020-04-29', 1")
    news = spark.sql("select 1L sym, date'2020-04-30' announce_date, date'2019-12-31' report_date, 1.0D v union all select 1L, date'2020-04-30', date'2020-03-31', 2.0D")
    got = {str(r.dt): r.v for r in fundamentals.asof_ffill(cells, news, "announce_date", ["v"]).collect()}
    assert got == {"2020-05-01": 2.0, "2020-04-29": None}


def test_affordable_lots_equals_search(spark):
    rng, costs = np.random.default_rng(1), pf.Costs()
    rows = [(float(rng.uniform(0, 50_000)), float(rng.uniform(1, 60)), float(rng.integers(0, 5000))) for _ in range(200)]
    t = spark.createDataFrame(rows, "cash double, price double, want double")
    got = [r.q for r in t.select(trades.affordable_lots(F.col("cash"), F.col("price"), F.col("want")).alias("q")).collect()]
    for (cash, price, want), q in zip(rows, got, strict=True):
        pay = lambda n: n * price + (max(n * price * costs.commission, 5) + n * price * (costs.transfer + costs.slippage) if n else 0)  # noqa: E731, B023
        assert q == max((n for n in range(0, int(want) // 100 * 100 + 1, 100) if pay(n) <= cash + 1e-9), default=0)


def test_probabilistic_sharpe_known_values(spark):
    t = spark.createDataFrame([(0.0, 0.0, 3.0, 100.0), (0.2, 0.0, 3.0, 101.0)], "sr double, skew double, kurt double, t double")
    got = [r.p for r in t.select(protocol.psr(F.lit(0.0)).alias("p")).collect()]
    assert math.isclose(got[0], 0.5) and math.isclose(got[1], 0.5 * (1 + math.erf(0.2 * 10 / math.sqrt(1.02) / math.sqrt(2))), rel_tol=1e-9)


def test_noise_is_not_significant(spark, sf_dir):
    from panelforge.plans import protocol_queries

    assert protocol_queries.noise_selfcheck(spark, sf_dir).first().p_value > 0.01


def test_random_formulas_are_valid_and_repeatable(spark):
    names = ["a", "b"]
    one, two = (sorted(tuple(r.tokens) for r in formula.random_formulas(spark.range(200), names, seed=4).collect()) for _ in range(2))
    assert one == two and len(one) > 50
    assert all(formula.depth(list(t), set(names)) == 1 for t in one) and max(map(len, one)) > 3


def test_winsor_handles_constant_and_empty_dates(spark):
    t = spark.sql("select 's' || id sym, date'2020-01-01' dt, 0 sess, true elig, 'f' factor_name, 5.0D value from range(4) union all select 's0', date'2020-01-02', 1, false, 'f', 7.0D")
    assert {r.value for r in returns.winsor_robust_z(t).collect()} == {0.0}


def test_upserts(spark):
    old = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0)], "k int, a double, b double")
    new = spark.createDataFrame([(1, None, 3.0), (3, 9.0, None)], "k int, a double, b double")
    assert {tuple(r) for r in upserts.coalescing(old, new, ["k"]).collect()} == {(1, 1.0, 3.0), (2, 2.0, 5.0), (3, 9.0, None)}
    assert {tuple(r) for r in upserts.last_wins(old, new, ["k"]).collect()} == {(1, None, 3.0), (2, 2.0, 5.0), (3, 9.0, None)}


def test_symbols_and_dates_as_the_exchanges_write_them(spark):
    t = spark.createDataFrame([("000300.SZ",), ("000905.SH",), ("874001.BJ",), (" 600000.SH ",), ("900901.SH",), ("600000",), (None,)], "s string")
    assert [r[0] for r in t.select(cleaning.valid_symbol(F.col("s"))).collect()] == [False, False, True, True, False, False, False]
    t = spark.createDataFrame([("900901",), ("510300",), (" 600000",), ("300001",), ("430001",), ("200002",)], "s string")
    assert [r[0] for r in t.select(cleaning.map_symbol(F.col("s"))).collect()] == ["900901.SH", "510300.SZ", "600000.SH", "300001.SZ", "430001.BJ", "200002.SZ"]
    written = ["20200131", "2020-01-31", "2020/01/31", "2020-1-31", "2020/1/31 10:20", "Jan 31, 2020", "31 Jan 2020", "1/31/2020", "20201345", "soon", " ", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in written], "s string").select(cleaning.clean_date(F.col("s")).cast("string")).collect()]
    assert got == ["2020-01-31"] * 8 + [None] * 4


def test_each_report_series_stands_alone(spark):
    """A report without earnings keeps its revenue, and NaN counts as missing."""
    dates = ["2019-03-31", "2019-06-30", "2019-09-30", "2019-12-31", "2020-03-31"]
    rows = [(1, d, d, 10.0 * k, 1.0 * k, None if k == 2 else float("nan") if k == 3 else 0.1 * k) for d, k in zip(dates, (1, 2, 3, 4, 1), strict=True)]
    t = spark.createDataFrame(rows, "sym long, report_date string, announce_date string, revenue_cum double, profit_cum double, eps_cum double")
    t = t.withColumn("report_date", F.to_date("report_date")).withColumn("announce_date", F.to_date("announce_date"))
    got = {str(r.report_date): r for r in fundamentals.trailing_reports(t).collect()}
    assert [got[d].revenue_ttm for d in dates] == [None, None, None, 40.0, 40.0] and [got[d].eps_ttm for d in dates] == [None] * 5


def test_validation_windows_edges(spark):
    ends = [2, 3, 10, 14, 40, 41]
    t = spark.createDataFrame([(n, 0, n) for n in ends], "fold int, train_start int, train_end int")
    got = {}
    for r in protocol.validation_windows(t).orderBy("fold", "window").collect():
        got.setdefault(r.fold, []).append((r.lo, r.hi))
    assert got[2] == [(0, 2)] and got[3] == [(1, 3)] and got[10] == [(6, 10)]
    assert got[14] == [(9, 14)] and got[40] == [(26, 29), (29, 32), (32, 35), (35, 40)] and got[41] == [(27, 30), (30, 33), (33, 36), (36, 41)]


def test_normal_distribution_and_its_inverse(spark):
    from statistics import NormalDist

    xs = [-9.0, -6.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.0, 4.9, 7.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(protocol.normal_cdf(F.col("x"))).collect()]
    assert all(math.isclose(g, 0.5 * math.erfc(-x / math.sqrt(2)), rel_tol=1e-6, abs_tol=1e-13) for g, x in zip(got, xs, strict=True))
    ps = [1e-12, 0.001, 0.02425, 0.3, 0.5, 0.9, 0.999999, 0.0, 1.0, None]
    back = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(protocol.normal_ppf(F.col("p"))).collect()]
    assert all(b is None if not p or p == 1 else math.isclose(b, NormalDist().inv_cdf(p), rel_tol=1e-8, abs_tol=1e-9) for b, p in zip(back, ps, strict=True))


def test_constant_signals_have_no_score(spark):
    days = spark.range(20).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("dt"), F.col("id").cast("int").alias("sess"))
    cells = days.crossJoin(spark.range(4).withColumnRenamed("id", "sym")).select("dt", "sym", F.lit(True).alias("elig"))
    signals = cells.select(F.lit("flat").alias("formula_id"), "*", F.lit(1.0).alias("signal")).unionByName(cells.select(F.lit("moving").alias("formula_id"), "*", F.col("sym").cast("double").alias("signal")))
    ranges = spark.createDataFrame([(1, 0, 15)], "fold int, train_start int, train_end int")
    flat = protocol.flat_signals(signals, days, ranges)
    assert [tuple(r) for r in flat.select("fold", "formula_id").collect()] == [(1, "flat")]
    ics = days.select("sess", F.lit(0.1).alias("ic"), F.explode(F.array(F.lit("flat"), F.lit("moving"))).alias("formula_id"))
    costs = ics.select("formula_id", "sess", F.lit(0.0).alias("cost"))
    got = {r.formula_id: r for r in protocol.candidate_gates(protocol.score_candidates(ics, costs, protocol.validation_windows(ranges), flat=flat)).collect()}
    assert got["flat"].reasons == ["constant signal"] and got["flat"].val_reward is None and not got["flat"].eligible and got["moving"].val_reward == 1.0


def test_a_mirrored_input_gives_mirrored_candidates(spark):
    """Full-window values, the canonical side on ties, four keys, penalties and malformed formulas."""
    windows = spark.createDataFrame([(0, 0, 4, 6), (0, 1, 6, 8)], "fold int, window int, lo int, hi int")
    ranges = spark.createDataFrame([(0, 0, 8)], "fold int, train_start int, train_end int")
    cells = [("tie", k, 1, True, 0.0 if k < 5 else -0.5) for k in range(8)] + [("tie", 5, 0, False, 9.0)] + [("up", k, 1, True, 1.0 + k) for k in range(8)]
    ics = spark.createDataFrame([("tie", k, 0.0) for k in range(8)] + [("up", k, 0.2 + k / 100) for k in range(8)], "formula_id string, sess int, ic double")
    costs = spark.createDataFrame([(n, k, 0.0) for n in ("tie", "up") for k in range(8)], "formula_id string, sess int, cost double")
    penalty = spark.createDataFrame([("up", 0.25)], "formula_id string, penalty double")
    invalid = spark.createDataFrame([("odd",)], "formula_id string")
    got = {}
    for side in (1, -1):
        signals = spark.createDataFrame([(n, s, y, e, side * v) for n, s, y, e, v in cells], "formula_id string, sess int, sym int, elig boolean, signal double")
        own = protocol.score_candidates(ics.withColumn("ic", F.col("ic") * side), costs, windows, penalty=penalty, ranges=ranges, signals=signals, invalid=invalid)
        got[side] = {r.formula_id: r for r in protocol.candidate_gates(own).collect()}
    for name in ("tie", "up"):
        assert got[1][name].sign == -got[-1][name].sign and got[1][name].val_reward == got[-1][name].val_reward
    assert got[1]["tie"].sign == -1 and got[1]["up"].sign == 1  # the cell that is not eligible does not decide
    ic = np.array([0.2 + k / 100 for k in range(8)])
    assert np.isclose(got[1]["up"].full_icir, ic.mean() / (ic.std(ddof=1) + 1e-9)) and np.isclose(got[1]["up"].full_reward, 0.75) and np.isclose(got[1]["up"].val_reward, 0.75)
    odd = got[1]["odd"]
    assert odd.reasons == ["invalid formula"] and odd.full_reward == -1 and odd.val_reward is None and not odd.eligible
    rows = [(0, "a", True, 1.0, 1.0, 0.5, 0.1), (0, "b", True, 1.0, 1.0, 0.5, 0.2), (0, "c", True, 1.0, 1.0, 0.4, 9.0), (0, "d", False, None, None, -2.0, None), (0, "e", False, None, None, -1.0, None)]
    table = spark.createDataFrame(rows, "fold int, formula_id string, eligible boolean, val_reward double, val_icir double, full_reward double, full_icir double")
    assert sorted(r.formula_id for r in protocol.select_candidate(table).collect()) == ["b", "e"]
    assert formula.malformed({"good": ["x", "NEG"], "few": ["x", "ADD"], "many": ["x", "x"], "odd": ["?"], "none": []}, ["x"]) == ["few", "many", "odd", "none"]
