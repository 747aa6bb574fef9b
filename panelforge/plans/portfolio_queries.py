"""Queries on portfolios of the standard candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import digits
from panelforge.operators import panel, protocol, quality, returns
from panelforge.operators import portfolio as pf
from panelforge.plans.base_sql import PANEL
from panelforge.plans.formula_queries import signals
from panelforge.plans.panel_queries import MIN_STOCKS, SCORED, TRADE, axis, scored
from panelforge.plans.registry import query
from panelforge.sources import fixtures

N = 5
C = pf.Costs()
BOOK = f"""{SCORED}{TRADE[len(PANEL):]},
tn AS (SELECT sym, dt, sess, elig, fwd, lead(elig) OVER ts AS e1, lead(susp OR up1 OR NOT elig) OVER ts AS b1, lead(susp OR down1) OVER ts AS s1 FROM trade WINDOW ts AS (PARTITION BY sym ORDER BY sess)),
cand AS (SELECT s.formula_id, s.sym, s.dt, t.sess, round(s.signal, 9) AS signal, t.fwd FROM signals s JOIN tn t USING (sym, dt) WHERE s.elig AND s.signal IS NOT NULL AND t.e1 AND NOT t.b1),
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY formula_id, dt ORDER BY signal DESC, sym) AS k FROM cand) WHERE k <= {N}),
weights AS (SELECT *, 0.05 / sum(0.05) OVER (PARTITION BY formula_id, dt) AS weight FROM picks),
net AS (SELECT formula_id, sym, sess, sum(d) AS d FROM (SELECT formula_id, sym, sess, weight AS d FROM weights UNION ALL SELECT formula_id, sym, sess + 1, -weight FROM weights WHERE sess + 1 <= (SELECT max(sess) FROM axis)) GROUP BY 1, 2, 3),
moved AS (SELECT formula_id, sess, sum(greatest(d, 0)) AS buys, sum(greatest(-d, 0)) AS sells, sum(abs(d)) AS turnover FROM net GROUP BY 1, 2),
gross AS (SELECT formula_id, sess, sum(weight * fwd) AS gross FROM weights GROUP BY 1, 2),
daily AS (SELECT formula_id, sess, coalesce(gross, 0) AS gross, buys * {C.buy_rate} + sells * {C.sell_rate} AS cost, coalesce(gross, 0) - (buys * {C.buy_rate} + sells * {C.sell_rate}) AS net, turnover FROM moved LEFT JOIN gross USING (formula_id, sess)),
eq AS (SELECT * REPLACE (net / 100 AS net), product(1 + net / 100) OVER (PARTITION BY formula_id ORDER BY sess ROWS UNBOUNDED PRECEDING) AS equity FROM daily),
curve AS (SELECT *, 1 - equity / (greatest(max(equity) OVER (PARTITION BY formula_id ORDER BY sess ROWS UNBOUNDED PRECEDING), 1) + 1e-12) AS drawdown FROM eq),
bench AS (SELECT sess, coalesce(avg(CASE WHEN elig AND coalesce(e1, false) THEN fwd END), 0) AS bench FROM tn GROUP BY 1),
icir AS (SELECT formula_id, CASE WHEN count(ic) >= 2 THEN avg(ic) / (stddev_samp(ic) + 1e-9) ELSE 0 END AS icir FROM ic GROUP BY 1)"""


def tradable(spark, sf_dir):
    return returns.with_tradability(panel.standard(spark, sf_dir)).withColumn("fwd", returns.open_to_open())


def even(own):
    """Signals to nine places: sums in another order leave ties ties."""
    return own.withColumn("signal", F.round("signal", 9))


def picks(spark, sf_dir):
    return pf.top_n(pf.selectable(even(signals(spark, sf_dir)), tradable(spark, sf_dir)), N)


def weights(spark, sf_dir):
    return pf.target_weights(picks(spark, sf_dir), N)


def last_session(spark, sf_dir) -> int:
    return axis(spark, sf_dir).agg(F.max("sess")).first()[0]


def daily(spark, sf_dir):
    return pf.topn_returns(weights(spark, sf_dir), last_session(spark, sf_dir))


def two_books(spark, sf_dir, own=None):
    """``formula_id, sign`` and :func:`daily` of each candidate and of its mirror image, each with the names and costs of its own book."""
    both = protocol.mirrored(even(signals(spark, sf_dir) if own is None else own))
    book = pf.target_weights(pf.top_n(pf.selectable(both, tradable(spark, sf_dir)), N), N)
    return pf.topn_returns(book, last_session(spark, sf_dir)).select("formula_id.*", "sess", "gross", "cost", "net", "turnover")


def curves(spark, sf_dir):
    """Curves of a hundredth of each return: prices of this data set jump, and whole returns would leave any range."""
    return pf.curve(daily(spark, sf_dir).withColumn("net", F.col("net") / 100))


def rounded(df, *names, places=6):
    return df.withColumns({n: digits(F.col(n), places) for n in names})


def r(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) + 0.0 AS {n}" for n in names)


@query("top_n", f"{BOOK} SELECT formula_id, sym, dt::VARCHAR AS dt, k::INT AS k FROM picks")
def top_n(spark, sf_dir):
    return picks(spark, sf_dir).select("formula_id", "sym", "dt", "k")


@query("target_weights", f"{BOOK} SELECT formula_id, sym, dt::VARCHAR AS dt, {r('weight')} FROM weights")
def target_weights(spark, sf_dir):
    return rounded(weights(spark, sf_dir).select("formula_id", "sym", "dt", "weight"), "weight")


@query("turnover", f"{BOOK} SELECT formula_id, sess, {r('buys', 'sells', 'turnover')} FROM moved")
def turnover(spark, sf_dir):
    return rounded(pf.turnover(weights(spark, sf_dir), last_session(spark, sf_dir)), "buys", "sells", "turnover")


@query("gross_return", f"{BOOK} SELECT formula_id, sess, {r('gross')} FROM gross")
def gross_return(spark, sf_dir):
    return rounded(pf.gross_return(weights(spark, sf_dir)), "gross")


@query("topn_returns", f"{BOOK} SELECT formula_id, sess, {r('gross', 'cost', 'net', 'turnover')} FROM daily")
def topn_returns(spark, sf_dir):
    return rounded(daily(spark, sf_dir), "gross", "cost", "net", "turnover")


@query("topn_ledger")
def topn_ledger(spark, sf_dir):
    chosen = weights(spark, sf_dir).withColumn("window", (F.col("sess") / 24).cast("long"))
    w = returns.by_session()
    cells = tradable(spark, sf_dir).select("sess", "sym", "fwd", F.lead("blocked_sell", 1).over(w).alias("sell_blocked"))
    sessions = axis(spark, sf_dir).select((F.col("sess") / 24).cast("long").alias("window"), "sess")
    return rounded(pf.topn_ledger(chosen, cells, sessions), "gross", "cost", "net", "turnover")


@query("equity_curve", f"{BOOK} SELECT formula_id, sess, {r('equity')} FROM curve")
def equity_curve(spark, sf_dir):
    return rounded(curves(spark, sf_dir).select("formula_id", "sess", "equity"), "equity")


@query("drawdown", f"{BOOK} SELECT formula_id, sess, {r('drawdown')} FROM curve")
def drawdown(spark, sf_dir):
    return rounded(curves(spark, sf_dir).select("formula_id", "sess", "drawdown"), "drawdown")


PERF = "SELECT formula_id, count(*) AS n, arg_max(equity, sess) - 1 AS total, coalesce(stddev_samp(net), 0) * sqrt(252) AS vol, max(drawdown) AS max_drawdown, avg(turnover) AS turnover FROM curve GROUP BY 1"


@query("perf_metrics", f"{BOOK}, p AS ({PERF}), q AS (SELECT *, pow(1 + total, 252.0 / n) - 1 AS annual FROM p), m AS (SELECT *, (annual - 0.02) / (vol + 1e-9) AS sharpe, annual / (max_drawdown + 1e-9) AS calmar FROM q) SELECT formula_id, {r('total', 'vol', 'max_drawdown', 'turnover', 'annual', 'sharpe', 'calmar', places=5)} FROM m")
def perf_metrics(spark, sf_dir):
    return rounded(pf.perf_metrics(curves(spark, sf_dir)).drop("n"), "total", "vol", "max_drawdown", "turnover", "annual", "sharpe", "calmar", places=5)


@query("sortino", f"{BOOK} SELECT formula_id, round(avg(net) * 252 / (CASE WHEN count(*) FILTER (net < 0) >= 3 THEN stddev_samp(CASE WHEN net < 0 THEN net END) * sqrt(252) ELSE coalesce(stddev_samp(net), 0) * sqrt(252) + 1e-6 END + 1e-9), 5) + 0.0 AS sortino FROM daily GROUP BY 1")
def sortino(spark, sf_dir):
    return rounded(pf.sortino(daily(spark, sf_dir)), "sortino", places=5)


@query("equal_weight_benchmark", f"{BOOK} SELECT sess, {r('bench')} FROM bench")
def equal_weight_benchmark(spark, sf_dir):
    return rounded(pf.equal_weight_benchmark(tradable(spark, sf_dir)), "bench")


@query("excess", f"{BOOK} SELECT formula_id, sess, round(net - bench, 6) + 0.0 AS excess FROM daily JOIN bench USING (sess)")
def excess(spark, sf_dir):
    return rounded(pf.excess(daily(spark, sf_dir), pf.equal_weight_benchmark(tradable(spark, sf_dir))).select("formula_id", "sess", "excess"), "excess")



@query("positions_snapshot", f"{BOOK}, b AS (SELECT formula_id, dt, sess, string_agg(sym::VARCHAR, ',' ORDER BY sym) AS book FROM weights GROUP BY 1, 2, 3), x AS (SELECT sess, lead(dt, 1) OVER (ORDER BY sess) AS entry, lead(dt, 2) OVER (ORDER BY sess) AS exit FROM axis) SELECT formula_id, dt::VARCHAR AS dt, book, entry::VARCHAR AS entry, exit::VARCHAR AS exit FROM b JOIN x USING (sess)")
def positions_snapshot(spark, sf_dir):
    own = pf.positions_snapshot(weights(spark, sf_dir), axis(spark, sf_dir))
    return own.select("formula_id", "dt", F.array_join(F.transform("book", lambda p: p["sym"].cast("string")), ",").alias("book"), "entry", "exit")


@query("positions_page", f"{BOOK}, d AS (SELECT DISTINCT formula_id, dt FROM weights ORDER BY dt DESC, formula_id LIMIT 4 OFFSET 2) SELECT w.formula_id, w.dt::VARCHAR AS dt, w.sym, {r('weight')}, s.name FROM weights w JOIN d USING (formula_id, dt) LEFT JOIN stocks s USING (sym)")
def positions_page(spark, sf_dir):
    snaps = pf.positions_snapshot(weights(spark, sf_dir), axis(spark, sf_dir))
    return rounded(pf.positions_page(snaps, fixtures.stocks(spark, sf_dir), 2, 4), "weight")


@query("reward", f"{BOOK}, c AS (SELECT formula_id, avg(cost) * 252 AS cost FROM daily GROUP BY 1) SELECT formula_id, round(least(greatest(icir - cost, -1), 1), 6) + 0.0 AS reward FROM icir JOIN c USING (formula_id)")
def reward(spark, sf_dir):
    stats = quality.ic_stats(quality.rank_ic(scored(spark, sf_dir), MIN_STOCKS))
    return rounded(pf.reward(stats.select("formula_id", "icir"), daily(spark, sf_dir)), "reward")


FEES = "greatest(l_extendedprice * 0.00025, 5.0) AS commission, CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.0005 ELSE 0 END AS stamp_tax, l_extendedprice * 0.00001 AS transfer_fee, l_extendedprice * 0.0005 AS slippage"


@query("trade_cost", f"WITH c AS (SELECT l_returnflag, {FEES} FROM lineitem) SELECT l_returnflag AS flag, round(sum(commission), 2) + 0.0 AS commission, round(sum(stamp_tax), 2) + 0.0 AS stamp_tax, round(sum(commission + stamp_tax + transfer_fee + slippage), 2) + 0.0 AS total FROM c GROUP BY 1")
def trade_cost(spark, sf_dir):
    line = fixtures.read(spark, sf_dir, "lineitem")
    fees = pf.trade_cost(F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy"), F.col("l_extendedprice").cast("double"))
    own = line.select(F.col("l_returnflag").alias("flag"), fees.alias("f")).groupBy("flag").agg(F.sum("f.commission").alias("commission"), F.sum("f.stamp_tax").alias("stamp_tax"), F.sum("f.total").alias("total"))
    return rounded(own, "commission", "stamp_tax", "total", places=2)


@query("rebalance_cost", f"{BOOK}, o AS (SELECT formula_id, sess, abs(d) * 100000 AS a, d < 0 AS sell FROM net WHERE abs(d) > 1e-12) SELECT formula_id, sess, round(sum(greatest(a * 0.00025, 5) + a * 0.00051 + CASE WHEN sell THEN a * 0.0005 ELSE 0 END) / 100000, 6) + 0.0 AS cost FROM o GROUP BY 1, 2")
def rebalance_cost(spark, sf_dir):
    w = weights(spark, sf_dir).select("formula_id", "sym", "sess", F.col("weight").alias("d"))
    gone = w.select("formula_id", "sym", (F.col("sess") + 1).alias("sess"), (-F.col("d")).alias("d")).where(F.col("sess") <= last_session(spark, sf_dir))
    net = w.unionByName(gone).groupBy("formula_id", "sym", "sess").agg(F.sum("d").alias("d")).where("abs(d) > 1e-12")
    fees = pf.trade_cost(F.when(F.col("d") < 0, "sell").otherwise("buy"), F.abs("d") * 100_000)
    return rounded(net.select("formula_id", "sess", fees.alias("f")).groupBy("formula_id", "sess").agg((F.sum("f.total") / 100_000).alias("cost")), "cost")


DERIVED = """tw AS (SELECT count(*)::INT - 2 AS train_end FROM axis), wn AS (SELECT train_end, CASE WHEN train_end <= 2 THEN 0 ELSE greatest(1, least(round_even(train_end * (1 - 0.35::DOUBLE), 0)::INT, train_end - 2)) END AS s FROM tw),
wk AS (SELECT *, CASE WHEN train_end - s < 12 THEN 1 ELSE 4 END AS k FROM wn),
wi AS (SELECT w::INT AS win, (s + w * ((train_end - s) // k))::INT AS lo, (CASE WHEN w = k - 1 THEN train_end ELSE s + (w + 1) * ((train_end - s) // k) END)::INT AS hi FROM wk, unnest(generate_series(0, k - 1)) t(w))"""


@query("reward_val_median", f"{BOOK}, {DERIVED}, i AS (SELECT formula_id, win, CASE WHEN count(ic) >= 2 THEN avg(ic) / (stddev_samp(ic) + 1e-9) ELSE 0 END AS icir FROM ic JOIN axis USING (dt) JOIN wi ON sess >= lo AND sess < hi GROUP BY 1, 2), c AS (SELECT formula_id, win, avg(cost) * 252 AS cost FROM daily JOIN wi ON sess >= lo AND sess < hi GROUP BY 1, 2) SELECT formula_id, round(median(least(greatest(icir - cost, -1), 1)), 6) + 0.0 AS val_reward, round(median(icir), 6) + 0.0 AS val_icir FROM i JOIN c USING (formula_id, win) GROUP BY 1")
def reward_val_median(spark, sf_dir):
    """Median over the validation windows, derived from the calendar however long it is, of the reward and of the ICIR."""
    own = axis(spark, sf_dir)
    training = protocol.training_window(own, F.lit("9999-12-31").cast("date")).withColumn("fold", F.lit(0))
    wins = protocol.validation_windows(training).select(F.col("window").alias("win"), "lo", "hi")
    return rounded(validation(spark, sf_dir, F.broadcast(wins)), "val_reward", "val_icir")


def validation(spark, sf_dir, wins):
    inside = (F.col("sess") >= F.col("lo")) & (F.col("sess") < F.col("hi"))
    ics = quality.rank_ic(scored(spark, sf_dir), MIN_STOCKS).join(F.broadcast(axis(spark, sf_dir)), "dt").join(wins, inside)
    icir = ics.groupBy("formula_id", "win").agg(F.when(F.count("ic") >= 2, F.avg("ic") / (F.stddev_samp("ic") + 1e-9)).otherwise(0.0).alias("icir"))
    cost = daily(spark, sf_dir).join(wins, inside).groupBy("formula_id", "win").agg((F.avg("cost") * 252).alias("cost"))
    each = icir.join(cost, ["formula_id", "win"]).withColumn("reward", F.least(F.greatest(F.col("icir") - F.col("cost"), F.lit(-1.0)), F.lit(1.0)))
    return each.groupBy("formula_id").agg(F.median("reward").alias("val_reward"), F.median("icir").alias("val_icir"))
