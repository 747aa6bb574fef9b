"""Top-N portfolios for many candidates at once: selection, weights, costs, curves and metrics.

A candidate is a ``formula_id``; everything is keyed on (candidate, session), so candidates and sessions run in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import by_session

YEAR = 252


@dataclass(frozen=True)
class Costs:
    commission: float = 0.00025
    min_commission: float = 5.0
    stamp: float = 0.0005
    transfer: float = 0.00001
    slippage: float = 0.0005

    @property
    def buy_rate(self) -> float:
        return self.commission + self.transfer + self.slippage

    @property
    def sell_rate(self) -> float:
        return self.buy_rate + self.stamp


def trade_cost(side: Column, amount: Column, costs: Costs = Costs()) -> Column:
    """A struct of fees for one order; nothing for an amount of 0."""
    some = amount > 0
    fee = lambda x: F.when(some, x).otherwise(0.0)
    commission = fee(F.greatest(amount * costs.commission, F.lit(costs.min_commission)))
    stamp = fee(F.when(side == "sell", amount * costs.stamp).otherwise(0.0))
    transfer, slippage = fee(amount * costs.transfer), fee(amount * costs.slippage)
    return F.struct(commission.alias("commission"), stamp.alias("stamp_tax"), transfer.alias("transfer_fee"), slippage.alias("slippage"), (commission + stamp + transfer + slippage).alias("total"))


def selectable(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """Signals that can be bought at the next open: ``formula_id, sym, dt, sess, signal, fwd, sell_blocked``.

    ``panel`` has ``elig, blocked_buy, blocked_sell, fwd``; the next session's flags decide.
    """
    w = by_session()
    flags = panel.select("sym", "dt", "sess", "fwd", F.lead("elig", 1).over(w).alias("_e"), F.lead("blocked_buy", 1).over(w).alias("_b"), F.lead("blocked_sell", 1).over(w).alias("sell_blocked"))
    own = signals.where("elig and signal is not null").select("formula_id", "sym", "dt", "signal")
    return own.join(flags, ["sym", "dt"]).where("_e and not _b").drop("_e", "_b")


def top_n(candidates: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest signals of each candidate and date, ties by symbol. The rank filter prunes before the exchange."""
    order = Window.partitionBy("formula_id", "dt").orderBy(F.desc("signal"), "sym")
    return candidates.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)


def target_weights(picks: DataFrame, n: int, cap: float = 0.05) -> DataFrame:
    """Equal weights under the cap, raised to a sum of 1."""
    raw = F.lit(min(1.0 / n, cap))
    return picks.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy("formula_id", "dt")))


def turnover(weights: DataFrame, last_session: int) -> DataFrame:
    """``formula_id, sess, buys, sells, turnover``: a position is a purchase on its session and a sale on the next, netted by symbol."""
    w = weights.select("formula_id", "sym", "sess", F.col("weight").alias("d"))
    gone = w.select("formula_id", "sym", (F.col("sess") + 1).alias("sess"), (-F.col("d")).alias("d")).where(F.col("sess") <= last_session)
    net = w.unionByName(gone).groupBy("formula_id", "sym", "sess").agg(F.sum("d").alias("d"))
    zero = F.lit(0.0)
    return net.groupBy("formula_id", "sess").agg(F.sum(F.greatest("d", zero)).alias("buys"), F.sum(F.greatest(-F.col("d"), zero)).alias("sells"), F.sum(F.abs("d")).alias("turnover"))


def gross_return(weights: DataFrame) -> DataFrame:
    return weights.groupBy("formula_id", "sess").agg(F.sum(F.col("weight") * F.col("fwd")).alias("gross"))


def topn_returns(weights: DataFrame, last_session: int, costs: Costs = Costs()) -> DataFrame:
    """``formula_id, sess, gross, cost, net, turnover`` with fees in proportion, for all candidates in one pass."""
    moved = turnover(weights, last_session).join(gross_return(weights), ["formula_id", "sess"], "left").withColumn("gross", F.coalesce("gross", F.lit(0.0)))
    cost = F.col("buys") * costs.buy_rate + F.col("sells") * costs.sell_rate
    return moved.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost")).select("formula_id", "sess", "gross", "cost", "net", "turnover")


def topn_ledger(picks: DataFrame, held: DataFrame, sessions: DataFrame, capital: float = 100_000.0, costs: Costs = Costs()) -> DataFrame:
    """As :func:`topn_returns` with the two path-dependent rules, per candidate and window.

    ``picks``: ``formula_id, window, sess, sym, weight``; ``held``: ``sess, sym, fwd, sell_blocked`` for symbols that any
    candidate picks; ``sessions``: ``window, sess``. Names that cannot be sold stay at their weight and the rest is scaled; the least
    commission depends on the capital, which compounds. A group holds the picks of one candidate and window.
    """
    schema = "formula_id string, window long, sess int, gross double, cost double, net double, turnover double, n_held int"
    names = picks.select("formula_id", "window", "sym").distinct()
    cells = names.join(held, "sym").join(F.broadcast(sessions), "sess", "left_semi") if "window" not in sessions.columns else names.join(F.broadcast(sessions), "window").join(held, ["sess", "sym"], "left")
    own = cells.join(picks.select("formula_id", "window", "sess", "sym", "weight"), ["formula_id", "window", "sess", "sym"], "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        money, book, out = capital, {}, []
        rows = rows.sort_values(["sess", "sym"])
        for sess, day in rows.groupby("sess"):
            fwd = dict(zip(day.sym, day.fwd.fillna(0.0), strict=True))
            blocked = {s for s, b in zip(day.sym, day.sell_blocked, strict=True) if b is None or b != b or b}
            target = {s: w for s, w in zip(day.sym, day.weight, strict=True) if w == w and w > 0}
            for s, w in book.items():
                if s in blocked and target.get(s, 0.0) < w:
                    target[s] = w
            total = sum(target.values())
            target = {s: w / total for s, w in target.items()} if total > 0 else {}
            fees = moved = 0.0
            for s in sorted(set(book) | set(target)):
                d = target.get(s, 0.0) - book.get(s, 0.0)
                moved += abs(d)
                amount = abs(d) * money
                if amount > 0:
                    fees += max(amount * costs.commission, costs.min_commission) + amount * (costs.transfer + costs.slippage + (costs.stamp if d < 0 else 0.0))
            gross, cost = sum(w * fwd.get(s, 0.0) for s, w in target.items()), fees / money if money > 0 else 0.0
            net = gross - cost
            out.append((rows.formula_id.iloc[0], rows.window.iloc[0], sess, gross, cost, net, moved, len(target)))
            money, book = money * (1 + net), target
        return pd.DataFrame(out, columns=["formula_id", "window", "sess", "gross", "cost", "net", "turnover", "n_held"])

    return own.groupBy("formula_id", "window").applyInPandas(run, schema)


def curve(daily: DataFrame) -> DataFrame:
    """Adds ``equity`` (from 1) and ``drawdown``."""
    w = Window.partitionBy("formula_id").orderBy("sess").rowsBetween(Window.unboundedPreceding, 0)
    own = daily.withColumn("equity", F.product(1 + F.col("net")).over(w))
    return own.withColumn("drawdown", 1 - F.col("equity") / (F.greatest(F.max("equity").over(w), F.lit(1.0)) + 1e-12))


def perf_metrics(curves: DataFrame) -> DataFrame:
    """Per candidate: total, annual, volatility (the sample's), Sharpe over 2 %, largest drawdown, Calmar, mean turnover."""
    n = F.count(F.lit(1)).cast("double")
    own = curves.groupBy("formula_id").agg(n.alias("n"), (F.max_by("equity", "sess") - 1).alias("total"), (F.coalesce(F.stddev_samp("net"), F.lit(0.0)) * YEAR**0.5).alias("vol"), F.max("drawdown").alias("max_drawdown"), F.avg("turnover").alias("turnover"))
    own = own.withColumn("annual", F.pow(1 + F.col("total"), YEAR / F.col("n")) - 1)
    return own.withColumn("sharpe", F.try_divide(F.col("annual") - 0.02, F.col("vol") + 1e-9)).withColumn("calmar", F.try_divide("annual", F.col("max_drawdown") + 1e-9))


def sortino(daily: DataFrame) -> DataFrame:
    down = F.when(F.col("net") < 0, F.col("net"))
    spread = F.when(F.count(down) >= 3, F.stddev_samp(down) * YEAR**0.5).otherwise(F.coalesce(F.stddev_samp("net"), F.lit(0.0)) * YEAR**0.5 + 1e-6)
    return daily.groupBy("formula_id").agg((F.avg("net") * YEAR / (spread + 1e-9)).alias("sortino"))


def equal_weight_benchmark(panel: DataFrame) -> DataFrame:
    """``sess, bench``: the mean forward return over cells eligible now and on the next session."""
    own = panel.withColumn("_e", F.col("elig") & F.coalesce(F.lead("elig", 1).over(by_session()), F.lit(False)))
    return own.groupBy("sess").agg(F.coalesce(F.avg(F.when(F.col("_e"), F.col("fwd"))), F.lit(0.0)).alias("bench"))


def excess(daily: DataFrame, bench: DataFrame) -> DataFrame:
    return daily.join(bench, "sess").withColumn("excess", F.col("net") - F.col("bench"))


def positions_snapshot(weights: DataFrame, axis: DataFrame) -> DataFrame:
    """Per candidate and signal date: entry and exit date and the book, by symbol."""
    when = axis.select("sess", F.lead("dt", 1).over(Window.orderBy("sess")).alias("entry"), F.lead("dt", 2).over(Window.orderBy("sess")).alias("exit"))
    book = weights.groupBy("formula_id", "dt", "sess").agg(F.sort_array(F.collect_list(F.struct("sym", F.round("weight", 6).alias("weight")))).alias("book"))
    return book.join(F.broadcast(when), "sess").drop("sess")


def positions_page(snapshots: DataFrame, names: DataFrame, offset: int, limit: int) -> DataFrame:
    """Newest first; rows of the page with symbols' names."""
    page = snapshots.orderBy(F.desc("dt"), "formula_id").offset(offset).limit(limit)
    each = page.select("formula_id", "dt", F.explode("book").alias("p")).select("formula_id", "dt", F.col("p.sym").alias("sym"), F.col("p.weight").alias("weight"))
    return each.join(names.select("sym", "name"), "sym", "left")


def reward(icir: DataFrame, daily: DataFrame, weight: float = 1.0, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """ICIR less the yearly cost, cut to a range."""
    cost = daily.groupBy("formula_id").agg((F.avg("cost") * YEAR).alias("cost"))
    return icir.join(cost, "formula_id").select("formula_id", F.least(F.greatest(F.col("icir") - weight * F.col("cost"), F.lit(low)), F.lit(high)).alias("reward"))
