"""Trade-log and position analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.portfolio import Costs

FEES = ["commission", "stamp_tax", "transfer_fee", "slippage"]


def amount(side: str | None = None) -> Column:
    return F.sum(F.when(F.col("side") == side, F.col("amount")).otherwise(0.0) if side else F.col("amount"))


def fee_summary(trades: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return trades.agg(F.count_distinct("dt").alias("days"), F.count(F.lit(1)).alias("trades"), amount("buy").alias("buys"), amount("sell").alias("sells"), amount().alias("amount"), *(F.sum(F.coalesce(f, zero)).alias(f) for f in FEES))


def fees() -> Column:
    return sum((F.coalesce(F.col(f), F.lit(0.0)) for f in FEES[1:]), F.coalesce(F.col(FEES[0]), F.lit(0.0)))


def fees_by_year(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.year("dt").alias("year")).agg(F.sum(fees()).alias("fees"))


def cash_reconcile(trades: DataFrame, initial: float, recorded: DataFrame) -> DataFrame:
    """``expected, cash, gap, broken, drag``: cash from the log against the recorded one (``cash``)."""
    own = trades.agg(amount("buy").alias("b"), amount("sell").alias("s"), F.sum(fees()).alias("f")).select((F.lit(initial) - F.col("b") + F.col("s") - F.col("f")).alias("expected"), (F.col("f") / initial * 100).alias("drag"))
    return own.crossJoin(F.broadcast(recorded)).withColumn("gap", F.col("cash") - F.col("expected")).withColumn("broken", F.abs("gap") > 0.01)


def rebalance_orders(targets: DataFrame, holdings: DataFrame, equity: float) -> DataFrame:
    """``sym, side, quantity, step``: whole-lot orders from holdings to target weights, sales first, dropped names sold out."""
    both = targets.select("sym", "weight", "price").join(holdings.select("sym", "quantity"), "sym", "full")
    want = F.coalesce(F.floor(F.lit(equity) * F.col("weight") / F.col("price") / 100) * 100, F.lit(0)).cast("long")
    change = want - F.coalesce("quantity", F.lit(0)).cast("long")
    own = both.withColumn("change", F.when(change > 0, (change / 100).cast("long") * 100).otherwise(change)).where("change <> 0")
    side = F.when(F.col("change") < 0, "sell").otherwise("buy")
    return own.select("sym", side.alias("side"), F.abs("change").alias("quantity"), F.when(F.col("change") < 0, 0).otherwise(1).alias("step"))


def affordable_lots(cash: Column, price: Column, requested: Column, costs: Costs = Costs(), lot: int = 100) -> Column:
    """The largest whole-lot purchase that cash pays with fees: the two branches of the least commission bound it directly."""
    unit, rest = price * lot, costs.transfer + costs.slippage
    rate = F.floor((cash + 1e-9) / (unit * (1 + rest + costs.commission)))
    least = F.floor((cash + 1e-9 - costs.min_commission) / (unit * (1 + rest)))
    lots = F.greatest(F.lit(0), F.least(rate, least, F.floor(requested / lot)))
    return F.when((cash > 0) & (price > 0), lots * lot).otherwise(0).cast("long")


def order_block_reason(orders: DataFrame, panel: DataFrame, suspended: Column, up: Column, down: Column) -> DataFrame:
    """Orders with the reason that keeps them from trading on their date, NULL if none."""
    p = panel.select("sym", "dt", F.lit(True).alias("_cell"), F.col("close").isNull().alias("_none"), suspended.alias("_s"), up.alias("_u"), down.alias("_d"))
    why = F.when(F.col("_cell").isNull() | F.col("_none"), "missing_bar").when(F.col("_s"), "suspended").when((F.col("side") == "buy") & F.col("_u"), "limit_up").when((F.col("side") == "sell") & F.col("_d"), "limit_down")
    return orders.join(p, ["sym", "dt"], "left").withColumn("reason", why).drop("_cell", "_none", "_s", "_u", "_d")


def holdings_value(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """``sym, value``: quantity times the last known price."""
    last = prices.where("price is not null").groupBy("sym").agg(F.max_by("price", "dt").alias("price"))
    return holdings.join(last, "sym", "left").select("sym", (F.col("quantity") * F.coalesce("price", F.lit(0.0))).alias("value"))


def in_blocks(trades: DataFrame, blocks: int = 256) -> DataFrame:
    """Adds ``block``: consecutive stretches of a symbol's trades by ``seq``, so that no symbol is one group.

    Edges are a keyed sample of the rows themselves, in number about ``blocks`` over all symbols, so a symbol has them by its rows.
    """
    share = max(1, trades.count() // blocks)
    edge = F.pmod(F.xxhash64("sym", F.to_json(F.struct("seq"))), F.lit(share)) == 0
    edges = trades.where(edge).groupBy("sym").agg(F.collect_set("seq").alias("edges"))
    own = trades.join(F.broadcast(edges), "sym", "left")
    return own.withColumn("block", F.coalesce(F.size(F.filter("edges", lambda e: e <= F.col("seq"))), F.lit(0))).drop("edges")


def avg_cost(trades: DataFrame, blocks: int = 256) -> DataFrame:
    """``sym, quantity, avg_cost`` after all trades in order of ``seq``: purchases re-weigh, sales keep, a full exit resets.

    A quantity held is a running sum kept from falling below 0: the sum less its minimum. A trade then maps the cost linearly,
    and a block's maps make one; products run from the last trade that forgets the cost before it. All sums are within blocks.
    """
    change = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity")).cast("double")
    own = in_blocks(trades.select("sym", "seq", "side", "quantity", "price"), blocks).withColumn("d", change)
    order = Window.partitionBy("sym", "block").orderBy("seq", "side", "quantity", "price")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("s", F.sum("d").over(running))
    each = own.groupBy("sym", "block").agg(F.sum("d").alias("total"), F.min("s").alias("low"))
    before = Window.partitionBy("sym").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # blocks, not trades
    each = each.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    each = each.withColumn("held", F.col("start") - F.least(F.lit(0.0), F.coalesce(F.min(F.col("start") + F.col("low")).over(before), F.lit(0.0))))
    ends = each.groupBy("sym").agg(F.max_by(F.greatest(F.col("held") + F.col("total"), F.col("total") - F.col("low")), "block").alias("quantity"))
    own = own.withColumn("m", F.min("s").over(running)).join(each.select("sym", "block", "held"), ["sym", "block"])
    own = own.withColumn("after", F.greatest(F.col("held") + F.col("s"), F.col("s") - F.col("m")))
    own = own.withColumn("had", F.coalesce(F.lag("after").over(order), F.col("held")))
    buys, bought = F.col("side") == "buy", F.col("had") + F.col("quantity")
    keep = F.when(buys, F.when(bought > 0, F.col("had") / bought).otherwise(1.0)).when(F.col("after") > 0, 1.0).otherwise(0.0)
    add = F.when(buys & (bought > 0), F.col("quantity") * F.col("price") / bought).otherwise(0.0)
    own = own.select("sym", "block", "seq", "side", "quantity", "price", keep.alias("keep"), add.alias("add"))
    # over the later trades of the block: how many forget, and the logarithm of what the others keep
    later = Window.partitionBy("sym", "block").orderBy(F.desc("seq"), F.desc("side"), F.desc("quantity"), F.desc("price")).rowsBetween(Window.unboundedPreceding, -1)
    forgets, kept = (F.col("keep") == 0).cast("int"), F.log(F.when(F.col("keep") > 0, F.col("keep")).otherwise(1.0))
    own = own.withColumn("f", F.coalesce(F.sum(forgets).over(later), F.lit(0))).withColumn("l", F.coalesce(F.sum(kept).over(later), F.lit(0.0)))
    maps = own.groupBy("sym", "block").agg(F.when(F.max(forgets) > 0, 0.0).otherwise(F.exp(F.sum(kept))).alias("keep"), F.sum(F.when(F.col("f") == 0, F.col("add") * F.exp("l")).otherwise(0.0)).alias("add"))
    parts = maps.groupBy("sym").agg(F.array_sort(F.collect_list(F.struct("block", "keep", "add"))).alias("t"))  # blocks, not trades
    done = parts.select("sym", F.aggregate("t", F.lit(0.0), lambda c, x: c * x["keep"] + x["add"]).alias("avg_cost"))
    return done.join(ends, "sym").select("sym", "quantity", F.when(F.col("quantity") > 0, F.col("avg_cost")).otherwise(0.0).alias("avg_cost"))


def sellable_qty(trades: DataFrame) -> DataFrame:
    """``sym, dt, sellable``: what was held before each trading day of a symbol."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    daily = trades.groupBy("sym", "dt").agg(F.sum(signed).alias("d"))
    w = Window.partitionBy("sym").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select("sym", "dt", F.greatest(F.coalesce(F.sum("d").over(w), F.lit(0.0)), F.lit(0.0)).alias("sellable"))
