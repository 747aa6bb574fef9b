"""Panel inputs derived from the star-schema tables: a line item is a tick.

Two grains: by month, where a supplier is a symbol and its nation its industry; by day, where ``GROUPED`` suppliers with
neighbouring keys are one symbol, named after the first of them, and its region is its industry. Daily calendars are long enough
for every window, and about four in ten symbols do not trade on a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAR = "9999-12-31"
GROUPED = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol(key: str, daily: bool):
    return F.floor(F.col(key) / GROUPED) if daily else F.col(key)


def session(daily: bool):
    return F.to_date("l_shipdate") if daily else F.trunc("l_shipdate", "month")


def code(sym):
    """A code on one of three boards, with price bands of their own: the board's three digits, then the key, three digits or more."""
    key = F.when(sym < 1_000, F.lpad(sym.cast("string"), 3, "0")).otherwise(sym.cast("string"))
    return F.concat(F.when(sym % 3 == 0, "600").when(sym % 3 == 1, "300").otherwise("001"), key)


def suppliers(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """``sym, s_name, s_nationkey, s_acctbal``, one row a symbol."""
    own = read(spark, sf_dir, "supplier")
    own = own.where(F.col("s_suppkey") % GROUPED == 0) if daily else own
    return own.withColumn("sym", symbol("s_suppkey", daily)).drop("s_suppkey")


def bars(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """One exchange by symbol serves the bars, their windows and every later join on the symbol."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    ticks = read(spark, sf_dir, "lineitem").select(symbol("l_suppkey", daily).alias("sym"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").repartition("sym")
    ticks = ticks.select("sym", session(daily).alias("dt"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), order.alias("at"), "l_quantity", "l_extendedprice")
    daily = ticks.groupBy("sym", "dt").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").cast("double").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).cast("double").alias("amount"),
    )
    own = Window.partitionBy("sym")
    return daily.withColumn("pre_close", F.lag("close").over(own.orderBy("dt"))).withColumn("turnover_rate", F.col("volume") / F.sum("volume").over(own))


def calendar(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(session(daily).alias("dt")).distinct().withColumn("is_open", F.lit(True))


def stocks(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """Symbols that trade. By month a symbol is listed with its first bar; by day some are listed as much as 99 days before or after it."""
    first = read(spark, sf_dir, "lineitem").groupBy(symbol("l_suppkey", daily).alias("sym")).agg(F.min(session(daily)).alias("list_date"))
    first = first.withColumn("list_date", F.expr("date_add(list_date, cast(sym * 37 % 199 - 99 as int))")) if daily else first
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey", F.col("n_name").alias("industry"))
    if daily:
        nation = nation.drop("industry").join(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("industry")), "n_regionkey")
    own = suppliers(spark, sf_dir, daily).join(nation, "s_nationkey").join(first, "sym")
    return own.select("sym", F.col("s_name").alias("name"), "industry", "list_date", (F.col("sym") % 17 == 0).alias("is_st"), code(F.col("sym")).alias("ticker"))


def constituents(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("index_code"))
    first = stocks(spark, sf_dir, daily).select("sym", F.col("list_date").alias("first"))
    own = suppliers(spark, sf_dir, daily).join(nation, "s_nationkey").join(region, "n_regionkey").join(first, "sym")
    main = own.select("index_code", "sym", F.add_months("first", (F.col("sym") % 6).cast("int")).alias("in_date"), F.when(F.col("sym") % 5 == 0, F.lit("1999-01-01")).otherwise(FAR).cast("date").alias("out_date"))
    again = own.where("sym % 10 = 0").select("index_code", "sym", F.lit("2000-01-01").cast("date").alias("in_date"), F.lit(FAR).cast("date").alias("out_date"))
    return main.where("in_date < out_date").unionByName(again)


def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bars(spark, sf_dir).where("sym % 7 <> month(dt) % 7")
    return own.select("sym", "dt", (F.col("amount") * (1 + F.col("sym") % 3)).alias("rzye"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-to-date quarterly reports with gaps: whole reports are missing, and single amounts of others (NULL, or NaN for the profit)."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sym"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), "l_extendedprice", "l_discount")
    single = line.groupBy("sym", "y", "q").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.sum(F.col("l_extendedprice") * (0.06 - F.col("l_discount"))).alias("profit"))
    to_date = Window.partitionBy("sym", "y").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    bvps = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sym"), (F.col("s_acctbal") / 100).cast("double").alias("bvps"))
    own = single.withColumn("revenue_cum", F.round(F.sum("revenue").over(to_date), 4)).withColumn("profit_cum", F.round(F.sum("profit").over(to_date), 4)).join(bvps, "sym")
    report = F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1)))
    announce = F.when(F.col("q") == 1, F.make_date("y", F.lit(4), F.lit(30))).when(F.col("q") == 2, F.make_date("y", F.lit(8), F.lit(31))).when(F.col("q") == 3, F.make_date("y", F.lit(10), F.lit(31))).otherwise(F.make_date(F.col("y") + 1, F.lit(4), F.lit(30)))
    own = own.where("(sym + q) % 11 <> 0")
    gap = F.col("sym") * 4 + F.col("y") * 3 + F.col("q")
    return own.select("sym", report.alias("report_date"), announce.alias("announce_date"), F.when(gap % 23 != 5, F.col("revenue_cum")).alias("revenue_cum"), F.when(gap % 29 == 7, float("nan")).otherwise(F.col("profit_cum")).alias("profit_cum"), F.when(gap % 19 != 3, F.col("profit_cum") / 1e5).alias("eps_cum"), "bvps", (F.try_divide("profit_cum", "revenue_cum") * 100).alias("net_margin"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    sell, amount = F.col("l_returnflag") == "R", F.col("l_extendedprice").cast("double")
    fee = lambda x: F.when(F.col("l_linenumber") != 7, x)
    return line.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("sym"), F.to_date("l_shipdate").alias("dt"), F.when(sell, "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").cast("double").alias("quantity"), (amount / F.col("l_quantity")).alias("price"), amount.alias("amount"),
        fee(F.greatest(amount * 0.00025, F.lit(5.0))).alias("commission"), fee(F.when(sell, amount * 0.0005).otherwise(0.0)).alias("stamp_tax"), fee(amount * 0.00001).alias("transfer_fee"), fee(amount * 0.0005).alias("slippage"),
    )
