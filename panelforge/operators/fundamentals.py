"""Point-in-time fundamentals: as-of joins, single periods and trailing four quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import finite

def asof_ffill(cells: DataFrame, events: DataFrame, at: str, values: list[str], tie: str = "report_date") -> DataFrame:
    """``cells`` (``sym, dt, ...``) with the latest ``values`` whose date ``at`` is not after ``dt``.

    Events are laid between the cells of their symbol and carried forward; each value skips its own NULLs and NaN. Events of one date
    are taken in the order of ``tie``, so the later report wins. One exchange on ``sym`` serves all values.
    """
    own = cells.select(*cells.columns, F.lit(1).alias("_cell"), F.lit(None).cast("date").alias("_tie"), *(F.lit(None).cast("double").alias(f"_{v}") for v in values))
    news = events.where(F.col(at).isNotNull()).select("sym", F.col(at).alias("dt"), F.lit(0).alias("_cell"), F.col(tie).alias("_tie"), *(finite(F.col(v).cast("double")).alias(f"_{v}") for v in values))
    w = Window.partitionBy("sym").orderBy("dt", "_cell", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(news, allowMissingColumns=True)
    return both.withColumns({v: F.last(f"_{v}", ignorenulls=True).over(w) for v in values}).where("_cell = 1").drop("_cell", "_tie", *(f"_{v}" for v in values))


def ytd_to_single(reports: DataFrame, cum: str, single: str) -> DataFrame:
    """Adds the period's own amount: the cumulative one less the last one known before it in the same fiscal year.

    Reports without the cumulative amount (NULL or NaN) stay and have none.
    """
    known = F.when(~F.isnan(F.col(cum).cast("double")), F.col(cum))
    before = Window.partitionBy("sym", F.year("report_date")).orderBy("report_date").rowsBetween(Window.unboundedPreceding, -1)
    return reports.withColumn(single, known - F.coalesce(F.last(known, ignorenulls=True).over(before), F.lit(0.0)))


def ttm4(reports: DataFrame, single: str, out: str) -> DataFrame:
    """Adds the sum of the last four periods that are known, NULL unless they span 265 to 285 days.

    Each series counts its own periods: a report without this amount neither takes a place nor gets a sum.
    """
    has = F.col(single).isNotNull()
    w = Window.partitionBy("sym", has).orderBy("report_date")
    days = F.datediff("report_date", F.lag("report_date", 3).over(w))
    return reports.withColumn(out, F.when(has & days.between(265, 285), F.sum(single).over(w.rowsBetween(-3, 0))))


def trailing_reports(reports: DataFrame) -> DataFrame:
    """``sym, report_date, announce_date, eps_ttm, revenue_ttm, profit_ttm, bvps, net_margin``."""
    for cum, name in (("eps_cum", "eps"), ("revenue_cum", "revenue"), ("profit_cum", "profit")):
        reports = ttm4(ytd_to_single(reports, cum, f"{name}_q"), f"{name}_q", f"{name}_ttm")
    return reports.withColumn("ps_part", F.when((F.col("profit_ttm") > 0) & (F.col("revenue_ttm") > 0), F.try_divide("profit_ttm", "revenue_ttm")))


#: What :func:`ratios` reads.
VALUED = ["eps_ttm", "bvps", "ps_part", "net_margin"]


def ratios(own: DataFrame) -> DataFrame:
    """``own``, with the latest :data:`VALUED`, and ``PE_TTM, PB, PS_TTM, NET_MARGIN``."""
    pe = F.when(F.col("eps_ttm") > 0, F.try_divide("close", "eps_ttm"))
    return own.withColumns({"PE_TTM": pe, "PB": F.when(F.col("bvps") > 0, F.try_divide("close", "bvps")), "PS_TTM": pe * F.col("ps_part")}).withColumnRenamed("net_margin", "NET_MARGIN")


def valuation(cells: DataFrame, reports: DataFrame) -> DataFrame:
    """``cells`` with ``PE_TTM, PB, PS_TTM`` and the margin level of the latest reports."""
    return ratios(asof_ffill(cells, trailing_reports(reports), "announce_date", VALUED))


def reports_and_balances(cells: DataFrame, reports: DataFrame, margin: DataFrame, values: list[str], sessions: int = 20) -> DataFrame:
    """``cells`` with the latest ``values`` of ``reports``, :func:`valuation` and :func:`balance_change`, in one exchange on ``sym``.

    Balances (``sym, dt, rzye``, one a symbol and date) are laid between the cells like reports; only one of the cell's own date counts.
    """
    known = finite(F.col("rzye").cast("double"))
    balance = margin.where(known.isNotNull()).select("sym", F.col("dt").alias("announce_date"), "rzye", F.unix_date("dt").alias("_day"))
    events = trailing_reports(reports).unionByName(balance, allowMissingColumns=True)
    own = asof_ffill(cells, events, "announce_date", [*values, *VALUED, "rzye", "_day"])
    own = ratios(own).withColumn("rzye", F.when(F.col("_day") == F.unix_date("dt"), F.col("rzye")))
    change = F.try_divide("rzye", F.lag("rzye", sessions).over(Window.partitionBy("sym").orderBy("sess"))) - 1
    return own.withColumn("MARGIN_BALANCE_CHG", change).drop("eps_ttm", "bvps", "ps_part", "rzye", "_day")


def balance_change(cells: DataFrame, margin: DataFrame, sessions: int = 20) -> DataFrame:
    """``cells`` with ``MARGIN_BALANCE_CHG``: the balance against that of ``sessions`` sessions before."""
    w = Window.partitionBy("sym").orderBy("sess")
    own = cells.join(margin.select("sym", "dt", "rzye"), ["sym", "dt"], "left")
    return own.withColumn("MARGIN_BALANCE_CHG", F.try_divide("rzye", F.lag("rzye", sessions).over(w)) - 1)


def industry_momentum(cells: DataFrame, index: DataFrame, member: DataFrame, sessions: int = 20) -> DataFrame:
    """``cells`` with ``INDUSTRY_MOMENTUM``: the return of the symbol's industry index (``industry, sess, close``)."""
    w = Window.partitionBy("industry").orderBy("sess")
    moved = index.select("industry", "sess", (F.try_divide("close", F.lag("close", sessions).over(w)) - 1).alias("INDUSTRY_MOMENTUM"))
    return cells.drop("industry").join(member.select("sym", "industry"), "sym", "left").join(moved, ["industry", "sess"], "left")
