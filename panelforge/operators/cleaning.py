"""Cleaning of provider tables: symbols, dates, bars, reports and balances. All are column expressions and window passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.universe import first_at_or_after

# fixed values: exchange prefixes of stocks, and codes that look like stocks but are indices, whatever exchange is named
PREFIXES = {
    "SH": ["600", "601", "603", "605", "688", "689"],
    "SZ": ["000", "001", "002", "003", "300", "301"],
    "BJ": ["430", "830", "831", "832", "833", "834", "835", "836", "837", "838", "839", "870", "871", "872", "873", "874", "875", "876", "877", "878", "879", "920"],
}
INDEX_CODES = ["000016", "000300", "000688", "000852", "000902", "000903", "000904", "000905", "000906", "000907", "000922"]


#: Ways to write a date beside eight digits; month before day where both are numbers.
DATE_PATTERNS = ["yyyy-M-d[ H:m[:s]]", "yyyy-M-d'T'H:m[:s]", "yyyy/M/d[ H:m[:s]]", "yyyy.M.d[ H:m[:s]]", "yyyyMMdd H:m[:s]", "M/d/yyyy[ H:m[:s]]", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-M"]


def numeric(x: Column) -> Column:
    """A double, NULL for text that is no number and for infinities and NaN."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def valid_symbol(symbol: Column) -> Column:
    """Whether it is a stock's code with its exchange; blanks around it do not matter."""
    symbol = F.trim(symbol)
    prefix, suffix = F.substring(symbol, 1, 3), F.substring(symbol, 8, 10)
    known = F.lit(False)
    for exchange, own in PREFIXES.items():
        known = known | ((suffix == exchange) & prefix.isin(own))
    return F.coalesce(symbol.rlike(r"^[0-9]{6}\.(SH|SZ|BJ)$") & known & ~F.substring(symbol, 1, 6).isin(INDEX_CODES), F.lit(False))


def map_symbol(code: Column) -> Column:
    """A bare code with the exchange that its first character stands for; a code with a point stays."""
    code = F.trim(code)
    first = F.substring(code, 1, 1)
    exchange = F.when(first.isin("6", "9"), ".SH").when(first.isin("4", "8"), ".BJ").otherwise(".SZ")
    return F.when(code.contains("."), code).otherwise(F.concat(code, exchange))


def clean_date(text: Column) -> Column:
    """A date from eight digits, with or without dashes or slashes, or from another usual way to write one, a time behind it or not.

    NULL for the rest: nothing is made up.
    """
    t = F.trim(text)
    compact = F.regexp_replace(t, "[-/]", "")
    eight = compact.rlike("^[0-9]{8}$")
    other = [F.try_to_timestamp(t, F.lit(p)).cast("date") for p in DATE_PATTERNS]
    return F.when(eight, F.try_to_date(F.when(eight, compact), "yyyyMMdd")).otherwise(F.coalesce(*other))


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: the one with the highest ``seq``. The rank filter prunes before the exchange."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where("_k = 1").drop("_k")


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Bars fit for a panel, from columns of any type plus ``seq`` (ingestion order).

    Prices must be positive; the last duplicate counts. ``pre_close``, if the feed has it, is carried forward from the symbol's
    last one; a feed without it has the close before. What is still missing is the open. Volume and amount default to 0;
    ``adj_factor`` is carried forward, then back, within its symbol.
    """
    prices, rest = ["open", "high", "low", "close"], ["pre_close", "volume", "amount", "turnover_rate", "adj_factor"]
    fed = "pre_close" in raw.columns
    raw = raw if fed else raw.withColumn("pre_close", F.lit(None).cast("double"))
    own = raw.withColumns({c: numeric(F.col(c)) for c in prices + rest})
    own = own.where(F.col("dt").isNotNull() & (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0))
    own = keep_last(own, ["sym", "dt"], "seq")
    w = Window.partitionBy("sym").orderBy("dt")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0.0)
    return own.withColumns({"pre_close": F.coalesce(F.last("pre_close", True).over(before) if fed else F.lag("close").over(w), "open"), "volume": F.coalesce("volume", zero), "amount": F.coalesce("amount", zero), "adj_factor": F.coalesce(F.last("adj_factor", True).over(before), F.first("adj_factor", True).over(after))})


def clean_stock_metadata(raw: DataFrame) -> DataFrame:
    """``sym, name, industry, list_date, is_st``: valid symbols, the last duplicate; columns that are not there are missing.

    The flag is read from the name where it is missing; listing dates are read by :func:`clean_date`.
    """
    absent = [c for c in ("name", "industry", "list_date") if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in absent} | ({} if "is_st" in raw.columns else {"is_st": F.lit(None).cast("boolean")}))
    own = keep_last(raw.where(valid_symbol(F.col("sym"))), ["sym"], "seq")
    name = F.coalesce("name", F.lit(""))
    return own.select("sym", name.alias("name"), "industry", clean_date(F.col("list_date").cast("string")).alias("list_date"), F.coalesce("is_st", F.upper(name).contains("ST")).alias("is_st"))


def merge_stock_details(base: DataFrame, details: DataFrame) -> DataFrame:
    """All symbols of both lists; a detail's name and date are preferred."""
    d = details.select("sym", F.col("name").alias("_name"), "list_date")
    return base.join(d, "sym", "full").withColumn("name", F.coalesce("_name", "name")).drop("_name")


def clean_provider_bars(feed: DataFrame, names: dict[str, str], percent: list[str]) -> DataFrame:
    """A provider's columns under standard names, percentages as fractions, dates as dates."""
    own = feed.withColumnsRenamed(names)
    return own.withColumns({"dt": clean_date(F.col("dt").cast("string"))} | {c: numeric(F.col(c)) / 100 for c in percent})


def disclosure_end(report: Column) -> Column:
    """The end of the statutory season in which a report date has to be announced."""
    y = F.year(report)
    return F.when(F.month(report) == 3, F.make_date(y, F.lit(4), F.lit(30))).when(F.month(report) == 6, F.make_date(y, F.lit(8), F.lit(31))).when(F.month(report) == 9, F.make_date(y, F.lit(10), F.lit(31))).when(F.month(report) == 12, F.make_date(y + 1, F.lit(4), F.lit(30)))


def clean_earnings(raw: DataFrame) -> DataFrame:
    own = raw.where(F.col("sym").isNotNull() & F.col("report_date").isNotNull())
    return own.withColumn("announce_date", disclosure_end(F.col("report_date"))).withColumn("net_margin", F.try_divide("profit", "revenue") * 100)


def clean_indicator(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"roa": numeric(F.col("roa")), "debt_ratio": numeric(F.col("debt_ratio"))}).where(F.col("report_date").isNotNull())


def clean_dividend(raw: DataFrame) -> DataFrame:
    return raw.withColumn("dividend_yield", numeric(F.col("dividend_yield")) / 100).where(F.col("ex_date").isNotNull())


def clean_margin(*feeds: DataFrame) -> DataFrame:
    """Balances of several exchanges in one table, the later feed and row counting."""
    both = None
    for k, feed in enumerate(feeds):
        own = feed.withColumn("rzye", numeric(F.col("rzye"))).where("rzye is not null").withColumn("_seq", F.struct(F.lit(k).alias("feed"), F.col("seq").alias("seq")))
        both = own if both is None else both.unionByName(own, allowMissingColumns=True)
    return keep_last(both, ["sym", "dt"], "_seq").drop("_seq")


def clean_industry(raw: DataFrame) -> DataFrame:
    return raw.withColumn("index_code", F.regexp_replace("index_code", r"\.SI$", "")).dropDuplicates()


def clean_index_closes(raw: DataFrame) -> DataFrame:
    """``index_code, dt, close`` of index histories: codes without their suffix, dates and closes read from text; rows without either
    go, and the last of a code and date (``seq``) counts."""
    own = clean_industry(raw).withColumns({"dt": clean_date(F.col("dt").cast("string")), "close": numeric(F.col("close"))}).where("dt is not null and close is not null")
    return keep_last(own, ["index_code", "dt"], "seq").select("index_code", "dt", "close")


def attach_announce_date(supplement: DataFrame, earnings: DataFrame) -> DataFrame:
    """Supplement rows with the announce date of the earnings row of their report; others go."""
    return supplement.join(earnings.select("sym", "report_date", "announce_date").distinct(), ["sym", "report_date"])


def quarter_ends(spans: DataFrame) -> DataFrame:
    """``quarter_end`` for each quarter that ends within (``first``, ``last``)."""
    months = F.explode(F.sequence(F.trunc("first", "quarter"), F.col("last"), F.expr("interval 3 months")))
    return spans.select("first", "last", months.alias("m")).select(F.last_day(F.add_months("m", 2)).alias("quarter_end"), "first", "last").where("quarter_end between first and last").select("quarter_end").distinct()


def date_index(axis: DataFrame, dates: DataFrame) -> DataFrame:
    """``d, idx``: the first session not before each date, at least 1, and the number of sessions past the end."""
    return first_at_or_after(dates.select("d").distinct(), axis, "d").select("d", F.greatest("idx", F.lit(1)).alias("idx"))


def universe_pick(constituents: DataFrame, listed: DataFrame, limit: int | None = None) -> DataFrame:
    """Valid constituents that are listed; ``limit`` by symbol if given.

    Only where no constituent is valid, the valid listed symbols stand in. An intersection may be empty; without any list, constituents stay.
    """
    valid = lambda df: df.where(valid_symbol(F.col("sym"))).select("sym").distinct()
    own = valid(constituents)
    own = valid(listed) if own.isEmpty() else own
    own = own if listed.isEmpty() else own.join(listed.select("sym").distinct(), "sym", "left_semi")
    return own.orderBy("sym").limit(limit) if limit else own


def encode_groups(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """``df`` with ``code``: labels numbered from 0 in their order. NULL has no code and shifts none of the others."""
    labels = df.where(F.col(label).isNotNull()).select(label).distinct()
    return df.join(labels.withColumn(code, F.row_number().over(Window.orderBy(label)) - 1), label, "left")
