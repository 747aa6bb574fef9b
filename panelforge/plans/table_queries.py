"""Queries on cleaning, upserts, sources and the trade log, on inputs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import digits
from panelforge.operators import cleaning as cl
from panelforge.operators import panel, returns, trades, upserts
from panelforge.plans.base_sql import BARS
from panelforge.plans.panel_queries import REPORTS, TRADE, axis
from panelforge.plans.registry import query
from panelforge.sources import files, fixtures
from panelforge.sources.shared import scratch
from panelforge.sources.versioned import Table

# symbols made of keys: six digits and an exchange by remainder, some of them wrong
CODE = "lpad(CAST((CASE {k} % 9 WHEN 0 THEN 600000 WHEN 1 THEN 300000 WHEN 2 THEN 1 WHEN 3 THEN 830000 WHEN 4 THEN 873900 WHEN 5 THEN 900001 WHEN 6 THEN 510000 WHEN 7 THEN 16 ELSE 399001 END + {k} % 1000) AS VARCHAR), 6, '0')"
EXCHANGE = "CASE {k} % 4 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' WHEN 2 THEN '.BJ' ELSE '.SZ' END || CASE WHEN {k} % 13 = 0 THEN ' ' ELSE '' END"
SYMBOL = CODE + " || " + EXCHANGE


def code(k: str):
    return F.expr(CODE.replace("VARCHAR", "STRING").format(k=k))


def symbol(k: str):
    return F.concat(code(k), F.expr(EXCHANGE.format(k=k)))


VALID = r"""(regexp_full_match(trim(s), '(60[0135]|68[89])[0-9]{3}\.SH|(00[0-3]|30[01])[0-9]{3}\.SZ|(430|83[0-9]|87[0-9]|920)[0-9]{3}\.BJ')
  AND NOT regexp_matches(trim(s), '^000(016|300|688|852|902|903|904|905|906|907|922)'))"""
CUST = f"k AS (SELECT c_custkey, {CODE.format(k='c_custkey')} AS code, {SYMBOL.format(k='c_custkey')} AS s FROM customer)"


@query("valid_symbol", f"WITH {CUST} SELECT c_custkey, s AS sym, {VALID} AS valid FROM k")
def valid_symbol(spark, sf_dir):
    own = fixtures.read(spark, sf_dir, "customer").select("c_custkey", symbol("c_custkey").alias("sym"))
    return own.withColumn("valid", cl.valid_symbol(F.col("sym")))


@query("map_symbol", f"WITH {CUST} SELECT c_custkey, code || CASE WHEN code[1] IN ('6', '9') THEN '.SH' WHEN code[1] IN ('4', '8') THEN '.BJ' ELSE '.SZ' END AS sym FROM k")
def map_symbol(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "customer").select("c_custkey", cl.map_symbol(code("c_custkey")).alias("sym"))


@query(
    "clean_listing_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 NOT IN (2, 8) THEN strftime(o_orderdate, '%Y-%m-%d') END AS list_date FROM orders",
)
def clean_listing_date(spark, sf_dir):
    """Order dates written in many ways: compact, with dashes, slashes and without leading zeros, with a time, with the month's name, and broken."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 9
    text = F.concat(F.date_format(d, "yyyy"), F.lit("1345"))
    for n, pattern in enumerate(["yyyyMMdd", "yyyy-MM-dd", None, "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy-M-d", "yyyy/M/d", "MMM d, yyyy"]):
        text = text if pattern is None else F.when(k == n, F.date_format(d, pattern)).otherwise(text)
    text = F.when(k == 8, " ").otherwise(text)
    return fixtures.read(spark, sf_dir, "orders").select("o_orderkey", cl.clean_date(text).alias("list_date"))


RAW = f"""{BARS}, raw AS (SELECT sym, dt, CASE WHEN sym % 13 = 3 AND month(dt) = 5 THEN -1 ELSE open END AS open, high, low, close, CASE WHEN month(dt) % 3 = 0 THEN pre_close END AS pre_close,
  CASE WHEN sym % 7 <> 0 THEN volume END AS volume, amount, turnover_rate, CASE WHEN month(dt) % 4 = 1 THEN 1 + sym / 100.0 END AS adj_factor, 1 AS seq FROM bars
  UNION ALL SELECT sym, dt, open, high, low, close * 2, NULL, volume, amount, turnover_rate, NULL, 2 FROM bars WHERE sym % 5 = 0 AND month(dt) = 3)"""


def raw_bars(spark, sf_dir):
    """Bars as text with planted faults: bad prices, missing fields and corrected duplicates."""
    b, m, s = fixtures.bars(spark, sf_dir), F.month("dt"), F.col("sym")
    text = lambda x: x.cast("string")
    one = b.select("sym", "dt", text(F.when((s % 13 == 3) & (m == 5), -1.0).otherwise(F.col("open"))).alias("open"), text(F.col("high")).alias("high"), text(F.col("low")).alias("low"), text(F.col("close")).alias("close"), text(F.when(m % 3 == 0, F.col("pre_close"))).alias("pre_close"), F.when(s % 7 != 0, text(F.col("volume"))).otherwise("n/a").alias("volume"), text(F.col("amount")).alias("amount"), text(F.col("turnover_rate")).alias("turnover_rate"), text(F.when(m % 4 == 1, 1 + s / 100)).alias("adj_factor"), F.lit(1).alias("seq"))
    two = b.where("sym % 5 = 0 and month(dt) = 3").select("sym", "dt", *(text(F.col(c)).alias(c) for c in ("open", "high", "low")), text(F.col("close") * 2).alias("close"), F.lit(None).cast("string").alias("pre_close"), *(text(F.col(c)).alias(c) for c in ("volume", "amount", "turnover_rate")), F.lit(None).cast("string").alias("adj_factor"), F.lit(2).alias("seq"))
    return one.unionByName(two)


@query(
    "normalize_bars",
    f"""WITH {RAW}, good AS (SELECT * FROM raw WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 QUALIFY row_number() OVER (PARTITION BY sym, dt ORDER BY seq DESC) = 1)
    SELECT sym, dt::VARCHAR AS dt, round(coalesce(last_value(pre_close IGNORE NULLS) OVER (PARTITION BY sym ORDER BY dt ROWS UNBOUNDED PRECEDING), open), 8) + 0.0 AS pre_close, coalesce(volume, 0) + 0.0 AS volume,
    round(coalesce(last_value(adj_factor IGNORE NULLS) OVER (PARTITION BY sym ORDER BY dt ROWS UNBOUNDED PRECEDING), first_value(adj_factor IGNORE NULLS) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS adj_factor
    FROM good""",
)
def normalize_bars(spark, sf_dir):
    own = cl.normalize_bars(raw_bars(spark, sf_dir))
    return own.select("sym", "dt", digits(F.col("pre_close"), 8).alias("pre_close"), (F.col("volume") + 0.0).alias("volume"), digits(F.col("adj_factor")).alias("adj_factor"))


@query("clean_stock_metadata", f"WITH {CUST}, m AS (SELECT *, c_custkey % 1000 AS r FROM k WHERE {VALID} QUALIFY row_number() OVER (PARTITION BY s ORDER BY c_custkey DESC) = 1) SELECT s AS sym, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS industry, CASE WHEN c_custkey % 5 <> 0 THEN (DATE '1990-01-01' + (c_custkey % 9000)::INT)::VARCHAR END AS list_date, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 ELSE contains(upper(CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END), 'ST') END AS is_st FROM m JOIN customer USING (c_custkey)")
def clean_stock_metadata(spark, sf_dir):
    k = F.col("c_custkey")
    raw = fixtures.read(spark, sf_dir, "customer").select(symbol("c_custkey").alias("sym"), F.when(k % 6 != 0, F.col("c_name")).alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("industry"), F.when(k % 5 != 0, F.date_format(F.expr("date_add(date'1990-01-01', cast(c_custkey % 9000 as int))"), "yyyy/M/d")).alias("list_date"), F.when(k % 3 == 0, k % 2 == 0).alias("is_st"), k.alias("seq"))
    return cl.clean_stock_metadata(raw)


@query("merge_stock_details", f"WITH {BARS} SELECT coalesce(a.sym, b.sym) AS sym, coalesce(b.name, a.name) AS name, b.list_date::VARCHAR AS list_date FROM (SELECT sym, name FROM stocks WHERE sym % 3 <> 0) a FULL JOIN (SELECT sym, 'D' || sym AS name, list_date FROM stocks WHERE sym % 4 <> 0) b ON a.sym = b.sym")
def merge_stock_details(spark, sf_dir):
    own = fixtures.stocks(spark, sf_dir)
    return cl.merge_stock_details(own.where("sym % 3 <> 0").select("sym", "name"), own.where("sym % 4 <> 0").select("sym", F.concat(F.lit("D"), "sym").alias("name"), "list_date"))


@query("clean_provider_bars", f"WITH {BARS} SELECT sym, dt::VARCHAR AS dt, round(close, 8) AS close, round(turnover_rate, 9) AS turnover_rate FROM bars WHERE sym % 2 = 0 UNION ALL SELECT sym, dt::VARCHAR, round(close, 8), NULL FROM bars WHERE sym % 2 = 1")
def clean_provider_bars(spark, sf_dir):
    """Two feeds with names of their own, one without turnover."""
    b = fixtures.bars(spark, sf_dir)
    one = b.where("sym % 2 = 0").select("sym", F.date_format("dt", "yyyyMMdd").alias("day"), F.col("close").alias("last"), (F.col("turnover_rate") * 100).alias("turn"))
    two = b.where("sym % 2 = 1").select("sym", F.col("dt").cast("string").alias("date"), F.col("close").alias("close_price"))
    both = cl.clean_provider_bars(one, {"day": "dt", "last": "close", "turn": "turnover_rate"}, ["turnover_rate"]).unionByName(cl.clean_provider_bars(two, {"date": "dt", "close_price": "close"}, []), allowMissingColumns=True)
    return both.select("sym", "dt", digits(F.col("close"), 8).alias("close"), digits(F.col("turnover_rate"), 9).alias("turnover_rate"))


@query("clean_earnings", f"WITH {REPORTS} SELECT sym, report_date::VARCHAR AS report_date, announce_date::VARCHAR AS announce_date, round(CASE WHEN NOT isnan(profit_cum) THEN profit_cum / revenue_cum * 100 END, 6) + 0.0 AS net_margin FROM reports")
def clean_earnings(spark, sf_dir):
    raw = fixtures.fundamentals(spark, sf_dir).select("sym", "report_date", F.when(~F.isnan("profit_cum"), F.col("profit_cum")).alias("profit"), F.col("revenue_cum").alias("revenue"))
    return cl.clean_earnings(raw).select("sym", "report_date", "announce_date", digits(F.col("net_margin")).alias("net_margin"))


@query("clean_indicator", f"WITH {REPORTS} SELECT sym, report_date::VARCHAR AS report_date, CASE WHEN sym % 4 <> 0 THEN round(bvps, 2) END AS roa, CASE WHEN sym % 4 = 0 THEN round(bvps, 2) END AS debt_ratio FROM reports")
def clean_indicator(spark, sf_dir):
    text = F.round("bvps", 2).cast("string")
    raw = fixtures.fundamentals(spark, sf_dir).select("sym", "report_date", F.when(F.col("sym") % 4 == 0, "--").otherwise(text).alias("roa"), F.when(F.col("sym") % 4 == 0, text).otherwise("NaN").alias("debt_ratio"))
    return cl.clean_indicator(raw.unionByName(raw.limit(1).withColumn("report_date", F.lit(None).cast("date"))))


@query("clean_dividend", f"WITH {REPORTS} SELECT sym, announce_date::VARCHAR AS ex_date, round(abs(bvps) / 1000, 9) + 0.0 AS dividend_yield FROM reports WHERE sym % 3 <> 0")
def clean_dividend(spark, sf_dir):
    raw = fixtures.fundamentals(spark, sf_dir).select("sym", F.when(F.col("sym") % 3 != 0, F.col("announce_date")).alias("ex_date"), (F.abs("bvps") / 10).cast("string").alias("dividend_yield"))
    return cl.clean_dividend(raw).withColumn("dividend_yield", digits(F.col("dividend_yield"), 9))


@query("clean_margin", f"WITH {BARS} SELECT sym, dt::VARCHAR AS dt, round(CASE WHEN sym % 2 = 0 THEN amount * 2 ELSE amount END, 2) AS rzye FROM bars WHERE NOT (sym % 2 = 1 AND month(dt) = 7)")
def clean_margin(spark, sf_dir):
    b = fixtures.bars(spark, sf_dir)
    one = b.select("sym", "dt", F.when((F.col("sym") % 2 == 1) & (F.month("dt") == 7), F.lit("-")).otherwise(F.col("amount").cast("string")).alias("rzye"), F.lit(1).alias("seq"))
    two = b.where("sym % 2 = 0").select("sym", "dt", (F.col("amount") * 2).alias("rzye"), F.lit(1).alias("seq"))
    return cl.clean_margin(one, two).select("sym", "dt", digits(F.col("rzye"), 2).alias("rzye"))


@query("clean_index_closes", f"WITH {BARS} SELECT industry AS index_code, dt::VARCHAR AS dt, round(max(close), 6) + 0.0 AS close FROM bars JOIN stocks USING (sym) WHERE month(dt) <> 7 GROUP BY ALL")
def clean_index_closes(spark, sf_dir):
    """Highest closes of an industry as an index history in text: old values come first, the Julys have no number."""
    own = fixtures.bars(spark, sf_dir).join(fixtures.stocks(spark, sf_dir), "sym").groupBy("industry", "dt").agg(F.max("close").alias("close"))
    raw = own.select(F.concat("industry", F.lit(".SI")).alias("index_code"), F.date_format("dt", "yyyyMMdd").alias("dt"), F.when(F.month("dt") == 7, "--").otherwise(F.col("close").cast("string")).alias("close"), F.lit(2).alias("seq"))
    return cl.clean_index_closes(raw.unionByName(raw.withColumns({"seq": F.lit(1), "close": F.when(F.col("close") != "--", "1.5").otherwise("--")}))).withColumn("close", digits(F.col("close")))


@query("clean_industry", f"WITH {BARS} SELECT DISTINCT industry AS index_code, sym FROM stocks")
def clean_industry(spark, sf_dir):
    own = fixtures.stocks(spark, sf_dir).select(F.concat("industry", F.lit(".SI")).alias("index_code"), "sym")
    return cl.clean_industry(own.unionByName(own.where("sym % 2 = 0")))


@query("attach_announce_date", f"WITH {REPORTS} SELECT sym, report_date::VARCHAR AS report_date, round(bvps, 4) + 0.0 AS bvps, announce_date::VARCHAR AS announce_date FROM reports WHERE sym % 3 = 0")
def attach_announce_date(spark, sf_dir):
    own = fixtures.fundamentals(spark, sf_dir)
    return cl.attach_announce_date(own.select("sym", "report_date", digits(F.col("bvps"), 4).alias("bvps")), own.where("sym % 3 = 0"))


@query("quarter_ends", f"WITH {BARS}, s AS (SELECT min(dt) AS a, max(dt) AS b FROM bars), q AS (SELECT last_day(m + INTERVAL 2 MONTH)::DATE AS q FROM s, unnest(generate_series(date_trunc('quarter', a), b::TIMESTAMP, INTERVAL 3 MONTH)) t(m)) SELECT q::VARCHAR AS quarter_end FROM q, s WHERE q BETWEEN a AND b")
def quarter_ends(spark, sf_dir):
    return cl.quarter_ends(fixtures.bars(spark, sf_dir).agg(F.min("dt").alias("first"), F.max("dt").alias("last")))


@query("limit_rate", f"WITH {CUST} SELECT s AS sym, CASE WHEN substr(s, 1, 3) IN ('300', '301', '688', '689') THEN 0.2 ELSE 0.1 END::DOUBLE AS rate FROM k")
def limit_rate(spark, sf_dir):
    own = fixtures.read(spark, sf_dir, "customer").select(symbol("c_custkey").alias("sym"))
    return own.withColumn("rate", returns.limit_rate(F.col("sym")).cast("double"))


@query("date_index", f"WITH {BARS}, d AS (SELECT DISTINCT o_orderdate::DATE + 400 AS d FROM orders) SELECT d::VARCHAR AS d, greatest(coalesce((SELECT min(sess) FROM axis WHERE dt >= d), (SELECT count(*) FROM axis)), 1)::INT AS idx FROM d")
def date_index(spark, sf_dir):
    dates = fixtures.read(spark, sf_dir, "orders").select(F.date_add(F.to_date("o_orderdate"), 400).alias("d")).distinct()
    return cl.date_index(axis(spark, sf_dir), dates)


#: Choices of symbols: some listed, all valid ones unlisted, none valid (all listed ones stand in), the first five.
PICKS = {"some": "c_custkey % 3 = 0", "unlisted": "c_custkey % 10 = 7", "invalid": "c_custkey % 9 = 5", "first five": "c_custkey % 2 = 0"}
GIVEN = " UNION ALL ".join(f"SELECT '{pick}' AS pick, s FROM k WHERE {how}" for pick, how in PICKS.items())


@query("universe_pick", f"""WITH {CUST}, given AS ({GIVEN}), listed AS (SELECT DISTINCT s FROM k WHERE c_custkey % 10 <> 7 AND s NOT IN (SELECT s FROM k WHERE c_custkey % 10 = 7)),
valid AS (SELECT DISTINCT pick, s FROM given WHERE {VALID}), picks AS (SELECT DISTINCT pick FROM given),
candidates AS (SELECT * FROM valid UNION ALL SELECT pick, s FROM picks, listed WHERE {VALID} AND pick NOT IN (SELECT pick FROM valid)),
numbered AS (SELECT pick, s AS sym, row_number() OVER (PARTITION BY pick ORDER BY s) AS r FROM candidates WHERE s IN (SELECT s FROM listed))
SELECT pick, sym FROM numbered WHERE pick <> 'first five' OR r <= 5""")  # fmt: skip
def universe_pick(spark, sf_dir):
    codes = fixtures.read(spark, sf_dir, "customer").select("c_custkey", symbol("c_custkey").alias("sym"))
    gone = codes.where("c_custkey % 10 = 7").select("sym")
    listed = codes.where("c_custkey % 10 <> 7").select("sym").join(gone, "sym", "left_anti").distinct()
    out = None
    for pick, how in PICKS.items():
        own = cl.universe_pick(codes.where(how), listed, 5 if pick == "first five" else None).select(F.lit(pick).alias("pick"), "sym")
        out = own if out is None else out.unionByName(own)
    return out


# -- sources and sinks


@query("scan_bars", f"WITH {BARS} SELECT sym, dt::VARCHAR AS dt, round(close, 8) AS close FROM bars WHERE sym IN (SELECT sym FROM stocks WHERE sym % 4 = 1) AND dt BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def scan_bars(spark, sf_dir):
    wanted = fixtures.stocks(spark, sf_dir).where("sym % 4 = 1")
    own = files.scan_for(fixtures.bars(spark, sf_dir), wanted, F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    return own.select("sym", "dt", digits(F.col("close"), 8).alias("close"))


@query("scan_fundamentals", f"WITH {REPORTS} SELECT sym, report_date::VARCHAR AS report_date, round(revenue_cum, 2) AS revenue FROM reports WHERE sym IN (SELECT sym FROM stocks WHERE sym % 4 = 1)")
def scan_fundamentals(spark, sf_dir):
    own = files.scan_for(fixtures.fundamentals(spark, sf_dir), fixtures.stocks(spark, sf_dir).where("sym % 4 = 1"))
    return own.select("sym", "report_date", digits(F.col("revenue_cum"), 2).alias("revenue"))


@query("scan_table_or_empty", f"WITH {BARS} SELECT sym, dt::VARCHAR AS dt, NULL::DOUBLE AS rzye FROM bars")
def scan_table_or_empty(spark, sf_dir):
    """A table that is not there leaves its column missing."""
    absent = files.scan_table_or_empty(spark, f"{sf_dir}/no_such_table.parquet", "sym long, dt date, rzye double")
    return fixtures.bars(spark, sf_dir).select("sym", "dt").join(absent, ["sym", "dt"], "left")


@query("source_parquet_cache", f"WITH {BARS} SELECT year(dt)::INT AS year, count(*) AS n, round(sum(CASE WHEN year(dt) = 1997 THEN 2 * amount ELSE amount END), 2) AS amount, 0 AS read_again, 1 AS read_changed FROM bars GROUP BY 1")
def source_parquet_cache(spark, sf_dir):
    """Files of bars by year behind a cache: a second look reads nothing, after a change of one year one file is read again."""
    source, cache = scratch(spark, "bars"), scratch(spark, "cache")
    own = fixtures.bars(spark, sf_dir).withColumn("year", F.year("dt")).select("sym", "year", "amount")
    write = lambda df: df.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(source)
    read = lambda paths: spark.read.schema("sym long, amount double, year int").option("basePath", source).parquet(*paths)
    look = lambda: files.refreshed(spark, f"{source}/*/*.parquet", cache, read)
    write(own)
    look()
    _, again = look()
    write(own.where("year = 1997").withColumn("amount", F.col("amount") * 2))
    bars, changed = look()
    return bars.groupBy("year").agg(F.count(F.lit(1)).alias("n"), digits(F.sum("amount"), 2).alias("amount")).withColumns({"read_again": F.lit(again), "read_changed": F.lit(changed)})


@query("sink_parquet_atomic", f"WITH {BARS} SELECT year(dt)::INT AS year, count(*) AS n, round(sum(CASE WHEN year(dt) = 1997 THEN 0 ELSE volume END), 1) + 0.0 AS volume, round(sum(volume), 1) + 0.0 AS volume_before FROM bars GROUP BY 1")
def sink_parquet_atomic(spark, sf_dir):
    """Rewriting one year leaves the others, and a reader that began before sees the version of then."""
    table, own = Table(spark, scratch(spark, "years"), "year"), fixtures.bars(spark, sf_dir).withColumn("year", F.year("dt"))
    table.replace(own)
    before = table.read()
    table.replace_parts(own.where("year = 1997").withColumn("volume", F.lit(0.0)))
    sums = lambda rows: rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), digits(F.sum("volume"), 1).alias("volume"))
    return sums(table.read()).join(sums(before).select("year", F.col("volume").alias("volume_before")), "year")


@query("sink_json_result", f"WITH {BARS} SELECT sym, dt::VARCHAR AS dt, CASE WHEN sym % 3 = 0 THEN NULL ELSE round(close, 8) END AS close FROM bars")
def sink_json_result(spark, sf_dir):
    path = scratch(spark, "json")
    own = fixtures.bars(spark, sf_dir).select("sym", "dt", F.when(F.col("sym") % 3 == 0, F.lit(float("nan"))).otherwise(digits(F.col("close"), 8)).alias("close"))
    files.write_json_result(own, path)
    return spark.read.schema("sym long, dt date, close double").json(path)


@query("source_json_records", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_json_records(spark, sf_dir):
    path = scratch(spark, "records")
    nation = fixtures.read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    nation.select("value").repartition(nation.count()).write.text(path)  # an array of a few records per file
    return files.json_records(spark, path, "n_nationkey int, n_name string, n_regionkey int").drop("file")


@query("upsert_last_wins", f"WITH {BARS} SELECT sym, dt::VARCHAR AS dt, round(CASE WHEN sym % 2 = 0 THEN close * 3 ELSE close END, 8) AS close FROM bars WHERE NOT (sym % 2 = 1 AND year(dt) = 1999)")
def upsert_last_wins(spark, sf_dir):
    own = fixtures.bars(spark, sf_dir).select("sym", "dt", "close")
    even = own.where("sym % 2 = 0")
    new = even.withColumn("close", F.col("close") * 2).withColumn("seq", F.lit(1)).unionByName(even.withColumn("close", F.col("close") * 3).withColumn("seq", F.lit(2)))
    table = Table(spark, scratch(spark, "last-wins"))
    table.replace(own.where("year(dt) <> 1999"))
    table.update(new, lambda old, rows: upserts.last_wins(old, rows, ["sym", "dt"], "seq").select("sym", "dt", "close"))
    return table.read().withColumn("close", digits(F.col("close"), 8))


@query("upsert_coalesce", f"WITH {BARS} SELECT sym, dt::VARCHAR AS dt, round(CASE WHEN sym % 3 = 0 THEN close * 2 ELSE close END, 8) AS close, volume + 0.0 AS volume FROM bars")
def upsert_coalesce(spark, sf_dir):
    own = fixtures.bars(spark, sf_dir).select("sym", "dt", "close", "volume")
    old = own.withColumn("volume", F.lit(None).cast("double"))
    new = own.withColumn("close", F.when(F.col("sym") % 3 == 0, F.col("close") * 2))
    table = Table(spark, scratch(spark, "coalesced"))
    table.replace(old)
    table.update(new, lambda old, rows: upserts.coalescing(old, rows, ["sym", "dt"]))
    return table.read().select("sym", "dt", digits(F.col("close"), 8).alias("close"), (F.col("volume") + 0.0).alias("volume"))


@query("replace_snapshot", f"WITH {BARS} SELECT sym, name, list_date::VARCHAR AS list_date FROM stocks WHERE sym % 5 <> 0")
def replace_snapshot(spark, sf_dir):
    own = fixtures.stocks(spark, sf_dir).select("sym", "name", F.col("list_date").cast("string").alias("list_date"))
    new = own.where("sym % 5 <> 0").withColumn("list_date", F.when(F.col("sym") % 2 == 0, " ").otherwise(F.col("list_date")))
    table = Table(spark, scratch(spark, "snapshot"))
    table.replace(own)
    table.update(new, upserts.replace_snapshot)
    return table.read().select("sym", "name", "list_date")


@query("replace_group", f"WITH {BARS}, g AS (SELECT min(industry) AS g FROM stocks) SELECT sym, industry FROM stocks WHERE industry <> (SELECT g FROM g) UNION ALL SELECT sym + 100000, industry FROM stocks WHERE industry = (SELECT g FROM g)")
def replace_group(spark, sf_dir):
    own = fixtures.stocks(spark, sf_dir).select("sym", "industry")
    least = own.agg(F.min("industry").alias("industry"))
    table = Table(spark, scratch(spark, "groups"), "industry")
    table.replace(own)
    table.replace_parts(own.join(F.broadcast(least), "industry").select(F.col("sym") + 100_000, "industry").toDF("sym", "industry"))
    return table.read()


@query("upsert_intervals_validated", f"WITH {BARS} SELECT index_code, sym, in_date::VARCHAR AS in_date, out_date::VARCHAR AS out_date FROM constituents")
def upsert_intervals_validated(spark, sf_dir):
    own = fixtures.constituents(spark, sf_dir)
    table = Table(spark, scratch(spark, "intervals"))
    table.replace(own.where("sym % 2 = 0"))
    table.update(own.where("sym % 3 = 0 or sym % 2 = 1"), upserts.intervals_validated)
    return table.read()


@query("purge_not_in", f"""WITH {BARS}, k AS (SELECT 'universe' AS kept, sym FROM constituents WHERE sym % 3 = 0 UNION SELECT 'universe', sym FROM stocks WHERE sym % 5 = 1 UNION SELECT 'nothing given', sym FROM stocks),
own AS (SELECT kept, bars.sym, count(*) AS n FROM bars JOIN (SELECT DISTINCT * FROM k) k ON k.sym = bars.sym GROUP BY 1, 2)
SELECT kept, sym, n, (SELECT count(*) FROM bars) AS n_before, sum(n) OVER (PARTITION BY kept)::BIGINT AS n_after FROM own""")  # fmt: skip
def purge_not_in(spark, sf_dir):
    """Bars outside a universe go, but for symbols that could not be fetched; an empty universe deletes nothing."""
    bars, universe = fixtures.bars(spark, sf_dir), fixtures.constituents(spark, sf_dir).where("sym % 3 = 0").select("sym")
    failed = fixtures.stocks(spark, sf_dir).where("sym % 5 = 1").select("sym")
    out = None
    for kept, keep in (("universe", universe), ("nothing given", universe.limit(0))):
        table = Table(spark, scratch(spark, "purged"))
        table.replace(bars.select("sym", "dt", "close"))
        before, after = upserts.purge_table(table, keep, failed)
        own = table.read().groupBy("sym").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kept).alias("kept"), "sym", "n", F.lit(before).cast("long").alias("n_before"), F.lit(after).cast("long").alias("n_after"))
        out = own if out is None else out.unionByName(own)
    return out


@query("data_status", f"WITH {BARS} SELECT count(*) AS n_rows, min(dt)::VARCHAR AS first, max(dt)::VARCHAR AS last, count(DISTINCT sym) AS n_symbols FROM bars")
def data_status(spark, sf_dir):
    return upserts.data_status(fixtures.bars(spark, sf_dir))


# -- trade log

TR = """tr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS sym, l_shipdate::DATE AS dt, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS amount,
  CASE WHEN l_linenumber <> 7 THEN greatest(l_extendedprice * 0.00025, 5.0) END AS commission, CASE WHEN l_linenumber <> 7 THEN CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.0005 ELSE 0 END END AS stamp_tax,
  CASE WHEN l_linenumber <> 7 THEN l_extendedprice * 0.00001 END AS transfer_fee, CASE WHEN l_linenumber <> 7 THEN l_extendedprice * 0.0005 END AS slippage FROM lineitem)"""
FEE = "coalesce(commission, 0) + coalesce(stamp_tax, 0) + coalesce(transfer_fee, 0) + coalesce(slippage, 0)"


@query("fee_summary", f"WITH {TR} SELECT count(DISTINCT dt) AS days, count(*) AS trades, round(sum(CASE WHEN side = 'buy' THEN amount ELSE 0 END), 1) AS buys, round(sum(CASE WHEN side = 'sell' THEN amount ELSE 0 END), 1) AS sells, round(sum(amount), 1) AS amount, {', '.join(f'round(sum(coalesce({f}, 0)), 2) AS {f}' for f in trades.FEES)} FROM tr")
def fee_summary(spark, sf_dir):
    own = trades.fee_summary(fixtures.trades(spark, sf_dir))
    return own.withColumns({c: digits(F.col(c), 1) for c in ("buys", "sells", "amount")} | {c: digits(F.col(c), 2) for c in trades.FEES})


@query("fees_by_year", f"WITH {TR} SELECT year(dt)::INT AS year, round(sum({FEE}), 2) + 0.0 AS fees FROM tr GROUP BY 1")
def fees_by_year(spark, sf_dir):
    return trades.fees_by_year(fixtures.trades(spark, sf_dir)).withColumn("fees", digits(F.col("fees"), 2))


@query("cash_reconcile", f"WITH {TR}, s AS (SELECT sum(CASE side WHEN 'buy' THEN -amount ELSE amount END) AS d, sum({FEE}) AS f FROM tr), c AS (SELECT sum(c_acctbal) AS cash FROM customer) SELECT round(1e9 + d - f, 1) + 0.0 AS expected, round(f / 1e9 * 100, 6) + 0.0 AS drag, round(cash, 1) + 0.0 AS cash, abs(cash - (1e9 + d - f)) > 0.01 AS broken FROM s, c")
def cash_reconcile(spark, sf_dir):
    cash = fixtures.read(spark, sf_dir, "customer").agg(F.sum("c_acctbal").cast("double").alias("cash"))
    own = trades.cash_reconcile(fixtures.trades(spark, sf_dir), 1e9, cash)
    return own.select(digits(F.col("expected"), 1).alias("expected"), digits(F.col("drag")).alias("drag"), digits(F.col("cash"), 1).alias("cash"), "broken")


LASTBAR = "lb AS (SELECT sym, arg_max(close, dt) AS price FROM bars GROUP BY 1)"


@query(
    "rebalance_orders",
    f"""WITH {BARS}, {LASTBAR}, t AS (SELECT sym, 1.0 / (SELECT count(*) FROM stocks WHERE sym % 2 = 0) AS weight, price FROM lb WHERE sym % 2 = 0),
    h AS (SELECT sym, (sym % 7) * 130 AS quantity FROM stocks WHERE sym % 3 = 0), b AS (SELECT coalesce(t.sym, h.sym) AS sym, coalesce(floor(1e8 * weight / price / 100) * 100, 0)::BIGINT - coalesce(quantity, 0)::BIGINT AS c FROM t FULL JOIN h ON t.sym = h.sym),
    o AS (SELECT sym, CASE WHEN c > 0 THEN (c // 100) * 100 ELSE c END AS c FROM b) SELECT sym, CASE WHEN c < 0 THEN 'sell' ELSE 'buy' END AS side, abs(c) AS quantity, CASE WHEN c < 0 THEN 0 ELSE 1 END AS step FROM o WHERE c <> 0""",
)
def rebalance_orders(spark, sf_dir):
    last = fixtures.bars(spark, sf_dir).groupBy("sym").agg(F.max_by("close", "dt").alias("price")).where("sym % 2 = 0")
    n = last.agg(F.count(F.lit(1)).alias("n"))
    targets = last.crossJoin(F.broadcast(n)).select("sym", (1.0 / F.col("n")).alias("weight"), "price")
    held = fixtures.stocks(spark, sf_dir).where("sym % 3 = 0").select("sym", ((F.col("sym") % 7) * 130).alias("quantity"))
    return trades.rebalance_orders(targets, held, 1e8)


@query("affordable_lots", f"WITH {BARS}, x AS (SELECT sym, dt, close AS price, amount / 10 AS cash, volume * 10 AS want FROM bars) SELECT sym, dt::VARCHAR AS dt, (greatest(0, least(floor((cash + 1e-9) / (price * 100 * (1 + 0.00051 + 0.00025))), floor((cash + 1e-9 - 5) / (price * 100 * 1.00051)), floor(want / 100))) * 100)::BIGINT AS quantity FROM x")
def affordable_lots(spark, sf_dir):
    return fixtures.bars(spark, sf_dir).select("sym", "dt", trades.affordable_lots(F.col("amount") / 10, F.col("close"), F.col("volume") * 10).alias("quantity"))


@query("order_block_reason", f"WITH {TRADE}, o AS (SELECT sym, dt, CASE WHEN (sym + month(dt)) % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM panel) SELECT o.sym, o.dt::VARCHAR AS dt, side, CASE WHEN t.close IS NULL THEN 'missing_bar' WHEN susp THEN 'suspended' WHEN side = 'buy' AND up1 THEN 'limit_up' WHEN side = 'sell' AND down1 THEN 'limit_down' END AS reason FROM o LEFT JOIN trade t ON t.sym = o.sym AND t.dt = o.dt")
def order_block_reason(spark, sf_dir):
    own = panel.standard(spark, sf_dir)
    orders = own.select("sym", "dt", F.when((F.col("sym") + F.month("dt")) % 2 == 0, "buy").otherwise("sell").alias("side"))
    return trades.order_block_reason(orders, own, returns.suspended(), returns.one_word("buy", F.col("rate")), returns.one_word("sell", F.col("rate")))


@query("fee_enrich", f"WITH {TR} SELECT l_orderkey AS order_id, l_linenumber AS line, sym, round(greatest(amount * 0.00025, 5) + amount * 0.00051 + CASE side WHEN 'sell' THEN amount * 0.0005 ELSE 0 END, 8) + 0.0 AS fee FROM tr")
def fee_enrich(spark, sf_dir):
    from panelforge.operators.portfolio import trade_cost

    own = fixtures.trades(spark, sf_dir)
    return own.select("order_id", "line", "sym", digits(trade_cost(F.col("side"), F.col("amount"))["total"], 8).alias("fee"))


@query("holdings_value", f"WITH {BARS}, {LASTBAR} SELECT sym, round((sym % 7) * 130 * coalesce(price, 0), 2) + 0.0 AS value FROM stocks LEFT JOIN lb USING (sym)")
def holdings_value(spark, sf_dir):
    held = fixtures.stocks(spark, sf_dir).select("sym", ((F.col("sym") % 7) * 130).alias("quantity"))
    prices = fixtures.bars(spark, sf_dir).select("sym", "dt", F.col("close").alias("price"))
    return trades.holdings_value(held, prices).withColumn("value", digits(F.col("value"), 2))


@query(
    "avg_cost",
    f"""WITH RECURSIVE {TR}, n AS (SELECT sym, side, quantity, price, row_number() OVER (PARTITION BY sym ORDER BY dt, l_orderkey, l_linenumber, l_partkey, amount) AS k FROM tr),
    s AS (SELECT sym, 0::BIGINT AS k, 0.0::DOUBLE AS q, 0.0::DOUBLE AS c FROM (SELECT DISTINCT sym FROM n)
      UNION ALL SELECT s.sym, n.k, CASE n.side WHEN 'buy' THEN q + quantity ELSE greatest(q - quantity, 0) END,
        CASE n.side WHEN 'buy' THEN (q * c + quantity * price) / (q + quantity) ELSE CASE WHEN q - quantity > 0 THEN c ELSE 0 END END FROM s JOIN n ON n.sym = s.sym AND n.k = s.k + 1)
    SELECT sym, round(arg_max(q, k), 4) + 0.0 AS quantity, round(arg_max(c, k), 4) + 0.0 AS avg_cost FROM s GROUP BY 1""",
)
def avg_cost(spark, sf_dir):
    own = fixtures.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sym"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.struct(F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"))
    done = trades.avg_cost(own)
    return done.select("sym", digits(F.col("quantity"), 4).alias("quantity"), digits(F.col("avg_cost"), 4).alias("avg_cost"))


@query("sellable_qty", f"WITH {TR}, d AS (SELECT sym, dt, sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) AS d FROM tr GROUP BY 1, 2) SELECT sym, dt::VARCHAR AS dt, greatest(coalesce(sum(d) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) + 0.0 AS sellable FROM d")
def sellable_qty(spark, sf_dir):
    return trades.sellable_qty(fixtures.trades(spark, sf_dir)).withColumn("sellable", F.col("sellable") + 0.0)
