"""DuckDB text of the derived inputs: the independent formulation that results are checked against."""

from __future__ import annotations

MONTHLY_INPUT = """
li AS (SELECT l_suppkey AS sym, date_trunc('month', l_shipdate)::DATE AS dt, l_extendedprice / l_quantity AS price, * FROM lineitem),
sup AS (SELECT s_suppkey AS sym, s_name, n_name AS industry, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
"""
DAILY_INPUT = """
li AS (SELECT l_suppkey // 4 AS sym, l_shipdate::DATE AS dt, l_extendedprice / l_quantity AS price, * FROM lineitem),
sup AS (SELECT s_suppkey // 4 AS sym, s_name, r_name AS industry, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 4 = 0),
"""
LISTED = "(SELECT sym, min(dt) AS list_date FROM bars GROUP BY sym)"
LISTED_DAILY = "(SELECT sym, min(dt) + (sym * 37 % 199 - 99)::INT AS list_date FROM bars GROUP BY sym)"
BARS = (
    MONTHLY_INPUT
    + """
bars0 AS (
  SELECT sym, dt,
    first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
    sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM li GROUP BY 1, 2),
bars AS (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY dt) AS pre_close, volume / sum(volume) OVER (PARTITION BY sym) AS turnover_rate FROM bars0),
calendar AS (SELECT DISTINCT dt, true AS is_open FROM bars),
axis AS (SELECT dt, (row_number() OVER (ORDER BY dt) - 1)::INT AS sess FROM calendar),
stocks AS (
  SELECT sym, s_name AS name, industry, f.list_date, sym % 17 = 0 AS is_st, r_name, CASE WHEN sym % 3 = 1 THEN 0.2 ELSE 0.1 END::DOUBLE AS rate
  FROM sup JOIN """
    + LISTED
    + """ f USING (sym)),
constituents AS (
  SELECT * FROM (
    SELECT r_name AS index_code, st.sym, (st.list_date + INTERVAL (st.sym % 6) MONTH)::DATE AS in_date,
      CASE WHEN st.sym % 5 = 0 THEN DATE '1999-01-01' ELSE DATE '9999-12-31' END AS out_date
    FROM stocks st
  ) WHERE in_date < out_date
  UNION ALL
  SELECT r_name, sym, DATE '2000-01-01', DATE '9999-12-31' FROM stocks WHERE sym % 10 = 0)
"""
)

#: The standard panel, with the helper columns that factors use.
PANEL = (
    BARS
    + """,
cells AS (SELECT st.sym, a.dt, a.sess, b.* EXCLUDE (sym, dt), st.industry, st.list_date, st.rate FROM stocks st CROSS JOIN axis a LEFT JOIN bars b ON b.sym = st.sym AND b.dt = a.dt),
aged AS (SELECT c.*, c.sess - l.first_sess + 1 AS age FROM cells c LEFT JOIN (SELECT sym, min(sess) AS first_sess FROM stocks JOIN axis ON dt >= list_date GROUP BY sym) l USING (sym)),
why AS (
  SELECT c.*, (
    (CASE WHEN EXISTS (SELECT 1 FROM constituents i WHERE i.sym = c.sym AND c.dt >= i.in_date AND c.dt < i.out_date) THEN 0 ELSE 1 END)
    | (CASE WHEN c.dt < c.list_date THEN 2 ELSE 0 END) | (CASE WHEN NOT c.dt < c.list_date AND coalesce(c.age, 0) < 3 THEN 4 ELSE 0 END)
    | 8 | (CASE WHEN c.close IS NULL THEN 16 ELSE 0 END))::INT AS reasons
  FROM aged c),
panel AS (SELECT *, (reasons & 23) = 0 AS elig FROM why)
"""
)

HELPERS = (
    PANEL
    + """,
h1 AS (SELECT *,
  close / lag(close, 1) OVER ts - 1 AS r, close / lag(close, 5) OVER ts - 1 AS r5, close / lag(close, 20) OVER ts - 1 AS r20,
  CASE WHEN volume IS NOT NULL THEN ln(1 + greatest(volume, 0)) END AS lv, close / pre_close - 1 AS move,
  abs(close - high) <= 1e-8 + 1e-5 * abs(high) AND abs(close - low) <= 1e-8 + 1e-5 * abs(low) AS sealed
  FROM panel WINDOW ts AS (PARTITION BY sym ORDER BY sess)),
h2 AS (SELECT *, coalesce((sealed AND move >= rate - 0.005)::INT, 0)::DOUBLE AS up, coalesce((sealed AND move <= -rate + 0.005)::INT, 0)::DOUBLE AS down,
  coalesce((high >= pre_close * (1 + rate) - 1e-9 AND NOT move >= rate - 0.005)::INT, 0)::DOUBLE AS broke, abs(r) / amount AS illiq,
  stddev_samp(r) OVER (PARTITION BY sym ORDER BY sess ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v20,
  coalesce(avg(CASE WHEN elig THEN r END) OVER (PARTITION BY dt), 0) AS mkt FROM h1),
h AS (SELECT *, sum(1 - up) OVER (PARTITION BY sym ORDER BY sess ROWS UNBOUNDED PRECEDING) AS island FROM h2)
"""
)


def by_day(text: str) -> str:
    """The same over the daily inputs."""
    return text.replace(MONTHLY_INPUT, DAILY_INPUT).replace(LISTED, LISTED_DAILY)


def w(n: int) -> str:
    return f"OVER (PARTITION BY sym ORDER BY sess ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def back(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY sym ORDER BY sess)"


def fixed(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


def industry(x: str) -> str:
    return f"CASE WHEN industry IS NOT NULL THEN {x} - avg(CASE WHEN elig THEN {x} END) OVER (PARTITION BY dt, industry) END"


def _capm(value: str) -> str:
    sums = {"n": "count(r)", "sr": "coalesce(sum(r) {w}, 0)", "sm": "sum(mkt) {w}", "srr": "coalesce(sum(r * r) {w}, 0)", "smm": "sum(mkt * mkt) {w}", "srm": "coalesce(sum(r * mkt) {w}, 0)"}
    inner = ", ".join(f"{(v if '{w}' in v else v + ' {w}').format(w=w(60))} AS {k}" for k, v in sums.items())
    return f"""SELECT sym, dt, CASE WHEN n >= 20 AND var_m > 1e-12 AND var_r > 1e-12 THEN {value} END AS v FROM (
      SELECT *, srm - sr * sm / n AS cov, smm - sm * sm / n AS var_m, srr - sr * sr / n AS var_r FROM (SELECT sym, dt, {inner} FROM h) WHERE n > 0)
      UNION ALL SELECT sym, dt, NULL FROM (SELECT sym, dt, count(r) {w(60)} AS n FROM h) WHERE n = 0"""


FACTORS: dict[str, str] = {
    **{f"RET_{n}": f"close / {back('close', n)} - 1" for n in (1, 5, 10, 120)},
    **{f"VOL_{n}": f"stddev_samp(r) {w(n)}" for n in (20, 60)},
    "TURNOVER": "turnover_rate",
    "TURNOVER_CHG": f"turnover_rate / {back('turnover_rate', 1)} - 1",
    **{f"TURNOVER_MA{n}": f"CASE WHEN turnover_rate IS NOT NULL THEN avg(turnover_rate) {w(n)} END" for n in (5, 20)},
    "TURNOVER_STD20": f"CASE WHEN turnover_rate IS NOT NULL THEN stddev_samp(turnover_rate) {w(20)} END",
    "VOLUME_RATIO": f"volume / (avg(volume) {w(20)} + 1e-9) - 1",
    "VOLUME_IMPACT": f"lv - avg(lv) {w(20)}",
    "AMPLITUDE": f"(high - low) / ({back('close', 1)} + 1e-9)",
    "CLOSE_POSITION": "(close - low) / (high - low + 1e-9)",
    **{f"MOMENTUM_{n}": f"close / {back('close', n)} - 1" for n in (20, 60)},
    **{f"REVERSAL_{n}": f"-(close / {back('close', n)} - 1)" for n in (5, 60, 120)},
    "SKEW_20": f"CASE WHEN count(r) {w(20)} >= 3 THEN skewness(r) {w(20)} END",
    "KURT_20": f"CASE WHEN count(r) {w(20)} >= 4 THEN kurtosis(r) {w(20)} END",
    "LIMIT_UP_EVENT": "up",
    "LIMIT_DOWN_EVENT": "down",
    "LIMIT_STREAK": "sum(up) OVER (PARTITION BY sym, island ORDER BY sess ROWS UNBOUNDED PRECEDING)",
    "LIMIT_UP_CNT_20": f"sum(up) {w(20)}",
    "LIMIT_BREAK": "broke",
    "OVERNIGHT_RET": "open / pre_close - 1",
    "INTRADAY_RET": "close / open - 1",
    "ILLIQ_20": f"avg(illiq) {w(20)}",
    "AMOUNT_SHARE": "amount / sum(CASE WHEN elig THEN amount END) OVER (PARTITION BY dt)",
    "MAX_20": f"max(r) {w(20)}",
    "HIGH_52W": f"close / max(close) {w(250)} - 1",
    "BETA_60": _capm("cov / var_m"),
    "IVOL_60": _capm("sqrt(greatest(var_r - cov / var_m * cov, 0))"),
    "RSQ_60": _capm("cov * cov / (var_r * var_m)"),
    "BIAS_20": f"close / avg(close) {w(20)} - 1",
    "SUSPEND_DAYS_60": f"sum((close IS NULL)::INT)::DOUBLE {w(60)}".replace("::DOUBLE OVER", " OVER"),
    "LIST_AGE": "count(close) OVER (PARTITION BY sym ORDER BY sess ROWS UNBOUNDED PRECEDING)",
    "MARKET_CAP": "amount / turnover_rate",
    "IND_REL_RET_5": industry("r5"),
    "IND_REL_RET_20": industry("r20"),
    "IND_REL_VOL_20": industry("v20"),
    "IND_REL_TURNOVER": industry("turnover_rate"),
    "NORTHBOUND_CHG": "0.0",
}
#: Digits after the point, where not 6.
PLACES = {"MARKET_CAP": 0, "ILLIQ_20": 12, "LIMIT_STREAK": 0}


#: Recursive means in the sessions' order, an independent form of the exponential ones.
EWM = f"""WITH RECURSIVE {HELPERS}, src AS MATERIALIZED (SELECT sym, dt, sess, close, high, low, pre_close, close - lag(close) OVER s AS d, last_value(close IGNORE NULLS) OVER s AS filled,
  CASE WHEN high IS NULL OR low IS NULL OR pre_close IS NULL THEN 0 ELSE greatest(high - low, abs(high - pre_close), abs(low - pre_close)) END AS reach FROM panel WINDOW s AS (PARTITION BY sym ORDER BY sess)),
run AS (SELECT sym, sess, coalesce(greatest(d, 0), 0.0) AS up, coalesce(greatest(-d, 0), 0.0) AS down, reach AS atr, filled AS fast, filled AS slow, 0.0::DOUBLE AS dea, filled IS NOT NULL AS begun FROM src WHERE sess = 0
  UNION ALL
  SELECT n.sym, n.sess, n.up, n.down, n.atr, n.fast, n.slow, CASE WHEN r_begun THEN old_dea * (1 - 2 / 10.0) + (n.fast - n.slow) * (2 / 10.0) ELSE n.fast - n.slow END, n.fast IS NOT NULL FROM (
    SELECT s.sym, s.sess, r.begun AS r_begun, r.dea AS old_dea, r.up * 13 / 14.0 + coalesce(greatest(s.d, 0), 0) / 14.0 AS up, r.down * 13 / 14.0 + coalesce(greatest(-s.d, 0), 0) / 14.0 AS down,
      r.atr * 13 / 14.0 + s.reach / 14.0 AS atr, CASE WHEN r.begun THEN r.fast * (11 / 13.0) + s.filled * (2 / 13.0) ELSE s.filled END AS fast, CASE WHEN r.begun THEN r.slow * (25 / 27.0) + s.filled * (2 / 27.0) ELSE s.filled END AS slow
    FROM run r JOIN src s ON s.sym = r.sym AND s.sess = r.sess + 1) n),
ew AS (SELECT sym, dt, CASE WHEN sess >= 13 AND up + down > 0 THEN 100 * up / (up + down) END AS RSI_14, atr AS ATR_14, fast - slow AS MACD_DIF, CASE WHEN fast IS NOT NULL THEN dea END AS MACD_DEA FROM run JOIN src USING (sym, sess))"""
EWM_NAMES = ("RSI_14", "ATR_14", "MACD_DIF", "MACD_DEA")


def factor_sql(name: str) -> str:
    if name in EWM_NAMES:
        return f"{EWM} SELECT sym, dt::VARCHAR AS dt, {fixed(name)} AS value FROM ew"
    x, places = FACTORS[name], PLACES.get(name, 6)
    if x.lstrip().startswith("SELECT"):
        return f"WITH {HELPERS} SELECT sym, dt::VARCHAR AS dt, {fixed('v', places)} AS value FROM ({x})"
    return f"WITH {HELPERS} SELECT sym, dt::VARCHAR AS dt, {fixed(f'CAST({x} AS DOUBLE)', places)} AS value FROM h"
