"""One query per formula operator, and composed formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import factors as lib
from panelforge.functions import formula
from panelforge.functions.numeric import digits
from panelforge.operators import panel
from panelforge.plans.base_sql import HELPERS, w
from panelforge.plans.registry import query

FORMULAS = {"plain": ["x"], "spread": ["x", "MA5", "x", "MA20", "SUB"], "ranked": ["x", "CS_RANK", "y", "TS_RANK10", "MUL"], "flat": ["x", "x", "SUB"], "broken": ["x", "ADD"]}
#: As at import: what callers register later changes no query.
FEATURES, OPERATORS = list(lib.REGISTRY), dict(formula.OPERATORS)


def inputs(spark, sf_dir, since=0):
    """From session ``since`` on; returns read one session before it."""
    own = lib.prepared(panel.standard(spark, sf_dir).where(F.col("sess") >= since - 1), []).where(F.col("sess") >= since)
    zero = F.lit(0.0)
    return own.select("sym", "dt", "sess", "elig", "industry", F.coalesce("r", zero).alias("x"), F.coalesce(F.try_divide("close", "pre_close") - 1, zero).alias("y"), F.coalesce("lv", zero).alias("z"))


F_SQL = f"WITH {HELPERS}, f AS (SELECT sym, dt, sess, elig, industry, coalesce(r, 0) AS x, coalesce(move, 0) AS y, coalesce(lv, 0) AS z FROM h)"
TS = "OVER (PARTITION BY sym ORDER BY sess)"
NONE = "count(CASE WHEN elig THEN x END) OVER (PARTITION BY dt) = 0"


def delayed(n: int, x: str = "x") -> str:
    return f"coalesce(lag({x}, {n}) {TS}, first({x}) {TS})"


def cs(value: str) -> str:
    return f"CASE WHEN {NONE} THEN 0 WHEN elig THEN {value} END"


def corr(n: int) -> str:
    m = lambda e: f"(sum({e}) {w(n)} / count(*) {w(n)})"
    vx, vy = (f"greatest({m(f'{v}*{v}')} - {m(v)} * {m(v)}, 0)" for v in "xy")
    return f"CASE WHEN sqrt({vx} * {vy}) > 1e-9 THEN ({m('x*y')} - {m('x')} * {m('y')}) / sqrt({vx} * {vy}) ELSE 0 END"


AVG = "avg(CASE WHEN elig THEN x END) OVER (PARTITION BY dt)"
AVG_IND = "avg(CASE WHEN elig THEN x END) OVER (PARTITION BY dt, industry)"
SQL = {
    "ADD": "x + y", "SUB": "x - y", "MUL": "x * y", "DIV": "x / CASE WHEN y = 0 THEN 1e-6 ELSE y + 1e-6 * sign(y) END", "NEG": "-x", "ABS": "abs(x)", "SIGN": "sign(x)", "GATE": "CASE WHEN x > 0 THEN y ELSE z END",
    "JUMP": "greatest((x - avg(x) OVER (PARTITION BY sym)) / (coalesce(stddev_samp(x) OVER (PARTITION BY sym), 0) + 1e-6) - 3, 0)",
    "JUMP_EXPANDING": "greatest((x - avg(x) OVER p) / (coalesce(stddev_samp(x) OVER p, 0) + 1e-6) - 3, 0)".replace("OVER p", "OVER (PARTITION BY sym ORDER BY sess ROWS UNBOUNDED PRECEDING)"),
    "DECAY": f"x + 0.8 * {delayed(1)} + 0.6 * {delayed(2)}", "DELAY1": delayed(1), "MAX3": f"max(x) {w(3)}",
    **{f"DELTA{n}": f"x - {delayed(n)}" for n in (5, 10, 20)},
    **{f"MA{n}": f"avg(x) {w(n)}" for n in (5, 10, 20, 60)},
    **{f"STD{n}": f"stddev_pop(x) {w(n)}" for n in (5, 10, 20, 60)},
    **{f"TS_RANK{n}": f"len(list_filter(list(x) {w(n)}, lambda v: v <= x)) / len(list(x) {w(n)})" for n in (5, 10, 20, 60)},
    **{f"CORR{n}": corr(n) for n in (5, 10, 20, 60)},
    **{f"DOWNVOL{n}": f"sqrt(avg(pow(least(x, 0), 2)) {w(n)})" for n in (5, 10, 20, 60)},
    "CS_ZSCORE": cs(f"(x - {AVG}) / (stddev_pop(CASE WHEN elig THEN x END) OVER (PARTITION BY dt) + 1e-6)"),
    "CS_DEMEAN": cs(f"x - {AVG}"),
    "CS_RANK": cs("(rank() OVER (PARTITION BY dt, elig ORDER BY x) - 1 + (count(*) OVER (PARTITION BY dt, elig, x) - 1) / 2.0) / count(*) OVER (PARTITION BY dt, elig)"),
    "CS_NEUTRALIZE": cs(f"CASE WHEN industry IS NULL OR {AVG_IND} IS NULL THEN x ELSE x - {AVG_IND} END"),
}


def _enter(name: str) -> None:
    @query(f"op_{name}", f"{F_SQL} SELECT sym, dt::VARCHAR AS dt, round(CAST({SQL[name]} AS DOUBLE), 6) + 0.0 AS value FROM f")
    def run(spark, sf_dir):
        op = formula.OPERATORS[name]
        return inputs(spark, sf_dir).select("sym", "dt", digits(op.build(*"xyz"[: op.arity]).cast("double")).alias("value"))


for _name in formula.OPERATORS:
    _enter(_name)

SIGNALS = f"""{F_SQL}, s AS (
  SELECT *, avg(x) {w(5)} - avg(x) {w(20)} AS spread, coalesce({SQL['CS_RANK']}, 0) AS rk,
    len(list_filter(list(y) {w(10)}, lambda v: v <= y)) / len(list(y) {w(10)}) AS tr FROM f),
u AS (SELECT 'plain' AS formula_id, sym, dt, elig, x AS v FROM s UNION ALL SELECT 'spread', sym, dt, elig, spread FROM s UNION ALL SELECT 'ranked', sym, dt, elig, rk * tr FROM s UNION ALL SELECT 'flat', sym, dt, elig, x - x FROM s),
signals AS (SELECT formula_id, sym, dt, elig, CASE WHEN count(CASE WHEN elig THEN v END) OVER q = 0 THEN 0 WHEN elig THEN (v - avg(CASE WHEN elig THEN v END) OVER q) / (stddev_pop(CASE WHEN elig THEN v END) OVER q + 1e-6) END AS signal FROM u WINDOW q AS (PARTITION BY formula_id, dt))"""


def signals(spark, sf_dir):
    return formula.formula_signal(inputs(spark, sf_dir), FORMULAS, ["x", "y", "z"])


@query("formula_signal", f"{SIGNALS} SELECT formula_id, sym, dt::VARCHAR AS dt, round(signal, 6) + 0.0 AS signal FROM signals")
def formula_signal(spark, sf_dir):
    return signals(spark, sf_dir).select("formula_id", "sym", "dt", digits(F.col("signal")).alias("signal"))


@query("formula_increment", f"{SIGNALS} SELECT formula_id, sym, dt::VARCHAR AS dt, round(signal, 6) + 0.0 AS signal FROM signals WHERE dt > (SELECT dt FROM axis ORDER BY dt DESC LIMIT 1 OFFSET 20)")
def formula_increment(spark, sf_dir):
    """The last 20 sessions' signals from those sessions and what the formulas look back."""
    since = (panel.standard(spark, sf_dir).agg(F.max("sess")).first()[0] or 0) - 19
    reach = max(formula.reach(t, {"x": 0, "y": 0, "z": 0}) for k, t in FORMULAS.items() if k != "broken")
    made = formula.appended_signal(inputs(spark, sf_dir, since - reach), FORMULAS, ["x", "y", "z"], since)
    return made.select("formula_id", "sym", "dt", digits(F.col("signal")).alias("signal"))


@query("random_formulas")
def random_formulas(spark, sf_dir):
    """A draw for each order's key: distinct formulas, their length and how many features and operators they hold."""
    seeds = panel.fixtures.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    made = formula.random_formulas(seeds, FEATURES, operators=OPERATORS)
    n_features = F.size(F.filter("tokens", lambda t: t.isin(FEATURES)))
    return made.select(F.array_join("tokens", " ").alias("formula"), F.size("tokens").alias("length"), n_features.alias("features"), (F.size("tokens") - n_features).alias("operators"))



def remapped(spark, stored):
    old = spark.createDataFrame([(1, k, f"F{k}") for k in range(1, 8)], "generation int, token int, name string")
    alias = spark.createDataFrame([("F4", "F1")], "name string, now string")
    now = spark.createDataFrame([(f"F{k}", 9 + k) for k in (1, 2, 3, 5, 6)], "name string, token int")
    good, _ = formula.formula_remap(stored, old, alias, now)
    return good.select("formula_id", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


@query(
    "formula_remap",
    """WITH k AS (SELECT l_orderkey AS formula_id, l_linenumber AS pos, l_partkey, l_extendedprice, CASE l_linenumber WHEN 1 THEN 10 WHEN 2 THEN 11 WHEN 3 THEN 12 WHEN 4 THEN 10 WHEN 5 THEN 14 WHEN 6 THEN 15 END AS new FROM lineitem)
    SELECT formula_id, array_to_string(list(new ORDER BY pos, l_partkey, l_extendedprice), ' ') AS tokens FROM k GROUP BY formula_id HAVING count(*) = count(new)""",
)
def formula_remap(spark, sf_dir):
    """A token list per order from all its line numbers, read in an old vocabulary; 4 is an alias of 1, 7 is gone."""
    line = panel.fixtures.read(spark, sf_dir, "lineitem")
    own = line.groupBy(F.col("l_orderkey").alias("formula_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))).alias("t"))
    return remapped(spark, own.select("formula_id", F.lit(1).alias("generation"), F.transform("t", lambda t: t["l_linenumber"]).alias("tokens")))
