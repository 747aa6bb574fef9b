"""The factor library: 62 named features as columns over the dense panel.

Three layers keep shuffles few: time-series helpers (partitioned by symbol), cross-section helpers (partitioned by session), and
the features themselves. All windows are over a symbol's sessions, so they share one exchange and one sort; what a session or an
industry has in common is an aggregate, one row each, that is sent to its cells. A window that several terms use is bound to a column
first, as Spark computes a window once for each place that names it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.functions.numeric import by_session, finite, is_close, ratio, trailing
from panelforge.functions.scan import exponential_means


def all_before() -> WindowSpec:
    return by_session().rowsBetween(Window.unboundedPreceding, 0)



@dataclass(frozen=True)
class Factor:
    name: str
    family: str
    needs: tuple[str, ...]
    build: Callable[[], Column]
    lookback: int | None = None
    description: str = ""


REGISTRY: dict[str, Factor] = {}
#: Names that are retired and what they mean now.
ALIASES = {"RET_20": "MOMENTUM_20"}


def register_factor(name: str, family: str, needs: str, build: Callable[[], Column], registry: dict[str, Factor] | None = None, lookback: int | None = None, description: str = "") -> None:
    """Add a factor: its name, family, the panel columns it needs and a function that gives its column.

    ``lookback`` is how many sessions before its own a value reads; None, the default, is all of them. It goes to ``registry``,
    a table of the caller's own, or to the library's.
    """
    registry = REGISTRY if registry is None else registry
    if name in registry:
        raise ValueError(f"factor {name} exists")
    if lookback is not None and lookback < 0:
        raise ValueError("lookback has to be 0 or more")
    if not callable(build):
        raise TypeError("build has to be callable")
    registry[name] = Factor(name, family, tuple(needs.split()), build, lookback, description)


def c(name: str) -> Column:
    return F.col(name)


def back(name: str, n: int) -> Column:
    return F.lag(name, n).over(by_session())


def seen(x: Column, window, least: int, value: Column) -> Column:
    return F.when(F.count(x).over(window) >= least, value)


def smooth_turnover(f, n: int) -> Column:
    return F.when(c("turnover_rate").isNotNull(), f("turnover_rate").over(trailing(n)))


def skew(n: int) -> Column:
    k = c(f"_seen{n}")
    return F.when(k >= 3, F.skewness("r").over(trailing(n)) * F.sqrt(k * (k - 1)) / (k - 2))


def kurt(n: int) -> Column:
    k = c(f"_seen{n}")
    return F.when(k >= 4, ((k + 1) * F.kurtosis("r").over(trailing(n)) + 6) * (k - 1) / ((k - 2) * (k - 3)))


def capm(part: str) -> Column:
    """Rolling regression on the market over 60 sessions: market sums run over all sessions, the stock's over valid ones."""
    n, sr, sm, srr, smm, srm = (c(x) for x in ("_n", "_sr", "_sm", "_srr", "_smm", "_srm"))
    cov, var_m, var_r = srm - sr * sm / n, smm - sm * sm / n, srr - sr * sr / n
    beta = F.try_divide(cov, var_m)
    value = {"beta": beta, "ivol": F.sqrt(F.greatest(var_r - beta * cov, F.lit(0.0))), "rsq": F.try_divide(cov * cov, var_r * var_m)}[part]
    return F.when((n >= 20) & (var_m > 1e-12) & (var_r > 1e-12), value)


def industry_relative(x: str) -> Column:
    return F.when(c("industry").isNotNull(), c(x) - c(f"_industry_{x}"))


def _register_all() -> None:
    """Windows over returns read one session more than their length less one, as a return reads the close before it."""

    def add(name: str, family: str, needs: str, lookback: int | None, description: str, build: Callable[[], Column]) -> None:
        register_factor(name, family, needs, build, lookback=lookback, description=description)

    for n in (1, 5, 10):
        add(f"RET_{n}", "momentum", "close", n, f"return of {n} sessions", lambda n=n: ratio(c("close"), back("close", n)))
    for n in (20, 60):
        add(f"VOL_{n}", "volatility", "close", n, f"deviation of {n} returns", lambda n=n: F.stddev_samp("r").over(trailing(n)))
    add("TURNOVER", "volume", "turnover_rate", 0, "turnover rate", lambda: finite(c("turnover_rate")))
    add("TURNOVER_CHG", "volume", "turnover_rate", 1, "change of the turnover rate", lambda: ratio(c("turnover_rate"), back("turnover_rate", 1)))
    add("TURNOVER_MA5", "volume", "turnover_rate", 4, "mean turnover rate of 5 sessions", lambda: smooth_turnover(F.avg, 5))
    add("TURNOVER_MA20", "volume", "turnover_rate", 19, "mean turnover rate of 20 sessions", lambda: smooth_turnover(F.avg, 20))
    add("TURNOVER_STD20", "volume", "turnover_rate", 19, "deviation of 20 turnover rates", lambda: smooth_turnover(F.stddev_samp, 20))
    add("VOLUME_RATIO", "volume", "volume", 19, "volume against its mean of 20 sessions", lambda: c("volume") / (F.avg("volume").over(trailing(20)) + 1e-9) - 1)
    add("VOLUME_IMPACT", "volume", "volume", 19, "log volume less its mean of 20 sessions", lambda: c("lv") - F.avg("lv").over(trailing(20)))
    add("AMPLITUDE", "volume", "high low close", 1, "range against the close before", lambda: (c("high") - c("low")) / (back("close", 1) + 1e-9))
    add("CLOSE_POSITION", "volume", "high low close", 0, "place of the close in the range", lambda: (c("close") - c("low")) / (c("high") - c("low") + 1e-9))
    for n in (20, 60):
        add(f"MOMENTUM_{n}", "momentum", "close", n, f"return of {n} sessions", lambda n=n: ratio(c("close"), back("close", n)))
    add("RET_120", "momentum", "close", 120, "return of 120 sessions", lambda: ratio(c("close"), back("close", 120)))
    for n in (5, 60, 120):
        add(f"REVERSAL_{n}", "momentum", "close", n, f"return of {n} sessions, turned", lambda n=n: -ratio(c("close"), back("close", n)))
    add("SKEW_20", "distribution", "close", 20, "skewness of 20 returns", lambda: skew(20))
    add("KURT_20", "distribution", "close", 20, "excess kurtosis of 20 returns", lambda: kurt(20))
    add("LIMIT_UP_EVENT", "event", "close high low pre_close", 0, "closed at the upper band", lambda: c("up"))
    add("LIMIT_DOWN_EVENT", "event", "close high low pre_close", 0, "closed at the lower band", lambda: c("down"))
    add("LIMIT_STREAK", "event", "close high low pre_close", None, "sessions in a row at the upper band", lambda: c("ups") - F.coalesce(F.max(F.when(c("up") == 0, c("ups"))).over(all_before()), F.lit(0.0)))
    add("LIMIT_UP_CNT_20", "event", "close high low pre_close", 19, "closes at the upper band in 20 sessions", lambda: F.sum("up").over(trailing(20)))
    add("LIMIT_BREAK", "event", "close high pre_close", 0, "touched the upper band and left it", lambda: c("broke"))
    add("OVERNIGHT_RET", "intraday", "open pre_close", 0, "open against the close before", lambda: ratio(c("open"), c("pre_close")))
    add("INTRADAY_RET", "intraday", "open close", 0, "close against the open", lambda: ratio(c("close"), c("open")))
    add("ILLIQ_20", "liquidity", "close amount", 20, "absolute return by amount, mean of 20 sessions", lambda: F.avg("illiq").over(trailing(20)))
    add("AMOUNT_SHARE", "liquidity", "amount", 0, "share of the session's amount", lambda: F.try_divide(c("amount"), c("_amount")))
    add("MAX_20", "lottery", "close", 20, "largest of 20 returns", lambda: F.max("r").over(trailing(20)))
    add("HIGH_52W", "momentum", "close", 249, "close against its highest of 250 sessions", lambda: ratio(c("close"), F.max("close").over(trailing(250))))
    for name, part, what in (("BETA_60", "beta", "slope"), ("IVOL_60", "ivol", "residual deviation"), ("RSQ_60", "rsq", "explained share")):
        add(name, "risk", "close", 60, f"regression on the market over 60 sessions: {what}", lambda part=part: capm(part))
    add("BIAS_20", "technical", "close", 19, "close against its mean of 20 sessions", lambda: ratio(c("close"), F.avg("close").over(trailing(20))))
    for name, what in (("RSI_14", "relative strength"), ("ATR_14", "true range"), ("MACD_DIF", "fast less slow mean"), ("MACD_DEA", "mean of the difference")):
        add(name, "technical", "close high low pre_close", None, f"{what}, exponential means", lambda name=name: c(f"_{name}"))
    add("SUSPEND_DAYS_60", "microstructure", "close", 59, "sessions without a bar in 60", lambda: F.sum(c("close").isNull().cast("double")).over(trailing(60)))
    add("LIST_AGE", "microstructure", "close", None, "bars so far", lambda: F.count("close").over(all_before()).cast("double"))
    add("MARKET_CAP", "fundamental", "amount turnover_rate", 0, "amount by turnover rate", lambda: F.try_divide(c("amount"), c("turnover_rate")))
    for name, x, n in (("RET_5", "r5", 5), ("RET_20", "r20", 20), ("VOL_20", "v20", 20), ("TURNOVER", "turnover_rate", 0)):
        add(f"IND_REL_{name}", "industry", "close turnover_rate industry", n, f"{name} less its mean in the industry", lambda x=x: industry_relative(x))
    for name in ("PE_TTM", "PB", "PS_TTM", "ROE", "ROA", "GROSS_MARGIN", "NET_MARGIN", "REVENUE_YOY", "PROFIT_YOY", "DEBT_RATIO", "DIVIDEND_YIELD", "MARGIN_BALANCE_CHG", "INDUSTRY_MOMENTUM"):
        add(name, "fundamental" if name[0] not in "MI" else "flow", f"ext_{name}", 0, f"column ext_{name} of the panel", lambda name=name: c(f"ext_{name}"))
    add("NORTHBOUND_CHG", "flow", "", 0, "no data: 0", lambda: F.lit(0.0))


_register_all()
EWM = ("RSI_14", "ATR_14", "MACD_DIF", "MACD_DEA")
INDUSTRY = {"IND_REL_RET_5": "r5", "IND_REL_RET_20": "r20", "IND_REL_VOL_20": "v20", "IND_REL_TURNOVER": "turnover_rate"}
MARKET = {"BETA_60", "IVOL_60", "RSQ_60"}


def with_ewm(panel: DataFrame, names: tuple[str, ...] | list[str] = EWM) -> DataFrame:
    """Adds those of ``_RSI_14, _ATR_14, _MACD_DIF, _MACD_DEA`` that are named: scans in columns, the last one over a difference of two."""
    names = [n for n in EWM if n in names]
    move = c("close") - back("close", 1)
    part = lambda x: F.when(move.isNotNull(), F.greatest(x, F.lit(0.0))).otherwise(0.0)
    terms = [c("high") - c("low"), F.abs(c("high") - c("pre_close")), F.abs(c("low") - c("pre_close"))]
    reach = F.when(terms[0].isNotNull() & terms[1].isNotNull() & terms[2].isNotNull(), F.greatest(*terms)).otherwise(0.0)
    made: dict[str, Column] = {"_row": F.row_number().over(by_session())}
    means: dict[str, tuple[str, float]] = {}
    if "RSI_14" in names:
        made |= {"_up": part(move), "_down": part(-move)}
        means |= {"_u": ("_up", 1 / 14), "_v": ("_down", 1 / 14)}
    if "ATR_14" in names:
        made["_reach"], means["_ATR_14"] = reach, ("_reach", 1 / 14)
    if {"MACD_DIF", "MACD_DEA"} & set(names):
        made["_filled"] = F.last("close", True).over(all_before())
        means |= {"_fast": ("_filled", 2 / 13), "_slow": ("_filled", 2 / 27)}
    own = exponential_means(panel.withColumns(made), means)
    if "_fast" in means:
        own = own.withColumn("_MACD_DIF", c("_fast") - c("_slow"))
    if "MACD_DEA" in names:
        own = exponential_means(own, {"_MACD_DEA": ("_MACD_DIF", 2 / 10)})
    if "RSI_14" in names:
        total = c("_u") + c("_v")
        own = own.withColumn("_RSI_14", F.when((c("_row") >= 14) & (total > 0), 100 * F.try_divide(c("_u"), total)))
    return own.select(*panel.columns, *(f"_{n}" for n in names))


def prepared(panel: DataFrame, names: list[str]) -> DataFrame:
    """``panel`` with the helper columns that the named factors use."""
    rate, move = F.col("rate"), F.try_divide("close", "pre_close") - 1
    sealed = is_close(c("close"), c("high")) & is_close(c("close"), c("low"))
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("double")
    touched = (c("high") >= c("pre_close") * (1 + rate) - 1e-9) & ~(move >= rate - 0.005)
    own = panel.withColumns({"r": ratio(c("close"), back("close", 1)), "lv": F.when(c("volume").isNotNull(), F.log1p(F.greatest("volume", F.lit(0.0)))), "up": flag(sealed & (move >= rate - 0.005)), "down": flag(sealed & (move <= -rate + 0.005)), "broke": flag(touched), "r5": ratio(c("close"), back("close", 5)), "r20": ratio(c("close"), back("close", 20))})
    own = own.withColumns({"illiq": F.try_divide(F.abs("r"), "amount"), "v20": F.stddev_samp("r").over(trailing(20)), "ups": F.sum("up").over(all_before())})
    listed = lambda x: F.when(c("elig"), c(x))
    shared: dict[tuple[str, ...], list[Column]] = {("dt",): [], ("dt", "industry"): [F.avg(listed(x)).alias(f"_industry_{x}") for n, x in INDUSTRY.items() if n in names]}
    if MARKET & set(names):
        shared["dt",].append(F.coalesce(F.avg(listed("r")), F.lit(0.0)).alias("mkt"))
    if "AMOUNT_SHARE" in names:
        shared["dt",].append(F.sum(listed("amount")).alias("_amount"))
    cells = own
    for key, made in shared.items():
        own = own.join(F.broadcast(cells.groupBy(*key).agg(*made)), list(key), "left") if made else own
    if MARKET & set(names):
        w = trailing(60)
        sums = {"_sr": c("r"), "_sm": c("mkt"), "_srr": c("r") * c("r"), "_smm": c("mkt") * c("mkt"), "_srm": c("r") * c("mkt")}
        own = own.withColumns({"_n": F.count("r").over(w).cast("double")} | {k: F.coalesce(F.sum(x).over(w), F.lit(0.0)) for k, x in sums.items()})
    if {"SKEW_20", "KURT_20"} & set(names):
        own = own.withColumn("_seen20", F.count("r").over(trailing(20)).cast("double"))
    return with_ewm(own, names) if set(EWM) & set(names) else own


def factors(panel: DataFrame, names: list[str], registry: dict[str, Factor] | None = None) -> DataFrame:
    """``sym, dt, sess, elig, industry`` and one column per factor; external features come as ``ext_<name>`` or are NULL.

    Names are looked up in ``registry``, by default the library's.
    """
    registry = REGISTRY if registry is None else registry
    names = [ALIASES.get(n, n) for n in names]
    if unknown := [n for n in names if n not in registry]:
        raise KeyError(f"unknown factors: {unknown}")
    absent = [f"ext_{n}" for n in names if f"ext_{n}" in registry[n].needs and f"ext_{n}" not in panel.columns]
    panel = panel.withColumns({x: F.lit(None).cast("double") for x in absent}) if absent else panel
    own = prepared(panel, names).select("sym", "dt", "sess", "elig", "industry", *(registry[n].build().alias(n) for n in names))
    return own.select("sym", "dt", "sess", "elig", "industry", *(finite(c(n)).alias(n) for n in names))


def lookback(names: list[str], registry: dict[str, Factor] | None = None) -> int | None:
    """Sessions before its own that a row of the named factors reads; None if one of them reads all."""
    registry = REGISTRY if registry is None else registry
    reach = [registry[ALIASES.get(n, n)].lookback for n in names]
    return None if None in reach else max(reach, default=0)


def appended(panel: DataFrame, names: list[str], since: int, registry: dict[str, Factor] | None = None) -> DataFrame:
    """Rows of :func:`factors` from session ``since`` on, equal to those of a whole run.

    Factors with a bounded lookback read that many sessions before ``since`` and no more: the bound is a literal on ``sess``, so a
    scan skips files and row groups without it. The others read the whole panel, if any is named. ``since`` at or before the
    first session gives everything, one past the last nothing.
    """
    registry = REGISTRY if registry is None else registry
    names = [ALIASES.get(n, n) for n in names]
    if unknown := [n for n in names if n not in registry]:
        raise KeyError(f"unknown factors: {unknown}")
    far = [n for n in names if registry[n].lookback is None]
    near = [n for n in names if n not in far]
    new = lambda rows, some: factors(rows, some, registry).where(c("sess") >= since)
    if not far:
        return new(panel.where(c("sess") >= since - lookback(near, registry)), near)
    whole = new(panel, far)
    if not near:
        return whole
    part = new(panel.where(c("sess") >= since - lookback(near, registry)), near)
    return part.join(whole.select("sym", "sess", *far), ["sym", "sess"]).select("sym", "dt", "sess", "elig", "industry", *names)
