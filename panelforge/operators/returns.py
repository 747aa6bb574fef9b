"""Forward returns, tradability and cross-section standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.numeric import by_session, is_close, ratio
from panelforge.operators.blocks import packed, unpacked


def open_to_open(*keys: str) -> Column:
    """Return from the next session's open to the one after; 0 if a price is missing."""
    w = by_session(*keys)
    return F.coalesce(ratio(F.lead("open", 2).over(w), F.lead("open", 1).over(w)), F.lit(0.0))


def limit_rate(symbol: Column, st: Column | None = None) -> Column:
    """Daily price band: 20 % on two boards, 5 % with an explicit flag, else 10 %."""
    board = F.when(F.substring(symbol, 1, 3).isin("300", "301", "688", "689"), 0.2).otherwise(0.1)
    return board if st is None else F.when(F.coalesce(st, F.lit(False)), 0.05).otherwise(board)


def suspended() -> Column:
    zero = F.lit(0.0)
    return (F.coalesce("open", zero) <= 0) | (F.coalesce("volume", zero) <= 0) | (F.coalesce("pre_close", zero) <= 0)


def one_word(side: str, rate: Column) -> Column:
    """The session traded at one price, at the band of ``side`` (buy: up, sell: down)."""
    same = is_close(F.col("open"), F.col("high")) & is_close(F.col("open"), F.col("low"))
    change = ratio(F.col("open"), F.col("pre_close"))
    return F.coalesce(same & ((change >= rate - 0.005) if side == "buy" else (change <= -rate + 0.005)), F.lit(False))


def can_be_bought() -> Column:
    """1 where the symbol is eligible and can be bought on the next session, else 0."""
    blocked, w = suspended() | one_word("buy", F.col("rate")) | ~F.col("elig"), by_session()
    return F.coalesce(F.lead("elig", 1).over(w) & ~F.lead(blocked, 1).over(w), F.lit(False)).cast("double")


def with_tradability(panel: DataFrame) -> DataFrame:
    """Adds ``blocked_buy`` and ``blocked_sell``; buying also needs eligibility."""
    rate = F.col("rate")
    return panel.withColumns({"blocked_buy": suspended() | one_word("buy", rate) | ~F.col("elig"), "blocked_sell": suspended() | one_word("sell", rate)})


def winsor_robust_z(long: DataFrame, low: float = 0.01, high: float = 0.99, clip: float = 5.0) -> DataFrame:
    """``value`` of ``factor_name`` rows standardised on each date over eligible cells.

    All cells are cut at the quantiles, then shifted by the median and scaled by the median absolute deviation (0 counts as 1) and
    cut at ``clip``; missing cells and dates without eligible cells give 0. Cutting keeps the order, so the median of the cut values
    is the cut median: one aggregate gives quantiles and median, a second one the deviation; both are joined back.
    """
    key = ["dt", "factor_name"]
    seen = F.when(F.col("elig"), F.col("value"))
    cuts = long.groupBy(*key).agg(F.percentile(seen, F.lit(low)).alias("_lo"), F.percentile(seen, F.lit(high)).alias("_hi"), F.median(seen).alias("_m"))
    inside = lambda c: F.least(F.greatest(c, "_lo"), "_hi")
    moved = long.join(cuts, key).withColumn("_d", F.when(F.col("value").isNotNull() & F.col("_lo").isNotNull(), inside("value") - inside("_m")))
    spread = moved.groupBy(*key).agg(F.median(F.when(F.col("elig"), F.abs("_d"))).alias("_s"))
    z = F.col("_d") / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    out = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))).otherwise(0.0)
    return moved.join(spread, key).withColumn("value", out).drop("_lo", "_hi", "_m", "_d", "_s")


def wide_robust_z(wide: DataFrame, names: list[str], low: float = 0.01, high: float = 0.99, clip: float = 5.0) -> DataFrame:
    """:func:`winsor_robust_z` of the columns ``names`` of ``sess, elig, ...``, a row a cell; other columns stay.

    Only the values of eligible cells are shuffled, in blocks of a session and a few features, and no keys with them: quantiles, median
    and deviation are of one feature on one session. What comes back is four numbers for each, a row a session, which is sent to all cells.
    """
    return robust_z(wide, names, robust_figures(wide, names, low, high), clip)


def robust_figures(wide: DataFrame, names: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``sess, k, lo, hi, mid, scale`` of the ``k``-th of ``names`` over a session's eligible cells; none without a value."""
    import numpy as np
    import pyarrow as pa

    def at(v, q: float) -> float:
        place = (len(v) - 1) * q
        k = int(place)
        part = place - k
        return float(v[k] * (1 - part) + v[k + 1] * part) if part else float(v[k])

    def one(keys, rows):
        group, values = unpacked(keys, rows, groups)
        out = []
        for name, v in zip(group, values.T, strict=True):
            v = np.sort(v[~np.isnan(v)])
            if len(v):
                lo, hi = at(v, low), at(v, high)
                inside = np.clip(v, lo, hi)
                middle = at(inside, 0.5)
                out.append((keys[0].as_py(), names.index(name), lo, hi, middle, at(np.sort(np.abs(inside - middle)), 0.5) or 1.0))
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    groups = [names[k : k + 8] for k in range(0, len(names), 8)]
    schema = pa.schema([("sess", pa.int32()), ("k", pa.int32()), *((c, pa.float64()) for c in ("lo", "hi", "mid", "scale"))])
    return packed(wide.where("elig"), groups).groupBy("sess", "part").applyInArrow(one, "sess int, k int, lo double, hi double, mid double, scale double")


def robust_z(wide: DataFrame, names: list[str], figures: DataFrame, clip: float = 5.0) -> DataFrame:
    """``wide`` with its columns ``names`` standardised by their :func:`robust_figures`."""
    by_day = figures.groupBy("sess").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("lo", "hi", "mid", "scale")))).alias("m"))
    by_day = by_day.select("sess", F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.try_element_at("m", k)).alias("_f"))

    def z(name: str, k: int) -> Column:
        f, x = F.get("_f", F.lit(k)), F.col(name).cast("double")
        d = (F.least(F.greatest(x, f["lo"]), f["hi"]) - f["mid"]) / f["scale"]
        return F.when(x.isNotNull() & f.isNotNull(), F.least(F.greatest(d, F.lit(-clip)), F.lit(clip))).otherwise(0.0).alias(name)

    own = wide.join(F.broadcast(by_day), "sess", "left")
    return own.select(*(z(c, names.index(c)) if c in names else F.col(c) for c in wide.columns))
