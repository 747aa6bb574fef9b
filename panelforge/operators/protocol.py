"""Walk-forward evaluation: folds, candidate scoring and selection, trial statistics and multiple-testing corrections.

Folds, candidates, signs and permutations are rows; what would be nested loops are joins and group-bys.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.blocks import packed, unpacked

EULER = 0.5772156649015329


def resolve_folds(folds: DataFrame, axis: DataFrame) -> DataFrame:
    """``fold, train_start, train_end, test_start, test_end, broken`` as half-open session ranges of signals.

    Anchors (``train_anchor, test_anchor``) are inclusive; two sessions before an anchor no signal starts any more, so no return
    crosses it. An empty range is broken.
    """
    n = lambda c: F.count(F.when(F.col("dt") <= F.col(c), 1)).cast("int")
    own = axis.crossJoin(F.broadcast(folds)).groupBy("fold").agg(n("train_anchor").alias("a"), n("test_anchor").alias("b"))
    own = own.select("fold", F.lit(0).alias("train_start"), (F.col("a") - 2).alias("train_end"), F.col("a").alias("test_start"), (F.col("b") - 2).alias("test_end"), F.col("b").alias("test_stop"))
    return own.withColumn("broken", (F.col("train_end") <= F.col("train_start")) | (F.col("test_end") <= F.col("test_start")))


def training_window(axis: DataFrame, anchor: Column) -> DataFrame:
    return axis.agg(F.count(F.when(F.col("dt") <= anchor, 1)).cast("int").alias("a")).select(F.lit(0).alias("train_start"), (F.col("a") - 2).alias("train_end"))


def entry_exit_dates(axis: DataFrame) -> DataFrame:
    w = Window.orderBy("sess")
    return axis.select("dt", F.lead("dt", 1).over(w).alias("entry"), F.lead("dt", 2).over(w).alias("exit"))


def fold_issues(folds: DataFrame) -> DataFrame:
    """Folds that do not go forward, do not increase, or train before the previous test ends."""
    w = Window.orderBy("fold")
    own = folds.withColumn("_p", F.lag("test_anchor").over(w)).withColumn("_t", F.lag("train_anchor").over(w))
    issue = F.when(F.col("test_anchor") <= F.col("train_anchor"), "backward").when(F.col("train_anchor") <= F.col("_t"), "not increasing").when(F.col("train_anchor") < F.col("_p"), "overlap")
    return own.withColumn("issue", issue).where("issue is not null").select("fold", "issue")


def validation_windows(ranges: DataFrame, fraction: float = 0.35, splits: int = 4, least: int = 3) -> DataFrame:
    """``fold, window, lo, hi``: the tail of each training range in disjoint windows, or in one if they get too short.

    The tail begins at the rounded share of the range (halves to the even number) and keeps two sessions at least; ranges of two
    sessions or less are their own tail. All windows are equally long but the last, which has the rest.
    """
    n = F.col("train_end") - F.col("train_start")
    begin = F.when(n <= 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.rint(n * (1.0 - min(max(fraction, 0.0), 0.5))).cast("int"), n - 2)))
    own = ranges.withColumn("_s", F.col("train_start") + begin).withColumn("_n", F.col("train_end") - F.col("_s"))
    own = own.withColumn("_k", F.when(F.col("_n") < splits * least, 1).otherwise(splits)).withColumn("_each", F.floor(F.col("_n") / F.col("_k")).cast("int"))
    own = own.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    lo = F.col("_s") + F.col("window") * F.col("_each")
    hi = F.when(F.col("window") == F.col("_k") - 1, F.col("train_end")).otherwise(lo + F.col("_each"))
    return own.select("fold", "window", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def fold_slice(panel: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells of each fold's test range with ``fwd`` made of prices inside the slice alone. Ranges are few and broadcast."""
    r = F.broadcast(ranges.select("fold", "test_start", "test_end", "test_stop"))
    own = panel.join(r, (F.col("sess") >= F.col("test_start")) & (F.col("sess") < F.col("test_stop")))
    w = Window.partitionBy("fold", "sym").orderBy("sess")
    return own.withColumn("fwd", F.coalesce(F.try_divide(F.lead("open", 2).over(w), F.lead("open", 1).over(w)) - 1, F.lit(0.0))).where("sess < test_end").drop("test_start", "test_end", "test_stop")


def mirrored(signals: DataFrame) -> DataFrame:
    """Every signal and its mirror image, told apart by ``formula_id``, a struct of ``formula_id`` and ``sign``."""
    own = signals.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("signal", F.col("signal") * F.col("sign"))
    return own.withColumn("formula_id", F.struct("formula_id", "sign")).drop("sign")


KEYS = ["fold", "formula_id", "sign", "window"]
#: Full-window rewards of candidates that are rejected before they are scored (fixed values).
FLAT_REWARD, INVALID_REWARD = -2.0, -1.0


def basket(weight: float = 1.0) -> dict[str, Column]:
    """The library's scorer: the ICIR of a window's coefficients, and as reward the ICIR less its book's yearly cost, cut at -1 and 1."""
    icir = F.when(F.count("ic") >= 2, F.avg("ic") / (F.stddev_samp("ic") + 1e-9)).otherwise(0.0)
    cost = F.coalesce(F.avg("cost"), F.lit(0.0)) * 252
    return {"reward": F.least(F.greatest(icir - weight * cost, F.lit(-1.0)), F.lit(1.0)), "icir": icir}


def scored_windows(cells: DataFrame, scorer: Callable[[], dict[str, Column]] | Callable[[pa.Table], dict[str, float]], grouped: bool = False) -> DataFrame:
    """``fold, formula_id, sign, window, reward, icir`` by a scorer over ``sess, ic, cost`` of each window.

    A scorer is either a function that returns aggregate columns named ``reward`` and ``icir``, or (``grouped``) a function from an Arrow table
    of one window's sessions, in their order, to these two numbers.
    """
    if not grouped:
        made = scorer()
        return cells.groupBy(*KEYS).agg(*(made[c].cast("double").alias(c) for c in ("reward", "icir")))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def run(keys: tuple, rows: pa.Table) -> pa.Table:
        made = scorer(rows.select(["sess", "ic", "cost"]).sort_by("sess"))
        named = {k: rows.column(k).slice(0, 1) for k in KEYS}
        return pa.table(named | {c: pa.array([made[c]], pa.float64()) for c in ("reward", "icir")})

    return cells.groupBy(*KEYS).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", reward double, icir double")


def score_candidates(
    ics: DataFrame, costs: DataFrame, windows: DataFrame, weight: float = 1.0, penalty: DataFrame | None = None, flat: DataFrame | None = None, ranges: DataFrame | None = None,
    signals: DataFrame | None = None, invalid: DataFrame | None = None, scorer: Callable | None = None, grouped: bool = False,
) -> DataFrame:
    """``fold, formula_id, sign, val_reward, val_icir, full_reward, full_icir, flat, invalid``: each candidate in its better direction.

    ``ics``: ``formula_id, sess, ic``; ``costs``: ``formula_id, sign, sess, cost`` from the books of both sides (:func:`mirrored`);
    ``windows``: :func:`validation_windows`. The mirrored signal has mirrored coefficients and its own book's cost. Costs without
    ``sign`` hold for both sides. ``val_*`` are medians over the windows, ``full_*`` (with ``ranges``) are of the whole training range; a
    candidate's ``penalty`` (``formula_id, penalty``) is taken off both rewards. ``scorer``: see :func:`scored_windows`.

    Better is the higher reward, then ICIR. Where both are equal the side is taken on which the first value that is not zero, of the eligible
    cells of ``signals`` (``formula_id, sess, sym, elig, signal``) in the windows by session and symbol, is positive: a mirrored input then gives
    the mirrored sign and so the same trades. Candidates of ``flat`` (:func:`flat_signals`) have no scores but a full-window reward of -2;
    those of ``invalid`` (``formula_id``, malformed formulas, that have no signal) have a row in each fold, with -1.
    """
    spans = windows.select("fold", "window", "lo", "hi")
    if ranges is not None:
        spans = spans.unionByName(ranges.select("fold", F.lit(-1).alias("window"), F.col("train_start").alias("lo"), F.col("train_end").alias("hi")))
    own = ics.join(F.broadcast(spans), (F.col("sess") >= F.col("lo")) & (F.col("sess") < F.col("hi")))
    own = own.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("ic", F.col("ic") * F.col("sign"))
    own = own.join(costs, ["formula_id", "sign", "sess"] if "sign" in costs.columns else ["formula_id", "sess"], "left")
    each = scored_windows(own.select(*KEYS, "sess", "ic", "cost"), scorer or (lambda: basket(weight)), grouped)
    part = lambda f, c, inside: f(F.when(F.col("window") >= 0 if inside else F.col("window") < 0, F.col(c)))
    both = each.groupBy("fold", "formula_id", "sign").agg(part(F.median, "reward", True).alias("val_reward"), part(F.median, "icir", True).alias("val_icir"), part(F.max, "reward", False).alias("full_reward"), part(F.max, "icir", False).alias("full_icir"))
    if penalty is not None:
        cut = F.coalesce("penalty", F.lit(0.0))
        both = both.join(penalty.select("formula_id", "penalty"), "formula_id", "left").withColumns({c: F.col(c) - cut for c in ("val_reward", "full_reward")}).drop("penalty")
    if signals is not None:
        seen = signals.where("elig and signal is not null and not isnan(signal) and signal <> 0").join(F.broadcast(windows.select("fold", "lo", "hi")), (F.col("sess") >= F.col("lo")) & (F.col("sess") < F.col("hi")))
        first = seen.groupBy("fold", "formula_id").agg(F.signum(F.min_by("signal", F.struct("sess", "sym"))).cast("int").alias("_first"))
        both = both.join(first, ["fold", "formula_id"], "left")
    ahead = F.col("sign") == F.coalesce("_first", F.lit(1)) if signals is not None else F.col("sign") == 1
    best = Window.partitionBy("fold", "formula_id").orderBy(F.desc("val_reward"), F.desc("val_icir"), F.desc(ahead.cast("int")))
    columns = ["fold", "formula_id", "sign", "val_reward", "val_icir", "full_reward", "full_icir"]
    own = both.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*columns)
    if flat is None:
        own = own.withColumn("flat", F.lit(False))
    else:
        own = own.join(flat.select("fold", "formula_id").withColumn("flat", F.lit(True)), ["fold", "formula_id"], "full").withColumn("flat", F.coalesce("flat", F.lit(False)))
        gone = {"sign": F.when(F.col("flat"), 1).otherwise(F.col("sign")), "full_reward": F.when(F.col("flat"), FLAT_REWARD).otherwise(F.col("full_reward"))}
        own = own.withColumns(gone | {c: F.when(~F.col("flat"), F.col(c)) for c in ("val_reward", "val_icir", "full_icir")})
    own = own.select(*columns, "flat", F.lit(False).alias("invalid"))
    if invalid is None:
        return own
    none = F.lit(None).cast("double")
    rejected = invalid.select("formula_id").distinct().crossJoin(F.broadcast(windows.select("fold").distinct()))  # a row a fold
    return own.unionByName(rejected.select("fold", "formula_id", F.lit(1).alias("sign"), none.alias("val_reward"), none.alias("val_icir"), F.lit(INVALID_REWARD).alias("full_reward"), none.alias("full_icir"), F.lit(False).alias("flat"), F.lit(True).alias("invalid")))


def flat_signals(signals: DataFrame, axis: DataFrame, ranges: DataFrame, least: float = 1e-4) -> DataFrame:
    """``fold, formula_id`` of signals that are (nearly) constant over the eligible cells of the fold's training range, or have none.

    One row a candidate and fold: few.
    """
    own = signals.where("elig and signal is not null").join(F.broadcast(axis.select("dt", F.col("sess").alias("_sess"))), "dt")
    r = F.broadcast(ranges.select("fold", "train_start", "train_end"))
    seen = own.join(r, (F.col("_sess") >= F.col("train_start")) & (F.col("_sess") < F.col("train_end"))).groupBy("fold", "formula_id").agg((F.stddev_pop("signal") >= least).alias("moves"))
    every = signals.select("formula_id").distinct().crossJoin(F.broadcast(ranges.select("fold")))
    return every.join(seen.where("moves"), ["fold", "formula_id"], "left_anti")


FIGURES = "formula_id string, sess int, sign int, sym long, signal double, fwd double, ic double, n long, count long, mean double, m2 double"


def session_figures(wide: DataFrame, names: list[str], top: int, min_stocks: int = 10, standardised: bool = True, places: int = 9) -> DataFrame:
    """What scoring and trading need of the candidates' signals in the columns ``names``, by candidate and session (:data:`FIGURES`).

    ``wide``: ``sess, sym, elig, _fwd, _ok`` and the signals, a row a cell; ``_ok`` is 1 where the symbol can be bought at the next open and
    symbols are whole numbers below 2^53. Values that are not ``standardised`` get the cross-section z-score first. Signals equal to ``places`` digits tie.

    Rows with ``sign`` 0: the rank coefficient ``ic`` over ``n`` pairs, count, mean and sum of squared deviations of the signal, and its first
    value that is not 0 with its symbol. Rows with ``sign`` 1 and -1: the ``top`` highest of the signal and of its mirror image among the
    symbols that can be bought, ties by symbol. Only eligible cells' values are shuffled, in blocks of a session and 24 signals.
    """
    import numpy as np

    head, size = ["sym", "_ok", "_fwd"], 24
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in FIGURES.split(", ")])

    def ranks(v):
        _, which, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[which]

    def one(keys, rows):
        group, values = unpacked(keys, rows, groups)
        values = values[np.argsort(values[:, 0], kind="stable")]
        sym, ok, fwd, sess = values[:, 0].astype(np.int64), values[:, 1] == 1, values[:, 2], keys[0].as_py()
        out = []
        for name, v in zip(group[3:], values.T[3:], strict=True):
            seen = ~np.isnan(v)
            if not seen.any():
                continue
            if not standardised:
                v = (v - v[seen].mean()) / (v[seen].std() + 1e-6)
            v = np.round(v, places)
            both, some = seen & ~np.isnan(fwd), np.flatnonzero(seen & (v != 0))
            n, ic = int(both.sum()), None
            if n and n >= min_stocks:
                a, b = (x - x.mean() for x in (ranks(v[both]), ranks(fwd[both])))
                va, vb = a @ a, b @ b
                ic = float(a @ b / np.sqrt(va * vb)) if va > 1e-12 and vb > 1e-12 else None
            first = {"sym": int(sym[some[0]]), "signal": float(v[some[0]])} if len(some) else {}
            own = {"formula_id": name, "sess": sess}
            out.append(own | first | {"sign": 0, "ic": ic, "n": n, "count": int(seen.sum()), "mean": float(v[seen].mean()), "m2": float(np.square(v[seen] - v[seen].mean()).sum())})
            free = np.flatnonzero(seen & ok)
            for sign in (1, -1):
                for k in free[np.argsort(-sign * v[free], kind="stable")[:top]]:
                    out.append(own | {"sign": sign, "sym": int(sym[k]), "signal": float(sign * v[k]), "fwd": None if np.isnan(fwd[k]) else float(fwd[k])})
        return pa.Table.from_pylist(out, schema)

    groups = [[*head, *names[k : k + size]] for k in range(0, len(names), size)]
    return packed(wide.where("elig"), groups).groupBy("sess", "part").applyInArrow(one, FIGURES)


def flat_figures(figures: DataFrame, ranges: DataFrame, least: float = 1e-4) -> DataFrame:
    """:func:`flat_signals` from the count, mean and squared deviations of :func:`session_figures`."""
    r = F.broadcast(ranges.select("fold", "train_start", "train_end"))
    own = figures.where("sign = 0").join(r, (F.col("sess") >= F.col("train_start")) & (F.col("sess") < F.col("train_end")))
    n, total = F.sum("count"), F.sum(F.col("count") * F.col("mean"))
    spread = (F.sum(F.col("m2") + F.col("count") * F.col("mean") * F.col("mean")) - total * total / n) / n
    seen = own.groupBy("fold", "formula_id").agg((F.sqrt(F.greatest(spread, F.lit(0.0))) >= least).alias("moves"))
    every = figures.select("formula_id").distinct().crossJoin(F.broadcast(ranges.select("fold")))
    return every.join(seen.where("moves"), ["fold", "formula_id"], "left_anti")


def candidate_gates(scored: DataFrame, min_reward: float = 0.0, min_icir: float = 0.05) -> DataFrame:
    """Adds ``reasons`` against a candidate and ``eligible``."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    reasons = F.when(F.col("invalid"), F.array(F.lit("invalid formula"))).when(F.col("flat"), F.array(F.lit("constant signal"))).otherwise(F.array_compact(F.array(F.when(bad("val_reward"), F.lit("reward undefined")).when(F.col("val_reward") < min_reward, F.lit("reward low")), F.when(bad("val_icir"), F.lit("icir undefined")).when(F.col("val_icir") < min_icir, F.lit("icir low")))))
    return scored.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def family_ablation(scored: DataFrame, families: DataFrame) -> DataFrame:
    """``fold, family, candidate, val_reward, val_icir, was, eligible, loss``: what each candidate loses without each family.

    ``scored``: :func:`candidate_gates` of ``formula.ablated`` (``family|name``, the whole formula under ``none``). A family that a candidate does
    not use has the candidate's own scores and a loss of 0; losses are NULL where one side has no score. ``families`` are few and broadcast.
    """
    made = scored.select("fold", F.substring_index("formula_id", "|", 1).alias("family"), F.expr("substr(formula_id, instr(formula_id, '|') + 1)").alias("candidate"), F.struct("val_reward", "val_icir", "eligible").alias("_v"))
    base = made.where("family = 'none'").select("fold", "candidate", F.col("_v").alias("_b")).crossJoin(F.broadcast(families.select("family").distinct()))
    own = base.join(made, ["fold", "candidate", "family"], "left").withColumn("_v", F.coalesce("_v", "_b"))
    return own.select("fold", "family", "candidate", "_v.val_reward", "_v.val_icir", F.col("_b.eligible").alias("was"), "_v.eligible", (F.col("_b.val_reward") - F.col("_v.val_reward")).alias("loss"))


def select_candidate(gated: DataFrame) -> DataFrame:
    """The best eligible and the best rejected candidate of each fold, by validation values, then those of the full window, then name."""
    w = Window.partitionBy("fold", "eligible").orderBy(*(F.desc_nulls_last(c) for c in ("val_reward", "val_icir", "full_reward", "full_icir")), "formula_id")
    return gated.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def aggregate_trials(trials: DataFrame, metrics: list[str]) -> DataFrame:
    """Per candidate and metric: ``n, median, q25, q75, iqr, low, high``."""
    long = trials.unpivot(["candidate"], metrics, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = lambda p: F.percentile("value", F.lit(p))
    own = long.groupBy("candidate", "metric").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.min("value").alias("low"), F.max("value").alias("high"))
    return own.withColumn("iqr", F.col("q75") - F.col("q25"))


def top_trial(trials: DataFrame) -> DataFrame:
    good = trials.where(F.col("sharpe").isNotNull() & ~F.isnan("sharpe") & ~F.col("failed"))
    return good.agg(F.max_by(F.struct("candidate", "fold", "sharpe"), F.struct("sharpe", "candidate", "fold")).alias("t")).select("t.*")


def trial_moments(series: DataFrame) -> DataFrame:
    """``candidate, fold, sr, skew, kurt, t`` from rows ``candidate, fold, excess``; deviations are the sample's."""
    n = F.count("excess").cast("double")
    own = series.groupBy("candidate", "fold").agg(n.alias("t"), F.avg("excess").alias("m"), F.coalesce(F.stddev_samp("excess"), F.lit(0.0)).alias("s"), F.skewness("excess").alias("g"), F.kurtosis("excess").alias("k")).where("t >= 2")
    flat, shrink = F.col("s") < 1e-12, (F.col("t") - 1) / F.col("t")
    return own.select("candidate", "fold", F.when(flat, 0.0).otherwise(F.try_divide("m", "s")).alias("sr"), F.when(flat, 0.0).otherwise(F.col("g") * F.pow(shrink, F.lit(1.5))).alias("skew"), F.when(flat, 3.0).otherwise((F.col("k") + 3) * shrink * shrink).alias("kurt"), "t")


# fixed values: Hart's rational form of the normal tail, and Acklam's of its inverse
HART_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + k
    return out


def normal_tail(a: Column) -> Column:
    """The chance of more than ``a`` >= 0: a rational form, a continued fraction far out."""
    fraction = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    return F.exp(-a * a / 2) * F.when(a < 7.07106781186547, poly(HART_TOP, a) / poly(HART_BOTTOM, a)).otherwise(1 / fraction / 2.506628274631)


def normal_cdf(x: Column) -> Column:
    """The normal distribution, as a column, to about fifteen digits."""
    tail = normal_tail(F.abs(x))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_ppf(p: Column) -> Column:
    """The inverse of :func:`normal_cdf`, NULL outside 0 to 1: a rational form and one step towards the true value."""
    low = F.least(p, 1 - p)
    q, r = F.sqrt(-2 * F.log(low)), p - 0.5
    outer = poly(ACKLAM_C, q) / poly(ACKLAM_D, q)
    x = F.when(low < 0.02425, F.when(p < 0.5, outer).otherwise(-outer)).otherwise(poly(ACKLAM_A, r * r) * r / poly(ACKLAM_B, r * r))

    def refined(x: Column) -> Column:
        error = F.when(p < 0.5, normal_cdf(x) - p).otherwise((1 - p) - normal_tail(F.abs(x)))
        u = error * 2.5066282746310002 * F.exp(x * x / 2)
        return x - u / (1 + x * u / 2)

    # bound once by a transform over one element
    return F.when((p > 0) & (p < 1), F.transform(F.array(x), refined)[0])


def psr(benchmark: Column) -> Column:
    """The chance that the true ratio is above ``benchmark``, from the columns of :func:`trial_moments`."""
    sr, skew, kurt, t = (F.col(c) for c in ("sr", "skew", "kurt", "t"))
    return normal_cdf((sr - benchmark) * F.sqrt(t - 1) / F.sqrt(F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12))))


def expected_max_sr(n: Column) -> Column:
    """What the best of ``n`` trials without skill is expected to show; 0 for one trial."""
    spread = F.sqrt(1 / (F.col("t") - 1))
    z = (1 - EULER) * normal_ppf(1 - 1 / n) + EULER * normal_ppf(1 - 1 / (n * math.e))
    return F.when(n > 1, spread * z).otherwise(0.0)


def deflated_sharpe(moments: DataFrame) -> DataFrame:
    """The best trial's ``dsr`` against the expected best of all."""
    n = moments.agg(F.count(F.lit(1)).cast("double").alias("n_trials"))
    best = moments.orderBy(F.desc("sr"), "candidate", "fold").limit(1).crossJoin(F.broadcast(n))
    best = best.withColumn("benchmark", expected_max_sr(F.col("n_trials")))
    return best.withColumn("dsr", psr(F.col("benchmark")))


def max_t_bootstrap(series: DataFrame, permutations: int = 5000, block: int = 10, seed: int = 0) -> DataFrame:
    """``observed, p_value, n_perms, n_trials``: the largest t of all trials against circular block resamples.

    A trial is a row with its series, as long as the calendar; trials meet stretches of permutations, each pair with a seed of its
    own, and the largest t of a permutation is an aggregate. The driver sees four numbers.
    """
    import numpy as np

    spark, stretch = series.sparkSession, 100
    own = series.groupBy("candidate", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("sess", "excess"))), lambda x: x["excess"]).alias("x")).where(F.size("x") >= 2)
    own = own.select(F.xxhash64("candidate", "fold").alias("key"), F.transform("x", lambda v: v.cast("double")).alias("x"))

    def scaled(x):
        x = np.array(x, float)
        return x - x.mean(), max(float(x.std(ddof=1)), 1e-12), float(x.mean())

    def t_of(parts):
        for part in parts:
            made = [(len(x), *scaled(x)[1:]) for x in part.x]
            yield pd.DataFrame({"n": [n for n, _, _ in made], "t": [math.sqrt(n) * m / s if s > 1e-12 else 0.0 for n, s, m in made]})

    seen = own.mapInPandas(t_of, "n long, t double").agg(F.count(F.lit(1)).alias("n_trials"), F.min("n").alias("least"), F.max("t").alias("observed")).first()
    if not seen["n_trials"]:
        return spark.createDataFrame([], "observed double, p_value double, n_perms long, n_trials int")
    observed, width = seen["observed"], min(max(block, 1), seen["least"])

    def run(parts):
        for part in parts:
            top = {}
            for key, first, x in zip(part.key, part["first"], part.x, strict=True):
                x, s, _ = scaled(x)
                for k in range(first, min(first + stretch, permutations)):
                    starts = np.random.default_rng([seed, k, key % 2**64]).integers(0, len(x), -(-len(x) // width))
                    draw = x[(starts[:, None] + np.arange(width)).ravel()[: len(x)] % len(x)]
                    top[k] = max(top.get(k, -math.inf), math.sqrt(len(x)) * float(draw.mean()) / s)
            yield pd.DataFrame({"id": list(top), "top": list(top.values())}).astype({"id": "int64", "top": "float64"})

    stretches = F.broadcast(spark.range(0, permutations, stretch).withColumnRenamed("id", "first"))
    pairs = own.crossJoin(stretches).repartition("first", "key")
    draws = pairs.mapInPandas(run, "id long, top double").groupBy("id").agg(F.max("top").alias("top"))
    return draws.agg(F.lit(observed).alias("observed"), ((F.count(F.when(F.col("top") >= observed, 1)) + 1) / (permutations + 1)).alias("p_value"), F.count(F.lit(1)).alias("n_perms"), F.lit(seen["n_trials"]).cast("int").alias("n_trials"))


def merge_prior_trials(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Earlier trials join the correction pool, marked so that they never compete."""
    return current.withColumn("pool", F.lit("current")).unionByName(prior.withColumn("pool", F.lit("prior")), allowMissingColumns=True)
