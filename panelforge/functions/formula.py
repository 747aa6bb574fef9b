"""Formula operators as columns, and signals composed from postfix formulas.

An operator knows its axis: ``row`` needs no neighbours, ``ts`` looks along a symbol, ``cs`` across a session. Inputs are
finite; undefined steps become 0. Leading rows of ``ts`` operators use what is there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import average_rank, by_session, trailing


@dataclass(frozen=True)
class Operator:
    name: str
    arity: int
    axis: str
    build: Callable[..., Column]
    lookback: int | None = 0


OPERATORS: dict[str, Operator] = {}


def register_operator(name: str, arity: int, axis: str, build: Callable[..., Column], operators: dict[str, Operator] | None = None, lookback: int | None = None) -> None:
    """Add an operator. ``build`` takes ``arity`` column names and gives a column.

    ``lookback``, of operators along a symbol: how many sessions before its own a value reads, None for all; others read none.
    It goes to ``operators``, a table of the caller's own, or to the library's.
    """
    operators = OPERATORS if operators is None else operators
    if name in operators:
        raise ValueError(f"operator {name} exists")
    if axis not in ("row", "ts", "cs"):
        raise ValueError(f"unknown axis {axis}")
    operators[name] = Operator(name, arity, axis, build, lookback if axis == "ts" else 0)


def c(x: str) -> Column:
    return F.col(x)


def delayed(x: str, n: int) -> Column:
    return F.coalesce(F.lag(x, n).over(by_session()), F.first(x).over(by_session()))


def windowed_correlation(x: str, y: str, n: int) -> Column:
    w = trailing(n)
    k = F.count(F.lit(1)).over(w).cast("double")
    mean = lambda e: F.sum(e).over(w) / k
    mx, my = mean(c(x)), mean(c(y))
    vx, vy = F.greatest(mean(c(x) * c(x)) - mx * mx, F.lit(0.0)), F.greatest(mean(c(y) * c(y)) - my * my, F.lit(0.0))
    root = F.sqrt(vx * vy)
    return F.when(root > 1e-9, F.try_divide(mean(c(x) * c(y)) - mx * my, root)).otherwise(0.0)


def rank_share(x: str, n: int) -> Column:
    """Share of the window's values that are not above the current one."""
    values = F.collect_list(x).over(trailing(n))
    return F.size(F.filter(values, lambda v: v <= c(x))) / F.size(values)


def jump(x: str, expanding: bool = False) -> Column:
    """Excess over three deviations of the symbol's whole series; ``expanding`` looks at the past alone."""
    w = by_session().rowsBetween(Window.unboundedPreceding, 0) if expanding else Window.partitionBy("sym")
    return F.greatest(F.try_divide(c(x) - F.avg(x).over(w), F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)) + 1e-6) - 3, F.lit(0.0))


def reference(x: str) -> Column:
    return F.when(c("elig"), c(x))


def standing(value: Column, x: str) -> Column:
    """Values of eligible rows; 0 on dates without any, NULL for others."""
    some = F.count(reference(x)).over(Window.partitionBy("dt")) > 0
    return F.when(~some, 0.0).when(c("elig"), value)


def cs_zscore(x: str) -> Column:
    w = Window.partitionBy("dt")
    return standing((c(x) - F.avg(reference(x)).over(w)) / (F.stddev_pop(reference(x)).over(w) + 1e-6), x)


def cs_demean(x: str) -> Column:
    return standing(c(x) - F.avg(reference(x)).over(Window.partitionBy("dt")), x)


def cs_rank(x: str) -> Column:
    return standing((average_rank(["dt", "elig"], x) - 1) / F.count(F.lit(1)).over(Window.partitionBy("dt", "elig")), x)


def cs_neutralize(x: str) -> Column:
    mean = F.avg(reference(x)).over(Window.partitionBy("dt", "industry"))
    return standing(F.when(c("industry").isNull() | mean.isNull(), c(x)).otherwise(c(x) - mean), x)


def _register_all() -> None:
    add = register_operator
    add("ADD", 2, "row", lambda x, y: c(x) + c(y))
    add("SUB", 2, "row", lambda x, y: c(x) - c(y))
    add("MUL", 2, "row", lambda x, y: c(x) * c(y))
    add("DIV", 2, "row", lambda x, y: F.try_divide(c(x), F.when(c(y) == 0, F.lit(1e-6)).otherwise(c(y) + 1e-6 * F.signum(c(y)))))
    add("NEG", 1, "row", lambda x: -c(x))
    add("ABS", 1, "row", lambda x: F.abs(c(x)))
    add("SIGN", 1, "row", lambda x: F.signum(c(x)))
    add("GATE", 3, "row", lambda cond, x, y: F.when(c(cond) > 0, c(x)).otherwise(c(y)))
    add("JUMP", 1, "ts", jump)
    add("JUMP_EXPANDING", 1, "ts", lambda x: jump(x, expanding=True))
    add("DECAY", 1, "ts", lambda x: c(x) + 0.8 * delayed(x, 1) + 0.6 * delayed(x, 2), lookback=2)
    add("DELAY1", 1, "ts", lambda x: delayed(x, 1), lookback=1)
    add("MAX3", 1, "ts", lambda x: F.max(x).over(trailing(3)), lookback=2)
    for n in (5, 10, 20):
        add(f"DELTA{n}", 1, "ts", lambda x, n=n: c(x) - delayed(x, n), lookback=n)
    for n in (5, 10, 20, 60):
        add(f"MA{n}", 1, "ts", lambda x, n=n: F.avg(x).over(trailing(n)), lookback=n - 1)
        add(f"STD{n}", 1, "ts", lambda x, n=n: F.stddev_pop(x).over(trailing(n)), lookback=n - 1)
        add(f"TS_RANK{n}", 1, "ts", lambda x, n=n: rank_share(x, n), lookback=n - 1)
        add(f"CORR{n}", 2, "ts", lambda x, y, n=n: windowed_correlation(x, y, n), lookback=n - 1)
        add(f"DOWNVOL{n}", 1, "ts", lambda x, n=n: F.sqrt(F.avg(F.pow(F.least(c(x), F.lit(0.0)), F.lit(2.0))).over(trailing(n))), lookback=n - 1)
    add("CS_ZSCORE", 1, "cs", cs_zscore)
    add("CS_DEMEAN", 1, "cs", cs_demean)
    add("CS_RANK", 1, "cs", cs_rank)
    add("CS_NEUTRALIZE", 1, "cs", cs_neutralize)


_register_all()


def depth(tokens: list[str], features: set[str], operators: dict[str, Operator] | None = None) -> int | None:
    """How many values a postfix formula leaves; None if it is malformed."""
    n, operators = 0, OPERATORS if operators is None else operators
    for t in tokens:
        if t in operators:
            n -= operators[t].arity - 1
            if n < 1:
                return None
        elif t in features:
            n += 1
        else:
            return None
    return n


def malformed(formulas: dict[str, list[str]], features: list[str], operators: dict[str, Operator] | None = None) -> list[str]:
    """Names of formulas that do not come out as one value: unknown tokens, too few arguments or values left over."""
    return [name for name, tokens in formulas.items() if depth(tokens, set(features), OPERATORS if operators is None else operators) != 1]


def formula_signal(panel: DataFrame, formulas: dict[str, list[str]], features: list[str], operators: dict[str, Operator] | None = None) -> DataFrame:
    """``formula_id, sym, dt, sess, elig, signal``: formulas over feature columns, ending in a cross-section z-score.

    Steps of all formulas are grouped: those that are ready and share an axis are made together, so the panel is exchanged by
    symbol and by session as seldom as the formulas allow. Equal steps are made once. Malformed formulas give no rows.
    """
    wide, ends = _made(panel, formulas, features, operators, True)
    if not ends:
        return panel.select(F.lit("").alias("formula_id"), "sym", "dt", "sess", "elig", F.lit(0.0).alias("signal")).where("false")
    wide = wide.select("sym", "dt", "sess", "elig", *(F.col(v).alias(k) for k, v in ends.items()))
    return wide.unpivot(["sym", "dt", "sess", "elig"], list(ends), "formula_id", "signal")


def formula_values(panel: DataFrame, formulas: dict[str, list[str]], features: list[str], others: list[str], operators: dict[str, Operator] | None = None) -> DataFrame:
    """The columns ``others`` and a column a formula, a row a cell: what :func:`formula_signal` takes the cross-section z-score of."""
    wide, ends = _made(panel, formulas, features, operators, False)
    return wide.select(*others, *(F.col(v).alias(k) for k, v in ends.items()))


def _made(panel: DataFrame, formulas: dict[str, list[str]], features: list[str], operators: dict[str, Operator] | None, standardised: bool) -> tuple[DataFrame, dict[str, str]]:
    """``panel`` with the steps of the well-formed formulas, and the column that each of these ends in."""
    operators = OPERATORS if operators is None else operators
    steps: dict[tuple, str] = {}
    ends: dict[str, str] = {}
    level: dict[str, int] = {f: 0 for f in features}
    plan: dict[tuple[int, str], dict[str, Column]] = {}
    for name, tokens in formulas.items():
        if depth(tokens, set(features), operators) != 1:
            continue
        stack: list[str] = []
        for t in [*tokens, *(["CS_ZSCORE"] if standardised else [])]:
            if t not in operators:
                stack.append(t)
                continue
            op = operators[t]
            args = tuple(stack[len(stack) - op.arity :])
            del stack[len(stack) - op.arity :]
            if (t, args) not in steps:
                own = f"_step{len(steps)}"
                steps[t, args] = own
                # a step comes after its inputs; ts before cs within a level, so equal axes meet
                level[own] = max(level[a] for a in args) + 1
                plan.setdefault((level[own], {"row": "a", "ts": "b", "cs": "c"}[op.axis]), {})[own] = op.build(*args)
            stack.append(steps[t, args])
        ends[name] = stack[0]
    last = set(ends.values()) if standardised else set()
    for _, made in sorted(plan.items(), key=lambda x: x[0]):
        panel = panel.withColumns({k: v if k in last else F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0)) for k, v in made.items()})
    return panel, ends


def without_zero(tokens: list[str], zero: str, operators: dict[str, Operator] | None = None) -> list[str]:
    """A well-formed formula without the sums that add the feature ``zero``, which is 0 everywhere: its values stay."""
    stack: list[list[str]] = []
    operators = OPERATORS if operators is None else operators
    for t in tokens:
        n = operators[t].arity if t in operators else 0
        args = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        if t == "ADD" and [zero] in args:
            stack.append(args[1] if args[0] == [zero] else args[0])
        else:
            stack.append([*(x for a in args for x in a), t])
    return stack[0]


def ablated(formulas: dict[str, list[str]], family_of: dict[str, str], neutral: str) -> dict[str, list[str]]:
    """``family|name``: each formula with the features of one of its families replaced by the column ``neutral``; ``none|name``: as it is.

    Families that a formula does not use would leave it as it is, so they are not made.
    """
    out = {}
    for name, tokens in formulas.items():
        used = sorted({family_of[t] for t in tokens if t in family_of})
        out |= {f"{gone}|{name}": [neutral if family_of.get(t) == gone else t for t in tokens] for gone in ["none", *used]}
    return out


def reach(tokens: list[str], features: dict[str, int | None], operators: dict[str, Operator] | None = None) -> int | None:
    """Sessions before its own that a well-formed formula reads: its operators' lookbacks added up along each argument, the longest
    counting, from those of its features. None if a part reads all sessions."""
    stack: list[float] = []
    operators = OPERATORS if operators is None else operators
    known = lambda n: float("inf") if n is None else n
    for t in tokens:
        if t not in operators:
            stack.append(known(features[t]))
            continue
        op = operators[t]
        args = stack[len(stack) - op.arity :]
        del stack[len(stack) - op.arity :]
        stack.append(max(args) + known(op.lookback))
    return None if stack[0] == float("inf") else int(stack[0])


def appended_signal(panel: DataFrame, formulas: dict[str, list[str]], features: list[str], since: int, operators: dict[str, Operator] | None = None) -> DataFrame:
    """Rows of :func:`formula_signal` from session ``since`` on, equal to those of a whole run.

    Formulas that read a bounded number of sessions read only those of the panel; the others read all of it.
    """
    bad = malformed(formulas, features, operators)
    reaches = {k: reach(t, dict.fromkeys(features, 0), operators) for k, t in formulas.items() if k not in bad}
    near = {k: formulas[k] for k, n in reaches.items() if n is not None}
    far = {k: formulas[k] for k, n in reaches.items() if n is None}
    first = since - max((n for n in reaches.values() if n is not None), default=0)
    own = formula_signal(panel.where(c("sess") >= first), near, features, operators)
    own = own.unionByName(formula_signal(panel, far, features, operators)) if far else own
    return own.where(c("sess") >= since)


def formula_remap(stored: DataFrame, vocabulary: DataFrame, aliases: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Formulas (``formula_id, generation, tokens``) resolved by name against the current vocabulary.

    ``vocabulary``: ``generation, token, name``; ``aliases``: ``name, now``; ``current``: ``name, token``. Returns the
    resolved formulas and, for those with a name that is gone, ``formula_id, name``.
    """
    each = stored.select("formula_id", "generation", F.posexplode("tokens").alias("at", "token")).join(F.broadcast(vocabulary), ["generation", "token"], "left")
    named = each.join(F.broadcast(aliases), "name", "left").withColumn("name", F.coalesce("now", "name")).select("formula_id", "at", "name", F.col("token").alias("old"))
    found = named.join(F.broadcast(current), "name", "left")
    lost = found.where("token is null").select("formula_id", F.coalesce("name", F.concat(F.lit("token "), F.col("old").cast("string"))).alias("name"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "token")))
    good = found.join(lost.select("formula_id").distinct(), "formula_id", "left_anti").groupBy("formula_id").agg(ordered.alias("t"))
    return good.select("formula_id", F.transform("t", lambda t: t["token"]).alias("tokens")), lost


def random_formulas(seeds: DataFrame, features: list[str], longest: int = 12, seed: int = 1, operators: dict[str, Operator] | None = None) -> DataFrame:
    """``tokens``: distinct valid postfix formulas, one drawn for each row of ``seeds`` (``id``) from that id and ``seed``.

    What is drawn depends on the arguments alone, whatever else is registered.
    """
    arity = {k: o.arity for k, o in (OPERATORS if operators is None else operators).items()}

    def draw(parts):
        import random

        import pandas as pd

        for part in parts:
            out = []
            for k in part.id:
                rng, tokens, open_values = random.Random(f"{seed}-{k}"), [], 0
                size = rng.randint(2, longest)
                while True:
                    room = size - len(tokens)
                    fitting = [o for o, a in arity.items() if a <= open_values and open_values - a + 1 <= room]
                    if open_values == 1 and tokens and (room <= 0 or rng.random() < 0.15):
                        break
                    if not open_values or (room > open_values and rng.random() < 0.5) or not fitting:
                        tokens.append(rng.choice(features))
                        open_values += 1
                    else:
                        o = rng.choice(fitting)
                        tokens.append(o)
                        open_values -= arity[o] - 1
                out.append(tokens)
            yield pd.DataFrame({"tokens": out})

    return seeds.select("id").mapInPandas(draw, "tokens array<string>").dropDuplicates(["tokens"])
