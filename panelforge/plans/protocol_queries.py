"""Queries on walk-forward evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelforge.functions import factors as lib
from panelforge.functions import formula
from panelforge.functions.numeric import digits
from panelforge.operators import panel, protocol, quality, returns
from panelforge.operators import portfolio as pf
from panelforge.plans.formula_queries import F_SQL, FORMULAS, SIGNALS, inputs, signals
from panelforge.plans.panel_queries import EVERY, FAM, LONG, MIN_STOCKS, all_families, all_standard, axis, scored, standard_wide
from panelforge.plans.portfolio_queries import BOOK, N, daily, last_session, rounded, tradable, two_books
from panelforge.plans.base_sql import BARS, EWM, EWM_NAMES, HELPERS, by_day
from panelforge.plans.registry import query
from panelforge.sources.shared import scratch

ANCHORS = [(1, "1997-12-31", "1998-12-31"), (2, "1998-12-31", "1999-12-31"), (3, "1999-12-31", "2000-12-31"), (4, "2030-01-01", "2031-01-01")]
FOLDS = "folds AS (SELECT fold, ta::DATE AS train_anchor, te::DATE AS test_anchor FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, a, b in ANCHORS) + ") f(fold, ta, te))"
RANGES = FOLDS + ", ab AS (SELECT fold, (SELECT count(*) FROM axis WHERE dt <= train_anchor)::INT AS a, (SELECT count(*) FROM axis WHERE dt <= test_anchor)::INT AS b FROM folds), ranges AS (SELECT fold, 0 AS train_start, a - 2 AS train_end, a AS test_start, b - 2 AS test_end, b AS test_stop, a - 2 <= 0 OR b - 2 <= a AS broken FROM ab)"


def folds(spark):
    return spark.createDataFrame(ANCHORS, "fold int, a string, b string").select("fold", F.to_date("a").alias("train_anchor"), F.to_date("b").alias("test_anchor"))


def ranges(spark, sf_dir):
    return protocol.resolve_folds(folds(spark), axis(spark, sf_dir))


def sound(spark, sf_dir):
    return ranges(spark, sf_dir).where("not broken")


@query("resolve_folds", f"WITH {BARS}, {RANGES} SELECT * FROM ranges")
def resolve_folds(spark, sf_dir):
    return ranges(spark, sf_dir)


@query("training_window", f"WITH {BARS} SELECT 0 AS train_start, (count(*) FILTER (dt <= DATE '1999-12-31'))::INT - 2 AS train_end FROM axis")
def training_window(spark, sf_dir):
    return protocol.training_window(axis(spark, sf_dir), F.lit("1999-12-31").cast("date"))


@query("entry_exit_dates", f"WITH {BARS} SELECT dt::VARCHAR AS dt, (lead(dt, 1) OVER (ORDER BY sess))::VARCHAR AS entry, (lead(dt, 2) OVER (ORDER BY sess))::VARCHAR AS exit FROM axis")
def entry_exit_dates(spark, sf_dir):
    return protocol.entry_exit_dates(axis(spark, sf_dir))


YEARS = f"{BARS}, yf AS (SELECT year(dt)::INT AS fold, min(dt) AS train_anchor, CASE WHEN year(dt) % 3 = 0 THEN min(dt) ELSE max(dt) + 60 END::DATE AS test_anchor FROM bars GROUP BY year(dt))"


@query("fold_issues", f"WITH {YEARS} SELECT fold, issue FROM (SELECT fold, CASE WHEN test_anchor <= train_anchor THEN 'backward' WHEN train_anchor <= lag(train_anchor) OVER (ORDER BY fold) THEN 'not increasing' WHEN train_anchor < lag(test_anchor) OVER (ORDER BY fold) THEN 'overlap' END AS issue FROM yf) WHERE issue IS NOT NULL")
def fold_issues(spark, sf_dir):
    """A fold per year of data, every third broken."""
    own = panel.fixtures.bars(spark, sf_dir).groupBy(F.year("dt").alias("fold")).agg(F.min("dt").alias("train_anchor"), F.max("dt").alias("last"))
    return protocol.fold_issues(own.select("fold", "train_anchor", F.when(F.col("fold") % 3 == 0, F.col("train_anchor")).otherwise(F.date_add("last", 60)).alias("test_anchor")))


WINS = """wn AS (SELECT fold, train_end, CASE WHEN train_end <= 2 THEN 0 ELSE greatest(1, least(round_even(train_end * (1 - 0.35::DOUBLE), 0)::INT, train_end - 2)) END AS s FROM ranges WHERE NOT broken),
wk AS (SELECT *, CASE WHEN train_end - s < 12 THEN 1 ELSE 4 END AS k FROM wn),
wins AS (SELECT fold, w::INT AS "window", (s + w * ((train_end - s) // k))::INT AS lo, (CASE WHEN w = k - 1 THEN train_end ELSE s + (w + 1) * ((train_end - s) // k) END)::INT AS hi FROM wk, unnest(generate_series(0, k - 1)) t(w))"""


@query("validation_windows", f"WITH {BARS}, {RANGES}, {WINS} SELECT * FROM wins")
def validation_windows(spark, sf_dir):
    return protocol.validation_windows(sound(spark, sf_dir))


@query("fold_slice", f"{BOOK}, {RANGES}, sl AS (SELECT fold, p.sym, p.dt, p.sess, test_end, coalesce(lead(open, 2) OVER w / lead(open, 1) OVER w - 1, 0) AS fwd FROM panel p JOIN ranges ON NOT broken AND sess >= test_start AND sess < test_stop WINDOW w AS (PARTITION BY fold, p.sym ORDER BY sess)) SELECT fold, sym, dt::VARCHAR AS dt, round(fwd, 6) + 0.0 AS fwd FROM sl WHERE sess < test_end")
def fold_slice(spark, sf_dir):
    own = protocol.fold_slice(panel.standard(spark, sf_dir), sound(spark, sf_dir))
    return own.select("fold", "sym", "dt", digits(F.col("fwd")).alias("fwd"))


def scores(spark, sf_dir, scorer=None, grouped=False):
    """Each side of a candidate with the names and costs of its own book; constant signals and malformed formulas have no scores."""
    days, ranges = F.broadcast(axis(spark, sf_dir)), sound(spark, sf_dir)
    ics = quality.rank_ic(scored(spark, sf_dir), MIN_STOCKS).join(days, "dt").select("formula_id", "sess", "ic")
    costs = two_books(spark, sf_dir).select("formula_id", "sign", "sess", "cost")
    bare = spark.createDataFrame([(k, 0.02) for k, tokens in FORMULAS.items() if len(tokens) == 1], "formula_id string, penalty double")
    bad = spark.createDataFrame([(k,) for k in formula.malformed(FORMULAS, ["x", "y", "z"])], "formula_id string")
    own = signals(spark, sf_dir)
    flat = protocol.flat_signals(own.drop("sess"), axis(spark, sf_dir), ranges)
    seen = own.withColumn("signal", F.round("signal", 9))
    return protocol.score_candidates(ics, costs, protocol.validation_windows(ranges), penalty=bare, flat=flat, ranges=ranges, signals=seen, invalid=bad, scorer=scorer, grouped=grouped)


#: The books of both sides, from the text of :data:`BOOK`, keyed ``formula_id|sign``.
BOOK_TABLES = "cand|picks|weights|net|moved|gross|daily"
SIDES = "(VALUES (1), (-1)) s(sign)"
BOOK2 = re.sub(rf"(^|FROM |JOIN )({BOOK_TABLES}|signals)\b", r"\g<1>\g<2>2", BOOK[BOOK.index("\ncand AS") + 1 : BOOK.index(",\neq AS")], flags=re.M)
SCORES = f"""{BOOK}, {RANGES}, {WINS},
signals2 AS (SELECT formula_id || '|' || sign AS formula_id, sym, dt, elig, signal * sign AS signal FROM signals CROSS JOIN {SIDES}),
{BOOK2},
spans AS (SELECT fold, "window", lo, hi FROM wins UNION ALL SELECT fold, -1, 0, train_end FROM ranges WHERE NOT broken),
sided AS (SELECT ic.formula_id, s.sign, a.sess, ic.ic * s.sign AS ic, d.cost FROM ic JOIN axis a USING (dt) CROSS JOIN {SIDES} LEFT JOIN daily2 d ON d.formula_id = ic.formula_id || '|' || s.sign AND d.sess = a.sess),
each AS (SELECT fold, formula_id, "window", sign, {{icir}} AS icir, {{reward}} AS reward FROM sided JOIN spans ON sess >= lo AND sess < hi GROUP BY 1, 2, 3, 4),
med AS (SELECT fold, formula_id, sign, median(reward) FILTER ("window" >= 0) - any_value(cut) AS val_reward, median(icir) FILTER ("window" >= 0) AS val_icir, max(reward) FILTER ("window" < 0) - any_value(cut) AS full_reward, max(icir) FILTER ("window" < 0) AS full_icir
  FROM (SELECT *, CASE formula_id WHEN 'plain' THEN 0.02 ELSE 0 END AS cut FROM each) GROUP BY 1, 2, 3),
firsts AS (SELECT fold, formula_id, sign(arg_min(round(signal, 9), (sess, sym)))::INT AS f FROM signals JOIN axis USING (dt) JOIN wins ON sess >= lo AND sess < hi WHERE elig AND round(signal, 9) <> 0 GROUP BY 1, 2),
moves AS (SELECT fold, formula_id FROM signals JOIN axis USING (dt) JOIN ranges ON NOT broken AND sess < train_end WHERE elig AND signal IS NOT NULL GROUP BY 1, 2 HAVING stddev_pop(signal) >= 1e-4),
better AS (SELECT med.* FROM med LEFT JOIN firsts USING (fold, formula_id) QUALIFY row_number() OVER (PARTITION BY fold, formula_id ORDER BY val_reward DESC, val_icir DESC, sign = coalesce(f, 1) DESC) = 1),
flats AS (SELECT *, TRUE AS flat FROM (SELECT fold, formula_id FROM (SELECT DISTINCT formula_id FROM signals), (SELECT fold FROM ranges WHERE NOT broken) EXCEPT SELECT fold, formula_id FROM moves)),
sc AS (SELECT fold, formula_id, CASE WHEN flat THEN 1 ELSE sign END AS sign, CASE WHEN flat IS NULL THEN val_reward END AS val_reward, CASE WHEN flat IS NULL THEN val_icir END AS val_icir,
  CASE WHEN flat THEN -2 ELSE full_reward END AS full_reward, CASE WHEN flat IS NULL THEN full_icir END AS full_icir, CASE WHEN flat THEN 'constant signal' END AS bad FROM better FULL JOIN flats USING (fold, formula_id)
  UNION ALL SELECT DISTINCT fold, 'broken', 1, NULL::DOUBLE, NULL::DOUBLE, -1.0, NULL::DOUBLE, 'invalid formula' FROM wins),
gated AS (SELECT * EXCLUDE (bad), bad IS NULL AND val_reward >= 0 AND val_icir >= 0.05 AS eligible, coalesce(bad, CASE WHEN val_reward < 0 THEN 'reward low' ELSE '' END || CASE WHEN val_reward < 0 AND val_icir < 0.05 THEN ',' ELSE '' END || CASE WHEN val_icir < 0.05 THEN 'icir low' ELSE '' END) AS reasons FROM sc),
chosen AS (SELECT * FROM gated QUALIFY row_number() OVER (PARTITION BY fold, eligible ORDER BY val_reward DESC NULLS LAST, val_icir DESC NULLS LAST, full_reward DESC NULLS LAST, full_icir DESC NULLS LAST, formula_id) = 1)"""
ICIR = "CASE WHEN count(ic) >= 2 THEN avg(ic) / (stddev_samp(ic) + 1e-9) ELSE 0 END"
BY_SCORER = SCORES


def by_scorer(icir: str, reward: str) -> str:
    return BY_SCORER.replace("{icir}", icir).replace("{reward}", reward)


SCORES = by_scorer(ICIR, f"least(greatest({ICIR} - coalesce(avg(cost), 0) * 252, -1), 1)")
VALUES = ("val_reward", "val_icir", "full_reward", "full_icir")
V = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in VALUES)


@query("score_candidates", f"{SCORES} SELECT fold, formula_id, sign, {V} FROM sc")
def score_candidates(spark, sf_dir):
    return rounded(scores(spark, sf_dir).drop("flat", "invalid"), *VALUES)


@query("candidate_gates", f"{SCORES} SELECT fold, formula_id, reasons, eligible FROM gated")
def candidate_gates(spark, sf_dir):
    own = protocol.candidate_gates(scores(spark, sf_dir))
    return own.select("fold", "formula_id", F.array_join("reasons", ",").alias("reasons"), "eligible")


@query("select_candidate", f"{SCORES} SELECT fold, formula_id, sign, eligible, {V} FROM chosen")
def select_candidate(spark, sf_dir):
    own = protocol.select_candidate(protocol.candidate_gates(scores(spark, sf_dir)))
    return rounded(own.select("fold", "formula_id", "sign", "eligible", *VALUES), *VALUES)


def trials(spark, sf_dir):
    """A trial per candidate and fold: excess returns of its sessions in the test range, a hundredth each."""
    own = pf.excess(daily(spark, sf_dir), pf.equal_weight_benchmark(tradable(spark, sf_dir)))
    r = F.broadcast(sound(spark, sf_dir).select("fold", "test_start", "test_end"))
    own = own.join(r, (F.col("sess") >= F.col("test_start")) & (F.col("sess") < F.col("test_end")))
    return own.select(F.col("formula_id").alias("candidate"), "fold", "sess", (F.col("excess") / 100).alias("excess"), (F.col("net") / 100).alias("net"), "turnover")


TRIALS = f"{BOOK}, {RANGES}, tl AS (SELECT formula_id AS candidate, fold, sess, (net - bench) / 100 AS excess, net / 100 AS net, turnover FROM daily JOIN bench USING (sess) JOIN ranges ON NOT broken AND sess >= test_start AND sess < test_end), rows_ AS (SELECT candidate, fold, avg(net) AS net, avg(turnover) AS turnover, avg(excess) / stddev_samp(excess) AS sharpe FROM tl GROUP BY 1, 2)"


def trial_rows(spark, sf_dir):
    return trials(spark, sf_dir).groupBy("candidate", "fold").agg(F.avg("net").alias("net"), F.avg("turnover").alias("turnover"), F.try_divide(F.avg("excess"), F.stddev_samp("excess")).alias("sharpe"))


def side_rows(spark, sf_dir, books):
    """:func:`trial_rows` of the books of both sides."""
    own = pf.excess(books, pf.equal_weight_benchmark(tradable(spark, sf_dir)))
    r = F.broadcast(sound(spark, sf_dir).select("fold", "test_start", "test_end"))
    own = own.join(r, (F.col("sess") >= F.col("test_start")) & (F.col("sess") < F.col("test_end")))
    return own.groupBy("fold", "formula_id", "sign").agg(*((F.avg(c) / 100).alias(c) for c in ("gross", "cost", "net")), F.avg("turnover").alias("turnover"), F.try_divide(F.avg("excess"), F.stddev_samp("excess")).alias("sharpe"))


@query("search_rows", f"{SCORES}, rows2 AS (SELECT formula_id, fold, avg(net) / 100 AS net, avg(net - bench) / stddev_samp(net - bench) AS sharpe FROM daily2 JOIN bench USING (sess) JOIN ranges ON NOT broken AND sess >= test_start AND sess < test_end GROUP BY 1, 2) SELECT c.fold, c.formula_id, c.sign, round(net, 6) + 0.0 AS net, round(sharpe, 6) + 0.0 AS sharpe FROM chosen c JOIN rows2 r ON r.fold = c.fold AND r.formula_id = c.formula_id || '|' || c.sign")
def search_rows(spark, sf_dir):
    """The selected candidates of each fold, traded out of sample on their chosen side."""
    best = protocol.select_candidate(protocol.candidate_gates(scores(spark, sf_dir))).select("fold", "formula_id", "sign")
    out = best.join(side_rows(spark, sf_dir, two_books(spark, sf_dir)), ["fold", "formula_id", "sign"])
    return rounded(out.select("fold", "formula_id", "sign", "net", "sharpe"), "net", "sharpe")


@query("benchmark_rows", f"{BOOK}, {RANGES} SELECT fold, count(*) AS n, round(avg(bench), 6) + 0.0 AS mean, round(stddev_samp(bench), 6) + 0.0 AS sd FROM bench JOIN ranges ON NOT broken AND sess >= test_start AND sess < test_end GROUP BY 1")
def benchmark_rows(spark, sf_dir):
    r = F.broadcast(sound(spark, sf_dir).select("fold", "test_start", "test_end"))
    own = pf.equal_weight_benchmark(tradable(spark, sf_dir)).join(r, (F.col("sess") >= F.col("test_start")) & (F.col("sess") < F.col("test_end")))
    return rounded(own.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("bench").alias("mean"), F.stddev_samp("bench").alias("sd")), "mean", "sd")


def scored_wide(spark, sf_dir, wide, names, penalty=None, standardised=True):
    """Gated scores of the candidates whose signals are the columns ``names`` of ``wide``, the books of both their sides and their coefficients.

    A signal without spread in the training range has no score and is rejected. What is written are a session's figures and its picks.
    """
    path = scratch(spark, "figures")
    protocol.session_figures(wide, names, N, MIN_STOCKS, standardised).write.parquet(path)
    figures = spark.read.parquet(path)
    whole = figures.where("sign = 0")
    ics = whole.where("n > 0").select("formula_id", "sess", "ic")
    picks = figures.where("sign <> 0").select(F.struct("formula_id", "sign").alias("formula_id"), "sym", F.col("sess").alias("dt"), "sess", "fwd")
    path = scratch(spark, "books")
    pf.topn_returns(pf.target_weights(picks, N), last_session(spark, sf_dir)).select("formula_id.*", "sess", "gross", "cost", "net", "turnover").write.parquet(path)
    books = spark.read.parquet(path)
    flat = protocol.flat_figures(figures, sound(spark, sf_dir))
    cut = None if penalty is None else spark.createDataFrame(list(penalty.items()), "formula_id string, penalty double")
    first = whole.where("sym is not null").select("formula_id", "sess", "sym", F.lit(True).alias("elig"), "signal")
    made = protocol.score_candidates(ics, books.select("formula_id", "sign", "sess", "cost"), protocol.validation_windows(sound(spark, sf_dir)), penalty=cut, flat=flat, ranges=sound(spark, sf_dir), signals=first)
    return protocol.candidate_gates(made).drop("flat", "invalid"), books, ics


BROKEN = SCORES[SCORES.index("\n  UNION ALL SELECT DISTINCT fold, 'broken'") : SCORES.index("),\ngated AS")]


def scores_of(signals: str, penalty: float) -> str:
    """:data:`SCORES` over other ``signals``, each with the same penalty, none malformed."""
    return SCORES.replace(SIGNALS, signals, 1).replace(BROKEN, "").replace("CASE formula_id WHEN 'plain' THEN 0.02 ELSE 0 END AS cut", f"{penalty} AS cut")


BASELINES = scores_of(f"{LONG}, signals AS MATERIALIZED (SELECT factor_name AS formula_id, sym, dt, elig, value AS signal FROM z)", 0.02)
OUTCOME = ("val_reward", "val_icir", "test_ic", "gross", "cost", "net", "turnover", "sharpe")


@query("baseline_rows", f"""{BASELINES},
rows2 AS (SELECT formula_id AS side, fold, avg(gross) / 100 AS gross, avg(cost) / 100 AS cost, avg(net) / 100 AS net, avg(turnover) AS turnover, avg(net - bench) / nullif(stddev_samp(net - bench), 0) AS sharpe FROM daily2 JOIN bench USING (sess) JOIN ranges ON NOT broken AND sess >= test_start AND sess < test_end GROUP BY 1, 2),
test AS (SELECT fold, formula_id, avg(ic) AS ic FROM ic JOIN axis USING (dt) JOIN ranges ON NOT broken AND sess >= test_start AND sess < test_end GROUP BY 1, 2),
whole AS (SELECT g.fold, g.formula_id, sign AS direction, val_reward, val_icir, eligible, reasons, sign * test.ic AS test_ic, gross, cost, net, turnover, sharpe FROM gated g LEFT JOIN rows2 r ON r.fold = g.fold AND r.side = g.formula_id || '|' || sign LEFT JOIN test ON test.fold = g.fold AND test.formula_id = g.formula_id)
SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in OUTCOME)}) FROM whole""")  # fmt: skip
def baseline_rows(spark, sf_dir):
    """Every single factor, scored like any candidate on the validation windows and traded out of sample in its learned direction."""
    made, books, ics = scored_wide(spark, sf_dir, standard_wide(spark, sf_dir), EVERY, {n: 0.02 for n in EVERY})
    r = F.broadcast(sound(spark, sf_dir).select("fold", "test_start", "test_end"))
    test = ics.join(r, (F.col("sess") >= F.col("test_start")) & (F.col("sess") < F.col("test_end"))).groupBy("fold", "formula_id").agg(F.avg("ic").alias("test_ic"))
    out = made.join(side_rows(spark, sf_dir, books), ["fold", "formula_id", "sign"], "left").join(test, ["fold", "formula_id"], "left")
    out = out.select("fold", "formula_id", F.col("sign").alias("direction"), "val_reward", "val_icir", "eligible", F.array_join("reasons", ",").alias("reasons"), (F.col("sign") * F.col("test_ic")).alias("test_ic"), "gross", "cost", "net", "turnover", "sharpe")
    return rounded(out, *OUTCOME)


AGG = "count(*) AS n, median(v) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, min(v) AS low, max(v) AS high"


@query("aggregate_trials", f"{TRIALS}, lg AS (SELECT candidate, 'net' AS metric, net AS v FROM rows_ UNION ALL SELECT candidate, 'turnover', turnover FROM rows_ UNION ALL SELECT candidate, 'sharpe', sharpe FROM rows_), ag AS (SELECT candidate, metric, {AGG} FROM lg GROUP BY 1, 2) SELECT candidate, metric, n, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('median', 'q25', 'q75', 'low', 'high'))}, round(q75 - q25, 6) + 0.0 AS iqr FROM ag")
def aggregate_trials(spark, sf_dir):
    return rounded(protocol.aggregate_trials(trial_rows(spark, sf_dir), ["net", "turnover", "sharpe"]), "median", "q25", "q75", "low", "high", "iqr")


@query("top_trial", f"{TRIALS} SELECT candidate, fold, round(sharpe, 6) + 0.0 AS sharpe FROM rows_ ORDER BY round(rows_.sharpe, 9) DESC, candidate DESC, fold DESC LIMIT 1")
def top_trial(spark, sf_dir):
    return rounded(protocol.top_trial(trial_rows(spark, sf_dir).withColumn("sharpe", F.round("sharpe", 9)).withColumn("failed", F.lit(False))), "sharpe")


MOMENTS = f"{TRIALS}, c0 AS (SELECT candidate, fold, excess, avg(excess) OVER q AS m, stddev_samp(excess) OVER q AS s FROM tl WINDOW q AS (PARTITION BY candidate, fold)), mo AS (SELECT candidate, fold, any_value(m / s) AS sr, avg(pow(excess - m, 3)) / pow(any_value(s), 3) AS skew, avg(pow(excess - m, 4)) / pow(any_value(s), 4) AS kurt, count(*)::DOUBLE AS t FROM c0 GROUP BY 1, 2)"


@query("trial_moments", f"{MOMENTS} SELECT candidate, fold, round(sr, 6) + 0.0 AS sr, round(skew, 6) + 0.0 AS skew, round(kurt, 6) + 0.0 AS kurt, t FROM mo")
def trial_moments(spark, sf_dir):
    return rounded(protocol.trial_moments(trials(spark, sf_dir)), "sr", "skew", "kurt")


def cdf_sql(x: str) -> str:
    """The normal distribution by its power series, whose terms are x^(2k+1) / (1 3 5 ... (2k+1))."""
    terms = f"list_sum(list_transform(range(0, 90), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    return f"(0.5 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {terms})"


@query("psr", f"{MOMENTS}, x AS (SELECT candidate, fold, sr * sqrt(t - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS x FROM mo) SELECT candidate, fold, round(CASE WHEN abs(x) > 8 THEN (x > 0)::INT ELSE {cdf_sql('x')} END, 6) + 0.0 AS psr FROM x")
def psr(spark, sf_dir):
    own = protocol.trial_moments(trials(spark, sf_dir))
    return own.select("candidate", "fold", digits(protocol.psr(F.lit(0.0))).alias("psr"))


#: The best of n trials without skill, with the inverse of the normal distribution by bisection.
BEST = f"""{MOMENTS.replace("WITH ", "WITH RECURSIVE ", 1)}, nn AS (SELECT count(*)::DOUBLE AS n FROM mo),
inv AS (SELECT which, p, -9.0::DOUBLE AS lo, 9.0::DOUBLE AS hi, 0 AS k FROM (SELECT 1 AS which, 1 - 1 / n AS p FROM nn UNION ALL SELECT 2, 1 - 1 / (n * exp(1)) FROM nn)
  UNION ALL SELECT which, p, CASE WHEN {cdf_sql('mid')} < p THEN mid ELSE lo END, CASE WHEN {cdf_sql('mid')} < p THEN hi ELSE mid END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS mid FROM inv WHERE k < 60)),
zz AS (SELECT sum(CASE which WHEN 1 THEN 1 - 0.5772156649015329 ELSE 0.5772156649015329 END * (lo + hi) / 2) AS z FROM inv WHERE k = 60),
em AS (SELECT mo.*, n, CASE WHEN n > 1 THEN sqrt(1 / (t - 1)) * z ELSE 0 END AS benchmark FROM mo, nn, zz)"""


@query("expected_max_sr", f"{BEST} SELECT candidate, fold, round(benchmark, 6) + 0.0 AS benchmark FROM em")
def expected_max_sr(spark, sf_dir):
    own = protocol.trial_moments(trials(spark, sf_dir))
    n = F.broadcast(own.agg(F.count(F.lit(1)).cast("double").alias("n")))
    return own.crossJoin(n).select("candidate", "fold", digits(protocol.expected_max_sr(F.col("n"))).alias("benchmark"))


@query("deflated_sharpe", f"{BEST}, top AS (SELECT *, (sr - benchmark) * sqrt(t - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS x FROM em ORDER BY sr DESC, candidate, fold LIMIT 1) SELECT candidate, fold, n AS n_trials, round(sr, 6) + 0.0 AS sr, round({cdf_sql('x')}, 6) + 0.0 AS dsr FROM top")
def deflated_sharpe(spark, sf_dir):
    own = protocol.deflated_sharpe(protocol.trial_moments(trials(spark, sf_dir)))
    return rounded(own.select("candidate", "fold", "n_trials", "sr", "dsr"), "sr", "dsr")


@query("max_t_bootstrap")
def max_t_bootstrap(spark, sf_dir):
    return rounded(protocol.max_t_bootstrap(trials(spark, sf_dir)), "observed", "p_value")


@query("noise_selfcheck")
def noise_selfcheck(spark, sf_dir):
    """Noise signals through the same path; their best must not be significant."""
    own = panel.standard(spark, sf_dir)
    noise = None
    for k in range(5):
        one = own.select(F.lit(f"noise{k}").alias("formula_id"), "sym", "dt", "elig", ((F.pmod(F.xxhash64("sym", "dt", F.lit(k)), F.lit(1_000_003))) / 1_000_003).alias("signal"))
        noise = one if noise is None else noise.unionByName(one)
    cells = tradable(spark, sf_dir)
    book = pf.target_weights(pf.top_n(pf.selectable(noise, cells), 5), 5)
    made = pf.excess(pf.topn_returns(book, axis(spark, sf_dir).agg(F.max("sess")).first()[0], pf.Costs(0, 0, 0, 0, 0)), pf.equal_weight_benchmark(cells))
    series = made.select(F.col("formula_id").alias("candidate"), F.lit(0).alias("fold"), "sess", "excess")
    return rounded(protocol.max_t_bootstrap(series, 1000), "observed", "p_value")


@query("merge_prior_trials", f"{TRIALS} SELECT pool, count(*) AS n, round(sum(net), 5) + 0.0 AS net FROM (SELECT 'current' AS pool, net FROM rows_ UNION ALL SELECT 'prior', NULL FROM rows_ WHERE fold = 1) GROUP BY 1")
def merge_prior_trials(spark, sf_dir):
    own = trial_rows(spark, sf_dir)
    both = protocol.merge_prior_trials(own, own.where("fold = 1").select("candidate", "fold", "sharpe"))
    return both.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), digits(F.sum("net"), 5).alias("net"))


#: Each feature with the seventh after it: every feature is in two candidates.
PAIRED = {f"{a}+{b}": [a, b, "ADD"] for a, b in zip(EVERY, EVERY[7:] + EVERY[:7], strict=True)}
ABLATED = scores_of(
    f"""{LONG}, {FAM}, cds AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{t[0]}', '{t[1]}')" for k, t in PAIRED.items())}) c(candidate, a, b)),
less AS (SELECT 'none' AS family, * FROM cds UNION SELECT family, cds.* FROM cds JOIN fam ON factor_name IN (a, b)),
u AS (SELECT c.family || '|' || candidate AS formula_id, x.sym, x.dt, x.elig, CASE WHEN fx.family = c.family THEN 0 ELSE x.value END + CASE WHEN fy.family = c.family THEN 0 ELSE y.value END AS v
  FROM less c JOIN fam fx ON fx.factor_name = a JOIN fam fy ON fy.factor_name = b JOIN z x ON x.factor_name = a JOIN z y ON y.factor_name = b AND y.sym = x.sym AND y.dt = x.dt),
signals AS MATERIALIZED ({SIGNALS[SIGNALS.index("signals AS (") + len("signals AS ("):]}""",
    0,
)


@query("family_ablation", f"""{ABLATED},
made AS (SELECT fold, split_part(formula_id, '|', 1) AS family, split_part(formula_id, '|', 2) AS candidate, val_reward, val_icir, eligible FROM gated),
own AS (SELECT b.fold, f.family, b.candidate, b.eligible AS was, b.val_reward AS base, CASE WHEN m.fold IS NULL THEN b ELSE m END AS v FROM made b CROSS JOIN (SELECT DISTINCT family FROM fam) f LEFT JOIN made m ON m.fold = b.fold AND m.candidate = b.candidate AND m.family = f.family WHERE b.family = 'none')
SELECT fold, family, candidate, round(v.val_reward, 6) + 0.0 AS val_reward, round(v.val_icir, 6) + 0.0 AS val_icir, was, v.eligible AS eligible, round(base - v.val_reward, 6) + 0.0 AS loss FROM own""")  # fmt: skip
def family_ablation(spark, sf_dir):
    """Per fold, family and candidate: the loss of validation reward when the family's features are made neutral."""
    ablated = formula.ablated(PAIRED, {n: lib.REGISTRY[n].family for n in EVERY}, "NEUTRAL")
    plain = {k: formula.without_zero(t, "NEUTRAL") for k, t in ablated.items()}
    name_of = {}  # candidates with the same signal are scored once
    for k, t in plain.items():
        name_of.setdefault(tuple(t), k)
    wide = formula.formula_values(standard_wide(spark, sf_dir).withColumn("NEUTRAL", F.lit(0.0)), {k: list(t) for t, k in name_of.items()}, [*EVERY, "NEUTRAL"], ["sym", "sess", "elig", "_fwd", "_ok"])
    made, _, _ = scored_wide(spark, sf_dir, wide, list(name_of.values()), standardised=False)
    alias = F.broadcast(spark.createDataFrame([(k, name_of[tuple(t)]) for k, t in plain.items()], "name string, formula_id string"))
    made = made.join(alias, "formula_id").drop("formula_id").withColumnRenamed("name", "formula_id")
    out = protocol.family_ablation(made, all_families(spark).select("family"))
    return rounded(out, "val_reward", "val_icir", "loss")


def hits() -> dict:
    """A scorer in columns: the share of positive coefficients above a half, the cost taken off."""
    share = F.avg((F.round("ic", 9) > 0).cast("double")) - 0.5
    return {"reward": share - F.coalesce(F.avg("cost"), F.lit(0.0)), "icir": share}


def middle(rows) -> dict:
    """A scorer over a window's rows: the median coefficient, and as reward that of the window's later half."""
    import numpy as np

    ic = rows.column("ic").to_numpy()
    own, late = (float(np.median(v[~np.isnan(v)])) if (~np.isnan(v)).any() else None for v in (ic, ic[len(ic) // 2 :]))
    return {"reward": late, "icir": own}


HITS = "avg((round(ic, 9) > 0)::INT) - 0.5"
LATE = "median(ic) FILTER (half)"
CHOICE = f"fold, formula_id, sign, eligible, {V}"
BY_HALVES = by_scorer("median(ic)", LATE).replace("FROM sided JOIN spans ON sess >= lo AND sess < hi GROUP BY 1, 2, 3, 4", """FROM (SELECT *, row_number() OVER w > count(*) OVER (PARTITION BY fold, formula_id, sign, "window") // 2 AS half
  FROM sided JOIN spans ON sess >= lo AND sess < hi WINDOW w AS (PARTITION BY fold, formula_id, sign, "window" ORDER BY sess)) GROUP BY 1, 2, 3, 4""")


@query("custom_score", f"""WITH a AS ({by_scorer(HITS, f"{HITS} - coalesce(avg(cost), 0)")} SELECT 'hits' AS scorer, {CHOICE} FROM chosen),
b AS ({BY_HALVES} SELECT 'middle' AS scorer, {CHOICE} FROM chosen)
SELECT * FROM a UNION ALL SELECT * FROM b""")  # fmt: skip
def custom_score(spark, sf_dir):
    """Scorers of the caller's own, one in columns and one over rows, for both signs and through gates and selection."""
    out = None
    for name, scorer, grouped in (("hits", hits, False), ("middle", middle, True)):
        own = protocol.select_candidate(protocol.candidate_gates(scores(spark, sf_dir, scorer, grouped))).select(F.lit(name).alias("scorer"), "fold", "formula_id", "sign", "eligible", *VALUES)
        out = own if out is None else out.unionByName(own)
    return rounded(out, *VALUES)


@query("register_factor", f"WITH {HELPERS} SELECT sym, dt::VARCHAR AS dt, round(1 - low / high, 6) + 0.0 AS value FROM h")
def register_factor(spark, sf_dir):
    """A factor of the caller's own, in a table of its own, used by name."""
    own = dict(lib.REGISTRY)
    lib.register_factor("RANGE_SHARE", "volume", "high low", lambda: F.try_divide(F.col("high") - F.col("low"), F.col("high")), own)
    return lib.factors(panel.standard(spark, sf_dir), ["RANGE_SHARE"], own).select("sym", "dt", digits(F.col("RANGE_SHARE")).alias("value"))


@query("register_operator", f"{F_SQL} SELECT sym, dt::VARCHAR AS dt, round(CASE WHEN count(CASE WHEN elig THEN x END) OVER q = 0 THEN 0 WHEN elig THEN (x / 2 - avg(CASE WHEN elig THEN x / 2 END) OVER q) / (stddev_pop(CASE WHEN elig THEN x / 2 END) OVER q + 1e-6) END, 6) + 0.0 AS signal FROM f WINDOW q AS (PARTITION BY dt)")
def register_operator(spark, sf_dir):
    """An operator of the caller's own, used in a formula."""
    own = dict(formula.OPERATORS)
    formula.register_operator("HALF", 1, "row", lambda x: F.col(x) / 2, own)
    made = formula.formula_signal(inputs(spark, sf_dir), {"half": ["x", "HALF"]}, ["x", "y", "z"], own)
    return made.select("sym", "dt", digits(F.col("signal")).alias("signal"))


@query("ewm", by_day(f"{EWM} SELECT sym, dt::VARCHAR AS dt, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in EWM_NAMES)} FROM ew"))
def ewm(spark, sf_dir):
    own = lib.factors(panel.standard(spark, sf_dir, daily=True), list(lib.EWM))
    return own.select("sym", "dt", *(digits(F.col(n)).alias(n) for n in lib.EWM))


@query("normal_cdf", f"{LONG} SELECT sym, dt::VARCHAR AS dt, factor_name, round({cdf_sql('value')}, 6) + 0.0 AS p FROM z")
def normal_cdf(spark, sf_dir):
    """The normal distribution at standardised factor values."""
    own = all_standard(spark, sf_dir)
    return own.select("sym", "dt", "factor_name", digits(protocol.normal_cdf(F.col("value"))).alias("p"))


@query("normal_ppf", f"{LONG} SELECT sym, dt::VARCHAR AS dt, factor_name, round(value, 5) + 0.0 AS z FROM z")
def normal_ppf(spark, sf_dir):
    """Normal scores: the quantile of each value's share of the distribution gives the value back."""
    own = all_standard(spark, sf_dir).withColumn("p", protocol.normal_cdf(F.col("value")))
    return own.select("sym", "dt", "factor_name", digits(protocol.normal_ppf(F.col("p")), 5).alias("z"))
