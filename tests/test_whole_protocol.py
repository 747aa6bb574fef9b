"""Baselines and ablations by the same path as candidates."""

from collections import defaultdict

from panelforge.functions import formula
from panelforge.plans import panel_queries as pq
from test_whole_job import duck, equal  # noqa: F401


def test_baselines_are_scored_and_traded(spark, sf_dir, duck):  # noqa: F811
    got = equal(spark, sf_dir, duck, "baseline_rows")
    assert {r.formula_id for r in got} == set(pq.EVERY) and len(got) == len(pq.EVERY) * len({r.fold for r in got})
    assert all((r.val_reward is None) == (r.reasons == "constant signal") and r.direction in (1, -1) for r in got)
    assert all(abs(r.gross - r.cost - r.net) < 3e-6 for r in got if r.net is not None) and any(r.cost > 0 for r in got)
    assert all(not r.eligible and r.reasons == "constant signal" for r in got if r.formula_id == "NORTHBOUND_CHG")


def test_ablation_leaves_other_candidates_alone(spark, sf_dir, duck):  # noqa: F811
    got = equal(spark, sf_dir, duck, "family_ablation")
    by = defaultdict(list)
    for r in got:
        used = {pq.lib.REGISTRY[n].family for n in r.candidate.split("+")}
        by[r.family in used].append(r.loss)
    families = {f.family for f in pq.lib.REGISTRY.values()}
    assert {r.family for r in got} >= families - {"caller"} and all(x in (0, None) for x in by[False]) and any(x for x in by[True])
    assert {n for r in got for n in r.candidate.split("+")} == set(pq.EVERY)


def test_ablated_formulas():
    made = formula.ablated({"p": ["a", "b", "ADD"], "q": ["b", "NEG"]}, {"a": "x", "b": "y", "c": "x"}, "ZERO")
    assert made == {"none|p": ["a", "b", "ADD"], "x|p": ["ZERO", "b", "ADD"], "y|p": ["a", "ZERO", "ADD"], "none|q": ["b", "NEG"], "y|q": ["ZERO", "NEG"]}
