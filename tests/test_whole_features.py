"""Queries over all features of the registry."""

import numpy as np

import __spark_entry__ as entry
from panelforge.operators import quality
from panelforge.plans import panel_queries as pq


def test_report_and_correlations_have_every_feature(spark, sf_dir):
    n = len(pq.EVERY)
    report = {r.factor_name: r for r in entry.queries()["factor_report"](spark, sf_dir).collect()}
    assert len(report) == n == 62 and report["BETA_60"].coverage > 0 and report["PE_TTM"].coverage > 0 and report["MARGIN_BALANCE_CHG"].family
    matrix = {(r.a, r.b): r["corr"] for r in entry.queries()["factor_corr_matrix"](spark, sf_dir).collect()}
    assert len(matrix) == n * (n - 1) // 2 and any(matrix.values())


def test_features_are_made_once(spark, sf_dir):
    first, again = (pq.all_standard(spark, sf_dir).inputFiles() for _ in range(2))
    assert first == again


def test_correlations_with_missing_features(spark):
    t = spark.createDataFrame([(f"s{k}", "2020-01-01", True, f, float(v)) for k, vs in enumerate([(1, 2), (2, 1), (3, 5), (4, None)]) for f, v in zip("ab", vs) if v is not None], "sym string, dt string, elig boolean, factor_name string, value double")
    assert abs(quality.factor_corr(t).first()["corr"] - abs(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])) < 1e-9
