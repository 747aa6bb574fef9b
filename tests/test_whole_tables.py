"""No cap of rows and no fixed window in SQL that once had one; the queries run in ``test_queries``."""

import __spark_entry__ as entry


def test_no_caps():
    sql = entry.oracle_sql()
    assert "pos <= 5" not in sql["formula_remap"] and "70, 81" not in sql["reward_val_median"]
    assert all("BETA_60" in sql[k] for k in ("factor_long", "factor_panel", "winsor_robust_z", "ic_stats", "coverage", "factor_corr_matrix", "normal_cdf", "normal_ppf", "feature_family", "ablate_family"))
