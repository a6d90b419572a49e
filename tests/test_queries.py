"""A query of each family against its SQL twin over the smallest tables (the driver compares all of them)."""

import pytest
from conftest import SMALL, same_rows

from plumbline.plans import catalog

NAMES = ["score_folds", "spearman", "kendall", "bootstrap_ci", "hard_easy", "compare_columns", "validated_join", "profile", "text_norm", "overlap_partition", "reconcile_censored", "best_threshold",
         "child_aggs", "moment_tensor", "sim_join", "cosine_pairs", "nn_loo", "coupled_groups", "partition_agreement", "screen_split", "kde_weights", "rm_anova", "holm", "bh", "resid_corr", "subset_average", "greedy_z_first_step", "population_solve", "offset_opt", "ols_recal", "rank_z", "stream_epochs"]


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, oracle, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), oracle(catalog.ORACLES[name]))


def test_entry_and_registry():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert len(q) > 150 and set(o) <= set(q)
