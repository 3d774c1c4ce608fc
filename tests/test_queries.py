"""Queries against their SQL on the smallest tables; tools/compare.py runs all of them at any scale."""

import compare
import pytest

import __spark_entry__ as entry
from wordmill.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "apply_swap", "apply_swap_pairs", "save_map", "swap_freq_diff", "swap_rank", "swap_rotate", "swap_mutual", "swap_greedy_benchmark", "swap_lemma_benchmark",
    "swap_greedy_lemma_benchmark", "permute_rows", "basic_tokens", "bow_classifier", "bow_pairs", "bucket_coverage", "bucket_lift", "build_pair_inputs",
    "classification_report", "coarse_buckets", "cosine_pairs", "doc_freq", "downsample_min", "mask_tokens", "pair_bow",
    "parse_run_names", "probe_rows", "random_baseline", "read_splits", "scramble_window_pairs", "span_report",
    "swap_nonsense", "swap_oov_similar", "swap_rank_by_pieces", "task_metrics_correlation", "tree_spans", "vocab_index",
]


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert compare.difference(got, con.execute(catalog.SQL[name]).df()) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 200
