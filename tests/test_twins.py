"""Registered queries against their SQL twins on the smallest tables.

A spread of queries runs by default; WAGERFRAME_ALL=1 runs every one.
"""

import os

import pytest
from compare import compare, connect

from wagerframe.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "explode_options_json", "nest_options", "lottery_merge", "best_sets", "lottery_text", "dominance_flags", "label_arrays",
    "policy_metrics_by_field", "progress_by_field", "failure_sample", "pair_metrics_by_subset", "held_out_preparation",
    "pair_audit_report", "clean_pairs", "best_of_n_metrics", "ties_metrics", "mcq_accuracy", "run_ledger_overlay",
    "mean_difference_vectors", "deficit_schedule", "spread_situations", "two_pool_mix", "exact_rows_whole_situations",
    "compositions", "generated_integrity", "generated_prompts_read_back", "label_lists", "reasoning_format_summary",
    "stream_running_metrics", "options_with_prompts", "stale_labels", "subjects_by_accuracy", "mcq_of_subjects", "sft_examples_in_order",
    "stream_policy_by_run", "transfer_prompts_read_back", "generated_transfer_low", "quota_until_filled", "generated_until_quota",
    "long_answer_strategies", "capped_rows_whole_situations", "nearest_row_totals", "mix_sizes_by_percent", "csv_round_trip",
    "csv_typed", "json_rows_round_trip", "run_results_round_trip", "published_versions", "best_of_items", "catalog_datasets",
    "resume_differences", "complete_runs", "stale_flags", "stored_results", "cot_examples_in_order", "sampled_ids",
    "json_list_in_splits", "run_lookup", "stream_once_per_key", "drop_bad_situations",
]
NAMES = list(catalogue.queries()) if os.environ.get("WAGERFRAME_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    problem, _, _ = compare(spark, con, FOLDER, catalogue.queries()[name], catalogue.twins().get(name))
    assert problem is None, problem


def test_twins_belong_to_queries():
    assert set(catalogue.twins()) <= set(catalogue.queries())
