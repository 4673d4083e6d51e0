"""Registered queries against their reference SQL."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

QUICK = (
    "c1_case_number c2_court c3_bench c4_judgment_date c6_parties_by_layout c8_departments c10_counsel_across_pages "
    "c12_final_disposition_by_layout c13_legal_phrases c14_sentences c15_directions open_actions_by_owner h1_directions_to_actions "
    "h7_action_quality_gate h9_prune_background_actions b5_text_quality b12_page_windows i2_search i2_search_documents e5_cite_evidence "
    "e1_exact_duplicates e2_replay_candidate e3_near_duplicates a7_upsert_documents a16_response_cache j6_apply_reviews j7_dashboard_projection "
    "b4_filter_dashboard j2_score_actions f6_accuracy_summary f8_stage_totals f9_llm_timing_summary e10_fuse_sources h13_payload_to_candidates "
    "i8_answer_questions k1_request_rate k3_latest_state k4_job_progress"
).split()


def pytest_generate_tests(metafunc):
    names = list(entry.queries()) if metafunc.config.getoption("--all-queries") else QUICK
    metafunc.parametrize("name", names)


@pytest.fixture(scope="module")
def con(request):
    return duck(request.config.getoption("--sf"))


def test_query(spark, con, name, request):
    ok, note, _ = compare(spark, con, name, request.config.getoption("--sf"), entry.queries(), entry.oracle_sql())
    assert ok, note
