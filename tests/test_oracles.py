"""Queries beside their SQL on the smallest tables."""

import pytest
from compare import compare

from arbora.plans import data_queries, graph_queries

FAST = [
    *data_queries.QUERIES,
    *"users_with_profile search_users common_following_all mutual_pairs user_profile degree_dist graph_counts min_incoming_degree suggest_all_candidates suggest all_paths route_fuzzy path_directed_edges wcc".split(),
    *"queue_claim queue_preview status_snapshot hub_defer pending_insert edge_upsert edge_history_delta edges_as_of insert_users crawl_step_done crawl_step_queued crawl_step_users export_edges".split(),
    *"fmt_uptime bar thresholds truncate file_size number_texts quota_reset export_json crawl_step_state common_following stream_event_counts stream_dedup_enqueue ring_buffer_latest".split(),
]


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, data, name):
    module = data_queries if name in data_queries.QUERIES else graph_queries
    ok, said = compare(spark, module.QUERIES[name], module.ORACLES[name], data)
    assert ok, said


def test_every_oracle_has_a_query():
    for module in (data_queries, graph_queries):
        assert set(module.ORACLES) <= set(module.QUERIES)
