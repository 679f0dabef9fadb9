"""A spread of registered queries beside their SQL on the smallest tables."""

import os

import pytest

from compare_oracle import compare, connect
from marginalia.plans import registry

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
NAMES = [
    "f01_clean_text", "f18_entity_signals", "n01_n07_intents", "p01_readable_files", "g09_tag_closure",
    "a03_a05_online_summary", "n10_metric_trend", "f11_c03_block_quality", "a11_c04_parent_chunks", "c01_packed_chunks",
    "w07_page_routing", "r02_bm25", "r11_hybrid_search", "g02_j16_edges", "g04_shortest_paths", "c07_w05_schedule_blocks",
    "j15_drawing_edges", "w13_memory", "n04_x03_experience_items", "m11_stream_monitor",
    "c08_structure_commits", "j14_weak_match", "g11_nested_tree", "a04_sketch_rollup", "a06_intent_rollup", "m04_dead_letters",
    "m09_stream_sessions", "u03_supplement", "a19_compare_answer", "a20_chunk_preview",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, connect(SF), name, registry.queries()[name], registry.oracle_sql().get(name), SF)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
