"""A sample of the queries against their SQL on the smallest tables; oracle_check.py runs all of them at any size."""

import pytest

from oracle_check import TABLES, compare
from paperflow.plans import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = ["m1_explode_webhooks", "m2_classify_inbound", "m9_fold_delivery", "m9_fold_delivery_stream", "m14_group_pages", "m14_group_pages_stream", "n1_normalize_fields", "p2_detect_section", "p10_visit_columns",
         "n12_read_values", "d2_assemble_drafts", "d3_merge_readings", "d8_check_conception", "v3_validate_field_values", "r1_fold_reviews", "r1_corrections", "r9_fold_retakes", "r12_move_pages", "l1_candidates", "l8_upsert_visits",
         "e9_export_rows", "q10_outcome_counts", "s1_s6_registry_csv", "s2_read_drafts", "s7_sync_registered",
         "m13_dedup_messages_stream", "s7_sync_log", "s8_flush_outbox", "r12_move_sequence", "r12_moved_pages", "l8_whole_documents", "l11_assign_ids", "q12_timing_stats", "q18_ink_distribution", "r8_key_reviews", "r19_visit_grid",
         "p14_single_boxes", "p14_choice_boxes", "p18_failed_pages", "p20_cell_sources", "n12_grid_fields"]


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    line = compare(spark, con, name, QUERIES[name], ORACLE[name], FOLDER)
    assert line.startswith("ok"), line


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
