"""Keys and numbers as large tables have them, on small tables."""

import shutil

import pytest

from oracle_check import TABLES, compare
from paperflow.plans import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def check(spark, folder, names, **tables):
    """The queries against their SQL on the smallest tables, of which some are replaced by SQL over the others."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW small_{t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for t in TABLES:
        if t in tables:
            con.execute(f"COPY ({tables[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            shutil.copy(f"{SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in names:
        line = compare(spark, con, name, QUERIES[name], ORACLE[name], str(folder))
        assert line.startswith("ok"), line


def test_ids_of_ten_digits(spark, tmp_path):
    # 1000 key + copy has ten digits, of which the SQL shows nine.
    check(spark, tmp_path, ["e8_latest_extended", "e9_export_rows", "e10_coverage", "s1_s6_registry_csv"],
          orders="SELECT * REPLACE (o_orderkey * 7 + 999000 AS o_orderkey) FROM small_orders", lineitem="SELECT * REPLACE (l_orderkey * 7 + 999000 AS l_orderkey) FROM small_lineitem")


def test_more_than_a_million_ids(spark, tmp_path):
    check(spark, tmp_path, ["l11_assign_ids"], orders="SELECT i AS o_orderkey, 1::BIGINT AS o_custkey, 'O' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '2000-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority FROM (SELECT unnest(range(1000001)) AS i)")


def test_balances_around_zero(spark, tmp_path):
    check(spark, tmp_path, ["n6_decimal"], customer="SELECT * REPLACE ([-0.0::DOUBLE, 0.0, -0.004, -0.01, 0.04, 0.05, 0.95, -999.99][c_custkey % 8 + 1] AS c_acctbal) FROM small_customer")


def test_new_documents_meet_stored_ones(spark, tmp_path):
    # Documents from 1,000,000 on are stored already when moves ask for new ones.
    check(spark, tmp_path, ["r12_move_sequence", "r12_moved_pages"], events="SELECT * REPLACE (CASE WHEN event_id >= 500 THEN event_id + 2999500 ELSE event_id END AS event_id) FROM small_events")


def test_arrivals_of_a_slice_in_several_files(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from paperflow.plans import files
    from paperflow.scale import shared_folder

    monkeypatch.setattr(files, "ARRIVALS_PER_FILE", 100)
    before = set(Path(shared_folder(spark)).glob("registered-*"))
    check(spark, tmp_path, ["s7_sync_log"])
    folder, = set(Path(shared_folder(spark)).glob("registered-*")) - before
    assert len(list(folder.glob("*.parquet"))) > 2
