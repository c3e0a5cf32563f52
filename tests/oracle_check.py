"""Compare every query with its SQL on the same tables: python tests/oracle_check.py [name ...] (SF_DIR names the folder)."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text_rows(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (not isinstance(v, (list, tuple, dict)) and not hasattr(v, "__len__") and pd.isna(v)):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return f"{float(v):.6g}" if float(v) != int(v) else str(int(v))
        return str(v)
    return sorted("|".join(cell(v) for v in row) for row in frame.itertuples(index=False))


def compare(spark, con, name, make, sql, folder):
    start = time.time()
    got = make(spark, folder).toPandas()
    spent = time.time() - start
    if sql is None:
        return f"rows  {name}: {len(got)} rows {spent:.1f}s"
    start = time.time()
    want = con.sql(sql).df()
    sql_time = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL  {name}: columns {sorted(got.columns)} vs {sorted(want.columns)}"
    types = [f"{c}:{got[c].dtype}/{want[c].dtype}" for c in got.columns if got[c].dtype != want[c].dtype]
    a, b = text_rows(got), text_rows(want)
    if a != b:
        left, right = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"FAIL  {name}: {len(a)} vs {len(b)} rows; spark {left}; sql {right}"
    return f"ok    {name}: {len(a)} rows {spent:.1f}s (sql {sql_time:.1f}s) {' '.join(types)}"


def main() -> int:
    import duckdb

    from paperflow.plans import ORACLE, QUERIES
    from paperflow.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con, failed = local_session(), duckdb.connect(), 0
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    wanted = sys.argv[1:]
    for name, make in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            line = compare(spark, con, name, make, ORACLE.get(name), folder)
        except Exception as e:  # noqa: BLE001
            line = f"ERROR {name}: {type(e).__name__} {str(e)[:600]}"
        failed += not line.startswith(("ok", "rows"))
        print(line, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
