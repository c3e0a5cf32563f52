from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import cut_lineage, numbered
from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The input tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


COPY_ORDER = ["l_extendedprice", "l_partkey", "l_suppkey"]


class SheetTables(Tables):
    """Tables in which an order's lines are documents without repeated line numbers.

    The test data holds several lines of one (order, line number). Each further one belongs to a further document of its
    order, so that every line is used: document n of order k has the key 1000 k + n - 1.
    """

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ("lineitem", "orders"):
            return super().__getattr__(name)
        if "_copies" not in self.__dict__:  # numbered once for all uses within a query, whichever they are
            lines = super().__getattr__("lineitem")
            self._copies = cut_lineage(numbered(lines, ["l_orderkey", "l_linenumber"], COPY_ORDER, F.floor(F.col("l_extendedprice") / 20_000), "_n"))
        copies = self._copies
        if name == "lineitem":
            return copies.withColumn("l_orderkey", F.col("l_orderkey") * 1000 + F.col("_n") - 1).drop("_n")
        orders, most = super().__getattr__("orders"), copies.groupBy("l_orderkey").agg(F.max("_n").alias("_n"))
        each = orders.join(most, orders["o_orderkey"] == most["l_orderkey"], "left").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1)).cast("long"))))
        return each.withColumn("o_orderkey", F.col("o_orderkey") * 1000 + F.col("_k") - 1).select(orders.columns)


SHEET_SQL = """sheet_copies AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) AS sheet FROM lineitem),
sheet_lines AS (SELECT * EXCLUDE (sheet) REPLACE (l_orderkey * 1000 + sheet - 1 AS l_orderkey) FROM sheet_copies),
sheet_orders AS (SELECT o.* REPLACE (o.o_orderkey * 1000 + n.sheet - 1 AS o_orderkey) FROM orders o
    JOIN (SELECT DISTINCT l_orderkey, sheet FROM sheet_copies UNION SELECT o_orderkey, 1 FROM orders) n ON n.l_orderkey = o.o_orderkey)"""


def sheets_sql(sql: str) -> str:
    """The same SQL over the documents of `SheetTables`; SQL taken over from another query may be so already."""
    if "sheet_copies AS" in sql:
        return sql
    body = re.sub(r"\borders\b", "sheet_orders", re.sub(r"\blineitem\b", "sheet_lines", sql.strip()))
    start = re.match(r"WITH( RECURSIVE)?\s+", body, re.IGNORECASE)
    return f"{start[0].strip()} {SHEET_SQL},\n{body[start.end():]}" if start else f"WITH {SHEET_SQL}\n{body}"


#: Queries on documents, fields or visits that are made of order lines.
SHEETS = set("""d1_flatten_fields d2_assemble_drafts d6_check_date_order d7_check_lmp d8_check_conception d8_apply_demotions
d11_match_page_sets s9_read_truth r1_fold_reviews r1_corrections r1_refused r2_blocking_items r3_document_status r13_discard_reviews
r16_queue_view r17_document_view r18_alerts r19_group_counts r19_visit_grid e2_mean_verified e3_earliest_verified e4_earliest_lab
e6_previous_cesarean e8_latest_extended e9_export_rows e10_coverage s1_s6_registry_csv q3_canonical q5_classify_outcomes
q6_score_pages q9_shifted_values q10_outcome_counts q13_score_bands q14_wrong_known_list q16_simple_outcomes""".split())


def query(name: str, sql: str | None = None):
    """Register a query over `Tables`; `sql` is the same result in ANSI SQL."""
    def add(make: Callable[[Tables], DataFrame]):
        tables = SheetTables if name in SHEETS else Tables
        QUERIES[name] = lambda spark, folder: make(tables(tune(spark, folder), folder))
        if sql is not None:
            ORACLE[name] = sheets_sql(sql) if name in SHEETS else sql
        return make
    return add
