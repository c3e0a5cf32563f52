"""Sharding by proportional stratified interleaving.

Rows of a source are put in seeded random order; row k of n has the fractional rank (k - 0.5) / n. Sorting all rows by
that rank interleaves the sources in proportion everywhere, so cutting the order into equal runs gives shards that all
hold the whole table's mixture. Counts of shards differ by one row at most (law `rows`).

Both sorts are cut into buckets along their order: hash ranges inside a source, then ranges of the fractional rank. Only
counts per bucket are added up, so a source with most of the rows is spread over as many tasks as it has buckets.

Cases: null sources are a source of their own, last in ties. A null text has crc32 0 and size 1. Rows that share a
doc_id are placed each by itself; rows equal in all columns are interchangeable. With fewer rows than shards some
shards stay empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import numbered
from .common import hash60, key_text, packed

ROWS_PER_BUCKET = 4096
MOST_BUCKETS = 20_000


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """The caller's rows in `doc`, with shard and slot. Needs doc_id and source; other columns are only carried."""
    total = docs.count()
    buckets = max(1, min(MOST_BUCKETS, -(-total // ROWS_PER_BUCKET)))
    plain = [f"`{f.name}`" for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    rows = docs.select(packed(docs).alias("doc"), F.col("source").isNull().alias("_last"), F.coalesce("source", F.lit("")).alias("_source"),
                       hash60(F.lit(f"shard {seed} "), key_text("doc_id")).alias("_h"), F.col("doc_id").alias("_id"),
                       F.xxhash64(*plain).alias("_row"))
    source, order = ["_last", "_source"], ["_h", "_id", "_row"]

    hashed = F.floor(F.col("_h") / F.lit(float(2**60)) * buckets)
    inside = numbered(rows, source, order, hashed, "_k")
    counts = rows.groupBy(*source).agg(F.count(F.lit(1)).alias("_n"))
    placed = inside.join(counts, source).withColumn("_f", (F.col("_k") - F.lit(0.5)) / F.col("_n"))

    position = numbered(placed, [], ["_f", *source, *order], F.floor(F.col("_f") * buckets), "_r")
    whole = max(1, total)
    shard = F.expr(f"(_r - 1) * {shards} div {whole}L")
    first = F.expr(f"(_shard * {whole}L + {shards - 1}) div {shards}")
    return (position.withColumn("_shard", shard.cast("long"))
            .select("doc", F.col("_shard").cast("int").alias("shard"), (F.col("_r") - 1 - first).cast("long").alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """The caller's rows with shard and slot behind their columns; columns of these names are replaced."""
    placed = assign_shards(docs, shards, seed)
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, "shard", "slot")
