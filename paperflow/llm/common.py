"""Small helpers shared by the operators: safe packing of the caller's columns, size-checked broadcasts, global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import cut_lineage, numbered

#: Rows up to which a table may be broadcast. Each caller's rows are a few dozen bytes, so this stays within some 20 MB.
BROADCAST_ROWS = 200_000


def packed(docs: DataFrame) -> Column:
    """All columns of the caller in one struct, so that names inside an operator cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting, and leave larger tables to adaptive joins. `df` should be checkpointed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def key_text(column: str) -> Column:
    """A text that tells null from any value, to be hashed."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def hash60(*parts: Column) -> Column:
    """60 uniform bits as a long, from MD5, so that any other engine can compute the same number."""
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 15), 16, 10).cast("long")


def ranged(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """`df` dealt into ranges of `order`, with the range's number in `_range`; checkpointed, so the ranges stay fixed."""
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def ranked(df: DataFrame, order: list[str], out: str, rows_per_task: int = 100_000) -> DataFrame:
    """1, 2, 3, ... over all rows in `order`, each range numbered in a task of its own."""
    parts = max(1, -(-df.count() // rows_per_task))
    return numbered(ranged(df, order, parts), [], order, F.col("_range"), out).drop("_range")


def range_bounds(df: DataFrame, column: str, ranges: int) -> list[int]:
    """At most `ranges` - 1 increasing values that cut an integer column into ranges of about equal row counts."""
    if ranges < 2:
        return []
    steps = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(column).cast("long"), steps, max(10_000, 20 * ranges)).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_number(column: str, bounds: list[int]) -> Column:
    """How many bounds are at or below the value: its range, from 0 on; null is in range 0. Two short searches, no UDF."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    value = F.col(column).cast("long")
    block = F.size(F.filter(F.lit([b[0] for b in blocks]).cast("array<bigint>"), lambda x: x <= value)) - 1
    inner = F.size(F.filter(F.get(F.array(*[F.lit(b).cast("array<bigint>") for b in blocks]), block), lambda x: x <= value))
    return F.when(value.isNull() | (value < bounds[0]), 0).otherwise(block * step + inner).cast("int")
