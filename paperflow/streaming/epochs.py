"""Tables that streams write epoch by epoch.

An epoch is a folder of its own. It is complete once Spark has marked it so, and a repeated epoch either finds itself
complete and does nothing, or replaces what a lost attempt left. So whatever is repeated, a table holds each epoch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_complete(spark: SparkSession, table: str, epoch: int) -> bool:
    return _exists(spark, f"{table}/epoch={epoch}/_SUCCESS")


def write_epoch(rows: DataFrame, table: str, epoch: int, by: list[str] | None = None) -> None:
    """Put the rows in place of whatever the epoch's folder holds, in one folder for each value of the columns `by`."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{table}/epoch={epoch}")


def read_epochs(spark: SparkSession, table: str, columns: str, before: int | None = None) -> DataFrame:
    """All rows with their epoch, of the epochs below `before` if that is given; none if nothing was written yet."""
    schema = f"{columns}, epoch long"
    rows = spark.read.schema(schema).parquet(table) if _exists(spark, table) else spark.createDataFrame([], schema)
    return rows if before is None else rows.where(F.col("epoch") < before)


def latest(rows: DataFrame, keys: list[str], then: list[str] | None = None) -> DataFrame:
    """The row of the last epoch of each key; `then` decides within an epoch."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct("epoch", *(then or []))
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
