"""Session settings the operators are tuned for. A caller's own session works too; these are the ones we recommend."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A key that holds a third of the rows makes one huge reduce partition; AQE cuts it into several tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings of a running session that the plans here depend on for speed, not for results.
RUNTIME = {
    # The JVM does not compile methods above 8000 bytes; wide rule projections then run as split, compiled functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows are small but rules are many: keep reduce tasks parallel also when the shuffled bytes are few.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # A reduce task takes so many bytes of shuffled rows, some ten times that in memory, however large the input is.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # What a scan task groups before the shuffle is bounded the same way.
    "spark.sql.files.maxPartitionBytes": "64m",
    # Split the partition of a hot join key, also where that costs one more shuffle after the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The state of custom stateful operators lies in RocksDB, which holds more than memory does.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


#: Bytes of input files to one partition of a shuffle before small ones are put together.
PARTITION_INPUT = 4 << 20


def tune(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Set the above; with the folder of the input, shuffles also get as many partitions as its size asks for."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    if folder is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(least, size // PARTITION_INPUT))
    return spark


def finer(spark: SparkSession, partitions: int, size: str) -> None:
    """At least so many partitions to a shuffle, put together up to `size` only: for steps that multiply the rows they take. The next query's `tune` undoes it."""
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(initial, max(partitions, int(spark.conf.get(initial, spark.conf.get("spark.sql.shuffle.partitions")))))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)


def local_session(cores: str = "8", app: str = "paperflow") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = (builder.config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
