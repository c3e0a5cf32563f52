"""Plan shapes that stay balanced when one key holds a large share of the rows.

Each helper splits the rows of a key into buckets along its order (a time span, a block of line numbers), works inside
the buckets, and carries only one summary row per (key, bucket) to the level above. A hot key is therefore spread over
as many tasks as it has buckets, and no group of unbounded size is ever gathered.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def time_bucket(ts: str, width_seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(width_seconds * 1_000_000)).cast("long")


def block(number: str, size: int) -> Column:
    return F.floor(F.col(number) / F.lit(size)).cast("long")


def first_by(df: DataFrame, keys: list[str], order: list[str], *, last: bool = False) -> DataFrame:
    """The first (or last) row of each key. An aggregate, so every task keeps one row per key before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


#: Buckets that one step of a prefix sum without keys adds up.
FAN_IN = 1024


def running_count(df: DataFrame, keys: list[str], order: list[str], bucket: Column, flag: Column, out: str, levels: int = 0) -> DataFrame:
    """Inclusive running sum of an integer `flag` per key in `order`; `bucket` must grow with the order.

    Without keys one task adds up the totals of all buckets; with `levels` they are added up level by level.
    """
    tagged = df.withColumn("_bucket", bucket).withColumn("_flag", flag.cast("long"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_local", F.sum("_flag").over(inside))
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum("_flag").alias("_total"))
    if levels and not keys:
        offsets = prefix_sums(totals, "_bucket", "_total", "_before", levels).drop("_total")
    else:
        before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, -1)
        offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    joined = _join_back(local, offsets, keys)
    return joined.withColumn(out, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).drop("_bucket", "_flag", "_local", "_before")


def prefix_sums(totals: DataFrame, number: str, total: str, out: str, levels: int = 3) -> DataFrame:
    """The sum of `total` over all rows with a smaller whole `number` (unique; null is below all).

    Numbers are grouped FAN_IN at a time, and their sums again; after `levels` groupings some 2**30 neighbouring numbers
    are one, and the few sums that are left meet as one array.
    """
    if not levels:
        gathered = totals.agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(number), F.lit(-(1 << 63))).alias("n"), F.col(total).alias("t")))).alias("_all"))
        summed = gathered.select(F.explode(F.transform("_all", lambda x: F.struct(
            x["n"].alias("_n"), F.aggregate(F.filter("_all", lambda y: y["n"] < x["n"]), F.lit(0).cast("long"), lambda acc, y: acc + y["t"]).alias(out)))).alias("_x"))
        return totals.join(summed.select("_x._n", f"_x.{out}"), F.coalesce(F.col(number), F.lit(-(1 << 63))) == F.col("_n")).drop("_n")
    group = f"_group{levels}"
    grouped = totals.withColumn(group, F.floor(F.col(number) / FAN_IN).cast("long"))
    before = Window.partitionBy(group).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    inner = grouped.withColumn("_inner", F.coalesce(F.sum(total).over(before), F.lit(0)))
    outer = prefix_sums(grouped.groupBy(group).agg(F.sum(total).alias("_sum")), group, "_sum", f"_outer{levels}", levels - 1).drop("_sum")
    return (inner.join(outer.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
            .withColumn(out, F.col("_inner") + F.col(f"_outer{levels}")).drop(group, "_g", "_inner", f"_outer{levels}"))


def running_before(df: DataFrame, keys: list[str], order: list[str], bucket: Column, sums: dict[str, str] | None = None,
                   maxima: dict[str, str] | None = None) -> DataFrame:
    """Per key, over the rows before each: sums (0 at first) and maxima (null at first) of the named columns."""
    sums, maxima = sums or {}, maxima or {}
    jobs = [(out, column, F.sum) for out, column in sums.items()] + [(out, column, F.max) for out, column in maxima.items()]
    tagged = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumns({f"_in_{out}": agg(column).over(inside) for out, column, agg in jobs})
    totals = tagged.groupBy(*keys, "_bucket").agg(*[agg(column).alias(f"_of_{out}") for out, column, agg in jobs])
    carried = totals.select(*keys, "_bucket", *[agg(f"_of_{out}").over(across).alias(f"_up_{out}") for out, _, agg in jobs])
    joined = _join_back(local, carried, keys)
    whole = {out: F.coalesce(F.col(f"_in_{out}"), F.lit(0)) + F.coalesce(F.col(f"_up_{out}"), F.lit(0)) for out in sums}
    whole |= {out: F.greatest(f"_in_{out}", f"_up_{out}") for out in maxima}
    return joined.withColumns(whole).drop("_bucket", *[f"_{k}_{out}" for out, _, _ in jobs for k in ("in", "up")])


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str, levels: int = 0) -> DataFrame:
    """1, 2, 3, ... per key in `order`."""
    return running_count(df, keys, order, bucket, F.lit(1), out, levels)


def neighbour(df: DataFrame, keys: list[str], order: list[str], bucket: Column, fields: list[str], out: str,
              *, following: bool = False) -> DataFrame:
    """The previous (or next) row of the key as a struct column, across bucket edges."""
    tagged = df.withColumn("_bucket", bucket).withColumn("_item", F.struct(*fields))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = tagged.withColumn("_near", (F.lead if following else F.lag)("_item").over(inside))
    pick = F.min_by if following else F.max_by
    edges = tagged.groupBy(*keys, "_bucket").agg(pick("_item", F.struct(*order)).alias("_edge"))
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_bucket")
    carried = edges.withColumn("_carry", (F.lead if following else F.lag)("_edge").over(across)).drop("_edge")
    joined = _join_back(local, carried, keys)
    return joined.withColumn(out, F.coalesce("_near", "_carry")).drop("_bucket", "_item", "_near", "_carry")


def _join_back(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one summary per (key, bucket). Both sides are already partitioned by the same columns."""
    return rows.join(summaries, [*keys, "_bucket"], "left")


def joined_text(lines: DataFrame, keys: list[str], line_no: str, text: str) -> DataFrame:
    """The text of each key: its lines in order, joined by a space. For keys that one photo or one document bounds."""
    gathered = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col(text).alias("t")))).alias("_lines"))
    return gathered.select(*keys, F.array_join(F.transform("_lines", lambda x: x["t"]), " ").alias(text))


def salted_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str, spread_by: list[str], salts: int = 8) -> DataFrame:
    """Join rows with hot keys to a small lookup that is unique in `on`: each key is spread over `salts` reduce tasks.

    For lookups far smaller than the rows (senders, facilities), since the lookup is repeated `salts` times. Where both
    sides are large a plain join is used, whose skewed partitions adaptive execution splits at run time. The salt is a hash of row columns, so a re-run of a lost task gives the same rows.
    The lookup grows with the data and is merged, never broadcast: the planner does not count its repeated rows and would send them all through the driver.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


#: Parts of a bin in each step of `order_statistics`.
DIGITS = 2048


def _binade(value: Column) -> Column:
    """Sign and binary exponent of a double as one whole number that grows with it: at most some 4200 different ones."""
    size = F.when(F.isnan(value), 3000).when(F.abs(value) == float("inf"), 2900).when(value == 0, 0).otherwise(F.floor(F.log2(F.abs(value))) + 1400)
    return F.when(value < 0, -size).otherwise(size).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], small: int = 10_000) -> DataFrame:
    """Exact order statistics per key by radix selection, without sorting a key in one task.

    Values are counted. The first digit is the binary exponent, so values of any magnitude fall into few bins; the bin that
    holds a wanted rank is cut into 2048 parts between its least and greatest value, and again, until it holds at most
    `small` different values. Only then are these sorted. Counting a bin is an aggregate that every task begins by itself,
    so a bin that all values fall into is spread like any other. `ranks` maps an output name to a 0-based rank expression
    over the column `n` (values in the key).
    """
    counted = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    summed = [F.sum("_c").alias("_bc"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_kinds")]

    def holding(bins: DataFrame, by: list[str], start: Column) -> DataFrame:
        """The bins of each key (and name) that hold the wanted rank."""
        upto = Window.partitionBy(*by).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        placed = bins.withColumn("_start", start + F.coalesce(F.sum("_bc").over(upto), F.lit(0)))
        return placed.where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_bc"))).select(
            *keys, "_name", "_rank", "n", "_start", "_lo", "_hi", "_kinds")

    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, rank in ranks.items()]))
    bins = counted.groupBy(*keys, _binade(F.col("_v")).alias("_digit")).agg(*summed).withColumn("n", F.sum("_bc").over(Window.partitionBy(*keys)))
    found = cut_lineage(holding(bins.withColumn("_want", wanted).select("*", "_want._name", "_want._rank"), [*keys, "_name"], F.lit(0).cast("long")))
    while not (wide := found.where(F.col("_kinds") > small)).isEmpty():
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * DIGITS), F.lit(DIGITS - 1))
        edges = wide.withColumnsRenamed({"_lo": "_from", "_hi": "_to"}).drop("_kinds")
        inside = counted.join(wide.select(*keys, "_name", "_lo", "_hi"), keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bins = inside.groupBy(*keys, "_name", part.alias("_digit")).agg(*summed).join(edges, [*keys, "_name"])
        narrower = holding(bins.withColumnRenamed("_start", "_base"), [*keys, "_name"], F.col("_base"))
        found = cut_lineage(found.where(F.col("_kinds") <= small).unionByName(narrower))
    inside = counted.join(found, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    upto = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    met = inside.withColumn("_upto", F.col("_start") + F.sum("_c").over(upto)).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    return met.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; one of our own only on one machine where none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Written to the shared folder and read again, so that the planner knows its size."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
