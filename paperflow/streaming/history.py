"""M13 as a stream: the first delivery of each message id for ever, against a history of any size.

The history is cut by a hash of the id into partitions, and each partition into blocks. A block has a Bloom filter of one
bitmap (4 kB, as Spark's bitmap functions build and merge them): an id belongs to one block and sets BITS bits there. A
batch first meets the bitmaps of its blocks. Ids whose bits are not all set are new, without a look at the history; only
the partitions of the others are read, by partition pruning, and decide. With about 3000 ids to a block some 1 % of the
new ids are looked up in vain. A history beyond that only makes more ids look at their partition: results never change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..scale import cut_lineage, first_by
from .epochs import is_complete, read_epochs, write_epoch

BITS = 5
BITMAP = 32_768
IDS_PER_BLOCK = 3_000


class MessageHistory:
    """Stored messages (`rows`) and the bitmaps of their ids (`filters`), both by epoch and partition."""

    def __init__(self, target: str, key: str, columns: str, expected_ids: int = 3_000_000, partitions: int = 64):
        self.rows, self.filters, self.key, self.columns, self.partitions = f"{target}/rows", f"{target}/filters", key, columns, partitions
        self.blocks = max(1, -(-expected_ids // (partitions * IDS_PER_BLOCK)))  # in each partition

    def addressed(self, messages: DataFrame) -> DataFrame:
        """Messages with the partition and block of their id."""
        place = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.partitions * self.blocks))
        return messages.withColumns({"part": F.floor(place / self.blocks).cast("int"), "block": (place % self.blocks).cast("int")})

    def bits(self) -> list[Column]:
        """The bits of an id, independent of its place."""
        return [F.pmod(F.xxhash64(F.lit(f"bit {i}"), F.col(self.key).cast("string")), F.lit(BITMAP)) for i in range(BITS)]

    def write_filters(self, fresh: DataFrame, epoch: int) -> None:
        # bitmap_bit_position counts from 1, bitmap_construct_agg from 0.
        each = self.addressed(fresh).select("part", "block", F.explode(F.array(*self.bits())).alias("bit"))
        built = each.groupBy("part", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        write_epoch(built, self.filters, epoch, ["part"])

    def perhaps_known(self, addressed: DataFrame, epoch: int) -> DataFrame:
        """The messages whose id has all its bits set by earlier epochs."""
        wanted = [r["part"] for r in addressed.select("part").distinct().collect()]  # one small number for each partition at most
        kept = read_epochs(addressed.sparkSession, self.filters, "block int, bitmap binary, part int", epoch)
        merged = kept.where(F.col("part").isin(wanted)).groupBy("part", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        byte = lambda p: F.conv(F.hex(F.substring("bitmap", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = [F.getbit(byte(p), (p % 8).cast("int")) == 1 for p in self.bits()]
        return addressed.join(merged, ["part", "block"]).where(reduce(lambda a, b: a & b, is_set)).drop("bitmap")

    def stored(self, parts: list[int], spark, epoch: int) -> DataFrame:
        """The stored messages of these partitions; no other folder is read."""
        return read_epochs(spark, self.rows, f"{self.columns}, part int", epoch).where(F.col("part").isin(parts))

    def append(self, batch: DataFrame, epoch: int, order: list[str]) -> None:
        """Store the first delivery of each id that no earlier epoch holds. A repeated epoch adds nothing."""
        spark = batch.sparkSession
        if is_complete(spark, self.filters, epoch):  # written last
            return
        first = cut_lineage(self.addressed(first_by(batch, [self.key], order)))
        maybe = cut_lineage(self.perhaps_known(first, epoch).select(self.key, "part"))
        parts = [r["part"] for r in maybe.select("part").distinct().collect()]
        fresh = first
        if parts:
            known = maybe.join(self.stored(parts, spark, epoch).select(self.key), self.key, "left_semi")
            fresh = first.join(known.select(self.key), self.key, "left_anti")
        write_epoch(fresh.drop("block"), self.rows, epoch, ["part"])
        self.write_filters(read_epochs(spark, self.rows, f"{self.columns}, part int").where(F.col("epoch") == epoch), epoch)

    def read(self, spark) -> DataFrame:
        return read_epochs(spark, self.rows, f"{self.columns}, part int").drop("part", "epoch")


def dedup_stream(messages: DataFrame, history: MessageHistory, order: list[str], checkpoint: str) -> StreamingQuery:
    """Append the first delivery of each id to the history."""
    return (messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, epoch: history.append(batch, epoch, order)).start())
