"""Classes of similar items from shared buckets, without all pairs of any bucket.

Every item of a bucket is first compared with one item only, the most central: the one that shares most buckets with most
others. The links found join items to components; then only items of different components still need a comparison. In
each bucket that holds several components, the items outside its largest one are compared with the others, except where
an exact bound rules a link out: the pieces that two items can have in common are those of the bucket's central item that
both have, and no more others than either has in common with anyone. No pair of a bucket is left out unless both are
known to belong together or cannot be similar, so the classes are those that comparing every pair would give.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import cut_lineage
from .common import broadcast_if_small

#: Bytes of pairs that a Python worker gets at a time.
PAIR_BYTES = 16 << 20


def components(edges: DataFrame) -> DataFrame:
    """id and label (the least id of its component) of all ends of edges (a, b), by alternating star contractions.

    A round needs one minimum per node and one join; it stops when the edges are stars around the least ids.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.join(least(both).select("u", F.least("m", "u").alias("m")), "u")
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Now every edge leads down; hang all lower neighbours of a node, and itself, on the least of them.
        low = large.join(least(large), "u")
        small = (low.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
                 .where("a <> b").distinct())
        after = cut_lineage(small)
        mark = F.bit_xor(F.xxhash64("a", "b"))
        done = after.agg(F.count(F.lit(1)), mark).first() == edges.agg(F.count(F.lit(1)), mark).first()
        edges = after
        if done:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def linked(buckets: DataFrame, payload: DataFrame, similar: Callable[[bytes, bytes], bool], threshold: float,
           pieces: Callable[[bytes], np.ndarray] | None = None, given: DataFrame | None = None, placed_by: Callable[[dict, dict], Column] | None = None) -> DataFrame:
    """id and label of every item that has a link; items without one are left out.

    `buckets` has rows of (bucket, id, size), `payload` one row (id, data) for each item. `similar` gets two data values and
    decides exactly. Items whose sizes differ by more than the factor `threshold` cannot be similar. If `pieces` are given,
    an item is a set of `size` 64-bit values, and two items of n and m values are similar only if they have in common
    threshold / (1 + threshold) * (n + m). `given` has links (a, b) that hold without a comparison.
    With `placed_by`, rows of `buckets` also have low and high, and it says from the columns (size, low, high) of two rows
    whether this bucket can speak for the pair; a similar pair must have a bucket that does.
    """
    spark = buckets.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PAIR_BYTES))
    held = buckets.groupBy("bucket").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("bucket", "n")
    shared = cut_lineage(buckets.join(held, "bucket"))
    weights = broadcast_if_small(cut_lineage(shared.groupBy("id").agg(F.sum("n").alias("weight"))))
    data = cut_lineage(payload.join(weights.select("id"), "id"))

    def near(a: str, b: str):
        return F.least(a, b) >= F.greatest(a, b) * threshold

    extra = [] if placed_by is None else ["low", "high"]

    def fits(one: dict[str, str], two: dict[str, str]) -> Column:
        within = near(one["size"], two["size"])
        return within if placed_by is None else within & placed_by({k: F.col(v) for k, v in one.items()}, {k: F.col(v) for k, v in two.items()})

    own, of_head, of_out = {c: c for c in ["size", *extra]}, {c: f"head_{c}" for c in ["size", *extra]}, {"size": "s", **{c: f"out_{c}" for c in extra}}

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar."""
        left = data.select(F.col("id").alias("a"), F.col("data").alias("left"))
        right = data.select(F.col("id").alias("b"), F.col("data").alias("right"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [similar(x, y) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")

    heads = shared.join(weights, "id").groupBy("bucket").agg(F.max_by(F.struct("id", *own), F.struct("weight", "id")).alias("h")).select(
        "bucket", F.col("h.id").alias("head"), *[F.col(f"h.{c}").alias(n) for c, n in of_head.items()])
    first = cut_lineage(shared.join(heads, "bucket").where(F.col("id") != F.col("head")).where(fits(own, of_head))
                        .select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct())
    found = compared(first)
    found = cut_lineage(found if given is None else found.unionByName(given))

    labels = components(found)
    placed = cut_lineage(shared.join(labels, "id", "left").select("bucket", "id", *own, F.coalesce("label", "id").alias("label")))
    several = placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    mixed = cut_lineage(placed.join(several, "bucket"))
    if pieces is not None:
        mixed = mixed.join(heads.select("bucket", "head"), "bucket")
        items = data.join(broadcast_if_small(cut_lineage(mixed.select("id").unionByName(mixed.select(F.col("head").alias("id"))).distinct())), "id")
        bits = cut_lineage(head_bits(mixed.select("head", "id").distinct(), items, pieces))
        mixed = cut_lineage(mixed.join(only_own(items, pieces), "id", "left").join(bits, ["head", "id"], "left").select("bucket", "id", *own, "label", "bits", F.when(
            F.col("id") != F.col("head"), F.col("size") - F.col("in_head") - F.coalesce("own", F.lit(0))).otherwise(F.lit(0)).alias("others")))
        both = F.aggregate(F.zip_with("b", "bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda total, x: total + x) + F.least("o", "others")
        common = F.coalesce(both + 1e-9 >= (F.col("s") + F.col("size")) * (threshold / (1 + threshold)), F.lit(True))
    else:
        mixed, common = mixed.withColumns({"bits": F.lit(None).cast("array<long>"), "others": F.lit(0)}), F.lit(True)
    main = (mixed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
            .agg(F.max_by("label", F.struct("n", "label")).alias("main")))
    members = mixed.join(main, "bucket")
    out = members.where("label <> main").select("bucket", F.col("id").alias("i"), *[F.col(c).alias(n) for c, n in of_out.items()], F.col("label").alias("l"), F.col("bits").alias("b"), F.col("others").alias("o"))
    pair = (F.col("l") != F.col("label")) & fits(of_out, own) & common & ((F.col("label") == F.col("main")) | (F.col("i") < F.col("id")))
    more = (out.join(members.withColumnRenamed("bucket", "_bucket"), (F.col("bucket") == F.col("_bucket")) & pair)
            .select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    also = cut_lineage(compared(cut_lineage(more)))
    if also.isEmpty():
        return labels
    return components(found.unionByName(also))


def only_own(data: DataFrame, pieces: Callable[[bytes], np.ndarray]) -> DataFrame:
    """id and own: how many of an item's pieces no other item of `data` has."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()):
                found = pieces(value).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), i, np.int64))], ["piece", "id"])

    owners = data.select("id", "data").mapInArrow(spread, "piece long, id long").groupBy("piece").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return owners.where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def head_bits(pairs: DataFrame, data: DataFrame, pieces: Callable[[bytes], np.ndarray]) -> DataFrame:
    """head, id, bits and in_head: which of the head's pieces an item has, as a bitmap, and how many.

    Ids with several data rows are left out, for their sizes and bits would not belong together.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, own = [], None, None
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                if left is not last:
                    last, own = left, np.sort(pieces(left))
                has = np.isin(own, pieces(right))
                packed = np.packbits(np.concatenate((has, np.zeros(-len(has) % 64, bool))))
                rows.append((packed.view(np.int64).tolist(), int(has.sum())))
            yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("id"), pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                                              pa.array([r[1] for r in rows], pa.int32())], ["head", "id", "bits", "in_head"])

    single = data.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("data").alias("data")).where("n = 1")
    left, right = single.select(F.col("id").alias("head"), F.col("data").alias("left")), single.select("id", F.col("data").alias("right"))
    return pairs.join(left, "head").join(right, "id").select("head", "id", "left", "right").mapInArrow(mark, "head long, id long, bits array<long>, in_head int")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
