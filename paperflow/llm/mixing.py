"""Mixing sources to target weights: word totals per source, repetition rates, whole copies plus one hashed coin toss.

Cases: a null source is a source of its own, ordered last. A null or blank text has size 0. A source without words has
target 0 and rate 0. Repeated rows are mixed each by itself; rows that share a doc_id get the same coin. An empty table
gives no rows. Columns the caller brings keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import cut_lineage
from .common import broadcast_if_small, hash60, key_text, packed, ranked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, target, rate from rows of (source, size).

    The level is the number of words per unit of weight. Sources whose share lies above `most` times their size are
    held there and the rest is shared anew, until none is above. A round is one aggregate over the sources and brings
    one row to the driver; the sources themselves stay distributed.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull().alias("_last"), "source"]
    named = totals.select(order[0], "source", "source_size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_n") - 1, F.lit(len(weights))).cast("int") + 1)
    sources = cut_lineage(ranked(named, ["_last", "source"], "_n").select(
        "source", "source_size", weight.alias("_weight"), (F.col("source_size") * F.lit(most)).alias("_cap")))

    whole = sources.agg(F.sum("source_size").cast("double"), F.sum("_weight")).first()
    everything, weight_sum = whole[0] or 0.0, whole[1] or 1.0
    level, held = everything / weight_sum, -1
    while True:
        capped = F.col("_cap") < F.col("_weight") * F.lit(level)
        n, caps, free = sources.agg(F.count_if(capped), F.sum(F.when(capped, F.col("_cap"))),
                                    F.sum(F.when(~capped, F.col("_weight")))).first()
        if n == held or not free:
            break
        held, level = n, (everything - (caps or 0.0)) / free
    target = F.least(F.col("_cap"), F.col("_weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def repeats(rate: Column, doc_id: str, seed: int) -> Column:
    """floor(rate), plus one where the document's hashed coin in [0, 1) lies below the fraction."""
    coin = hash60(F.lit(f"mix {seed} "), key_text(doc_id)) / F.lit(float(2**60))
    return (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixture_plan(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = WEIGHTS,
                 most: float = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """One row per document: doc (all its columns), doc_id, size, source_size, target, copies."""
    size = words_in(F.col("text")) if size is None else size
    targets = broadcast_if_small(source_targets(docs.select("source", size.alias("size")), weights, most))
    rows = docs.select(packed(docs).alias("doc"), F.col("doc_id").alias("doc_id"), F.col("source").alias("_source"), size.alias("size"))
    joined = rows.join(targets, rows["_source"].eqNullSafe(targets["source"]))
    return joined.select("doc", "doc_id", "size", "source_size", "target", repeats(F.col("rate"), "doc_id", seed).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with the caller's columns."""
    plan = mixture_plan(docs, **options).where("copies > 0")
    return plan.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("doc.*")
