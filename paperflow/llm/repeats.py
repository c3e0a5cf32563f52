"""Finding, in a whole table of texts, the windows that also start earlier: the exchange behind both substring operators.

Texts are dealt into ranges of doc_id (batches), so that an earlier batch holds only earlier documents. Two rounds of
messages between batches and ranges of fingerprints decide everything:

1. Each batch sends a thin set of short fingerprints (what is sent is the operator's method). A range answers, with one
   bit each, which occur at least twice in the table. Windows without such a piece cannot be repeated.
2. Each batch sends two fingerprints of its remaining windows, of 64 and of 32 bits, made from the bytes with different
   tables and factors; windows are equal if both are. A range answers which of them an earlier batch holds.

A batch sends every fingerprint once, however often it occurs there, so a passage found everywhere costs one entry per
batch. Copies of a whole text are recognised beforehand by their hash: nothing of theirs is ever first, so they send nothing.
The texts are shuffled once and read from that shuffle in all three steps of one query; a lost executor only repeats tasks.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import deal, is_in, mixed, pack, rolling, unpack
from .common import range_bounds, range_number

#: Bytes of text that one task holds at a time, and fingerprints that one range holds.
BATCH_BYTES = 8 << 20
KEYS_PER_RANGE = 1 << 20
SENT = "part int, batch int, keys binary, anchors binary, seconds binary"
REPLY = "batch int, kind int, part long, data binary"
COPY, REPEATED, LATER = 0, 1, 2


def packed_rows(batch: int, keys: np.ndarray, parts: int, bits: int, anchors: np.ndarray | None = None, seconds: np.ndarray | None = None) -> pa.Table:
    """One row for each range that gets keys. Without anchors of their own all keys are anchors. Seconds go along with keys."""
    cut = deal(keys, parts, bits)
    cut_anchors = None if anchors is None else deal(anchors, parts, bits)
    used = [i for i in range(parts) if cut[i + 1] > cut[i]]
    return pa.table({
        "part": pa.array(used, pa.int32()), "batch": pa.array([batch] * len(used), pa.int32()),
        "keys": pa.array([pack(keys[cut[i]:cut[i + 1]]) for i in used], pa.binary()),
        "anchors": pa.array([None if anchors is None else pack(anchors[cut_anchors[i]:cut_anchors[i + 1]]) for i in used], pa.binary()),
        "seconds": pa.array([None if seconds is None else seconds[cut[i]:cut[i + 1]].tobytes() for i in used], pa.binary())})


def pair_order(keys: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of pairs by key and second, and which pairs differ from the one before in it."""
    order = np.argsort(keys, kind="stable")
    same, alike = keys[order[1:]] == keys[order[:-1]], seconds[order[1:]] == seconds[order[:-1]]
    if (same & ~alike).any():
        order = np.lexsort((seconds, keys))
        same, alike = keys[order[1:]] == keys[order[:-1]], seconds[order[1:]] == seconds[order[:-1]]
    return order, np.concatenate((np.ones(min(1, len(keys)), bool), ~(same & alike)))


def folded(x: np.ndarray) -> np.ndarray:
    """32 bits that depend on all bits of a 64-bit sum."""
    return ((x * np.uint64(0xC2B2AE3D27D4EB4F) ^ (x >> np.uint64(29))) >> np.uint64(32)).astype(np.uint32)


def answer(batches: list[int], kind: int, part: int, masks: list[np.ndarray]) -> pa.Table:
    kept = [i for i, m in enumerate(masks) if m.any()]
    return pa.table({
        "batch": pa.array([batches[i] for i in kept], pa.int32()), "kind": pa.array([kind] * len(kept), pa.int32()),
        "part": pa.array([part] * len(kept), pa.int64()), "data": pa.array([np.packbits(masks[i]).tobytes() for i in kept], pa.binary())})


def repeated_in_range(table: pa.Table) -> pa.Table:
    """Which keys occur at least twice in the table and meet an anchor. Batches send a key twice if they hold it twice."""
    batches, part = table["batch"].to_pylist(), table["part"][0].as_py()
    sets = [unpack(x) for x in table["keys"].to_pylist()]
    every = np.sort(np.concatenate(sets))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    anchors = [unpack(x) for x in table["anchors"].to_pylist() if x]
    if table["anchors"].null_count < len(table):
        indexed = np.unique(np.concatenate(anchors)) if anchors else np.zeros(0, np.uint64)
        twice = twice[is_in(twice, indexed)]
    return answer(batches, REPEATED, part, [is_in(s[np.concatenate(([True], s[1:] != s[:-1]))], twice) for s in sets])


def later_in_range(table: pa.Table) -> pa.Table:
    """Which keys an earlier batch holds as well."""
    part = table["part"][0].as_py()
    rows = sorted(zip(table["batch"].to_pylist(), table["keys"].to_pylist(), table["seconds"].to_pylist()))
    batches, sets = [b for b, _, _ in rows], [unpack(x) for _, x, _ in rows]
    sizes = np.array([len(s) for s in sets])
    every, seconds = np.concatenate(sets), np.concatenate([np.frombuffer(x, np.uint32) for _, _, x in rows])
    order, new = pair_order(every, seconds)  # the order of the batches holds within equal pairs
    later = np.zeros(len(every), bool)
    later[order] = ~new
    return answer(batches, LATER, part, np.split(later, np.cumsum(sizes)[:-1]))


def mask_of(replies: pa.Table, kind: int, keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The bits that came back for sorted distinct keys."""
    cut, mask = deal(keys, parts, bits), np.zeros(len(keys), bool)
    for k, part, data in zip(replies["kind"].to_pylist(), replies["part"].to_pylist(), replies["data"].to_pylist()):
        if k == kind:
            a, b = cut[part], cut[part + 1]
            mask[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
    return mask


class Batch:
    """The distinct documents of one batch in order: by doc_id (null first), then by text."""

    def __init__(self, table: pa.Table, replies: pa.Table | None):
        self.ids, hashes, texts = table["doc_id"].to_pylist(), table["hash"].to_pylist(), table["text"].to_pylist()
        self.texts = [t or b"" for t in texts]
        copies = set() if replies is None else {
            (p, int(d)) for k, p, d in zip(*(replies[c].to_pylist() for c in ("kind", "part", "data"))) if k == COPY}
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0, self.texts[i]))
        self.of, self.first = [0] * len(order), []
        for i in order:
            last = self.first[-1] if self.first else None
            if last is None or (self.ids[last], self.texts[last]) != (self.ids[i], self.texts[i]):
                self.first.append(i)
            self.of[i] = len(self.first) - 1
        self.copy = [(self.ids[i], hashes[i]) in copies for i in self.first]
        self.number = table["batch"][0].as_py() if len(table) else 0

    def own_texts(self) -> list[bytes]:
        """Texts that take part; copies of earlier documents are left out."""
        return [self.texts[i] for i, copy in zip(self.first, self.copy) if not copy]


def starts_inside(bounds: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a window that ends in the same document."""
    mask = np.ones(max(0, int(bounds[-1]) - length + 1), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        mask[max(a, b - length + 1):b] = False
    return mask


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Positions inside any window that begins at `starts`."""
    change = np.zeros(n + 1, np.int32)
    change[starts] += 1
    change[starts + length] -= 1
    return np.cumsum(change[:-1]) > 0


def resolve(docs: DataFrame, window: int, cut, second_values, prepare, sampled, likely, finish, schema: str, keys_per_byte: float, sampled_per_byte: float) -> DataFrame:
    """Run both rounds and finish every batch.

    cut(texts) gives the values of all texts end to end and the bounds of the texts; second_values(texts, values) the values
    for the second fingerprint; prepare(values, bounds) what the next
    two need. sampled(prepared) gives the sorted fingerprints of round 1 (twice where repeated) and those that are anchors,
    or None. likely(prepared, keys) gives the starts of windows that hold a piece of the sorted `keys`. finish(batch,
    removed, bounds) gives the rows.
    """
    measured = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    batches = max(1, -(-measured // BATCH_BYTES))
    parts_1 = max(1, int(measured * sampled_per_byte) // KEYS_PER_RANGE + 1)
    parts_2 = max(1, int(measured * keys_per_byte) // KEYS_PER_RANGE + 1)
    bounds = range_bounds(docs, "doc_id", batches)
    tasks = max(batches, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("hash2"),
                        range_number("doc_id", bounds).alias("batch"), F.col("text"))
    slim = keyed.select("doc_id", "hash", "hash2", "batch").where(F.col("text").isNotNull())
    firsts = (slim.groupBy("hash", "hash2").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"))
              .where("n > 1"))
    copies = (slim.join(firsts, ["hash", "hash2"]).where((F.col("doc_id") > F.col("least")) | ((F.col("nulls") > 0) & F.col("doc_id").isNotNull()))
              .select((F.col("batch") + 0).alias("batch"), F.lit(COPY).alias("kind"), F.col("doc_id").alias("part"), F.col("hash").cast("string").cast("binary").alias("data")).distinct())
    texts = keyed.select("doc_id", "hash", F.col("text").cast("binary").alias("text"), "batch").repartition(tasks, "batch")

    def sample(table, replies):
        batch = Batch(table, replies)
        keys, anchors = sampled(prepare(*cut(batch.own_texts())))
        return packed_rows(batch.number, keys, parts_1, 48, anchors)

    def windows(batch, replies):
        own = batch.own_texts()
        values, ends = cut(own)
        prepared = prepare(values, ends)
        keys = np.unique(sampled(prepared)[0])
        at = likely(prepared, keys[mask_of(replies, REPEATED, keys, parts_1, 48)])
        prints = mixed(rolling(values, window)[at])
        seconds = folded(rolling(second_values(own, values), window, second=True)[at])
        return ends, at, prints, seconds, *pair_order(prints, seconds)

    def extend(table, replies):
        batch = Batch(table, replies)
        _, _, prints, seconds, order, new = windows(batch, replies)
        return packed_rows(batch.number, prints[order[new]], parts_2, 64, seconds=seconds[order[new]])

    def last(table, replies):
        batch = Batch(table, replies)
        ends, at, prints, _, order, new = windows(batch, replies)
        earlier = mask_of(replies, LATER, prints[order[new]], parts_2, 64)
        gone = np.zeros(len(at), bool)
        gone[order] = ~new | earlier[np.cumsum(new) - 1]
        return finish(batch, covered(at[gone], window, int(ends[-1])), ends)

    def together(replies, function, out):
        return texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(function, out)

    repeated = together(copies, sample, SENT).groupBy("part").applyInArrow(repeated_in_range, REPLY)
    known = copies.unionByName(repeated)
    later = together(known, extend, SENT).groupBy("part").applyInArrow(later_in_range, REPLY)
    return together(known.unionByName(later), last, schema)


def spans(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
    return edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()


def span_array(found: list[tuple[list[int], list[int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.array([[{"start": s, "length": n} for s, n in zip(*x)] for x in found], kind)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
