"""Best-two-fit packing of token sequences.

A bin is filled greedily: the longest unpacked piece first, then again and again the longest that still fits. Then the
bin's smallest piece is taken out if two unpacked pieces fit the room it leaves more tightly (the bin's first piece stays).

Pieces of one length are alike to this rule, and there are at most `capacity` lengths. So the rule runs over counts of
lengths, a table bounded by the capacity whatever the corpus holds: a filled bin is a pattern, and it is repeated as
often as the rule would find it again. The pieces themselves never leave the cluster. They are encoded once, numbered per
length within the task that encodes them, and written; a count per task and length turns these numbers into ranks, and a
rank of a length leads to its sequence and place by a search in its length's row of the patterns. A length that a third of all pieces share
is therefore spread like any other.

Cases: a null text is empty and holds only the end id; an empty table gives no rows. Only documents of more than
`capacity` ids are cut; their first piece may be shorter. Rows that share a doc_id, null ones too, are documents of their
own. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import uuid
from array import array
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scale import cut_lineage, shared_folder
from .common import broadcast_if_small
from .token_files import _byte_characters

CAPACITY = 2048
#: Bytes of text a worker encodes at a time.
CHUNK = 1 << 20
#: How the byte-level format splits texts; a fixed value of it.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER_LETTERS = re.compile("[^\x00-\u024f\u2000-\u206f\u20ac]")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
ENCODED = "part int, doc_id long, piece int, start long, length long, number long, ids binary"


class TextEncoder:
    """Ids of whole texts by a tokenizer file.

    A byte-level file without a normalizer, whose merges stand in the order of their ids, says the same as a table of ranks:
    then `tiktoken`, which reads such tables, encodes the text several times faster, with the same ids. The file is asked
    whether it is of this kind. Texts with characters beyond the Latin blocks and common signs, or with one of the file's
    added tokens, and all texts of other files go through the tokenizer itself. A long text is cut at a space between two
    characters that are no space, where such a tokenizer begins a piece in any case.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in told["added_tokens"]]
        self.ranked = self.ranks(told)

    def ranks(self, told: dict):
        """The same tokenizer as a table of ranks, or None."""
        import tiktoken

        splitter, model = told["pre_tokenizer"] or {}, told["model"]
        if (told["normalizer"] or told["truncation"] or told["padding"] or told["post_processor"] or splitter.get("type") != "ByteLevel"
                or not splitter.get("use_regex") or splitter.get("add_prefix_space") or model["type"] != "BPE" or model.get("dropout")
                or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in told["added_tokens"])):
            return None
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(model["vocab"].get(token) != 256 + i for i, token in enumerate(merges)):
            return None
        byte_of = {c: b for b, c in enumerate(_byte_characters())}
        table = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=table, special_tokens={})

    def parts(self, text: str) -> list[str]:
        if len(text) <= CHUNK or self.ranked is None:
            return [text]
        out, a = [], 0
        while len(text) - a > CHUNK and (cut := SINGLE_SPACE.search(text, a + CHUNK)):
            out.append(text[a:cut.start()])
            a = cut.start()
        return [*out, text[a:]]

    def ids(self, text: str) -> list[int]:
        if self.ranked is not None and not OTHER_LETTERS.search(text) and not any(t in text for t in self.added):
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text followed by the end id, and the number of ids of each text."""
        out, counts = array("I"), []
        for text in texts:
            before = len(out)
            for part in self.parts(text):
                out.extend(self.ids(part))
            out.append(end_id)
            counts.append(len(out) - before)
        return np.array(out, np.uint32), np.array(counts, np.int64)


def encoder(path: str) -> TextEncoder:
    """One for each worker process, kept from task to task."""
    home = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders"))
    if path not in home.__dict__:
        home.__dict__[path] = TextEncoder(path)
    return home.__dict__[path]


def chunks(sizes: list[int], most: int = CHUNK) -> list[tuple[int, int]]:
    """Bounds of stretches of about `most` bytes, each of one text at least."""
    out, a, total = [], 0, 0
    for b, size in enumerate(sizes):
        if b > a and total + size > most:
            out.append((a, b))
            a, total = b, 0
        total += size
    return [*out, (a, len(sizes))] if sizes else out


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents with their ids, and for each its number among those of its length in its task."""
    def encode(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                flat, counts = encoder(tokenizer)([t or "" for t in texts.slice(a, b - a).to_pylist()], end_id)
                pieces = -(-counts // capacity)
                of = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                ahead = counts[of] - (pieces[of] - piece) * capacity  # where the piece would start, were the first one whole
                start, stop = np.maximum(ahead, 0), ahead + capacity
                length, base = stop - start, (np.cumsum(counts) - counts)[of]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                number = np.empty(len(of), np.int64)
                number[order] = np.arange(len(of)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                data = memoryview(flat.astype("<u4").tobytes())
                payload = [data[4 * s:4 * e] for s, e in zip((base + start).tolist(), (base + stop).tolist())]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(of), part, np.int32)), "doc_id": pa.array([ids[a + i] for i in of.tolist()], pa.int64()),
                    "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                    "number": pa.array(number), "ids": pa.array(payload, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, ENCODED)


def fill_bin(counts: np.ndarray, capacity: int) -> tuple[dict[int, int], dict[int, int]]:
    """One bin of the rule over counts of lengths: how many pieces of each length it keeps, and how many it had to have at hand."""
    held, gap, left = {}, capacity, counts.copy()
    lengths = np.arange(len(counts))
    while gap:
        open_ = np.flatnonzero(left[:gap + 1])
        if not len(open_):
            break
        best = int(open_[-1])
        n = min(gap // best, int(left[best]))
        held[best] = held.get(best, 0) + n
        left[best] -= n
        gap -= n * best
    needed = dict(held)
    if gap and sum(held.values()) > 1:
        small = min(held)
        room = gap + small
        upto = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest piece that is left, up to each length
        first = np.flatnonzero(left[:room + 1])
        second = upto[np.minimum(first, room - first)]
        single = (second == first) & (left[first] < 2)
        second[single] = upto[first[single] - 1]
        total = np.where(second > 0, first + second, 0)
        if len(total) and total.max() > small:
            at = len(total) - 1 - int(total[::-1].argmax())  # of equal pairs the one with the longest piece
            held[small] -= 1
            if not held[small]:
                del held[small]
            for length in (int(first[at]), int(second[at])):
                held[length] = held.get(length, 0) + 1
                needed[length] = needed.get(length, 0) + 1
    return held, needed


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces a bin, number of bins, first sequence, offset): which ranks of a length lie where.

    A pattern is taken as many times as the rule would choose it in a row, that is, while its lengths last.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, sequence, out = np.zeros(capacity + 1, np.int64), 0, []
    while left.any():
        held, needed = fill_bin(left, capacity)
        times = min((int(left[x]) - need) // held[x] + 1 if x in held else 1 << 62 for x, need in needed.items())
        offset = 0
        for length in sorted(held, reverse=True):
            n = held[length]
            out.append((length, int(used[length]), n, times, sequence, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        sequence += times
    return out


def plan_table(spark: SparkSession, plan: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """One row for each length, `capacity` rows at most: where its ranks lie, in the order of the first ranks."""
    rows = [(length, *map(list, zip(*[(x[1], x[2], x[4], x[5]) for x in own]))) for length, own in groupby(sorted(plan), key=itemgetter(0))]
    return spark.createDataFrame(rows, "length long, firsts array<long>, each array<long>, sequences array<long>, offsets array<long>")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (32-bit little-endian), ids_crc32, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    # A checksum lies next to the ids, so that pieces can be placed and compared without reading the ids again.
    encode_pieces(docs, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids")).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)
    pieces = spark.read.schema(f"{ENCODED}, ids_crc32 long").parquet(folder)
    by_task = cut_lineage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    plan = F.broadcast(plan_table(spark, plan_bins({r["length"]: r["n"] for r in histogram}, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    ahead = broadcast_if_small(cut_lineage(by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))))

    rank = F.col("number") + F.col("ahead")
    at = F.size(F.filter("firsts", lambda x: x <= F.col("rank"))) - 1
    inside, each = F.col("rank") - F.get("firsts", F.col("at")), F.get("each", F.col("at"))
    put = pieces.join(ahead, ["part", "length"]).withColumn("rank", rank).join(plan, "length").withColumn("at", at)
    return put.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.get("sequences", F.col("at")) + F.floor(inside / each)).alias("sequence_id"),
                      (F.get("offsets", F.col("at")) + inside % each * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_ids, ids (raw), documents (doc_id, piece, offset, length): the packed sequences as a trainer reads them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))  # bounded by the capacity
    gathered = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_ids"))
    ids = F.aggregate("p", F.lit("").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return gathered.select("sequence_id", "n_ids", ids.alias("ids"),
                           F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("documents"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
