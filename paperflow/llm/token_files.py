"""Token ids in binary shards with a minimal perfect hash index.

Documents are encoded with a tokenizer file, an end id is added to each, and their ids are laid end to end in ascending
order of doc_id. A shard is a range of doc_id. The files are Parquet with one row per shard:

    shard, n_docs, n_ids      its number and counts
    payload                   raw ids, 32-bit unsigned little-endian, all documents of the shard in order
    keys                      the doc_ids in order (for a walk over the shard; keyed access does not need them)
    displace                  the hash function: one 32-bit signed number for each bucket of about four keys
    slots                     24 bytes a document: fingerprint of its key, offset and length in ids, each 64-bit little-endian

A key has two 64-bit hashes. The first leads to a bucket, both and the bucket's displacement give the slot (a negative one
is the slot itself), and the second, stored as fingerprint, tells a document of the shard from any other key: one access,
whatever the number of documents. Next to the shards lies
`ranges`, the bounds of doc_id that lead a key to its shard.

Cases: a null text is empty and holds only the end id. Rows that share a doc_id are keys (doc_id, 0), (doc_id, 1), ... in
the order of their texts. A null doc_id comes first. An empty table gives no shards. Other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import sys
import types
import uuid
import zlib
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import shared_folder
from .arrays import mixed
from .common import range_bounds, range_number

SHARD_BYTES = 4 << 20
#: Words whose ids a worker remembers; when full it starts anew. Bytes of text it splits at a time.
REMEMBERED = 500_000
CHUNK = 4 << 20
SHARD = "shard int, n_docs long, n_ids long, payload binary, keys array<long>, displace binary, slots binary"
SLOT = np.dtype([("fingerprint", "<u8"), ("offset", "<i8"), ("length", "<i8")])
NULL_KEY = np.uint64(0x6E756C6C)
#: Letters that the normalizer at most lowers (a-z and those of Latin-1), and marks that end a word without joining it.
PLAIN_BODY = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and (c.isascii() or c >= "\u00c0"))
MARKS = ".,;:!?%*#$&|)"
#: Settings of a tokenizer file under which a text's ids are those of its words; fixed values of the format.
WORDS = {
    "truncation": None, "padding": None, "post_processor": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Displacements tried for a bucket before the shard is given up: two keys then agree in 128 bits.
TRIES = 1 << 22


def _byte_characters() -> list[str]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    kept, others = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)], 0
    out = []
    for b in range(256):
        out.append(chr(b) if b in kept else chr(256 + others))
        others += b not in kept
    return out


def _keep(ids: array, ends: array, more: list[list[int]]) -> np.ndarray:
    """Append stretches of ids; their numbers."""
    first, at = len(ends) - 1, len(ids)
    ids.extend(chain.from_iterable(more))
    ends.frombytes((at + np.cumsum([len(m) for m in more], dtype=np.int64)).tobytes())
    return first + np.arange(len(more))


def _values(texts: pa.Array) -> list:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _stretches(ids: array, ends: array, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of the given numbers end to end, and the length of each."""
    flat, bounds = np.frombuffer(ids, np.uint32), np.frombuffer(ends, np.int64)
    begin = bounds[which]
    length = bounds[which + 1] - begin
    upto = np.cumsum(length)
    where = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin - (upto - length), length)
    return flat[where], length


class WordEncoder:
    """Ids of texts by words. The tokenizer splits at white space and drops it, so a text's ids are its words' ids in turn.

    A word of plain letters with marks behind it is two pieces to the tokenizer, a run of letters and a run of marks, and
    all its normalizer does to them is to lower the letters. Such pieces are looked up in the tokenizer's model directly;
    all other words go through the whole tokenizer. That holds for files with the settings `WORDS`; with
    any other file whole texts are encoded. A word's ids are remembered as one stretch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.characters = Tokenizer.from_file(path), _byte_characters()
        told = json.loads(self.tokenizer.to_str())
        self.by_words = ({k: told[k] for k in WORDS} == WORDS and told["model"]["end_of_word_suffix"] == "</w>" and told["model"]["dropout"] is None
                         and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]))
        self.forget()

    def forget(self) -> None:
        self.bodies: dict[str, int] = {"": 0}
        self.pieces, self.piece_ends = array("I"), array("q", [0, 0])
        self.words: dict[bytes, int] = {b"": 0}
        self.ids, self.ends = array("I"), array("q", [0, 0])

    def piece(self, text: str) -> list[int]:
        written = text if text.isascii() else "".join([self.characters[b] for b in text.encode()])
        return [t.id for t in self.tokenizer.model.tokenize(written)]

    def pieces_of(self, texts: pa.Array) -> np.ndarray:
        """The number of each run of letters or marks among the pieces; new ones are encoded."""
        met = texts.dictionary_encode()
        written = _values(met.dictionary)
        at = np.fromiter(map(self.bodies.get, written, repeat(-1)), np.int64, len(written))
        fresh = np.flatnonzero(at < 0)
        new = [written[k] for k in fresh.tolist()]
        at[fresh] = _keep(self.pieces, self.piece_ends, [self.piece(text.lower()) for text in new])
        self.bodies.update(zip(new, at[fresh].tolist()))
        return at[met.indices.to_numpy()]

    def learn(self, words: pa.Array) -> None:
        """Keep the ids of new words: those of its letters and of its marks, or of the whole word."""
        lowered = pc.ascii_lower(pc.ascii_rtrim(words, characters=MARKS))
        is_plain = pc.match_substring_regex(lowered, PLAIN_BODY)
        plain = is_plain.to_numpy(zero_copy_only=False)
        parts = np.zeros((len(words), 2), np.int64)
        parts[plain, 0] = self.pieces_of(lowered.filter(is_plain))
        parts[plain, 1] = self.pieces_of(pc.utf8_ltrim(words.filter(is_plain), characters=LETTERS))
        others = _values(words.filter(pc.invert(is_plain)).cast(pa.large_binary()))
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)
        parts[~plain, 0] = _keep(self.pieces, self.piece_ends, [e.ids for e in encoded])
        ids, lengths = _stretches(self.pieces, self.piece_ends, parts.ravel())
        self.ends.frombytes((len(self.ids) + np.cumsum(lengths.reshape(-1, 2).sum(axis=1))).astype(np.int64).tobytes())
        self.ids.frombytes(ids.tobytes())

    def known(self, words: pa.Array) -> np.ndarray:
        """The number of each of different words among those remembered."""
        written = _values(words.cast(pa.large_binary()))
        at = np.fromiter(map(self.words.get, written, repeat(-1)), np.int64, len(written))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            at[fresh] = len(self.ends) - 1 + np.arange(len(fresh))
            self.learn(words.take(pa.array(fresh)))
            self.words.update(zip([written[k] for k in fresh.tolist()], at[fresh].tolist()))
        return at

    def __call__(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text followed by the end id, and the number of ids of each text."""
        parts, counts, a = [], [], 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
                size += len(texts[b])
                b += 1
            ids, lengths = self.some(texts[a:b], end_id)
            parts.append(ids)
            counts.append(lengths)
            a = b
        return np.concatenate(parts or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def some(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > REMEMBERED or len(self.bodies) > REMEMBERED:
            self.forget()
        if not self.by_words:
            encoded = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(encoded), np.uint32), np.array([len(e) for e in encoded])
        # Invalid UTF-8 is passed through: only ASCII marks and blanks are looked at here.
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False))
        counts = split.value_lengths().to_numpy()
        met = split.flatten().dictionary_encode()
        used = self.known(met.dictionary)[met.indices.to_numpy()]
        used = np.insert(used, np.cumsum(counts), _keep(self.ids, self.ends, [[end_id]])[0])
        ids, length = _stretches(self.ids, self.ends, used)
        upto = np.cumsum(length)
        return ids, np.diff(upto[np.cumsum(counts + 1) - 1], prepend=0)


def encoder(path: str) -> WordEncoder:
    """One for each worker process, kept from task to task."""
    home = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders"))
    if path not in home.__dict__:
        home.__dict__[path] = WordEncoder(path)
    return home.__dict__[path]


def key_hash(ids: list[int | None], copies: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key; only the second tells a null apart from the number in its place."""
    base = np.array([int(NULL_KEY) if i is None else i & (2**64 - 1) for i in ids], np.uint64)
    nulls, times = np.array([i is None for i in ids], np.uint64), np.array(copies, np.uint64)
    first = mixed(mixed(base) + times * np.uint64(0x9E3779B97F4A7C15))
    return first, mixed(mixed(base * np.uint64(0xD1B54A32D192ED03) + nulls) ^ mixed(times + np.uint64(0x632BE59BD9B4E019)))


def _slots(keys: np.ndarray, seconds: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mixed(keys + d * (seconds | np.uint64(1))) % np.uint64(n)).astype(np.int64)


def slot_of(keys: np.ndarray, seconds: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key in a shard of n documents."""
    d = displace[(keys % np.uint64(len(displace))).astype(np.int64)].astype(np.int64)
    return np.where(d < 0, -d - 1, _slots(keys, seconds, np.maximum(d, 0).astype(np.uint64), n))


def minimal_perfect_hash(keys: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Displacements that send n distinct keys to n slots. Large buckets are placed first; single keys take what is free."""
    n = len(keys)
    displace = np.zeros(max(1, -(-n // 4)), np.int32)
    bucket = (keys % np.uint64(len(displace))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=len(displace))
    begin = np.cumsum(sizes) - sizes
    used = np.zeros(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in by_size[:int((sizes > 1).sum())].tolist():
        own = order[begin[b]:begin[b] + sizes[b]]
        for base in range(0, TRIES, len(tries)):
            d = np.uint64(base) + tries
            slots = _slots(keys[own][None, :], seconds[own][None, :], d[:, None], n)
            ordered = np.sort(slots, axis=1)
            good = np.flatnonzero(~used[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            if len(good):
                displace[b] = int(d[good[0]])
                used[slots[good[0]]] = True
                break
        else:
            raise ValueError("keys of a shard cannot be told apart")
    singles = by_size[int((sizes > 1).sum()):int((sizes > 0).sum())]
    displace[singles] = -np.flatnonzero(~used)[:len(singles)] - 1
    return displace


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> str:
    """Write the shards and give their folder, by default a new one in the shared folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))
    bounds = range_bounds(docs, "doc_id", shards)
    tasks = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                        range_number("doc_id", bounds).alias("shard")).repartition(tasks, "shard")

    def build(table: pa.Table) -> pa.Table:
        ids, texts = table["doc_id"].to_pylist(), [t or b"" for t in table["text"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        ids = [ids[i] for i in order]
        copies = [0] * len(ids)
        for i in range(1, len(ids)):
            copies[i] = copies[i - 1] + 1 if ids[i] == ids[i - 1] else 0
        payload, lengths = encoder(tokenizer)([texts[i] for i in order], end_id)
        keys, seconds = key_hash(ids, copies)
        displace = minimal_perfect_hash(keys, seconds)
        slots = np.zeros(len(ids), SLOT)
        at = slot_of(keys, seconds, displace, len(ids))
        slots["fingerprint"][at], slots["offset"][at], slots["length"][at] = seconds, np.cumsum(lengths) - lengths, lengths
        return pa.table({
            "shard": pa.array(table["shard"][:1].to_pylist(), pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([len(payload)], pa.int64()),
            "payload": pa.array([payload.astype("<u4").tobytes()], pa.binary()), "keys": pa.array([ids], pa.list_(pa.int64())),
            "displace": pa.array([displace.astype("<i4").tobytes()], pa.binary()), "slots": pa.array([slots.tobytes()], pa.binary())})

    built = keyed.groupBy("shard").applyInArrow(build, SHARD)
    built.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{folder}/shards")
    spark.createDataFrame([(bounds,)], "bounds array<long>").write.parquet(f"{folder}/ranges")
    return folder


def find(row: dict, ids: list[int | None], copies: list[int]) -> list[tuple[int, int] | None]:
    """Offset and length of keys in one shard, None for keys that are not there."""
    slots, displace = np.frombuffer(row["slots"], SLOT), np.frombuffer(row["displace"], "<i4")
    keys, seconds = key_hash(ids, copies)
    met = slots[slot_of(keys, seconds, displace, len(slots))]
    good = met["fingerprint"] == seconds
    return [(int(m["offset"]), int(m["length"])) if g else None for m, g in zip(met, good)]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, offset, n_tokens, ids_crc32 of every document, each met through the index of its shard."""
    def walk(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, copies = row["keys"], [0] * len(row["keys"])
                for i in range(1, len(ids)):
                    copies[i] = copies[i - 1] + 1 if ids[i] == ids[i - 1] else 0
                places, payload = find(row, ids, copies), memoryview(row["payload"])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "shard": pa.array([row["shard"]] * len(ids), pa.int32()),
                    "offset": pa.array([p[0] for p in places], pa.int64()), "n_tokens": pa.array([p[1] for p in places], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(payload[4 * a:4 * (a + n)]) for a, n in places], pa.int64())})

    return spark.read.parquet(f"{folder}/shards").mapInArrow(walk, "doc_id long, shard int, offset long, n_tokens long, ids_crc32 long")


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """shard, start: ids of all shards before it. One small row for each shard, summed up in order."""
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/shards").select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id, ids (raw payload) of the wanted doc_ids: keys are led to their shards, each shard is read once."""
    bounds = spark.read.parquet(f"{folder}/ranges").first()["bounds"]
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id"), range_number("doc_id", bounds).alias("shard")).distinct()

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out = left["doc_id"].to_pylist(), []
        for row in right.to_pylist() if ids else []:
            copy, open_ = 0, ids
            while open_:
                places = find(row, open_, [copy] * len(open_))
                out += [(i, row["payload"][4 * p[0]:4 * (p[0] + p[1])]) for i, p in zip(open_, places) if p]
                copy, open_ = copy + 1, [i for i, p in zip(open_, places) if p]
        return pa.table({"doc_id": pa.array([o[0] for o in out], pa.int64()), "ids": pa.array([o[1] for o in out], pa.binary())})

    shards = spark.read.parquet(f"{folder}/shards").select("shard", "payload", "displace", "slots")
    return wanted.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(take, "doc_id long, ids binary")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
