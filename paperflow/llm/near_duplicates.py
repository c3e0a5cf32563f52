"""Near-duplicate classes with Order MinHash.

A text is the sequence of its runs of five words, each labelled with how often it occurred before. For each of several
hash functions the sketch takes the few labelled runs of least hash and keeps them in the order of the text, so that
equal sketch entries speak for the same content in the same order. Texts that share an entry are candidates. They are
verified by a banded alignment of their labelled runs: the longest chain of equal runs in order in both texts, within the
band of shifts that the threshold allows. Their similarity is aligned / (n + m - aligned), Jaccard's measure with order.

Texts equal in all words are joined beforehand by a BLAKE2b digest of their words' fingerprints, so copies cost nothing. At a similarity of 0.8 an
entry of five agrees with probability 0.8 ** 5, and one of 28 agrees in all but 1.5 of 100,000 pairs. Texts of few words
have too few runs for that and get entries of two; both kinds are made where the lengths of a similar pair may lie on
either side.

Cases: words are lower-cased A-Z, digits and all characters beyond ASCII. Texts of one to four words are one run. Texts
without a word are alike only if equal; a null text is alone. Rows that share a doc_id are one document; rows without a
doc_id are classes of their own, with a null class_id. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import cut_lineage
from .arrays import PLAIN, mixed, rolling, word_spans
from .linking import linked

RUN = 5
SIMILARITY = 0.8
ENTRIES = 28
#: Runs in an entry, and the numbers of runs in a text from which and up to which it gets such entries.
LONG, LONG_FROM = 5, 32
SHORT, SHORT_TO = 2, 40
CHUNK = 1 << 20
_FACTORS = mixed(np.arange(101, 101 + ENTRIES, dtype=np.uint64)) | np.uint64(1)
_PLACES = mixed(np.arange(301, 301 + LONG, dtype=np.uint64)) | np.uint64(1)


def labelled_runs(words: np.ndarray) -> np.ndarray:
    """One 64-bit value for each run of words, which also depends on how often the run occurred before."""
    if not len(words):
        return words
    runs = mixed(rolling(words, min(RUN, len(words))))
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if not new.all():
        at = np.arange(len(runs))
        times = np.empty(len(runs), np.uint64)
        times[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        runs = mixed(runs + times * np.uint64(0x9E3779B97F4A7C15))
    return runs


def entries(runs: np.ndarray, length: int, kind: int) -> np.ndarray:
    """The sketch: for each hash function one value for the `length` least runs in text order."""
    length, out = min(length, len(runs)), np.empty(ENTRIES, np.uint64)
    step = max(1, CHUNK // len(runs))
    for a in range(0, ENTRIES, step):
        hashed = runs[None, :] * _FACTORS[a:a + step, None]
        at = np.sort(np.argpartition(hashed, length - 1, axis=1)[:, :length], axis=1)
        out[a:a + step] = (mixed(runs[at]) * _PLACES[:length]).sum(axis=1, dtype=np.uint64)
    return mixed(out + np.arange(kind * ENTRIES, (kind + 1) * ENTRIES, dtype=np.uint64))


def sketch(words: np.ndarray) -> tuple[int, np.ndarray]:
    runs = labelled_runs(words)
    n, kinds = len(runs), []
    if n >= LONG_FROM:
        kinds.append(entries(runs, LONG, 0))
    if 0 < n <= SHORT_TO:
        kinds.append(entries(runs, SHORT, 1))
    return n, np.concatenate(kinds) if kinds else np.zeros(0, np.uint64)


def words_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Word fingerprints of each text, found for many texts at once."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < CHUNK):
            size += len(texts[b]) + 1
            b += 1
        starts, _, prints = word_spans(np.frombuffer(b"\n".join(texts[a:b]), np.uint8), PLAIN)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[a:b])])
        yield from np.split(prints, np.searchsorted(starts, begins[1:-1]))
        a = b


def runs_of(text: bytes) -> np.ndarray:
    return labelled_runs(next(words_of([text])))


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest chain of equal labelled runs, in order in both, with positions at most `band` apart."""
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    order = np.argsort(i[near], kind="stable")
    ends: list[int] = []
    for x in j[near][order].tolist():
        at = bisect_left(ends, x)
        if at == len(ends):
            ends.append(x)
        else:
            ends[at] = x
    return head + tail + len(ends)


def similar_texts(a: bytes, b: bytes) -> bool:
    """Whether the order-keeping similarity of two texts reaches the threshold."""
    x, y = (labelled_runs(w) for w in words_of([a, b]))
    n = len(x) + len(y)
    if not len(x) or not len(y):
        return False
    needed = SIMILARITY / (1 + SIMILARITY) * n
    if len(np.intersect1d(x, y, assume_unique=True)) < needed - 1e-9:
        return False
    return aligned(x, y, int(n - 2 * needed) + 1) >= needed - 1e-9


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class), one row for each row of `docs`."""
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("data"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("data").to_pylist()
            n, keys, sketches = [], [], []
            for i, text, words in zip(ids, texts, words_of([t or b"" for t in texts])):
                size, found = sketch(words)
                if len(words):
                    key = blake2b(words.tobytes(), digest_size=16).digest()
                else:
                    key = b"none" + blake2b(text, digest_size=16).digest() if text is not None else b"null" + str(i).encode()
                n.append(size)
                keys.append(key)
                sketches.append(found.view(np.int64))
            offsets = np.cumsum([0, *map(len, sketches)])
            values = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int32()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))], ["id", "size", "key", "sketch"])

    described = cut_lineage(source.where("id is not null").mapInArrow(describe, "id long, size int, key binary, sketch array<long>"))
    owners = described.groupBy("key").agg(F.min("id").alias("owner"))
    owned = cut_lineage(described.select("id", "key").distinct().join(owners, "key").select("id", "owner"))
    own = described.join(owned.where("id = owner").select("id").distinct(), "id", "left_semi")
    buckets = own.select(F.explode("sketch").alias("bucket"), "id", "size")
    texts = source.where("id is not null and data is not null")
    # Rows of one doc_id with several texts are one document, so these texts' owners belong together from the start.
    together = owned.groupBy("id").agg(F.min("owner").alias("b"), F.max("owner").alias("a")).where("a <> b").select("id", "b").join(owned, "id").select(F.col("owner").alias("a"), "b")
    labels = linked(buckets, texts, similar_texts, SIMILARITY, runs_of, together)

    classes = owned.join(labels.select(F.col("id").alias("owner"), "label"), "owner", "left").select("id", F.coalesce("label", "owner").alias("class"))
    classes = classes.groupBy("id").agg(F.min("class").alias("class"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("class").alias("class_id"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
