"""Substring dedup with fixed-block anchors.

The non-overlapping blocks of ten words of every document are the reference index. Every rolling window of ten words
probes it; a hit is extended to the windows of 20 words around it, whose repeats are told by 96 bits of fingerprints,
and overlapping repeated windows join to the maximal repeated spans. Any window of 20 words holds a whole reference
block, so each repeat is met by at least one probe.

Cases: a null text has no words. Rows equal in doc_id and text are one document and get the same row each. Rows that
share only the doc_id follow one another in the order of their texts; a null doc_id is before all others. Texts of fewer
than 20 words lose nothing. An empty table gives no rows. Other columns of the caller are not looked at.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .arrays import SPACED, is_in, mixed, rolling, word_spans
from .repeats import resolve, span_array, spans, starts_inside

WINDOW, BLOCK = 20, 10
ROW = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, length: long>>, kept binary"


def word_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts end to end, and where each text begins among them."""
    starts, _, prints = word_spans(np.frombuffer(b"\n".join(texts), np.uint8), SPACED)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return prints, np.searchsorted(starts, begins)


def second_word_values(texts: list[bytes], values: np.ndarray) -> np.ndarray:
    """Fingerprints of the same words that are independent of `values`."""
    return word_spans(np.frombuffer(b"\n".join(texts), np.uint8), SPACED, second=True)[2]


def dedup_blocks(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, spans (in words) that were removed, kept (the other words joined by a space, UTF-8).

    A window of `window` words must hold a whole reference block wherever it starts: window >= 2 * block - 1.
    """
    if window < 2 * block - 1:
        raise ValueError("a window may miss every reference block")

    def prepare(values, ends):
        """Block fingerprints at every position, which lie inside a document, which are reference blocks, and the windows."""
        inside = starts_inside(ends, block)
        aligned = np.zeros(len(inside), bool)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            aligned[a:b:block] = True
        return mixed(rolling(values, block)) >> np.uint64(16), inside, aligned & inside, starts_inside(ends, window)

    def sampled(prepared):
        prints, inside, aligned, _ = prepared
        keys, counts = np.unique(prints[inside], return_counts=True)
        return np.repeat(keys, np.minimum(counts, 2)), np.unique(prints[aligned])

    def likely(prepared, keys):
        prints, inside, _, whole = prepared
        hit = np.concatenate(([0], np.cumsum(is_in(prints, keys) & inside)))
        at = np.flatnonzero(whole)
        return at[hit[at + window - block + 1] > hit[at]]

    def finish(batch, removed, ends):
        rows, own = [], 0
        for i, copy in zip(batch.first, batch.copy):
            words = batch.texts[i].split()
            if copy:
                gone = np.full(len(words), len(words) >= window)
            else:
                gone, own = removed[ends[own]:ends[own + 1]], own + 1
            n = int(gone.sum())
            kept = words if not n else [w for w, g in zip(words, gone.tolist()) if not g]
            rows.append((len(words), n, spans(gone), b" ".join(kept)))
        rows = [rows[i] for i in batch.of]
        return pa.table({
            "doc_id": pa.array(batch.ids, pa.int64()), "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()),
            "spans": span_array([r[2] for r in rows]), "kept": pa.array([r[3] for r in rows], pa.binary())})

    return resolve(docs, window, word_values, second_word_values, prepare, sampled, likely, finish, ROW, keys_per_byte=0.17, sampled_per_byte=0.17)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
