"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered only through 100 bytes, most significant digit first, with two digits of 50 bytes; the order of a
digit is that of its fingerprint. A pass keeps the groups of at least two suffixes, and after the last pass equal groups
are the repeated windows, told by 96 bits of fingerprints. The first pass sorts one suffix for each window, the one with the least first digit
among the 51 that start in it with a whole digit: equal windows choose equal suffixes, so a window whose suffix is alone
is unique, and about one suffix in 25 is sorted. The second pass sorts what is left through the full depth.

Cases: a null text is empty. Rows equal in doc_id and text are one document and get the same row each. Rows that share
only the doc_id follow one another in the order of their texts; a null doc_id is before all others. Texts of fewer than
100 bytes lose nothing. What is kept may end inside a character, so it is binary. An empty table gives no rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .arrays import is_in, mixed, rolling, window_extreme
from .repeats import resolve, span_array, spans, starts_inside

DEPTH, DIGIT = 100, 50
ROW = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary"


def byte_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def dedup_suffixes(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (in bytes) that were removed, kept (the other bytes)."""
    width = depth - digit + 1

    def prepare(values, ends):
        """First digits, the least of each window, the windows inside a document, and the suffixes that some window chose."""
        prints = rolling(values, digit)
        inside, minima = starts_inside(ends, depth), window_extreme(prints, width, np.minimum)
        if not len(minima):
            return prints, minima, inside, np.zeros(0, np.int64)
        room = np.zeros(width - 1, np.uint64)
        best = window_extreme(np.concatenate((room, np.where(inside, minima, np.uint64(0)), room)), width, np.maximum)
        return prints, minima, inside, np.flatnonzero((best == prints) & (best > 0))

    def sampled(prepared):
        prints, _, _, chosen = prepared
        keys, counts = np.unique(mixed(prints[chosen]) >> np.uint64(16), return_counts=True)
        return np.repeat(keys, np.minimum(counts, 2)), None

    def likely(prepared, keys):
        prints, minima, inside, chosen = prepared
        at = chosen[is_in(mixed(prints[chosen]) >> np.uint64(16), keys)]
        if not len(at):
            return at
        marked = np.zeros(len(prints), np.uint64)
        marked[at] = ~prints[at]
        return np.flatnonzero((window_extreme(marked, width, np.maximum) == ~minima) & inside)

    def finish(batch, removed, ends):
        rows, own = [], 0
        for i, copy in zip(batch.first, batch.copy):
            text = np.frombuffer(batch.texts[i], np.uint8)
            if copy:
                gone = np.full(len(text), len(text) >= depth)
            else:
                gone, own = removed[ends[own]:ends[own + 1]], own + 1
            n = int(gone.sum())
            rows.append((len(text), n, spans(gone) if n else ([], []), text[~gone].tobytes() if n else batch.texts[i]))
        rows = [rows[i] for i in batch.of]
        return pa.table({
            "doc_id": pa.array(batch.ids, pa.int64()), "n_bytes": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()),
            "spans": span_array([r[2] for r in rows]), "kept": pa.array([r[3] for r in rows], pa.binary())})

    return resolve(docs, depth, byte_values, lambda texts, values: values, prepare, sampled, likely, finish, ROW, keys_per_byte=0.25, sampled_per_byte=0.05)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
