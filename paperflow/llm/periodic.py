"""Runs of repeated words: all maximal stretches of a text that repeat with a period.

Longest common extensions of two places decide everything. Only suffixes that start at places of a difference cover modulo
31 are sorted: by their first 31 words, then by doubling ranks of such blocks. The words that neighbours in that order
share, and a sparse table of range minima over them, answer any two cover places at once. For any other two places the
cover has one shift below 31 that brings both into it; so at most 30 words are compared one by one before the table
answers. The same over the reversed text extends to the left.

Runs are met on a harmonic grid: a run of period p and at least 2p words holds two grid places p apart, with the grid 0,
p, 2p, ..., so for each p the n / p neighbouring grid places whose words agree are extended both ways. A run is also met
with multiples of its period, over the same words; the least period is kept. The work is n log n for a text of n words.
Several texts are handled as one sequence with a word of its own after each, so that nothing extends beyond a text.

Cases: a null or empty text has no words and no runs. Rows are treated one by one, so repeated rows, shared or null doc_ids
change nothing. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A perfect difference set, whose differences are every number below 31 once.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)
LEAST_LENGTH = 12
#: Bytes of text that are handled as one sequence, and pairs of places extended at once.
CHUNK = 1 << 20
PAIRS = 1 << 18
ROW = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary"


def shifts() -> np.ndarray:
    """For two residues the least shift that brings both into the cover."""
    inside = np.zeros(MODULUS, bool)
    inside[list(COVER)] = True
    step = np.arange(MODULUS)
    both = inside[(step[:, None, None] + step) % MODULUS] & inside[(step[None, :, None] + step) % MODULUS]
    return both.argmax(axis=2)


class Extensions:
    """Longest common extensions within one sequence of numbers that ends with a number of its own."""

    def __init__(self, words: np.ndarray):
        n, top = len(words), int(words.max()) + 1
        self.shift = shifts()
        self.words = np.concatenate((words, np.arange(top, top + 2 * MODULUS)))  # past the end nothing is equal
        self.base = np.zeros(MODULUS, np.int64)
        places = []
        for residue in COVER:
            self.base[residue] = sum(map(len, places))
            places.append(np.arange(residue, n, MODULUS))
        place = np.concatenate(places)
        levels = self.ranks(place, top + 2 * MODULUS, n)
        order = np.argsort(levels[-1], kind="stable")
        self.rank = np.empty(len(place), np.int64)
        self.rank[order] = np.arange(len(place))
        self.table = [self.shared(order[:-1], order[1:], levels, place)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            width = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))

    def ranks(self, place: np.ndarray, top: int, n: int) -> list[np.ndarray]:
        """Ranks of the cover suffixes by their first 1, 2, 4, ... blocks, until all differ."""
        bits = max(1, int(top).bit_length())
        each = max(1, 63 // bits)
        keys = []
        for a in range(0, MODULUS, each):
            key = np.zeros(len(place), np.int64)
            for t in range(a, min(a + each, MODULUS)):
                key = (key << bits) | self.words[place + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(place), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        levels, blocks = [], 1
        while True:
            rank = np.empty(len(place), np.int64)
            rank[order] = np.cumsum(new)
            levels.append(rank)
            if not len(place) or int(rank.max()) == len(place) - 1 or blocks * MODULUS >= n:
                return levels
            ahead = np.full(len(place), -1, np.int64)
            inside = np.flatnonzero(place + blocks * MODULUS < n)
            ahead[inside] = rank[inside + blocks]
            key = rank * (len(place) + 1) + ahead + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
            blocks *= 2

    def shared(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """How many words neighbours in the order share: whole blocks by their ranks, the rest word by word."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            out[same] += MODULUS << k
            a[same] += 1 << k
            b[same] += 1 << k
        alive, i, j = np.arange(len(a)), place[a], place[b]
        for t in range(MODULUS):
            alive = alive[self.words[i[alive] + t] == self.words[j[alive] + t]]
            if not len(alive):
                break
            out[alive] += 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The words that follow both places alike, for places i < j."""
        shift, out = self.shift[i % MODULUS, j % MODULUS], np.zeros(len(i), np.int64)
        alive, synchronised = np.arange(len(i)), []
        for t in range(MODULUS):
            there = shift[alive] == t
            if there.any():
                synchronised.append(alive[there])
                alive = alive[~there]
            if not len(alive):
                break
            alive = alive[self.words[i[alive] + t] == self.words[j[alive] + t]]
            out[alive] += 1
        met = np.concatenate(synchronised or [alive])
        if len(met):
            a, b = i[met] + shift[met], j[met] + shift[met]
            a, b = self.rank[self.base[a % MODULUS] + a // MODULUS], self.rank[self.base[b % MODULUS] + b // MODULUS]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.log2(high - low).astype(np.int64)  # exact for powers of two below 2**48
            least = np.zeros(len(met), np.int64)
            for k in np.unique(level).tolist():
                own = level == k
                least[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
            out[met] += least
        return out


def least_periods(rows: np.ndarray) -> np.ndarray:
    """Of the rows (start, end, period) with the same words the one with the least period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def find_runs(words: np.ndarray, longest: int, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period; `longest` is the length of the longest text inside."""
    n = len(words)
    if longest < least:
        return np.zeros((0, 3), np.int64)
    ahead, back = Extensions(words), Extensions(np.concatenate((words[-2::-1], words[-1:])))
    found, places, periods, waiting = [], [], [], 0

    def extend():
        i, p = np.concatenate(places), np.concatenate(periods)
        right, left = ahead(i, i + p), np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        # Place k of the sequence is place n - 2 - k of the reversed one, whose last word is the same end.
        left[inner] = back(n - 1 - i[inner] - p[inner], n - 1 - i[inner])
        good = right + left >= np.maximum(p, least - p)
        found.append(least_periods(np.stack((i - left, i + p + right, p), axis=1)[good]))

    for p in range(1, longest // 2 + 1):
        grid = words[::p]
        at = np.flatnonzero(grid[1:] == grid[:-1]) * p
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), p))
            waiting += len(at)
        if waiting > PAIRS:
            extend()
            places, periods, waiting = [], [], 0
    if places:
        extend()
    rows = least_periods(np.concatenate(found or [np.zeros((0, 3), np.int64)]))
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(sizes: list[int]) -> list[list[int]]:
    """Texts of similar length together, about CHUNK bytes at a time, one at least."""
    out, own, total = [], [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if own and total + sizes[i] > CHUNK:
            out.append(own)
            own, total = [], 0
        own.append(i)
        total += sizes[i]
    return [*out, own] if own else out


def runs_of(texts: list[bytes], least: int) -> list[tuple[int, np.ndarray, bytes]]:
    """Number of words, runs (start, length, period) and kept words of each text."""
    split = [t.split() for t in texts]
    index: dict[bytes, int] = {}
    for words in split:
        for w in words:
            if w not in index:
                index[w] = len(index)
    sizes = np.array([len(words) for words in split], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    sequence = np.empty(int(sizes.sum()) + len(split), np.int64)
    for k, words in enumerate(split):
        a = int(begin[k])
        sequence[a:a + len(words)] = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        sequence[a + len(words)] = len(index) + k
    rows = find_runs(sequence, int(sizes.max()), least)
    bounds = np.searchsorted(rows[:, 0], np.concatenate((begin, [len(sequence)])))
    out = []
    for k, words in enumerate(split):
        own = rows[bounds[k]:bounds[k + 1]].copy()
        kept = words
        if len(own):
            own[:, :2] -= begin[k]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 1], -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
            own[:, 1] -= own[:, 0]
        out.append((len(words), own, b" ".join(kept)))
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and kept: the words joined by a space
    without those that a run holds after its first period. A run has at least `least` words and two periods."""
    def find(batches):
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            texts = batch.column("text")
            for own in stretches([len(t.as_py() or b"") for t in texts]):
                done = runs_of([texts[i].as_py() or b"" for i in own], least)
                flat = np.concatenate([rows for _, rows, _ in done])
                cut = np.cumsum([0, *(len(rows) for _, rows, _ in done)]).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(kind))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(own)), "n_words": pa.array([n for n, _, _ in done], pa.int64()),
                    "runs": pa.ListArray.from_arrays(pa.array(cut), fields), "kept": pa.array([kept for _, _, kept in done], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(find, ROW)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
