"""Array functions on UTF-8 bytes and word hashes: rolling fingerprints, window minima, packed sets of fingerprints."""

from __future__ import annotations

import sys
from hashlib import blake2b

import numpy as np
from pyspark import TaskContext, cloudpickle

SEGMENT = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SECOND = 0xD1B54A32D192ED03
#: Bytes up to which a word's fingerprint is a polynomial. Sums modulo 2**64 with odd factors have long inputs that collide
#: whatever the factors (a Thue-Morse word and its mirror), so longer words are hashed by BLAKE2b.
POLYNOMIAL_BYTES = 64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: White space as a break, all other bytes as they are.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[[0x20, *range(0x09, 0x0E)]] = 0
SPACED[0] = 0x20  # a code that no other byte has
#: ASCII letters in lower case, digits and all bytes beyond ASCII; the rest breaks words.
PLAIN = np.array([b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 0x80 else 0 for b in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
#: For a second fingerprint that is independent of the first.
SECOND_VALUES = mixed(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(_SECOND))


def _powers(n: int, multiplier: int = _MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64."""
    kept = _POWERS if TaskContext.get() else {}  # on the driver nothing is kept, for it would be sent with each function
    if multiplier not in kept or len(kept[multiplier][0]) < n:
        rows = []
        for base in (multiplier, pow(multiplier, -1, 1 << 64)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            rows.append(np.multiply.accumulate(row))
        kept[multiplier] = rows[0], rows[1]
    up, down = kept[multiplier]
    return up[:n], down[:n]


def rolling(values: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """Fingerprints of all runs of `length` values (bytes or 64-bit numbers), in segments so that memory stays bounded."""
    of_byte, multiplier = (SECOND_VALUES, _SECOND) if second else (BYTE_VALUES, _MULTIPLIER)
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, SEGMENT):
        b = min(a + SEGMENT, n)
        part = values[a:b + length - 1]
        up, down = _powers(len(part) + 1, multiplier)
        terms = (of_byte[part] if part.dtype == np.uint8 else part) * up[:len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        np.multiply(total[length:] - total[:-length], down[:b - a], out=out[a:b])
    return out


def word_spans(buf: np.ndarray, table: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and fingerprints of the words of one buffer; bytes that `table` maps to 0 are breaks."""
    of_byte, multiplier = (SECOND_VALUES, _SECOND) if second else (BYTE_VALUES, _MULTIPLIER)
    starts, ends, prints = [], [], []
    a, n = 0, len(buf)
    while a < n:
        b = min(a + SEGMENT, n)
        while b < n and table[buf[b - 1]]:  # a word is not cut
            step = np.flatnonzero(table[buf[b:b + SEGMENT]] == 0)
            b = b + int(step[0]) + 1 if len(step) else min(b + SEGMENT, n)
        code = table[buf[a:b]]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], code != 0, [0])).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        up, down = _powers(len(code) + 1, multiplier)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(of_byte[code] * up[:len(code)], out=total[1:])
        found = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        for k in np.flatnonzero(e - s > POLYNOMIAL_BYTES).tolist():
            found[k] = int.from_bytes(blake2b(code[s[k]:e[k]].tobytes(), digest_size=8, person=b"second" if second else b"first").digest(), "little")
        prints.append(found)
        starts.append(s + a)
        ends.append(e + a)
        a = b
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), mixed(np.concatenate(prints))


def window_extreme(x: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every run of `width` values, from running extremes of blocks forwards and backwards."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    fill = np.array(np.iinfo(x.dtype).max if ufunc is np.minimum else np.iinfo(x.dtype).min, x.dtype)
    out = np.empty(n, x.dtype)
    step = max(width, SEGMENT // width * width)
    for a in range(0, n, step):
        b = min(a + step, n)
        part = x[a:b + width - 1]
        blocks = -(-len(part) // width)
        block = np.full(blocks * width, fill, x.dtype)
        block[:len(part)] = part
        block = block.reshape(blocks, width)
        ahead = ufunc.accumulate(block, axis=1).ravel()
        back = ufunc.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        ufunc(back[:b - a], ahead[width - 1:width - 1 + b - a], out=out[a:b])
    return out


def deal(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Bounds of the `parts` equal ranges of `bits`-bit numbers within sorted keys."""
    width = -(-(1 << bits) // parts)
    lower = np.array([min(i * width, (1 << bits) - 1) for i in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, lower), [len(keys)])).astype(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences in byte planes; the planes of zeros cost next to nothing once compressed."""
    if not len(keys):
        return b""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def is_in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the sorted `wanted`."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


# Workers get this module with the functions that use it, also where the package is not installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
