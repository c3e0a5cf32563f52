"""Language identification with error-correcting output codes.

Every language gets a codeword; for each bit one linear classifier over hashed character n-grams tells the languages with
a 1 from those with a 0. A text is given the language whose codeword loses least: the squared hinge loss of every bit,
weighted by how reliable that bit's classifier was in training. Up to seven languages get the exhaustive code of all
two-way splits; more get seeded random codewords. A text whose two best codewords lie close together is flagged.

Training takes at most `sample` documents, dealt evenly to the languages by the hash of their ids, from the rows that the
caller lets it learn from; everything else covers all rows.

Cases: a null text, or one without a letter, is `und` with score 0 and not ambiguous. Without any labelled row all texts
are `und`; with one language all others get it with score 1. Null doc_ids are documents like others. Labels may repeat and
disagree. An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash60, key_text

SAMPLE = 1600
FEATURES = 1 << 13
ORDERS = 3
UNKNOWN = "und"
RIDGE = 0.05
#: Ratio of the best codeword's loss to the second best's above which a text is ambiguous.
CLOSE = 0.9
RESULT = "lang string, score double, ambiguous boolean"
FITTED_NAMES = ["languages", "code", "weights", "bias", "trust"]
FITTED = "languages array<string>, code binary, weights binary, bias binary, trust binary"

#: ASCII marks and digits count as blanks.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def features(text: str) -> np.ndarray | None:
    """Counts of hashed runs of 1 to ORDERS characters; None if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(points < 128, _FOLD[np.minimum(points, 127)], points)
    if not (points != 32).any() or not any(map(str.isalpha, text)):
        return None
    blank = points == 32
    points = points[~(blank & np.concatenate(([True], blank[:-1])))]
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)])).astype(np.uint32)
    runs, counts = np.zeros(len(points), np.uint32), np.zeros(FEATURES, np.int64)
    for n in range(1, ORDERS + 1):
        runs = (runs[:len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1:] * np.uint32(0x9E3779B1))
        counts += np.bincount((runs ^ (runs >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - 13), minlength=FEATURES)
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts, dtype=np.float32)
    return root / np.linalg.norm(root, axis=-1, keepdims=True)


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """k different rows of +1 and -1."""
    if k == 1:
        return np.ones((1, 0), np.float32)
    if k <= 7:
        bits = np.arange(1, 2 ** (k - 1))
        rest = (bits[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack((np.ones(len(bits)), 1 - 2 * rest)).astype(np.float32)
    generator, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, apart = None, -1
    for _ in range(50):
        code = generator.choice(np.array([-1, 1], np.float32), (k, length))
        gap = int(((length - (code @ code.T)) / 2 + length * np.eye(k)).min())
        if gap > apart and np.abs(code.sum(axis=0)).max() < k:
            best, apart = code, gap
    return best


class Model:
    """languages, their codewords, a weight vector and bias for each bit, and the weight of each bit."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score in 0..1, and whether it is ambiguous, for rows of scaled features."""
        n = len(rows)
        if len(self.languages) == 1:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        margin = rows @ self.weights + self.bias
        loss = (np.square(np.maximum(0, 1 - margin[:, None, :] * self.code[None])) * self.trust).sum(axis=2).astype(np.float64)
        near = np.argsort(loss, axis=1, kind="stable")
        best, second = np.take_along_axis(loss, near[:, :1], 1)[:, 0], np.take_along_axis(loss, near[:, 1:2], 1)[:, 0]
        share = np.exp(-4 * (loss - best[:, None]) / self.trust.sum())
        return near[:, 0], 1 / share.sum(axis=1), best > CLOSE * second


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most about `sample` rows of (doc_id, text, lang). Each also gives a short piece, so that short texts are known."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = sample / len(languages)
    rate = F.element_at(F.create_map(*[x for g in languages for x in (F.lit(g), F.lit(float(share / counts[g])))]), F.col("lang"))
    drawn = labelled.where(hash60(F.lit("language "), key_text("doc_id")) / F.lit(float(2**60)) < rate)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                start = (doc_id or 0) * 7919 % max(1, len(text) - 60)
                for piece in (text, text[start:start + 60]):
                    found = features(piece)
                    if found is not None:
                        at = np.flatnonzero(found)
                        out.append((doc_id, lang, at.astype("<u4").tobytes(), found[at].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([o[0] for o in out], pa.int64()), "lang": pa.array([o[1] for o in out], pa.string()),
                                              "at": pa.array([o[2] for o in out], pa.binary()), "n": pa.array([o[3] for o in out], pa.binary())})

    rows = drawn.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(sparse, "doc_id long, lang string, at binary, n binary")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted([row for batch in batches for row in batch.to_pylist()])
        if model is not None:
            parts = [pa.array([np.asarray(part, "<f4").tobytes()], pa.binary()) for part in (model.code, model.weights, model.bias, model.trust)]
            yield pa.RecordBatch.from_arrays([pa.array([model.languages], pa.list_(pa.string())), *parts], FITTED_NAMES)

    # The sample is bounded, so one task fits it; the driver sees the weights only.
    told = rows.repartition(1).mapInArrow(fit, FITTED).collect()
    if not told:
        return None
    code, weights, bias, trust = (np.frombuffer(told[0][c], "<f4") for c in FITTED_NAMES[1:])
    return Model(told[0]["languages"], code.reshape(len(told[0]["languages"]), -1), weights.reshape(FEATURES, -1), bias, trust)


def fitted(rows: list[dict]) -> Model | None:
    """The classifiers for rows of lang and counts (`at`, `n`), whatever their order."""
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, len(r["at"]), r["at"], r["n"]))
    languages = sorted({r["lang"] for r in rows})
    if not rows:
        return None
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.float32))
    x = np.zeros((len(rows), FEATURES), np.float32)
    y = code[[languages.index(r["lang"]) for r in rows]]
    for i, r in enumerate(rows):  # one matrix, changed in place
        counts = np.sqrt(np.frombuffer(r["n"], "<u4"), dtype=np.float32)
        x[i, np.frombuffer(r["at"], "<u4")] = counts / np.linalg.norm(counts)
    del rows
    middle, bias = x.mean(axis=0), y.mean(axis=0)
    x -= middle
    products = x @ x.T
    products.flat[::len(products) + 1] += np.float32(RIDGE)
    solved = np.linalg.solve(products, y - bias)
    del products
    weights = (x.T @ solved).astype(np.float32)
    right = (np.sign(x @ weights + bias) == y).mean(axis=0)
    return Model(languages, code, weights, (bias - middle @ weights).astype(np.float32), np.maximum(0.05, 2 * right - 1).astype(np.float32))


def language_of(model: Model | None, text: Column) -> Column:
    """A struct of lang, score and ambiguous for every text."""
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n = len(texts)
            lang, score, close = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
            held, at = [], []
            for i, text in enumerate(texts.tolist()):
                found = features(text) if text and model else None
                if found is not None:
                    held.append(scaled(found))
                    at.append(i)
                if held and (len(held) == 256 or i == n - 1):
                    near, score[at], close[at] = model.decode(np.array(held))
                    lang[at] = np.array(model.languages, object)[near]
                    held, at = [], []
            if held:
                near, score[at], close[at] = model.decode(np.array(held))
                lang[at] = np.array(model.languages, object)[near]
            yield pd.DataFrame({"lang": lang, "score": score, "ambiguous": close})

    return F.pandas_udf(predict, RESULT)(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
