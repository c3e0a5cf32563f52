"""Ranked lexical search, term at a time with a limit on accumulators.

The queries are items of texts. Documents lie in shards of bounded size, each with its postings (terms by document and
documents by term). A shard takes an item's terms rarest first. A posting of a document not met before makes an
accumulator for it, until the sum of the largest contributions that the remaining terms can give is below the k-th best
partial score: from there on a new document could no longer come among the best k, so no accumulator is made any more, and
the survivors alone are updated through all remaining terms, exactly. The k-th best score of a task's earlier shards
counts as well. The best k of all shards then meet in two rounds of k per group, so no task sees a hot item's rows at once.

Scores are integers throughout; only a term's weight goes through a logarithm. Documents are counted, weighed and searched
whole. Items are taken in blocks of bounded vocabulary, which is all that goes to the driver and to each task.

Cases: a null or empty text has no terms, counts for nothing and is found by nothing; an item without terms finds nothing.
Items that share an item_id are one item with the terms of all of them. Rows that share a doc_id are documents of their
own; a null doc_id comes before all others among equal scores. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import sys
import uuid
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import cut_lineage, shared_folder

BEST = 50
#: Terms of items that one block holds, on average, and postings of one shard.
BLOCK_TERMS = 500_000
SHARD_POSTINGS = 1 << 20
CHUNK = 4 << 20
#: Tasks whose best rows meet in the first of the two rounds.
FAN_IN = 64
#: ASCII letters in lower case, digits and bytes beyond ASCII make up terms; all other bytes are breaks.
TERM_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SHARD = ("part int, n_docs long, n_terms long, df array<long>, doc_ids array<long>, sizes array<long>, ends array<long>, "
         "terms binary, counts binary")
FOUND = "part int, item int, doc_id long, score long"


def count_terms(text: bytes) -> Counter:
    """How often each term occurs. A long text is cut at breaks, so that few of its terms are held at once."""
    if len(text) <= CHUNK:
        return Counter(text.translate(TERM_BYTES).split())
    out, a = Counter(), 0
    while a < len(text):
        b = min(a + CHUNK, len(text))
        while b < len(text) and TERM_BYTES[text[b]] != 0x20:
            b += 1
        out.update(text[a:b].translate(TERM_BYTES).split())
        a = b
    return out


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct) of the items that have terms."""
    def take(batches):
        for batch in batches:
            terms = [list(count_terms(t or b"")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), "terms": pa.array(terms, pa.list_(pa.binary()))})

    kind = items.schema["item_id"].dataType.simpleString()
    split = items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(take, f"item_id {kind}, terms array<binary>")
    return split.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)


def write_shards(docs: DataFrame, vocabulary: dict[bytes, int], folder: str) -> None:
    """The postings of the vocabulary in all documents, in shards, and a row of counts for each task."""
    def build(batches):
        part, df, totals = TaskContext.get().partitionId(), np.zeros(len(vocabulary), np.int64), [0, 0]
        ids, sizes, ends, terms, counts = [], [], [], array("i"), array("q")

        def shard():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "n_docs": pa.array([0], pa.int64()), "n_terms": pa.array([0], pa.int64()), "df": pa.array([None], pa.list_(pa.int64())),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.int64())),
                "terms": pa.array([np.asarray(terms, "<i4").tobytes()], pa.binary()), "counts": pa.array([np.asarray(counts, "<i8").tobytes()], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                met = count_terms(text.as_py() or b"")
                if not met:
                    continue
                size = met.total()
                totals[0] += 1
                totals[1] += size
                own = {vocabulary[t]: n for t, n in met.items() if t in vocabulary}
                if not own:
                    continue
                terms.extend(own.keys())
                counts.extend(own.values())
                ids.append(doc_id.as_py())
                sizes.append(size)
                ends.append(len(terms))
                if len(terms) >= SHARD_POSTINGS:
                    df += np.bincount(np.asarray(terms), minlength=len(df))
                    yield shard()
                    ids, sizes, ends, terms, counts = [], [], [], array("i"), array("q")
        if terms:
            df += np.bincount(np.asarray(terms), minlength=len(df))
            yield shard()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "n_docs": pa.array([totals[0]], pa.int64()), "n_terms": pa.array([totals[1]], pa.int64()), "df": pa.array([df.tolist()], pa.list_(pa.int64())),
            **{name: pa.array([None], pa.list_(pa.int64())) for name in ("doc_ids", "sizes", "ends")}, **{name: pa.array([None], pa.binary()) for name in ("terms", "counts")}})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows.mapInArrow(build, SHARD).write.option("compression", "zstd").parquet(folder)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Contributions of all postings of one shard, by document and by term."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = np.array([0 if i is None else i for i in row["doc_ids"]], np.int64)
        self.known = np.array([i is not None for i in row["doc_ids"]], bool)
        self.ends = np.array(row["ends"], np.int64)
        self.terms, counts = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["counts"], "<i8")
        norm = np.array([50 + 50 * size * n_docs // n_terms for size in row["sizes"]], np.int64)  # Python's integers do not overflow
        doc = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        self.gain = weights[self.terms] * (1_000_000_000 * counts // (1000 * counts + 20 * norm[doc]))
        order = np.argsort(self.terms, kind="stable")
        self.doc_of, self.gain_of = doc[order], self.gain[order]
        self.begin = np.searchsorted(self.terms[order], np.arange(len(weights) + 1))
        self.peak = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.begin))
        if len(held):
            self.peak[held] = np.maximum.reduceat(self.gain_of, self.begin[held])

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begin[term], self.begin[term + 1]
        return self.doc_of[a:b], self.gain_of[a:b]

    def update(self, score: np.ndarray, survivors: np.ndarray, rest: np.ndarray) -> None:
        """Add all that the terms of `rest` give the survivors, through their own postings or those of the terms, whichever are fewer."""
        begin = np.concatenate(([0], self.ends))[survivors]
        sizes = self.ends[survivors] - begin
        if sizes.sum() > (self.begin[rest + 1] - self.begin[rest]).sum():
            for term in rest.tolist():
                docs, gain = self.postings(term)
                score[docs] += gain  # others than survivors are not looked at again
            return
        wanted = np.zeros(len(self.peak), bool)
        wanted[rest] = True
        upto = np.cumsum(sizes)
        at = np.arange(int(upto[-1])) + np.repeat(begin - (upto - sizes), sizes)
        gained = np.concatenate(([0], np.cumsum(np.where(wanted[self.terms[at]], self.gain[at], 0))))
        score[survivors] += gained[upto] - gained[upto - sizes]


def search_shard(shard: Shard, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the shard) that may be among the best k, and their exact scores. `terms` are rarest first;
    `least` is a score that k documents elsewhere have reached."""
    remaining = np.concatenate((np.cumsum(shard.peak[terms][::-1])[::-1], [0]))
    score, met = np.zeros(len(shard.ends), np.int64), np.zeros(len(shard.ends), bool)
    created, n, stop = [], 0, len(terms)
    for j, term in enumerate(terms.tolist()):
        bar = least
        if n >= k and remaining[j] < score.max():  # the k-th best is worth finding only then
            have = score[np.concatenate(created)]
            bar = max(bar, int(np.partition(have, n - k)[n - k]))
        if remaining[j] < bar:
            stop = j
            break
        docs, gain = shard.postings(term)
        score[docs] += gain
        fresh = docs[~met[docs]]
        if len(fresh):
            met[fresh] = True
            created.append(fresh)
            n += len(fresh)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    survivors = np.sort(np.concatenate(created))
    if stop < len(terms):
        shard.update(score, survivors, terms[stop:])
    return survivors, score[survivors]


def best_of(score: np.ndarray, known: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best by score, then doc_id, null first."""
    if len(score) > k:
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, known, ids = score[keep], known[keep], ids[keep]
    order = np.lexsort((ids, known, -score))[:k]
    return score[order], known[order], ids[order]


def top_rows(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of every item, in two rounds."""
    by_score = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    rows = rows.withColumn("group", F.floor(F.col("part") / FAN_IN))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*by_score))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by_score))).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """item (its number in the block), rank, doc_id, score for one block of items."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    folder = f"{shared_folder(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    write_shards(docs, vocabulary, folder)
    shards = spark.read.schema(SHARD).parquet(folder)
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    by_term = shards.where("df IS NOT NULL").select(F.posexplode("df").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n"))
    for row in by_term.collect():  # bounded by the block's vocabulary
        df[row["term"]] = row["n"]
    weights = np.array([term_weight(n_docs, n) for n in df.tolist()], np.int64)
    rarest = [np.array(sorted((vocabulary[t] for t in terms), key=lambda i: (df[i], i)), np.int64) for _, terms in items]

    def search(batches):
        part, best = TaskContext.get().partitionId(), {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], weights, n_docs, n_terms)
                for item, terms in enumerate(rarest):
                    had = best.get(item)
                    least = int(had[0][-1]) if had is not None and len(had[0]) == k else 0
                    at, score = search_shard(shard, terms, k, least)
                    good = score > 0
                    at, score = at[good], score[good]
                    if len(at):
                        new = score, shard.known[at], shard.ids[at]
                        best[item] = best_of(*(new if had is None else map(np.concatenate, zip(had, new))), k)
        for item, (score, known, ids) in best.items():
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(score), part, np.int32)), "item": pa.array(np.full(len(score), item, np.int32)),
                "doc_id": pa.array(ids, mask=~known), "score": pa.array(score)})

    return top_rows(shards.where("df IS NULL").mapInArrow(search, FOUND), k).select("item", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for every item its k best documents with a score above 0."""
    spark = docs.sparkSession
    terms = cut_lineage(item_terms(items))
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    kind = items.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks if total else 0):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        if own:
            pairs = [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in own]
            names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], f"item int, item_id {kind}")
            rows = search_block(docs, pairs, k).join(F.broadcast(names), "item")  # one row for each item of the block
            found = found.unionByName(rows.select("item_id", "rank", "doc_id", "score"))
    return found


cloudpickle.register_pickle_by_value(sys.modules[__name__])
