"""Queries of packing, ranked search and periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import pack_documents
from .periodic import periodic_runs
from .registry import query, table
from .search import search_documents


@query("op11_best_two_fit")
def best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    packed = pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


SEARCH_SQL = r"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM cut WHERE len(w) > 0),
held AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM cut) GROUP BY ALL),
weighed AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM held, totals GROUP BY t, n_docs),
gains AS (SELECT r, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS gain FROM held JOIN weighed USING (t), totals),
scored AS (SELECT item_id, r, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (t) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
FROM scored QUALIFY rank <= 50"""


@query("op12_limited_accumulators", SEARCH_SQL)
def limited_accumulators(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents for every item of the benchmark."""
    return search_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def looped(doc_id: Column, words: Column) -> Column:
    """The words as the contract has them: in a tenth of the documents, told by the hash of doc_id, they go round from some place on."""
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    round_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i)))
    return F.when((h % 10 == 0) & (n > 0), round_).otherwise(words)


@query("op13_cover_runs")
def cover_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of all documents and the words that stay without them."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = table(spark, folder, "documents").select("doc_id", words.alias("words"))
    found = periodic_runs(docs.select("doc_id", F.array_join(looped(F.col("doc_id"), F.col("words")), " ").alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", (-F.col("best.less")).alias("length"), "best.period",
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"))
