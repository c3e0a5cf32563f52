"""Queries of the operators that work on whole texts in Arrow batches, with the SQL of the same results where there is one."""

from __future__ import annotations

import sys
import zlib

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import RATE, align_recordings, wav_bytes
from .block_repeats import dedup_blocks
from .language import held_out, language_of, train
from .near_duplicates import near_duplicate_classes
from .registry import query, table
from .suffix_repeats import dedup_suffixes
from .token_files import read_token_files, shard_starts, write_token_files

BLOCK_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - 18)) AS s FROM split WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM runs) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM split),
cut AS (SELECT DISTINCT doc_id, unnest(g) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM words ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op6_block_anchor_dedup", BLOCK_SQL)
def block_anchor_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of repeated runs of 20 words removed from all but their first place."""
    return dedup_blocks(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SUFFIX_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
runs AS (SELECT doc_id, s, substr(h, 2 * s - 1, 200) AS t FROM (SELECT *, unnest(range(1, n - 98)) AS s FROM h WHERE n >= 100)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM runs) WHERE k > 1),
islands AS (SELECT doc_id, s, sum(starts) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM (
    SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS starts FROM later)),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM islands GROUP BY doc_id, i),
edges AS (SELECT doc_id, coalesce(lag(b) OVER w, 1) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, coalesce(x.b, 1), n + 1 FROM h LEFT JOIN (SELECT doc_id, max(b) AS b FROM spans GROUP BY doc_id) x USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a - 1, 2 * (b - a)), '' ORDER BY a) AS k FROM edges JOIN h USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM h JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""


@query("op7_suffix_radix_dedup", SUFFIX_SQL)
def suffix_radix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of repeated strings of 100 bytes removed from all but their first place."""
    return dedup_suffixes(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_token_shards")
def token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents written to indexed binary shards and read back through the index."""
    import public_tokenizers

    files = write_token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    rows, starts = read_token_files(spark, files), shard_starts(spark, files)
    return rows.join(starts, "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


@query("op5_language_codes")
def language_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents from classifiers that saw none of the held-out third."""
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", held_out().alias("held_out"), language_of(train(docs.where(~held_out())), F.col("text")).alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score", "l.ambiguous")


@query("op1_order_minhash_classes")
def order_minhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicate_classes(table(spark, folder, "documents"))


def spoken(text: str | None) -> bytes | None:
    """A conversation as sound: every word is a tone of an eighth of a second whose pitch follows from the word."""
    if text is None:
        return None
    words = text.encode("utf-8", "replace").split()
    pitch = np.array([zlib.crc32(w) % 36 for w in words], np.int64)
    tone = np.arange(512) / RATE * 2 * np.pi
    tones = 0.5 * np.sin(tone[None, :] * (130.8127826502993 * 2 ** (np.arange(36) / 12))[:, None])
    return wav_bytes(tones[pitch].ravel() if len(words) else np.zeros(0))


@query("op9_chroma_fingerprints")
def chroma_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations as recordings, fingerprinted and aligned."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    recordings = said.select(F.col("conv_id").alias("id"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("media"))
    found = align_recordings(recordings, spoken)
    return found.select(F.col("id").alias("conv_id"), (F.octet_length("ints") / 4).cast("long").alias("n_ints"), F.crc32("ints").alias("ints_crc32"),
                        "class_id", "offset", F.round("bit_errors", 6).alias("bit_errors"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
