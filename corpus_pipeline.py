"""From raw documents to training shards, in five stages over whole tables.

Each stage takes all documents its predecessor kept and returns documents with the same columns; the last adds shard and
slot. Every stage is written as Parquet and read again before the next one starts, so a lost executor or a restart costs
one stage at most.

Decisions and cases: language identification rejects texts without a letter and texts that no language's codeword comes
near; of each near-duplicate class the least doc_id stays, and of rows that share a doc_id the one with the least text
hash; rows without doc_id are never dropped as duplicates; contaminated documents are dropped; mixing repeats or drops
documents by their source's rate. An empty table passes through all stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperflow.llm.common import packed
from paperflow.llm.decontamination import decontaminate
from paperflow.llm.language import UNKNOWN, language_of, train
from paperflow.llm.mixing import mix
from paperflow.llm.near_duplicates import near_duplicate_classes
from paperflow.llm.sharding import shard_documents
from paperflow.scale import shared_folder

#: With K languages a text that tells nothing scores 1 / K; a text below this score is in no known language.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised, by classifiers fitted on a bounded sample of the labelled rows."""
    found = docs.withColumn("_language", language_of(train(docs), F.col("text")))
    known = (F.col("_language.lang") != UNKNOWN) & (F.col("_language.score") >= LEAST_SCORE)
    return found.where(known).drop("_language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    heads = near_duplicate_classes(docs).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_head")).distinct()
    rows = docs.select(packed(docs).alias("doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_t"))
    kept = rows.where(F.col("_id").isNotNull()).join(heads, F.col("_id") == F.col("_head"))
    one = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("_t"))).where("_n = 1")
    return one.select("doc.*").unionByName(rows.where(F.col("_id").isNull()).select("doc.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that quote the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources come to their target weights."""
    return mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents to eight shards of the same mixture."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_contaminated", drop_contaminated),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Language models and sketches are outside SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs, home = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{home}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
