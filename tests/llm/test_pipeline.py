"""The pipeline's stages on the smallest tables, each against a plain reading of its decision, and on odd documents."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from .conftest import FOLDER, frame
from .test_native import brute_contamination
from .test_texts import classes_by_brute_force


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    language = pipeline.identify_language(spark, docs, FOLDER)
    assert language.columns == docs.columns and {r.doc_id for r in language.collect()} == {i for i, r in rows.items() if any(map(str.isalpha, r.text or ""))}

    near = pipeline.drop_near_duplicates(spark, docs, FOLDER)
    classes = classes_by_brute_force([(i, r.text, None) for i, r in rows.items()])
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == sorted(set(classes.values()))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = pipeline.drop_contaminated(spark, docs, FOLDER)
    judged = brute_contamination([(i, r.text, None) for i, r in rows.items()], items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(j[0] for j in judged if not j[4])

    last = pipeline.shard(spark, docs, FOLDER)
    assert last.columns == [*docs.columns, "shard", "slot"] and last.count() == len(rows)


def test_run_and_odd_documents(spark, tmp_path):
    whole = pipeline.run(spark, FOLDER)
    assert whole.columns[-2:] == ["shard", "slot"] and whole.count() > 100
    odd = [(1, None, "a"), (2, "", "a"), (3, "one two three", None), (3, "one two three", None), (3, "another text", None), (None, "no id here", "b"), (None, "no id here", "b"), (5, "one two three", "a")]
    docs = frame(spark, odd).withColumn("lang", F.lit("en"))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    empty = frame(spark, [])
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
        assert empty.count() == 0
