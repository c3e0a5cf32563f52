"""File readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import catalog as C
from .. import schemas
from ..scale import cut_lineage, first_by


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The 31-column registry; an empty cell is null."""
    return spark.read.csv(path, header=True, schema=schemas.REGISTRY, nullValue="", enforceSchema=False)


def write_registry_csv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """The 31 headers in order. One file only on request, since it is written by one task."""
    out = rows.select(*[F.col(f"`{h}`") for h in C.EXPORT_HEADERS])
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(
        path, header=True, nullValue="", emptyValue="", lineSep="\n")


def read_drafts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(drafts, rejected rows with the text that could not be read). One JSON document per line."""
    schema = StructType.fromDDL(f"document_id string, {schemas.DRAFT}, _corrupt string")
    # Parsed once: both results come from the stored rows. Blank lines are neither.
    rows = cut_lineage(spark.read.text(path).where(F.trim("value") != "").select(
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d")))
    return (rows.where(F.col("d._corrupt").isNull()).select("d.*").drop("_corrupt"),
            rows.where(F.col("d._corrupt").isNotNull()).select(F.col("d._corrupt").alias("text"), F.lit("MALFORMED").alias("error")))


def read_webhooks(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """S3: one envelope per line, with its arrival time."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").schema("value string").load(path) if streaming else reader.text(path)
    return parse_webhooks(lines, "value")


def parse_webhooks(lines: DataFrame, column: str) -> DataFrame:
    return lines.withColumn("envelope", F.from_json(column, schemas.WEBHOOK))


def read_state(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One state table with its declared types."""
    return spark.read.schema(schemas.STATE[name]).parquet(f"{folder}/{name}")


def write_state(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """Columns are cast to the declared types, so a reader always finds the same table."""
    declared = StructType.fromDDL(schemas.STATE[name])
    df.select(*[F.col(f.name).cast(f.dataType) for f in declared]).write.mode(mode).parquet(f"{folder}/{name}")


def audit_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest (path, bytes, sha256) against files (path, bytes, sha256): MISSING, SIZE, HASH, EXTRA or OK."""
    want = manifest.select("path", F.col("bytes").alias("want_bytes"), F.lower("sha256").alias("want_sha256"))
    have = files.select("path", F.col("bytes").alias("have_bytes"), F.lower("sha256").alias("have_sha256"))
    return want.join(have, "path", "full_outer").select(
        "path", F.when(F.col("have_bytes").isNull(), "MISSING").when(F.col("want_bytes").isNull(), "EXTRA")
        .when(F.col("have_bytes") != F.col("want_bytes"), "SIZE")
        .when(F.col("have_sha256") != F.col("want_sha256"), "HASH").otherwise("OK").alias("state"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder with their size and digest."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.regexp_replace(F.col("path"), "^file:/*", "/")
    return found.select(F.replace(base, F.lit(folder.rstrip("/") + "/"), F.lit("")).alias("path"),
                        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def media_problem(content: Column, suffix: Column) -> Column:
    """Why bytes are not an accepted photo, or null."""
    jpeg = F.hex(F.substring(content, 1, 3)) == "FFD8FF"
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    kind = F.lower(suffix)
    return (F.when(content.isNull() | (F.length(content) == 0), "EMPTY").when(F.length(content) > C.MAX_MEDIA_BYTES, "TOO_LARGE")
            .when(~kind.isin(".jpg", ".jpeg", ".png"), "SUFFIX")
            .when(kind.isin(".jpg", ".jpeg") & ~jpeg, "MAGIC").when((kind == ".png") & ~png, "MAGIC"))


def store_media_refs(media: DataFrame, content: str = "content", suffix: str = "suffix", key: str = "media_id") -> tuple[DataFrame, DataFrame]:
    """(accepted rows with a content-addressed ref, one stored row per distinct content). Base64 text is decoded."""
    is_text = dict(media.dtypes)[content] == "string"
    data = media.withColumn(content, F.try_to_binary(F.col(content), F.lit("base64"))) if is_text else media
    checked = data.withColumn("reject_reason", media_problem(F.col(content), F.col(suffix)))
    ending = F.when(F.lower(suffix) == ".png", ".png").otherwise(".jpg")
    refs = checked.withColumn("media_ref", F.when(
        F.col("reject_reason").isNull(), F.concat(F.sha2(content, 256), ending)))
    # Keep the content out of the shuffle: pick one row per digest by key, then fetch its bytes.
    keep = first_by(refs.where("media_ref IS NOT NULL").select("media_ref", key), ["media_ref"], [key])
    stored = refs.join(keep, ["media_ref", key], "left_semi").select("media_ref", content)
    return refs.drop(content), stored


def read_truth(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Ground-truth pages, flattened to one row per cell, key or extended item.

    A page row holds page, patient, split, layout, expected_section, supported, the maps `grid` and `labs` (slot -> row ->
    cell), `keys` and `document_fields` (field -> cell) and the array `extended`. One page per line, or with `nested` one
    object with a `pages` array per file.
    """
    cell = "state:string,text:string,canonical:string,value:string,sha256:string,accept:array<string>"
    page = ("page:int,patient:int,split:string,layout:string,expected_section:string,supported:boolean,"
            f"visit_slots:array<string>,grid:map<string,map<string,struct<{cell}>>>,labs:map<string,map<string,struct<{cell}>>>,"
            f"keys:map<string,struct<{cell}>>,document_fields:map<string,struct<{cell}>>,"
            f"extended:array<struct<section:string,item:string,field:string,{cell}>>")
    if nested:
        whole = spark.read.json(path, multiLine=True, schema=f"pages array<struct<{page}>>")
        return flatten_truth(whole.select(F.explode("pages").alias("p")).select("p.*"))
    return flatten_truth(spark.read.text(path).select(F.from_json("value", f"struct<{page}>").alias("p")).select("p.*"))


def flatten_truth(pages: DataFrame) -> DataFrame:
    head = ["page", "patient", "split", "layout", "expected_section", "supported"]

    def rows(frame, slot, section, item, field, cell):
        return frame.select(*head, slot.alias("slot"), section.alias("section"), item.alias("item"), field.alias("field"),
                            cell["state"].alias("state"), cell["text"].alias("text"), cell["canonical"].alias("canonical"),
                            cell["value"].alias("choice"), cell["sha256"].alias("sha256"), cell["accept"].alias("accept"))

    null = F.lit(None).cast("string")
    parts = []
    for name, section in (("grid", "encounter"), ("labs", "visit_labs")):
        by_slot = pages.select("*", F.explode(name).alias("_slot", "_cells")).select("*", F.explode("_cells").alias("_field", "_cell"))
        item = F.col("_slot") if name == "labs" else null
        parts.append(rows(by_slot, F.col("_slot"), F.lit(section), item, F.col("_field"), F.col("_cell")))
    for name in ("keys", "document_fields"):
        by_field = pages.select("*", F.explode(name).alias("_field", "_cell"))
        parts.append(rows(by_field, null, F.lit("document"), null, F.col("_field"), F.col("_cell")))
    items = pages.select("*", F.explode("extended").alias("_item"))
    parts.append(rows(items, null, F.col("_item.section"), F.col("_item.item"), F.col("_item.field"), F.col("_item")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
