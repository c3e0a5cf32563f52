"""V1-V9: rule checks that return violations as rows; no rows means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.normalize import type_range_error

DRAFT_KEYS = ["document_id", "schema_version", "layout_id", "notes", "extraction", "pages", "pii_detected", "document_fields",
              "encounters", "extended"]


def _item(path: Column | str, rule: str) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(rule).alias("rule"))


def _listed(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), item) for test, item in pairs]))


def validate_drafts(drafts: DataFrame, raw: str | None = None) -> DataFrame:
    """V1: header rules of nested drafts. `raw` names a column with the JSON text, for unknown top-level keys."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    fixed = _listed(
        (~F.col("schema_version").eqNullSafe(F.lit(C.SCHEMA_VERSION)), _item("schema_version", "EXPECTED_VERSION")),
        (~F.col("layout_id").eqNullSafe(F.lit(C.LAYOUT_ID)), _item("layout_id", "EXPECTED_LAYOUT")),
        (F.col("extraction").isNull(), _item("extraction", "OBJECT_EXPECTED")),
        (F.col("extraction").isNotNull() & blank("extraction.extractor"), _item("extraction.extractor", "TEXT_EXPECTED")),
        (F.col("extraction").isNotNull() & blank("extraction.extractor_version"), _item("extraction.extractor_version", "TEXT_EXPECTED")),
        (F.col("pages").isNull() | (F.size("pages") == 0), _item("pages", "NON_EMPTY_LIST_EXPECTED")),
        (F.col("pii_detected").isNull(), _item("pii_detected", "LIST_EXPECTED")),
        (F.col("document_fields").isNull(), _item("document_fields", "OBJECT_EXPECTED")),
        (F.col("encounters").isNull(), _item("encounters", "LIST_EXPECTED")))

    def each(column, test, rule, suffix=""):
        hit = F.transform(column, lambda x, i: F.when(F.coalesce(test(x), F.lit(False)), F.struct(
            F.concat(F.lit(f"{column}["), i.cast("string"), F.lit("]" + suffix)).alias("path"), F.lit(rule).alias("rule"))))
        return F.coalesce(F.array_compact(hit), F.array().cast("array<struct<path:string,rule:string>>"))

    found = F.concat(
        fixed, each("pages", lambda p: p["page_ref"].isNull(), "PAGE_REF_EXPECTED"),
        each("pii_detected", lambda p: p["action"].isNull() | ~p["action"].isin(C.PII_ACTIONS), "PII_ACTION"),
        each("encounters", lambda e: e["encounter_type"].isNull() | ~e["encounter_type"].isin(C.ENCOUNTER_TYPES), "ENCOUNTER_TYPE", ".encounter_type"),
        each("encounters", lambda e: e["slot"].isNull() | ~e["slot"].isin([s for s, _ in C.SLOTS]), "UNKNOWN_SLOT", ".slot"),
        each("encounters", lambda e: e["fields"].isNull(), "OBJECT_EXPECTED", ".fields"))
    if raw is not None:
        extra = F.array_except(F.json_object_keys(raw), F.array(*[F.lit(k) for k in DRAFT_KEYS]))
        found = F.concat(found, F.transform(F.coalesce(extra, F.array().cast("array<string>")),
                                            lambda k: F.struct(k.alias("path"), F.lit("UNKNOWN_KEY").alias("rule"))))
    return drafts.select("document_id", F.explode(found).alias("v")).select("document_id", "v.*")


def validate_field_sets(field_sets: DataFrame, fields: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """V2: missing and unknown field names of each field set (keys + scope)."""
    known = F.broadcast(catalog.where("scope IN ('document', 'encounter')").select("scope", "field"))
    present = fields.select(*keys, "scope", "field").distinct()
    missing = field_sets.select(*keys, "scope").distinct().join(known, "scope").join(present, [*keys, "scope", "field"], "left_anti")
    unknown = present.join(known, ["scope", "field"], "left_anti")
    return (missing.select(*keys, "scope", "field", F.lit("MISSING_FIELD").alias("rule"))
            .unionByName(unknown.select(*keys, "scope", "field", F.lit("UNKNOWN_FIELD").alias("rule"))))


def validate_field_values(fields: DataFrame, catalog: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """V3: one violation row per broken rule of a field value."""
    info = F.broadcast(catalog.select(F.col("field").alias("_f"), "kind", F.col("unit").alias("_unit"), "minimum", "maximum", "choices"))
    rows = fields.join(info, F.col("field") == F.col("_f"))
    status, value, conf, state = (F.col(c) for c in ("field_status", "value", "confidence", "verification_state"))
    problem = type_range_error(value, F.col("kind"), F.col("minimum"), F.col("maximum"), F.col("choices"), as_of)
    unverified_known = (status == "KNOWN") & (state == "UNVERIFIED")
    valid_status = F.coalesce(status.isin(C.FIELD_STATUSES), F.lit(False))
    range_rule = F.col("_problem").isin("RANGE_LOW", "RANGE_HIGH", "DATE_FUTURE")
    tests = [
        (~valid_status, "FIELD_STATUS"), (valid_status & ~conf.between(0, 1), "CONFIDENCE_RANGE"),
        (valid_status & ~F.col("unit").eqNullSafe(F.col("_unit")), "UNIT"),
        (valid_status & ~F.coalesce(state.isin(C.VERIFICATION_STATES), F.lit(False)), "VERIFICATION_STATE"),
        (status.isin(C.MISSING_STATUSES) & value.isNotNull(), "VALUE_MUST_BE_NULL"),
        ((status == "KNOWN") & value.isNull(), "KNOWN_REQUIRES_VALUE"),
        (valid_status & value.isNotNull() & F.col("_problem").isNotNull() & ~range_rule, "INVALID_VALUE"),
        ((status == "KNOWN") & value.isNotNull() & range_rule, "OUT_OF_RANGE"),
        (unverified_known & (conf < C.KNOWN_CONFIDENCE), "CONFIDENCE_BELOW_THRESHOLD"),
        (unverified_known & F.array_contains("validation_flags", "CONFLICT_ACROSS_PAGES"), "CONFLICT_KNOWN"),
    ]
    rules = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), r) for t, r in tests]))
    return rows.withColumn("_problem", problem).select(*keys, "field", F.explode(rules).alias("rule"))


def validate_sources(fields: DataFrame, keys: list[str]) -> DataFrame:
    """V4: optional parts of `source`: at least two readings, each with a page and a valid status; from and to."""
    s = F.col("source")
    bad = F.exists(s["readings"], lambda r: r["page_ref"].isNull() | r["field_status"].isNull() | ~r["field_status"].isin(C.FIELD_STATUSES))
    rules = F.array_compact(F.array(
        F.when(s.isNotNull() & s["page_ref"].isNull(), "SOURCE_PAGE_REF"),
        F.when(s["readings"].isNotNull() & (F.size(s["readings"]) < 2), "TWO_READINGS_EXPECTED"),
        F.when((F.size(s["readings"]) >= 2) & bad, "READING_INVALID"),
        F.when(s["normalization"].isNotNull() & (s["normalization"]["from"].isNull() | s["normalization"]["to"].isNull()), "NORMALIZATION")))
    return fields.select(*keys, "field", F.explode(rules).alias("rule"))


def validate_extended(items: DataFrame, sections: DataFrame, catalog: DataFrame) -> DataFrame:
    """V5: extended rows (document_id, catalog_version, section, item_index, item_key, field): version, known section and
    field, item key of the list, no key twice in a section."""
    known = F.broadcast(sections.select(F.col("section").alias("_s"), F.col("item_key").alias("_key"), F.col("item_values")))
    fields = F.broadcast(catalog.select(F.col("section").alias("_fs"), F.col("field").alias("_ff")))
    rows = items.join(known, F.col("section") == F.col("_s"), "left").join(
        fields, (F.col("section") == F.col("_fs")) & (F.col("field") == F.col("_ff")), "left")
    rules = F.array_compact(F.array(
        F.when(~F.col("catalog_version").eqNullSafe(F.lit(C.EXTENDED_VERSION)), "CATALOG_VERSION"),
        F.when(F.col("_s").isNull(), "UNKNOWN_SECTION"), F.when(F.col("_s").isNotNull() & F.col("_ff").isNull(), "UNKNOWN_FIELD"),
        F.when(F.col("_key").isNotNull() & ~F.coalesce(F.array_contains("item_values", F.col("item_key")), F.lit(False)), "UNKNOWN_ITEM")))
    broken = rows.select("document_id", "section", "item_index", "field", F.explode(rules).alias("rule"))
    keyed = items.where("item_key IS NOT NULL").select("document_id", "section", "item_index", "item_key").distinct()
    # The first item of a key is right; every later one is a duplicate.
    firsts = keyed.groupBy("document_id", "section", "item_key").agg(F.min("item_index").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = keyed.join(firsts, ["document_id", "section", "item_key"]).where("item_index <> _first").select(
        "document_id", "section", "item_index", F.lit(None).cast("string").alias("field"), F.lit("DUPLICATE_ITEM").alias("rule"))
    return broken.unionByName(twice)


def reject_verified_claims(fields: DataFrame) -> DataFrame:
    """V6: documents whose extraction claims that a person verified something."""
    claim = (F.col("verification_state") != "UNVERIFIED") | (F.coalesce("correction_count", F.lit(0)) > 0)
    return fields.where(claim).select("document_id").distinct()


def pages_multiset_equal(draft_pages: DataFrame, captured_pages: DataFrame, group: str = "document_id", item: str = "page_ref") -> DataFrame:
    """V7: documents whose draft lists other pages, or other multiplicities, than were captured."""
    count = lambda df, name: df.groupBy(group, item).agg(F.count(F.lit(1)).alias(name))
    both = count(draft_pages, "_d").join(count(captured_pages, "_c"), [group, item], "full_outer")
    return both.where(~F.col("_d").eqNullSafe(F.col("_c"))).select(group).distinct()


def valid_reviewer(name: Column) -> Column:
    """V8: a reviewer's name."""
    return F.coalesce(F.regexp_replace(name, r"^\s+|\s+$", "").rlike(r"^[\w.@ \-]{2,60}$"), F.lit(False))


def valid_ids(message_id: Column, group_id: Column) -> Column:
    """V8: a message id of 1-200 characters and, when given, a group id of 1-100."""
    return F.coalesce(F.length(message_id).between(1, 200), F.lit(False)) & (group_id.isNull() | F.length(group_id).between(1, 100))


def audit_duplicates(df: DataFrame, keys: list[str], constraint: str, where: Column | None = None) -> DataFrame:
    """V9: keys held by more than one row; rows with a null key are free, as in a partial unique index."""
    rows = df if where is None else df.where(where)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
            .select(F.lit(constraint).alias("constraint"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "rows"))


def audit_orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str, constraint: str) -> DataFrame:
    """V9: references to rows that do not exist, one row per missing key."""
    held = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("rows"))
    return held.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti").select(
        F.lit(constraint).alias("constraint"), F.col("_k").cast("string").alias("key"), "rows")


def audit_values(df: DataFrame, column: str, allowed: list[str], constraint: str) -> DataFrame:
    """V9: values outside a closed list."""
    return df.where(~F.col(column).isin(allowed)).groupBy(F.col(column).cast("string").alias("key")).agg(
        F.count(F.lit(1)).alias("rows")).select(F.lit(constraint).alias("constraint"), "key", "rows")
