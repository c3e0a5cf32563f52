"""Drafts as long field tables: flattening, assembly, merging of pages, and consistency across fields.

A document has one row per field and slot; slots are a closed list of ten, so windows per document stay short. Evidence
and demotions are kept as long rows instead of growing arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..scale import first_by

FV_COLUMNS = ["raw_text", "value", "unit", "confidence", "field_status", "validation_flags", "source", "verification", "corrections"]


# ------------------------------------------------------------------ nested and long forms

def flatten_fields(drafts: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per field value: document fields, encounters by index, extended sections by item, with a review order.

    The entries of all parts of a draft are put together and spread once, so a draft is made and looked at once.
    """
    null_s, null_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def entries(rank, section, enc, slot, item, key, fields):
        return F.transform(F.map_entries(fields), lambda e: F.struct(
            F.lit(rank).alias("_rank"), F.lit(section).alias("section"), enc.cast("int").alias("encounter_index"), slot.cast("string").alias("slot"), item.cast("int").alias("item_index"),
            key.cast("string").alias("item_key"), e["key"].alias("field"), *[e["value"][c].alias(c) for c in FV_COLUMNS]))

    def listed(items, of):
        """The entries of the items of a list that have fields, with their place in it."""
        return F.flatten(F.filter(F.transform(items, lambda n, i: of(n, i)), lambda x: x.isNotNull()))

    parts = [entries(0, "document", null_i, null_s, null_i, null_s, F.col("document_fields")),
             listed(F.col("encounters"), lambda n, i: entries(1, "encounter", i, n["slot"], null_i, null_s, n["fields"]))]
    for rank, (name, _scope, item_key, _values) in enumerate(C.EXTENDED_SECTIONS, start=2):
        part = F.col(f"extended.{name}")
        if item_key is None:
            parts.append(entries(rank, name, null_i, null_s, null_i, null_s, part))
        else:
            parts.append(listed(part, lambda n, i, rank=rank, name=name, item_key=item_key: entries(rank, name, null_i, null_s, i, n[item_key], n["fields"])))
    every = F.flatten(F.array_compact(F.array(*parts)))
    out = drafts.select("document_id", F.explode(every).alias("_e")).select("document_id", "_e.*")
    order = F.broadcast(catalog.select(F.col("field").alias("_f"), F.col("ord").alias("_o")))
    ordered = out.join(order, F.col("field") == F.col("_f"), "left")
    return ordered.withColumn(
        "review_order", F.format_string("%02d-%04d-%03d", "_rank", F.coalesce("encounter_index", "item_index", F.lit(0)),
                                        F.coalesce("_o", F.lit(999)))).drop("_rank", "_f", "_o")


def field_value(columns: list[str] = FV_COLUMNS) -> Column:
    return F.struct(*columns)


def assemble_drafts(fields: DataFrame, slots: DataFrame) -> DataFrame:
    """Long fields back to (document_id, document_fields, encounters, extended lists). The inverse of D1.

    What is gathered per document is the closed set of catalog fields and slots.
    """
    order = F.broadcast(slots.select(F.col("slot").alias("_s"), F.col("slot_ord")))
    item = F.struct("section", "slot_ord", "encounter_index", "slot", "item_index", "item_key", "field", field_value().alias("fv"))
    # A document's fields are dealt out once and gathered once; its parts are made from them there.
    gathered = fields.join(order, F.col("slot") == F.col("_s"), "left").groupBy("document_id").agg(F.collect_list(item).alias("_items"))

    def of_section(name):
        return F.filter("_items", lambda i: i["section"] == name).alias(f"_{name}")

    parted = gathered.select("document_id", *[of_section(name) for name in ("document", "encounter", *[n for n, *_ in C.EXTENDED_SECTIONS])])
    as_map = lambda items: F.map_from_entries(F.transform(items, lambda i: F.struct(i["field"], i["fv"])))

    def grouped(part, by, make):
        """An element for each different `by` of the items, in its order."""
        keys = F.array_sort(F.array_distinct(F.transform(part, lambda i: F.struct(*[i[c].alias(c) for c in by]))))
        same = lambda i, k: F.struct(*[i[c].alias(c) for c in by]).eqNullSafe(k)
        return F.transform(keys, lambda k: make(k, as_map(F.filter(part, lambda i: same(i, k)))))

    some = lambda name, made: F.when(F.size(f"_{name}") > 0, made)
    columns = {"document_fields": some("document", as_map(F.col("_document"))),
               "encounters": some("encounter", grouped(F.col("_encounter"), ["slot_ord", "encounter_index", "slot"], lambda k, m: F.struct(F.lit("ANTENATAL").alias("encounter_type"), k["slot"].alias("slot"), m.alias("fields"))))}
    for name, _scope, item_key, _values in C.EXTENDED_SECTIONS:
        part = F.col(f"_{name}")
        columns[name] = some(name, as_map(part) if item_key is None else grouped(part, ["item_index", "item_key"], lambda k, m, item_key=item_key: F.struct(k["item_key"].alias(item_key), m.alias("fields"))))
    # Sections of a document that has neither fields nor encounters of its own belong to no draft.
    return parted.where((F.size("_document") > 0) | (F.size("_encounter") > 0)).select("document_id", *[c.alias(n) for n, c in columns.items()])


# ------------------------------------------------------------------ merging pages

def reading_kind(value: Column, raw: Column, status: Column, flags: Column) -> Column:
    """How far a page settles a field: a value was read, nothing is there for sure, something is there without a value, or nobody looked."""
    has = lambda f: F.array_contains(flags, f)
    return (F.when(value.isNotNull(), "value").when(has("CELL_BLANK") | has("MARKED_DASH"), "blank")
            .when((F.coalesce(raw, F.lit("")) != "") | (status == "ILLEGIBLE") | has("CELL_INK_UNREAD"), "written").otherwise("unchecked"))


def merge_readings(readings: DataFrame, keys: list[str], page_order: str = "page_no") -> DataFrame:
    """D3: the readings of all pages of a field put together. Pages that contradict one another (two values, or a sure blank
    beside anything written) leave the field in conflict; where they agree, kind, status and confidence rank the readings.

    "More than one value" is min <> max, so the whole rule is one partial aggregate. The readings themselves stay in
    their long table (`reading_evidence`).
    """
    rest = [c for c in readings.columns if c not in keys]
    kind = reading_kind(F.col("value"), F.col("raw_text"), F.col("field_status"), F.col("validation_flags"))
    rank = F.array_position(F.array(*[F.lit(k) for k in ("value", "written", "blank", "unchecked")]), F.col("_kind"))
    is_ = lambda k: F.col("_kind") == k
    row = F.struct(*rest)
    merged = readings.withColumn("_kind", kind).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("readings"), F.min(F.when(is_("value"), F.col("value"))).alias("_low"),
        F.max(F.when(is_("value"), F.col("value"))).alias("_high"), F.bool_or(is_("blank")).alias("_blank"),
        F.bool_or(is_("value") | is_("written")).alias("_ink"),
        F.min_by(row, F.struct(rank, F.col("field_status") != "KNOWN", -F.coalesce("confidence", F.lit(0.0)), F.col(page_order))).alias("_best"),
        F.min_by(row, F.when(is_("value") | is_("written"), F.col(page_order))).alias("_first"))
    differ = F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    conflict = (F.col("readings") > 1) & (differ | (F.col("_blank") & F.col("_ink")))
    empty = {"raw_text": "string", "value": "string", "value_num": "double", "value_date": "date", "confidence": "double"}
    out = []
    for c in rest:
        if c in empty:
            out.append(F.when(~F.col("_c"), F.col("_best")[c]).alias(c))
        elif c == "field_status":
            out.append(F.when(F.col("_c"), "NEEDS_REVIEW").otherwise(F.col("_best")[c]).alias(c))
        elif c == "validation_flags":
            out.append(F.when(F.col("_c"), F.array(F.lit("CONFLICT_ACROSS_PAGES"))).otherwise(F.col("_best")[c]).alias(c))
        else:
            out.append(F.when(F.col("_c"), F.col("_first")[c]).otherwise(F.col("_best")[c]).alias(c))
    return merged.withColumn("_c", conflict).select(*keys, *out, "readings")


def reading_evidence(readings: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """The readings behind every field that more than one page shows."""
    return readings.join(merged.where("readings > 1").select(*keys), keys, "left_semi")


def encounters(columns: DataFrame, gridless_pages: DataFrame) -> DataFrame:
    """The visits of a document: a slot counts once any page fills it; a page whose table was not found adds one to enter by hand."""
    visits = columns.where("populated").select("document_id", "slot", F.lit(None).cast("string").alias("page_ref")).distinct()
    manual = gridless_pages.select("document_id", F.lit("MANUAL").alias("slot"), "page_ref")
    return visits.unionByName(manual).withColumn("encounter_type", F.lit("ANTENATAL"))


def missing_section_fields(entries: DataFrame, found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Document fields no page of the document shows, with the reason."""
    wanted = F.broadcast(catalog.where("scope = 'document'").select("field"))
    documents = entries.groupBy("document_id").agg(F.bool_and("read").alias("_all"))
    return (documents.crossJoin(wanted).join(found.select("document_id", "field"), ["document_id", "field"], "left_anti")
            .select("document_id", "field", F.when(F.col("_all"), "SECTION_NOT_CAPTURED").otherwise("PAGE_NOT_READ").alias("flag")))


# ------------------------------------------------------------------ consistency

def check_date_order(visits: DataFrame) -> DataFrame:
    """Demotions of visit dates that do not follow the dated visit before them; both dates are flagged."""
    dated = visits.where("visit_date IS NOT NULL")
    w = Window.partitionBy("document_id").orderBy("slot_ord")
    near = dated.withColumns({"_before": F.lag("visit_date").over(w), "_after": F.lead("visit_date").over(w)})
    return near.where((F.col("visit_date") <= F.col("_before")) | (F.col("_after") <= F.col("visit_date"))).select(
        "document_id", "slot", F.lit("visit_date").alias("field"), F.lit("DATE_ORDER").alias("flag"))


def check_lmp(visits: DataFrame, lmp: DataFrame) -> DataFrame:
    """Demotions from the first day of the last period: visits outside 0-315 days, or ages more than 14 days off."""
    joined = visits.join(lmp.select("document_id", "lmp"), "document_id").where("visit_date IS NOT NULL AND lmp IS NOT NULL")
    elapsed = F.date_diff("visit_date", "lmp")
    outside = ~elapsed.between(0, C.GA_LIMIT_DAYS)
    off = ~outside & F.coalesce(F.abs(elapsed - F.col("gestational_age_days")) > C.GA_GAP_DAYS, F.lit(False))
    item = lambda slot, field, flag: F.struct(slot.cast("string").alias("slot"), F.lit(field).alias("field"), F.lit(flag).alias("flag"))
    hits = F.when(outside, F.array(item(F.col("slot"), "visit_date", "DATE_INCONSISTENT_WITH_DDR"),
                                   item(F.lit(None), "last_menstrual_period", "DATE_INCONSISTENT_WITH_DDR"))
                  ).when(off, F.array(item(F.col("slot"), "gestational_age_days", "GA_INCONSISTENT_WITH_DDR"),
                                      item(F.col("slot"), "visit_date", "GA_INCONSISTENT_WITH_DDR")))
    return joined.select("document_id", F.explode(hits).alias("h")).select("document_id", "h.*").distinct()


def check_conception(visits: DataFrame) -> DataFrame:
    """Each visit implies a conception day (date minus age); one more than 14 days from the lower median of at least
    three visits, or two visits that disagree, is demoted. At most one visit per slot, so the median is over ten values."""
    implied = visits.where("visit_date IS NOT NULL AND gestational_age_days IS NOT NULL").withColumn(
        "_day", F.unix_date("visit_date") - F.col("gestational_age_days"))
    stats = implied.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("_n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _day)").alias("_mid"),
        (F.max("_day") - F.min("_day")).alias("_spread"))
    off = F.when(F.col("_n") >= 3, F.abs(F.col("_day") - F.col("_mid")) > C.GA_GAP_DAYS).when(
        F.col("_n") == 2, F.col("_spread") > C.GA_GAP_DAYS).otherwise(False)
    return implied.join(stats, "document_id").where(off).select(
        "document_id", "slot", F.explode(F.array(F.lit("gestational_age_days"), F.lit("visit_date"))).alias("field"),
        F.lit("GA_INCONSISTENT_WITH_VISITS").alias("flag"))


def apply_demotions(fields: DataFrame, demotions: DataFrame) -> DataFrame:
    """Add flags to fields and send the KNOWN ones to review. Demotions have (document_id, slot or null, field, flag)."""
    per_field = demotions.groupBy("document_id", F.coalesce("slot", F.lit("")).alias("_slot"), F.col("field")).agg(
        F.array_sort(F.collect_set("flag")).alias("_flags"))  # at most the four consistency flags
    joined = fields.withColumn("_slot", F.coalesce("slot", F.lit(""))).join(per_field, ["document_id", "_slot", "field"], "left")
    hit = F.col("_flags").isNotNull()
    return joined.withColumns({
        "validation_flags": F.when(hit, F.array_union("validation_flags", "_flags")).otherwise(F.col("validation_flags")),
        "field_status": F.when(hit & (F.col("field_status") == "KNOWN"), "NEEDS_REVIEW").otherwise(F.col("field_status"))}).select(*fields.columns)


def flag_orphan_labs(labs: DataFrame, visits: DataFrame) -> DataFrame:
    """A laboratory value whose slot is no encounter of the document."""
    have = visits.select("document_id", "slot").distinct().withColumn("_visit", F.lit(True))
    orphan = F.col("_visit").isNull()
    flag = F.lit("LAB_WITHOUT_VISIT")
    return labs.join(have, ["document_id", "slot"], "left").withColumns({
        "validation_flags": F.when(orphan, F.array_union("validation_flags", F.array(flag))).otherwise(F.col("validation_flags")),
        "field_status": F.when(orphan & (F.col("field_status") == "KNOWN"), "NEEDS_REVIEW").otherwise(F.col("field_status"))}).select(*labs.columns)


def blank_drafts(documents: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every base field of a failed or waiting document, empty and for review, with one manual encounter."""
    base = F.broadcast(catalog.where("scope IN ('document', 'encounter')").select("field", "scope", "unit"))
    return (documents.where(F.col("status").isin("PROCESSING_FAILED", "PENDING_AI")).select("document_id").crossJoin(base)
            .select("document_id", F.col("scope").alias("section"), F.when(F.col("scope") == "encounter", "MANUAL").alias("slot"),
                    "field", "unit", F.lit(None).cast("string").alias("value"), F.lit("NEEDS_REVIEW").alias("field_status"),
                    F.array(F.lit("MANUAL_ENTRY")).alias("validation_flags")))


# ------------------------------------------------------------------ stored and late results

def match_page_sets(pages: DataFrame, library: DataFrame, group: str = "document_id", stored: str = "extraction_id",
                    item: str = "page_ref") -> DataFrame:
    """The stored extraction whose page set equals the document's. Sets meet by an order-free signature (count and
    two hash sums) and are then compared member by member, so no set has to be gathered."""
    def signature(frame, key):
        members = frame.select(key, item).distinct()
        h1, h2 = F.xxhash64(item), F.xxhash64(F.lit("second"), F.col(item))
        return members, members.groupBy(key).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(F.pmod(h1, F.lit(1 << 40))).alias("_h1"), F.sum(F.pmod(h2, F.lit(1 << 40))).alias("_h2"))

    mine, left = signature(pages, group)
    theirs, right = signature(library, stored)
    # One library entry per signature is enough to compare with: equal sets give the same answer.
    pairs = left.join(first_by(right, ["_n", "_h1", "_h2"], [stored]), ["_n", "_h1", "_h2"])
    same = (pairs.join(mine, group).join(theirs.withColumnRenamed(stored, "_s").withColumnRenamed(item, "_i"),
                                         (F.col(stored) == F.col("_s")) & (F.col(item) == F.col("_i")))
            .groupBy(group, stored, "_n").agg(F.count(F.lit(1)).alias("_hits")).where("_hits = _n").select(group, stored))
    return left.select(group).join(same, group, "left").withColumn(
        "error", F.when(F.col(stored).isNull(), "NO_FIXTURE_FOR_PAGE_SET"))


def current_results_only(results: DataFrame, result_pages: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """A verdict per extraction result: it counts only when its revision, the document's status and the ordered
    (page, ref, hint) list are those of today and it claims no human verification; repeats of a revision are replays."""
    now_pages = pages.where("replaced_by IS NULL").select(
        "document_id", "position", F.col("page_id").alias("_p"), F.col("media_ref").alias("_m"), F.col("section_hint").alias("_h"))
    have = now_pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("_now"))
    joined = result_pages.join(results.select("result_id", "document_id"), "result_id").join(now_pages, ["document_id", "position"], "left")
    equal = F.col("page_id").eqNullSafe(F.col("_p")) & F.col("media_ref").eqNullSafe(F.col("_m")) & F.col("section_hint").eqNullSafe(F.col("_h"))
    counted = joined.groupBy("result_id").agg(F.count(F.lit(1)).alias("_sent"), F.count_if(equal).alias("_equal"))
    first = results.groupBy("document_id", "revision").agg(F.min("result_id").alias("_first"))
    docs = documents.select("document_id", F.col("revision").alias("_rev"), F.col("status").alias("_status"))
    all_ = (results.join(docs, "document_id", "left").join(have, "document_id", "left").join(counted, "result_id", "left")
            .join(first, ["document_id", "revision"]))
    same_pages = (F.col("_sent") == F.col("_now")) & (F.col("_equal") == F.col("_sent"))
    verdict = (F.when(F.col("_rev").isNull(), "UNKNOWN_DOCUMENT").when(F.col("claims_verification"), "VERIFIED_CLAIM")
               .when((F.col("revision") != F.col("_rev")) | (F.col("_status") != "PENDING_AI"), "STALE_REVISION")
               .when(~F.coalesce(same_pages, F.lit(False)), "STALE_PAGES")
               .when(F.col("result_id") != F.col("_first"), "REPLAY").otherwise("ACCEPTED"))
    return all_.select("result_id", "document_id", "revision", verdict.alias("verdict"))
