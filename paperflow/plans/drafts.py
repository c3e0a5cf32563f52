"""D1-D12, S2, S9 and V1-V9 on orders (documents) and their lines (fields, pages, visits)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from .. import schemas
from ..operators import drafts as D
from ..operators import validate as V
from ..sources.files import flatten_truth
from .forms import COPIES_SQL, SLOT_SQL, copies, slot
from .registry import Tables, query



def no_flags():
    return F.array().cast("array<string>")


def document_lines(t: Tables) -> DataFrame:
    """The lines of a document, unique in (order, line number), are its visits; see `registry.SheetTables`."""
    return t.lineitem.withColumn("q", F.col("l_quantity").cast("int"))


FIRST_SQL = f"{COPIES_SQL}, visits AS (SELECT *, {SLOT_SQL} AS slot FROM copies WHERE page_no = 1)"


# ------------------------------------------------------------------ nested drafts

def long_fields(t: Tables) -> DataFrame:
    """Fields of every order as long rows: a file number, per visit a date and a weight, per slot a haemoglobin value."""
    visits = document_lines(t)
    status = F.when(F.col("l_returnflag") == "N", "KNOWN").otherwise("NEEDS_REVIEW")
    state = F.when(F.col("l_linestatus") == "F", "CONFIRMED").otherwise("UNVERIFIED")
    null_s, null_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def rows(df, section, enc, slot_, item, key, field, value, unit, status_, state_):
        return df.select(
            F.col("l_orderkey").cast("string").alias("document_id"), F.lit(section).alias("section"), enc.alias("encounter_index"), slot_.alias("slot"), item.alias("item_index"),
            key.cast("string").alias("item_key"), F.lit(field).alias("field"), value.alias("raw_text"), value.alias("value"), F.lit(unit).cast("string").alias("unit"), F.lit(0.9).alias("confidence"),
            status_.alias("field_status"), no_flags().alias("validation_flags"),
            F.lit(None).cast(schemas.SOURCE).alias("source"), F.struct(state_.alias("state"), F.lit("r").alias("by"), F.lit("2024-01-01").alias("at")).alias("verification"),
            F.array().cast(f"array<struct<at:string,by:string,action:string,previous:{schemas.CHANGE},new:{schemas.CHANGE}>>").alias("corrections"))

    index = F.col("l_linenumber").cast("int") - 1
    head = visits.select("l_orderkey").distinct()
    known, unverified = F.lit("KNOWN"), F.lit("UNVERIFIED")
    number = F.lpad(F.col("l_orderkey").cast("string"), 6, "0")
    parts = [rows(head, "document", null_i, null_s, null_i, null_s, "registry_file_number", number, None, known, unverified),
             rows(visits, "encounter", index, slot(), null_i, null_s, "visit_date", F.date_format("l_shipdate", "yyyy-MM-dd"), None, status, state),
             rows(visits, "encounter", index, slot(), null_i, null_s, "weight_kg", (F.col("q") + 40).cast("string"), "kg", status, state),
             rows(head, "pregnancy", null_i, null_s, null_i, null_s, "parity", F.lit("2"), None, known, unverified),
             rows(visits, "visit_labs", null_i, null_s, index, slot(), "hemoglobin_g_dl", (F.col("q") % 10 + 8).cast("string"), "g/dL", status, state)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


LONG_SQL = f"""{FIRST_SQL}, head AS (SELECT DISTINCT l_orderkey FROM lineitem), v AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END AS status,
  CASE WHEN l_linestatus = 'F' THEN 'CONFIRMED' ELSE 'UNVERIFIED' END AS state FROM visits),
fields AS (SELECT l_orderkey, 'document' AS section, '' AS slot, 'registry_file_number' AS field, LPAD(CAST(l_orderkey AS VARCHAR), 6, '0') AS value, 'KNOWN' AS status, 'UNVERIFIED' AS state FROM head
 UNION ALL SELECT l_orderkey, 'encounter', slot, 'visit_date', strftime(l_shipdate, '%Y-%m-%d'), status, state FROM v
 UNION ALL SELECT l_orderkey, 'encounter', slot, 'weight_kg', CAST(q + 40 AS VARCHAR), status, state FROM v
 UNION ALL SELECT l_orderkey, 'pregnancy', '', 'parity', '2', 'KNOWN', 'UNVERIFIED' FROM head
 UNION ALL SELECT l_orderkey, 'visit_labs', slot, 'hemoglobin_g_dl', CAST(q % 10 + 8 AS VARCHAR), status, state FROM v)"""


def nested(t: Tables) -> DataFrame:
    """Drafts with the header of a valid document around the assembled fields."""
    body = D.assemble_drafts(long_fields(t), C.slots(t.spark))
    extended = F.struct(F.lit(C.EXTENDED_VERSION).alias("catalog_version"), *[n for n, *_ in C.EXTENDED_SECTIONS])
    return body.withColumns({"extended": extended})


@query("d1_flatten_fields", f"WITH {LONG_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS document_id, section, slot, field, value, status AS field_status, state FROM fields")
def flatten_fields(t):
    flat = D.flatten_fields(nested(t), C.field_catalog(t.spark))
    return flat.select("document_id", "section", F.coalesce("slot", F.when(F.col("section") == "visit_labs", F.col("item_key")), F.lit("")).alias("slot"), "field", "value", "field_status",
                       F.col("verification.state").alias("state"))


@query("d2_assemble_drafts", f"""WITH {LONG_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS document_id, MAX(CASE WHEN section = 'document' THEN value END) AS file_number,
  STRING_AGG(slot || '=' || value, ' ' ORDER BY array_position({C.GRID_SLOTS}, slot)) FILTER (field = 'weight_kg') AS weights,
  STRING_AGG(slot || '=' || value, ' ' ORDER BY array_position({C.GRID_SLOTS}, slot)) FILTER (section = 'visit_labs') AS labs FROM fields GROUP BY 1""")
def assemble_drafts(t):
    body = D.assemble_drafts(long_fields(t), C.slots(t.spark))
    pairs = lambda items, key, field: F.array_join(F.transform(items, lambda e: F.concat(e[key], F.lit("="), e["fields"][field]["value"])), " ")
    return body.select("document_id", F.col("document_fields")["registry_file_number"]["value"].alias("file_number"), pairs("encounters", "slot", "weight_kg").alias("weights"),
                       pairs("visit_labs", "slot", "hemoglobin_g_dl").alias("labs"))


# ------------------------------------------------------------------ merging

def readings(t: Tables) -> DataFrame:
    """Every copy of a line is one page's reading of a field."""
    value = F.when(F.col("l_returnflag") != "A", F.when(F.col("q") % 5 > 0, F.expr("q div 25").cast("string")))
    flags = F.when(F.col("l_returnflag") == "A", F.array(F.lit("CELL_BLANK"))).otherwise(no_flags())
    return copies(t).select(
        F.col("l_orderkey").alias("document_id"), slot().alias("slot"), F.lit("weight_kg").alias("field"), F.col("page_no"),
        F.when(F.col("l_returnflag") != "A", F.col("q").cast("string")).alias("raw_text"), value.alias("value"), value.cast("double").alias("value_num"), F.lit(None).cast("date").alias("value_date"),
        F.col("conf").alias("confidence"), F.when(value.isNull(), F.when(F.col("l_returnflag") == "A", "NOT_PROVIDED").otherwise("NEEDS_REVIEW")).when(F.col("l_linestatus") == "F", "KNOWN").otherwise("NEEDS_REVIEW").alias("field_status"),
        flags.alias("validation_flags"))


READINGS_SQL = f"""{COPIES_SQL}, r AS (SELECT l_orderkey AS document_id, {SLOT_SQL} AS slot, page_no, conf, CASE WHEN l_returnflag = 'A' THEN 'blank' WHEN q % 5 > 0 THEN 'value' ELSE 'written' END AS kind,
  CASE WHEN l_returnflag <> 'A' AND q % 5 > 0 THEN CAST(q // 25 AS VARCHAR) END AS value, l_returnflag <> 'A' AND q % 5 > 0 AND l_linestatus = 'F' AS known FROM copies),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id, slot ORDER BY CASE kind WHEN 'value' THEN 1 WHEN 'written' THEN 2 ELSE 3 END, NOT known, conf DESC, page_no) AS no FROM r),
g AS (SELECT document_id, slot, COUNT(*) AS readings, COUNT(*) > 1 AND (COUNT(DISTINCT value) > 1 OR (BOOL_OR(kind = 'blank') AND BOOL_OR(kind <> 'blank'))) AS conflict FROM r GROUP BY 1, 2)"""


@query("d3_merge_readings", f"""WITH {READINGS_SQL} SELECT g.document_id, g.slot, g.readings, CASE WHEN conflict THEN '' ELSE COALESCE(value, '') END AS value,
  CASE WHEN conflict THEN 'NEEDS_REVIEW' WHEN known THEN 'KNOWN' WHEN kind = 'blank' THEN 'NOT_PROVIDED' ELSE 'NEEDS_REVIEW' END AS field_status, CASE WHEN conflict THEN 'CONFLICT_ACROSS_PAGES' WHEN kind = 'blank' THEN 'CELL_BLANK' ELSE '' END AS flags
  FROM g JOIN best b ON b.document_id = g.document_id AND b.slot = g.slot AND b.no = 1""")
def merge_readings(t):
    m = D.merge_readings(readings(t), ["document_id", "slot", "field"])
    return m.select("document_id", "slot", "readings", F.coalesce("value", F.lit("")).alias("value"), "field_status", F.array_join("validation_flags", ";").alias("flags"))


@query("d3_reading_evidence", f"WITH {READINGS_SQL} SELECT r.document_id, r.slot, r.page_no, COALESCE(r.value, '') AS value FROM r JOIN g ON g.document_id = r.document_id AND g.slot = r.slot WHERE g.readings > 1")
def evidence(t):
    rows, keys = readings(t), ["document_id", "slot", "field"]
    return D.reading_evidence(rows, D.merge_readings(rows, keys), keys).select("document_id", "slot", "page_no", F.coalesce("value", F.lit("")).alias("value"))


@query("d4_encounters", f"""SELECT DISTINCT l_orderkey AS document_id, {SLOT_SQL} AS slot, '' AS page_ref FROM lineitem WHERE l_returnflag <> 'A'
  UNION ALL SELECT l_orderkey, 'MANUAL', l_partkey || '-' || l_suppkey || '-' || l_linenumber FROM lineitem WHERE l_quantity = 50""")
def encounters(t):
    columns = t.lineitem.select(F.col("l_orderkey").alias("document_id"), slot().alias("slot"), (F.col("l_returnflag") != "A").alias("populated"))
    gridless = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("document_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("page_ref"))
    return D.encounters(columns, gridless).select("document_id", "slot", F.coalesce("page_ref", F.lit("")).alias("page_ref"))


@query("d5_missing_section_fields", """
WITH d AS (SELECT l_orderkey AS document_id, BOOL_AND(l_returnflag <> 'A') AS complete, BOOL_OR(l_linenumber = 1 AND l_returnflag <> 'A') AS cover, BOOL_OR(l_linenumber = 3 AND l_returnflag <> 'A') AS grid FROM lineitem GROUP BY 1)
SELECT document_id, field, CASE WHEN complete THEN 'SECTION_NOT_CAPTURED' ELSE 'PAGE_NOT_READ' END AS flag FROM d,
 (SELECT UNNEST(['registry_file_number', 'midwife_patient_code', 'facility_name', 'last_menstrual_period']) AS field) WHERE CASE WHEN field = 'last_menstrual_period' THEN NOT grid ELSE NOT cover END""")
def missing_fields(t):
    pages = t.lineitem.select(F.col("l_orderkey").alias("document_id"), (F.col("l_returnflag") != "A").alias("read"), "l_linenumber")
    names = F.when(F.col("l_linenumber") == 1, F.array(*[F.lit(f) for f in C.DOCUMENT_FIELDS[:3]])).when(F.col("l_linenumber") == 3, F.array(F.lit("last_menstrual_period")))
    found = pages.where("read").select("document_id", F.explode(names).alias("field"))
    return D.missing_section_fields(pages, found, C.field_catalog(t.spark))


# ------------------------------------------------------------------ consistency

def visit_rows(t: Tables) -> DataFrame:
    return document_lines(t).select(F.col("l_orderkey").alias("document_id"), slot().alias("slot"), F.col("l_linenumber").alias("slot_ord"), F.to_date("l_shipdate").alias("visit_date"), (F.col("q") * 6).alias("gestational_age_days"))


@query("d6_check_date_order", f"""WITH {FIRST_SQL}, w AS (SELECT l_orderkey AS document_id, slot, l_shipdate AS d, LAG(l_shipdate) OVER v AS b, LEAD(l_shipdate) OVER v AS a FROM visits WINDOW v AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT document_id, slot, 'visit_date' AS field, 'DATE_ORDER' AS flag FROM w WHERE d <= b OR a <= d""")
def date_order(t):
    return D.check_date_order(visit_rows(t))


LMP_SQL = f"""{FIRST_SQL}, e AS (SELECT v.l_orderkey AS document_id, slot, q * 6 AS ga, date_diff('day', o_orderdate, l_shipdate) AS days FROM visits v JOIN orders ON o_orderkey = v.l_orderkey)"""


@query("d7_check_lmp", f"""WITH {LMP_SQL}, f AS (SELECT document_id, slot, 'visit_date' AS field, 'DATE_INCONSISTENT_WITH_DDR' AS flag FROM e WHERE days NOT BETWEEN 0 AND 315
 UNION SELECT document_id, '', 'last_menstrual_period', 'DATE_INCONSISTENT_WITH_DDR' FROM e WHERE days NOT BETWEEN 0 AND 315
 UNION SELECT document_id, slot, UNNEST(['gestational_age_days', 'visit_date']), 'GA_INCONSISTENT_WITH_DDR' FROM e WHERE days BETWEEN 0 AND 315 AND ABS(days - ga) > 14) SELECT * FROM f""")
def lmp(t):
    first_day = t.orders.select(F.col("o_orderkey").alias("document_id"), F.to_date("o_orderdate").alias("lmp"))
    return D.check_lmp(visit_rows(t), first_day).withColumn("slot", F.coalesce("slot", F.lit("")))


@query("d8_check_conception", f"""WITH {FIRST_SQL}, e AS (SELECT l_orderkey AS document_id, slot, date_diff('day', DATE '1970-01-01', l_shipdate) - q * 6 AS day FROM visits),
g AS (SELECT document_id, COUNT(*) AS n, LIST_SORT(LIST(day))[(COUNT(*) + 1) // 2] AS mid, MAX(day) - MIN(day) AS spread FROM e GROUP BY 1)
SELECT e.document_id, slot, UNNEST(['gestational_age_days', 'visit_date']) AS field, 'GA_INCONSISTENT_WITH_VISITS' AS flag FROM e JOIN g ON g.document_id = e.document_id WHERE CASE WHEN n >= 3 THEN ABS(day - mid) > 14 WHEN n = 2 THEN spread > 14 ELSE false END""")
def conception(t):
    return D.check_conception(visit_rows(t))


@query("d8_apply_demotions", f"""WITH {FIRST_SQL}, w AS (SELECT *, LAG(l_shipdate) OVER v AS b, LEAD(l_shipdate) OVER v AS a FROM visits WINDOW v AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey AS document_id, slot, CASE WHEN COALESCE(l_shipdate <= b OR a <= l_shipdate, false) THEN 'NEEDS_REVIEW' ELSE 'KNOWN' END AS field_status, CASE WHEN COALESCE(l_shipdate <= b, false) OR COALESCE(a <= l_shipdate, false) THEN 'X;DATE_ORDER' ELSE 'X' END AS flags
 FROM w WHERE COALESCE(l_shipdate <= b, false) OR COALESCE(a <= l_shipdate, false) OR true""".replace("CASE WHEN COALESCE(l_shipdate <= b OR a <= l_shipdate, false)", "CASE WHEN COALESCE(l_shipdate <= b, false) OR COALESCE(a <= l_shipdate, false)"))
def demotions(t):
    rows = visit_rows(t)
    fields = rows.select("document_id", "slot", F.lit("visit_date").alias("field"), F.lit("KNOWN").alias("field_status"), F.array(F.lit("X")).alias("validation_flags"))
    return D.apply_demotions(fields, D.check_date_order(rows)).select("document_id", "slot", "field_status", F.array_join("validation_flags", ";").alias("flags"))


@query("d9_flag_orphan_labs", f"""WITH {COPIES_SQL}, have AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A')
SELECT c.l_orderkey AS document_id, {SLOT_SQL.replace('CASE l_linenumber', 'CASE c.l_linenumber')} AS slot, c.page_no, CASE WHEN h.l_orderkey IS NULL THEN 'NEEDS_REVIEW' ELSE 'KNOWN' END AS field_status, h.l_orderkey IS NULL AS orphan
FROM copies c LEFT JOIN have h ON h.l_orderkey = c.l_orderkey AND h.l_linenumber = c.l_linenumber""")
def orphan_labs(t):
    labs = copies(t).select(F.col("l_orderkey").alias("document_id"), slot().alias("slot"), "page_no", F.lit("KNOWN").alias("field_status"), no_flags().alias("validation_flags"))
    visits = t.lineitem.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("document_id"), slot().alias("slot"))
    return D.flag_orphan_labs(labs, visits).select("document_id", "slot", "page_no", "field_status", F.array_contains("validation_flags", "LAB_WITHOUT_VISIT").alias("orphan"))


@query("d10_blank_drafts", """SELECT o_orderkey AS document_id, field, CASE WHEN i > 4 THEN 'MANUAL' ELSE '' END AS slot, 'NEEDS_REVIEW' AS field_status FROM orders,
 (SELECT UNNEST(['registry_file_number', 'midwife_patient_code', 'facility_name', 'last_menstrual_period', 'visit_date', 'gestational_age_days', 'weight_kg', 'systolic_bp_mmhg', 'diastolic_bp_mmhg', 'fundal_height_cm', 'syphilis_test', 'hiv_test']) AS field, UNNEST(range(1, 13)) AS i)
 WHERE o_orderstatus IN ('P', 'F')""")
def blank_drafts(t):
    docs = t.orders.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "PENDING_AI").when(F.col("o_orderstatus") == "F", "PROCESSING_FAILED").otherwise("REGISTERED").alias("status"))
    return D.blank_drafts(docs, C.field_catalog(t.spark)).select("document_id", "field", F.coalesce("slot", F.lit("")).alias("slot"), "field_status")


@query("d11_match_page_sets", """
WITH s AS (SELECT l_orderkey, STRING_AGG(DISTINCT CAST(l_suppkey % 20 AS VARCHAR), ',' ORDER BY CAST(l_suppkey % 20 AS VARCHAR)) AS pages FROM lineitem GROUP BY 1),
lib AS (SELECT pages, MIN(l_orderkey) AS id FROM s JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT l_orderkey AS document_id, COALESCE(lib.id, -1) AS extraction_id, CASE WHEN lib.id IS NULL THEN 'NO_FIXTURE_FOR_PAGE_SET' ELSE '' END AS error FROM s LEFT JOIN lib ON lib.pages = s.pages""")
def page_sets(t):
    pages = t.lineitem.select(F.col("l_orderkey").alias("document_id"), (F.col("l_suppkey") % 20).cast("string").alias("page_ref"))
    stored = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    library = pages.join(stored, "document_id", "left_semi").withColumnRenamed("document_id", "extraction_id")
    return D.match_page_sets(pages, library).select("document_id", F.coalesce("extraction_id", F.lit(-1)).alias("extraction_id"), F.coalesce("error", F.lit("")).alias("error"))


@query("d12_current_results_only", """
WITH p AS (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS page FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey AS document_id, BOOL_OR(page % 97 = 0) AS moved FROM p GROUP BY 1),
r AS (SELECT document_id, k, moved, o_orderstatus AS s, o_orderkey % 3 = 0 AS old FROM b JOIN orders ON o_orderkey = document_id, (SELECT UNNEST([0, 1]) AS k))
SELECT document_id * 2 + k AS result_id, CASE WHEN document_id % 11 = 0 THEN 'VERIFIED_CLAIM' WHEN old OR s <> 'P' THEN 'STALE_REVISION' WHEN moved THEN 'STALE_PAGES' WHEN k = 1 THEN 'REPLAY' ELSE 'ACCEPTED' END AS verdict FROM r""")
def current_results(t):
    # Each document has two results of one revision; a page whose number divides by 97 has been photographed again since.
    pages = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    now = pages.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("position"), F.col("part").alias("page_id"), F.col("part").cast("string").alias("media_ref"),
                       F.lit(None).cast("string").alias("section_hint"), F.lit(None).cast("string").alias("replaced_by"))
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    seen = now.withColumn("page_id", F.when(F.col("page_id") % 97 == 0, -1).otherwise(F.col("page_id"))).withColumn("_k", k).withColumn("result_id", F.col("document_id") * 2 + F.col("_k")).drop("document_id", "_k", "replaced_by")
    docs = t.orders.select(F.col("o_orderkey").alias("document_id"), F.lit(3).alias("revision"), F.when(F.col("o_orderstatus") == "P", "PENDING_AI").otherwise("REGISTERED").alias("status"))
    results = pages.select(F.col("l_orderkey").alias("document_id")).distinct().withColumn("_k", k).select(
        "document_id", (F.col("document_id") * 2 + F.col("_k")).alias("result_id"), F.when(F.col("document_id") % 3 == 0, 2).otherwise(3).alias("revision"), (F.col("document_id") % 11 == 0).alias("claims_verification"))
    return D.current_results_only(results, seen, docs, now).select("result_id", "verdict")


# ------------------------------------------------------------------ validation

@query("v1_validate_drafts", """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT k AS document_id, 'schema_version' AS path, 'EXPECTED_VERSION' AS rule FROM o WHERE s = 'F'
UNION ALL SELECT k, 'pages', 'NON_EMPTY_LIST_EXPECTED' FROM o WHERE p = '1-URGENT'
UNION ALL SELECT k, 'pages[1]', 'PAGE_REF_EXPECTED' FROM o WHERE p = '2-HIGH'
UNION ALL SELECT k, 'pii_detected[0]', 'PII_ACTION' FROM o WHERE p = '3-MEDIUM'
UNION ALL SELECT k, 'encounters[0].slot', 'UNKNOWN_SLOT' FROM o WHERE p = '5-LOW'
UNION ALL SELECT k, 'extraction.extractor', 'TEXT_EXPECTED' FROM o WHERE s = 'P'
UNION ALL SELECT k, 'surprise', 'UNKNOWN_KEY' FROM o WHERE k % 7 = 0""")
def validate_drafts(t):
    p = F.col("o_orderpriority")
    page = lambda ref: F.struct(ref.cast("string").alias("page_ref"))
    drafts = t.orders.select(
        F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "0.9").otherwise(C.SCHEMA_VERSION).alias("schema_version"), F.lit(C.LAYOUT_ID).alias("layout_id"),
        F.struct(F.when(F.col("o_orderstatus") == "P", "").otherwise("grid").alias("extractor"), F.lit("1").alias("extractor_version")).alias("extraction"),
        F.when(p == "1-URGENT", F.array().cast("array<struct<page_ref:string>>")).otherwise(F.array(page(F.lit("a")), page(F.when(p != "2-HIGH", "b")))).alias("pages"),
        F.array(F.struct(F.when(p == "3-MEDIUM", "KEPT").otherwise("REDACTED").alias("action"))).alias("pii_detected"), F.create_map(F.lit("x"), F.lit("y")).alias("document_fields"),
        F.array(F.struct(F.lit("ANTENATAL").alias("encounter_type"), F.when(p == "5-LOW", "T9").otherwise("M7").alias("slot"), F.create_map(F.lit("x"), F.lit("y")).alias("fields"))).alias("encounters"),
        F.when(F.col("o_orderkey") % 7 == 0, '{"pages":[],"surprise":1}').otherwise('{"pages":[]}').alias("raw"))
    return V.validate_drafts(drafts, "raw")


@query("v2_validate_field_sets", """
WITH n AS (SELECT ['registry_file_number', 'midwife_patient_code', 'facility_name', 'last_menstrual_period', 'phone', 'cin', 'address'] AS names),
f AS (SELECT DISTINCT l_orderkey AS document_id, names[l_linenumber] AS field FROM lineitem, n), d AS (SELECT DISTINCT document_id FROM f)
SELECT d.document_id, w.field, 'MISSING_FIELD' AS rule FROM d, (SELECT UNNEST(names[1:4]) AS field FROM n) w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.document_id = d.document_id AND f.field = w.field)
UNION ALL SELECT document_id, field, 'UNKNOWN_FIELD' FROM f, n WHERE field IN ('phone', 'cin', 'address')""")
def field_sets(t):
    names = [*C.DOCUMENT_FIELDS, "phone", "cin", "address"]
    fields = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.lit("document").alias("scope"), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber")).alias("field"))
    return V.validate_field_sets(fields, fields, C.field_catalog(t.spark), ["document_id"]).select("document_id", "field", "rule")


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def values_to_check(t: Tables) -> DataFrame:
    return t.lineitem.select(
        *LINE, F.lit("weight_kg").alias("field"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity").cast("int").cast("string")).alias("value"), F.when(F.col("l_tax") > 0.075, "lb").otherwise("kg").alias("unit"),
        (1 - F.col("l_discount") * 4).alias("confidence"), F.when(F.col("l_returnflag") == "N", "KNOWN").when(F.col("l_returnflag") == "A", "ILLEGIBLE").otherwise("NEEDS_REVIEW").alias("field_status"),
        F.when(F.col("l_linestatus") == "F", "CONFIRMED").otherwise("UNVERIFIED").alias("verification_state"),
        F.when(F.col("l_linenumber") == 2, F.array(F.lit("CONFLICT_ACROSS_PAGES"))).otherwise(no_flags()).alias("validation_flags"))


@query("v3_validate_field_values", f"""WITH f AS (SELECT *, CAST(l_quantity AS INT) AS q, l_linenumber < 7 AS has, l_returnflag = 'N' AS known, 1 - l_discount * 4 AS c FROM lineitem)
SELECT {', '.join(LINE)}, UNNEST(list_filter([CASE WHEN l_tax > 0.075 THEN 'UNIT' END, CASE WHEN l_returnflag = 'A' AND has THEN 'VALUE_MUST_BE_NULL' END, CASE WHEN known AND NOT has THEN 'KNOWN_REQUIRES_VALUE' END,
 CASE WHEN known AND has AND q < 30 THEN 'OUT_OF_RANGE' END, CASE WHEN known AND l_linestatus = 'O' AND c < 0.75 THEN 'CONFIDENCE_BELOW_THRESHOLD' END, CASE WHEN known AND l_linestatus = 'O' AND l_linenumber = 2 THEN 'CONFLICT_KNOWN' END], lambda x: x IS NOT NULL)) AS rule FROM f""")
def field_values(t):
    return V.validate_field_values(values_to_check(t), C.field_catalog(t.spark), F.lit("2010-01-01").cast("date"), LINE).drop("field")


@query("v4_validate_sources", f"""SELECT {', '.join(LINE)}, CASE WHEN l_linenumber = 1 THEN 'TWO_READINGS_EXPECTED' WHEN l_linenumber = 2 THEN 'READING_INVALID' WHEN l_linenumber = 3 THEN 'NORMALIZATION' ELSE 'SOURCE_PAGE_REF' END AS rule
 FROM lineitem WHERE l_linenumber < 5 AND l_returnflag <> 'N'""")
def sources(t):
    bad = F.col("l_returnflag") != "N"
    reading = lambda status: F.struct(F.lit("p").alias("page_ref"), status.cast("string").alias("field_status"))
    one, two = F.array(reading(F.lit("KNOWN"))), F.array(reading(F.lit("KNOWN")), reading(F.when(bad & (F.col("l_linenumber") == 2), "LOST").otherwise("KNOWN")))
    norm = F.when(F.col("l_linenumber") == 3, F.struct(F.lit("cmHg").alias("from"), F.when(~bad, "mmHg").alias("to")))
    source = F.struct(F.when(~(bad & (F.col("l_linenumber") == 4)), "p").alias("page_ref"), F.when(bad & (F.col("l_linenumber") == 1), one).otherwise(two).alias("readings"), norm.alias("normalization"))
    return V.validate_sources(t.lineitem.select(*LINE, F.lit("x").alias("field"), source.alias("source")), LINE).drop("field")


@query("v5_validate_extended", """
WITH i AS (SELECT l_orderkey AS document_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) - 1 AS item_index, l_linenumber AS n, l_returnflag AS f FROM lineitem),
k AS (SELECT *, CASE WHEN n = 7 THEN '12' ELSE CAST(n AS VARCHAR) END AS item_key FROM i)
SELECT document_id, item_index, 'CATALOG_VERSION' AS rule FROM k WHERE f = 'A'
UNION ALL SELECT document_id, item_index, 'UNKNOWN_FIELD' FROM k WHERE f = 'R' UNION ALL SELECT document_id, item_index, 'UNKNOWN_ITEM' FROM k WHERE n = 7
UNION ALL SELECT document_id, item_index, 'DUPLICATE_ITEM' FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id, item_key ORDER BY item_index) AS no FROM k) WHERE no > 1""")
def extended(t):
    from ..scale import numbered
    rows = numbered(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"], F.col("l_linenumber"), "no")
    items = rows.select(F.col("l_orderkey").alias("document_id"), (F.col("no") - 1).alias("item_index"), F.when(F.col("l_returnflag") == "A", "old").otherwise(C.EXTENDED_VERSION).alias("catalog_version"),
                        F.lit("newborns").alias("section"), F.when(F.col("l_linenumber") == 7, "12").otherwise(F.col("l_linenumber").cast("string")).alias("item_key"),
                        F.when(F.col("l_returnflag") == "R", "shoe_size").otherwise("birth_weight_g").alias("field"))
    return V.validate_extended(items, C.extended_sections(t.spark), C.field_catalog(t.spark)).select("document_id", "item_index", "rule")


@query("v6_reject_verified_claims", "SELECT DISTINCT l_orderkey AS document_id FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'N' OR l_quantity = 50")
def claims(t):
    state = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), "CONFIRMED").otherwise("UNVERIFIED")
    return V.reject_verified_claims(t.lineitem.select(F.col("l_orderkey").alias("document_id"), state.alias("verification_state"), F.when(F.col("l_quantity") == 50, 1).alias("correction_count")))


@query("v7_pages_multiset_equal", """
SELECT DISTINCT document_id FROM (SELECT l_orderkey AS document_id, l_suppkey % 10 AS p, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) a
FULL JOIN (SELECT l_orderkey AS document_id, l_suppkey % 10 AS p, COUNT(*) AS n FROM lineitem WHERE l_quantity < 48 GROUP BY 1, 2) b USING (document_id, p) WHERE a.n IS DISTINCT FROM b.n""")
def multisets(t):
    pages = t.lineitem.select(F.col("l_orderkey").alias("document_id"), (F.col("l_suppkey") % 10).alias("page_ref"), "l_quantity")
    return V.pages_multiset_equal(pages, pages.where("l_quantity < 48"))


@query("v9_audit_uniqueness", """
SELECT 'visit' AS constraint_name, o_custkey || '|' || o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m-%d') AS key, COUNT(*) AS rows FROM orders GROUP BY o_custkey, o_orderpriority, o_orderdate HAVING COUNT(*) > 1
UNION ALL SELECT 'line', l_orderkey || '|' || l_linenumber, COUNT(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
UNION ALL SELECT 'sender', CAST(user_id AS VARCHAR), COUNT(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id
UNION ALL SELECT 'status', event_type, COUNT(*) FROM events WHERE event_type NOT IN ('view', 'click', 'error') GROUP BY event_type""")
def audit(t):
    visits = t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = (V.audit_duplicates(visits, ["o_custkey", "o_orderpriority", "day"], "visit").unionByName(V.audit_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], "line"))
           .unionByName(V.audit_orphans(t.events, "user_id", t.supplier, "s_suppkey", "sender")).unionByName(V.audit_values(t.events, "event_type", ["view", "click", "error"], "status")))
    return out.withColumnRenamed("constraint", "constraint_name")


@query("s9_read_truth", f"""WITH {FIRST_SQL} SELECT l_orderkey AS page, slot, 'weight_kg' AS field, CASE WHEN l_returnflag = 'A' THEN 'blank' ELSE 'value' END AS state, CASE WHEN l_returnflag = 'A' THEN '' ELSE CAST(q AS VARCHAR) END AS text FROM visits
 UNION ALL SELECT DISTINCT l_orderkey, '', 'registry_file_number', 'value', CAST(l_orderkey AS VARCHAR) FROM visits""")
def truth(t):
    cell = "struct<state:string,text:string,canonical:string,value:string,sha256:string,accept:array<string>>"
    make = lambda state, text: F.struct(state.alias("state"), text.alias("text"), *[F.lit(None).cast(ty).alias(n) for n, ty in (("canonical", "string"), ("value", "string"), ("sha256", "string"), ("accept", "array<string>"))])
    blank = F.col("l_returnflag") == "A"
    entry = F.struct(slot().alias("k"), F.create_map(F.lit("weight_kg"), make(F.when(blank, "blank").otherwise("value"), F.when(~blank, F.col("q").cast("string")))).alias("v"))
    pages = document_lines(t).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(entry)).alias("grid")).select(
        F.col("l_orderkey").alias("page"), F.lit(1).alias("patient"), F.lit("s").alias("split"), F.lit("current_pregnancy").alias("layout"), F.lit("current_pregnancy").alias("expected_section"), F.lit(True).alias("supported"),
        "grid", F.lit(None).cast(f"map<string,map<string,{cell}>>").alias("labs"), F.create_map(F.lit("registry_file_number"), make(F.lit("value"), F.col("l_orderkey").cast("string"))).alias("keys"),
        F.lit(None).cast(f"map<string,{cell}>").alias("document_fields"), F.lit(None).cast(f"array<struct<section:string,item:string,field:string,{cell[7:-1]}>>").alias("extended"))
    return flatten_truth(pages).select("page", F.coalesce("slot", F.lit("")).alias("slot"), "field", "state", F.coalesce("text", F.lit("")).alias("text"))
