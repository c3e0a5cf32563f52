"""The analytic table per customer, and the files around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import export as E
from ..scale import first_by
from ..sources import files as S
from .forms import COPIES_SQL
from .registry import Tables, query

FIELDS = ["systolic_bp_mmhg", "diastolic_bp_mmhg", "hiv_test", "syphilis_test", "gestational_age_days", "weight_kg", "fundal_height_cm"]


def document_lines(t: Tables) -> DataFrame:
    """The lines of a document; see `registry.SheetTables`."""
    return t.lineitem.withColumn("q", F.col("l_quantity").cast("int"))


def status_columns():
    return [F.when(F.col("l_returnflag") == "A", "NEEDS_REVIEW").otherwise("KNOWN").alias("field_status"), F.when(F.col("l_linestatus") == "F", "CONFIRMED").when(F.col("l_returnflag") == "N", "CORRECTED").otherwise("UNVERIFIED").alias("verification_state")]


VERIFIED_SQL = "(l_returnflag <> 'A' AND (l_linestatus = 'F' OR l_returnflag = 'N'))"


def visit_fields(t: Tables) -> DataFrame:
    """Orders are visits of their customer; each line number is one field of the visit."""
    q = F.col("q")
    answer = F.when(q % 2 == 0, "POSITIVE").otherwise("NEGATIVE")
    value = F.when(F.col("l_linenumber") == 1, (q + 90).cast("string")).when(F.col("l_linenumber") == 2, (q + 50).cast("string")).when(F.col("l_linenumber").isin(3, 4), answer).when(F.col("l_linenumber") == 5, (q * 5).cast("string")).otherwise(q.cast("string"))
    rows = document_lines(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderstatus"), "l_orderkey")
    return rows.select(F.col("o_custkey").alias("patient_id"), F.col("l_orderkey").alias("visit_id"), F.when(F.col("l_orderkey") % 19 != 0, F.to_date("o_orderdate")).alias("visit_date"), F.element_at(F.array(*[F.lit(f) for f in FIELDS]), F.col("l_linenumber")).alias("field"),
                       value.alias("value"), value.try_cast("double").alias("value_num"), *status_columns())


def visits(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("visit_id"), F.when(F.col("o_orderkey") % 19 != 0, F.to_date("o_orderdate")).alias("visit_date"), 
                           F.element_at(F.array(*[F.lit(s) for s in C.GRID_SLOTS]), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("slot"), F.array(document()).alias("source_documents"), "o_orderstatus", "o_orderpriority")


def document(column: str = "o_orderkey"):
    """As wide as any whole number, so that ids of long keys stay different and order as the keys do."""
    return F.concat(F.lit("DOC-"), F.lpad(F.col(column).cast("string"), 19, "0"))


def short_document(column: str = "document_id"):
    """The nine characters that the SQL shows of an id; longer keys are cut only here, after every join and maximum."""
    return F.concat(F.lit("DOC-"), F.lpad(F.substring_index(column, "-", -1).cast("long").cast("string"), 9, "0"))


def documents(t: Tables) -> DataFrame:
    """Documents of an order belong to its customer once registered; a low-priority one was registered for the next customer as well."""
    return t.orders.select(document().alias("document_id"), F.when(F.col("o_orderstatus") == "F", "REGISTERED").otherwise("CAPTURED").alias("status"), F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("patient_id"))


EXT = [("pregnancy", "maternal_age_years"), ("pregnancy", "parity"), ("previous_deliveries", "previous_delivery_mode_text"), ("delivery", "delivery_mode"), ("newborns", "newborn_sex"), ("newborns", "birth_weight_g"), ("visit_labs", "hemoglobin_g_dl")]


def extended_fields(t: Tables) -> DataFrame:
    """Orders that are not pending have an extended part, one field per line number."""
    q, n = F.col("q"), F.col("l_linenumber")
    mode = F.when(q % 3 == 0, "cesarienne").when(q % 3 == 1, "voie basse").otherwise("Césarienne")
    value = (F.when(n == 1, q.cast("string")).when(n == 2, (q % 6).cast("string")).when(n == 3, mode).when(n == 4, F.when(q % 2 == 0, "CESAREAN_PLANNED").otherwise("VAGINAL_INSTRUMENTAL"))
             .when(n == 5, F.when(q % 2 == 0, "MALE").otherwise("FEMALE")).when(n == 6, (q * 100).cast("string")).otherwise((q % 10 + 8).cast("string")))
    at = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in EXT]), n)
    rows = document_lines(t).join(t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    key = F.when(n == 7, F.element_at(F.array(*[F.lit(s) for s in C.GRID_SLOTS]), (q % 9 + 1).cast("int"))).otherwise("1")
    return rows.select(document("l_orderkey").alias("document_id"), at(0).alias("section"), F.when(n == 6, F.when(q > 25, 1).otherwise(0)).otherwise(0).alias("item_index"), key.alias("item_key"), at(1).alias("field"), value.alias("value"), value.try_cast("double").alias("value_num"), *status_columns())


EXPORT_SQL = f"""{COPIES_SQL}, l AS (SELECT *, {VERIFIED_SQL} AS ok FROM copies WHERE page_no = 1),
vf AS (SELECT o_custkey AS p, l_orderkey AS v, CASE WHEN l_orderkey % 19 <> 0 THEN o_orderdate END AS d, l_linenumber AS n, q, ok FROM l JOIN orders ON o_orderkey = l_orderkey WHERE ok),
vc AS (SELECT p, CAST(printf('%.1f', SUM(q + 90) FILTER (n = 1) / COUNT(*) FILTER (n = 1)) AS DOUBLE) AS sys, CAST(printf('%.1f', SUM(q + 50) FILTER (n = 2) / COUNT(*) FILTER (n = 2)) AS DOUBLE) AS dia FROM vf WHERE d IS NOT NULL GROUP BY 1),
ear AS (SELECT p, n, q, ROW_NUMBER() OVER (PARTITION BY p, n ORDER BY d, v) AS no FROM vf WHERE d IS NOT NULL AND n IN (3, 4, 5)),
ec AS (SELECT p, MAX(CASE WHEN n = 3 THEN CASE WHEN q % 2 = 0 THEN 1 ELSE 0 END END) AS hiv, MAX(CASE WHEN n = 4 THEN CASE WHEN q % 2 = 0 THEN 1 ELSE 0 END END) AS syph, MAX(CASE WHEN n = 5 THEN q * 5 // 7 END) AS ga FROM ear WHERE no = 1 GROUP BY 1),
src AS (SELECT o_custkey AS p, o_orderkey AS doc FROM orders UNION SELECT CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey + 1 ELSE o_custkey END, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
hasx AS (SELECT DISTINCT l_orderkey AS doc FROM l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'),
ch AS (SELECT p, MAX(doc) AS doc FROM src JOIN hasx USING (doc) GROUP BY 1),
x AS (SELECT ch.p, ch.doc, l_linenumber AS n, q FROM ch JOIN l ON l_orderkey = ch.doc WHERE ok),
xc AS (SELECT p, MAX(CASE WHEN n = 1 THEN q END) AS age, MAX(CASE WHEN n = 2 THEN q % 6 END) AS parity, MAX(CASE WHEN n = 3 THEN CASE WHEN q % 3 = 0 THEN 1 WHEN q % 3 = 1 THEN 0 END END) AS ces,
 MAX(CASE WHEN n = 4 THEN CASE WHEN q % 2 = 0 THEN 1 ELSE 0 END END) AS mode, MAX(CASE WHEN n = 5 THEN CASE WHEN q % 2 = 0 THEN 1 ELSE 0 END END) AS sex, MAX(CASE WHEN n = 6 AND q <= 25 THEN q * 100 END) AS weight, MAX(CASE WHEN n = 7 THEN q % 10 + 8 END) AS hb FROM x GROUP BY 1)"""
_EXPR = {"id": "'EXP-' || c_custkey", "age (years)": "age", "parity (number)": "parity", "previous cesarean": "ces", "mean systolic bp (mmhg)": "sys", "mean diastolic bp (mmhg)": "dia", "hemoglobin (g/dl)": "hb", "hiv test result": "hiv",
         "syphilis test result": "syph", "gestational age at enrollment (weeks)": "ga", "type of delivery (0=vaginal,1=cesarean)": "mode", "newborn sex (0=female,1=male)": "sex", "child birth weight (g)": "weight"}
EXPORT_COLUMNS_SQL = ", ".join(f'{_EXPR[h]} AS "{h}"' if h == "id" else f'CAST({_EXPR.get(h, "NULL")} AS DOUBLE) AS "{h}"' for h in C.EXPORT_HEADERS)


def export(t: Tables) -> DataFrame:
    rows = E.export_rows(t.customer.select(F.col("c_custkey").alias("patient_id")), visit_fields(t), visits(t), documents(t), extended_fields(t), C.slots(t.spark))
    return rows.select(*[F.col(f"`{h}`") if h == "id" else F.col(f"`{h}`").cast("double") for h in C.EXPORT_HEADERS])


@query("e9_export_rows", f"WITH {EXPORT_SQL} SELECT {EXPORT_COLUMNS_SQL} FROM customer LEFT JOIN vc ON vc.p = c_custkey LEFT JOIN ec ON ec.p = c_custkey LEFT JOIN xc ON xc.p = c_custkey")
def export_rows(t):
    return export(t)


@query("e2_mean_verified", f"WITH {EXPORT_SQL} SELECT DISTINCT vf.p AS patient_id, sys AS systolic, dia AS diastolic FROM vf JOIN vc ON vc.p = vf.p WHERE d IS NOT NULL AND (sys IS NOT NULL OR dia IS NOT NULL)")
def means(t):
    c = E.visit_columns(visit_fields(t)).select("patient_id", F.col("`mean systolic bp (mmhg)`").alias("systolic"), F.col("`mean diastolic bp (mmhg)`").alias("diastolic"))
    return c.where("systolic IS NOT NULL OR diastolic IS NOT NULL")


@query("e3_earliest_verified", f"WITH {EXPORT_SQL} SELECT p AS patient_id, COALESCE(hiv, -1) AS hiv, COALESCE(syph, -1) AS syphilis, CAST(COALESCE(ga, -1) AS BIGINT) AS weeks FROM ec")
def earliest(t):
    c = E.visit_columns(visit_fields(t))
    zero = lambda h, n: F.coalesce(F.col(f"`{h}`"), F.lit(-1)).alias(n)
    return c.select("patient_id", zero("hiv test result", "hiv"), zero("syphilis test result", "syphilis"), zero("gestational age at enrollment (weeks)", "weeks")).where("hiv >= 0 OR syphilis >= 0 OR weeks >= 0")


@query("e4_earliest_lab", f"""WITH {COPIES_SQL}, l AS (SELECT *, {VERIFIED_SQL} AS ok FROM copies WHERE page_no = 1),
v AS (SELECT o_custkey AS p, o_orderkey % 9 AS s, MIN(CASE WHEN o_orderkey % 19 <> 0 THEN o_orderdate END) AS d FROM orders GROUP BY 1, 2),
x AS (SELECT o_custkey AS p, l_orderkey, l_linenumber, q % 9 AS s, q FROM l JOIN orders ON o_orderkey = l_orderkey WHERE ok),
r AS (SELECT x.p, q, ROW_NUMBER() OVER (PARTITION BY x.p ORDER BY v.d IS NULL, v.d, x.s, l_orderkey, l_linenumber) AS no, MIN(q % 9) OVER (PARTITION BY x.p) AS mn FROM x LEFT JOIN v ON v.p = x.p AND v.s = x.s)
SELECT r.p AS patient_id, CAST(q % 9 AS DOUBLE) AS hemoglobin_g_dl FROM r WHERE no = 1""")
def labs(t):
    # The value of a laboratory row is its slot number, so that ties within a slot do not matter.
    rows = document_lines(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(
        F.col("o_custkey").alias("patient_id"), F.element_at(F.array(*[F.lit(s) for s in C.GRID_SLOTS]), (F.col("q") % 9 + 1).cast("int")).alias("slot"), F.lit("hemoglobin_g_dl").alias("field"), F.lit("x").alias("value"),
        (F.col("q") % 9).cast("double").alias("value_num"), *status_columns())
    return E.earliest_labs(rows, visits(t), C.slots(t.spark), "hemoglobin_g_dl")


@query("e6_previous_cesarean", f"WITH {COPIES_SQL}, l AS (SELECT o_custkey AS p, q FROM copies JOIN orders ON o_orderkey = l_orderkey WHERE page_no = 1 AND l_linenumber = 3 AND {VERIFIED_SQL}) SELECT p AS patient_id, CASE WHEN BOOL_OR(q % 3 = 0) THEN 1 WHEN BOOL_AND(q % 3 = 1) THEN 0 ELSE -1 END AS previous_cesarean FROM l GROUP BY 1")
def cesarean(t):
    rows = document_lines(t).where("l_linenumber = 3").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").withColumns({
        "value": F.when(F.col("q") % 3 == 0, "CESARienne").when(F.col("q") % 3 == 1, "Voie basse").otherwise("Césarienne")})
    rows = rows.select(F.col("o_custkey").alias("patient_id"), "value", *status_columns())
    ok = rows.where(E.is_verified(F.col("field_status"), F.col("verification_state")))
    return ok.groupBy("patient_id").agg(F.coalesce(E.previous_cesarean(F.col("value")), F.lit(-1)).alias("previous_cesarean"))


@query("e8_latest_extended", f"WITH {EXPORT_SQL} SELECT p AS patient_id, 'DOC-' || LPAD(CAST(doc AS VARCHAR), 9, '0') AS document_id FROM ch")
def latest(t):
    sources = visits(t).select("patient_id", F.explode("source_documents").alias("document_id"))
    return E.latest_extended(sources, documents(t), extended_fields(t)).withColumn("document_id", short_document())


@query("e10_coverage", f"""WITH {EXPORT_SQL}, r AS (SELECT {EXPORT_COLUMNS_SQL} FROM customer LEFT JOIN vc ON vc.p = c_custkey LEFT JOIN ec ON ec.p = c_custkey LEFT JOIN xc ON xc.p = c_custkey)
""" + " UNION ALL ".join(f"SELECT '{c}' AS category, {sum(1 for _h, k, _i in C.EXPORT_COLUMNS if k == c)}::BIGINT AS columns, CAST({' + '.join(f'COUNT({chr(34)}{h}{chr(34)})' for h, k, _i in C.EXPORT_COLUMNS if k == c)} AS BIGINT) AS filled FROM r" for c in C.COVERAGE))
def coverage(t):
    # Columns per category, with the cells each category fills in the export.
    filled = export(t).agg(*[F.count(F.col(f"`{h}`")).alias(f"c{i}") for i, h in enumerate(C.EXPORT_HEADERS)])
    cells = filled.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("number"), F.col(f"c{i}").alias("filled")) for i in range(len(C.EXPORT_HEADERS))])).alias("x")).select("x.*")
    catalog = C.export_columns(t.spark)
    return E.coverage(catalog).join(catalog.join(cells, "number").groupBy("category").agg(F.sum("filled").alias("filled")), "category")


PROFILED = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("e11_profile_registry", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS blanks, MIN({c}) AS minimum, MAX({c}) AS maximum, CAST(COUNT(*) FILTER ({c} = FLOOR({c})) AS BIGINT) AS whole, COUNT(DISTINCT {c}) AS distinct_values,
 CAST(COUNT(*) FILTER ({c} = (SELECT MAX({c}) FROM lineitem)) AS BIGINT) AS at_maximum FROM lineitem""" for c in PROFILED))
def profile(t):
    return E.profile(t.lineitem, PROFILED).withColumnRenamed("column", "column_name")


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("e11_row_rules", " UNION ALL ".join(f"SELECT {', '.join(LINE)}, '{rule}' AS rule FROM lineitem WHERE {test}" for rule, test in (
    ("parity_within_gravidity", "l_linenumber - 1 > l_quantity"), ("enrollment_before_birth", "l_quantity < 10"), ("preterm_iff_below_37", "(l_returnflag = 'A') <> (l_quantity < 37)"),
    ("cesarean_needs_parity", "l_linestatus = 'F' AND l_linenumber = 1"))))
def rules(t):
    rows = t.lineitem.select(*LINE, (F.col("l_linenumber") - 1).alias("parity (number)"), F.col("l_quantity").alias("gravidity (number)"), F.lit(10.0).alias("gestational age at enrollment (weeks)"),
                             F.col("l_quantity").alias("gestational age at birth (weeks)"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("preterm birth"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("previous cesarean"))
    return E.row_rules(rows, E.registry_rules(), LINE)


@query("s4_audit_manifest", """SELECT 'doc/' || doc_id AS path, CASE WHEN source = 'src1' THEN 'MISSING' WHEN source = 'src2' THEN 'EXTRA' WHEN source = 'src3' THEN 'SIZE' WHEN source = 'src4' THEN 'HASH' ELSE 'OK' END AS state FROM documents""")
def audit(t):
    # Documents as files: some are gone, some are new, some changed in size or content.
    d = t.documents.withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id")))
    source = F.col("source")
    manifest = d.where(source != "src2").select("path", F.length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    files = d.where(source != "src1").select("path", F.when(source == "src3", F.length("text") + 1).otherwise(F.length("text")).alias("bytes"),
                                             F.when(source == "src4", F.sha2(F.reverse("text"), 256)).otherwise(F.upper(F.sha2("text", 256))).alias("sha256"))
    return S.audit_manifest(manifest, files)


@query("s11_store_media_refs", """WITH m AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'MAGIC' WHEN lang = 'es' THEN 'SUFFIX' ELSE '' END AS reason, sha256(text) AS h FROM documents)
SELECT doc_id, reason AS reject_reason, CASE WHEN reason <> '' THEN false ELSE doc_id = MIN(CASE WHEN reason = '' THEN doc_id END) OVER (PARTITION BY h) END AS stored FROM m""")
def media(t):
    # Texts behind a JPEG signature stand for photos; exact copies are stored once.
    lang = F.col("lang")
    head = F.unhex(F.when(lang == "de", "0000").otherwise("FFD8FF"))
    rows = t.documents.select("doc_id", F.concat(head, F.col("text").cast("binary")).alias("content"), F.when(lang == "es", ".gif").otherwise(".JPG").alias("suffix"))
    refs, stored = S.store_media_refs(rows, key="doc_id")
    kept = stored.select("media_ref", F.sha2("content", 256).alias("digest"))
    first = first_by(refs.where("media_ref IS NOT NULL").select("media_ref", "doc_id"), ["media_ref"], ["doc_id"]).join(kept, "media_ref").where(F.startswith("media_ref", "digest")).select("doc_id", F.lit(True).alias("stored"))
    return refs.join(first, "doc_id", "left").select("doc_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"), F.coalesce("stored", F.lit(False)).alias("stored"))


@query("s12_field_catalog", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ['digits', 'code', 'text', 'date', 'bp', 'enum', 'choice'][l_linenumber] AS kind, ['', '', '', '', 'mmHg', '', ''][l_linenumber] AS unit,
  CASE WHEN l_linenumber = 7 THEN 'newborns' WHEN l_linenumber < 5 THEN 'document' ELSE 'encounter' END AS section FROM lineitem""")
def field_catalog(t):
    # The catalog looked up for the field of every line.
    names = ["registry_file_number", "midwife_patient_code", "facility_name", "last_menstrual_period", "systolic_bp_mmhg", "hiv_test", "newborn_sex"]
    catalog = F.broadcast(C.field_catalog(t.spark).select("field", "kind", F.coalesce("unit", F.lit("")).alias("unit"), "section"))
    return t.lineitem.select(*LINE, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber")).alias("field")).join(catalog, "field").drop("field")
