"""Q1-Q18 on order lines (cells and readings), documents with labels, and events (timings)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import scoring as Q
from .drafts import FIRST_SQL, document_lines
from .forms import COPIES_SQL, slot
from .registry import Tables, query


def text(*columns: str):
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]


# ------------------------------------------------------------------ truth

@query("q1_truth_cells", f"""WITH {COPIES_SQL}, ch AS (SELECT l_orderkey AS page, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS no, CAST(q % 10 AS VARCHAR) AS c, q * 20 AS x, l_linenumber * 25 + l_suppkey % 20 - 10 AS y FROM copies),
p AS (SELECT *, CASE WHEN x >= 100 AND x < 1000 THEN x // 100 END AS col, (y + 12) // 25 AS r FROM ch)
SELECT page, CAST(col AS BIGINT) AS col, CAST(CASE WHEN y - 25 * r > 12 OR (y - 25 * r) * 2 > 25 THEN r + 1 ELSE r END AS BIGINT) AS row, STRING_AGG(c, '' ORDER BY no) AS text FROM p WHERE col IS NOT NULL AND ABS(y - 25 * r) <= 8 AND r BETWEEN 0 AND 8 GROUP BY 1, 2, 3""")
def truth_cells(t):
    from ..scale import numbered
    rows = numbered(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"], F.col("l_linenumber"), "no")
    q = F.col("l_quantity").cast("int")
    chars = rows.select(F.col("l_orderkey").alias("page"), "no", (q % 10).cast("string").alias("char"), (q * 20).cast("double").alias("x"), (F.col("l_linenumber") * 25 + F.col("l_suppkey") % 20 - 10).cast("double").alias("y"))
    pages = t.lineitem.select(F.col("l_orderkey").alias("page")).distinct()
    heads = pages.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(9)))).select("page", (F.col("c") * 100.0).alias("left"), (F.col("c") * 100.0 + 100).alias("right"), F.col("c").cast("string").alias("slot"))
    bands = pages.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("page", (F.col("r") * 25.0).alias("y"), F.col("r").cast("string").alias("row"))
    return Q.truth_cells(chars, heads, bands).select("page", F.col("slot").cast("long").alias("col"), F.col("row").cast("long").alias("row"), "text")


@query("q2_cell_state", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_tax = 0.08 THEN 'illegible' WHEN l_returnflag = 'A' THEN 'blank' WHEN l_linestatus = 'F' THEN 'dash' ELSE 'value' END AS state FROM lineitem""")
def cell_state(t):
    line = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    cells = t.lineitem.select(*line, F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", "  ")).when(F.col("l_linestatus") == "F", " — ").otherwise(" 12 ").alias("text"))
    fixes = t.lineitem.where("l_tax = 0.08").select(*line, F.lit("illegible").alias("state"), F.lit(None).cast("string").alias("text"))
    return Q.with_corrections(cells.withColumn("state", Q.cell_state(F.col("text"))), fixes, line).select(*line, "state")


@query("q3_canonical", f"""WITH {FIRST_SQL}, c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'dash' ELSE 'value' END AS state, q FROM visits)
SELECT l_orderkey AS page, l_linenumber AS item, 'systolic_bp_mmhg' AS field, CASE WHEN state = 'value' THEN CAST((q % 6 + 10) * 10 AS VARCHAR) ELSE '' END AS want FROM c WHERE l_linenumber < 4
UNION ALL SELECT l_orderkey, l_linenumber, 'diastolic_bp_mmhg', CASE WHEN state = 'value' THEN CAST((q % 3 + 6) * 10 AS VARCHAR) ELSE '' END FROM c WHERE l_linenumber < 4
UNION ALL SELECT l_orderkey, l_linenumber, 'weight_kg', CASE WHEN state = 'value' THEN CASE WHEN l_linenumber = 7 THEN 'given' ELSE CAST(q + 40 AS VARCHAR) END ELSE '' END FROM c WHERE l_linenumber >= 4""")
def canonical(t):
    from ..functions.normalize import normalize_fields
    low = F.col("l_linenumber") < 4
    cells = document_lines(t).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("item"), F.when(low, "bp").otherwise("weight_kg").alias("field"), F.when(F.col("l_returnflag") == "A", "dash").otherwise("value").alias("state"),
                                   F.when(F.col("l_returnflag") == "A", "-").when(low, F.concat_ws("/", F.col("q") % 6 + 10, F.col("q") % 3 + 6)).otherwise(F.concat(F.col("q") + 40, F.lit(" kg"))).alias("text"),
                                   F.when(F.col("l_linenumber") == 7, "given").alias("canonical"), F.lit(None).cast("string").alias("choice"))
    parsed = normalize_fields(Q.split_pressure(cells), C.field_catalog(t.spark), C.choice_spellings(t.spark), F.lit("2010-01-01").cast("date"), raw="text")
    return Q.canonical(parsed).select("page", "item", "field", *text("want"))


@query("q4_same_value", """SELECT doc_id, lang = 'en' OR doc_id % 2 = 0 AS same_text, doc_id % 3 <> 2 AS same_number FROM documents""")
def same_value(t):
    # English titles are written in another case, even documents have an accepted alternative; two of three numbers agree.
    name = F.concat(F.lit("Été de "), F.col("source"))
    got = F.when(F.col("lang") == "en", F.concat(F.lit("ETE  de-"), F.col("source"))).otherwise(F.lit("hiver"))
    got = F.regexp_replace(got, "-", " ")
    accept = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Hiver!"))).otherwise(F.array(F.lit("printemps")))
    number = (F.col("doc_id") * 0.5).cast("string")
    read = F.when(F.col("doc_id") % 3 == 0, F.concat(number, F.lit("0000001"))).when(F.col("doc_id") % 3 == 1, number).otherwise(F.concat(F.lit("1"), number))
    return t.documents.select("doc_id", Q.same_value(got, name, F.lit("text"), accept).alias("same_text"), Q.same_value(read, number, F.lit("decimal"), accept).alias("same_number"))


# ------------------------------------------------------------------ outcomes

def truth(t: Tables) -> DataFrame:
    """What is on paper: a weight per line of an order; some cells are blank."""
    blank = F.col("l_returnflag") == "A"
    return document_lines(t).select(
        F.col("l_orderkey").alias("page"), F.lit("encounter").alias("section"), slot().alias("slot"), F.lit(None).cast("string").alias("item"), F.lit("weight_kg").alias("field"), F.when(blank, "blank").otherwise("value").alias("state"),
        F.when(~blank, F.col("q").cast("string")).alias("want"), F.lit(None).cast("string").alias("choice"), F.array().cast("array<string>").alias("accept"), F.col("l_linenumber").alias("slot_ord"), (F.col("l_discount") < 0.085).alias("in_visit"),
        F.when(F.col("l_orderkey") % 2 == 0, "clean").otherwise("photo").alias("condition"), F.lit("current_pregnancy").alias("layout"), F.lit(True).alias("supported"), F.lit(None).cast("string").alias("sha256"))


def predictions(t: Tables) -> DataFrame:
    """What was read: nothing for a high tax, another value for some suppliers, no value for the last line number."""
    status = F.when(F.col("l_linestatus") == "F", "KNOWN").when(F.col("l_suppkey") % 7 == 0, "ILLEGIBLE").when(F.col("l_suppkey") % 7 == 1, "NOT_PROVIDED").otherwise("NEEDS_REVIEW")
    value = F.when(F.col("l_linenumber") < 7, F.when(F.col("l_suppkey") % 5 == 0, F.col("q") + 1).otherwise(F.col("q")).cast("string"))
    return document_lines(t).where("l_tax < 0.075").select(F.col("l_orderkey").alias("page"), F.lit("encounter").alias("section"), slot().alias("slot"), F.lit(None).cast("string").alias("item"), F.lit("weight_kg").alias("field"), value.alias("value"),
                                                         status.alias("field_status"), (1 - F.col("l_discount")).alias("confidence"))


OUTCOME_SQL = f"""{FIRST_SQL}, o AS (SELECT *, l_tax < 0.075 AS present, l_linenumber < 7 AND l_suppkey % 5 <> 0 AS good, l_linenumber < 7 AS val, CASE WHEN l_linestatus = 'F' THEN 'KNOWN' WHEN l_suppkey % 7 = 0 THEN 'ILLEGIBLE' WHEN l_suppkey % 7 = 1 THEN 'NOT_PROVIDED' ELSE 'NEEDS_REVIEW' END AS st,
  CASE WHEN l_orderkey % 2 = 0 THEN 'clean' ELSE 'photo' END AS condition FROM visits),
scored AS (SELECT *, CASE WHEN l_returnflag <> 'A' THEN CASE WHEN NOT present THEN 'no_field' WHEN st = 'KNOWN' THEN CASE WHEN good THEN 'correct_known' ELSE 'wrong_known' END WHEN st = 'NEEDS_REVIEW' THEN CASE WHEN good THEN 'review_right' WHEN val THEN 'review_wrong' ELSE 'review_empty' END
   WHEN st = 'ILLEGIBLE' THEN 'marked_illegible' ELSE 'claimed_missing' END
  ELSE CASE WHEN NOT present THEN 'absent_ok' WHEN st = 'NOT_PROVIDED' THEN 'missing_ok' WHEN st = 'ILLEGIBLE' THEN 'blank_marked_illegible' WHEN st = 'KNOWN' THEN 'wrong_known_blank' ELSE 'review_on_blank' END END AS outcome FROM o)"""


def scored(t: Tables) -> DataFrame:
    return Q.classify_outcomes(truth(t), predictions(t).drop("item", "section"), ["page", "slot"], C.field_catalog(t.spark))


@query("q5_classify_outcomes", f"WITH {OUTCOME_SQL} SELECT l_orderkey AS page, slot, outcome FROM scored")
def classify_outcomes(t):
    return scored(t).select("page", "slot", "outcome")


@query("q6_score_pages", f"""WITH {OUTCOME_SQL} SELECT l_orderkey AS page, slot, 'grid' AS kind, outcome, CASE WHEN l_returnflag = 'A' THEN '' ELSE CAST(q AS VARCHAR) END AS want FROM scored
 UNION ALL SELECT o_orderkey, '', 'patient_key', CASE WHEN o_orderstatus = 'F' THEN 'correct_known' WHEN o_orderstatus = 'P' THEN 'review_wrong' ELSE 'no_field' END, '' FROM orders""")
def score_pages(t):
    from ..functions.privacy import key_hash
    k = F.col("o_orderkey").cast("string")
    null = F.lit(None).cast("string")
    keys = t.orders.select(F.col("o_orderkey").alias("page"), F.lit("document").alias("section"), null.alias("slot"), null.alias("item"), F.lit("registry_file_number").alias("field"), F.lit("value").alias("state"), null.alias("want"), null.alias("choice"),
                           F.array().cast("array<string>").alias("accept"), F.lit(0).alias("slot_ord"), F.lit(True).alias("in_visit"), F.lit("clean").alias("condition"), F.lit("cover").alias("layout"), F.lit(True).alias("supported"),
                           key_hash(F.lit("registry_file_number"), k, "salt").alias("sha256"))
    read = t.orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("page"), F.lit("document").alias("section"), null.alias("slot"), null.alias("item"), F.lit("registry_file_number").alias("field"),
                                                         F.when(F.col("o_orderstatus") == "F", k).otherwise("999").alias("value"), F.when(F.col("o_orderstatus") == "F", "KNOWN").otherwise("NEEDS_REVIEW").alias("field_status"), F.lit(0.9).alias("confidence"))
    rows = Q.score_pages(truth(t).unionByName(keys), predictions(t).unionByName(read), C.field_catalog(t.spark), "salt")
    return rows.select("page", "slot", F.col("group").alias("kind"), "outcome", *text("want"))


@query("q8_visit_set_diff", """WITH e AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS slot FROM lineitem WHERE l_returnflag <> 'A'), f AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS slot FROM lineitem WHERE l_linestatus = 'F')
SELECT page, COUNT(e.slot) AS expected, COUNT(f.slot) AS found, COUNT(*) FILTER (f.slot IS NULL) AS missed, COUNT(*) FILTER (e.slot IS NULL) AS extra, COUNT(*) FILTER (f.slot IS NULL OR e.slot IS NULL) = 0 AS exact FROM e FULL JOIN f USING (page, slot) GROUP BY page""")
def visit_sets(t):
    pick = lambda test: t.lineitem.where(test).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("slot"))
    return Q.visit_set_diff(pick("l_returnflag <> 'A'"), pick("l_linestatus = 'F'"), ["page"])


@query("q9_shifted_values", f"""WITH {FIRST_SQL}, g AS (SELECT l_orderkey AS page, l_linenumber AS n, q // 5 AS want, (q + l_suppkey % 10) // 5 AS got FROM visits), w AS (SELECT *, LAG(want) OVER v AS b, LEAD(want) OVER v AS a FROM g WINDOW v AS (PARTITION BY page ORDER BY n))
SELECT page, n AS slot_ord FROM w WHERE got <> want AND (got = b OR got = a)""")
def shifted(t):
    cells = document_lines(t).select(F.col("l_orderkey").alias("page"), F.lit("weight_kg").alias("field"), F.col("l_linenumber").alias("slot_ord"), F.expr("q div 5").alias("want"), F.expr("(q + l_suppkey % 10) div 5").alias("got"))
    return Q.shifted_values(cells, ["page"]).select("page", "slot_ord")


_NAMES = [*C.WRITTEN_OUTCOMES, *C.EMPTY_OUTCOMES]
_COUNTS = ", ".join(f"COUNT(*) FILTER (outcome = '{n}') AS {n}" for n in _NAMES)


@query("q10_outcome_counts", f"""WITH {OUTCOME_SQL}, k AS (SELECT * FROM scored WHERE l_discount < 0.085 OR outcome <> 'absent_ok'),
c AS (SELECT COALESCE(condition, '') AS condition, COALESCE(slot, '') AS slot, {_COUNTS} FROM k GROUP BY GROUPING SETS ((condition), (condition, slot)))
SELECT *, CAST({' + '.join(C.WRITTEN_OUTCOMES)} AS BIGINT) AS written, CAST({' + '.join(C.EMPTY_OUTCOMES)} AS BIGINT) AS empty, CAST(round_even(100.0 * correct_known / ({' + '.join(C.WRITTEN_OUTCOMES)}), 0) AS INT) AS correct_pct FROM c""")
def outcome_counts(t):
    return Q.outcome_counts(scored(t), [["condition"], ["condition", "slot"]]).withColumns({"condition": F.coalesce("condition", F.lit("")), "slot": F.coalesce("slot", F.lit(""))})


@query("q11_section_confusion", """SELECT lang AS layout, CASE WHEN guess = lang THEN 'right' ELSE guess END AS found, COUNT(*) AS pages, COUNT(*) FILTER (n_chars < 500) AS reviewed
 FROM (SELECT *, CASE WHEN regexp_matches(text, '[ \n](the|and)[ \n.,]') THEN 'en' WHEN regexp_matches(text, '[ \n](der|und)[ \n.,]') THEN 'de' WHEN regexp_matches(text, '[ \n](le|que)[ \n.,]') THEN 'fr' ELSE 'not read' END AS guess FROM documents) GROUP BY 1, 2""")
def confusion(t):
    guess = F.when(F.col("text").rlike("[ \n](the|and)[ \n.,]"), "en").when(F.col("text").rlike("[ \n](der|und)[ \n.,]"), "de").when(F.col("text").rlike("[ \n](le|que)[ \n.,]"), "fr")
    runs = t.documents.select(F.col("lang").alias("layout"), F.col("lang").alias("expected_section"), guess.alias("section"), F.when(F.col("n_chars") < 500, "SECTION_UNCERTAIN").alias("review_reason"))
    return Q.section_confusion(runs)


@query("q12_timing_stats", """SELECT event_type, COUNT(*) AS n, MEDIAN(value) AS median, LIST_SORT(LIST(value))[(COUNT(*) - 1) * 9 // 10 + 1] AS p90, MAX(value) AS maximum FROM events GROUP BY 1""")
def timing(t):
    return Q.timing_stats(t.events, ["event_type"], "value")


@query("q12_failure_counts", "SELECT user_id, event_type AS result, COUNT(*) AS pages FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def failures(t):
    return Q.failure_counts(t.events.select("user_id", F.when(F.col("event_type") == "view", "read").otherwise(F.col("event_type")).alias("result")), ["user_id"])


@query("q13_score_bands", f"""WITH {OUTCOME_SQL} SELECT condition, CASE WHEN 1 - l_discount < 0.9 THEN '0.00-0.90' WHEN 1 - l_discount < 0.97 THEN '0.90-0.97' ELSE '0.97-1.00' END AS band, COUNT(*) FILTER (outcome IN ('correct_known', 'review_right')) AS right,
 COUNT(*) FILTER (outcome NOT IN ('correct_known', 'review_right')) AS wrong FROM scored WHERE present AND outcome IN ('correct_known', 'wrong_known', 'review_right', 'review_wrong') GROUP BY 1, 2""")
def bands(t):
    return Q.score_bands(scored(t), ["condition"])


@query("q14_wrong_known_list", f"WITH {OUTCOME_SQL} SELECT l_orderkey AS page, slot, CASE WHEN l_returnflag = 'A' THEN '' ELSE CAST(q AS VARCHAR) END AS want, CASE WHEN val THEN CASE WHEN l_suppkey % 5 = 0 THEN CAST(q + 1 AS VARCHAR) ELSE CAST(q AS VARCHAR) END ELSE '' END AS got FROM scored WHERE outcome IN ('wrong_known', 'wrong_known_blank')")
def wrong_known(t):
    return Q.wrong_known_list(scored(t)).select("page", "slot", *text("want", "got"))


@query("q15_document_scores", """WITH v AS (SELECT o_custkey AS patient, l_orderkey, BOOL_AND((l_returnflag <> 'A') = (l_linestatus = 'F')) AS exact FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
a AS (SELECT patient, BOOL_AND(exact) AS encounters_right FROM v GROUP BY 1), k AS (SELECT o_custkey AS patient, BOOL_AND(o_orderpriority <> '5-LOW') AS keys_right, BOOL_AND(o_orderstatus <> 'P') AS lmp_right FROM orders GROUP BY 1),
b AS (SELECT o_custkey AS patient, COUNT(*) FILTER (l_returnflag <> 'N') AS blocking_fields FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT a.patient, encounters_right, keys_right, lmp_right, blocking_fields FROM a JOIN k ON k.patient = a.patient JOIN b ON b.patient = a.patient""")
def document_scores(t):
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("patient")), "l_orderkey")
    visits = lines.select("patient", ((F.col("l_returnflag") != "A") == (F.col("l_linestatus") == "F")).alias("exact"))
    keys = t.orders.select(F.col("o_custkey").alias("patient"), (F.col("o_orderpriority") != "5-LOW").alias("right"))
    lmp = t.orders.select(F.col("o_custkey").alias("patient"), (F.col("o_orderstatus") != "P").alias("right"))
    fields = lines.select("patient", F.when(F.col("l_returnflag") == "A", "ILLEGIBLE").when(F.col("l_returnflag") == "R", "NEEDS_REVIEW").otherwise("KNOWN").alias("field_status"))
    return Q.document_scores(visits, keys, lmp, fields)


@query("q16_simple_outcomes", f"""WITH {OUTCOME_SQL}, s AS (SELECT condition, CASE WHEN outcome = 'correct_known' THEN 'correct KNOWN' WHEN outcome IN ('wrong_known', 'wrong_known_blank') THEN 'WRONG KNOWN' WHEN outcome = 'review_right' THEN 'review value right'
 WHEN outcome IN ('review_wrong', 'review_empty', 'marked_illegible') THEN 'review' WHEN outcome = 'claimed_missing' THEN 'missed' WHEN outcome = 'no_field' THEN 'visit missed' WHEN outcome IN ('missing_ok', 'absent_ok') THEN 'ok (blank)' ELSE 'review (blank on paper)' END AS name FROM scored)
SELECT name, COUNT(*) FILTER (condition = 'clean') AS clean, COUNT(*) FILTER (condition = 'photo') AS photo FROM s GROUP BY 1""")
def simple(t):
    rows = scored(t).select(Q.simple_outcome(F.col("outcome")).alias("name"), F.col("condition").alias("option"))
    return Q.compare_options(rows, ["name"], ["clean", "photo"])


@query("q17_assign_split", """SELECT o_orderkey + 1 AS page, o_orderkey // 8 + 1 AS patient, CASE WHEN o_orderkey // 8 + 1 <= 5 THEN 'development' ELSE 'held_out' END AS split,
 ['cover', 'identification', 'current_pregnancy', 'delivery', 'postpartum_mother_early', 'newborn_early', 'postpartum_mother_late', 'newborn_late'][o_orderkey % 8 + 1] AS layout, o_orderkey % 8 NOT IN (4, 6) AS supported FROM orders""")
def split(t):
    return Q.assign_split(t.orders.select((F.col("o_orderkey") + 1).alias("page")), C.layouts(t.spark)).select("page", "patient", "split", "layout", "supported")


@query("q18_ink_distribution", "SELECT l_returnflag, COUNT(*) AS n, MIN(l_extendedprice) AS minimum, MEDIAN(l_extendedprice) AS median, MAX(l_extendedprice) AS maximum FROM lineitem GROUP BY 1")
def ink(t):
    return Q.ink_distribution(t.lineitem, ["l_returnflag"], "l_extendedprice")
