"""Literal cases of the rules, with expected results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperflow import catalog as C
from paperflow.functions import normalize as N
from paperflow.functions import privacy as K
from paperflow.functions import text as T
from paperflow.operators import drafts as D
from paperflow.operators import export as E
from paperflow.operators import layout as P
from paperflow.operators import linkage as L
from paperflow.operators import messages as M
from paperflow.operators import reading as R
from paperflow.operators import review as V

def as_of():
    return F.lit("2026-01-01").cast("date")


NORMALISED = [
    ("visit_date", "19/12/25", "2025-12-19", None), ("visit_date", "2025-12-19", "2025-12-19", None), ("gestational_age_days", "28SA+1j", "197", None),
    ("gestational_age_days", "35", "245", None), ("gestational_age_days", "28 SA 3 j", "199", None), ("gestational_age_days", "28 SA et 3 jours", "199", None),
    ("gestational_age_days", "28 sem + 3", "199", None), ("systolic_bp_mmhg", "12", "120", None), ("systolic_bp_mmhg", "125", "125", None), ("diastolic_bp_mmhg", "7,5", "75", None),
    ("weight_kg", "63,5 kg", "63.5", None), ("syphilis_test", "nég", "NEGATIVE", None), ("midwife_patient_code", "CM: 164125", "164125", None), ("registry_file_number", "164 125", "164125", None),
    ("visit_date", "31/02/25", None, "DATE_INVALID"), ("visit_date", "hier", None, "DATE_FORMAT"), ("visit_date", "01/01/27", None, "DATE_FUTURE"), ("fundal_height_cm", "HU 80", None, "NOT_A_NUMBER"),
    ("fundal_height_cm", "80", None, "RANGE_HIGH"), ("gestational_age_days", "28+9", None, "GA_DAYS"), ("gestational_age_days", "28,5", None, "GA_DECIMAL"), ("gestational_age_days", "283", None, "GA_FORMAT"),
    ("gestational_age_days", "28 3", None, "GA_FORMAT"), ("systolic_bp_mmhg", "120,5", None, "NOT_WHOLE"), ("hiv_test", "peut-être", None, "NOT_AN_ANSWER"), ("weight_kg", "  ", None, "EMPTY"),
    ("newborn_sex", "GARÇON", "MALE", None), ("maternal_age_years", "27 ans", "27", None), ("birth_weight_g", "3200 gr.", "3200", None),
]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_normalize(spark):
    df = spark.createDataFrame([(i, f, r) for i, (f, r, _v, _e) in enumerate(NORMALISED)], "i int, field string, raw_text string")
    got = {r.i: (r.value, r.error) for r in N.normalize_fields(df, C.field_catalog(spark), C.choice_spellings(spark), as_of()).collect()}
    assert [got[i] for i in range(len(NORMALISED))] == [(v, e) for _f, _r, v, e in NORMALISED]


def test_extra_kind(spark):
    catalog = C.field_catalog(spark).withColumn("kind", F.when(F.col("field") == "parity", "roman").otherwise(F.col("kind")))
    df = spark.createDataFrame([("parity", "II")], "field string, raw_text string")
    out = N.normalize_fields(df, catalog, C.choice_spellings(spark), as_of(), extra={"roman": lambda t: N.result(F.length(t), F.length(t))})
    assert out.first().value == "2"


def test_rounding_equals_python(spark):
    numbers = [k / 40 for k in range(4000)] + [2.675, 1.005, 0.15, 63.55, 1e5 / 7]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", T.round_half_even(F.col("x"), 1).alias("a"), F.expr(T.half_even_sql("x", 2)).alias("b")).collect()
    assert all(r.a == round(r.x, 1) and r.b == round(r.x, 2) for r in got)


@pytest.mark.parametrize("key,data,digest", [
    (b"\x0b" * 20, "Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", "what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 131, "Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54")])
def test_keyed_index(spark, key, data, digest):
    assert spark.range(1).select(K.keyed_index(F.lit(data), key).alias("h")).first().h == digest


def test_seal_and_tamper(spark):
    key = b"0123456789abcdef"
    sealed = spark.range(1).select(K.seal(F.struct(F.lit(7).alias("a")), key).alias("s"))
    assert sealed.select(K.unseal(F.col("s"), key, "a int").alias("o")).first().o.a == 7
    broken = sealed.select(K.unseal(F.concat(F.col("s"), F.unhex(F.lit("00"))), key, "a int").alias("o"))
    assert broken.first().o is None


def test_digest(spark):
    import base64
    import hashlib
    d = hashlib.sha256(b"abc").digest()
    cases = [(None, True), (base64.b64encode(d).decode(), True), (d.hex().upper(), True), (base64.b64encode(b"x" * 32).decode(), False), ("0" * 64, False), ("short", True)]
    got = spark.createDataFrame([(i, c) for i, (c, _w) in enumerate(cases)], "i int, c string").select("i", T.digest_matches(F.col("c"), F.lit(b"abc")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [w for _c, w in cases]


def test_grouping_edges(spark):
    start = dt.datetime(2025, 1, 1, 10)
    at = [0, 2, 10, 19, 3600 - 4, 3600 + 3]
    df = spark.createDataFrame([(f"p{i}", "s", start + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "page_id string, sender_id string, received_at timestamp")
    got = {r.page_id: r.document_no for r in M.group_pages(df).collect()}
    assert [got[f"p{i}"] for i in range(6)] == [1, 1, 1, 2, 3, 3]  # 8 s joins, 9 s does not; 7 s joins across a bucket edge


def test_delivery_sequences(spark):
    cases = {"a": ["DELIVERED", "SENT"], "b": [("FAILED", 131000)], "c": [("FAILED", 131047)], "d": ["READ", ("FAILED", 131047)], "e": [("FAILED", 131000), "READ"]}
    events = [(m, i, *(e if isinstance(e, tuple) else (e, None)), dt.datetime(2025, 1, 1)) for m, es in cases.items() for i, e in enumerate(es)]
    out = [(m, m, "SENT", 1, None, None, None) for m in cases]
    got = M.fold_delivery(spark.createDataFrame(events, "wa_message_id string, seq int, status string, error_code long, at timestamp"),
                          spark.createDataFrame(out, "message_id string, wa_message_id string, status string, attempts int, last_error string, next_attempt_at timestamp, updated_at timestamp"))
    assert {r.message_id: (r.status, r.wa_message_id) for r in got.collect()} == {"a": ("DELIVERED", "a"), "b": ("PENDING", None), "c": ("FAILED", "c"), "d": ("READ", "d"), "e": ("PENDING", None)}


CELLS = [("weight_kg", "63,5 kg", 0.99, None, "63.5", "KNOWN", []), ("weight_kg", "6O", 0.99, None, "60", "NEEDS_REVIEW", ["OCR_CHARACTER_SUBSTITUTED"]), ("weight_kg", "62 64", 0.99, None, None, "NEEDS_REVIEW", ["OCR_UNPARSED"]),
         ("weight_kg", "-", 0.9, None, None, "NOT_PROVIDED", ["MARKED_DASH"]), ("weight_kg", "", None, "CELL_BLANK", None, "NOT_PROVIDED", ["CELL_BLANK"]), ("visit_date", "", None, "CELL_BLANK", None, "NEEDS_REVIEW", ["CELL_BLANK"]),
         ("visit_date", "05106/2025", 0.99, None, "2025-06-05", "NEEDS_REVIEW", ["OCR_CHARACTER_SUBSTITUTED"]), ("gestational_age_days", "28,3", 0.99, None, None, "NEEDS_REVIEW", ["GA_FORMAT_AMBIGUOUS"]),
         ("fundal_height_cm", "2|", 0.99, None, "21", "NEEDS_REVIEW", ["OCR_CHARACTER_UNCLEAR"]), ("hiv_test", "nég", 0.5, None, "NEGATIVE", "NEEDS_REVIEW", ["OCR_LOW_CONFIDENCE"]), ("weight_kg", "63 kg x", 0.99, None, "63", "NEEDS_REVIEW", ["OCR_EXTRA_TEXT"])]


def test_read_values(spark):
    df = spark.createDataFrame([(i, f, t, c, e, False) for i, (f, t, c, e, *_r) in enumerate(CELLS)], "i int, field string, text string, confidence double, empty_reason string, spans boolean")
    table = R.reading_catalog(C.field_catalog(spark), C.choice_spellings(spark))
    got = {r.i: (r.value, r.field_status, list(r.validation_flags)) for r in R.read_values(df, table, as_of()).collect()}
    for i, (_f, t, _c, _e, v, s, flags) in enumerate(CELLS):
        assert got[i] == (v, s, flags), (t, got[i])


def test_read_bp(spark):
    cases = [("12/7", "120", "70", "KNOWN", []), ("120/80", "120", "80", "KNOWN", []), ("12/07", None, None, "NEEDS_REVIEW", ["BP_LOOKS_LIKE_DATE", "OCR_UNPARSED"]), ("13/60", None, None, "NEEDS_REVIEW", ["BP_UNITS_MIXED", "OCR_UNPARSED"]),
             ("11/12", None, None, "NEEDS_REVIEW", ["BP_ORDER_IMPLAUSIBLE", "OCR_UNPARSED"])]
    df = spark.createDataFrame([(i, c[0], 0.99, None, False) for i, c in enumerate(cases)], "i int, text string, confidence double, empty_reason string, spans boolean")
    got = {(r.i, r.field): r for r in R.read_bp(df).collect()}
    for i, (_t, high, low, status, flags) in enumerate(cases):
        a, b = got[i, "systolic_bp_mmhg"], got[i, "diastolic_bp_mmhg"]
        assert (a.value, b.value, a.field_status, list(a.validation_flags)) == (high, low, status, flags)


def test_spanning_box_is_split(spark):
    grid = spark.sql("""SELECT 'd' AS document_id, 'p' AS page_ref, 0D AS header_bottom, array(named_struct('slot', 'T1_V1', 'left', 0D, 'right', 100D), named_struct('slot', 'T1_V2', 'left', 100D, 'right', 200D)) AS columns,
                        array(named_struct('row', 'weight_kg', 'top', 10D, 'bottom', 50D)) AS rows""")
    line = spark.createDataFrame([("d", "p", 1, "62 64", 0.9, 60.0, 20.0, 160.0, 40.0)], "document_id string, page_ref string, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    cells = {r.slot: (r.text, r.spans) for r in P.grid_cells(P.assign_cells(line, grid), grid).collect()}
    assert cells == {"T1_V1": ("62", True), "T1_V2": ("64", True)}


def test_section_across_lines(spark):
    lines = [("d", "p", i, t) for i, t in enumerate(["FICHE DE SURVEILLANCE", "DE LA GROSSESSE", "Type de l'établissement :"])] + [("d", "q", 0, "Etat vaccinal"), ("d", "r", 0, "rien")]
    df = spark.createDataFrame(lines, "document_id string, page_ref string, line_no int, text string")
    assert {r.page_ref: (r.section, r.section_confidence) for r in P.detect_section(df).collect()} == {"p": ("cover", "high"), "q": ("newborn", "low"), "r": ("unknown", "none")}


def test_merge_conflict_and_agreement(spark):
    schema = "document_id string, slot string, field string, page_no int, raw_text string, value string, value_num double, value_date date, confidence double, field_status string, validation_flags array<string>"
    base = [("d", "M7", "weight_kg", 1, "62", "62", 62.0, None, 0.9, "KNOWN", []), ("d", "M7", "weight_kg", 2, "62", "62", 62.0, None, 0.95, "KNOWN", []),
            ("d", "M8", "weight_kg", 1, "62", "62", 62.0, None, 0.9, "KNOWN", []), ("d", "M8", "weight_kg", 2, "63", "63", 63.0, None, 0.9, "KNOWN", []),
            ("d", "M9", "weight_kg", 1, None, None, None, None, None, "NOT_PROVIDED", ["CELL_BLANK"]), ("d", "M9", "weight_kg", 2, "6?", None, None, None, 0.4, "NEEDS_REVIEW", ["OCR_UNPARSED"])]
    got = {r.slot: (r.value, r.field_status, r.confidence, list(r.validation_flags)) for r in D.merge_readings(spark.createDataFrame(base, schema), ["document_id", "slot", "field"]).collect()}
    assert got == {"M7": ("62", "KNOWN", 0.95, []), "M8": (None, "NEEDS_REVIEW", None, ["CONFLICT_ACROSS_PAGES"]), "M9": (None, "NEEDS_REVIEW", None, ["CONFLICT_ACROSS_PAGES"])}


def test_upsert_is_idempotent(spark):
    none = "array<struct<at:timestamp,by:string,document_id:string,previous:map<string,string>,selected_fields:array<string>>>"
    visits = spark.sql(f"SELECT 'V1' AS visit_id, 'A' AS patient_id, 'ANTENATAL' AS encounter_type, DATE '2025-07-04' AS visit_date, 'M7' AS slot, map('weight_kg', '62') AS fields, array('D0') AS source_documents, CAST(array() AS {none}) AS history")
    accepted = spark.sql("""SELECT * FROM VALUES (1, 'D1', 'A', 'ANTENATAL', DATE '2025-07-04', 'M7', map('weight_kg', '63'), 'UPDATE', array(''), 'r', TIMESTAMP '2025-08-01'),
        (2, 'D2', 'A', 'ANTENATAL', DATE '2025-08-04', 'M8', map('weight_kg', '64'), NULL, array(''), 'r', TIMESTAMP '2025-08-01') AS t(seq, document_id, patient_id, encounter_type, visit_date, slot, fields, decision, selected, by, at)""")
    once, outcomes, deferred = L.upsert_visits(visits, accepted)
    assert {(r.seq, r.outcome) for r in outcomes.collect()} == {(1, "UPDATED"), (2, "CREATED")} and deferred.isEmpty()
    twice, again, _d = L.upsert_visits(once, accepted)
    key = lambda r: (r.visit_id, r.visit_date, tuple(sorted(r.fields.items())), tuple(r.source_documents), len(r.history))
    assert sorted(map(key, once.collect())) == sorted(map(key, twice.collect()))
    assert {r.outcome for r in again.collect()} == {"UNCHANGED"}


def test_long_replacement_chain(spark):
    pages = spark.range(37).select(F.concat(F.lit("p"), F.col("id")).alias("page_id"), F.when(F.col("id") < 36, F.concat(F.lit("p"), F.col("id") + 1)).alias("replaced_by"))
    got = {r.page_id: (r.active_page_id, r.steps) for r in V.page_chain(pages).collect()}
    assert got == {f"p{i}": ("p36", 36 - i) for i in range(37)}


def test_export_codes(spark):
    df = spark.createDataFrame([("1", "a", "Césarienne"), ("2", "a", "césarienne, puis cesarienne"), ("3", "a", "Voie basse")], "patient_id string, x string, value string")
    got = {r.patient_id: r.c for r in df.groupBy("patient_id").agg(E.previous_cesarean(F.col("value")).alias("c")).collect()}
    assert got == {"1": None, "2": 1, "3": 0}


def test_coverage_counts(spark):
    got = {r.category: r["columns"] for r in E.coverage(C.export_columns(spark)).collect()}
    assert sum(got.values()) == 31 and got["implemented but unverified"] == 1
    assert len(C.EXPORT_HEADERS) == 31 and len(set(C.EXPORT_HEADERS)) == 31


def test_fold_of_every_form(spark):
    from paperflow.functions.text import norm

    cases = {"ﬁche №3": "fiche no3", "Ｐｏｉｄｓ： ½": "poids: 12", "Œdème é é": "deme e e", "œuvre": "uvre", "63 kg": "63 kg", "㎏": "kg", "plain": "plain"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", norm(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_blanks_beyond_ascii(spark):
    from paperflow.functions.text import strip

    got = spark.createDataFrame([(" 19/12/25 ",), ("164 125",), (" ",)], "t string").select(strip(F.col("t")).alias("s")).collect()
    assert [g.s for g in got] == ["19/12/25", "164 125", ""]


def test_page_text_at_any_length(spark):
    from paperflow.operators.layout import detect_section

    label = ["Grossesse", "actuelle"]
    def page(name, filler):
        lines = [f"x{i}" for i in range(filler)] + [label[0]] + label[1:] + [f"y{i}" for i in range(filler)]
        return [("d", name, i, t) for i, t in enumerate(lines)]
    rows = spark.createDataFrame(page("short", 5) + page("long", 900), "document_id string, page_ref string, line_no int, text string")
    got = {r.page_ref: (r.section, r.section_confidence) for r in detect_section(rows).collect()}
    assert got["short"] == got["long"]


def test_page_chain_in_a_circle(spark):
    pages = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", None)], "page_id string, replaced_by string")
    got = {r.page_id: r.active_page_id for r in V.page_chain(pages).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": "e", "e": "e"}


def test_refused_requests_take_no_key(spark):
    from paperflow.operators import linkage as L

    patients = spark.createDataFrame([("p", 1, "A", None)], "patient_id string, facility_id int, registry_file_number string, midwife_patient_code string")
    asked = spark.createDataFrame([(1, 1, "A", "X"), (2, 1, "B", "X"), (3, 1, "B", "Y"), (4, 1, "D", "Y"), (5, 1, None, None)], "seq int, facility_id int, registry_file_number string, midwife_patient_code string")
    got = {r.seq: r.verdict for r in L.create_patients(asked, patients).collect()}
    assert got == {1: "KEY_ALREADY_REGISTERED", 2: "CREATED", 3: "KEY_TAKEN_IN_BATCH", 4: "CREATED", 5: "CREATED"}
    people = spark.createDataFrame([("p", 1, None, "c"), ("q", 1, None, "d")], "patient_id string, facility_id int, registry_file_number string, midwife_patient_code string")
    offers = spark.createDataFrame([("q", 1, "K", None), ("p", 2, "K", None), ("p", 3, "M", None)], "patient_id string, seq int, registry_file_number string, midwife_patient_code string")
    assert {r.patient_id: r.registry_file_number for r in L.fill_keys(people, offers).collect()} == {"q": "K", "p": "M"}


def test_documents_are_sent_once(spark, tmp_path):
    from paperflow.streaming import streams as S

    documents = spark.createDataFrame([(f"d{i}", 1, f"p{i % 2}", "REGISTERED") for i in range(6)], "document_id string, facility_id int, patient_id string, status string")
    visits = spark.createDataFrame([("p0", "v1"), ("p0", "v2")], "patient_id string, visit_id string")
    log, folder = spark.createDataFrame([("d5",)], "document_id string"), str(tmp_path)

    def send(document, patient, visits):
        import os
        import uuid

        open(os.path.join(folder, f"{document}-{uuid.uuid4().hex}"), "w").close()
        return {"status": "ACCEPTED", "ack_id": "a"} if document != "d1" else None

    acks = S.sync_registered(S.sync_payloads(documents, visits, log), send)
    after, failed = S.apply_acknowledgements(documents, acks)
    after.collect(), failed.collect(), failed.count()
    assert sorted(f.name.split("-")[0] for f in tmp_path.iterdir()) == ["d0", "d1", "d2", "d3", "d4"]
    assert [f.document_id for f in failed.collect() if f.document_id == "d1"] == ["d1"]


def test_a_full_width_colon_ends_a_label(spark):
    lines = spark.createDataFrame([("d", "p", 1, "DDR\uff1a 01/02/2025", 0.9, 0.0, 0.0, 100.0, 20.0)],
                                  "document_id string, page_ref string, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert P.value_beside(lines.withColumn("label", F.lit("l")), lines).first().value_text == "01/02/2025"


BOX_LINES = "document_id string, page_ref string, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
SQUARES = "document_id string, page_ref string, x0 double, y0 double, x1 double, y1 double, score double, ink double"


def test_single_boxes_are_found_beside_their_labels(spark):
    cases = {"ticked": 0.5, "empty": 0.01, "faint": 0.1, "none": None, "far": 0.5}
    lines = spark.createDataFrame([(k, "p", 1, "Consanguinité", 0.9, 300.0, 100.0, 440.0, 120.0) for k in cases], BOX_LINES)
    squares = spark.createDataFrame([(k, "p", 20.0 if k == "far" else 270.0, 102.0, 36.0 if k == "far" else 286.0, 118.0, 1.0, ink) for k, ink in cases.items() if ink is not None], SQUARES)
    pages = spark.createDataFrame([(k, "p") for k in [*cases, "unprinted"]], "document_id string, page_ref string")
    marks = P.box_marks(lines, squares, pages, [(f, None, pattern, label) for f, pattern, label in C.SINGLE_BOXES])
    got = {g.document_id: g for g in P.single_box_fields(marks).where("field = 'consanguinity_mark'").collect()}
    assert {k: (g.value, g.field_status, g.validation_flags) for k, g in got.items()} == {
        "ticked": ("MARKED", "KNOWN", []), "empty": ("UNMARKED", "KNOWN", []), "faint": (None, "NEEDS_REVIEW", ["CHECKBOX_UNCLEAR"]),
        "none": (None, "NEEDS_REVIEW", ["CHECKBOX_NOT_FOUND"]), "far": (None, "NEEDS_REVIEW", ["CHECKBOX_NOT_FOUND"]), "unprinted": (None, "NEEDS_REVIEW", ["OCR_LABEL_NOT_FOUND"])}
    assert got["ticked"].checkboxes[0].label == "Consanguinité" and (got["ticked"].x0, got["ticked"].y1) == (270.0, 118.0)


def test_a_choice_keeps_the_evidence_of_all_its_boxes(spark):
    words = {"exclusivement au sein": 0.5, "Artificiel": 0.01, "mixte": 0.02}
    lines = spark.createDataFrame([("d", "p", i, w, 0.9, 300.0, 100.0 * i, 400.0, 100.0 * i + 20) for i, w in enumerate(words)], BOX_LINES)
    squares = spark.createDataFrame([("d", "p", 270.0, 100.0 * i + 2, 286.0, 100.0 * i + 18, 1.0, ink) for i, ink in enumerate(words.values())], SQUARES)
    pages = spark.createDataFrame([("d", "p")], "document_id string, page_ref string")
    fv = P.choice_box_fields(P.box_marks(lines, squares, pages, [b for b in C.CHOICE_BOXES if b[0] == "feeding_mode"])).first()
    assert (fv.value, fv.field_status, [m.state for m in fv.checkboxes]) == ("EXCLUSIVE_BREASTFEEDING", "KNOWN", ["MARKED", "UNMARKED", "UNMARKED"])


def test_documents_are_applied_whole_in_turn(spark):
    import random

    r = random.Random(9)
    rows, seq = [], 0
    for d in range(60):
        for _ in range(r.randrange(1, 4)):
            seq += 1
            rows.append((seq, f"d{d}", f"p{r.randrange(5)}", r.choice("AB"), None if r.random() < 0.03 else dt.date(2025, 1, r.randrange(1, 15))))
    taken, want = set(), set()
    for d in range(60):
        visits = [x[2:] for x in rows if x[1] == f"d{d}"]
        if all(v[2] for v in visits) and len(set(visits)) == len(visits) and not taken & set(visits):
            taken |= set(visits)
            want.add(f"d{d}")
    accepted = spark.createDataFrame(rows, "seq int, document_id string, patient_id string, encounter_type string, visit_date date")
    assert {g.document_id for g in L.choose_documents(accepted).collect()} == want


def test_moves_of_pages_equal_the_moves_one_by_one(spark):
    import random

    r = random.Random(11)
    pages = [(f"p{i}", f"d{i // 2}", None, i % 2 + 1) for i in range(16)]
    moves = [(k, f"p{r.randrange(17)}", k % 4 == 0, f"new{k}" if k % 4 == 0 else r.choice(["d0", "d1", "d2", "d3", "d4", "new0", "new4", "d9"])) for k in range(40)]
    place, order, documents, verdicts = {p: d for p, d, *_ in pages}, {p: (-1, n) for p, _, _, n in pages}, {f"d{i}" for i in range(8)}, {}
    for k, page, split, target in moves:
        source = place.get(page)
        size = sum(d == source for d in place.values())
        why = ("PAGE_NOT_FOUND" if source is None else "SAME_DOCUMENT" if not split and target == source else "DOCUMENT_NOT_FOUND" if not split and target not in documents
               else "ONLY_PAGE" if split and size == 1 else None)
        verdicts[k] = why
        if why is None:
            place[page], order[page] = target, (k, 0)
            documents.add(target)
            if source not in place.values():
                documents.discard(source)
    assert {"DOCUMENT_NOT_FOUND", "ONLY_PAGE", None} <= set(verdicts.values())
    frame = spark.createDataFrame(pages, "page_id string, document_id string, replaced_by string, position int")
    docs = spark.createDataFrame([(f"d{i}", "NEEDS_REVIEW", "F") for i in range(8)], "document_id string, status string, facility_id string")
    after, judged, _effects, _retakes = V.move_pages(frame, spark.createDataFrame(moves, "move_id int, page_id string, split boolean, target_document_id string"), docs,
                                                     spark.createDataFrame([], "page_id string, status string"), V.page_chain(frame))
    assert {g.move_id: g.reason for g in judged.collect()} == verdicts
    want = {}
    for page in sorted(place, key=lambda p: order[p]):
        want[page] = (place[page], 1 + sum(d == place[page] for d, _ in want.values()))
    assert {g.page_id: (g.document_id, g.position) for g in after.collect()} == want
