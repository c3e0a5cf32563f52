"""Q1-Q18: readings against a ground truth, as long tables and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.privacy import key_hash
from ..functions.text import plain, strip
from ..scale import order_statistics


def truth_cells(chars: DataFrame, headers: DataFrame, rows: DataFrame, reach: float = 8.0, page: str = "page") -> DataFrame:
    """Q1: characters of a text layer (page, no, char, x, y) to (slot, row) cells: the column interval that holds x and
    the nearest row centre within `reach`. Column and row tables of a page ride along as short arrays."""
    frame = headers.groupBy(page).agg(F.collect_list(F.struct("left", "right", "slot")).alias("_cols")).join(
        rows.groupBy(page).agg(F.collect_list(F.struct("y", "row")).alias("_rows")), page)
    # Headers and rows are the printed frame of one page: nine columns, about ten rows.
    placed = chars.join(frame, page)
    slot = F.try_element_at(F.filter("_cols", lambda c: (F.col("x") >= c["left"]) & (F.col("x") < c["right"])), F.lit(1))["slot"]
    near = F.array_min(F.transform("_rows", lambda r: F.struct(F.abs(r["y"] - F.col("y")).alias("d"), r["row"].alias("row"))))
    cells = placed.select(page, slot.alias("slot"), F.when(near["d"] <= reach, near["row"]).alias("row"), "no", "char").where("slot IS NOT NULL AND row IS NOT NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "char"))), lambda x: x["char"]), "")
    return cells.groupBy(page, "slot", "row").agg(text.alias("text"))


def cell_state(text: Column) -> Column:
    """Q2: blank, dash or value."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", "blank").when(trimmed.isin(C.DASHES), "dash").otherwise("value")


def with_corrections(truth: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Q2: a correction replaces the state and text of a cell."""
    fixes = corrections.select(*keys, F.col("state").alias("_state"), F.col("text").alias("_text"))
    fixed = F.col("_state").isNotNull()
    return truth.join(fixes, keys, "left").withColumns({
        "state": F.coalesce("_state", "state"), "text": F.when(fixed, F.col("_text")).otherwise(F.col("text"))}).drop("_state", "_text")


def split_pressure(truth: DataFrame) -> DataFrame:
    """Q3: a written `a/b` cell of the pressure row is two fields; a blank or dash is blank in both."""
    parts = F.split("text", "/")
    written = (F.col("field") == "bp") & (F.col("state") == "value")
    pair = F.array(F.struct(F.lit("systolic_bp_mmhg").alias("f"), F.when(written, F.get(parts, F.lit(0))).otherwise(F.col("text")).alias("t")),
                   F.struct(F.lit("diastolic_bp_mmhg").alias("f"), F.when(written, F.get(parts, F.lit(1))).otherwise(F.col("text")).alias("t")))
    single = F.array(F.struct(F.col("field").alias("f"), F.col("text").alias("t")))
    rest = [c for c in truth.columns if c not in ("field", "text")]
    return truth.withColumn("_p", F.explode(F.when(F.col("field") == "bp", pair).otherwise(single))).select(
        *rest, F.col("_p.f").alias("field"), F.col("_p.t").alias("text"))


def canonical(truth: DataFrame, normalized: Column | str = "value") -> DataFrame:
    """Q3: the value a truth cell should be stored as: its given canonical value, else its text through N1."""
    return truth.withColumn("want", F.when(F.col("state") == "choice", F.col("choice")).when(
        F.col("state") == "value", F.coalesce("canonical", normalized)))


def same_value(got: Column, want: Column, kind: Column, accept: Column) -> Column:
    """Q4: texts without case, accents, punctuation or spaces, or an accepted alternative; numbers within 1e-6."""
    bare = lambda c: F.replace(plain(c), F.lit(" "), F.lit(""))
    texts = (bare(got) == bare(want)) | F.coalesce(F.exists(accept, lambda a: plain(a) == bare(got)), F.lit(False))
    number_got, number_want = got.try_cast("double"), want.try_cast("double")
    numbers = F.abs(number_got - number_want) < 1e-6
    return F.coalesce(F.when(kind == "text", texts).when(kind.isin("int", "decimal", "bp", "gestational_age"), numbers).otherwise(got == want), F.lit(False))


def outcome(state: Column, choice: Column, present: Column, status: Column, got: Column, right: Column) -> Column:
    """Q5: how a reading compares with what is on the paper."""
    written = (state == "value") | ((state == "choice") & choice.isNotNull())
    missing = status.isin("NOT_PROVIDED", "NOT_APPLICABLE", "UNKNOWN")
    on_paper = (F.when(~present, "no_field")
                .when((state == "choice") & (choice == "MULTIPLE"), F.when(status == "NEEDS_REVIEW", "review_right").otherwise("wrong_known"))
                .when(status == "KNOWN", F.when(right, "correct_known").otherwise("wrong_known"))
                .when(status == "NEEDS_REVIEW", F.when(right, "review_right").when(got.isNotNull(), "review_wrong").otherwise("review_empty"))
                .when(status == "ILLEGIBLE", "marked_illegible").otherwise("claimed_missing"))
    empty = (F.when(~present, "absent_ok").when(missing, "missing_ok").when(status == "ILLEGIBLE", "blank_marked_illegible")
             .when(status == "KNOWN", "wrong_known_blank").otherwise("review_on_blank"))
    return F.when(F.coalesce(written, F.lit(False)), on_paper).otherwise(empty)


def classify_outcomes(truth: DataFrame, fields: DataFrame, keys: list[str], catalog: DataFrame) -> DataFrame:
    """Q5: every truth cell (keys, field, state, want, choice, accept) with the reading of the same cell and its outcome."""
    kinds = F.broadcast(catalog.select(F.col("field").alias("_f"), "kind"))
    read = fields.select(*keys, "field", F.col("value").alias("got"), F.col("field_status").alias("status"), "confidence", F.lit(True).alias("_present"))
    joined = truth.join(read, [*keys, "field"], "left").join(kinds, F.col("field") == F.col("_f"), "left")
    right = same_value(F.col("got"), F.col("want"), F.coalesce("kind", F.lit("code")), F.col("accept"))
    return joined.withColumn("outcome", outcome(F.col("state"), F.col("choice"), F.coalesce("_present", F.lit(False)), F.col("status"),
                                                F.col("got"), right)).drop("_present", "_f", "kind")


def score_pages(truth: DataFrame, fields: DataFrame, catalog: DataFrame, salt: str) -> DataFrame:
    """Q6: outcomes of grid, laboratory, key and extended cells of supported pages in one table.

    `truth` is S9 with Q3 applied; `fields` are long readings with (page, slot, section, item, field). Patient keys meet
    only as hashes, and their values are not put out.
    """
    on = ["page", "section", "slot", "item"]
    blank = lambda df: df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("section", "slot", "item")})
    keyed = (F.col("section") == "document") & (F.col("layout") == "cover")
    cells = blank(truth.where("supported")).withColumns({
        "state": F.when(F.col("state") == "not_on_layout", "blank").otherwise(F.col("state")),
        "want": F.when(keyed, F.col("sha256")).otherwise(F.col("want"))})
    secret = F.col("field").isin(*C.KEY_FIELDS, "facility_name")
    value = F.when(F.col("field") == "facility_name", F.replace(plain(F.col("value")), F.lit(" "), F.lit(""))).otherwise(F.col("value"))
    read = blank(fields).withColumn("value", F.when(secret, key_hash(F.col("field"), value, salt)).otherwise(F.col("value")))
    plain_kinds = catalog.withColumn("kind", F.when(secret, "code").otherwise(F.col("kind")))  # hashes are compared as they are
    scored = classify_outcomes(cells, read, on, plain_kinds)
    group = (F.when(F.col("section") == "encounter", "grid").when(F.col("section") == "visit_labs", "labs")
             .when(keyed, "patient_key").when(F.col("section") == "document", "pregnancy_key").otherwise("extended"))
    return scored.withColumn("group", group).withColumns({c: F.when(~secret, F.col(c)) for c in ("want", "got")})


def visit_set_diff(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Q8: missed and extra visit slots per page, by counting set differences instead of gathering sets."""
    both = expected.select(*keys, "slot").distinct().withColumn("_e", F.lit(1)).join(
        found.select(*keys, "slot").distinct().withColumn("_f", F.lit(1)), [*keys, "slot"], "full_outer")
    counted = both.groupBy(*keys).agg(F.count("_e").alias("expected"), F.count("_f").alias("found"),
                                      F.count_if(F.col("_f").isNull()).alias("missed"), F.count_if(F.col("_e").isNull()).alias("extra"))
    return counted.withColumn("exact", (F.col("missed") == 0) & (F.col("extra") == 0))


def shifted_values(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Q9: read values that are wrong for their slot but equal the truth of the slot before or after it.

    `cells` hold (keys, field, slot_ord, want, got) for all nine slots; a page and field has nine rows.
    """
    w = Window.partitionBy(*keys, "field").orderBy("slot_ord")
    near = cells.withColumns({"_before": F.lag("want").over(w), "_after": F.lead("want").over(w)})
    wrong = F.col("got").isNotNull() & ~F.coalesce(F.col("got") == F.col("want"), F.lit(False))
    moved = F.coalesce(F.col("got") == F.col("_before"), F.lit(False)) | F.coalesce(F.col("got") == F.col("_after"), F.lit(False))
    return near.where(wrong & moved).drop("_before", "_after")


def outcome_counts(rows: DataFrame, sets: list[list[str]], outcomes: list[str] = [*C.WRITTEN_OUTCOMES, *C.EMPTY_OUTCOMES]) -> DataFrame:
    """Q10: outcome counts for several groupings in one pass; empty cells outside visit columns are left out when nothing
    was made of them. Adds written, empty and the share that was read right."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    kept = rows.where(F.coalesce("in_visit", F.lit(True)) | (F.col("outcome") != "absent_ok")) if "in_visit" in rows.columns else rows
    grouped = kept.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])
    total = lambda names: sum((F.col(n) for n in names if n in outcomes), F.lit(0))
    return grouped.withColumns({"written": total(C.WRITTEN_OUTCOMES), "empty": total(C.EMPTY_OUTCOMES)}).withColumn(
        "correct_pct", F.when(F.col("written") > 0, F.bround(100 * F.col("correct_known") / F.col("written"), 0).cast("int")))


def section_confusion(runs: DataFrame) -> DataFrame:
    """Q11: expected layout against detected section, and the review reasons."""
    found = F.when(F.col("section") == F.col("expected_section"), "right").otherwise(F.coalesce("section", F.lit("not read")))
    return runs.groupBy("layout", found.alias("found")).agg(F.count(F.lit(1)).alias("pages"), F.count("review_reason").alias("reviewed"))


def timing_stats(runs: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    """Q12: median, element int(0.9 (n - 1)) of the sorted times, and maximum, exactly and without sorting a group."""
    n = F.col("n")
    stats = order_statistics(runs, keys, seconds, {
        "_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2), "p90": F.floor((n - 1) * 9 / 10), "maximum": n - 1})
    return stats.select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p90", "maximum")


def failure_counts(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.where("result <> 'read'").groupBy(*keys, "result").agg(F.count(F.lit(1)).alias("pages"))


def score_bands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Q13: right and wrong values per confidence band."""
    scored = rows.where(F.col("confidence").between(0, 1.01) & F.col("outcome").isin("correct_known", "wrong_known", "review_right", "review_wrong"))
    band = F.when(F.col("confidence") < 0.9, "0.00-0.90").when(F.col("confidence") < 0.97, "0.90-0.97").otherwise("0.97-1.00")
    right = F.col("outcome").isin("correct_known", "review_right")
    return scored.groupBy(*keys, band.alias("band")).agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong"))


def wrong_known_list(rows: DataFrame) -> DataFrame:
    """Q14: wrong values marked KNOWN; sort by page where it is shown."""
    return rows.where(F.col("outcome").isin("wrong_known", "wrong_known_blank"))


def document_scores(visits: DataFrame, keys_right: DataFrame, lmp: DataFrame, fields: DataFrame, by: str = "patient") -> DataFrame:
    """Q15: per patient document: exact visit slots, right keys, right LMP, and visit fields left to settle."""
    keys = keys_right.groupBy(by).agg(F.bool_and("right").alias("keys_right"))
    blocking = fields.groupBy(by).agg(F.count_if(F.col("field_status").isin("NEEDS_REVIEW", "ILLEGIBLE")).alias("blocking_fields"))
    exact = visits.groupBy(by).agg(F.bool_and("exact").alias("encounters_right"))
    right = lmp.groupBy(by).agg(F.bool_and("right").alias("lmp_right"))
    return exact.join(keys, by, "left").join(right, by, "left").join(blocking, by, "left")


SIMPLE_OUTCOMES = {
    "correct_known": "correct KNOWN", "wrong_known": "WRONG KNOWN", "wrong_known_blank": "WRONG KNOWN", "review_right": "review value right",
    "review_wrong": "review", "review_empty": "review", "marked_illegible": "review", "claimed_missing": "missed", "no_field": "visit missed",
    "missing_ok": "ok (blank)", "absent_ok": "ok (blank)", "review_on_blank": "review (blank on paper)", "blank_marked_illegible": "review (blank on paper)",
}


def simple_outcome(name: Column) -> Column:
    """Q16: the shorter outcome names of the first specimen report."""
    chain = None
    for key, value in SIMPLE_OUTCOMES.items():
        chain = F.when(name == key, value) if chain is None else chain.when(name == key, value)
    return chain


def compare_options(rows: DataFrame, keys: list[str], options: list[str]) -> DataFrame:
    """Q16: counts per outcome, one column per reading option; the options are named by the caller."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("option") == o).alias(o) for o in options])


def assign_split(pages: DataFrame, layouts: DataFrame, page: str = "page") -> DataFrame:
    """Q17: patient, layout and split of a specimen page number; eight pages per patient, five patients for development."""
    table = F.broadcast(layouts.select(F.col("position").alias("_position"), "layout", "expected_section", "supported"))
    patient = F.floor((F.col(page) - 1) / 8) + 1
    return (pages.withColumns({"patient": patient.cast("long"), "_at": (F.pmod(F.col(page) - 1, F.lit(8)) + 1).cast("int"),
                               "split": F.when(patient <= 5, "development").otherwise("held_out")})
            .join(table, F.col("_at") == F.col("_position")).drop("_at", "_position"))


def ink_distribution(marks: DataFrame, keys: list[str], ink: str = "ink") -> DataFrame:
    """Q18: number, minimum, median and maximum of the ink share per box state."""
    n = F.col("n")
    s = order_statistics(marks, keys, ink, {"minimum": F.lit(0), "_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2), "maximum": n - 1})
    return s.select(*keys, "n", "minimum", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "maximum")
