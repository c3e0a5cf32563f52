"""The analytic table, one row of 31 columns per patient, from verified values only.

Everything about a patient is one aggregate keyed by patient_id, so hot patients are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.text import round_half_even, weeks


def is_verified(status: Column, state: Column) -> Column:
    return F.coalesce((status == "KNOWN") & state.isin("CONFIRMED", "CORRECTED"), F.lit(False))


def verified_value(value: Column, status: Column, state: Column) -> Column:
    """The value when it is KNOWN and a person confirmed or corrected it."""
    return F.when(is_verified(status, state), value)


def _ok(field: str) -> Column:
    return (F.col("field") == field) & F.col("_verified") & F.col("value").isNotNull()


def mean_verified(field: str) -> Column:
    """Aggregate over visit field rows; one decimal. Sum over count, so that a re-run gives the same digits."""
    total = F.sum(F.when(_ok(field), F.col("value_num")))
    return round_half_even(total / F.count_if(_ok(field)), 1)


def earliest_verified(field: str, column: str = "value") -> Column:
    """Aggregate: the value of the first dated visit that has one; ties by visit id."""
    return F.min_by(F.when(_ok(field), F.col(column)), F.when(_ok(field) & F.col("visit_date").isNotNull(), F.struct("visit_date", "visit_id")))


def code_answer(value: Column) -> Column:
    """E5: POSITIVE and NEGATIVE as 1 and 0."""
    return F.when(value == "POSITIVE", 1).when(value == "NEGATIVE", 0)


def code_delivery(value: Column) -> Column:
    mode = F.lower(value)
    return F.when(F.contains(mode, F.lit("cesar")), 1).when(F.contains(mode, F.lit("voie_basse")) | F.contains(mode, F.lit("vag")), 0)


def code_sex(value: Column) -> Column:
    sex = F.upper(F.trim(value))
    return (F.when(sex.isin("MALE", "M", "MASCULIN", "GARÇON", "GARCON", "1"), 1)
            .when(sex.isin("FEMALE", "F", "FÉMININ", "FEMININ", "FILLE", "0"), 0))


def previous_cesarean(value: Column) -> Column:
    """Aggregate over the verified modes of a patient: any caesarean is 1, only vaginal ones is 0. Accents are not
    folded, so an accented spelling stays undecided."""
    mode = F.lower(value)
    vaginal = F.contains(mode, F.lit("basse")) | F.contains(mode, F.lit("vag"))
    return F.when(F.bool_or(F.contains(mode, F.lit("cesar"))), 1).when(F.bool_and(vaginal), 0)


def earliest_labs(labs: DataFrame, visits: DataFrame, slots: DataFrame, field: str, patient: str = "patient_id") -> DataFrame:
    """First verified laboratory value: by the date of the first visit with its slot, undated last, then printed order."""
    dates = visits.where("visit_date IS NOT NULL").groupBy(patient, "slot").agg(F.min("visit_date").alias("_date"))
    order = F.broadcast(slots.select("slot", "slot_ord"))
    rows = (labs.where(F.col("field") == field).join(dates, [patient, "slot"], "left").join(order, "slot", "left")
            .withColumn("_verified", is_verified(F.col("field_status"), F.col("verification_state"))).where("_verified AND value IS NOT NULL"))
    rank = F.struct(F.col("_date").isNull(), F.coalesce("_date", F.lit("0001-01-01").cast("date")), F.coalesce("slot_ord", F.lit(999)), "slot")
    return rows.groupBy(patient).agg(F.min_by("value_num", rank).alias(field))


def latest_extended(visit_sources: DataFrame, documents: DataFrame, extended_documents: DataFrame) -> DataFrame:
    """Per patient the highest document id, among visit sources and registered documents, that has an extended part."""
    registered = documents.where(F.col("status").isin(C.REGISTERED) & F.col("patient_id").isNotNull()).select("patient_id", "document_id")
    sources = visit_sources.select("patient_id", "document_id").unionByName(registered)
    return sources.join(extended_documents.select("document_id").distinct(), "document_id", "left_semi").groupBy("patient_id").agg(
        F.max("document_id").alias("document_id"))


def visit_columns(visit_fields: DataFrame, fractional_weeks: bool = False) -> DataFrame:
    """E2, E3, E5 in one aggregate over (patient_id, visit_id, visit_date, field, value, value_num, field_status,
    verification_state)."""
    rows = visit_fields.withColumn("_verified", is_verified(F.col("field_status"), F.col("verification_state")) & F.col("visit_date").isNotNull())
    return rows.groupBy("patient_id").agg(
        mean_verified("systolic_bp_mmhg").alias("mean systolic bp (mmhg)"), mean_verified("diastolic_bp_mmhg").alias("mean diastolic bp (mmhg)"),
        code_answer(earliest_verified("hiv_test")).alias("hiv test result"), code_answer(earliest_verified("syphilis_test")).alias("syphilis test result"),
        weeks(earliest_verified("gestational_age_days", "value_num"), fractional_weeks).alias("gestational age at enrollment (weeks)"))


def extended_columns(extended_fields: DataFrame, chosen: DataFrame, fractional_weeks: bool = False) -> DataFrame:
    """The columns taken from the chosen document of each patient: (document_id, section, item_index, field, ...)."""
    rows = extended_fields.join(chosen, "document_id").withColumn("_verified", is_verified(F.col("field_status"), F.col("verification_state")))
    one = lambda field, column="value_num": F.max(F.when(_ok(field), F.col(column)))
    # Only the first newborn of the list is exported.
    newborn = lambda field, column="value_num": F.max(F.when(_ok(field) & (F.col("item_index") == 0), F.col(column)))
    return rows.groupBy("patient_id").agg(
        one("maternal_age_years").alias("age (years)"), one("gravidity").alias("gravidity (number)"), one("parity").alias("parity (number)"),
        one("abortions_count").alias("abortions (number)"), one("living_children_count").alias("living children (number)"),
        previous_cesarean(F.when(_ok("previous_delivery_mode_text"), F.col("value"))).alias("previous cesarean"),
        weeks(one("delivery_gestational_age_days"), fractional_weeks).alias("gestational age at birth (weeks)"),
        code_delivery(one("delivery_mode", "value")).alias("type of delivery (0=vaginal,1=cesarean)"),
        code_sex(newborn("newborn_sex", "value")).alias("newborn sex (0=female,1=male)"), newborn("birth_weight_g").alias("child birth weight (g)"),
        newborn("birth_head_circumference_cm").alias("head circumference (cm)"))


def export_rows(patients: DataFrame, visit_fields: DataFrame, visits: DataFrame, documents: DataFrame, extended_fields: DataFrame,
                slots: DataFrame, fractional_weeks: bool = False) -> DataFrame:
    """The 31 columns, one row per patient; columns without an agreed definition stay empty."""
    sources = visits.select("patient_id", F.explode("source_documents").alias("document_id"))
    chosen = latest_extended(sources, documents, extended_fields)
    labs = extended_fields.where("section = 'visit_labs'").withColumn("slot", F.col("item_key")).join(chosen, "document_id")
    hemoglobin = earliest_labs(labs, visits, slots, "hemoglobin_g_dl").withColumnRenamed("hemoglobin_g_dl", "hemoglobin (g/dl)")
    out = patients.select("patient_id")
    for part in (visit_columns(visit_fields, fractional_weeks), extended_columns(extended_fields, chosen, fractional_weeks), hemoglobin):
        out = out.join(part, "patient_id", "left")
    out = out.withColumn("id", F.concat(F.lit("EXP-"), F.col("patient_id").cast("string")))
    return out.select(*[F.col(f"`{h}`") if h in out.columns else F.lit(None).cast("double").alias(h) for h in C.EXPORT_HEADERS])


def coverage(columns: DataFrame) -> DataFrame:
    """Columns per coverage category."""
    return columns.groupBy("category").agg(F.count(F.lit(1)).alias("columns"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: rows, blanks, min, max, whole numbers, distinct values, rows at the maximum. One pass for
    the sums, and one count per (column, value) for distinct values and the maximum."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    counted = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    value = F.col("v").isNotNull()
    return counted.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(~value, F.col("n")).otherwise(0)).alias("blanks"), F.min("v").alias("minimum"), F.max("v").alias("maximum"),
        F.sum(F.when(value & (F.col("v") == F.floor("v")), F.col("n")).otherwise(0)).alias("whole"), F.count_if(value).alias("distinct_values"),
        F.max_by(F.when(value, F.col("n")), F.when(value, F.col("v"))).alias("at_maximum"))


def row_rules(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """Rows that break a rule, one row per rule."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(True)), name) for name, test in rules.items()]))
    return df.select(*[F.col(f"`{k}`") for k in keys], F.explode(broken).alias("rule"))


def registry_rules() -> dict[str, Column]:
    """The rules the published registry follows."""
    c = lambda h: F.col(f"`{h}`")
    birth = c("gestational age at birth (weeks)")
    return {
        "parity_within_gravidity": c("parity (number)") <= c("gravidity (number)"),
        "enrollment_before_birth": c("gestational age at enrollment (weeks)") <= birth,
        "preterm_iff_below_37": (c("preterm birth") == 1) == (birth < 37),
        "cesarean_needs_parity": ~((c("previous cesarean") == 1) & (c("parity (number)") == 0)),
    }
