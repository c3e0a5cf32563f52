"""Patient candidates, visit matching, and registration without duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..scale import cut_lineage, numbered

KEYS = C.KEY_FIELDS


def candidates(documents: DataFrame, patients: DataFrame) -> DataFrame:
    """L1: patients of the document's facility that hold one of its link keys.

    Two equi joins and a union, one per key (an OR condition would be a Cartesian product). A key is held by at most one
    patient of a facility, so a document has at most two candidates. A key that very many documents carry makes a skewed
    partition on the document side only, which adaptive execution splits.
    """
    doc = documents.select("document_id", "facility_id", *KEYS)
    pats = patients.select("patient_id", "facility_id", *KEYS)
    found = None
    for key in KEYS:
        mine = doc.where(F.col(key).isNotNull()).select("document_id", "facility_id", F.col(key).alias("_k"))
        held = pats.where(F.col(key).isNotNull()).select("patient_id", "facility_id", F.col(key).alias("_k"))
        hit = mine.join(held, ["facility_id", "_k"], "inner").select("document_id", "patient_id", F.lit(key).alias("key"))
        found = hit if found is None else found.unionByName(hit)
    pairs = found.groupBy("document_id", "patient_id").agg(*[F.bool_or(F.col("key") == k).alias(f"m_{k}") for k in KEYS])
    full = (pairs.join(doc.select("document_id", *[F.col(k).alias(f"d_{k}") for k in KEYS]), "document_id")
            .join(pats.select("patient_id", *KEYS), "patient_id"))
    conflict = {k: F.coalesce(F.col(f"d_{k}").isNotNull() & F.col(k).isNotNull() & (F.col(f"d_{k}") != F.col(k)), F.lit(False)) for k in KEYS}
    total = pairs.groupBy("document_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    listed = lambda tests: F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))
    mismatch = conflict[KEYS[0]] | conflict[KEYS[1]]
    several = F.col("candidate_count") > 1
    return full.join(total, "document_id").select(
        "document_id", "patient_id", listed({k: F.col(f"m_{k}") for k in KEYS}).alias("matched_keys"), listed(conflict).alias("conflicting_keys"),
        F.when(mismatch | several, "CONFLICT").otherwise("STRONG").alias("strength"),
        F.array_compact(F.array(F.when(mismatch, "KEY_MISMATCH"), F.when(several, "MULTIPLE_CANDIDATES"))).alias("flags"), "candidate_count")


def visit_stats(visits: DataFrame) -> DataFrame:
    """L2: visits and last date per patient."""
    return visits.groupBy("patient_id").agg(F.count(F.lit(1)).alias("visit_count"), F.max("visit_date").alias("last_visit_date"))


def suggest_patient(found: DataFrame, documents: DataFrame) -> DataFrame:
    """L3: the only STRONG candidate, when both keys are read as KNOWN with confidence and both match."""
    strong = found.where("strength = 'STRONG'").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("patient_id").alias("suggested_patient_id"), F.min(F.size("matched_keys")).alias("_keys"))
    sure = None
    for k in KEYS:
        test = F.col(k).isNotNull() & (F.col(f"{k}_status") == "KNOWN") & (F.col(f"{k}_confidence") >= C.KNOWN_CONFIDENCE)
        sure = test if sure is None else sure & test
    return documents.where(F.coalesce(sure, F.lit(False))).select("document_id").join(
        strong.where(F.col("_n") == 1).where(F.col("_keys") == len(KEYS)), "document_id").select("document_id", "suggested_patient_id")


def selection_warnings(selections: DataFrame, found: DataFrame) -> DataFrame:
    """L4: warnings on a chosen existing patient."""
    marks = found.select("document_id", "patient_id", "flags")
    return selections.where("choice = 'EXISTING'").join(marks, ["document_id", "patient_id"], "left").select(
        "document_id", "patient_id", F.coalesce("flags", F.array(F.lit("NO_KEY_MATCH"))).alias("warnings"))


def visit_version(visits: DataFrame) -> Column:
    """Fingerprint of a visit's fields, history and sources; equal means unchanged."""
    parts = [F.to_json(F.array_sort(F.map_entries("fields"))), *[F.to_json(c) for c in ("history", "source_documents") if c in visits.columns]]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def match_encounters(encounters: DataFrame, visits: DataFrame) -> DataFrame:
    """Outcome of each encounter against the patient's visit of the same type and date.

    `fields` is map(name -> value text) on both sides. A null draft value never differs, nor does the date.
    """
    stored = visits.select("patient_id", "encounter_type", "visit_date", "visit_id", F.col("slot").alias("_slot"),
                           F.col("fields").alias("_fields"), visit_version(visits).alias("existing_version"))
    joined = encounters.join(stored, ["patient_id", "encounter_type", "visit_date"], "left")
    names = F.array(*[F.lit(f) for f in C.ENCOUNTER_FIELDS if f != "visit_date"])
    diffs = F.filter(names, lambda n: F.try_element_at("fields", n).isNotNull()
                     & ~F.try_element_at("fields", n).eqNullSafe(F.try_element_at("_fields", n)))
    known = F.col("visit_id").isNotNull()
    marked = joined.withColumn("diffs", F.when(known, diffs).otherwise(F.array().cast("array<string>")))
    return marked.withColumns({
        "outcome": F.when(F.col("visit_date").isNull(), "MISSING_DATE").when(~known, "NEW").when(F.size("diffs") > 0, "EXISTS_DIFFERENT").otherwise("EXISTS_SAME"),
        "flags": F.when(known & ~F.col("_slot").eqNullSafe(F.col("slot")), F.array(F.lit("SLOT_DIFFERS"))).otherwise(F.array().cast("array<string>"))
    }).drop("_slot", "_fields")


def confirm_gate(documents: DataFrame, matches: DataFrame, decisions: DataFrame, pending_retakes: DataFrame) -> DataFrame:
    """Verdict per confirmation: REPLAY, a refusal, or ACCEPTED.

    `documents` hold status, revision, expected_revision; `decisions` hold (document_id, encounter_index, decision UPDATE /
    KEEP / FIELDS, selected array, expected_version).
    """
    asked = matches.join(decisions, ["document_id", "encounter_index"], "left")
    different = F.col("outcome") == "EXISTS_DIFFERENT"
    partial = F.col("decision") == "FIELDS"
    # A choice of fields must be a non-empty subset of what differs.
    legal = F.col("decision").isin("UPDATE", "KEEP") | (partial & (F.size("selected") > 0) & (F.size(F.array_except("selected", "diffs")) == 0))
    stale = partial & ~F.col("expected_version").eqNullSafe(F.col("existing_version"))
    flags = asked.groupBy("document_id").agg(
        F.bool_or(different & ~F.coalesce(legal, F.lit(False))).alias("_undecided"), F.bool_or(F.coalesce(stale, F.lit(False))).alias("_stale"))
    waiting = pending_retakes.where("status = 'PENDING'").select("document_id").distinct().withColumn("_retake", F.lit(True))
    joined = documents.join(flags, "document_id", "left").join(waiting, "document_id", "left")
    verdict = (F.when(F.col("status").isin(C.REGISTERED), "REPLAY").when(F.col("_retake"), "RETAKE_PENDING")
               .when(F.col("status") != "PATIENT_MATCHED", "NOT_READY")
               .when(~F.col("expected_revision").eqNullSafe(F.col("revision")), "STALE_REVISION")
               .when(F.col("_undecided"), "DECISION_REQUIRED").when(F.col("_stale"), "STALE_VISIT").otherwise("ACCEPTED"))
    return joined.withColumn("verdict", verdict).drop("_undecided", "_stale", "_retake")


def confirm_fields(fields: DataFrame, accepted: DataFrame, reviewer: Column, at: Column) -> DataFrame:
    """A confirmed document's unverified base fields become CONFIRMED; extended fields do not."""
    joined = fields.join(accepted.select("document_id", F.lit(True).alias("_ok")), "document_id", "left")
    hit = F.col("_ok") & F.col("section").isin("document", "encounter") & (F.col("verification_state") == "UNVERIFIED")
    hit = F.coalesce(hit, F.lit(False))
    return joined.withColumns({"verification_state": F.when(hit, "CONFIRMED").otherwise(F.col("verification_state")),
                               "verified_by": F.when(hit, reviewer), "verified_at": F.when(hit, at)}).drop("_ok")


VISIT_KEY = ["patient_id", "encounter_type", "visit_date"]


def choose_documents(accepted: DataFrame) -> DataFrame:
    """The documents of a batch that can be applied as they were judged, as if one after the other by seq: a document is
    left out when an encounter of it has no date, when two of its encounters are one visit, or when a document applied
    before it has touched one of its visits (it must be matched again against the new state).

    Rounds over the undecided: who is first on all its visits is applied, and who shares a visit with it is left out. So a
    visit that many documents claim is settled at once; rounds are only as many as the longest chain of documents that wait
    for one another.
    """
    claims = accepted.groupBy("document_id", *VISIT_KEY).agg(F.count(F.lit(1)).alias("_n"))
    turns = accepted.groupBy("document_id").agg(F.min("seq").alias("_turn"), F.bool_or(F.col("visit_date").isNull()).alias("_undated"))
    twice = claims.groupBy("document_id").agg(F.max("_n").alias("_most"))
    sound = turns.where("NOT _undated").join(twice.where("_most = 1").select("document_id"), "document_id", "left_semi").drop("_undated")
    undecided = cut_lineage(claims.select("document_id", *VISIT_KEY).join(sound, "document_id"))
    applied = undecided.where(F.lit(False)).select(F.col("document_id").alias("_applied"))
    while not undecided.isEmpty():
        order = F.struct("_turn", "document_id")
        first = undecided.groupBy(*VISIT_KEY).agg(F.min(order).alias("_first"))
        marked = undecided.join(first, VISIT_KEY).withColumn("_leads", F.col("_first") == order)
        leaders = cut_lineage(marked.groupBy("document_id").agg(F.bool_and("_leads").alias("_leads")).where("_leads").select("document_id"))
        applied = applied.union(leaders.select(F.col("document_id").alias("_applied")))
        taken = undecided.join(leaders, "document_id", "left_semi").select(*VISIT_KEY)
        beaten = undecided.join(taken, VISIT_KEY, "left_semi").select("document_id").distinct()  # the leaders themselves as well
        undecided = cut_lineage(undecided.join(beaten, "document_id", "left_anti"))
    return cut_lineage(applied.select(F.col("_applied").alias("document_id")))


def upsert_visits(visits: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visits after the batch, outcome per encounter, deferred encounters).

    `accepted` rows: seq, document_id, patient_id, encounter_type, visit_date, slot, fields, decision (UPDATE, KEEP, FIELDS or
    null), selected, by, at. A document is applied whole or deferred whole (`choose_documents`); deferred ones must be
    matched again against the new state. Applying a batch twice changes nothing.
    """
    key = VISIT_KEY
    chosen_docs = choose_documents(accepted)
    first = accepted.join(chosen_docs, "document_id", "left_semi")
    deferred = accepted.join(chosen_docs, "document_id", "left_anti")
    new = first.select(*key, *[F.col(c).alias(f"n_{c}") for c in ("document_id", "slot", "fields", "decision", "selected", "by", "at", "seq")])
    both = visits.join(new, key, "full_outer")
    exists, arrives = F.col("visit_id").isNotNull(), F.col("n_seq").isNotNull()
    names = F.array(*[F.lit(f) for f in C.ENCOUNTER_FIELDS if f != "visit_date"])
    diffs = F.filter(names, lambda n: F.try_element_at("n_fields", n).isNotNull() & ~F.try_element_at("n_fields", n).eqNullSafe(F.try_element_at("fields", n)))
    both = both.withColumn("_diffs", F.when(exists & arrives, diffs).otherwise(F.array().cast("array<string>")))
    chosen = F.when(F.col("n_decision") == "UPDATE", F.col("_diffs")).when(F.col("n_decision") == "FIELDS", F.array_intersect("_diffs", "n_selected")).otherwise(
        F.array().cast("array<string>"))
    both = both.withColumn("_set", chosen)
    outcome = (F.when(arrives & ~exists, "CREATED").when(arrives & (F.size("_diffs") == 0), "UNCHANGED").when(
        arrives & F.col("n_decision").isin("UPDATE", "FIELDS"), "UPDATED").when(arrives, "KEPT_EXISTING"))
    updated = F.map_zip_with("fields", "n_fields", lambda k, old, new_: F.when(F.array_contains("_set", k), new_).otherwise(old))
    kept = F.map_filter(updated, lambda k, v: F.map_contains_key("fields", k) | F.array_contains("_set", k))
    previous = F.map_from_arrays(F.col("_set"), F.transform("_set", lambda k: F.try_element_at("fields", k)))
    entry = F.struct(F.col("n_at").alias("at"), F.col("n_by").alias("by"), F.col("n_document_id").alias("document_id"), previous.alias("previous"),
                     F.array_sort("_set").alias("selected_fields"))
    no_history = F.array().cast("array<struct<at:timestamp,by:string,document_id:string,previous:map<string,string>,selected_fields:array<string>>>")
    after = both.withColumn("outcome", outcome)
    result = after.select(
        F.coalesce("visit_id", F.concat(F.lit("VIS-"), F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256), 1, 16))).alias("visit_id"),
        *key, F.coalesce("slot", "n_slot").alias("slot"),
        F.when(~exists, F.col("n_fields")).when(F.size("_set") > 0, kept).otherwise(F.col("fields")).alias("fields"),
        F.when(~exists, F.array("n_document_id")).when(arrives, F.array_union("source_documents", F.array("n_document_id"))).otherwise(F.col("source_documents")).alias("source_documents"),
        F.when(~exists, no_history).when(F.size("_set") > 0, F.concat("history", F.array(entry))).otherwise(F.col("history")).alias("history"),
        "outcome", F.col("n_document_id").alias("_doc"), F.col("n_seq").alias("_seq"))
    outcomes = result.where("outcome IS NOT NULL").select(F.col("_seq").alias("seq"), F.col("_doc").alias("document_id"), "visit_id", "visit_date", "slot", "outcome")
    return result.drop("outcome", "_doc", "_seq"), outcomes, deferred


def create_patients(requests: DataFrame, patients: DataFrame) -> DataFrame:
    """Verdict per explicit NEW: refused when a key is held in the facility, or was taken by an earlier request of the
    batch; NO_LINK_KEY when it has none. A refused request takes no key, as if the requests came one by one.

    Rounds over the undecided: who is first on all its keys is created and refuses the others on them. Each round decides
    at least the first request of every facility; with few requests on one key there are few rounds.
    """
    rows = requests.select("seq", "facility_id", *KEYS)
    verdict = None
    for key in KEYS:
        held = patients.where(F.col(key).isNotNull()).select("facility_id", key).distinct().withColumn(f"_held_{key}", F.lit(True))
        rows = rows.join(held, ["facility_id", key], "left")
        verdict = F.col(f"_held_{key}") if verdict is None else F.coalesce(verdict, F.col(f"_held_{key}"))
    rows = rows.select("seq", "facility_id", *KEYS, F.when(verdict, "KEY_ALREADY_REGISTERED").alias("verdict"))
    decided, undecided = rows.where("verdict IS NOT NULL").select("seq", "verdict"), cut_lineage(rows.where("verdict IS NULL").drop("verdict"))
    while not undecided.isEmpty():
        first = undecided
        for key in KEYS:
            leads = undecided.where(F.col(key).isNotNull()).groupBy("facility_id", key).agg(F.min("seq").alias(f"_first_{key}"))
            first = first.join(leads, ["facility_id", key], "left")
        leads_all = [F.coalesce(F.col("seq") == F.col(f"_first_{key}"), F.lit(True)) for key in KEYS]
        created = cut_lineage(first.where(leads_all[0] & leads_all[1]).select("seq", "facility_id", *KEYS))
        rest = undecided.join(created.select("seq"), "seq", "left_anti")
        beaten = None
        for key in KEYS:
            taken = created.where(F.col(key).isNotNull()).select("facility_id", key, F.col("seq").alias(f"_by_{key}"))
            rest = rest.join(taken, ["facility_id", key], "left")
            test = F.col(f"_by_{key}") < F.col("seq")
            beaten = F.coalesce(test, F.lit(False)) if beaten is None else beaten | F.coalesce(test, F.lit(False))
        rest = cut_lineage(rest.select("seq", "facility_id", *KEYS, beaten.alias("_beaten")))
        decided = cut_lineage(decided.unionByName(created.select("seq", F.lit("CREATED").alias("verdict"))).unionByName(
            rest.where("_beaten").select("seq", F.lit("KEY_TAKEN_IN_BATCH").alias("verdict"))))
        undecided = rest.where("NOT _beaten").drop("_beaten")
    none = F.col(KEYS[0]).isNull() & F.col(KEYS[1]).isNull()
    return requests.join(decided, "seq").select(*requests.columns, "verdict",
                                                F.when(none, F.array(F.lit("NO_LINK_KEY"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def fill_keys(patients: DataFrame, documents: DataFrame) -> DataFrame:
    """Patients with missing keys filled from registered documents (patient_id, seq, keys) when nobody in the facility
    holds the key; nothing is overwritten. Documents count in the order of seq: the earlier offer of a key keeps it, and a
    patient whose offer is gone gets the next one. Rounds until no offer is open."""
    out = patients
    for key in KEYS:
        held = patients.where(F.col(key).isNotNull()).select("facility_id", F.col(key).alias("_offer")).distinct()
        offers = documents.where(F.col(key).isNotNull()).select("patient_id", "seq", F.col(key).alias("_offer")).join(
            out.where(F.col(key).isNull()).select("patient_id", "facility_id"), "patient_id")
        open_ = cut_lineage(offers.join(held, ["facility_id", "_offer"], "left_anti").groupBy("patient_id", "facility_id", "_offer").agg(F.min("seq").alias("seq")))
        grants = None
        while not open_.isEmpty():
            per_key = open_.groupBy("facility_id", "_offer").agg(F.min(F.struct("seq", "patient_id")).alias("_k"))
            per_patient = open_.groupBy("patient_id").agg(F.min(F.struct("seq", "_offer")).alias("_p"))
            won = cut_lineage(open_.join(per_key, ["facility_id", "_offer"]).join(per_patient, "patient_id").where(
                (F.col("_k.patient_id") == F.col("patient_id")) & (F.col("_p._offer") == F.col("_offer"))).select("patient_id", "facility_id", "_offer"))
            grants = won if grants is None else cut_lineage(grants.unionByName(won))
            open_ = cut_lineage(open_.join(won.select("patient_id"), "patient_id", "left_anti").join(won.select("facility_id", "_offer"), ["facility_id", "_offer"], "left_anti"))
        if grants is not None:
            out = out.join(grants.select("patient_id", "_offer"), "patient_id", "left").withColumn(key, F.coalesce(key, "_offer")).drop("_offer")
    return out.select(*patients.columns)


def assign_ids(df: DataFrame, order: str, prefix: str, start: Column | int = 0, out: str = "new_id", block_size: int = 65_536) -> DataFrame:
    """Dense ids PREFIX-000001, ... in `order` (a unique whole number). Rows are numbered inside blocks of the order;
    the counts of the blocks are added up level by level."""
    base = start if isinstance(start, Column) else F.lit(start)
    return numbered(df, [], [order], F.floor(F.col(order) / block_size), "_no", levels=3).withColumn(
        out, F.format_string(f"{prefix}-%06d", F.col("_no") + base)).drop("_no")


def patient_list(patients: DataFrame, visits: DataFrame) -> DataFrame:
    """Patients with their visit count and last date."""
    return patients.join(visit_stats(visits), "patient_id", "left").withColumn("visit_count", F.coalesce("visit_count", F.lit(0)))


def patient_timeline(patients: DataFrame, visits: DataFrame, facilities: DataFrame) -> DataFrame:
    """One row per visit with patient and facility; sorted where it is shown. Histories stay with their visit."""
    head = patients.join(facilities.select("facility_id", F.col("name").alias("facility_name")), "facility_id", "left").select(
        "patient_id", "facility_id", "facility_name")
    sizes = [F.size("history").alias("revisions")] if "history" in visits.columns else []
    return visits.join(head, ["patient_id"], "inner").select("*", *sizes)


def compact_fields(fields: Column) -> Column:
    """Value, status and verification state of each field of a visit."""
    return F.transform_values(fields, lambda _k, v: F.struct(v["value"].alias("value"), v["field_status"].alias("field_status"),
                                                             v["verification"]["state"].alias("verification")))


def list_senders(senders: DataFrame, facilities: DataFrame) -> DataFrame:
    """Senders with the names of their facilities; sort by label where it is shown."""
    return senders.join(facilities.select("facility_id", F.col("name").alias("facility_name")), "facility_id", "inner")
