"""Review actions, retakes, page chains, status and the views built from them.

The ordered folds are written in closed form (last setter, previous event, running count of openings), so they are
aggregates and bucketed neighbours over the event rows; no history is gathered into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..scale import block, cut_lineage, first_by, neighbour, numbered, running_before, running_count, salted_join

FIELD_KEY = ["document_id", "section", "encounter_index", "item_index", "field"]
SEQ_BLOCK = 65_536


def _key(df: DataFrame) -> DataFrame:
    """One text key per field, so that null indexes join."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in FIELD_KEY]
    return df.withColumn("_key", F.concat_ws("\x1f", *parts))


def fold_reviews(fields: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields after review, corrections as rows, refused actions).

    `actions` carry seq, action, new_value and error (from N1 on the typed text), field_status, reviewer and at. What a
    CORRECT or SET_STATUS leaves does not depend on what was there before, so the state after each action follows from
    the last of them before it; a CONFIRM can only be refused while no such action has been taken yet.
    """
    base = _key(fields).select("_key", F.col("value").alias("_v0"), F.col("field_status").alias("_s0"), F.col("required").alias("_req"))
    acts = _key(actions).join(base, ["_key"], "left")
    act = F.col("action")
    reason = (F.when(F.col("_s0").isNull(), "UNKNOWN_FIELD")
              .when((act == "CORRECT") & F.col("error").isNotNull(), "INVALID_VALUE")
              .when((act == "SET_STATUS") & ~F.coalesce(F.col("field_status").isin(C.MISSING_STATUSES), F.lit(False)), "INVALID_STATUS")
              .when((act == "SET_STATUS") & F.col("_req"), "VALUE_REQUIRED")
              .when(~act.isin("CONFIRM", "CORRECT", "SET_STATUS"), "UNKNOWN_ACTION"))
    checked = acts.withColumn("_reason", reason)
    sets = act.isin("CORRECT", "SET_STATUS") & F.col("_reason").isNull()
    after = F.struct(F.when(act == "CORRECT", F.col("new_value")).alias("value"),
                     F.when(act == "CORRECT", "KNOWN").otherwise(F.col("field_status")).alias("field_status"))
    checked = checked.withColumns({"_sets": sets, "_after": after})
    first_set = checked.where("_sets").groupBy("_key").agg(F.min("seq").alias("_first_set"))
    timed = checked.join(first_set, ["_key"], "left")
    untouched = F.col("_first_set").isNull() | (F.col("seq") < F.col("_first_set"))
    refuse = F.when((act == "CONFIRM") & untouched & F.col("_v0").isNull() & F.col("_req"), "VALUE_REQUIRED").when(
        (act == "CONFIRM") & untouched & F.col("_v0").isNull() & (F.col("_s0") == "NEEDS_REVIEW"), "NOTHING_TO_CONFIRM")
    timed = timed.withColumn("_reason", F.coalesce("_reason", refuse))
    refused = timed.where("_reason IS NOT NULL").select(*[c for c in actions.columns], F.col("_reason").alias("reason"))
    good = timed.where("_reason IS NULL")

    last = good.groupBy("_key").agg(
        F.max_by(F.struct("action", "reviewer", "at"), "seq").alias("_last"),
        F.max_by("_after", F.when(F.col("_sets"), F.col("seq"))).alias("_set"),
        F.count_if("_sets").alias("correction_count"))
    folded = _key(fields).join(last, "_key", "left")
    confirmed = F.when((F.col("_last").isNotNull()) & (F.col("field_status") == "NEEDS_REVIEW"), "KNOWN").otherwise(F.col("field_status"))
    result = folded.withColumns({
        "value": F.when(F.col("_set").isNotNull(), F.col("_set.value")).otherwise(F.col("value")),
        "field_status": F.when(F.col("_set").isNotNull(), F.col("_set.field_status")).otherwise(confirmed),
        "verification_state": F.when(F.col("_last.action") == "CONFIRM", "CONFIRMED").when(
            F.col("_last").isNotNull(), "CORRECTED").otherwise(F.col("verification_state")),
        "verified_by": F.col("_last.reviewer"), "verified_at": F.col("_last.at"),
        "correction_count": F.coalesce("correction_count", F.lit(0))}).drop("_key", "_last", "_set")

    # A correction keeps what was there: the setter before it, or the value as read (KNOWN if it had been confirmed).
    setters = neighbour(good.where("_sets"), ["_key"], ["seq"], block("seq", SEQ_BLOCK), ["_after"], "_prev")
    confirmed_first = good.where("action = 'CONFIRM'").groupBy("_key").agg(F.min("seq").alias("_confirm"))
    told = setters.join(confirmed_first, ["_key"], "left")
    before = F.when(F.col("_prev").isNotNull(), F.col("_prev._after")).otherwise(F.struct(
        F.col("_v0").alias("value"), F.when((F.col("_confirm") < F.col("seq")) & (F.col("_s0") == "NEEDS_REVIEW"), "KNOWN")
        .otherwise(F.col("_s0")).alias("field_status")))
    corrections = told.select(*FIELD_KEY, "seq", "at", F.col("reviewer").alias("by"), "action", before.alias("previous"), F.col("_after").alias("new"))
    return result, corrections, refused


def blocking_items(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """R2: what a reviewer must settle: pages with a reason first, then fields in review order, then repeated dates.

    `fields` are the base fields; extended fields never block.
    """
    null_s, null_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    page = pages.where("review_reason IS NOT NULL").select(
        "document_id", F.lit(0).alias("rank"), F.lit("page").alias("scope"), F.col("page_index").cast("int").alias("item"), null_s.alias("slot"),
        null_s.alias("field"), F.col("review_reason").alias("reason"))
    reason = F.when(F.col("required") & F.col("value").isNull(), "REQUIRED_MISSING").when(
        (F.col("verification_state") == "UNVERIFIED") & F.col("field_status").isin("NEEDS_REVIEW", "ILLEGIBLE"), F.col("field_status"))
    field = fields.withColumn("reason", reason).where("reason IS NOT NULL").select(
        "document_id", F.lit(1).alias("rank"), F.when(F.col("encounter_index").isNull(), "document").otherwise("encounter").alias("scope"),
        F.col("encounter_index").cast("int").alias("item"), "slot", "field", "reason")
    dates = fields.where("field = 'visit_date' AND value IS NOT NULL")
    same_date = Window.partitionBy("document_id", "value")  # encounters of one document on one date: at most ten slots
    repeated = dates.withColumn("_first", F.min("encounter_index").over(same_date)).where("encounter_index > _first").select(
        "document_id", F.lit(2).alias("rank"), F.lit("encounter").alias("scope"), F.col("encounter_index").cast("int").alias("item"),
        "slot", "field", F.lit("DUPLICATE_ENCOUNTER_DATE").alias("reason"))
    return page.unionByName(field).unionByName(repeated)


def blocking_counts(blocking: DataFrame) -> DataFrame:
    return blocking.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocking_count"))


def document_status(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """Status of reviewable documents from the selection and the blocking items."""
    joined = documents.join(counts, "document_id", "left")
    status = (F.when(~F.col("status").isin(C.REVIEWABLE), F.col("status")).when(F.col("choice") == "UNSURE", "DUPLICATE_SUSPECTED")
              .when(F.coalesce("blocking_count", F.lit(0)) > 0, "NEEDS_REVIEW").when(F.col("choice").isNotNull(), "PATIENT_MATCHED")
              .otherwise("VALIDATED"))
    return joined.withColumn("status", status).drop("blocking_count")


def next_step(status: Column, retake_pending: Column, blocking: Column, choice: Column, differing: Column) -> Column:
    """What happens next with a document, first rule that applies."""
    return (F.when(status == "CAPTURED", "COLLECTING").when(retake_pending & (status != "REGISTERED"), "WAITING_RETAKE")
            .when(status == "PENDING_AI", "WAITING_AI").when(status == "PROCESSING_FAILED", "FAILED")
            .when(status.isin(C.REGISTERED), "DONE").when(blocking > 0, "FIELD")
            .when(choice.isNull() | (choice == "UNSURE"), "PATIENT").when(differing > 0, "EXISTING_VISITS").otherwise("CONFIRM"))


def retake_reason(pages: DataFrame, draft_pages: DataFrame, failure_pages: DataFrame) -> DataFrame:
    """Why a page's photo could not be used: the draft's entry at its position and ref; without a draft, the last
    failure. Only known reasons."""
    drafted = draft_pages.select("document_id").distinct().withColumn("_draft", F.lit(True))
    entry = draft_pages.select("document_id", "position", F.col("page_ref").alias("_ref"), F.col("retake_reason").alias("_r1"))
    failed = failure_pages.select("page_id", F.col("reason").alias("_r2"))
    joined = pages.join(drafted, "document_id", "left").join(entry, ["document_id", "position"], "left").join(failed, "page_id", "left")
    reason = F.when(F.col("_draft"), F.when(F.col("_ref") == F.col("media_ref"), F.col("_r1"))).otherwise(F.col("_r2"))
    return joined.select("document_id", "page_id", "position", F.when(reason.isin(C.RETAKE_REASONS), reason).alias("reason"))


def fail_documents(failures: DataFrame, documents: DataFrame) -> DataFrame:
    """The first permanent failure of each waiting document; codes outside the allowed list are dropped."""
    first = first_by(failures.where(F.col("code").isin(C.FAILURE_CODES)).select("document_id", "seq", "code"), ["document_id"], ["seq"])
    joined = documents.join(first.select("document_id", "code"), "document_id", "left")
    hit = F.col("code").isNotNull() & (F.col("status") == "PENDING_AI")
    return joined.withColumns({"status": F.when(hit, "PROCESSING_FAILED").otherwise(F.col("status")),
                               "failure_reason": F.when(hit, F.col("code"))}).drop("code")


def reject_stale(commands: DataFrame, documents: DataFrame, key: str = "command_id") -> DataFrame:
    """A verdict per command: the revision must be given and current, and the first command on it wins."""
    current = documents.select("document_id", F.col("revision").alias("_now"))
    winners = commands.groupBy("document_id", "expected_revision").agg(F.min(key).alias(key)).select(key, F.lit(True).alias("_first"))
    joined = commands.join(current, ["document_id"], "left").join(winners, key, "left")
    verdict = (F.when(F.col("_now").isNull(), "UNKNOWN_DOCUMENT").when(F.col("expected_revision").isNull(), "REVISION_REQUIRED")
               .when(F.col("expected_revision") != F.col("_now"), "STALE").when(F.col("_first").isNull(), "STALE").otherwise("ACCEPTED"))
    return joined.withColumn("verdict", verdict).drop("_now", "_first")


def select_patient(commands: DataFrame, documents: DataFrame, patients: DataFrame, reviews: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdict per selection, selection of each document after the last accepted one). CLEAR drops the selection, and
    so does an accepted review of a link key (`reviews`: document_id, seq in the order of the commands, field)."""
    docs = documents.select("document_id", F.col("facility_id").alias("_df"))
    pats = patients.select("patient_id", F.col("facility_id").alias("_pf"))
    joined = commands.join(docs, ["document_id"], "left")
    joined = joined.join(pats, ["patient_id"], "left")
    reason = (F.when(F.col("_df").isNull(), "UNKNOWN_DOCUMENT").when(~F.col("choice").isin("EXISTING", "NEW", "UNSURE", "CLEAR"), "UNKNOWN_CHOICE")
              .when((F.col("choice") == "EXISTING") & F.col("_pf").isNull(), "PATIENT_NOT_FOUND")
              .when((F.col("choice") == "EXISTING") & (F.col("_pf") != F.col("_df")), "OTHER_FACILITY"))
    judged = joined.withColumn("reason", reason).drop("_df", "_pf")
    last = judged.where("reason IS NULL").groupBy("document_id").agg(F.max_by(F.struct(
        "choice", F.when(F.col("choice") == "EXISTING", F.col("patient_id")).alias("patient_id"), "reviewer"), "seq").alias("s"), F.max("seq").alias("seq"))
    if reviews is not None:
        settled = reviews.where(F.col("field").isin(C.KEY_FIELDS)).groupBy("document_id").agg(F.max("seq").alias("_reviewed"))
        last = last.join(settled, "document_id", "left").where(F.col("_reviewed").isNull() | (F.col("_reviewed") <= F.col("seq")))
    selected = last.where("s.choice <> 'CLEAR'").select("document_id", "s.choice", "s.patient_id", F.col("s.reviewer").alias("by"))
    return judged, selected


def fold_retakes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(retake requests with their outcome, refused or repeated events).

    Events of a page are REQUEST, PHOTO and CANCEL by seq, with `allowed` false for a photo of another sender or facility
    and for anything on a registered document. A request opens when the event before it is not a request; a photo or a
    cancellation counts when the event before it is one. After the first photo that counts the page is replaced.
    """
    legal = events.where("allowed")
    near = neighbour(legal, ["page_id"], ["seq"], block("seq", SEQ_BLOCK), ["type"], "_before")
    pending = F.coalesce(F.col("_before.type") == "REQUEST", F.lit(False))
    marked = near.withColumn("_pending", pending).drop("_before")
    done = marked.where("type = 'PHOTO' AND _pending").groupBy("page_id").agg(F.min("seq").alias("_done"))
    live = marked.join(done, ["page_id"], "left").withColumn(
        "_over", F.coalesce(F.col("seq") > F.col("_done"), F.lit(False))).drop("_done")
    opens = (F.col("type") == "REQUEST") & ~F.col("_pending") & ~F.col("_over")
    closes = (F.col("type") != "REQUEST") & F.col("_pending") & ~F.col("_over")
    counted = running_count(live.withColumns({"_opens": opens, "_closes": closes}), ["page_id"], ["seq"], block("seq", SEQ_BLOCK),
                            F.col("_opens").cast("int"), "request_no")
    requests = counted.where("_opens OR _closes").groupBy("page_id", "request_no").agg(
        F.min(F.when(F.col("_opens"), F.struct("seq", "at", "actor"))).alias("o"),
        F.min(F.when(F.col("_closes"), F.struct("seq", "at", "actor", "type"))).alias("c"))
    requests = requests.where("o IS NOT NULL").select(
        "page_id", "request_no", F.col("o.seq").alias("requested_seq"), F.col("o.at").alias("requested_at"), F.col("o.actor").alias("requested_by"),
        F.when(F.col("c").isNull(), "PENDING").when(F.col("c.type") == "PHOTO", "FULFILLED").otherwise("CANCELLED").alias("status"),
        F.col("c.seq").alias("closed_seq"), F.col("c.at").alias("closed_at"))
    reason = F.when(F.col("_over"), "PAGE_REPLACED").when(F.col("type") == "REQUEST", "REPEATED").otherwise("RETAKE_NOT_PENDING")
    refused = counted.where("NOT _opens AND NOT _closes").select(*events.columns, reason.alias("reason")).unionByName(
        events.where("NOT allowed").withColumn("reason", F.lit("NOT_ALLOWED")))
    return requests, refused


def retake_view(retakes: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests with the position and refs of the original and its replacement."""
    original = pages.select("page_id", "position", F.col("media_ref").alias("original_media_ref"))
    new = pages.select(F.col("page_id").alias("replacement_page_id"), F.col("media_ref").alias("replacement_media_ref"))
    return retakes.join(original, "page_id").join(new, "replacement_page_id", "left")


def active_pages(pages: DataFrame) -> DataFrame:
    """Pages that were not replaced."""
    return pages.where(F.col("replaced_by").isNull())


def page_chain(pages: DataFrame) -> DataFrame:
    """For every page the active page at the end of its replacement chain and the number of steps to it.

    Pointer jumping: each round doubles the reach, so a chain of n pages takes log2(n) joins. Pages that have arrived
    leave the loop, so the end of a long chain never becomes a hot join key. Lineage is cut every round. A round in which
    no page arrives leaves only pages that go round in circles; they have no active page and no number of steps.
    """
    links = pages.select("page_id", F.col("replaced_by").alias("to"))
    resolved = links.where("to IS NULL").select("page_id", F.col("page_id").alias("active_page_id"), F.lit(0).cast("long").alias("steps"))
    walking = links.where("to IS NOT NULL").withColumn("hops", F.lit(1).cast("long"))
    while True:
        table = resolved.select(F.col("page_id").alias("_p"), F.col("active_page_id").alias("_to"), F.col("steps").alias("_h"), F.lit(True).alias("_end")
                                ).unionByName(walking.select(F.col("page_id").alias("_p"), F.col("to").alias("_to"), F.col("hops").alias("_h"), F.lit(False).alias("_end")))
        jumped = cut_lineage(walking.join(table, F.col("to") == F.col("_p"), "left").select(
            "page_id", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.coalesce("_end", F.lit(True)).alias("_end")))
        arrived, walking = jumped.where("_end"), jumped.where("NOT _end").drop("_end")
        if arrived.isEmpty():
            return resolved.unionByName(walking.select("page_id", F.lit(None).cast(walking.schema["to"].dataType).alias("active_page_id"), F.lit(None).cast("long").alias("steps")))
        resolved = resolved.unionByName(arrived.select("page_id", F.col("to").alias("active_page_id"), F.col("hops").alias("steps")))


MOVE_BLOCK = 4096


def move_pages(pages: DataFrame, moves: DataFrame, documents: DataFrame, retakes: DataFrame, chain: DataFrame,
               ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pages after the moves, verdict per move, documents to reset or delete, retakes after the moves).

    Moves have move_id (a whole number that orders them), page_id, target_document_id (a fresh id for a split) and `split`.
    The result is that of the moves one by one: each is judged on where its page is, how many pages are left there and which
    documents still exist at its turn. Replaced originals and their retakes follow their active page, positions are
    compacted, both drafts are dropped, and a document without pages is removed.

    A verdict depends on earlier moves only: on the last one of its page and on the sizes of two documents. So verdicts are
    guessed for all moves together and judged again from running sums under the guess, until none changes. The first move
    is right at once and each round settles at least the next one, so what stays is the sequential result; in practice a
    round settles all but the moves that hang on a wrong guess.

    Moves may have a `scope`: those of a scope are judged on the documents as stored and on one another, not on the moves of
    other scopes. A document whose facility_id is null is open to all facilities.
    """
    scope = (F.col("scope") if "scope" in moves.columns else F.lit(0)).alias("_scope")
    moves = moves.select("move_id", "page_id", "target_document_id", "split", scope)
    docs = documents.select("document_id", "status", "facility_id")
    pending = retakes.where("status = 'PENDING'").select("page_id").distinct().withColumn("_retake", F.lit(True))
    home = pages.select("page_id", F.col("document_id").alias("_home"), "replaced_by").join(
        docs.select(F.col("document_id").alias("_home"), F.col("status").alias("_hs"), F.col("facility_id").alias("_hf")), "_home", "left")
    target = docs.select(F.col("document_id").alias("target_document_id"), F.col("status").alias("_ts"), F.col("facility_id").alias("_tf"))
    split_from = moves.where("split").join(home, "page_id").groupBy("_scope", "target_document_id").agg(F.min("_hf").alias("_sf"))  # a new document is of its page's facility
    known = (moves.join(home, "page_id", "left").join(pending, "page_id", "left")
             .join(target, "target_document_id", "left").join(split_from, ["_scope", "target_document_id"], "left"))
    fixed = (F.when(F.col("_home").isNull(), "PAGE_NOT_FOUND").when(F.col("replaced_by").isNotNull(), "PAGE_REPLACED")
             .when(F.col("_retake"), "RETAKE_PENDING").when(F.col("_hs").isin(C.REGISTERED), "ALREADY_REGISTERED"))
    later = (F.when(~F.col("split") & F.col("_ts").isin(C.REGISTERED), "ALREADY_REGISTERED")
             .when(~F.col("split") & (F.coalesce("_tf", "_sf") != F.col("_hf")), "OTHER_FACILITY"))
    static = cut_lineage(known.select("move_id", "page_id", "split", "_scope", "_home", F.col("target_document_id").alias("_to"),
                                      F.col("_ts").isNotNull().alias("_stored"), fixed.alias("_fixed"), later.alias("_later")))
    sizes = cut_lineage(active_pages(pages).groupBy("document_id").agg(F.count(F.lit(1)).alias("_size")))

    guess = static.withColumns({"_from": F.col("_home"), "reason": F.coalesce("_fixed", "_later")})
    while True:
        judged = cut_lineage(_judge_moves(guess, sizes))
        changed = judged.where(~F.col("reason").eqNullSafe(F.col("_old")) | ~F.col("_from").eqNullSafe(F.col("_old_from")))
        guess = judged.drop("_old", "_old_from")
        if changed.isEmpty():
            break
    verdicts = guess.select("move_id", "page_id", F.col("_from").alias("source_document_id"), F.col("_to").alias("target_document_id"), "reason")
    accepted = verdicts.where("reason IS NULL")

    final = accepted.groupBy(F.col("page_id").alias("active_page_id")).agg(
        F.max_by("target_document_id", "move_id").alias("_in"), F.max("move_id").alias("_order"))
    carried = chain.join(final, "active_page_id").select("page_id", "_in", "_order")
    moved = pages.join(carried, "page_id", "left").withColumns({
        "document_id": F.coalesce("_in", "document_id"), "_late": F.coalesce(F.col("_order"), F.lit(-1))})
    # Moved pages stand behind the pages already there, in the order of the moves; blocks of moves are buckets of their own.
    active = active_pages(moved).select("document_id", "page_id", "_late", "position", F.col("_order").isNotNull().alias("_came"))
    block_ = F.when(F.col("_came"), F.lit(1 << 40) + block("_late", MOVE_BLOCK)).otherwise(block("position", MOVE_BLOCK))
    place = numbered(active, ["document_id"], ["_came", "_late", "position", "page_id"], block_, "_new").select(F.col("page_id").alias("active_page_id"), "_new")
    placed = moved.join(chain.select("page_id", "active_page_id"), "page_id", "left").join(place, "active_page_id", "left").withColumn(
        "position", F.coalesce("_new", "position")).select(*pages.columns)
    touched = accepted.select(F.explode(F.array("source_document_id", "target_document_id")).alias("document_id")).distinct()
    left = active_pages(placed).select("document_id").distinct().withColumn("_has", F.lit(True))
    effects = touched.join(left, "document_id", "left").select("document_id", F.when(F.col("_has"), "RESET").otherwise("DELETE").alias("effect"))
    followed = retakes
    if "document_id" in retakes.columns:
        followed = retakes.join(carried.select("page_id", "_in"), "page_id", "left").withColumn(
            "document_id", F.coalesce("_in", "document_id")).select(*retakes.columns)
    return placed, verdicts, effects, followed


def _judge_moves(guess: DataFrame, sizes: DataFrame) -> DataFrame:
    """One round of `move_pages`: verdict and source of every move if all earlier moves end as guessed."""
    taken = F.col("reason").isNull()
    own = running_before(guess.withColumn("_moved", F.when(taken, F.col("move_id"))), ["page_id"], ["move_id"], block("move_id", MOVE_BLOCK), maxima={"_last": "_moved"})
    there = guess.where(taken).select(F.col("move_id").alias("_last"), F.col("_to").alias("_now"))
    placed = own.join(there, "_last", "left").withColumns({"_old": F.col("reason"), "_old_from": F.col("_from")}).withColumn("_from", F.coalesce("_now", "_home"))
    # Two rows for each move, one for each document it looks at; accepted moves take a page from one to the other.
    sides = F.explode(F.array(F.struct(F.col("_from").alias("document_id"), F.lit(-1).alias("sign")), F.struct(F.col("_to").alias("document_id"), F.lit(1).alias("sign"))))
    steps = placed.select("move_id", "_scope", F.when(F.col("_old").isNull(), 1).otherwise(0).alias("_n"), sides.alias("_side")).select(
        "move_id", "_scope", "_side.document_id", "_side.sign", (F.col("_n") * F.col("_side.sign")).alias("_step"), F.when(F.col("_side.sign") < 0, F.col("_n")).otherwise(0).alias("_gone"))
    sums = running_before(steps.where("document_id IS NOT NULL"), ["_scope", "document_id"], ["move_id", "sign"], block("move_id", MOVE_BLOCK), {"_sum": "_step", "_left": "_gone"})
    seen = sums.join(sizes, "document_id", "left").withColumn("_size", F.coalesce("_size", F.lit(0)) + F.col("_sum"))
    at = seen.groupBy("move_id").agg(F.max(F.when(F.col("sign") < 0, F.col("_size"))).alias("_source_size"), F.max(F.when(F.col("sign") > 0, F.col("_size"))).alias("_target_size"),
                                     F.max(F.when(F.col("sign") > 0, F.col("_left"))).alias("_target_left"))
    exists = (F.col("_target_size") > 0) | (F.col("_stored") & (F.col("_target_left") == 0))
    reason = (F.when(F.col("_fixed").isNotNull(), F.col("_fixed")).when(~F.col("split") & (F.col("_to") == F.col("_from")), "SAME_DOCUMENT")
              .when(~F.col("split") & ~F.coalesce(exists, F.lit(False)), "DOCUMENT_NOT_FOUND").when(F.col("_later").isNotNull(), F.col("_later"))
              .when(F.col("split") & (F.col("_source_size") == 1), "ONLY_PAGE"))
    return placed.join(at, "move_id", "left").withColumn("reason", reason).select(
        "move_id", "page_id", "split", "_scope", "_home", "_to", "_stored", "_fixed", "_later", "_from", "reason", "_old", "_old_from")


def discard_reviews(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """What is lost when a draft is dropped, and the reset document."""
    lost = fields.groupBy("document_id").agg(F.count_if(F.col("verification_state") != "UNVERIFIED").alias("discarded_reviews"))
    return documents.join(lost, "document_id", "left").withColumns({
        "discarded_reviews": F.coalesce("discarded_reviews", F.lit(0)), "selection_discarded": F.col("choice").isNotNull(),
        "choice": F.lit(None).cast("string"), "revision": F.col("revision") + 1})


def set_sections(pages: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with the last chosen section, documents to read again). An empty choice returns to detection."""
    last = choices.groupBy("page_id").agg(F.max_by(F.struct("section"), "seq").alias("_c"))
    joined = pages.join(last, "page_id", "left").withColumn("_new", F.when(F.col("_c").isNull(), F.col("section_hint")).otherwise(F.col("_c.section")))
    changed = joined.where(~F.col("_new").eqNullSafe(F.col("section_hint"))).select("document_id").distinct()
    return joined.withColumn("section_hint", F.col("_new")).select(*pages.columns), changed


def status_history(events: DataFrame, bucket_size: int = SEQ_BLOCK) -> DataFrame:
    """Status changes with the time until the next one."""
    changes = events.where("type = 'STATUS_CHANGED'").select(
        "document_id", "id", "actor", "at", F.get_json_object("detail", "$.from").alias("from_status"), F.get_json_object("detail", "$.to").alias("to_status"))
    near = neighbour(changes, ["document_id"], ["id"], block("id", bucket_size), ["at"], "_next", following=True)
    return near.withColumn("seconds", F.unix_seconds(F.col("_next.at").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))).drop("_next")


def status_as_of(events: DataFrame, until: Column | None = None) -> DataFrame:
    """The last status of each document, and the detail of its failure when it failed."""
    changes = events.where("type = 'STATUS_CHANGED'")
    changes = changes if until is None else changes.where(F.col("at") <= until)
    last = changes.groupBy("document_id").agg(F.max_by(F.struct(
        F.get_json_object("detail", "$.to").alias("status"), F.col("at"), F.col("detail")), "id").alias("l"))
    return last.select("document_id", "l.status", "l.at", F.when(F.col("l.status") == "PROCESSING_FAILED", F.col("l.detail")).alias("failure_detail"))


def queue_hint(status: Column, pending_retakes: Column) -> tuple[Column, Column]:
    """(hint code, whether a person has to act)."""
    waiting = (pending_retakes > 0) & (status != "REGISTERED")
    code = (F.when(waiting, "WAITING_RETAKE").when(status == "CAPTURED", "COLLECTING").when(status == "PENDING_AI", "WAITING_AI")
            .when(status == "PROCESSING_FAILED", "RETAKE_OR_MANUAL").when(status.isin("AI_PROCESSED", "NEEDS_REVIEW"), "CHECK_FIELDS")
            .when(status == "VALIDATED", "CHOOSE_PATIENT").when(status == "DUPLICATE_SUSPECTED", "DECIDE_DUPLICATE")
            .when(status == "PATIENT_MATCHED", "CONFIRM").when(status == "REGISTERED", "REGISTERED").otherwise(status))
    acts = ~waiting & status.isin("PROCESSING_FAILED", "AI_PROCESSED", "NEEDS_REVIEW", "VALIDATED", "DUPLICATE_SUSPECTED", "PATIENT_MATCHED")
    return code, acts


def queue_view(documents: DataFrame, senders: DataFrame, pages: DataFrame, retakes: DataFrame, blocking: DataFrame, visits: DataFrame) -> DataFrame:
    """One row per document with its counts and hint; sort by document id descending where it is shown."""
    count = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    out = salted_join(documents, senders.select("sender_id", F.col("label").alias("sender_label")), ["sender_id"], "inner", ["document_id"])
    for frame, name in ((active_pages(pages), "page_count"), (retakes.where("status = 'PENDING'"), "pending_retakes"),
                        (blocking, "blocking_count"), (visits, "encounter_count")):
        out = out.join(count(frame, name), "document_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    hint, acts = queue_hint(F.col("status"), F.col("pending_retakes"))
    return out.withColumns({"hint": hint, "action": acts})


def document_view(documents: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Everything about each document as rows (document_id, part, sort_key, item JSON).

    Each part is (rows with document_id, columns that order it). The parts stay rows: a document's events have no bound.
    """
    out = documents.select("document_id", F.lit("header").alias("part"), F.lit("").alias("sort_key"),
                           F.to_json(F.struct(*[c for c in documents.columns if c != "document_id"])).alias("item"))
    for name, (frame, order) in parts.items():
        rest = [c for c in frame.columns if c != "document_id"]
        key = F.concat_ws("|", *[F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 20, "0") for c in order])
        out = out.unionByName(frame.select("document_id", F.lit(name).alias("part"), key.alias("sort_key"), F.to_json(F.struct(*rest)).alias("item")))
    return out


def alerts(pages: DataFrame, fields: DataFrame, show: int = 8) -> DataFrame:
    """The first alerts of each document in order, with the total. The list shown is a top-k by design."""
    page = F.col("page_no").cast("long")
    supported = [s for s, _l in C.PAGE_SECTIONS if s != "postpartum"]
    kinds = F.array_compact(F.array(
        F.when(F.col("review_reason").isNotNull(), F.struct(F.lit("warn").alias("tone"), F.col("review_reason").alias("code")))
        .when(~F.coalesce("grid_found", F.lit(True)), F.struct(F.lit("warn").alias("tone"), F.lit("GRID_NOT_FOUND").alias("code")))
        .when(~F.col("section").isin([*supported, "unknown"]), F.struct(F.lit("info").alias("tone"), F.lit("SECTION_UNSUPPORTED").alias("code")))))
    notes = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.struct(F.lit("info").alias("tone"), w.alias("code")))
    from_pages = pages.select("document_id", page.alias("o1"), F.posexplode(F.concat(kinds, notes)).alias("o2", "a")).select(
        "document_id", F.lit(0).alias("o0"), F.col("o1").cast("string").alias("o1"), F.col("o2").cast("long").alias("o2"), "a.tone", "a.code", F.lit(None).cast("string").alias("field"))
    first = lambda names: F.try_element_at(F.filter("validation_flags", lambda f: f.isin(names)), F.lit(1))
    conflict, odd = first(C.CONFLICT_FLAGS), first(C.CONSISTENCY_FLAGS)
    from_fields = fields.where("verification_state = 'UNVERIFIED'").withColumns({"_c": conflict, "_o": odd}).where("_c IS NOT NULL OR _o IS NOT NULL").select(
        "document_id", F.lit(1).alias("o0"), F.col("review_order").cast("string").alias("o1"), F.lit(0).cast("long").alias("o2"),
        F.when(F.col("_c").isNotNull(), "warn").otherwise("info").alias("tone"), F.coalesce("_c", "_o").alias("code"), "field")
    rows = from_pages.withColumn("o1", F.lpad("o1", 20, "0")).unionByName(from_fields)
    totals = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"))
    # The rank limit is applied inside each task before the shuffle, so a document with many alerts stays small.
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy("document_id").orderBy("o0", "o1", "o2", "code"))).where(F.col("position") <= show)
    return ranked.join(totals, "document_id").select("document_id", "position", "tone", "code", "field", "total")


def group_counts(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the fields to settle, read but unverified, and done."""
    todo = (F.col("verification_state") == "UNVERIFIED") & F.col("field_status").isin("NEEDS_REVIEW", "ILLEGIBLE")
    unread = (F.col("verification_state") == "UNVERIFIED") & (F.col("field_status") == "KNOWN")
    return fields.groupBy(*keys).agg(F.count_if(todo).alias("todo"), F.count_if(unread).alias("unverified"), F.count_if(~todo & ~unread).alias("done"))


def visit_grid(fields: DataFrame, value: Column, slots: list[str] = C.GRID_SLOTS) -> DataFrame:
    """Field x slot table of a document; the slots are a closed list, so no values have to be collected for the pivot."""
    return fields.groupBy("document_id", "field").pivot("slot", slots).agg(F.max(value))
