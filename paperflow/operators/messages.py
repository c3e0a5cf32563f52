"""The message stream, delivery status and grouping of pages into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import catalog as C
from ..functions.text import backoff_seconds, sender_id
from ..scale import block, first_by, neighbour, numbered, running_count, salted_join, time_bucket


# ------------------------------------------------------------------ webhooks

def _changes(envelopes: DataFrame) -> DataFrame:
    ours = F.col("envelope.object") == "whatsapp_business_account"
    rest = [c for c in envelopes.columns if c != "envelope"]
    entries = envelopes.select(*rest, ours.alias("_known"), F.explode_outer(
        F.when(ours, F.col("envelope.entry"))).alias("_entry"))
    return entries.select(*rest, "_known", F.explode_outer("_entry.changes").alias("_change"))


def explode_webhooks(envelopes: DataFrame, phone_number_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1: (messages, statuses, skipped changes) of parsed envelopes; only `messages` changes of our own number count."""
    rest = [c for c in envelopes.columns if c != "envelope"]
    changes = _changes(envelopes)
    mine = F.coalesce((F.col("_change.field") == "messages")
                      & (F.col("_change.value.metadata.phone_number_id") == phone_number_id), F.lit(False))
    accepted = changes.where(mine)
    # An envelope of another kind counts one skipped change; one without entries counts none.
    skipped = changes.where(~mine & (~F.coalesce("_known", F.lit(False)) | F.col("_change").isNotNull())).select(*rest)

    m = F.col("_m")
    is_image = (F.substring(F.coalesce(m["type"], F.lit("unknown")), 1, 40) == "image") & m["image"]["id"].isNotNull()
    messages = (accepted.select(*rest, F.explode("_change.value.messages").alias("_m"))
                .where(m["id"].isNotNull() & m["from"].isNotNull())
                .select(*rest, F.substring(m["id"], 1, 200).alias("wa_message_id"),
                        F.substring(F.coalesce(m["type"], F.lit("unknown")), 1, 40).alias("message_type"),
                        m["from"].alias("phone"), F.when(is_image, m["image"]["id"]).alias("media_id"),
                        F.when(is_image, m["image"]["mime_type"]).alias("mime_type"),
                        F.when(is_image, m["image"]["sha256"]).alias("media_sha256"),
                        F.substring(m["context"]["id"], 1, 200).alias("context_message_id"),
                        F.timestamp_seconds(m["timestamp"].try_cast("long")).alias("sent_at"),
                        F.try_element_at(m["errors"], F.lit(1))["code"].try_cast("long").cast("string").alias("error_code")))
    s = F.col("_s")
    statuses = (accepted.select(*rest, F.explode("_change.value.statuses").alias("_s"))
                .where(s["id"].isNotNull() & s["status"].isNotNull())
                .select(*rest, s["id"].alias("wa_message_id"), F.upper(s["status"]).alias("status"),
                        F.try_element_at(s["errors"], F.lit(1))["code"].try_cast("long").alias("error_code")))
    return messages, statuses, skipped


def classify_inbound(messages: DataFrame, known: DataFrame, senders: DataFrame, order: list[str]) -> DataFrame:
    """M2: one row per message id with its status and `copies`, the number of deliveries in this batch.

    `known` holds the message ids already stored. The first delivery is picked by an aggregate, so a message repeated
    millions of times costs one row per task.
    """
    rest = [c for c in messages.columns if c != "wa_message_id"]
    unique = messages.groupBy("wa_message_id").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_m"), F.count(F.lit(1)).alias("copies"))
    rows = unique.select("wa_message_id", "_m.*", "copies").withColumn("sender_id", sender_id(F.col("phone"))).drop("phone")
    # Known ids grow with the history, so they are merged with the rows, which are grouped by id already.
    seen = known.select("wa_message_id").distinct().withColumn("_seen", F.lit(True)).hint("merge")
    enrolled = senders.where("channel = 'WHATSAPP'").select("sender_id", F.lit(True).alias("_enrolled"))
    joined = salted_join(rows.join(seen, "wa_message_id", "left"), enrolled, ["sender_id"], "left", ["wa_message_id"])
    status = (F.when(F.col("_seen"), "DUPLICATE").when(F.col("_enrolled").isNull(), "REJECTED")
              .when((F.col("message_type") != "image") | F.col("media_id").isNull(), "IGNORED").otherwise("PENDING"))
    marked = joined.withColumn("status", status)
    pending = F.col("status") == "PENDING"
    hidden = {c: F.when(pending, F.col(c)) for c in ("media_id", "mime_type", "media_sha256", "context_message_id")
              if c in marked.columns}
    return (marked.withColumns(hidden).withColumn("sender_id", F.when(F.col("status") != "REJECTED", F.col("sender_id")))
            .drop("_seen", "_enrolled"))


def inbound_rows(classified: DataFrame) -> DataFrame:
    """The rows that are stored: everything that is not a duplicate."""
    return classified.where("status <> 'DUPLICATE'").drop("copies")


def webhook_summary(classified: DataFrame, keys: list[str]) -> DataFrame:
    """M3: queued, ignored, rejected and duplicate messages per batch."""
    def n(status):
        return F.count_if(F.col("status") == status)
    return classified.groupBy(*keys).agg(
        n("PENDING").alias("queued"), n("IGNORED").alias("ignored"), n("REJECTED").alias("rejected"),
        F.sum(F.when(F.col("status") == "DUPLICATE", F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicates"))


# ------------------------------------------------------------------ jobs and delivery

def retry_schedule(failures: DataFrame, now: Column, transient: str = "transient", attempts: str = "attempts",
                   limit: int = C.MAX_ATTEMPTS) -> DataFrame:
    """M7: state after one more failed attempt, the wait before the next, and whether the sender must be told."""
    tries = F.col(attempts) + 1
    again = F.col(transient) & (tries < limit)
    wait = backoff_seconds(tries)
    return failures.withColumns({
        "status": F.when(again, "PENDING").otherwise("FAILED"), attempts: tries,
        "wait_seconds": F.when(again, wait),
        "next_attempt_at": F.when(again, F.timestamp_seconds(F.unix_micros(now.cast("timestamp")) / 1e6 + wait)),
        "notify": ~again})


def due_jobs(jobs: DataFrame, now: Column, limit: int, order: list[Column], held: bool = False) -> DataFrame:
    """M8: the next `limit` pending jobs; a top-k, so no full sort."""
    due = jobs.where((F.col("status") == "PENDING") & (F.col("next_attempt_at") <= now))
    return due.where(F.lit(False)) if held else due.orderBy(*order).limit(limit)


RANK = {"SENT": 1, "DELIVERED": 2, "READ": 3}


def _rank(status: Column) -> Column:
    chain = None
    for name, rank in RANK.items():
        chain = F.when(status == name, rank) if chain is None else chain.when(status == name, rank)
    return chain.otherwise(0)


def delivery_state(events: DataFrame) -> DataFrame:
    """M9: what the fold needs of the status events of each message. Built-in aggregates, for a table and for a stream."""
    failed, rank = F.col("status") == "FAILED", _rank(F.col("status"))
    return events.groupBy("wa_message_id").agg(
        F.min(F.when(failed, F.struct("seq", "error_code", "at"))).alias("_fail"),
        F.min(F.when(rank >= 2, F.col("seq"))).alias("_arrived"),
        F.max(rank).alias("_rank"),
        F.min(F.when(rank > 0, F.struct((-rank).alias("r"), F.col("seq"), F.col("at")))).alias("_best"))


def fold_delivery(events: DataFrame, outbound: DataFrame) -> DataFrame:
    """M9: the state of each outbound message after its status events, in `seq` order.

    The rules have a closed form, so no event list is gathered: a FAILED that comes before any DELIVERED or READ ends
    the message (a transient code with attempts left re-queues it and frees its id, so later events of that id find
    nothing); otherwise failures are ignored and the highest rank wins.
    """
    return judge_delivery(delivery_state(events), outbound)


def judge_delivery(state: DataFrame, outbound: DataFrame, how: str = "left") -> DataFrame:
    """M9: outbound messages (with the attempts made so far) after the events summed up in `state`."""
    joined = outbound.withColumnRenamed("wa_message_id", "_id").join(
        state, F.col("_id") == F.col("wa_message_id"), how).drop("wa_message_id")
    start = _rank(F.col("status"))
    ends = (F.col("_fail").isNotNull() & (start < 2)
            & (F.col("_arrived").isNull() | (F.col("_fail.seq") < F.col("_arrived"))))
    open_ = F.col("status") != "FAILED"
    transient = F.col("_fail.error_code").isin(C.TRANSIENT_CODES) & (F.col("attempts") < C.MAX_ATTEMPTS)
    requeue = F.coalesce(open_ & ends & transient, F.lit(False))
    dead = F.coalesce(open_ & ends & ~F.coalesce(transient, F.lit(False)), F.lit(False))
    higher = F.coalesce(open_ & ~ends & (F.col("_rank") > start), F.lit(False))
    rank_name = F.element_at(F.array(*[F.lit(n) for n in RANK]), F.greatest(F.col("_rank"), F.lit(1)))
    code = F.concat(F.lit("STATUS_FAILED_"), F.coalesce(F.col("_fail.error_code").cast("string"), F.lit("None")))
    wait = backoff_seconds(F.col("attempts"))
    changed_at = F.when(requeue | dead, F.col("_fail.at")).when(higher, F.col("_best.at"))
    return joined.select(
        "message_id", F.when(~requeue, F.col("_id")).alias("wa_message_id"),
        F.when(requeue, "PENDING").when(dead, "FAILED").when(higher, rank_name).otherwise(F.col("status")).alias("status"),
        "attempts", F.when(requeue | dead, code).otherwise(F.col("last_error")).alias("last_error"),
        F.when(requeue, F.timestamp_seconds(F.unix_seconds("_fail.at") + wait)).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.coalesce(changed_at, F.col("updated_at")).alias("updated_at"))


def map_replies(inbound: DataFrame, outbound: DataFrame, retakes: DataFrame) -> DataFrame:
    """The pending retake a photo answers, through the message it quotes; null for an ordinary page."""
    pending = retakes.where("status = 'PENDING'").select("request_id", "request_message_id")
    asked = outbound.join(pending, outbound["message_id"] == pending["request_message_id"], "inner").select(
        F.col("wa_message_id").alias("_quoted"), F.col("request_id").alias("retake_request_id"))
    return inbound.join(asked, inbound["context_message_id"] == F.col("_quoted"), "left").drop("_quoted")


def outbound_queue(messages: DataFrame, senders: DataFrame, retakes: DataFrame, pages: DataFrame) -> DataFrame:
    """OUT messages of WHATSAPP senders; a retake request quotes the message of the photo it is about."""
    channel = senders.where("channel = 'WHATSAPP'").select("sender_id")
    out = salted_join(messages.where("direction = 'OUT'").select("id", "sender_id", "body"), channel, ["sender_id"], "inner", ["id"])
    quoted = retakes.join(pages.select("page_id", "source_message_id"), "page_id").select(
        F.col("request_message_id").alias("id"), F.col("source_message_id").alias("quoted"))
    return out.join(quoted, "id", "left").select(F.col("id").alias("message_id"), "sender_id", "body", "quoted",
                                                 F.lit("PENDING").alias("status"))


def discard_held(outbound: DataFrame) -> DataFrame:
    """Nothing that was held is ever sent."""
    held = F.col("status") == "PENDING"
    return outbound.withColumns({"last_error": F.when(held, "DISCARDED_HELD").otherwise(F.col("last_error")),
                                 "status": F.when(held, "FAILED").otherwise(F.col("status"))})


# ------------------------------------------------------------------ grouping

def dedup_messages(messages: DataFrame, seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First delivery of each id that is not stored yet."""
    return first_by(messages, [key], order).join(seen.select(key).distinct().hint("merge"), key, "left_anti")


def group_pages(pages: DataFrame, window_seconds: float = C.GROUP_WINDOW_SECONDS, sender: str = "sender_id",
                at: str = "received_at", key: str = "page_id", bucket_seconds: int = 3600) -> DataFrame:
    """Number the documents of each sender: a gap above the window to the page before starts a new one.

    Only ordinary pages take part; pass pages without a group id or a retake id. A busy sender is cut into time buckets
    (one hour by default), and only the bucket edges are compared across them.
    """
    order = [at, key]
    bucket = time_bucket(at, bucket_seconds)
    near = neighbour(pages, [sender], order, bucket, [at], "_before")
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_before")[at].cast("timestamp"))) / 1e6
    starts = near.withColumn("_starts", F.when(F.col("_before").isNull() | (gap > window_seconds), 1).otherwise(0)).drop("_before")
    return running_count(starts, [sender], order, bucket, F.col("_starts"), "document_no").drop("_starts")


def documents_of_groups(grouped: DataFrame, sender: str = "sender_id", at: str = "received_at") -> DataFrame:
    return grouped.groupBy(sender, "document_no").agg(
        F.count(F.lit(1)).alias("page_count"), F.min(at).alias("created_at"), F.max(at).alias("last_page_at"))


def group_explicit(pages: DataFrame, closures: DataFrame, at: str = "received_at") -> DataFrame:
    """Pages that carry a group id: one document per (group, sender); after its closure a page is refused."""
    joined = pages.join(closures.select("group_id", "sender_id", "closed_at"), ["group_id", "sender_id"], "left")
    return joined.withColumn("reject_reason", F.when(F.col(at) > F.col("closed_at"), "GROUP_CLOSED")).drop("closed_at")


def close_windows(documents: DataFrame, now: Column, window_seconds: float = C.GROUP_WINDOW_SECONDS) -> DataFrame:
    """A collecting document without an explicit group closes once its last page is older than the window."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_page_at").cast("timestamp"))
    closes = (F.col("status") == "CAPTURED") & ~F.col("explicit_group") & (age > window_seconds * 1e6)
    return documents.withColumn("status", F.when(closes, "PENDING_AI").otherwise(F.col("status")))


def waiting_documents(documents: DataFrame, extraction_on: bool = True) -> DataFrame:
    waiting = documents.where("status = 'PENDING_AI'").select("document_id")
    return waiting if extraction_on else waiting.where(F.lit(False))


def number_pages(pages: DataFrame, order: list[str], bucket: Column | None = None) -> DataFrame:
    """Positions 1..n of the active pages of each document; `bucket` must grow with the order. By default it is an hour
    of the first order column if that is a time, and a range of it if it is a number; of other types a document is one bucket."""
    active = pages.where(F.col("replaced_by").isNull())
    if bucket is None:
        kind = pages.schema[order[0]].dataType
        bucket = (time_bucket(order[0], 3600) if kind.typeName().startswith("timestamp") else block(order[0], 4096) if isinstance(kind, NumericType)
                  else F.lit(0).cast("long"))
    return numbered(active, ["document_id"], order, bucket, "position")


def acknowledge(pages: DataFrame) -> DataFrame:
    """The text sent back for each new page or replacement; nothing for a duplicate."""
    again = F.col("replaces").isNotNull()
    body = F.when(again, F.format_string("Reçu : nouvelle photo de la page %d. Merci, le traitement est en cours.", "position")
                  ).otherwise(F.format_string("Reçu : page %d. Merci, le traitement est en cours.", "position"))
    return pages.where(~F.col("duplicate")).select(
        "sender_id", F.lit("OUT").alias("direction"), body.alias("body"), F.col("received_at").alias("created_at"))


def thread(messages: DataFrame, retakes: DataFrame) -> DataFrame:
    """Messages with the retake they announce. Sort or filter by sender at the end that reads it."""
    asked = retakes.select(F.col("request_message_id").alias("id"), F.col("request_id").alias("retake_request_id"),
                           F.col("status").alias("retake_status"))
    return messages.join(asked, "id", "left")


def enroll(requests: DataFrame, senders: DataFrame, facilities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(senders to upsert, refused requests with a reason, facilities to add)."""
    held = senders.select("sender_id", F.col("facility_id").alias("_held"))
    size = lambda c: F.length(F.trim(c)).between(1, 100)
    checked = requests.join(held, "sender_id", "left").withColumn("reason", (
        F.when(~F.col("channel").isin(C.CHANNELS), "INVALID_CHANNEL")
        .when(~(size("sender_id") & size("facility_id") & size("label")), "INVALID_FIELD")
        .when(F.col("_held").isNotNull() & (F.col("_held") != F.col("facility_id")), "SENDER_MOVED")))
    accepted = checked.where("reason IS NULL").select("sender_id", "facility_id", F.trim("label").alias("label"), "channel")
    added = accepted.select("facility_id").distinct().join(facilities, "facility_id", "left_anti")
    return accepted, checked.where("reason IS NOT NULL").select("sender_id", "facility_id", "reason"), added


def delivery_overview(outbound: DataFrame, messages: DataFrame, senders: DataFrame, inbound: DataFrame,
                      limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The newest outbound rows with their labels, and the newest inbound rows. The limit is taken before the joins."""
    newest = outbound.join(senders.select("sender_id"), "sender_id", "left_semi").orderBy(F.desc("message_id")).limit(limit)
    labelled = (newest.join(messages.select(F.col("id").alias("message_id"), "body"), "message_id")
                .join(senders.select("sender_id", F.col("label").alias("sender_label")), "sender_id"))
    return labelled, inbound.orderBy(F.desc("inbound_id")).limit(limit)
