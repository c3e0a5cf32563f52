"""S1-S3, S5, S6, the sinks of S7 and S8 and the streaming forms of M9, M13, M14, M16: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import messages as M
from ..scale import shared_folder
from ..sources import files as S
from ..streaming import history as H
from ..streaming import streams as T
from ..streaming import windows as W
from ..streaming.epochs import latest, read_epochs, write_epoch
from . import export, messages
from .registry import ORACLE, Tables, query


def fresh(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_s6_registry_csv", ORACLE["e9_export_rows"])
def registry_csv(t):
    folder = fresh(t, "registry")
    S.write_registry_csv(export.export(t), folder)
    return S.read_registry(t.spark, folder)


@query("s2_read_drafts", """SELECT doc_id, CASE WHEN source = 'src1' THEN 'MALFORMED' ELSE 'draft' END AS kind FROM documents""")
def read_drafts(t):
    # Documents as drafts with their text as notes; those of one source are cut off in the middle.
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.lit("1.0").alias("schema_version"), F.col("text").alias("notes")))
    cut = F.concat(F.lit('{"document_id": "'), F.col("doc_id").cast("string"), F.lit('", "notes": ['))
    folder = fresh(t, "drafts")
    t.documents.select(F.when(F.col("source") == "src1", cut).otherwise(whole).alias("value")).write.text(folder)
    drafts, rejected = S.read_drafts(t.spark, folder)
    number = F.regexp_extract("text", r'"document_id": "([0-9]+)"', 1)
    return drafts.select(F.col("document_id").cast("long").alias("doc_id"), F.lit("draft").alias("kind")).unionByName(
        rejected.select(number.cast("long").alias("doc_id"), F.col("error").alias("kind")))


@query("s3_read_webhooks", ORACLE["m1_explode_webhooks"])
def read_webhooks(t):
    body = messages.envelopes(t).select(F.to_json(F.struct("event_id", F.col("envelope.object").alias("object"), F.col("envelope.entry").alias("entry"))).alias("value"))
    folder = fresh(t, "webhooks")
    body.write.text(folder)
    calls = S.read_webhooks(t.spark, folder).select("envelope", F.get_json_object("value", "$.event_id").alias("event_id"))
    found, statuses, skipped = M.explode_webhooks(calls, "ours")
    call, empty = F.col("event_id").alias("call"), F.lit("")
    return (found.select(F.lit("message").alias("part"), call, "wa_message_id", F.col("message_type").alias("kind"), F.coalesce("media_id", empty).alias("detail"), F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"))
            .unionByName(statuses.select(F.lit("status").alias("part"), call, "wa_message_id", F.col("status").alias("kind"), F.col("error_code").cast("string").alias("detail"), empty.alias("sent_at")))
            .unionByName(skipped.select(F.lit("skipped").alias("part"), call, empty.alias("wa_message_id"), empty.alias("kind"), empty.alias("detail"), empty.alias("sent_at"))))


@query("s5_state_tables", """SELECT 'patients' AS name, CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS detail FROM customer UNION ALL SELECT 'pages', CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m-%d') FROM events""")
def state_tables(t):
    folder = fresh(t, "state")
    null = F.lit(None)
    people = t.customer.select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("facility_id"), null.alias("registry_file_number"), F.col("c_name").alias("midwife_patient_code"), F.array().alias("flags"),
                               null.alias("created_at"), null.alias("created_by"))
    pages = t.events.select(F.col("event_id").alias("page_id"), F.col("user_id").alias("document_id"), null.alias("source_message_id"), F.col("user_id").alias("sender_id"), null.alias("media_ref"), null.alias("media_sha256"), F.lit(1).alias("position"),
                            F.col("ts").alias("received_at"), null.alias("replaced_by"), null.alias("section_hint"))
    S.write_state(people, folder, "patients")
    S.write_state(pages, folder, "pages")
    return S.read_state(t.spark, folder, "patients").select(F.lit("patients").alias("name"), F.col("patient_id").alias("id"), F.col("facility_id").alias("detail")).unionByName(
        S.read_state(t.spark, folder, "pages").select(F.lit("pages").alias("name"), F.col("page_id").alias("id"), F.date_format("received_at", "yyyy-MM-dd").alias("detail")))


# ------------------------------------------------------------------ streams

SLICES = 5


def event_stream(t: Tables, slices: int = SLICES, order: str = "event_id") -> DataFrame:
    """All events as files that came one after the other in the given order, read one slice to a micro-batch."""
    folder, place = fresh(t, "arrivals"), F.expr(order)
    files = max(1, t.events.count() // slices // 5_000_000)
    least, most = t.events.agg(F.coalesce(F.min(place), F.lit(0)), F.coalesce(F.max(place), F.lit(0))).first()
    number = (place - least) * slices / (most - least + 1)
    for k in range(slices):
        t.events.where(F.floor(number) == k).repartition(files).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", files).parquet(folder)


def streamed(t: Tables) -> Tables:
    """The tables with events as a stream."""
    out = Tables(t.spark, t.folder)
    out.events = event_stream(t)
    return out


@query("m9_fold_delivery_stream", ORACLE["m9_fold_delivery"])
def delivery_stream(t):
    target = fresh(t, "delivery")
    T.delivery_stream(messages.delivery_events(streamed(t)), messages.outbound_messages(t), target, fresh(t, "delivery-checkpoint")).awaitTermination()
    return T.delivered_messages(t.spark, target).select("message_id", "status", F.coalesce("last_error", F.lit("")).alias("last_error"),
                                                        F.coalesce("wa_message_id", F.lit("")).alias("wa_message_id"))


@query("m13_dedup_messages_stream", f"SELECT user_id || '-' || {messages.KIND.format('BIGINT')} AS message_id, MIN(event_id) AS event_id FROM events GROUP BY 1")
def dedup_stream(t):
    rows = event_stream(t).select(F.expr(f"user_id || '-' || {messages.KIND.format('BIGINT')}").alias("message_id"), "event_id", F.col("ts").cast("timestamp").alias("at"))
    history = H.MessageHistory(fresh(t, "messages"), "message_id", "message_id string, event_id long, at timestamp")
    H.dedup_stream(rows, history, ["at", "event_id"], fresh(t, "messages-checkpoint")).awaitTermination()
    return history.read(t.spark).select("message_id", "event_id")


@query("m14_group_pages_stream", f"""WITH {messages.GROUPS_SQL}, d AS (SELECT user_id, document_no, COUNT(*) AS page_count, MIN(ts) AS created, MAX(ts) AS last FROM grouped GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS sender_id, page_count, strftime(created, '%Y-%m-%d %H:%M:%S') AS created_at,
 CASE WHEN epoch_us(last) // 1000 + {messages.GAP * 1000} < (SELECT MAX(epoch_us(ts)) // 1000 FROM events) - 60000 THEN 'PENDING_AI' ELSE 'CAPTURED' END AS status FROM d""")
def group_stream(t):
    # Pages come in the order of their times, whatever their ids: none is late.
    pages = event_stream(t, order="unix_micros(cast(ts AS timestamp))").select(F.col("user_id").alias("sender_id"), F.col("ts").cast("timestamp").alias("received_at"))
    target = fresh(t, "groups")
    changes = W.document_changes(pages, messages.GAP)
    (changes.writeStream.outputMode("update").option("checkpointLocation", fresh(t, "groups-checkpoint")).trigger(availableNow=True)
     .foreachBatch(lambda batch, epoch: write_epoch(batch, target, epoch)).start().awaitTermination())
    return W.documents(read_epochs(t.spark, target, W.CHANGE)).select(
        "sender_id", "page_count", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "status")


#: Orders to one file of arrivals.
ARRIVALS_PER_FILE = 250_000


@query("s7_sync_log", ORACLE["s7_sync_registered"])
def sync_log(t):
    """Documents become registered one slice after the other; each is sent in its micro-batch."""
    documents, visits, send = messages.sync_tables(t)
    folder, log = fresh(t, "registered"), fresh(t, "sync-log")
    # Each slice is written and read in as many tasks as its size asks for.
    files = max(1, t.orders.count() // 2 // ARRIVALS_PER_FILE)
    for k in range(2):
        documents.where("status = 'REGISTERED'").where(F.pmod(F.xxhash64("document_id"), F.lit(2)) == k).select("document_id").repartition(files, "document_id").write.mode("append").parquet(folder)
    arrivals = t.spark.readStream.schema("document_id string").option("maxFilesPerTrigger", files).parquet(folder)
    T.sync_stream(arrivals, documents, visits, log, fresh(t, "sync-checkpoint"), send).awaitTermination()
    last = latest(T.read_sync_log(t.spark, log), ["document_id"])
    return last.select(F.col("document_id").cast("long").alias("document_id"), "status", F.coalesce("ack_id", F.lit("")).alias("ack_id"))


@query("s8_flush_outbox", """
WITH i AS (SELECT event_id AS id, user_id, event_type = 'error' AS bad FROM events),
f AS (SELECT *, MIN(CASE WHEN bad THEN id END) OVER (PARTITION BY user_id) AS first_bad FROM i),
r AS (SELECT *, CASE WHEN first_bad IS NULL OR id < first_bad THEN 1 ELSE 2 END AS run FROM f),
g AS (SELECT user_id, id // 50 AS part, MAX(run) AS closed FROM r GROUP BY 1, 2)
SELECT CAST(id AS VARCHAR) AS id, 'SYNCED' AS state, CAST(CASE WHEN id = first_bad THEN 2 ELSE 1 END AS BIGINT) AS attempts, 'P' || id AS page_id, closed AS group_closed_in
FROM r JOIN g ON g.user_id = r.user_id AND g.part = r.id // 50""")
def flush_outbox(t):
    """Two runs over all events as items of their users: in the first an error is not acknowledged."""
    items = t.events.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("sender_id"), F.col("event_id").alias("seq"),
                            F.expr("concat(user_id, '-', event_id div 50)").alias("group_id"), F.col("event_type").alias("payload"))
    log, closings = fresh(t, "outbox-log"), fresh(t, "closings")
    for run in (1, 2):
        first = run == 1

        def send(item, payload, first=first):
            return {} if first and payload == "error" else {"page_id": f"P{item}", "document_id": f"D{int(item) // 50}"}

        T.flush_outbox(items, log, run, send)
        T.close_groups(items, log, closings, run, lambda document: {"ok": True})
    closed = read_epochs(t.spark, closings, T.CLOSING).where("ok").groupBy("group_id").agg(F.min("epoch").cast("int").alias("group_closed_in"))
    return T.item_states(items, log).join(closed, "group_id", "left").select("id", "state", "attempts", "page_id", "group_closed_in")
