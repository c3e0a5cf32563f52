"""M1-M21, S7, S8 and S10 on events, conversations, customers, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest_matches, mask_sender, sender_id
from ..operators import messages as M
from ..operators.words import words_to_lines
from ..sources.files import parse_webhooks
from ..streaming import streams as S
from .registry import Tables, query

PHONE = "'+212 (' || LPAD(CAST({0} AS {1}), 9, '0') || ')'"
KIND = "CAST(regexp_extract(props, '([0-9]+)', 1) AS {0})"


def senders(t: Tables) -> DataFrame:
    """Customers as enrolled phones; one market segment uses the simulator channel."""
    return t.customer.select(
        sender_id(F.expr(PHONE.format("c_custkey", "STRING"))).alias("sender_id"), F.col("c_nationkey").cast("string").alias("facility_id"),
        F.col("c_name").alias("label"), F.when(F.col("c_mktsegment") == "MACHINERY", "SIMULATOR").otherwise("WHATSAPP").alias("channel"))


SENDERS_SQL = """senders AS (SELECT 'whatsapp:+212' || LPAD(CAST(c_custkey AS VARCHAR), 9, '0') AS sender_id,
  CAST(c_nationkey AS VARCHAR) AS facility_id, c_name AS label,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'SIMULATOR' ELSE 'WHATSAPP' END AS channel FROM customer)"""


def inbound(t: Tables) -> DataFrame:
    """Events as messages; every id is delivered twice."""
    return t.events.select(
        F.concat(F.lit("wamid."), F.expr("event_id div 2")).alias("wa_message_id"), F.col("event_id"), F.col("ts").alias("received_at"),
        F.expr(PHONE.format("user_id", "STRING")).alias("phone"), F.when(F.col("event_type") == "view", "image").otherwise(F.col("event_type")).alias("message_type"),
        F.when(F.col("event_type") == "view", F.expr("concat('m', event_id)")).alias("media_id"))


def envelopes(t: Tables) -> DataFrame:
    """Each event as the JSON of one webhook call: views are photos, errors are failed statuses, purchases go to another number."""
    number = F.when(F.col("event_type") == "purchase", "other").otherwise("ours")
    message = F.struct(F.concat(F.lit("wamid."), F.col("event_id")).alias("id"), F.col("user_id").cast("string").alias("from"),
                       F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
                       F.when(F.col("event_type") == "view", "image").otherwise("text").alias("type"),
                       F.when(F.col("event_type") == "view", F.struct(F.concat(F.lit("m"), F.col("event_id")).alias("id"), F.lit("image/jpeg").alias("mime_type"))).alias("image"))
    status = F.struct(F.concat(F.lit("wamid."), F.col("event_id")).alias("id"), F.lit("failed").alias("status"),
                      F.array(F.struct(F.lit(131047).alias("code"))).alias("errors"))
    is_error = F.col("event_type") == "error"
    value = F.struct(F.struct(number.alias("phone_number_id")).alias("metadata"), F.when(~is_error, F.array(message)).alias("messages"),
                     F.when(is_error, F.array(status)).alias("statuses"))
    change = F.struct(F.when(F.col("event_type") == "signup", "account").otherwise("messages").alias("field"), value.alias("value"))
    body = F.struct(F.lit("whatsapp_business_account").alias("object"), F.array(F.struct(F.lit("e").alias("id"), F.array(change).alias("changes"))).alias("entry"))
    return parse_webhooks(t.events.select("event_id", F.to_json(body).alias("value")), "value").drop("value")


@query("m1_explode_webhooks", """
SELECT 'message' AS part, CAST(event_id AS VARCHAR) AS call, 'wamid.' || event_id AS wa_message_id,
       CASE WHEN event_type = 'view' THEN 'image' ELSE 'text' END AS kind,
       CASE WHEN event_type = 'view' THEN 'm' || event_id ELSE '' END AS detail,
       strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS sent_at
FROM events WHERE event_type IN ('view', 'click')
UNION ALL SELECT 'status', CAST(event_id AS VARCHAR), 'wamid.' || event_id, 'FAILED', '131047', '' FROM events WHERE event_type = 'error'
UNION ALL SELECT 'skipped', CAST(event_id AS VARCHAR), '', '', '', '' FROM events WHERE event_type IN ('purchase', 'signup')""")
def explode_webhooks(t):
    messages, statuses, skipped = M.explode_webhooks(envelopes(t), "ours")
    call, empty = F.col("event_id").cast("string").alias("call"), F.lit("")
    return (messages.select(F.lit("message").alias("part"), call, "wa_message_id", F.col("message_type").alias("kind"),
                            F.coalesce("media_id", empty).alias("detail"), F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"))
            .unionByName(statuses.select(F.lit("status").alias("part"), call, "wa_message_id", F.col("status").alias("kind"),
                                         F.col("error_code").cast("string").alias("detail"), empty.alias("sent_at")))
            .unionByName(skipped.select(F.lit("skipped").alias("part"), call, empty.alias("wa_message_id"), empty.alias("kind"), empty.alias("detail"), empty.alias("sent_at"))))


CLASSIFIED_SQL = f"""WITH {SENDERS_SQL},
msg AS (SELECT event_id // 2 AS k, event_id, user_id, event_type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03'),
known AS (SELECT DISTINCT event_id // 2 AS k FROM events WHERE ts < TIMESTAMP '2024-01-03'),
first AS (SELECT k, MIN(event_id) AS event_id, COUNT(*) AS copies FROM msg GROUP BY k),
classified AS (
SELECT f.k, f.copies, e.ts, e.user_id,
  CASE WHEN f.k IN (SELECT k FROM known) THEN 'DUPLICATE' WHEN s.sender_id IS NULL THEN 'REJECTED'
       WHEN e.event_type <> 'view' THEN 'IGNORED' ELSE 'PENDING' END AS status,
  'm' || e.event_id AS media_id, 'whatsapp:+212' || LPAD(CAST(e.user_id AS VARCHAR), 9, '0') AS sender_id
FROM first f JOIN events e ON e.event_id = f.event_id
LEFT JOIN senders s ON s.sender_id = 'whatsapp:+212' || LPAD(CAST(e.user_id AS VARCHAR), 9, '0') AND s.channel = 'WHATSAPP')"""


def classified(t: Tables) -> DataFrame:
    rows, start = inbound(t), F.lit("2024-01-03").cast("timestamp")
    return M.classify_inbound(rows.where(F.col("received_at") >= start), rows.where(F.col("received_at") < start), senders(t), ["received_at", "event_id"])


@query("m2_classify_inbound", CLASSIFIED_SQL + """
SELECT 'wamid.' || k AS wa_message_id, status, copies, CASE WHEN status = 'PENDING' THEN media_id ELSE '' END AS media_id,
       CASE WHEN status = 'REJECTED' THEN '' ELSE sender_id END AS sender_id FROM classified""")
def classify_inbound(t):
    return classified(t).select("wa_message_id", "status", "copies", F.coalesce("media_id", F.lit("")).alias("media_id"), F.coalesce("sender_id", F.lit("")).alias("sender_id"))


@query("m3_webhook_summary", CLASSIFIED_SQL + """
SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) FILTER (status = 'PENDING') AS queued, COUNT(*) FILTER (status = 'IGNORED') AS ignored,
  COUNT(*) FILTER (status = 'REJECTED') AS rejected, CAST(SUM(CASE WHEN status = 'DUPLICATE' THEN copies ELSE copies - 1 END) AS BIGINT) AS duplicates
FROM classified GROUP BY 1""")
def webhook_summary(t):
    return M.webhook_summary(classified(t).withColumn("day", F.date_format("received_at", "yyyy-MM-dd")), ["day"])


PHONES = "'+212 6-' || c_custkey"


@query("m4_sender_id", f"""SELECT c_custkey, CASE WHEN LENGTH('2126' || c_custkey) BETWEEN 6 AND 15 THEN 'whatsapp:+2126' || c_custkey ELSE '' END AS sender_id FROM customer""")
def sender_ids(t):
    return t.customer.select("c_custkey", F.coalesce(sender_id(F.expr(PHONES)), F.lit("")).alias("sender_id"))


@query("m5_mask_sender", """SELECT c_custkey, 'whatsapp:+212' || REPEAT('•', 7) || RIGHT(LPAD(CAST(c_custkey AS VARCHAR), 9, '0'), 2) AS masked FROM customer""")
def mask_senders(t):
    return t.customer.select("c_custkey", mask_sender(sender_id(F.expr(PHONE.format("c_custkey", "STRING")))).alias("masked"))


@query("m6_digest_matches", """SELECT doc_id, lang <> 'en' OR sha256(text) <> sha256(text || 'x') AND doc_id % 2 = 0 AS ok FROM documents""")
def digests(t):
    # Even documents declare the hex digest of their text, odd English ones that of another text; other languages declare nothing usable.
    other = F.concat("text", F.lit("x"))
    hexed = F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise(F.base64(F.unhex(F.sha2(other, 256))))
    declared = F.when(F.col("lang") == "en", hexed).otherwise("not a digest")
    return t.documents.select("doc_id", digest_matches(declared, F.col("text").cast("binary")).alias("ok"))


@query("m7_retry_schedule", f"""
WITH f AS (SELECT event_id, {KIND.format('BIGINT')} % 12 + 1 AS tries, event_type IN ('error', 'view') AS transient FROM events)
SELECT event_id, tries AS attempts, CASE WHEN transient AND tries < 10 THEN 'PENDING' ELSE 'FAILED' END AS status,
  CASE WHEN transient AND tries < 10 THEN CAST(LEAST(30 * POW(2, tries - 1), 3600) AS BIGINT) ELSE -1 END AS wait_seconds FROM f""")
def retry_schedule(t):
    jobs = t.events.select("event_id", (F.expr(KIND.format("BIGINT")) % 12).alias("attempts"), F.col("event_type").isin("error", "view").alias("transient"))
    return M.retry_schedule(jobs, F.lit("2024-02-01")).select("event_id", "attempts", "status", F.coalesce("wait_seconds", F.lit(-1)).cast("long").alias("wait_seconds"))


@query("m8_due_jobs", """
SELECT event_id FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 20""")
def due_jobs(t):
    jobs = t.events.select("event_id", F.col("ts").alias("next_attempt_at"), F.when(F.col("event_type") == "error", "PENDING").otherwise("SENT").alias("status"))
    return M.due_jobs(jobs, F.lit("2024-01-20").cast("timestamp"), 20, [F.col("next_attempt_at"), F.col("event_id")]).select("event_id")


def delivery_events(t: Tables) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in (("click", "SENT"), ("view", "DELIVERED"), ("signup", "READ"), ("error", "FAILED"), ("purchase", "OTHER")) for x in p])
    return t.events.select(
        F.expr("concat('w', event_id div 6)").alias("wa_message_id"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("status"),
        F.when(F.col("event_type") == "error", F.when(F.col("value") < 10, 131000).otherwise(131047)).cast("long").alias("error_code"), F.col("ts").cast("timestamp").alias("at"))


@query("m9_fold_delivery", """
WITH e AS (SELECT event_id // 6 AS m, event_id, event_type, value,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 0 END AS rank FROM events),
g AS (SELECT m, MIN(event_id) FILTER (event_type = 'error') AS fail, MIN(event_id) FILTER (rank >= 2) AS arrived, MAX(rank) AS top FROM e GROUP BY m),
j AS (SELECT g.*, x.value FROM g LEFT JOIN e x ON x.event_id = g.fail)
SELECT m AS message_id, CASE WHEN fail IS NOT NULL AND (arrived IS NULL OR fail < arrived)
    THEN CASE WHEN value < 10 AND m % 12 < 10 THEN 'PENDING' ELSE 'FAILED' END
    ELSE CASE WHEN top >= 2 THEN CASE top WHEN 2 THEN 'DELIVERED' ELSE 'READ' END ELSE 'SENT' END END AS status,
  CASE WHEN fail IS NOT NULL AND (arrived IS NULL OR fail < arrived)
    THEN CASE WHEN value < 10 THEN 'STATUS_FAILED_131000' ELSE 'STATUS_FAILED_131047' END ELSE '' END AS last_error,
  CASE WHEN fail IS NOT NULL AND (arrived IS NULL OR fail < arrived) AND value < 10 AND m % 12 < 10 THEN '' ELSE 'w' || m END AS wa_message_id
FROM j""")
def fold_delivery(t):
    return M.fold_delivery(delivery_events(t), outbound_messages(t)).select(
        "message_id", "status", F.coalesce("last_error", F.lit("")).alias("last_error"), F.coalesce("wa_message_id", F.lit("")).alias("wa_message_id"))


def outbound_messages(t: Tables) -> DataFrame:
    return t.events.select(F.expr("event_id div 6").alias("message_id")).distinct().select(
        "message_id", F.expr("concat('w', message_id)").alias("wa_message_id"), F.lit("SENT").alias("status"), F.expr("cast(message_id % 12 as int)").alias("attempts"),
        F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("updated_at"))


@query("m10_map_replies", f"""
SELECT i.event_id, COALESCE('R' || o.event_id, '') AS retake_request_id FROM events i
LEFT JOIN events o ON o.event_id = i.event_id - {KIND.format('BIGINT').replace('props', 'i.props')} AND o.event_type = 'signup' AND o.value < 10""")
def map_replies(t):
    e = t.events
    inbound_ = e.select("event_id", (F.col("event_id") - F.expr(KIND.format("BIGINT"))).cast("string").alias("context_message_id"))
    outbound = e.where("event_type IN ('click', 'signup')").select(F.col("event_id").alias("message_id"), F.col("event_id").cast("string").alias("wa_message_id"))
    retakes = e.where("event_type = 'signup'").select(F.expr("concat('R', event_id)").alias("request_id"), F.col("event_id").alias("request_message_id"),
                                                      F.when(F.col("value") < 10, "PENDING").otherwise("FULFILLED").alias("status"))
    return M.map_replies(inbound_, outbound, retakes).select("event_id", F.coalesce("retake_request_id", F.lit("")).alias("retake_request_id"))


def thread_messages(t: Tables) -> DataFrame:
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), sender_id(F.expr(PHONE.format("conv_id", "STRING"))).alias("sender_id"),
                                  F.when(F.col("role") == "assistant", "OUT").otherwise("IN").alias("direction"), F.col("text").alias("body"))


def thread_retakes(t: Tables) -> DataFrame:
    """Long answers stand for retake requests."""
    return t.conversations.where("role = 'assistant' AND length(text) > 200").select(
        F.expr("concat('RTK-', conv_id, '-', turn)").alias("request_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("request_message_id"),
        F.col("conv_id").cast("string").alias("page_id"), F.when(F.col("turn") % 2 == 1, "PENDING").otherwise("CANCELLED").alias("status"))


@query("m11_outbound_queue", f"""WITH {SENDERS_SQL}
SELECT c.conv_id * 1000 + c.turn AS message_id, s.sender_id, c.text AS body, CASE WHEN LENGTH(c.text) > 200 THEN 'src' || c.conv_id ELSE '' END AS quoted
FROM conversations c JOIN senders s ON s.sender_id = 'whatsapp:+212' || LPAD(CAST(c.conv_id AS VARCHAR), 9, '0') AND s.channel = 'WHATSAPP'
WHERE c.role = 'assistant'""")
def outbound_queue(t):
    pages = t.conversations.select(F.col("conv_id").cast("string").alias("page_id"), F.expr("concat('src', conv_id)").alias("source_message_id")).distinct()
    return M.outbound_queue(thread_messages(t), senders(t), thread_retakes(t), pages).select("message_id", "sender_id", "body", F.coalesce("quoted", F.lit("")).alias("quoted"))


@query("m12_discard_held", """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'FAILED' WHEN 'O' THEN 'SENT' ELSE 'DELIVERED' END AS status,
  CASE o_orderstatus WHEN 'P' THEN 'DISCARDED_HELD' ELSE '' END AS last_error FROM orders""")
def discard_held(t):
    jobs = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "SENT").otherwise("DELIVERED").alias("status"),
                           F.lit("").alias("last_error"))
    return M.discard_held(jobs)


@query("m13_dedup_messages", f"""
WITH m AS (SELECT user_id || '-' || {KIND.format('BIGINT')} AS message_id, ts, event_id FROM events)
SELECT message_id, MIN(event_id) AS event_id FROM m WHERE ts >= TIMESTAMP '2024-01-03'
  AND message_id NOT IN (SELECT message_id FROM m WHERE ts < TIMESTAMP '2024-01-03') GROUP BY message_id""")
def dedup_messages(t):
    rows = t.events.select(F.expr(f"user_id || '-' || {KIND.format('BIGINT')}").alias("message_id"), "ts", "event_id")
    start = F.lit("2024-01-03").cast("timestamp")
    return M.dedup_messages(rows.where(F.col("ts") >= start), rows.where(F.col("ts") < start), "message_id", ["ts", "event_id"]).select("message_id", "event_id")


GAP = 6 * 3600
GROUPS_SQL = f"""g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(LAG(ts) OVER w) <= {GAP * 1000000} THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
grouped AS (SELECT *, CAST(SUM(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS document_no FROM g)"""


def grouped(t: Tables) -> DataFrame:
    return M.group_pages(t.events.select("event_id", "user_id", "ts", "event_type"), GAP, "user_id", "ts", "event_id", bucket_seconds=6 * 3600)


@query("m14_group_pages", f"WITH {GROUPS_SQL} SELECT event_id, user_id, document_no FROM grouped")
def group_pages(t):
    return grouped(t).select("event_id", "user_id", "document_no")


@query("m15_group_explicit", f"""
WITH p AS (SELECT event_id, user_id, {KIND.format('BIGINT')} AS k, ts, event_type FROM events),
c AS (SELECT user_id, k, MIN(ts) AS closed_at FROM p WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT event_id, CASE WHEN p.ts > c.closed_at THEN 'GROUP_CLOSED' ELSE '' END AS reject_reason
FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.k = p.k""")
def group_explicit(t):
    pages = t.events.select("event_id", F.col("user_id").alias("sender_id"), F.expr(KIND.format("BIGINT")).alias("group_id"), F.col("ts").alias("received_at"), "event_type")
    closures = pages.where("event_type = 'purchase'").groupBy("group_id", "sender_id").agg(F.min("received_at").alias("closed_at"))
    return M.group_explicit(pages, closures).select("event_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


@query("m16_close_windows", f"""WITH {GROUPS_SQL}
SELECT user_id, document_no, COUNT(*) AS page_count, CASE WHEN epoch_us(TIMESTAMP '2024-01-25') - epoch_us(MAX(ts)) > {GAP * 1000000} THEN 'PENDING_AI' ELSE 'CAPTURED' END AS status
FROM grouped GROUP BY 1, 2""")
def close_windows(t):
    docs = M.documents_of_groups(grouped(t), "user_id", "ts").withColumns({"status": F.lit("CAPTURED"), "explicit_group": F.lit(False)})
    return M.close_windows(docs, F.lit("2024-01-25").cast("timestamp"), GAP).select("user_id", "document_no", "page_count", "status")


def pages_of_users(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("page_id"), F.when(F.col("event_type") == "error", F.col("event_id") + 1).alias("replaced_by"),
                           F.col("ts").alias("received_at"), "event_type")


POSITIONS_SQL = "n AS (SELECT user_id, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events WHERE event_type <> 'error')"


@query("m17_number_pages", f"WITH {POSITIONS_SQL} SELECT user_id AS document_id, event_id AS page_id, position FROM n")
def number_pages(t):
    return M.number_pages(pages_of_users(t), ["page_id"]).select("document_id", "page_id", "position")


@query("m18_acknowledge", f"""WITH {POSITIONS_SQL}
SELECT user_id AS sender_id, CASE WHEN event_type = 'signup' THEN 'Reçu : nouvelle photo de la page ' ELSE 'Reçu : page ' END || position || '. Merci, le traitement est en cours.' AS body
FROM n WHERE event_type <> 'click'""")
def acknowledge(t):
    pages = M.number_pages(pages_of_users(t), ["page_id"]).select(
        F.col("document_id").alias("sender_id"), "position", "received_at", F.when(F.col("event_type") == "signup", F.col("page_id")).alias("replaces"), (F.col("event_type") == "click").alias("duplicate"))
    return M.acknowledge(pages).select("sender_id", "body")


@query("m19_thread", """
SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'assistant' AND LENGTH(text) > 200 THEN 'RTK-' || conv_id || '-' || turn ELSE '' END AS retake_request_id,
  CASE WHEN role = 'assistant' AND LENGTH(text) > 200 THEN CASE WHEN turn % 2 = 1 THEN 'PENDING' ELSE 'CANCELLED' END ELSE '' END AS retake_status FROM conversations""")
def thread(t):
    return M.thread(thread_messages(t), thread_retakes(t)).select("id", F.coalesce("retake_request_id", F.lit("")).alias("retake_request_id"), F.coalesce("retake_status", F.lit("")).alias("retake_status"))


@query("m20_enroll", """
SELECT s_suppkey AS sender, CASE WHEN c.c_custkey IS NOT NULL AND c.c_nationkey <> s.s_nationkey THEN 'SENDER_MOVED' ELSE 'ACCEPTED' END AS verdict
FROM supplier s LEFT JOIN customer c ON c.c_custkey = s.s_suppkey
UNION ALL SELECT DISTINCT s.s_nationkey, 'NEW_FACILITY' FROM supplier s LEFT JOIN customer c ON c.c_custkey = s.s_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
WHERE n.n_regionkey = 0 AND (c.c_custkey IS NULL OR c.c_nationkey = s.s_nationkey)""")
def enroll(t):
    # Customers are enrolled already; suppliers ask to be. Facilities of one region are not there yet.
    held = t.customer.select(F.col("c_custkey").cast("string").alias("sender_id"), F.col("c_nationkey").cast("string").alias("facility_id"))
    asked = t.supplier.select(F.col("s_suppkey").cast("string").alias("sender_id"), F.col("s_nationkey").cast("string").alias("facility_id"), F.col("s_name").alias("label"), F.lit("WHATSAPP").alias("channel"))
    places = t.nation.where("n_regionkey <> 0").select(F.col("n_nationkey").cast("string").alias("facility_id"))
    accepted, refused, added = M.enroll(asked, held, places)
    key = lambda c: F.col(c).cast("long").alias("sender")
    return (accepted.select(key("sender_id"), F.lit("ACCEPTED").alias("verdict")).unionByName(refused.select(key("sender_id"), F.col("reason").alias("verdict")))
            .unionByName(added.select(key("facility_id"), F.lit("NEW_FACILITY").alias("verdict"))))


@query("m21_delivery_overview", f"""WITH {SENDERS_SQL},
o AS (SELECT c.conv_id * 1000 + c.turn AS id, s.label AS label FROM conversations c JOIN senders s ON s.sender_id = 'whatsapp:+212' || LPAD(CAST(c.conv_id AS VARCHAR), 9, '0') ORDER BY 1 DESC LIMIT 50)
SELECT 'outbound' AS part, id, label FROM o UNION ALL SELECT 'inbound', event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 50)""")
def delivery_overview(t):
    messages = thread_messages(t)
    outbound = messages.select(F.col("id").alias("message_id"), "sender_id")
    inbound_ = t.events.select(F.col("event_id").alias("inbound_id"), F.col("event_type").alias("message_type"))
    out, came = M.delivery_overview(outbound, messages, senders(t), inbound_)
    return out.select(F.lit("outbound").alias("part"), F.col("message_id").alias("id"), F.col("sender_label").alias("label")).unionByName(
        came.select(F.lit("inbound").alias("part"), F.col("inbound_id").alias("id"), F.col("message_type").alias("label")))


@query("s7_sync_registered", """
SELECT o.o_orderkey AS document_id, CASE WHEN n.n <= 7 THEN 'SYNCED' ELSE 'REGISTERED' END AS status, CASE WHEN n.n <= 7 THEN 'ACK-' || o.o_orderkey || '-' || n.n ELSE '' END AS ack_id
FROM orders o JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) n ON n.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'""")
def sync_registered(t):
    documents, visits, send = sync_tables(t)
    log = t.spark.createDataFrame([], "document_id string")
    acks = S.sync_registered(S.sync_payloads(documents, visits, log), send)
    return acks.select(F.col("document_id").cast("long").alias("document_id"), "status", F.coalesce("ack_id", F.lit("")).alias("ack_id"))


def sync_tables(t: Tables):
    # Finished orders with lines are registered documents; a registry that takes at most seven visits refuses the rest.
    documents = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(
        F.col("o_orderkey").cast("string").alias("document_id"), F.lit("F1").alias("facility_id"), F.col("o_orderkey").cast("string").alias("patient_id"),
        F.when(F.col("o_orderstatus") == "F", "REGISTERED").otherwise("CAPTURED").alias("status"))
    visits = t.lineitem.select(F.col("l_orderkey").cast("string").alias("patient_id"), "l_linenumber", "l_shipdate")

    def send(document, _patient, visits_):
        n = sum(1 for _v in visits_)
        return {"status": "ACKNOWLEDGED", "ack_id": f"ACK-{document}-{n}"} if n <= 7 else {"status": "BUSY"}

    return documents, visits, send


@query("s8_replay_outbox", """
WITH i AS (SELECT event_id // 3 AS id, MIN(event_id) AS seq, COUNT(*) FILTER (event_type = 'error') AS attempts, COUNT(*) FILTER (event_type = 'view') AS acks FROM events GROUP BY 1)
SELECT id, CASE WHEN acks > 0 THEN 'SYNCED' WHEN attempts > 0 THEN 'FAILED' ELSE 'PENDING' END AS state, attempts, acks = 0 AS to_send FROM i""")
def replay_outbox(t):
    key = F.expr("event_id div 3").alias("id")
    items = t.events.select(key, F.col("event_id").alias("seq"))
    acks = t.events.where("event_type = 'view'").select(key, F.col("event_id").cast("string").alias("page_id"))
    tries = t.events.where("event_type = 'error'").select(key, F.col("event_id").alias("seq"), F.lit("TIMEOUT").alias("error"))
    todo, state = S.replay_outbox(items, acks, tries)
    return state.join(todo.select("id", F.lit(True).alias("to_send")), "id", "left").select("id", "state", "attempts", F.coalesce("to_send", F.lit(False)).alias("to_send"))


@query("s10_words_to_lines", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS row_no FROM lineitem),
w AS (SELECT l_orderkey, row_no, (row_no - 1) // 3 AS line, CAST(l_quantity * 10 AS INT) AS lft, 60 AS width, 20 AS height, 100 - l_discount * 100 AS conf, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS text FROM l),
s AS (SELECT *, CASE WHEN LAG(line) OVER v = line AND lft - LAG(lft + width) OVER v <= 1.5 * height THEN 0 ELSE 1 END AS starts FROM w WINDOW v AS (PARTITION BY l_orderkey ORDER BY row_no)),
n AS (SELECT *, CAST(SUM(starts) OVER (PARTITION BY l_orderkey ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_no FROM s)
SELECT l_orderkey AS page_ref, line_no, STRING_AGG(text, ' ' ORDER BY row_no) AS text, ROUND(MIN(conf) / 100, 4) AS confidence, MIN(lft) AS x0, MAX(lft + width) AS x1 FROM n GROUP BY 1, 2""")
def words(t):
    from ..scale import numbered
    lines = numbered(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount"), ["l_orderkey"],
                     ["l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"], F.col("l_linenumber"), "row_no")
    rows = lines.select(F.col("l_orderkey").alias("page_ref"), "row_no", F.lit(5).alias("level"), F.lit(1).alias("block"), F.lit(1).alias("par"), F.expr("(row_no - 1) div 3").alias("line"),
                        (F.col("l_quantity") * 10).cast("int").alias("left"), F.lit(0).alias("top"), F.lit(60).alias("width"), F.lit(20).alias("height"),
                        (100 - F.col("l_discount") * 100).alias("conf"), F.col("l_quantity").cast("int").cast("string").alias("text"))
    return words_to_lines(rows).select("page_ref", "line_no", "text", F.round("confidence", 4).alias("confidence"), "x0", "x1")
