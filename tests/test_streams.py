"""Streams and sinks: the result does not depend on where micro-batches are cut, and whatever is repeated adds nothing."""

import datetime as dt
import os
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from paperflow.operators import messages as M
from paperflow.streaming import history as H
from paperflow.streaming import streams as T
from paperflow.streaming import windows as W
from paperflow.streaming.epochs import is_complete, latest, read_epochs, write_epoch

START = dt.datetime(2025, 1, 1)
SCHEMA = "sender_id string, received_at timestamp"


def arrivals(spark, folder, slices, schema):
    """A stream that gets one slice to a micro-batch."""
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(query):
    assert query.awaitTermination(300)


def sliced(rows, n):
    size = -(-len(rows) // n)
    return [rows[i:i + size] for i in range(0, len(rows), size)]


# ------------------------------------------------------------------ M14, M16

def windows_of(spark, folder, slices):
    changes = W.document_changes(arrivals(spark, f"{folder}/in", slices, SCHEMA), 8, "20 seconds")
    drained(changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True)
            .foreachBatch(lambda batch, epoch: write_epoch(batch, f"{folder}/out", epoch)).start())
    got = W.documents(read_epochs(spark, f"{folder}/out", W.CHANGE)).collect()
    return sorted((g.sender_id, g.created_at, g.last_page_at, g.page_count, g.status) for g in got)


def plain_windows(rows, gap, now):
    out, by_sender = [], {}
    for sender, at in rows:
        by_sender.setdefault(sender, []).append(at)
    for sender, times in by_sender.items():
        run = []
        for at in [*sorted(times), None]:
            if run and (at is None or (at - run[-1]).total_seconds() > gap):
                closed = (now - run[-1]).total_seconds() > gap
                out.append((sender, run[0], run[-1], len(run), "PENDING_AI" if closed else "CAPTURED"))
                run = []
            run.append(at)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_documents_do_not_depend_on_micro_batches(spark, tmp_path, parts):
    r = random.Random(3)
    at, rows = 0.0, []
    for _ in range(300):
        at += r.choice([0.2, 1, 3, 7])
        # Pages are up to 12 seconds late, which the delay of 20 seconds allows; they may join two documents to one.
        rows.append((f"s{r.choice([0, 0, 0, 1, 2, 3])}", START + dt.timedelta(seconds=round(at - r.choice([0, 0, 0, 12]), 3))))
    rows += [("edge", START), ("edge", START + dt.timedelta(seconds=8)), ("edge", START + dt.timedelta(seconds=16.001))]
    rows.sort(key=lambda x: x[1] if r.random() < 0.9 else x[1] + dt.timedelta(seconds=10))
    last = max(t for _, t in rows)
    want = plain_windows(rows, 8, last - dt.timedelta(seconds=20))
    assert {s for *_, s in want} == {"CAPTURED", "PENDING_AI"}
    assert windows_of(spark, str(tmp_path), sliced(rows, parts)) == want


def test_a_late_page_joins_two_open_documents():
    assert W.joined_spans([(0, 5, 2), (20, 22, 1), (12, 13, 1)], 8) == [(0, 22, 4)]
    assert W.joined_spans([(0, 5, 2), (14, 15, 1)], 8) == [(0, 5, 2), (14, 15, 1)]


# ------------------------------------------------------------------ M9

EVENTS = "wa_message_id string, seq long, status string, error_code long, at timestamp"


@pytest.mark.parametrize("parts", [1, 4])
def test_delivery_does_not_depend_on_micro_batches(spark, tmp_path, parts):
    r = random.Random(5)
    events = [(f"w{r.randrange(40)}", k, r.choice(["SENT", "DELIVERED", "READ", "FAILED"]), r.choice([131000, 131047, None]), START + dt.timedelta(seconds=k)) for k in range(200)]
    outbound = spark.createDataFrame([(m, f"w{m}", "SENT", m % 12, None, None, None) for m in range(40)], T.DELIVERED)
    stream = arrivals(spark, f"{tmp_path}/in", sliced(events, parts), EVENTS)
    drained(T.delivery_stream(stream, outbound, f"{tmp_path}/out", f"{tmp_path}/c"))
    columns = ["message_id", "wa_message_id", "status", "attempts", "last_error", "next_attempt_at", "updated_at"]
    met = {e[0] for e in events}
    want = M.fold_delivery(spark.createDataFrame(events, EVENTS), outbound).select(*columns).collect()
    assert sorted(map(str, T.delivered_messages(spark, f"{tmp_path}/out").select(*columns).collect())) == sorted(str(w) for w in want if f"w{w.message_id}" in met)


def test_the_tenth_attempt_is_the_last(spark, tmp_path):
    events = [(f"w{m}", m, "FAILED", 131000, START) for m in (8, 9, 10, 11)]
    outbound = spark.createDataFrame([(m, f"w{m}", "SENT", m, None, None, None) for m in (8, 9, 10, 11)], T.DELIVERED)
    drained(T.delivery_stream(arrivals(spark, f"{tmp_path}/in", [events[:2], events[2:]], EVENTS), outbound, f"{tmp_path}/out", f"{tmp_path}/c"))
    got = {g.message_id: (g.status, g.wa_message_id) for g in T.delivered_messages(spark, f"{tmp_path}/out").collect()}
    assert got == {8: ("PENDING", None), 9: ("PENDING", None), 10: ("FAILED", "w10"), 11: ("FAILED", "w11")}


# ------------------------------------------------------------------ M13

MESSAGES = "message_id string, event_id long"


def test_message_history(spark, tmp_path):
    history = H.MessageHistory(f"{tmp_path}/h", "message_id", MESSAGES, expected_ids=1, partitions=8)
    first = spark.createDataFrame([(f"m{i % 50}", i) for i in range(120)], MESSAGES)
    history.append(first, 0, ["event_id"])
    again = spark.createDataFrame([(f"m{i}", 1000 + i) for i in range(40, 60)] + [(None, 2000)], MESSAGES)
    history.append(again, 1, ["event_id"])
    want = {f"m{i}": i for i in range(50)} | {f"m{i}": 1000 + i for i in range(50, 60)}
    read = lambda: {g.message_id: g.event_id for g in history.read(spark).where("message_id IS NOT NULL").collect()}
    assert read() == want and history.read(spark).where("message_id IS NULL").count() == 1
    files = sorted(os.listdir(f"{history.rows}/epoch=1"))
    history.append(again, 1, ["event_id"])  # complete: nothing is written
    assert sorted(os.listdir(f"{history.rows}/epoch=1")) == files
    os.remove(f"{history.filters}/epoch=1/_SUCCESS")  # broken off at the very end: the epoch is made again
    history.append(again, 1, ["event_id"])
    assert read() == want and is_complete(spark, history.filters, 1)


def test_bitmaps_miss_no_stored_id_and_few_partitions_are_read(spark, tmp_path):
    history = H.MessageHistory(f"{tmp_path}/h", "message_id", MESSAGES, expected_ids=200_000, partitions=16)
    history.append(spark.range(20_000).select(F.concat(F.lit("old"), F.col("id")).alias("message_id"), F.col("id").alias("event_id")), 0, ["event_id"])
    old = history.addressed(spark.range(20_000).select(F.concat(F.lit("old"), F.col("id")).alias("message_id")))
    assert history.perhaps_known(old, 1).count() == 20_000
    new = history.addressed(spark.range(20_000).select(F.concat(F.lit("new"), F.col("id")).alias("message_id")))
    assert history.perhaps_known(new, 1).count() < 200
    one = history.addressed(spark.createDataFrame([("old7",)], "message_id string")).first()["part"]
    plan = history.stored([one], spark, 1)._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters:")[1].split("]")[0]
    for part in range(16):  # a message that is known is told so with the other partitions out of reach
        for name in os.listdir(f"{history.rows}/epoch=0/part={part}") if part != one else []:
            with open(f"{history.rows}/epoch=0/part={part}/{name}", "wb") as broken:
                broken.write(b"not a table")
    history.append(spark.createDataFrame([("old7", 5), ("old7", 6)], MESSAGES), 1, ["event_id"])
    assert read_epochs(spark, history.rows, f"{MESSAGES}, part int").where("epoch = 1").count() == 0


# ------------------------------------------------------------------ S7

DOCS, VISITS = "document_id string, facility_id string, patient_id string, status string", "patient_id string, visit string"


def sync_tables(spark, n=30):
    documents = spark.createDataFrame([(f"D{i}", "F", f"P{i}", "REGISTERED" if i % 5 else "CAPTURED") for i in range(n)], DOCS)
    return documents, spark.createDataFrame([(f"P{i}", f"v{k}") for i in range(n) for k in range(i % 4)], VISITS)


def test_documents_that_failed_are_sent_again_and_others_not(spark, tmp_path):
    documents, visits = sync_tables(spark)
    log, sent = f"{tmp_path}/log", f"{tmp_path}/sent"
    os.mkdir(sent)

    def send(document, _patient, rows, sent=sent):
        n = len(os.listdir(sent))
        open(f"{sent}/{document}-{n}-{os.getpid()}", "w").close()
        tries = sum(name.startswith(f"{document}-") for name in os.listdir(sent))
        if document in ("D3", "D4") and tries == 1:
            raise OSError("away")
        return {"status": "ACKNOWLEDGED", "ack_id": f"{document}:{sum(1 for _ in rows)}"}

    registered = [[(f"D{i}",) for i in range(0, 15)], [(f"D{i}",) for i in range(10, 30)]]
    drained(T.sync_stream(arrivals(spark, f"{tmp_path}/in", registered, "document_id string"), documents, visits, log, f"{tmp_path}/c", send))
    rows = T.read_sync_log(spark, log)
    state = {g.document_id: (g.status, g.ack_id) for g in latest(rows, ["document_id"]).collect()}
    assert state == {f"D{i}": ("SYNCED", f"D{i}:{i % 4}") for i in range(30) if i % 5}
    failed = {(g.document_id, g.error_type) for g in rows.where("status <> 'SYNCED'").collect()}
    assert failed == {("D3", "OSError"), ("D4", "OSError")}
    assert len(os.listdir(sent)) == 24 + 2
    T.sync_to_log(documents, visits, log, 1, send)  # the epoch is complete: nothing is sent
    assert len(os.listdir(sent)) == 24 + 2


def test_a_killed_task_leaves_one_acknowledgement(tmp_path):
    """A worker dies in the middle of a task; the task is repeated in a cluster that allows it."""
    code = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark.sql import SparkSession
        from paperflow.streaming import streams as T
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        base = {str(tmp_path)!r}
        os.mkdir(base + "/sent")

        def send(document, _patient, rows):
            mark = base + "/killed"
            if document == "D7" and not os.path.exists(mark):
                open(mark, "w").close()
                os._exit(1)
            open(base + "/sent/" + document + "-" + str(os.getpid()), "w").close()
            return {{"status": "ACKNOWLEDGED", "ack_id": document}}

        documents = spark.createDataFrame([(f"D{{i}}", "F", f"P{{i}}", "REGISTERED") for i in range(20)], {DOCS!r})
        visits = spark.createDataFrame([("P1", "v")], {VISITS!r})
        rows = T.sync_to_log(documents, visits, base + "/log", 0, send).collect()
        assert sorted(r.document_id for r in rows) == sorted(f"D{{i}}" for i in range(20)), rows
        assert all(r.status == "SYNCED" and r.ack_id == r.document_id for r in rows)
        assert os.path.exists(base + "/killed")
        print("one acknowledgement each")
    """)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "one acknowledgement each" in done.stdout, done.stderr[-2000:]


# ------------------------------------------------------------------ S8

ITEMS = "id string, sender_id string, seq long, group_id string, payload string"


def outbox(spark, n=60):
    return spark.createDataFrame([(f"i{k}", f"s{k % 3}", k, f"g{k // 10}" if k % 2 else None, f"p{k}") for k in range(n)] + [("i4", "s1", 99, None, "again")], ITEMS)


def test_items_go_out_in_order_and_resume_behind_the_cursor(spark, tmp_path):
    items, log, closings = outbox(spark), f"{tmp_path}/log", f"{tmp_path}/closings"
    down = lambda i, payload: {} if i in ("i10", "i32") else {"page_id": f"P{i}", "document_id": f"D{int(i[1:]) // 10}"}
    up = lambda i, payload: {"page_id": f"P{i}", "document_id": f"D{int(i[1:]) // 10}"}
    one = T.flush_outbox(items, log, 1, down).collect()
    assert {g.id for g in one if g.error} == {"i10", "i32"}
    assert {g.id for g in one if g.page_id} == {f"i{k}" for k in range(60) if k < (60, 10, 32)[k % 3]}
    assert {g.document_id for g in T.close_groups(items, log, closings, 1, lambda d: {"ok": d != "D0"}).collect() if g.ok} == set()
    assert {r.id for r in T.open_items(items, T.cursors(spark, log)).collect()} == {f"i{k}" for k in range(60) if k >= (60, 10, 32)[k % 3]}
    two = T.flush_outbox(items, log, 2, up, most=5).collect()
    assert [g.id for g in sorted(two, key=lambda g: g.seq)] == [f"i{k}" for k in (10, 13, 16, 19, 22, 32, 35, 38, 41, 44)]
    T.flush_outbox(items, log, 3, up)
    assert T.flush_outbox(items, log, 3, down).count() == len([k for k in range(60) if k >= (60, 25, 47)[k % 3]])  # complete: sends nothing
    states = {g.id: (g.state, g.attempts, g.page_id) for g in T.item_states(items, log).collect()}
    assert states == {f"i{k}": ("SYNCED", 2 if k in (10, 32) else 1, f"Pi{k}") for k in range(60)}
    first = T.close_groups(items, log, closings, 3, lambda d: {"ok": d != "D5"}).collect()
    assert {(g.document_id, g.ok) for g in first} == {(f"D{k}", k != 5) for k in range(6)}
    assert {(g.document_id, g.ok) for g in T.close_groups(items, log, closings, 4, lambda d: {"ok": True}).collect()} == {("D5", True)}


def test_a_run_that_broke_off_is_made_again(spark, tmp_path):
    items, log, mark = outbox(spark), f"{tmp_path}/log", f"{tmp_path}/mark"

    def dies(i, payload, mark=mark):
        if i == "i30" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return {"page_id": f"P{i}"}

    with pytest.raises(Exception):
        T.flush_outbox(items, log, 1, dies)
    assert not is_complete(spark, log, 1)
    assert T.flush_outbox(items, log, 1, dies).count() == 60
    assert T.item_states(items, log).where("state = 'SYNCED' AND attempts = 1").count() == 60


def test_one_timer_for_a_sender_whatever_the_sessions():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.calls, self.timers, self.rows = 0, set(), []

        def getListState(self, *_):
            return self

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def registerTimer(self, at):
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers.discard(at)

    class Times:
        def __init__(self, now, watermark):
            self.now, self.watermark = now, watermark

        def getExpiryTimeInMs(self):
            return self.now

        def getCurrentWatermarkInMs(self):
            return self.watermark

    sessions, handle = W.DocumentSessions(1_000), Handle()
    sessions.init(handle)
    opened = list(sessions.handleInputRows(("a",), iter([pd.DataFrame({"at_us": [k * 10_000 for k in range(100)]})]), None))
    assert len(opened[0]) == 100 and handle.calls == 1
    first = min(handle.timers)
    handle.timers.clear()
    closed = list(sessions.handleExpiredTimer(("a",), Times(first, 500), Times(first, 500)))
    assert len(closed[0]) == 50 and set(closed[0].status) == {W.CLOSED} and len(handle.rows) == 50
    assert handle.timers == {sessions.timer(500_000)} and handle.calls == 2
    list(sessions.handleInputRows(("a",), iter([pd.DataFrame({"at_us": [500_500]})]), None))
    assert handle.timers == {sessions.timer(500_500)} and handle.rows[0] == (500_000, 500_500, 2)


def test_pages_whose_ids_run_against_their_times_are_all_grouped(spark, tmp_path):
    from paperflow.plans import QUERIES

    rows = [(99 - k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), k % 3, "view", 1.0, "{}") for k in range(100)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["m14_group_pages_stream"](spark, str(tmp_path)).collect()
    assert len(got) == 100 and {g.page_count for g in got} == {1} and sum(g.status == "CAPTURED" for g in got) == 1
