"""Delivery states as a stream, and the two places where something is sent.

Sending is at least once, with ids the receiver recognises. What was answered is a table by epoch (`epochs`), so a task
that is lost and repeated, or an epoch that is run again, leaves one answer for each document or item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import catalog as C
from ..operators.messages import delivery_state, judge_delivery
from ..scale import cut_lineage, first_by
from .epochs import is_complete, latest, read_epochs, write_epoch


DELIVERED = "message_id long, wa_message_id string, status string, attempts int, last_error string, next_attempt_at timestamp, updated_at timestamp"


def delivery_stream(events: DataFrame, outbound: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """M9 as a stream: the messages whose state a micro-batch changed, judged over all their events and written by epoch.

    The aggregates are kept up to date by the stream; the attempts of each message come from the outbound table by a join
    of the changed messages only. As a message is always judged over its whole history, it does not matter where the
    micro-batches were cut.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        write_epoch(judge_delivery(batch, outbound, "inner"), target, epoch)

    return (delivery_state(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def delivered_messages(spark: SparkSession, target: str) -> DataFrame:
    """M9: the last state of every message that had events."""
    return latest(read_epochs(spark, target, DELIVERED), ["message_id"]).drop("epoch")


ACK = "document_id string, patient_id string, ack_id string, status string, error_type string"


def sync_payloads(documents: DataFrame, visits: DataFrame, log: DataFrame) -> DataFrame:
    """The registered documents that are not in the log yet, one row per visit of their patient (long: a patient's
    visits have no bound); a document without visits has one row without a visit."""
    todo = documents.where("status = 'REGISTERED'").join(log.select("document_id"), "document_id", "left_anti")
    rest = [c for c in visits.columns if c != "patient_id"]
    return todo.select("document_id", "facility_id", "patient_id").join(
        visits.select("patient_id", F.struct(*rest).alias("visit")), "patient_id", "left")


def deliver_payloads(payloads: DataFrame, send: Callable[[str, str, Iterator[str]], dict]) -> DataFrame:
    """Send each document once and give an acknowledgement or an error type per document. Every reading sends.

    Rows are partitioned by document and sorted inside each partition, so a task streams the visits of one document
    after the other to `send(document_id, patient_id, visits)` without holding them.
    """
    statuses = tuple(C.ACK_STATUSES)  # the function for the workers closes over values, not over this package
    rows = payloads.select("document_id", "patient_id", F.to_json("visit").alias("visit")).repartition("document_id").sortWithinPartitions("document_id")

    columns = ["document_id", "patient_id", "ack_id", "status", "error_type"]

    def deliver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import groupby

        stream = (row for frame in batches for row in zip(frame["document_id"], frame["patient_id"], frame["visit"]))
        answers = []
        for document, group in groupby(stream, key=lambda row: row[0]):
            head = next(group)
            visits = (visit for part in ([head], group) for _d, _p, visit in part if isinstance(visit, str))
            ack_id, error = None, None
            try:
                answer = send(document, head[1], visits)
                good = isinstance(answer, dict) and answer.get("status") in statuses
                ack_id = answer.get("ack_id") if good else None
                if not isinstance(ack_id, str) or not ack_id.strip():
                    ack_id, error = None, "SYNC_ACK_REQUIRED"
            except Exception as failure:  # the type only: messages may quote patient data
                error = type(failure).__name__
            answers.append((document, head[1], ack_id, "SYNCED" if error is None else "REGISTERED", error))
            if len(answers) == 2000:
                yield pd.DataFrame(answers, columns=columns)
                answers = []
        yield pd.DataFrame(answers, columns=columns)

    return rows.mapInPandas(deliver, ACK)


def sync_registered(payloads: DataFrame, send: Callable[[str, str, Iterator[str]], dict]) -> DataFrame:
    """Send once and store the answers in the shared folder, so that reading them again, as statuses and as failures,
    does not send again. `sync_to_log` keeps them for later runs as well."""
    return cut_lineage(deliver_payloads(payloads, send))


def read_sync_log(spark: SparkSession, log: str) -> DataFrame:
    """All answers with the epoch in which they came."""
    return read_epochs(spark, log, ACK)


def synced_documents(spark: SparkSession, log: str, before: int | None = None) -> DataFrame:
    return read_epochs(spark, log, ACK, before).where("status = 'SYNCED'").select("document_id")


def sync_to_log(documents: DataFrame, visits: DataFrame, log: str, epoch: int, send: Callable[[str, str, Iterator[str]], dict]) -> DataFrame:
    """Send the registered documents the log does not hold as synced and append the answers as one epoch.

    Spark's writer keeps the rows of one attempt of each task and marks the epoch complete at the end. So a repeated task
    leaves one acknowledgement per document, an epoch that broke off is sent again and replaced, and a complete one sends
    nothing. Documents that failed before are in the next epoch again if `documents` has them.
    """
    spark = documents.sparkSession
    if not is_complete(spark, log, epoch):
        payloads = sync_payloads(documents.dropDuplicates(["document_id"]), visits, synced_documents(spark, log, epoch))
        write_epoch(deliver_payloads(payloads, send), log, epoch)
    return read_sync_log(spark, log).where(F.col("epoch") == epoch)


def failed_documents(spark: SparkSession, log: str, before: int) -> DataFrame:
    """Documents whose last answer was an error."""
    return latest(read_epochs(spark, log, ACK, before), ["document_id"]).where("status <> 'SYNCED'").select("document_id")


def sync_stream(registered: DataFrame, documents: DataFrame, visits: DataFrame, log: str, checkpoint: str,
                send: Callable[[str, str, Iterator[str]], dict]) -> StreamingQuery:
    """S7 as a stream: documents (`registered` streams their ids) are sent in the micro-batch in which they come, with
    those whose last sending failed."""
    def write(batch: DataFrame, epoch: int) -> None:
        due = batch.select("document_id").union(failed_documents(batch.sparkSession, log, epoch)).distinct()
        sync_to_log(documents.join(due, "document_id", "left_semi"), visits, log, epoch, send)

    return registered.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def apply_acknowledgements(documents: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their new status, failure events)."""
    done = acks.where("status = 'SYNCED'").select("document_id", F.lit(True).alias("_done"))
    after = documents.join(done, "document_id", "left").withColumn("status", F.when(F.col("_done"), "SYNCED").otherwise(F.col("status"))).drop("_done")
    failed = acks.where("error_type IS NOT NULL").select(
        "document_id", F.lit("SYNC_FAILED").alias("type"), F.to_json(F.struct("error_type", "patient_id")).alias("detail"))
    return after, failed


def replay_outbox(outbox: DataFrame, delivered: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items still to send in order, state per item).

    `outbox` may hold an item several times; `delivered` are acknowledgements that named a page; `attempts` are tries.
    """
    items = first_by(outbox, ["id"], ["seq"])
    acked = delivered.where("page_id IS NOT NULL").groupBy("id").agg(F.min("page_id").alias("page_id"))
    tries = attempts.groupBy("id").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("error", "seq").alias("last_error"))
    state = items.join(acked, "id", "left").join(tries, "id", "left").withColumns({
        "attempts": F.coalesce("attempts", F.lit(0)),
        "state": F.when(F.col("page_id").isNotNull(), "SYNCED").when(F.coalesce("attempts", F.lit(0)) > 0, "FAILED").otherwise("PENDING")})
    state = state.withColumn("last_error", F.when(F.col("state") == "FAILED", F.col("last_error")))
    return items.join(acked, "id", "left_anti"), state


def closable_groups(state: DataFrame) -> DataFrame:
    """Groups whose items have all been delivered and that had pages."""
    return state.where("group_id IS NOT NULL").groupBy("group_id").agg(
        F.bool_and(F.col("state") == "SYNCED").alias("_done")).where("_done").select("group_id")


ITEM = "id string, sender_id string, seq long, group_id string, page_id string, document_id string, error string"
CLOSING = "group_id string, document_id string, ok boolean"


def cursors(spark: SparkSession, log: str, before: int | None = None) -> DataFrame:
    """How far each sender's items have been delivered. Items go out in order, so one number says it."""
    return read_epochs(spark, log, ITEM, before).where("page_id IS NOT NULL").groupBy("sender_id").agg(F.max("seq").alias("cursor"))


def open_items(outbox: DataFrame, done: DataFrame) -> DataFrame:
    """The items behind the cursor of their sender, one for each id: what an outbox still holds after acknowledgements."""
    return (first_by(outbox, ["id"], ["seq"]).join(done, "sender_id", "left")
            .where(F.col("cursor").isNull() | (F.col("seq") > F.col("cursor"))).drop("cursor"))


def flush_outbox(outbox: DataFrame, log: str, run: int, send: Callable[[str, str], dict], most: int | None = None) -> DataFrame:
    """Deliver the open items of each sender in order of `seq`, up to the first that fails, and log what came back.

    `outbox` has id, sender_id, seq, group_id and payload. `send(id, payload)` must answer with a `page_id`. A sender's items
    are one sorted stream through one task, which holds one at a time; with `most`, a run delivers so many of each sender,
    so a run that breaks off repeats no more than these. A run that is complete sends nothing when it is called again.
    """
    spark = outbox.sparkSession
    if is_complete(spark, log, run):
        return read_epochs(spark, log, ITEM).where(F.col("epoch") == run)
    todo = open_items(outbox, cursors(spark, log, run)).select("id", "sender_id", "seq", "group_id", "payload")

    def deliver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sender, stopped, n = None, False, 0
        for frame in batches:
            out = []
            for id_, whose, seq, group, payload in frame.itertuples(index=False):
                if whose != sender:
                    sender, stopped, n = whose, False, 0
                if stopped or (most is not None and n == most):
                    continue
                n += 1
                page = document = error = None
                try:
                    answer = send(id_, payload)
                    answer = answer if isinstance(answer, dict) else {}
                    page, document = answer.get("page_id") or None, answer.get("document_id")
                    error = None if page else "NOT_ACKNOWLEDGED"
                except Exception as failure:  # the type only: messages may quote patient data
                    error = type(failure).__name__
                stopped = error is not None
                out.append((id_, whose, seq, group, page, document, error))
            yield pd.DataFrame(out, columns=["id", "sender_id", "seq", "group_id", "page_id", "document_id", "error"])

    ordered = todo.repartition("sender_id").sortWithinPartitions("sender_id", "seq")
    write_epoch(ordered.mapInPandas(deliver, ITEM), log, run)
    return read_epochs(spark, log, ITEM).where(F.col("epoch") == run)


def item_states(outbox: DataFrame, log: str) -> DataFrame:
    """State, attempts, page_id and last error of every item, from the log of all runs."""
    rows = read_epochs(outbox.sparkSession, log, ITEM)
    acked = rows.where("page_id IS NOT NULL").select("id", "page_id")
    tries = rows.where("error IS NOT NULL").select("id", F.col("epoch").alias("seq"), "error")
    state = replay_outbox(outbox, acked, tries)[1]
    return state.withColumn("attempts", F.col("attempts") + (F.col("state") == "SYNCED").cast("int"))


def close_groups(outbox: DataFrame, log: str, closings: str, run: int, close: Callable[[str], dict]) -> DataFrame:
    """Close the documents of the groups whose items have all been delivered, each until it is acknowledged."""
    spark = outbox.sparkSession
    if not is_complete(spark, closings, run):
        done = read_epochs(spark, closings, CLOSING, run).where("ok").select("group_id", "document_id")
        of_group = read_epochs(spark, log, ITEM).where("document_id IS NOT NULL").select("group_id", "document_id").distinct()
        todo = closable_groups(item_states(outbox, log)).join(of_group, "group_id").join(done, ["group_id", "document_id"], "left_anti")

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                answers = []
                for document in frame["document_id"]:
                    try:
                        answer = close(document)
                        answers.append(isinstance(answer, dict) and bool(answer.get("ok")))
                    except Exception:  # counts as not acknowledged
                        answers.append(False)
                yield frame[["group_id", "document_id"]].assign(ok=pd.Series(answers, dtype=bool))

        write_epoch(todo.select("group_id", "document_id").mapInPandas(ask, CLOSING), closings, run)
    return read_epochs(spark, closings, CLOSING).where(F.col("epoch") == run)
