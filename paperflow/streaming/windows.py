"""M14 and M16 as a stream: pages become documents, open documents are CAPTURED, closed ones PENDING_AI.

State per sender: the sessions that may still grow, as (first page, last page, number of pages). A page joins a session
when it is at most the window away, and may join two sessions to one. One event-time timer for each sender stands at the
end of the earliest window; when the watermark passes it, all documents whose windows are over are closed and leave the
state, and the next timer is set. So the calls to the state store follow senders and batches, not sessions. What comes out is a log of
changes; `documents` gives its end: open documents too, so the result does not depend on where micro-batches were cut.

A page that comes after the watermark opens nothing and is dropped by Spark; the delay bounds how late a page may be.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .. import catalog as C
from .epochs import latest

CHANGE = "sender_id string, first_us long, last_us long, page_count long, status string"
OPEN, CLOSED, GONE = "CAPTURED", "PENDING_AI", "JOINED"


def joined_spans(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (first, last, pages) with those at most `gap` apart joined."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] <= gap:
            out[-1] = out[-1][0], max(out[-1][1], last), out[-1][2] + n
        else:
            out.append((first, last, n))
    return out


class DocumentSessions(StatefulProcessor):
    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getListState("open", "first long, last long, pages long")

    def held(self) -> list[tuple[int, int, int]]:
        return [tuple(map(int, s)) for s in self.open.get()]

    def store(self, spans: list[tuple[int, int, int]]) -> None:
        self.open.put(spans) if spans else self.open.clear()

    def timer(self, last: int) -> int:
        """The first millisecond at which the window after `last` is over."""
        return (last + self.gap) // 1000 + 1

    def wake(self, before: int | None, last: int | None) -> None:
        """Move the sender's timer from the end of one window to that of another."""
        if before is not None and before != last:
            self.handle.deleteTimer(self.timer(before))
        if last is not None and before != last:
            self.handle.registerTimer(self.timer(last))

    def changes(self, key, rows: list[tuple[int, int, int, str]]) -> Iterator[pd.DataFrame]:
        if rows:
            first, last, pages, status = zip(*rows)
            yield pd.DataFrame({"sender_id": [key[0]] * len(rows), "first_us": first, "last_us": last, "page_count": pages, "status": status})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.held()
        spans = before
        for frame in rows:
            at = np.sort(frame["at_us"].to_numpy(np.int64))
            cut = np.concatenate(([0], np.flatnonzero(np.diff(at) > self.gap) + 1, [len(at)]))
            spans = joined_spans(spans + [(int(at[a]), int(at[b - 1]), int(b - a)) for a, b in zip(cut[:-1], cut[1:])], self.gap)
        self.wake(min((s[1] for s in before), default=None), min(s[1] for s in spans))
        self.store(spans)
        starts = {s[0] for s in spans}
        yield from self.changes(key, [(*s, OPEN) for s in spans if s not in before] + [(*s, GONE) for s in before if s[0] not in starts])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The timer that fired is taken away by Spark.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = self.held()
        done, kept = [s for s in spans if self.timer(s[1]) <= now], [s for s in spans if self.timer(s[1]) > now]
        self.store(kept)
        self.wake(None, min((s[1] for s in kept), default=None))
        yield from self.changes(key, [(*s, CLOSED) for s in done])

    def close(self) -> None:
        pass


def document_changes(pages: DataFrame, window_seconds: float = C.GROUP_WINDOW_SECONDS, delay: str = "1 minute") -> DataFrame:
    """The log of changes for a stream of ordinary pages (sender_id, received_at), in update mode. Needs the RocksDB state store."""
    rows = pages.where(F.col("received_at").isNotNull()).withWatermark("received_at", delay).select(
        F.col("sender_id").cast("string").alias("sender_id"), "received_at", F.unix_micros(F.col("received_at").cast("timestamp")).alias("at_us"))
    return rows.groupBy("sender_id").transformWithStateInPandas(DocumentSessions(int(window_seconds * 1_000_000)), CHANGE, "update", "eventTime")


def documents(changes: DataFrame) -> DataFrame:
    """The documents at the end of a log of changes with their epochs."""
    last = latest(changes.withColumn("_closed", F.col("status") == CLOSED), ["sender_id", "first_us"], ["_closed"])
    return last.where(F.col("status") != GONE).select("sender_id", "page_count", F.timestamp_micros("first_us").alias("created_at"),
                                                      F.timestamp_micros("last_us").alias("last_page_at"), "status")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
