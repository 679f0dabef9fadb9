"""State machines over event time: file status, archived conversations, done files, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.sources import commits
from marginalia.streaming.ingest import dead_letters
from marginalia.streaming.monitor import STEPS, utc_instant

LEGAL = frozenset(STEPS)


def may_follow(before: int | None, after: int) -> bool:
    """A first status and a repeated one are legal, else the step has to be known."""
    return before is None or before == after or (before, after) in LEGAL


class StatusProcessor(StatefulProcessor):
    """Changes of a file wait until the watermark has passed them, so they are judged in the order of their time.

    A legal step moves the file on, any other is reported and leaves the status as it is. A file that has been silent for the
    time to live is forgotten.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms bigint, event_id bigint, status int")
        self.now = handle.getValueState("now", "status int, at_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due: set[int] = set()
        for pdf in rows:
            new = [(int(a), int(e), int(s)) for a, e, s in zip(pdf["at_ms"], pdf["event_id"], pdf["status"])]
            self.waiting.appendList(new)
            due.add(min(a for a, _, _ in new))
        self.handle.registerTimer(min(due) + 1)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in held if r[0] < passed]
        status, last = self.now.get() if self.now.exists() else (None, None)
        out = []
        for at, event, after in ready:
            if last is not None and at >= last + self.ttl_ms:
                status = None
            ok = may_follow(status, after)
            out.append((key[0], event, -1 if status is None else int(status), after, ok))
            status, last = (after if ok else status), at
        rest = held[len(ready):]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] + 1)
        else:
            self.waiting.clear()
        if ready:
            self.now.update((int(status), int(last)))
            self.handle.registerTimer(last + self.ttl_ms)
        elif last is not None and last + self.ttl_ms <= passed:
            self.now.clear()
        if out:
            yield pd.DataFrame(out, columns=["file_md5", "event_id", "before", "after", "legal"])

    def close(self) -> None:
        pass


def status_steps(changes: DataFrame, late: str = "1 hour", ttl_days: int = 30) -> DataFrame:
    """Every change with the status before it (-1: none) and whether it was legal.

    changes: file_md5, event_id, status, ts. Ties in time go by event_id. Changes later than ``late`` are dropped by the watermark.
    """
    at = utc_instant("ts")
    timed = changes.select("file_md5", "event_id", "status", at.alias("at"), F.unix_millis(at).alias("at_ms")).withWatermark("at", late)
    return timed.groupBy("file_md5").transformWithStateInPandas(
        statefulProcessor=StatusProcessor(ttl_days * 86_400_000),
        outputStructType="file_md5 string, event_id bigint, before int, after int, legal boolean", outputMode="Append", timeMode="EventTime",
    )


class ArchiveProcessor(StatefulProcessor):
    """A conversation that has been idle is emitted once, with all its messages in order.

    It ends at its first pause of the idle time, once the watermark is past it. What comes after that, late or repeated, is passed
    over until the marker's life is over.
    """

    def __init__(self, idle_ms: int, ttl_ms: int):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq bigint, role string, content string, at_ms bigint")
        self.mark = handle.getValueState("mark", "last_ms bigint, archived boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        archived = self.mark.get()[1] if self.mark.exists() else False
        for pdf in rows:
            if not archived:
                self.held.appendList([(int(s), r, c, int(a)) for s, r, c, a in zip(pdf["seq"], pdf["role"], pdf["content"], pdf["at_ms"])])
        if not archived:
            last = self._first_session()[-1][0]
            self.mark.update((last, False))
            self.handle.registerTimer(last + self.idle_ms)
        return iter([])

    def _first_session(self) -> list[tuple]:
        """(at, seq, role, content) up to the first pause, in order of time, repeated messages once."""
        rows = sorted({(a, s, r, c) for s, r, c, a in map(tuple, self.held.get())}, key=lambda x: (x[0], x[1], str(x)))
        end = next((i for i in range(1, len(rows)) if rows[i][0] - rows[i - 1][0] >= self.idle_ms), len(rows))
        return rows[:end]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last, archived = self.mark.get() if self.mark.exists() else (None, True)
        if last is None:
            return
        if archived:
            if last + self.ttl_ms <= passed:
                self.mark.clear()
        elif last + self.idle_ms <= passed:  # an earlier timer of a conversation that went on comes too soon
            rows = sorted(self._first_session(), key=lambda x: x[1])
            self.held.clear()
            self.mark.update((last, True))
            self.handle.registerTimer(last + self.ttl_ms)
            yield pd.DataFrame({"conversation_id": key[0], "seq": [r[1] for r in rows], "role": [r[2] for r in rows], "content": [r[3] for r in rows],
                                "at_ms": [r[0] for r in rows], "ended_ms": last})

    def close(self) -> None:
        pass


def archived_sessions(messages: DataFrame, idle_minutes: int = 30, late: str = "1 hour", ttl_days: int = 7) -> DataFrame:
    """Messages (conversation_id, seq, role, content, ts) of conversations that have ended, each conversation once."""
    at = utc_instant("ts")
    timed = messages.select("conversation_id", "seq", "role", "content", at.alias("at"), F.unix_millis(at).alias("at_ms")).withWatermark("at", late)
    return timed.groupBy("conversation_id").transformWithStateInPandas(
        statefulProcessor=ArchiveProcessor(idle_minutes * 60_000, ttl_days * 86_400_000),
        outputStructType="conversation_id bigint, seq bigint, role string, content string, at_ms bigint, ended_ms bigint",
        outputMode="Append", timeMode="EventTime",
    )


def two_sinks(root: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that splits validated requests, read once, into good rows and dead letters with reason and
    position. Both are committed together, so a replayed batch changes neither. `missing` names what a request lacks."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            bad = rows.filter("missing <> ''").withColumns({"reason": F.concat(F.lit("missing: "), "missing"), "attempts": F.lit(0)})
            good = rows.filter("missing = ''").drop("missing")
            commits.commit({"requests": good, "dead": dead_letters(bad)}, rows.select(F.coalesce("file_md5", F.lit("")).alias("file_md5")), root, batch_id)
        finally:
            rows.unpersist()

    return write


def done_markers(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Markers that batches before one have set."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:  # none yet
        return None
    return rows.filter(F.col("batch") < before)


def skip_done(path: str, out: str, ttl: str = "7 days") -> Callable[[DataFrame, int], None]:
    """A batch writer that lets in a file's first request unless the file was finished within the marker's life.

    The table of finished files changes from batch to batch; each batch sees the markers of those before it, so it can be
    repeated. Requests: user_id, file_md5, event_id, ts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        done = done_markers(batch.sparkSession, path, batch_id)
        fresh = batch
        if done is not None:
            last = done.groupBy("file_md5").agg(F.max("done_at").alias("_done_at"))
            fresh = batch.join(last, "file_md5", "left").filter(f"_done_at IS NULL OR _done_at <= ts - INTERVAL {ttl}").drop("_done_at")
        rest = [c for c in fresh.columns if c != "file_md5"]
        first = fresh.groupBy("file_md5").agg(F.min_by(F.struct(*rest), F.struct("ts", "event_id")).alias("r")).select("file_md5", "r.*").persist()
        try:
            first.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            first.select("file_md5", F.col("ts").alias("done_at")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            first.unpersist()

    return write
