"""Keyed state with processing time: retries, chat history, rate counters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia import constants as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HistoryProcessor(StatefulProcessor):
    """The last messages of a conversation; all of them expire after the time to live."""

    def __init__(self, keep: int = C.HISTORY_KEEP, ttl_ms: int = C.DONE_TTL_DAYS * 86_400_000):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "seq bigint, role string, content string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.items.get()] if self.items.exists() else []
        for pdf in rows:
            held += list(pdf[["seq", "role", "content"]].itertuples(index=False, name=None))
            held = sorted(held, key=lambda r: r[0])[-self.keep:]
        held = [(int(s), r, c) for s, r, c in held]
        self.items.put(held)  # writing again renews the life of every kept message
        yield pd.DataFrame({"conversation_id": [key[0]] * len(held), "seq": [h[0] for h in held], "role": [h[1] for h in held], "content": [h[2] for h in held]})

    def close(self) -> None:
        pass


def chat_history(messages: DataFrame, keep: int = C.HISTORY_KEEP) -> DataFrame:
    """Per conversation the current history, emitted after each batch that touches it."""
    return messages.groupBy("conversation_id").transformWithStateInPandas(
        statefulProcessor=HistoryProcessor(keep), outputStructType="conversation_id bigint, seq bigint, role string, content string",
        outputMode="Update", timeMode="ProcessingTime",
    )


class RateProcessor(StatefulProcessor):
    """The first event opens a window; events past the limit inside it are rejected.

    A timer at the window's end drops its state, so idle users cost nothing.
    """

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened double, n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        opened, n = self.window.get() if self.window.exists() else (float("-inf"), 0)
        # a user's events of one micro-batch come in several frames; the rule needs them in one order
        pdf = pd.concat([f[["at", "event_id"]] for f in rows]).sort_values(["at", "event_id"])
        verdict = []
        for at in pdf["at"]:
            if at >= opened + self.window_s:
                opened, n = float(at), 0
            n += 1
            verdict.append(n <= self.limit)
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"].to_numpy(), "allowed": verdict})
        self.window.update((float(opened), int(n)))
        self.handle.registerTimer(math.ceil((opened + self.window_s) * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.window.exists() and (self.window.get()[0] + self.window_s) * 1000 <= timerValues.getCurrentWatermarkInMs():
            self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, limit: int, window_s: int, late: str = "10 minutes") -> DataFrame:
    """M08 as a stream: events need user_id, event_id and `at` (seconds); micro-batches come in order of time.

    Events later than `late` behind the newest get no verdict, as their window is gone.
    """
    timed = events.withColumn("_at", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("_at", late)
    return timed.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=RateProcessor(limit, window_s), outputStructType="user_id bigint, event_id bigint, allowed boolean",
        outputMode="Append", timeMode="EventTime",
    )


def rate_limited_batch(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """M08 in batch: the same verdicts in one ordered pass per burst.

    A pause of a whole window always opens a new one, so a user's events split into bursts at such
    pauses and bursts are spread over tasks; a task keeps only the open window while it scans.
    """
    pos = F.floor(F.col("at") / window_s).cast("long")
    slots = events.select("user_id", pos.alias("slot"), "at").groupBy("user_id", "slot").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    # one row per user and slot of one window's length: a burst starts where the slot before is too old
    w = W.partitionBy("user_id").orderBy("slot")
    starts = slots.withColumn("gap", F.col("lo") - F.lag("hi").over(w) >= window_s)
    bursts = starts.withColumn("burst", F.sum(F.coalesce(F.col("gap"), F.lit(True)).cast("int")).over(w)).select("user_id", "slot", "burst")
    rows = events.withColumn("slot", pos).join(bursts, ["user_id", "slot"]).select("user_id", "burst", "at", "event_id")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, opened, n = None, float("-inf"), 0
        for pdf in frames:
            verdict = []
            for user, burst, at in zip(pdf["user_id"], pdf["burst"], pdf["at"]):
                if (user, burst) != key:
                    key, opened = (user, burst), float("-inf")
                if at >= opened + window_s:
                    opened, n = at, 0
                n += 1
                verdict.append(n <= limit)
            yield pdf[["user_id", "event_id"]].assign(allowed=verdict)

    return rows.repartition("user_id", "burst").sortWithinPartitions("user_id", "burst", "at", "event_id").mapInPandas(
        scan, "user_id bigint, event_id bigint, allowed boolean"
    )


class RetryProcessor(StatefulProcessor):
    """Run a request up to `attempts` times with 2^n second pauses, then give it up."""

    def __init__(self, work: Callable[[str], bool], attempts: int = 3):
        self.work, self.attempts = work, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tried = handle.getValueState("tried", "n int")

    def _attempt(self, key: Any, now_ms: int) -> pd.DataFrame:
        n = (self.tried.get()[0] if self.tried.exists() else 0) + 1
        try:
            ok, reason = bool(self.work(key[0])), "handler returned false"
        except Exception as e:
            ok, reason = False, f"{type(e).__name__}: {e}"
        if ok or n >= self.attempts:
            self.tried.clear()
        else:
            self.tried.update((n,))
            self.handle.registerTimer(now_ms + 1000 * 2 ** n)
        status = C.STATUS_DONE if ok else C.STATUS_FAILED if n >= self.attempts else C.STATUS_PROCESSING
        return pd.DataFrame({"file_md5": [key[0]], "attempts": [n], "status": [status], "reason": ["" if ok else reason]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.tried.exists():  # a request whose retry is pending is not started a second time
            yield self._attempt(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._attempt(key, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def with_retries(requests: DataFrame, work: Callable[[str], bool], attempts: int = 3) -> DataFrame:
    """Outcomes per attempt; rows with the failed status go to the dead letters."""
    return requests.groupBy("file_md5").transformWithStateInPandas(
        statefulProcessor=RetryProcessor(work, attempts), outputStructType="file_md5 string, attempts int, status int, reason string",
        outputMode="Append", timeMode="ProcessingTime",
    )
