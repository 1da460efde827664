"""Recognition jobs watched by timers: a notice, a stall, a limit on the whole, and one more attempt.

``start`` begins a job, ``progress`` (``value``) moves it, ``done`` and ``error`` end an attempt. Only a strictly larger
finite value of at most one is a move. An attempt ends without a result when nothing moved for STALL_MS or after CAP_MS;
then, or after an error, the next attempt begins, ATTEMPTS of them at most. Timers fire at their own time, in order,
before the event that shows that it has passed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from maskora.streaming import ordered

NOTICE_MS, STALL_MS, CAP_MS, ATTEMPTS = 25_000, 45_000, 60_000, 2
STATE = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("outcome", pa.string()), *((k, pa.int64()) for k in ("attempt", "jobs", "notices", "stalls", "caps", "timeouts", "results"))])
STATE_DDL = "doc_id long, seq long, outcome string, attempt long, jobs long, notices long, stalls long, caps long, timeouts long, results long"


class Watch:
    """The job of one key; counts are over all its jobs."""

    def __init__(self, data: dict | None = None):
        self.outcome, self.attempt, self.begun, self.moved, self.highest, self.noticed = None, 0, 0, 0, 0.0, False
        self.jobs = self.notices = self.stalls = self.caps = self.timeouts = self.results = 0
        if data:
            self.__dict__.update(data)

    def deadline(self) -> int | None:
        """When the next timer fires."""
        if self.outcome != "running":
            return None
        ends = min(self.moved + STALL_MS, self.begun + CAP_MS)
        return ends if self.noticed else min(ends, self.begun + NOTICE_MS)

    def advance(self, now_ms: int) -> None:
        """Fire the timers up to ``now_ms``."""
        while (due := self.deadline()) is not None and due <= now_ms:
            if not self.noticed and due == self.begun + NOTICE_MS:
                self.noticed, self.notices = True, self.notices + 1
                continue
            if due == self.moved + STALL_MS:
                self.stalls += 1
            else:
                self.caps += 1
            self._next(due, "timeout")

    def _next(self, at_ms: int, otherwise: str) -> None:
        if self.attempt < ATTEMPTS:
            self._begin(at_ms, self.attempt + 1)
        else:
            self.outcome = otherwise
            self.timeouts += otherwise == "timeout"

    def _begin(self, at_ms: int, attempt: int) -> None:
        self.outcome, self.attempt, self.begun, self.moved, self.highest, self.noticed = "running", attempt, at_ms, at_ms, 0.0, False

    def apply(self, op: str, p: dict, at_ms: int) -> None:
        self.advance(at_ms)
        if op == "start":
            self.jobs += 1
            self._begin(at_ms, 1)
        elif self.outcome != "running":
            return
        elif op == "progress":
            value = p.get("value")
            if value is not None and math.isfinite(value) and self.highest < value <= 1:
                self.highest, self.moved = value, at_ms
        elif op == "done":
            self.outcome, self.results = "done", self.results + 1
        elif op == "error":
            self._next(at_ms, "failed")

    def row(self, doc_id: int, seq: int) -> dict:
        return {"doc_id": doc_id, "seq": seq} | {k: getattr(self, k) for k in STATE.names[2:]}


def replay(events: DataFrame) -> DataFrame:
    """The state of each job's key after all its events ``(doc_id, seq, ts, op, payload)``; timers run up to the last event."""
    return ordered.replayed(events, Watch, STATE_DDL, STATE)


def follow(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The same over a stream, on the events' own clock."""
    return ordered.followed(events, Watch, STATE_DDL, delay)


def alarms(events: DataFrame, clock=None) -> DataFrame:
    """The state after each change over a stream, on the machine's clock: timers fire without events, by processing time.

    Events count when they come. ``clock`` turns Spark's milliseconds into those of the timers, for tests.
    """
    clock = clock or (lambda ms: ms)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, seq = json.loads(state.get[0]) if state.exists else (None, 0)
        w, real = Watch(held), state.getCurrentProcessingTimeMs()
        now, before = clock(real), json.dumps(held)
        for b in batches:
            for n, op, payload in sorted(zip(b["seq"], b["op"], b["payload"], strict=True), key=lambda e: e[0]):
                w.apply(op, json.loads(payload) if payload else {}, now)
                seq = int(n)
        w.advance(now)
        state.update((json.dumps([w.__dict__, seq]),))
        if (due := w.deadline()) is not None:
            state.setTimeoutDuration(max(1, due - now))
        if json.dumps(w.__dict__) != before:
            yield pd.DataFrame([w.row(key[0], seq)])

    rows = events.select("doc_id", "seq", "op", F.coalesce("payload", F.lit("")).alias("payload"))
    return rows.groupBy("doc_id").applyInPandasWithState(run, STATE_DDL, "held string", "update", GroupStateTimeout.ProcessingTimeTimeout)
