"""Which analysis of a page runs, waits and counts: one at a time, the latest request wins, one more may wait.

``open`` shows another image, ``start`` asks for an analysis (``reuse``: with the text that is known), ``finish`` and
``fail`` end the one that runs. Each request has a revision; a result counts only if no later one was asked for and
the image is still the same. Requests that come while one runs are one waiting request; among these a full run beats
one that reuses text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from maskora.streaming import ordered

STATE = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), *((k, pa.int64()) for k in ("image", "revision", "running")), ("waiting", pa.string()), *((k, pa.int64()) for k in ("runs", "published", "superseded", "discarded", "failed", "last_published"))])
STATE_DDL = "doc_id long, seq long, image long, revision long, running long, waiting string, runs long, published long, superseded long, discarded long, failed long, last_published long"


class Flight:
    """One page: its image, the revision of the last request, the run under way ``[revision, image]`` and the request that waits."""

    def __init__(self, data: dict | None = None):
        self.image = self.revision = self.runs = self.published = self.superseded = self.discarded = self.failed = 0
        self.running = self.waiting = self.last_published = None
        if data:
            self.__dict__.update(data)

    def _start(self, reuse: bool) -> None:
        self.revision += 1
        if self.running:
            self.waiting = "reuse" if reuse and self.waiting != "full" else "full"
        else:
            self.running, self.runs = [self.revision, self.image], self.runs + 1

    def apply(self, op: str, p: dict, at_ms: int = 0) -> None:
        """One event. Requests without an image and ends without a run change nothing."""
        if op == "open":
            self.image, self.revision, self.waiting = self.image + 1, self.revision + 1, None
        elif op == "start" and self.image:
            self._start(bool(p.get("reuse")))
        elif op in ("finish", "fail") and self.running:
            revision, image = self.running
            self.running = None
            if op == "fail":
                self.failed += 1
            elif image != self.image:
                self.discarded += 1
            elif revision != self.revision:
                self.superseded += 1
            else:
                self.published, self.last_published = self.published + 1, revision
            if self.waiting:
                reuse, self.waiting = self.waiting == "reuse", None
                self._start(reuse)

    def row(self, doc_id: int, seq: int) -> dict:
        return {"doc_id": doc_id, "seq": seq} | {k: getattr(self, k) for k in STATE.names[2:]} | {"running": self.running and self.running[0]}


def replay(events: DataFrame) -> DataFrame:
    """The state of each page after all its events ``(doc_id, seq, ts, op, payload)``."""
    return ordered.replayed(events, Flight, STATE_DDL, STATE)


def follow(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same over a stream with late events."""
    return ordered.followed(events, Flight, STATE_DDL, delay)
