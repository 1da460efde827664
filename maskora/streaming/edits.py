"""Edit history of a page's boxes and shapes: one state machine, run over a table or a stream.

Events are ``(doc_id, seq, ts, op, payload)`` with a JSON payload. A document's events are one key and are taken in
order of ``seq``; the state is its boxes, shapes, selection and at most HISTORY snapshots.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskora.streaming import ordered

HISTORY = 30
LEAST_SIDE, LEAST_WIDTH = 5, 8
STATE_DDL = "doc_id long, seq long, boxes string, shapes string, selected string, anchor string, depth int, can_undo boolean, can_redo boolean"


STATE = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), *((k, pa.string()) for k in ("boxes", "shapes", "selected", "anchor")), ("depth", pa.int32()), ("can_undo", pa.bool_()), ("can_redo", pa.bool_())])


class Page:
    """The state of one document."""

    def __init__(self, data: dict | None = None):
        self.boxes, self.shapes, self.selected, self.anchor = [], [], [], None
        self.history, self.at, self.dragged = [{"boxes": [], "shapes": []}], 0, False
        if data:
            self.__dict__.update(data)

    def _commit(self) -> None:
        snapshot = json.loads(json.dumps({"boxes": self.boxes, "shapes": self.shapes}))
        self.history = (self.history[: self.at + 1] + [snapshot])[-HISTORY:]
        self.at = len(self.history) - 1

    def _prune(self) -> None:
        ids = {b["id"] for b in self.boxes}
        self.selected = [i for i in self.selected if i in ids]
        if self.anchor not in ids:
            self.anchor = self.selected[-1] if self.selected else None

    def _select(self, ids: list, anchor: str | None) -> None:
        """Boxes that exist, each once; the anchor is the one given, if it is among them, else the last."""
        known = {b["id"] for b in self.boxes}
        self.selected = [i for i in dict.fromkeys(ids) if i in known]
        self.anchor = anchor if anchor in self.selected else (self.selected[-1] if self.selected else None)

    def _drag_edge(self, p: dict) -> None:
        """One end of a box follows ``x`` while the other stays at ``fixed``; beyond it the box turns over. History gets one step, on release."""
        left, wide = min(p["x"], p["fixed"]), max(LEAST_WIDTH, abs(p["x"] - p["fixed"]))
        for b in self.boxes:
            x, y, w, h = b["rect"]
            if b["id"] == p["id"] and (abs(left - x) >= 0.5 or abs(wide - w) >= 0.5):
                self.boxes = [o | {"rect": [left, y, wide, h]} if o is b else o for o in self.boxes]
                self.dragged = True
                return

    def _move(self, to: int) -> None:
        if 0 <= to < len(self.history):
            self.at = to
            self.boxes, self.shapes = (json.loads(json.dumps(self.history[to][k])) for k in ("boxes", "shapes"))
            self._prune()

    def apply(self, op: str, p: dict, at_ms: int = 0) -> None:
        """One event. Unknown operations and events without effect change nothing and leave no history."""
        ids = p.get("ids") or ([p["id"]] if "id" in p else [])
        record = p.get("record", True)
        if op == "open":
            self.__init__()
        elif op == "add" and min(p["rect"][2:]) >= LEAST_SIDE:
            self.boxes = [*self.boxes, {"id": p["id"], "type": "manual", "label": p.get("label", "手動"), "rect": p["rect"], "enabled": True}]
            self.selected, self.anchor = [p["id"]], p["id"]
            self._commit()
        elif op == "set":
            self.boxes, self.selected, self.anchor = p["boxes"], [], None
            self._commit()
        elif op == "update" and any(b["id"] in ids for b in self.boxes):
            self.boxes = [b | p["patch"] if b["id"] in ids else b for b in self.boxes]
            if record:
                self._commit()
        elif op == "toggle":
            self.boxes = [b | {"enabled": not b["enabled"]} if b["id"] in ids else b for b in self.boxes]
            self._commit()
        elif op == "protect" and any(b["id"] in ids for b in self.boxes):
            on = not any(b["enabled"] for b in self.boxes if b["id"] in ids)
            self.boxes = [b | {"enabled": on} if b["id"] in ids else b for b in self.boxes]
            self._commit()
        elif op == "merge":
            self.boxes = [b | {"rect": p["rect"]} if b["id"] == p["keep"] else b for b in self.boxes if b["id"] not in p["remove"]]
            self._prune()
            self._commit()
        elif op in ("remove", "clear"):
            left = [] if op == "clear" else [b for b in self.boxes if b["id"] not in ids]
            if len(left) < len(self.boxes):
                self.boxes = left
                self._prune()
                self._commit()
        elif op == "select":
            self._select(ids, p.get("anchor"))
        elif op == "toggle_select":
            on = p["id"] not in self.selected
            self._select([*self.selected, p["id"]] if on else [i for i in self.selected if i != p["id"]], p["id"] if on else self.anchor)
        elif op == "marquee":
            self._select([*p.get("base", []), *ids], self.anchor)
        elif op == "select_all":
            self._select([b["id"] for b in self.boxes], self.anchor)
        elif op == "drag_edge":
            self._drag_edge(p)
        elif op == "drop_edge":
            if self.dragged:
                self._commit()
            self.dragged = False
        elif op == "add_shape":
            self.shapes = [*self.shapes, p["shape"]]
            self._commit()
        elif op == "update_shape" and any(s["id"] in ids for s in self.shapes):
            self.shapes = [s | p["patch"] if s["id"] in ids else s for s in self.shapes]
            if record:
                self._commit()
        elif op == "remove_shape" and any(s["id"] in ids for s in self.shapes):
            self.shapes = [s for s in self.shapes if s["id"] not in ids]
            self._commit()
        elif op == "commit":
            self._commit()
        elif op in ("undo", "redo"):
            self._move(self.at + (1 if op == "redo" else -1))

    def row(self, doc_id: int, seq: int) -> dict:
        text = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True)
        return {"doc_id": doc_id, "seq": seq, "boxes": text(self.boxes), "shapes": text(self.shapes), "selected": text(self.selected), "anchor": self.anchor, "depth": len(self.history), "can_undo": self.at > 0, "can_redo": self.at < len(self.history) - 1}


def replay(edits: DataFrame) -> DataFrame:
    """The state of each document after all its events ``(doc_id, seq, ts, op, payload)``."""
    return ordered.replayed(edits, Page, STATE_DDL, STATE)


def follow(edits: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The same over a stream with late events: the new state of a document whenever the watermark has released some of its events."""
    return ordered.followed(edits, Page, STATE_DDL, delay)


def stalled_jobs(progress: DataFrame, stall_s: int = 45, cap_s: int = 60) -> DataFrame:
    """``(job_id, gap_s, total_s, stalled, over_cap)`` of progress events ``(job_id, ts, progress)``.

    Only a strictly larger finite progress of at most one counts as movement.
    """
    progress = progress.withColumn("ts", F.col("ts").cast("timestamp"))
    order = Window.partitionBy("job_id").orderBy("ts", "progress")
    best = F.max("progress").over(order.rowsBetween(Window.unboundedPreceding, -1))
    valid = F.col("progress").isNotNull() & ~F.isnan("progress") & F.col("progress").between(0, 1)
    moves = progress.filter(valid).withColumn("best", best).filter(F.col("best").isNull() | (F.col("progress") > F.col("best")))
    gaps = moves.withColumn("gap", F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order))
    last = progress.groupBy("job_id").agg(F.max(F.unix_micros("ts")).alias("end"), F.min(F.unix_micros("ts")).alias("begin"))
    sums = gaps.groupBy("job_id").agg(F.max("gap").alias("gap"), F.max(F.unix_micros("ts")).alias("moved"))
    found = last.join(sums, "job_id", "left").select("job_id", (F.greatest(F.coalesce("gap", F.lit(0)), F.col("end") - F.coalesce("moved", "begin")) / 1e6).alias("gap_s"), ((F.col("end") - F.col("begin")) / 1e6).alias("total_s"))
    return found.withColumns({"stalled": F.col("gap_s") >= stall_s, "over_cap": F.col("total_s") >= cap_s})
