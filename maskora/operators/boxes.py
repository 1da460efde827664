"""Order-dependent reductions of a page's boxes and lines.

Each looks at one document at a time and its result depends on the order of what it has merged so far, so no join
or window expresses it. Spark brings a page's rows together and in order; on most pages no two rows are near enough to
be one, which is seen on whole batches of columns, and such rows pass as they are. Only the others are folded, row by
row in Python. A document is one page; its rows fit a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Which box's label and type stay when two are one.
PRIORITY = {"pii": 100, "company": 90, "person": 80, "custom": 70, "manual": 60, "avatar": 50, "face": 40}
PHOTO = {"face", "avatar"}
_TITLED = re.compile("(?:様|さま|さん|サン|君|くん|ちゃん|氏|殿)$")
_CJK = re.compile("[々〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")


def _union(a: dict, b: dict) -> dict:
    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
    return {"x": x, "y": y, "w": max(a["x"] + a["w"], b["x"] + b["w"]) - x, "h": max(a["y"] + a["h"], b["y"] + b["h"]) - y}


def _is_same(a: dict, b: dict) -> bool:
    if any(bool(a[k]) != bool(b[k]) for k in ("is_manual", "enabled")) or (a["rotation"] or 0) != (b["rotation"] or 0):
        return False
    if (a["type"] in PHOTO) != (b["type"] in PHOTO):
        return False
    dx = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    dy = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    if dx <= 0 or dy <= 0:
        return False
    row = dy / max(1, min(a["h"], b["h"])) >= 0.85 and min(a["h"], b["h"]) / max(a["h"], b["h"], 1) >= 0.75
    return dx * dy / min(a["w"] * a["h"], b["w"] * b["h"]) >= 0.85 and (a["type"] in PHOTO or row)


def dedupe_page(rows: list[dict]) -> list[dict]:
    """One box where several say the same: by priority, the first that a box coincides with takes it in."""
    kept: list[dict] = []
    for b in sorted(rows, key=lambda r: (-PRIORITY.get(r["type"], 0), r["seq"])):
        same = next((i for i, r in enumerate(kept) if _is_same(r, b)), None)
        if same is None:
            kept.append(b)
        else:
            kept[same] = kept[same] | _union(kept[same], b) | {"text": kept[same]["text"] or b["text"]}
    return kept


def _adjacent(a: dict, b: dict) -> bool:
    if a["type"] != b["type"] or b["is_manual"]:
        return False
    overlap = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    if overlap / (min(a["h"], b["h"]) or 1) < 0.85 or abs(a["h"] - b["h"]) / max(a["h"], b["h"], 1) > 0.5:
        return False
    left, right = (a, b) if a["x"] <= b["x"] else (b, a)
    if not -0.3 * max(a["h"], b["h"]) <= right["x"] - left["x"] - left["w"] <= 2:
        return False
    return a["type"] != "person" or not any(_TITLED.search(r["text"] or "") for r in (a, b))


def _grow(rows: list[dict], near, join, fixed=lambda r: False) -> list[dict]:
    """Each row in turn takes in those near it, pass after pass over the rest, until none is."""
    left, out = list(rows), []
    while left:
        acc = left.pop(0)
        grown = not fixed(acc)
        while grown:
            grown, rest = False, []
            for r in left:
                if near(acc, r):
                    acc, grown = join(acc, r), True
                else:
                    rest.append(r)
            left = rest
        out.append(acc)
    return out


def merge_adjacent_page(rows: list[dict]) -> list[dict]:
    return _grow(sorted(rows, key=lambda r: r["seq"]), _adjacent, lambda a, b: a | _union(a, b) | {"text": (a["text"] or "") + (b["text"] or "")}, lambda r: r["type"] not in ("person", "company", "pii", "custom") or r["is_manual"])


def _fragments(a: dict, b: dict) -> bool:
    ha, hb = max(1, a["y1"] - a["y0"]), max(1, b["y1"] - b["y0"])
    overlap = max(0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])) / max(1, min(ha, hb))
    left, right = (a, b) if a["x0"] <= b["x0"] else (b, a)
    return overlap >= 0.68 and abs(ha - hb) / max(ha, hb) <= 0.35 and -0.25 * max(ha, hb) <= right["x0"] - left["x1"] <= 1.15 * max(ha, hb)


def _join_lines(a: dict, b: dict) -> dict:
    left, right = (a, b) if a["x0"] <= b["x0"] else (b, a)
    tall = max(1, a["y1"] - a["y0"], b["y1"] - b["y0"])
    gap = right["x0"] - left["x1"] > tall * 0.35 and not _CJK.match(left["text"][-1:]) and not _CJK.match(right["text"][:1])
    more = {k: (left[k] or []) + (right[k] or []) for k in ("words", "symbols", "aligned") if k in a}
    if gap and more.get("aligned") is not None:
        between = {"text": " ", "bbox": {"x0": left["x1"], "y0": left["y0"], "x1": right["x0"], "y1": left["y1"]}, "confidence": 0.0}
        more["aligned"] = (left["aligned"] or []) + [between] + (right["aligned"] or [])
    if "raw_text" in a:
        more["raw_text"] = (left["raw_text"] or "") + " " * gap + (right["raw_text"] or "")
    return a | more | {"text": left["text"] + " " * gap + right["text"], "x0": min(a["x0"], b["x0"]), "y0": min(a["y0"], b["y0"]), "x1": max(a["x1"], b["x1"]), "y1": max(a["y1"], b["y1"]), "confidence": (a["confidence"] + b["confidence"]) / 2}


def merge_fragments_page(rows: list[dict]) -> list[dict]:
    """Pieces of one line joined. Pieces are taken by rows (centres within 4 px of the row's first are one row), then from the left."""
    by_centre = sorted(rows, key=lambda r: ((r["y0"] + r["y1"]) / 2, r["x0"], r["line_no"]))
    ordered, row = [], []
    for r in by_centre:
        if row and (r["y0"] + r["y1"] - row[0]["y0"] - row[0]["y1"]) / 2 > 4:
            ordered += sorted(row, key=lambda x: (x["x0"], x["line_no"]))
            row = []
        row.append(r)
    ordered += sorted(row, key=lambda x: (x["x0"], x["line_no"]))
    return _grow(ordered, _fragments, _join_lines)


@dataclass(frozen=True)
class _Fold:
    """A reduction of a page: what it does to rows, what it reads and changes of them, and whether any two of a page may be one.

    ``may_join`` takes column getters of earlier and later rows; a page without such a pair stays as it is.
    """

    page: Callable[[list[dict]], list[dict]]
    columns: tuple[str, ...]
    may_join: Callable[[Callable, Callable], np.ndarray]
    order: str


def _may_be_same(a, b) -> np.ndarray:
    dx = np.minimum(a("x") + a("w"), b("x") + b("w")) - np.maximum(a("x"), b("x"))
    dy = np.minimum(a("y") + a("h"), b("y") + b("h")) - np.maximum(a("y"), b("y"))
    share = dx * dy >= 0.849 * np.minimum(a("w") * a("h"), b("w") * b("h"))  # a little wide: the fold decides
    return (dx > 0) & (dy > 0) & share


def _may_be_adjacent(a, b) -> np.ndarray:
    low, high = np.minimum(a("h"), b("h")), np.maximum(a("h"), b("h"))
    overlap = np.minimum(a("y") + a("h"), b("y") + b("h")) - np.maximum(a("y"), b("y"))
    first = a("x") <= b("x")
    gap = np.where(first, b("x") - a("x") - a("w"), a("x") - b("x") - b("w"))
    return (overlap >= 0.849 * np.where(low == 0, 1, low)) & (gap >= -0.301 * high) & (gap <= 2) | (low < 0)


def _may_be_fragments(a, b) -> np.ndarray:
    ha, hb = np.maximum(1, a("y1") - a("y0")), np.maximum(1, b("y1") - b("y0"))
    overlap = np.minimum(a("y1"), b("y1")) - np.maximum(a("y0"), b("y0"))
    gap = np.where(a("x0") <= b("x0"), b("x0") - a("x1"), a("x0") - b("x1"))
    high = np.maximum(ha, hb)
    return (overlap >= 0.679 * np.minimum(ha, hb)) & (gap >= -0.251 * high) & (gap <= 1.151 * high)


_DEDUPE = _Fold(dedupe_page, ("type", "seq", "is_manual", "enabled", "rotation", "x", "y", "w", "h", "text"), _may_be_same, "seq")
_ADJACENT = _Fold(merge_adjacent_page, ("type", "seq", "is_manual", "x", "y", "w", "h", "text"), _may_be_adjacent, "seq")
_FRAGMENTS = _Fold(merge_fragments_page, ("line_no", "text", "x0", "y0", "x1", "y1", "confidence", "words", "symbols", "aligned", "raw_text"), _may_be_fragments, "line_no")


def _joining(rows: pa.RecordBatch, place: np.ndarray, may_join) -> np.ndarray:
    """For each row of whole pages whether two rows of its page may be one. ``place`` counts a page's rows from 1."""
    page = np.cumsum(place == 1) - 1
    found, known = np.zeros(page[-1] + 1, bool), {}

    def numbers(name: str) -> np.ndarray:
        if name not in known:
            known[name] = rows[name].cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        return known[name]

    later, apart = np.flatnonzero(place > 1), 1
    while len(later):
        earlier = later - apart
        found[page[later[may_join(lambda k: numbers(k)[earlier], lambda k: numbers(k)[later])]]] = True  # noqa: B023
        apart += 1
        later = later[(place[later] > apart) & ~found[page[later]]]
    return found[page]


def _folded(rows: pa.RecordBatch, place: np.ndarray, fold: _Fold) -> pa.RecordBatch:
    """The rows of whole pages after the fold. Columns that it does not know come from the row that took in the others."""
    own = [c for c in fold.columns if c in rows.schema.names]
    values = [rows[c].to_pylist() for c in own]
    dicts = [dict(zip(own, v, strict=True), _at=i) for i, v in enumerate(zip(*values, strict=True))]
    starts = [*np.flatnonzero(place == 1).tolist(), len(dicts)]
    out = [r for i, j in zip(starts, starts[1:], strict=False) for r in fold.page(dicts[i:j])]
    kept = rows.take(pa.array([r["_at"] for r in out], pa.int64()))
    columns = [pa.array([r[f.name] for r in out], f.type) if f.name in own else kept[f.name] for f in rows.schema]
    return pa.RecordBatch.from_arrays(columns, schema=rows.schema)


def _by_page(df: DataFrame, fold: _Fold) -> DataFrame:
    """``fold`` on each document's rows. Pages are small and many, so a batch of them crosses to Python at once; one that a batch's end cuts waits for its rest."""
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy(fold.order)))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b["_place"].to_numpy() == 1)
            if len(starts) and (waiting or starts[-1] > 0):
                yield pa.concat_batches([*waiting, b.slice(0, starts[-1])])
                waiting = []
            waiting.append(b.slice(starts[-1]) if len(starts) else b)
        if waiting:
            yield pa.concat_batches(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pages(batches):
            if not b.num_rows:
                continue
            place, rows = b["_place"].to_numpy(), b.drop_columns(["_place"])
            joining = _joining(rows, place, fold.may_join)
            if not joining.all():
                yield rows.filter(pa.array(~joining))
            if joining.any():
                yield _folded(rows.filter(pa.array(joining)), place[joining], fold)

    return placed.mapInArrow(run, df.schema)


def dedupe_boxes(boxes: DataFrame) -> DataFrame:
    """``boxes(doc_id, box_id, seq, type, label, text, x, y, w, h, rotation, enabled, is_manual, ...)`` without duplicates."""
    return _by_page(boxes, _DEDUPE)


def merge_adjacent(boxes: DataFrame) -> DataFrame:
    return _by_page(boxes, _ADJACENT)


def merge_fragments(lines: DataFrame) -> DataFrame:
    return _by_page(lines, _FRAGMENTS)
