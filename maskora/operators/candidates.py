"""Picture candidates against text and against each other: overlap by grid cells, and greedy suppression.

Candidates are ``(doc_id, cand_id, x, y, w, h, confidence)``. Two areas overlap by ``share`` if their common area is at
least that part of the smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a grid cell in pixels. An area is dealt to the cells that it covers.
CELL = 64
TEXT_SHARE, NATIVE_SHARE, PHOTO_SHARE, MOST = 0.15, 0.5, 0.3, 20


def overlaps(a: dict[str, Column], b: dict[str, Column], share: float) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return (wide > 0) & (high > 0) & (wide * high >= F.least(a["w"] * a["h"], b["w"] * b["h"]) * share)


def _celled(areas: DataFrame) -> DataFrame:
    """A row for each cell that an area with a positive width and height covers."""
    cells = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / CELL), F.floor((F.col(at) + F.col(size)) / CELL)))
    return areas.filter("w > 0 AND h > 0").withColumn("cell_x", cells("x", "w")).withColumn("cell_y", cells("y", "h"))


def apart_from(candidates: DataFrame, others: DataFrame, share: float = TEXT_SHARE) -> DataFrame:
    """The candidates that overlap no area ``others(doc_id, x, y, w, h)`` of their document by ``share``.

    Areas meet in grid cells, so what is compared are neighbours, not all pairs of a page. Areas without a size, and
    those with nulls, overlap nothing.
    """
    a, b = _celled(candidates.select("doc_id", "cand_id", "x", "y", "w", "h")).alias("a"), _celled(others.select("doc_id", "x", "y", "w", "h")).alias("b")
    at = lambda side: {k: F.col(f"{side}.{k}") for k in "xywh"}
    same_cell = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("doc_id", "cell_x", "cell_y")]
    meets = same_cell[0] & same_cell[1] & same_cell[2] & overlaps(at("a"), at("b"), share)
    hit = a.join(b, meets, "left_semi").select("doc_id", "cand_id").distinct()
    return candidates.join(hit, ["doc_id", "cand_id"], "left_anti")


def _share(a, b) -> float:
    wide, high = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return wide * high / min(a[2] * a[3], b[2] * b[3]) if wide > 0 and high > 0 else 0.0


def suppressed(candidates: DataFrame, share: float = PHOTO_SHARE, most: int = MOST) -> DataFrame:
    """``(doc_id, cand_id, place)``: of candidates that overlap the most confident stays, ``most`` of a document at most.

    Candidates come in order of confidence (ties by cand_id), and one stays if it overlaps none that stayed before it;
    ``most`` is the feature's own limit. A task holds the areas that stayed in one document, however many it is offered.
    """
    rows = candidates.select("doc_id", "cand_id", F.array(*(F.col(k).cast("double") for k in "xywh")).alias("area"), F.col("confidence").cast("double").alias("confidence"))
    rows = rows.filter("confidence IS NOT NULL AND forall(area, v -> v IS NOT NULL)")
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("confidence"), "cand_id").select("doc_id", "cand_id", "area")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, kept = None, []
        for b in batches:
            out = []
            for d, i, area in zip(*(b[c].to_pylist() for c in ("doc_id", "cand_id", "area")), strict=True):
                if d != doc:
                    doc, kept = d, []
                if len(kept) < most and all(_share(area, k) < share for k in kept):
                    kept.append(area)
                    out.append((d, i, len(kept)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field("doc_id").type), pa.array(columns[1], b.schema.field("cand_id").type), pa.array(columns[2], pa.int32())], ["doc_id", "cand_id", "place"])

    kinds = dict(rows.dtypes)
    return ordered.mapInArrow(run, f"doc_id {kinds['doc_id']}, cand_id {kinds['cand_id']}, place int")


def accepted(candidates: DataFrame, texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The candidates that stay: clear of text, then the best of those that overlap, then clear of ``known`` faces."""
    clear = apart_from(candidates, texts, TEXT_SHARE)
    best = clear.join(suppressed(clear).select("doc_id", "cand_id"), ["doc_id", "cand_id"], "left_semi")
    return best if known is None else apart_from(best, known, PHOTO_SHARE)
