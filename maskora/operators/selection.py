"""Bulk edits of the chosen boxes of each page, and small rules around drawing and export.

``chosen`` is a boolean column of the boxes. What a rule asks of the whole selection is a window over the page,
so an edit costs one exchange by page at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators.layout import round_half_up

#: One step is this share of a box's height; label sizes go from 0.4 to 1.6 in tenths.
STEP, SMALLEST, LABEL_LOW, LABEL_HIGH, LABEL_STEP = 0.12, 4, 0.4, 1.6, 0.1


def _page() -> WindowSpec:
    return Window.partitionBy("doc_id")


def toggle_protection(boxes: DataFrame, chosen: Column) -> DataFrame:
    """If any chosen box of a page is enabled, all chosen ones are disabled; else all are enabled."""
    rows = boxes.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    rows = rows.withColumn("_on", F.bool_or(F.col("_chosen") & F.col("enabled")).over(_page()))
    return rows.withColumn("enabled", F.when(F.col("_chosen"), ~F.coalesce("_on", F.lit(False))).otherwise(F.col("enabled"))).drop("_chosen", "_on")


def relabel(boxes: DataFrame, chosen: Column, label: str, touched: bool = False) -> DataFrame:
    """Chosen boxes get a label and its reason. Mixed labels stay unless the field was touched; equal ones are no change."""
    old = F.when(F.coalesce(chosen, F.lit(False)), F.coalesce("label", F.lit("")))
    rows = boxes.withColumn("_old", old).withColumns({"_low": F.min("_old").over(_page()), "_high": F.max("_old").over(_page())})
    change = F.coalesce((F.lit(touched) | (F.col("_low") == F.col("_high"))) & (F.col("_old") != label), F.lit(False))
    reason = F.col("reason") if "reason" in boxes.columns else F.lit(None).cast("string")
    rows = rows.withColumns({"label": F.when(change, label).otherwise(F.col("label")), "reason": F.when(change, f"ユーザー指定 ({label or '文字なし'})").otherwise(reason)})
    return rows.drop("_old", "_low", "_high")


def more_with_label(boxes: DataFrame, chosen: Column) -> DataFrame:
    """``(doc_id, label, more)``: where all chosen boxes of a page share a label, how many others have it too."""
    rows = boxes.select("doc_id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce(chosen, F.lit(False)).alias("chosen"))
    counts = rows.groupBy("doc_id", "label").agg(F.count_if("chosen").alias("own"), F.count_if(~F.col("chosen")).alias("more")).filter("own > 0")
    return counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("labels"), F.first("label").alias("label"), F.first("more").alias("more")).filter("labels = 1").select("doc_id", "label", "more")


def _vertical(boxes: DataFrame, chosen: Column, y: Column, h: Column, page_height: Column) -> DataFrame:
    new_h = F.greatest(F.lit(float(SMALLEST)), F.least(page_height, h))
    new_y = F.greatest(F.lit(0.0), F.least(page_height - new_h, y))
    moved = F.coalesce(chosen, F.lit(False)) & ((F.abs(new_y - F.col("y")) >= 0.5) | (F.abs(new_h - F.col("h")) >= 0.5))
    return boxes.withColumns({"y": F.when(moved, new_y).otherwise(F.col("y")), "h": F.when(moved, new_h).otherwise(F.col("h"))})


def _step(h: Column) -> Column:
    return F.greatest(F.lit(1.0), round_half_up(h * STEP).cast("double"))


def step_thickness(boxes: DataFrame, chosen: Column, direction: int, page_height: Column) -> DataFrame:
    """One step thicker or thinner about the middle, inside the page; changes below half a pixel are none."""
    h = F.greatest(F.lit(float(SMALLEST)), F.col("h") + _step(F.col("h")) * direction)
    return _vertical(boxes, chosen, F.col("y") + (F.col("h") - h) / 2, h, page_height)


def step_down(boxes: DataFrame, chosen: Column, direction: int, page_height: Column) -> DataFrame:
    """One step down (or up, at -1), inside the page."""
    return _vertical(boxes, chosen, F.col("y") + _step(F.col("h")) * direction, F.col("h"), page_height)


def step_label_scale(boxes: DataFrame, chosen: Column, direction: int) -> DataFrame:
    """The chosen boxes' ``label_scale`` (null: 1) a tenth up or down, within its limits."""
    now = F.coalesce("label_scale", F.lit(1.0))
    new = round_half_up(F.greatest(F.lit(LABEL_LOW), F.least(F.lit(LABEL_HIGH), now + LABEL_STEP * direction)) * 10) / 10
    return boxes.withColumn("label_scale", F.when(F.coalesce(chosen, F.lit(False)) & (new != now), new).otherwise(F.col("label_scale")))


def without_rotation(boxes: DataFrame) -> DataFrame:
    """All rotations cleared on the pages where any is larger than a tenth of a degree."""
    turned = F.max(F.abs(F.coalesce("rotation", F.lit(0.0)))).over(_page()) > 0.1
    return boxes.withColumn("rotation", F.when(turned, F.lit(None).cast("double")).otherwise(F.col("rotation")))


def stroke_rotation(snapped: Column, page_angle: Column, follow: Column) -> Column:
    """A stroke's rotation: the snapped line's, else the page's; none if slopes are not followed or below 0.1 degrees."""
    angle = F.coalesce(snapped, page_angle)
    return F.when(follow & (F.abs(angle) >= 0.1), angle)


def image_point(client: Column, origin: Column, shown: Column, pixels: Column) -> Column:
    """A coordinate on the screen as a pixel of the image."""
    return round_half_up((client - origin) * (pixels / shown))


def image_length(px: Column, shown: Column, pixels: Column) -> Column:
    return px * (pixels / F.when(shown == 0, 1).otherwise(shown))


def keyword_list(keywords: DataFrame) -> DataFrame:
    """``(keyword)``: trimmed, without empty and repeated ones."""
    return keywords.select(T.trim_all(F.col("keyword")).alias("keyword")).filter("keyword != ''").distinct()


def previews(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(doc_id)`` of the pages that have lines and at least one enabled box; no other page's text is shown."""
    return lines.select("doc_id").join(boxes.filter("enabled").select("doc_id"), "doc_id", "left_semi").distinct()


def _distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def _angle(before: Column, corner: Column, after: Column) -> Column:
    size = _distance(before, corner) * _distance(after, corner)
    dot = (before["x"] - corner["x"]) * (after["x"] - corner["x"]) + (before["y"] - corner["y"]) * (after["y"] - corner["y"])
    return F.when(size < 1e-6, 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size)))))


def is_document_quad(quad: Column, w: Column, h: Column) -> Column:
    """Whether ``quad`` (structs ``tl, tr, br, bl`` of x and y) looks like a page in an image of that size."""
    corners = [quad[k] for k in ("tl", "tr", "br", "bl")]
    ring = list(zip(corners, corners[1:] + corners[:1], strict=True))
    area = F.abs(sum((a["x"] * b["y"] - b["x"] * a["y"] for a, b in ring[1:]), ring[0][0]["x"] * ring[0][1]["y"] - ring[0][1]["x"] * ring[0][0]["y"])) / 2
    top, right, bottom, left = (_distance(a, b) for a, b in ring)
    shape = F.greatest(top, bottom) / F.greatest(F.lit(1.0), left, right)
    angles = F.array(*(_angle(corners[i - 1], corners[i], corners[(i + 1) % 4]) for i in range(4)))
    cx, cy = (sum((c[k] for c in corners[1:]), corners[0][k]) / 4 for k in "xy")
    return (
        area.between(w * h * 0.12, w * h * 0.995)
        & (F.least(top, right, bottom, left) >= 24)
        & shape.between(0.22, 4.5)
        & F.forall(angles, lambda a: a.between(52, 128))
        & cx.between(0, w)
        & cy.between(0, h)
    )


def needs_warp(quad: Column, w: Column, h: Column, by_content: Column) -> Column:
    """Whether a page's quadrangle is worth straightening; margins count unless it was found by its content."""
    tl, tr, br, bl = (quad[k] for k in ("tl", "tr", "br", "bl"))
    top, bottom, left, right = _distance(tl, tr), _distance(bl, br), _distance(tl, bl), _distance(tr, br)
    trapeze = F.greatest(F.abs(top - bottom) / F.greatest(top, bottom, F.lit(1.0)), F.abs(left - right) / F.greatest(left, right, F.lit(1.0)))
    margin = F.greatest(F.least(tl["x"], bl["x"]) / w, F.least(tl["y"], tr["y"]) / h, (w - F.greatest(tr["x"], br["x"])) / w, (h - F.greatest(bl["y"], br["y"])) / h)
    skew = F.greatest(F.abs(tl["y"] - tr["y"]) / h, F.abs(tl["x"] - bl["x"]) / w, F.abs(bl["y"] - br["y"]) / h)
    return is_document_quad(quad, w, h) & ((trapeze > 0.02) | (skew > 0.01) | (~by_content & (margin > 0.035)))
