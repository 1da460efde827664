"""Operators on recognised lines, strokes and shapes: spatial joins within a document, snapping, quality.

Lines are ``(doc_id, line_no, text, x0, y0, x1, y1, confidence)``; every join has ``doc_id`` as its equi-key, so
Spark may hash or sort it and split a skewed document's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators.bands import BAND, banded, share_band
from maskora.sources.scratch import by_text, materialised

_W = T.WS
# Lines that are labels of a form, and what they label.
LABEL_LINES = [
    ("person", "人名", "(?iu)^(?:氏名|お?名前|Name|担当者|契約者|申請者|代表者)"),
    ("phone", "電話番号", "(?iu)^(?:TEL|電話(?:番号)?|携帯(?:番号)?)"),
    ("email", "メールアドレス", "(?iu)^(?:Email|E-?mail|メール(?:アドレス)?)"),
    ("postal", "郵便番号", "^(?:〒|郵便番号)"),
    ("address", "住所", "(?iu)^(?:住所|Address)"),
    ("birth_date", "生年月日", "(?iu)^(?:生年月日|誕生日|DOB)"),
    ("bank_account", "口座番号", r"(?iu)^(?:口座番号|口座No\.?)"),
    ("bank_account", "支店番号", "^(?:支店番号|店番号)"),
    ("id_number", "個人番号", "^(?:マイナンバー|個人番号)"),
    ("id_number", "公的識別番号", "^(?:運転免許証?(?:番号)?|免許証番号|旅券番号|パスポート番号|保険者番号|被保険者番号)"),
    ("id_number", "識別番号", "(?iu)^(?:社員番号|従業員番号|顧客番号|会員番号|会員ID|ユーザーID|ログインID)"),
    ("password", "パスワード", "(?iu)^(?:パスワード|Password|PW)"),
    ("credit_card", "カード情報", "^(?:カード番号|クレジットカード)"),
]
_COLON = rf"[{_W}]*[:：]?\z"


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


_ANY_LABEL = "|".join(f"(?:{pattern})" for *_, pattern in LABEL_LINES)


def label_of(text: Column, trimmed: bool = False) -> Column:
    """``struct(category, label)`` of a line that is a label and nothing else."""
    t, found = text if trimmed else T.trim_all(text), None
    for category, label, pattern in LABEL_LINES:
        value = F.struct(F.lit(category).alias("category"), F.lit(label).alias("label"))
        found = F.when(t.rlike(pattern + _COLON), value) if found is None else found.when(t.rlike(pattern + _COLON), value)
    return F.when(t.rlike(f"(?:{_ANY_LABEL}){_COLON}"), found)  # few lines are labels: one pattern before thirteen


def is_value_of(text: Column, category: Column, trimmed: bool = False, no_label: bool = False) -> Column:
    """Whether a text may be the value of a label; ``trimmed`` and ``no_label`` say what is known of it already."""
    t = text if trimmed else T.trim_all(text)
    n = F.length(F.regexp_replace(F.translate(t, "Oo〇○", "0000"), "[^0-9]", ""))
    shape = (
        F.when(category == "phone", n.between(9, 11))
        .when(category == "email", t.rlike("[@＠]"))
        .when(category == "postal", n == 7)
        .when(category == "birth_date", t.rlike(rf"[0-9]{{1,4}}[{_W}]*[年/.\-][{_W}]*[0-9]{{1,2}}"))
        .when(category == "bank_account", n.between(3, 12))
        .when(category == "person", T.is_person_value(t))
        .when(category == "address", T.is_address_value(t))
        .otherwise(~t.rlike(r"^[：:]\z"))
    )
    fits = F.length(t).between(2, 100) & shape
    return fits if no_label else fits & label_of(t, True).isNull()


def _label_texts(texts: DataFrame) -> DataFrame:
    """``line`` with its trimmed ``text``, its ``kind`` if it is a label, and else ``fits``, the categories whose value it may be."""
    categories = sorted({category for category, *_ in LABEL_LINES})
    rows = texts.withColumn("text", T.trim_all(F.col("line"))).withColumn("kind", label_of(F.col("text"), True))
    fits = F.array(*(F.when(is_value_of(F.col("text"), F.lit(k), trimmed=True, no_label=True), k) for k in categories))
    return rows.withColumn("fits", F.when(F.col("kind").isNull(), F.array_compact(fits)))


def _y_overlap(a0, a1, b0, b1) -> Column:
    least = F.least(a1 - a0, b1 - b0)
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / F.when(least == 0, 1.0).otherwise(least)


def label_values(lines: DataFrame) -> DataFrame:
    """``(doc_id, label_line, value_line, category, label, value)``: each label line with its nearest plausible value.

    Values on the label's row win over those below; another label in between bars the way. Ties go to the
    higher, then the left, then the earlier line. What a text is, is found out once for each distinct text, when this is
    called.
    """
    rows = lines.select("doc_id", "line_no", F.coalesce("text", F.lit("")).alias("line"), "x0", "y0", "x1", "y1")
    rows = rows.join(by_text(rows, "line", _label_texts, "label-texts"), "line").drop("line")
    c = F.col
    tall = F.greatest(F.lit(8.0), c("y1") - c("y0"))
    marks = rows.filter("kind is not null")
    a = banded(marks, F.least("y0", c("y1") - tall * 0.15), c("y1") + tall * 2.2).alias("a")
    b = banded(rows.filter("kind is null"), c("y0"), c("y1")).alias("b")
    o = banded(marks.select("doc_id", "line_no", "x0", "y0", "y1"), c("y0"), c("y1")).alias("o")
    h = F.greatest(F.lit(8.0), c("a.y1") - c("a.y0"))
    wide = c("a.x1") - c("a.x0")
    same = (_y_overlap(c("a.y0"), c("a.y1"), c("b.y0"), c("b.y1")) >= 0.55) & (c("b.x0") >= c("a.x1") - h * 0.25) & (c("b.x0") - c("a.x1") <= F.greatest(h * 30, wide * 12))
    gap = c("b.y0") - c("a.y1")
    below = gap.between(h * -0.15, h * 2.2) & (F.abs(c("b.x0") - c("a.x0")) <= F.greatest(F.lit(64.0), wide))
    fits = F.array_contains(c("b.fits"), c("a.kind.category"))
    pairs = a.join(b, share_band("a", "b") & fits & (same | below)).select(
        c("a.doc_id").alias("doc_id"), c("a.line_no").alias("label_line"), c("b.line_no").alias("value_line"), c("a.kind").alias("kind"), c("b.text").alias("text"),
        c("a.x0").alias("ax0"), c("a.y0").alias("ay0"), c("a.x1").alias("ax1"), c("a.y1").alias("ay1"), c("b.x0").alias("bx0"), c("b.y0").alias("by0"), h.alias("h"), same.alias("same"),
        F.when(same, F.greatest(F.lit(0.0), c("b.x0") - c("a.x1"))).otherwise(F.greatest(F.lit(0.0), gap) + F.abs(c("b.x0") - c("a.x0")) * 0.25).alias("distance"),
    )
    p = banded(pairs, c("ay0"), c("ay1") + c("h") * 2.2).alias("p")
    on_row = (_y_overlap(c("p.ay0"), c("p.ay1"), c("o.y0"), c("o.y1")) >= 0.55) & (c("o.x0") > c("p.ax1")) & (c("o.x0") < c("p.bx0"))
    under = (c("o.y0") > c("p.ay1")) & (c("o.y0") < c("p.by0")) & (F.abs(c("o.x0") - c("p.ax0")) <= c("p.h") * 2)
    barred = share_band("p", "o", once=False) & (c("p.label_line") != c("o.line_no")) & ((c("p.same") & on_row) | (~c("p.same") & under))
    facts = [f"p.{k}" for k in ("kind", "text", "same", "distance", "by0", "bx0")]  # the pair's own; as keys, a count by hash without a sort
    open_ = p.join(o, barred, "left").groupBy("p.doc_id", "p.label_line", "p.value_line", *facts).agg(F.count("o.line_no").alias("bars")).filter("bars = 0")
    order = Window.partitionBy("doc_id", "label_line").orderBy(F.col("same").desc(), "distance", "by0", "bx0", "value_line")
    best = open_.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return best.select("doc_id", "label_line", "value_line", F.col("kind.category").alias("category"), F.col("kind.label").alias("label"), F.col("text").alias("value"))


def _address_texts(texts: DataFrame) -> DataFrame:
    return texts.select("text", label_of(F.col("text"), True).isNotNull().alias("is_label"), T.is_address_value(F.col("text")).alias("is_address"))


def address_continuations(lines: DataFrame, values: DataFrame) -> DataFrame:
    """Up to two lines that carry on the address of each address value: ``(doc_id, label_line, value_line, value)``.

    A line follows at the first line's left edge, close below the last accepted one; a label between ends the address.
    """
    rows = lines.select("doc_id", "line_no", T.trim_all(F.coalesce("text", F.lit(""))).alias("text"), "x0", "y0", "x1", "y1")
    first = values.filter("category = 'address'").join(rows.select("doc_id", F.col("line_no").alias("value_line"), F.col("x0").alias("vx0"), F.col("y1").alias("end")), ["doc_id", "value_line"])
    first = first.join(rows.select("doc_id", F.col("line_no").alias("label_line"), F.greatest(F.lit(8.0), F.col("y1") - F.col("y0")).alias("h")), ["doc_id", "label_line"])
    # what both steps read is written once: else each step would find the labels' values again, and the second one the first step too
    step, found = first.select("doc_id", "label_line", F.col("value_line").alias("first_line"), F.lit(None).cast("double").alias("after"), "vx0", "end", "h"), []
    step = materialised(step, "addresses")
    # only labels and texts like an address bear on what follows; which these are is found out once for each text
    likely = by_text(rows, "text", _address_texts, "address-texts").filter("is_label OR is_address")
    follow = rows.join(likely, "text").withColumn("band", F.floor(F.col("y0") / BAND))
    for _ in range(2):
        reach = banded(step, F.col("end") - F.col("h") * 0.1, F.col("end") + F.col("h") * 1.25).drop("first_band")
        near = reach.join(follow, ["doc_id", "band"]).filter(
            (F.col("line_no") != F.col("label_line")) & (F.col("line_no") != F.col("first_line")) & (F.col("y0") - F.col("end")).between(F.col("h") * -0.1, F.col("h") * 1.25)
            & (F.abs(F.col("x0") - F.col("vx0")) <= F.col("h") * 1.5) & (F.col("after").isNull() | (F.col("y0") >= F.col("after")))
        )
        order = Window.partitionBy("doc_id", "label_line").orderBy("y0", "x0", "line_no")
        taken = near.withColumn("place", F.row_number().over(order)).filter("place = 1 and not is_label")
        taken = materialised(taken.select("doc_id", "label_line", "first_line", "line_no", "text", "vx0", "y0", "y1", "h"), "address-lines")
        found.append(taken.select("doc_id", "label_line", F.col("line_no").alias("value_line"), F.col("text").alias("value")))
        step = taken.select("doc_id", "label_line", "first_line", F.col("y0").alias("after"), "vx0", F.col("y1").alias("end"), "h")
    return found[0].unionByName(found[1]).distinct()


#: What may follow a sender's name on its line.
SENDER_TAIL = rf"[{_W}]*(?:[0-9]{{1,2}}:[0-9]{{2}}|既読|未読|送信済み)[{_W}]*\z"
_TIME = rf"[{_W}][0-9]{{1,2}}:[0-9]{{2}}(?:[{_W}]*(?:既読|未読|送信済み))?[{_W}]*\z"


def is_timed(text: Column) -> Column:
    """Whether a line ends in a time, as a sender's does."""
    return text.rlike(_TIME)


def sender_headers(lines: DataFrame, avatars: DataFrame | None = None) -> DataFrame:
    """Lines that stand above a message body and end in a time, or beside an avatar ``(doc_id, x, y, w, h)``."""
    c = F.col
    tall = F.greatest(F.lit(1.0), c("y1") - c("y0"))
    heads = lines if avatars is not None else lines.filter(c("text").rlike(_TIME))
    a = banded(heads.select("doc_id", "line_no", "x0", "y0", "y1"), c("y1") - tall * 0.1, c("y1") + tall * 2.5).alias("a")
    b = lines.filter(F.length(T.trim_all(c("text"))) >= 3).select("doc_id", "line_no", "x0", "y0").withColumn("band", F.floor(c("y0") / BAND)).alias("b")
    h = F.greatest(F.lit(1.0), c("a.y1") - c("a.y0"))
    body = share_band("a", "b", once=False) & (c("a.line_no") != c("b.line_no"))
    body = body & (c("b.y0") >= c("a.y1") - h * 0.1) & (c("b.y0") - c("a.y1") <= h * 2.5) & (F.abs(c("b.x0") - c("a.x0")) <= h * 2)
    over = heads.join(a.join(b, body, "left_semi").select("doc_id", "line_no").distinct(), ["doc_id", "line_no"], "left_semi")
    timed = over.filter(F.col("text").rlike(_TIME))
    if avatars is None:
        return timed
    a, v = over.filter(~F.coalesce(F.col("text").rlike(_TIME), F.lit(False))).alias("a"), avatars.alias("v")
    gap = c("a.x0") - (c("v.x") + c("v.w"))
    beside = (c("a.doc_id") == c("v.doc_id")) & gap.between(h * -0.2, h * 2) & (c("a.y0") >= c("v.y") - h * 0.5) & (c("a.y0") <= c("v.y") + c("v.h") * 0.5)
    return timed.unionByName(a.join(v, beside, "left_semi"))


def range_box(start: Column, end: Column, length: Column, x0: Column, y0: Column, x1: Column, y1: Column, aligned: Column | None = None) -> Column:
    """``struct(x, y, w, h)`` of characters [start, end): the union of their own boxes where each has one, else a share of the line's."""
    share = F.struct(
        round_half_up(x0 + (x1 - x0) * start / length).alias("x"), y0.cast("double").alias("y"),
        F.greatest(F.lit(10.0), round_half_up((x1 - x0) * (end / length - start / length))).alias("w"), (y1 - y0).cast("double").alias("h"),
    )
    valid = (start >= 0) & (end <= length) & (start < end)
    if aligned is None:
        return F.when(valid, share)
    part = F.slice(aligned, start + 1, F.greatest(F.lit(1), end - start))
    side = lambda name, agg: agg(F.transform(part, lambda s: s["bbox"][name]))
    left, right, top, bottom = side("x0", F.array_min), side("x1", F.array_max), side("y0", F.array_min), side("y1", F.array_max)
    own = F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), F.greatest(F.lit(1.0), bottom - top).alias("h"))
    return F.when(valid, F.when((F.size(aligned) == length) & (right > left), own).otherwise(share))


def padded(x: Column, y: Column, w: Column, h: Column, padding: float, width: Column, height: Column, photo: bool = False) -> Column:
    """A box with its safety margin, inside the image."""
    px = F.greatest(F.lit(2.0), F.lit(padding + 1.0), F.least(F.lit(10.0), F.ceil(h * (0.1 if photo else 0.07)).cast("double")))
    py = F.greatest(round_half_up(F.lit(padding * 0.4)), F.least(F.lit(6.0), F.ceil(h * (0.07 if photo else 0.04)).cast("double")))
    left, top = F.greatest(F.lit(0.0), x - px), F.greatest(F.lit(0.0), y - py)
    return F.struct(left.alias("x"), top.alias("y"), (F.least(width, x + w + px) - left).alias("w"), (F.least(height, y + h + py) - top).alias("h"))


def scaled_lines(lines: DataFrame, scale: Column) -> DataFrame:
    """Coordinates of a work image divided by its scale and rounded; a scale of one changes nothing."""
    return lines.withColumns({k: F.when(F.abs(scale - 1) < 0.001, F.col(k)).otherwise(round_half_up(F.col(k) / scale)) for k in ("x0", "y0", "x1", "y1")})


def recognition_quality(lines: DataFrame) -> DataFrame:
    """``(doc_id, chars, avg_confidence, score)``; the mean is weighted by each line's characters, at least one in the numerator."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), rf"[{_W}]", ""))
    sums = lines.groupBy("doc_id").agg(F.sum(n).alias("chars"), F.sum(F.col("confidence") * F.greatest(F.lit(1), n)).alias("weighted"))
    mean = F.when(F.col("chars") > 0, F.col("weighted") / F.col("chars")).otherwise(0.0)
    return sums.select("doc_id", "chars", mean.alias("avg_confidence"), (F.col("chars") * F.greatest(F.lit(1.0), mean)).alias("score"))


def better_result(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per document whether the second recognition replaces the first: ``(doc_id, use_second)``."""
    a, b = first.alias("a"), second.alias("b")
    empty = F.coalesce(F.col("a.chars"), F.lit(0)) == 0
    better = (F.col("b.score") > F.col("a.score") * 1.15) & (F.col("b.avg_confidence") >= F.col("a.avg_confidence") - 3)
    return a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full").select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce(F.when(empty, F.col("b.chars") > 0).otherwise(better), F.lit(False)).alias("use_second"))


def recognition_status(quality: DataFrame, timed_out: Column | None = None) -> DataFrame:
    timed_out = F.lit(False) if timed_out is None else timed_out
    status = F.when(F.col("chars") == 0, F.when(timed_out, "timeout").otherwise("no_text")).when(F.col("avg_confidence") < 35, "low_confidence").otherwise("ok")
    return quality.withColumn("status", status)


def typical_line_height(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Upper median of the heights over four, plus four, per document.

    ``pages(doc_id, height)`` adds those without such a line, with 2.2 % of their height, 16 at least.
    """
    heights = lines.filter(F.col("y1") - F.col("y0") > 4).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("y1") - F.col("y0"))).alias("h"))
    median = heights.select("doc_id", (F.element_at("h", F.floor(F.size("h") / 2).cast("int") + 1) + 4).alias("line_height"))
    if pages is None:
        return median
    default = F.greatest(F.lit(16.0), round_half_up(F.col("height") * 0.022))
    return pages.join(median, "doc_id", "left").select("doc_id", F.coalesce("line_height", default).alias("line_height"))


def usable_results(status: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents ``(doc_id, status)`` whose recognition can be used again: not failed, and with a line at least."""
    good = status.filter(~F.coalesce(F.col("status"), F.lit("failed")).isin("failed", "timeout", "no_text"))
    return good.join(lines, "doc_id", "left_semi").select("doc_id", "status")


def text_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes that stand on text: found by the engine, no pictures, and of four pixels a side at least."""
    return boxes.filter(~F.coalesce(F.col("is_manual"), F.lit(False)) & ~F.col("type").isin("manual", "face", "avatar") & (F.col("w") >= 4) & (F.col("h") >= 4))


def text_columns(lines: DataFrame, width: float, top: int = 4) -> DataFrame:
    """The most common left edges of a document, in steps of 1.5 % of its width; ties go to the edge seen first."""
    step = max(4.0, width * 0.015)
    counts = lines.groupBy("doc_id", F.floor(F.col("x0") / step + 0.5).alias("edge")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    order = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "first_line")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def marquee(boxes: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    return boxes.filter((F.col("x") < x + w) & (F.col("x") + F.col("w") > x) & (F.col("y") < y + h) & (F.col("y") + F.col("h") > y))


def box_at(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """The top-most box under each point ``(doc_id, point_id, px, py)``, rotated boxes included."""
    a = -F.radians(F.coalesce("rotation", F.lit(0.0)))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    dx, dy = F.col("px") - cx, F.col("py") - cy
    rx, ry = cx + dx * F.cos(a) - dy * F.sin(a), cy + dx * F.sin(a) + dy * F.cos(a)
    hit = rx.between(F.col("x"), F.col("x") + F.col("w")) & ry.between(F.col("y"), F.col("y") + F.col("h"))
    return points.join(boxes, "doc_id").filter(hit).groupBy("doc_id", "point_id").agg(F.max_by("box_id", "seq").alias("box_id"))


def _segment(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(n == 0, 1.0).otherwise(n)))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def shape_at(shapes: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """The top-most arrow, ellipse or rectangle whose outline is within the tolerance and half its width of each point."""
    c = F.col
    px, py = c("px"), c("py")
    left, right, top, bottom = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    sides = F.least(_segment(px, py, left, top, right, top), _segment(px, py, right, top, right, bottom), _segment(px, py, right, bottom, left, bottom), _segment(px, py, left, bottom, left, top))
    rx, ry = F.greatest(F.lit(1.0), (right - left) / 2), F.greatest(F.lit(1.0), (bottom - top) / 2)
    nx, ny = (px - (left + right) / 2) / rx, (py - (top + bottom) / 2) / ry
    ellipse = F.abs(F.hypot(nx, ny) - 1) * F.least(rx, ry)
    away = F.when(c("kind") == "arrow", _segment(px, py, c("x1"), c("y1"), c("x2"), c("y2"))).when(c("kind") == "rect", sides).otherwise(ellipse)
    return points.join(shapes, "doc_id").filter(away <= tolerance + c("width") / 2).groupBy("doc_id", "point_id").agg(F.max_by("shape_id", "seq").alias("shape_id"))


def share_line(bx, by, bw, bh, ex, ey, ew, eh, gap_factor: float = 1.6) -> Column:
    """Whether two strokes lie on one line of text."""
    small = (bw < 1) | (bh < 1) | (ew < 1) | (eh < 1)
    tall = ((eh > bh * 2.2) & (eh > bh + 14)) | ((bh > eh * 2.2) & (bh > eh + 14))
    apart = F.abs(by + bh / 2 - ey - eh / 2) > F.greatest(F.lit(8.0), F.least(bh, eh) * 0.7)
    gap = F.greatest(bx, ex) - F.least(bx + bw, ex + ew)
    return ~small & ~tall & ~apart & (gap <= F.greatest(bh, eh) * gap_factor)


def absorb_strokes(strokes: DataFrame, extra: DataFrame, gap_factor: float = 0.3) -> DataFrame:
    """A new stroke ``(doc_id, x, y, w, h)`` united with all strokes of its document on the same line."""
    a, b, c = extra.alias("a"), strokes.alias("b"), F.col
    same = (c("a.doc_id") == c("b.doc_id")) & share_line(c("b.x"), c("b.y"), c("b.w"), c("b.h"), c("a.x"), c("a.y"), c("a.w"), c("a.h"), gap_factor)
    edges = a.join(b, same, "left").groupBy(c("a.doc_id").alias("doc_id"), c("a.x").alias("ax"), c("a.y").alias("ay"), c("a.w").alias("aw"), c("a.h").alias("ah")).agg(
        F.min("b.x").alias("x"), F.min("b.y").alias("y"), F.max(c("b.x") + c("b.w")).alias("r"), F.max(c("b.y") + c("b.h")).alias("d"), F.count("b.x").alias("absorbed")
    )
    x, y = F.least("ax", "x"), F.least("ay", "y")
    return edges.select("doc_id", x.alias("x"), y.alias("y"), (F.greatest(c("ax") + c("aw"), c("r")) - x).alias("w"), (F.greatest(c("ay") + c("ah"), c("d")) - y).alias("h"), "absorbed")


def snap_drags(drags: DataFrame, lines: DataFrame, edges: DataFrame | None = None, pad_y: float = 2.0) -> DataFrame:
    """Drags ``(doc_id, drag_id, sx, sy, cx, cy)`` snapped to lines: ``(doc_id, drag_id, line_no, x, y, w, h, snapped)``.

    The nearest line within reach wins (a line that the drag overlaps sideways is preferred, the earlier of equals);
    its top and bottom are taken, and each end moves to the nearest edge of a line, word or character
    (``edges(doc_id, line_no, at)``). A drag much taller than the line, or with no line in reach, stays as it is.
    """
    c = F.col
    d = drags.withColumns({"minx": F.least("sx", "cx"), "maxx": F.greatest("sx", "cx"), "miny": F.least("sy", "cy"), "maxy": F.greatest("sy", "cy")})
    d = d.withColumns({"rw": F.greatest(F.lit(1.0), c("maxx") - c("minx")), "rh": F.greatest(F.lit(1.0), c("maxy") - c("miny"))})
    away = lambda a, b: F.when((b >= c("y0")) & (a <= c("y1")), 0.0).when(b < c("y0"), c("y0") - b).otherwise(a - c("y1"))
    h = F.greatest(F.lit(8.0), c("y1") - c("y0"))
    overlap = F.greatest(F.lit(0.0), F.least("maxx", "x1") - F.greatest("minx", "x0"))
    distance = F.least(away(c("sy"), c("sy")) * 1.5, away(c("cy"), c("cy")), away(c("miny"), c("maxy")))
    near = ((overlap > 0) | ((c("minx") <= c("x1") + 40) & (c("maxx") >= c("x0") - 40))) & (distance <= F.greatest(F.lit(24.0), h * 1.25))
    score = distance * 2 - F.when(overlap > 0, 20).otherwise(0)
    drawn = banded(d, c("miny"), c("maxy")).drop("first_band")
    tall = F.greatest(F.lit(24.0), h * 1.25)
    reached = banded(lines.select("doc_id", "line_no", "x0", "y0", "x1", "y1"), c("y0") - tall, c("y1") + tall).drop("first_band")
    best = drawn.join(reached, ["doc_id", "band"]).filter(near).groupBy("doc_id", "drag_id").agg(F.min(F.struct(score.alias("score"), "line_no", "x0", "y0", "x1", "y1")).alias("line"))
    rows = d.join(best, ["doc_id", "drag_id"], "left").select("*", "line.line_no", "line.x0", "line.y0", "line.x1", "line.y1").drop("line")
    rows = rows.withColumn("snapped", c("line_no").isNotNull() & (c("rh") <= h * 2.4))
    own = F.array("x0", "x1")
    if edges is not None:
        lists = edges.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list("at")).alias("edges"))
        rows = rows.join(lists, ["doc_id", "line_no"], "left")
        own = F.concat(own, F.coalesce("edges", F.array().cast("array<double>")))
    reach = F.greatest(F.lit(12.0), h * 0.4)

    def nearest(x: Column) -> Column:
        by = F.array_sort(F.transform(F.filter(own, lambda e: F.abs(x - e) <= reach), lambda e: F.struct(F.abs(x - e).alias("d"), e.alias("e"))))
        return F.coalesce(F.try_element_at(by, F.lit(1))["e"], x)

    full = (c("rw") > (c("x1") - c("x0")) * 0.75) & (c("minx") <= c("x0") + reach * 2) & (c("maxx") >= c("x1") - reach * 2)
    left, right = F.when(full, c("x0")).otherwise(nearest(c("minx"))), F.when(full, c("x1")).otherwise(nearest(c("maxx")))
    box = F.struct(F.greatest(F.lit(0.0), left - 1).alias("x"), F.greatest(F.lit(0.0), c("y0") - pad_y).alias("y"), F.greatest(F.lit(6.0), right - left + 2).alias("w"), (c("y1") - c("y0") + pad_y * 2).alias("h"))
    raw = F.struct(c("minx").alias("x"), c("miny").alias("y"), c("rw").alias("w"), c("rh").alias("h"))
    return rows.select("doc_id", "drag_id", F.when(c("snapped"), c("line_no")).alias("line_no"), F.when(c("snapped"), box).otherwise(raw).alias("b"), "snapped").select("doc_id", "drag_id", "line_no", "b.*", "snapped")


def work_scale(w: Column, h: Column, line_height: Column, screen_photo: Column) -> Column:
    """Factor that brings lines near 36 px, from 0.55 to 3.2, within the side and pixel limits of recognition."""
    side = F.when(screen_photo, 3200.0).otherwise(2200.0)
    pixels = F.when(screen_photo, 4_500_000.0).otherwise(3_000_000.0)
    wanted = F.greatest(F.lit(0.55), F.least(F.lit(3.2), F.when(line_height > 0, F.lit(36.0) / line_height).otherwise(1.0)))
    return F.least(wanted, side / F.greatest(w, h), F.sqrt(pixels / (w * h)))


def box_counts(boxes: DataFrame) -> DataFrame:
    """Enabled boxes of each document: faces (with avatars), persons, companies, pii and all."""
    on = boxes.filter("enabled")
    return on.groupBy("doc_id").agg(
        F.count_if(F.col("type").isin("face", "avatar")).alias("faces"), F.count_if(F.col("type") == "person").alias("persons"),
        F.count_if(F.col("type") == "company").alias("companies"), F.count_if(F.col("type") == "pii").alias("pii"), F.count(F.lit(1)).alias("total"),
    )


def selection_bounds(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("doc_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.array_sort(F.collect_set("label")).alias("labels"))
