"""Pages drawn from messages: wrapped lines with the exact box of each character, as a recogniser would give them.

There is no font here; a character is as wide as the font is high if it is of the wide kinds (Japanese, Chinese, full
width), and half as wide if not. Chat pages follow one layout: the sender's line, then the wrapped message below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators.symbols import SYMBOLS

WIDE = T.CJK + T.CJK_MARKS + "！-｠￠-￦"
FONT, LINE_HEIGHT, PITCH = 20, 24, 32
SENDER_X, TEXT_X, TEXT_WIDTH, ABOVE_TEXT, BELOW_TEXT = 115.0, 133.0, 450.0, 44, 30


def char_widths(text: Column, size: int = FONT) -> Column:
    """Each character's width in pixels."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda ch: F.when(ch.rlike(f"[{WIDE}]"), float(size)).otherwise(size / 2))


def wrapped(text: Column, width: float, size: int = FONT) -> Column:
    """The lines of a text: a line takes characters while it is no wider than ``width``, and one at least. An empty text has none."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    if width <= 0:
        return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    state = "struct<lines:array<string>,line:string,wide:double>"
    empty = F.struct(F.array().alias("lines"), F.lit("").alias("line"), F.lit(0.0).alias("wide")).cast(state)

    def step(acc: Column, ch: Column) -> Column:
        w = F.when(ch.rlike(f"[{WIDE}]"), float(size)).otherwise(size / 2)
        full = (acc["line"] != "") & (acc["wide"] + w > width)
        broken = F.struct(F.concat(acc["lines"], F.array(acc["line"])).alias("lines"), ch.alias("line"), w.alias("wide")).cast(state)
        longer = F.struct(acc["lines"].alias("lines"), F.concat(acc["line"], ch).alias("line"), (acc["wide"] + w).alias("wide")).cast(state)
        return F.when(full, broken).otherwise(longer)

    return F.aggregate(chars, empty, step, lambda acc: F.when(acc["line"] != "", F.concat(acc["lines"], F.array(acc["line"]))).otherwise(acc["lines"]))


def _symbols(text: Column, x: Column, y: Column, size: int) -> Column:
    """Each character's box; edges are rounded from the running width, so neighbours touch."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def boxes(edges: Column) -> Column:
        side = lambda k: F.floor(x + F.get(edges, k) + 0.5).cast("double")
        return F.transform(chars, lambda ch, k: F.struct(ch.alias("text"), F.struct(side(k).alias("x0"), y.alias("y0"), side(k + 1).alias("x1"), (y + LINE_HEIGHT).alias("y1")).alias("bbox"), F.lit(99.0).alias("confidence")))

    def running(widths: Column) -> Column:
        zero = F.array(F.lit(0.0))
        return F.aggregate(widths, zero, lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))

    return T.bound(T.bound(char_widths(text, size), running), boxes).cast(SYMBOLS)


def drawn_lines(messages: DataFrame, symbols: bool = True) -> DataFrame:
    """``(doc_id, line_no, text, x0, y0, x1, y1, confidence[, words, symbols])`` of ``messages(doc_id, seq, sender, text)``, one below the other.

    Line breaks of a text are spaces. Null senders and texts are empty and have no line. A page's messages are placed by
    running sums over the page, in order of ``seq``; line numbers go from the top.
    """
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")
    rows = messages.select("doc_id", "seq", F.coalesce("sender", F.lit("")).alias("sender"), wrapped(said, TEXT_WIDTH).alias("body"))
    tall = (F.lit(ABOVE_TEXT) + F.size("body") * PITCH + BELOW_TEXT).cast("double")
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"top": F.coalesce(F.sum(tall).over(before), F.lit(0.0)), "first": F.coalesce(F.sum(F.size("body") + 1).over(before), F.lit(0))})
    head = F.struct(F.lit(0).alias("k"), F.col("sender").alias("text"), F.lit(SENDER_X).alias("x0"), F.col("top").alias("y0"))
    body = F.transform("body", lambda t, k: F.struct((k + 1).alias("k"), t.alias("text"), F.lit(TEXT_X).alias("x0"), (F.col("top") + ABOVE_TEXT + k * PITCH).alias("y0")))
    lines = rows.select("doc_id", "first", F.explode(F.concat(F.array(head), body)).alias("l")).filter("l.text != ''")
    text, x0, y0 = F.col("l.text"), F.col("l.x0"), F.col("l.y0")
    wide = F.aggregate(char_widths(text), F.lit(0.0), lambda a, w: a + w)
    out = lines.select("doc_id", (F.col("first") + F.col("l.k")).cast("int").alias("line_no"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), F.floor(x0 + wide + 0.5).cast("double").alias("x1"), (y0 + LINE_HEIGHT).alias("y1"), F.lit(99.0).alias("confidence"))
    return out.withColumns({"words": F.array().cast(SYMBOLS), "symbols": _symbols(F.col("text"), F.col("x0"), F.col("y0"), FONT)}) if symbols else out
