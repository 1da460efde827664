"""Characters of recognised lines with boxes of their own, and the box of a range of them.

The recogniser gives words and symbols ``struct<text, bbox: struct<x0, y0, x1, y1>, confidence>``; a symbol may hold
several characters and its spaces are not those of the line. ``aligned`` has one such entry for each code point of the
line's text. All is arrays on the line's row, linear in its length, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators import layout as L

SYMBOLS = "array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>"
#: Between two of these a space is the recogniser's own.
SPACED_ALIKE = T.CJK + T.CJK_MARKS


def _entry(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, confidence: Column) -> Column:
    bbox = F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))
    return F.struct(text.alias("text"), bbox.alias("bbox"), confidence.cast("double").alias("confidence"))


def _characters(piece: Column) -> Column:
    """A symbol's characters, in equal shares of its width."""
    box = piece["bbox"]
    wide = F.greatest(F.lit(1.0), box["x1"] - box["x0"])

    def share(chars: Column) -> Column:
        n = F.size(chars)
        edge = lambda k: box["x0"] + wide * k / n
        return F.transform(chars, lambda ch, k: _entry(ch, edge(k), box["y0"], F.when(n == 1, box["x1"]).otherwise(edge(k + 1)), box["y1"], piece["confidence"]))

    return T.bound(T.characters(T.half_width(F.coalesce(piece["text"], F.lit("")))), share)


def _pieces_characters(pieces: Column) -> Column:
    """The characters of all symbols. Where each symbol is one character, as most are, they keep their boxes as these are."""
    single = lambda chars: F.transform(pieces, lambda e, k: F.struct(F.get(chars, k).alias("text"), e["bbox"].alias("bbox"), e["confidence"].alias("confidence")))
    own = T.bound(T.characters(T.half_width(_joined(pieces))), single)
    return F.when(F.exists(pieces, lambda e: F.coalesce(F.length(e["text"]), F.lit(0)) != 1), F.flatten(F.transform(pieces, _characters))).otherwise(own)


def _joined(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: e["text"]), "")


def _masked(entries: Column, flags: Column) -> Column:
    return T.bound(flags, lambda f: F.filter(entries, lambda e, i: F.get(f, i)))


def aligned_text(raw: Column, words: Column, symbols: Column, box: dict[str, Column], confidence: Column) -> Column:
    """``struct(text, aligned)``: the line's text, from its symbols (else its words), and an entry for each character.

    Runs of spaces become one, with the first one's box; none at the start and none between two Japanese or Chinese
    characters. A line without either is its normalised raw text, in equal shares of its box.
    """
    none = F.array().cast(SYMBOLS)
    symbols, words = F.coalesce(symbols, none), F.coalesce(words, none)
    pieces = T.bound(F.when(F.size(symbols) > 0, symbols).otherwise(words), _pieces_characters)
    plain = T.join_cjk(T.normalize_recognised(T.trim_all(F.coalesce(raw, F.lit("")))))

    def shares(chars: Column) -> Column:
        wide = F.greatest(F.lit(1.0), box["x1"] - box["x0"]) / F.size(chars)
        edge = lambda k: L.round_half_up(box["x0"] + wide * k)
        return F.struct(plain.alias("text"), F.transform(chars, lambda ch, k: _entry(ch, edge(k), box["y0"], edge(k + 1), box["y1"], confidence)).cast(SYMBOLS).alias("aligned"))

    def of_pieces(p: Column) -> Column:
        return T.bound(_joined(p), lambda t: F.when(t.rlike(f"[{T.SPACE}]"), _masked(p, T.kept_spaces(t, SPACED_ALIKE))).otherwise(p))

    def finished(kept: Column) -> Column:
        spaced = F.transform(kept, lambda e: F.struct(F.translate(e["text"], T.SPACE_MEMBERS, " " * len(T.SPACE_MEMBERS)).alias("text"), e["bbox"].alias("bbox"), e["confidence"].alias("confidence")))
        own = T.bound(spaced, lambda s: F.struct(_joined(s).alias("text"), s.cast(SYMBOLS).alias("aligned")))
        return F.when(F.size(kept) > 0, own).otherwise(T.bound(T.characters(plain), shares))

    return T.bound(T.bound(pieces, of_pieces), finished)


def cleaned_text(text: Column, aligned: Column) -> Column:
    """``struct(text, aligned)`` without white space between two characters of the CJK blocks; the others keep their boxes."""
    blocks = f"[{T.CJK_BLOCKS}]"
    bridge = lambda before, after: F.coalesce(F.right(before, F.lit(1)).rlike(blocks) & F.left(after, F.lit(1)).rlike(blocks), F.lit(False))
    flags = T.kept_places(text, T.WS, lambda before, run, after: F.array_repeat(~bridge(before, after), F.length(run)))
    cleaned = F.struct(T.join_cjk(text).alias("text"), _masked(aligned, flags).alias("aligned"))
    same = F.coalesce(~text.rlike(f"{blocks}[{T.WS}]+{blocks}"), F.lit(False))  # most lines: nothing to take out
    return F.when(same, F.struct(text.alias("text"), aligned.alias("aligned"))).otherwise(cleaned)


def aligned_lines(lines: DataFrame, clean: bool = True, where: Column | None = None) -> DataFrame:
    """``lines(doc_id, line_no, text, x0, y0, x1, y1, words, symbols, confidence)`` with the aligned ``text`` and ``aligned``, cleaned too.

    ``raw_text`` keeps the text as it came. Null words, symbols and texts count as empty; an empty line has no entries.
    Lines for which ``where`` does not hold keep their text, and have null for ``aligned``.
    """
    box = {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}
    made = aligned_text(F.col("text"), F.col("words"), F.col("symbols"), box, F.col("confidence"))
    if where is not None:
        made = F.when(where, made).otherwise(F.struct(F.col("text").alias("text"), F.lit(None).cast(SYMBOLS).alias("aligned")))
    rows = lines.withColumn("_made", made).withColumn("raw_text", F.col("text"))
    rows = rows.withColumns({"text": F.col("_made.text"), "aligned": F.col("_made.aligned")}).drop("_made")
    return cleaned_lines(rows, where) if clean else rows


def cleaned_lines(lines: DataFrame, where: Column | None = None) -> DataFrame:
    """Aligned lines without white space inside Japanese and Chinese text."""
    made = cleaned_text(F.col("text"), F.col("aligned"))
    if where is not None:
        made = F.when(where, made).otherwise(F.struct(F.col("text").alias("text"), F.col("aligned").alias("aligned")))
    rows = lines.withColumn("_made", made)
    return rows.withColumns({"text": F.col("_made.text"), "aligned": F.col("_made.aligned")}).drop("_made")


_BOX = "struct<x:double,y:double,w:double,h:double>"


def _around(entries: Column) -> Column:
    """The box around some entries; null if it has no width."""
    side = lambda e, agg, k: agg(F.transform(e, lambda x: x["bbox"][k])).alias(k)
    sides = lambda e: F.struct(side(e, F.array_min, "x0"), side(e, F.array_min, "y0"), side(e, F.array_max, "x1"), side(e, F.array_max, "y1"))
    box = lambda s: F.when(s["x1"] > s["x0"], F.struct(s["x0"].alias("x"), s["y0"].alias("y"), (s["x1"] - s["x0"]).alias("w"), F.greatest(F.lit(1.0), s["y1"] - s["y0"]).alias("h")).cast(_BOX))
    return T.bound(T.bound(entries, sides), box)


def _by_occurrence(start: Column, end: Column, text: Column, symbols: Column) -> Column:
    """The symbols that spell the range, at their occurrence nearest to where it should be (the earlier of two as near)."""
    bare = lambda s: F.regexp_replace(F.coalesce(s, F.lit("")), f"[{T.WS}]", "")
    target, expected = bare(F.substring(text, start + 1, end - start)), F.length(bare(F.substring(text, F.lit(1), start)))

    def look(s: Column) -> Column:
        # s: struct(chars, places), the symbols' characters as one string and each one's symbol
        n = F.length(target)
        after = F.position(target, s["chars"], expected + 1) - 1
        head = F.substring(s["chars"], F.lit(1), expected - 1 + n)
        back = F.position(F.reverse(target), F.reverse(head))
        before = F.when((back > 0) & (expected > 0), F.length(head) - (back - 1) - n)
        after = F.when(after >= 0, after)
        at = F.when(before.isNull(), after).when(after.isNull(), before).otherwise(F.when(expected - before <= after - expected, before).otherwise(after))
        first, last = F.get(s["places"], at), F.get(s["places"], at + n - 1)
        return F.when((n > 0) & at.isNotNull(), _around(F.slice(symbols, first + 1, last - first + 1)))

    chars = F.transform(symbols, lambda e: bare(e["text"]))
    places = F.flatten(F.transform(chars, lambda c, i: F.array_repeat(i, F.length(c))))
    return T.bound(F.struct(F.array_join(chars, "").alias("chars"), places.alias("places")), look)


def _by_words(start: Column, end: Column, text: Column, words: Column) -> Column:
    """Shares of the words in the range, if they cover it; words are found in the text one after the other."""
    state = "struct<cursor:int,covered:int,parts:array<struct<bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>"
    none = F.struct(F.lit(0).alias("cursor"), F.lit(0).alias("covered"), F.array().alias("parts")).cast(state)

    def step(acc: Column, w: Column) -> Column:
        return T.bound(F.position(w["text"], text, acc["cursor"] + 1) - 1, lambda at: moved(acc, w, at))

    def moved(acc: Column, w: Column, at: Column) -> Column:
        n, box = F.length(w["text"]), w["bbox"]
        low, high = F.greatest(start, at), F.least(end, at + n)
        edge = lambda k: box["x0"] + (box["x1"] - box["x0"]) * (k - at) / n
        part = F.array(F.struct(F.struct(edge(low).alias("x0"), box["y0"].alias("y0"), edge(high).alias("x1"), box["y1"].alias("y1")).alias("bbox")))
        passed = F.struct((at + n).alias("cursor"), acc["covered"].alias("covered"), acc["parts"].alias("parts")).cast(state)
        taken = F.struct((at + n).alias("cursor"), (acc["covered"] + high - low).alias("covered"), F.concat(acc["parts"], part).alias("parts")).cast(state)
        return F.when((F.coalesce(n, F.lit(0)) == 0) | (at < 0), acc).when(low >= high, passed).otherwise(taken)

    found = F.aggregate(words, none, step)
    return T.bound(found, lambda f: F.when((f["covered"] == end - start) & (F.size(f["parts"]) > 0), _around(f["parts"])))


def span_box(start: Column, end: Column, text: Column, box: dict[str, Column], aligned: Column | None = None, symbols: Column | None = None, words: Column | None = None) -> Column:
    """``struct(x, y, w, h, mode)`` of the characters [start, end) of a line; null for a range outside it.

    The first that gives a box: 1, the characters' own boxes, where each has one; 2, the symbols that spell the range
    (of the aligned ones, else of the recogniser's), nearest to its place; 3, the words that cover it, by shares; 4, a
    share of the line. Arrays may be null.
    """
    n, none = F.length(text), F.array().cast(SYMBOLS)
    get = lambda x: none if x is None else F.coalesce(x, none)
    aligned, symbols, words = get(aligned), get(symbols), get(words)
    own = F.when(F.size(aligned) == n, _around(F.slice(aligned, start + 1, F.greatest(F.lit(1), end - start))))
    spelled = T.bound(F.when(F.size(aligned) > 0, aligned).otherwise(symbols), lambda s: F.when(F.size(s) > 0, _by_occurrence(start, end, text, s)))
    share = L.range_box(start, end, n, *(box[k] for k in ("x0", "y0", "x1", "y1"))).cast(_BOX)
    valid = (start >= 0) & (end <= n) & (start < end)

    def numbered(found: Column, mode: int) -> Column:
        return T.bound(found, lambda b: F.when(b.isNotNull(), F.struct(*(b[k].alias(k) for k in "xywh"), F.lit(mode).alias("mode"))))

    ways = (own, spelled, F.when(F.size(words) > 0, _by_words(start, end, text, words)), share)
    return F.when(valid, F.coalesce(*(numbered(found, mode) for mode, found in enumerate(ways, 1))))
