"""Registered queries over recognised pages: symbols and ranges, candidates, new analyses. Lines and boxes come from the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskora import engine
from maskora.operators import analysis as A
from maskora.operators import candidates as C
from maskora.operators import layout as L
from maskora.operators import spans as S
from maskora.operators import symbols as Y
from maskora.sources import drawn as W
from maskora.sources import memo
from maskora.sources.scratch import shared_path
from maskora.sources.tables import table


def _piece(text, x0, x1):
    box = F.struct(x0.alias("x0"), F.col("y0"), x1.alias("x1"), F.col("y1"))
    return F.struct(text.alias("text"), box.alias("bbox"), F.col("confidence"))


def symbol_lines(lines: DataFrame) -> DataFrame:
    """Lines as a recogniser gives them. By ``line_no % 4``: 0, a symbol for each character and a space after each;
    1, symbols of three characters; 2, words only; 3, neither."""
    line, kind, x0 = F.col("text"), F.col("line_no") % 4, F.col("x0")
    spaced = F.regexp_replace(line, "(.)", "$1 ")
    at = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: k)
    single = F.transform(F.split(spaced, ""), lambda ch, k: _piece(ch, x0 + 5.0 * k, x0 + 5.0 * k + 5))
    triple = F.transform(at(F.ceil(F.length(line) / 3)), lambda k: _piece(F.substring(line, (3 * k + 1).cast("int"), F.lit(3)), x0 + 30.0 * k, x0 + 30.0 * k + 28))
    words = F.transform(F.split(line, " "), lambda w, k: _piece(w, x0 + 100.0 * k, x0 + 100.0 * k + 10 * F.length(w)))
    none = F.array().cast(Y.SYMBOLS)
    made = lines.withColumns({"symbols": F.when(kind == 0, single).when(kind == 1, triple).otherwise(none).cast(Y.SYMBOLS), "words": F.when(kind == 2, words).otherwise(none).cast(Y.SYMBOLS)})
    return made.withColumn("text", F.when(kind == 0, spaced).otherwise(line))  # apart: in one step the lambdas above would see the new text


def _aligned_sql(lines: str) -> str:
    """Characters with boxes, then runs of spaces between neighbours by window functions; rows ``(doc_id, line_no, i, ch, a, b)``, ``a`` and ``b`` the sides."""
    alike = r"[\p{Han}\p{Hiragana}\p{Katakana}\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"
    return f"""
o AS ({lines}), k AS (SELECT *, line_no % 4 AS kind FROM o),
u AS (SELECT doc_id, line_no, 2 * i AS i, substr(text, i + 1, 1) AS ch, x0 + 10e0 * i AS a, x0 + 10e0 * i + 5 AS b FROM (SELECT *, unnest(range(length(text))) AS i FROM k WHERE kind = 0) z
 UNION ALL SELECT doc_id, line_no, 2 * i + 1, ' ', x0 + 10e0 * i + 5, x0 + 10e0 * i + 10 FROM (SELECT *, unnest(range(length(text))) AS i FROM k WHERE kind = 0) z
 UNION ALL SELECT doc_id, line_no, i, substr(text, i + 1, 1), x0 + 30e0 * (i // 3) + 28e0 * (i % 3) / least(3, length(text) - i // 3 * 3), x0 + 30e0 * (i // 3) + 28e0 * (i % 3 + 1) / least(3, length(text) - i // 3 * 3) FROM (SELECT *, unnest(range(length(text))) AS i FROM k WHERE kind = 1) z
 UNION ALL SELECT doc_id, line_no, 1000 * w + i, substr(word, i + 1, 1), x0 + 100e0 * w + 10e0 * i, x0 + 100e0 * w + 10e0 * i + 10 FROM (SELECT *, unnest(range(length(word))) AS i FROM (SELECT *, string_split(text, ' ')[w + 1] AS word FROM (SELECT *, unnest(range(len(string_split(text, ' ')))) AS w FROM k WHERE kind = 2) y) x) z
 UNION ALL SELECT doc_id, line_no, i, substr(text, i + 1, 1), floor(x0 + i * (x1 - x0) / length(text) + 0.5), floor(x0 + (i + 1) * (x1 - x0) / length(text) + 0.5) FROM (SELECT *, unnest(range(length(text))) AS i FROM k WHERE kind = 3) z),
n AS (SELECT *, lead(i) OVER line AS next_i, lead(ch) OVER line AS next_ch FROM u WHERE ch != ' ' OR (doc_id, line_no) IN (SELECT (doc_id, line_no) FROM k WHERE kind = 3) WINDOW line AS (PARTITION BY doc_id, line_no ORDER BY i)),
s AS (SELECT doc_id, line_no, i, ch, a, b FROM n UNION ALL SELECT u.doc_id, u.line_no, u.i, ' ', u.a, u.b FROM n JOIN u ON u.doc_id = n.doc_id AND u.line_no = n.line_no AND u.i = n.i + 1
 WHERE u.ch = ' ' AND n.ch != ' ' AND NOT (regexp_matches(n.ch, '{alike}') AND regexp_matches(coalesce(n.next_ch, ''), '{alike}')) AND (n.doc_id, n.line_no) IN (SELECT (doc_id, line_no) FROM k WHERE kind < 3))"""


def _boxes_sql(lines: str) -> str:
    """Which of the four ways gives a range its box, and the box; ranges are ``[1, length - line_no // 4)``, of two characters from the second on at least."""
    return f"""
WITH {_aligned_sql(lines)},
l AS (SELECT doc_id, line_no, string_agg(ch, '' ORDER BY i) AS text FROM s GROUP BY doc_id, line_no),
q AS (SELECT k.doc_id, k.line_no, kind, x0, y0, x1, y1, CASE WHEN kind = 0 THEN l.text ELSE k.text END AS text, greatest(2, length(CASE WHEN kind = 0 THEN l.text ELSE k.text END) - k.line_no // 4) AS stop FROM k JOIN l ON l.doc_id = k.doc_id AND l.line_no = k.line_no),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS spot FROM s),
own AS (SELECT q.doc_id, q.line_no, min(a) AS a, max(b) AS b FROM q JOIN c ON c.doc_id = q.doc_id AND c.line_no = q.line_no WHERE kind = 0 AND spot >= 1 AND spot < stop GROUP BY 1, 2),
v AS (SELECT q.*, substr(text, 2, stop - 1) AS part, own.a, own.b, length(replace(substr(text, 1, 1), ' ', '')) AS skipped FROM q LEFT JOIN own ON own.doc_id = q.doc_id AND own.line_no = q.line_no)
SELECT doc_id, line_no, CAST(CASE WHEN kind = 0 THEN 1 WHEN kind = 1 THEN 2 WHEN kind = 2 AND NOT contains(part, ' ') THEN 3 ELSE 4 END AS integer) AS mode,
 round(CASE WHEN kind = 0 THEN a WHEN kind = 1 THEN x0 + 30 * ((1 - CASE WHEN substr(text, 2, 1) = ' ' THEN -1 ELSE 0 END) // 3) WHEN kind = 2 AND NOT contains(part, ' ') THEN x0 + 10 ELSE floor(x0 + (x1 - x0) / length(text) + 0.5) END, 6) AS x, y0 AS y,
 round(CASE WHEN kind = 0 THEN b - a WHEN kind = 1 THEN 30 * ((stop - 1) // 3) + 28 - 30 * (1 // 3) WHEN kind = 2 AND NOT contains(part, ' ') THEN 10e0 * (stop - 1) ELSE greatest(10e0, floor((x1 - x0) * (CAST(stop AS double) / length(text) - 1e0 / length(text)) + 0.5)) END, 6) AS w, y1 - y0 AS h
FROM v WHERE length(text) > 1
"""


def range_boxes(lines: DataFrame) -> DataFrame:
    """A range of each line and its box. Lines of kind 0 come aligned; the others as the recogniser gave them."""
    given = symbol_lines(lines)
    kind = F.col("line_no") % 4
    made = Y.aligned_lines(given, where=kind == 0)
    rows = made.withColumns({"text": F.when(kind == 0, F.col("text")).otherwise(F.col("raw_text")), "aligned": F.when(kind == 0, F.col("aligned"))})
    stop = F.greatest(F.lit(2), F.length("text") - F.floor(F.col("line_no") / 4).cast("int"))
    box = Y.span_box(F.lit(1), stop, F.col("text"), {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}, F.col("aligned"), F.col("symbols"), F.col("words"))
    # shorter lines have no such range and no box; a filter on the text would be pushed below and work out the alignment once more
    found = rows.select("doc_id", "line_no", F.explode_outer(F.array(box)).alias("b")).filter("b IS NOT NULL")
    return found.select("doc_id", "line_no", "b.mode", F.round("b.x", 6).alias("x"), "b.y", F.round("b.w", 6).alias("w"), "b.h")


def _overlap_sql(a: str, b: str, share: float) -> str:
    wide, high = f"(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))", f"(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"{wide} > 0 AND {high} > 0 AND {wide} * {high} >= least({a}.w * {a}.h, {b}.w * {b}.h) * {share}"


def _candidates(lines: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Picture candidates of a page, and its texts' areas (the upper half of each line, so that some candidates are clear of it)."""
    found = boxes.select("doc_id", F.col("seq").alias("cand_id"), (F.col("x") - 60 + 7 * F.col("seq")).alias("x"), (F.col("y") - 12).alias("y"), F.least(F.col("w"), F.lit(40.0)).alias("w"), F.lit(30.0).alias("h"), (F.pmod(F.col("doc_id") * 7 + F.col("seq") * 13, F.lit(50)) / 50).alias("confidence"))
    texts = lines.filter("line_no % 2 = 0").select("doc_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), F.lit(9.0).alias("h"))
    return found, texts


def _candidate_sql(lines: str, boxes: str) -> str:
    return f"""
WITH RECURSIVE o AS ({lines}), c AS (SELECT doc_id, seq AS cand_id, x - 60 + 7 * seq AS x, y - 12 AS y, least(w, 40e0) AS w, 30e0 AS h, (doc_id * 7 + seq * 13) % 50 / 50 AS confidence FROM ({boxes})),
t AS (SELECT doc_id, x0 AS x, y0 AS y, x1 - x0 AS w, 9e0 AS h FROM o WHERE line_no % 2 = 0),
f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, cand_id) AS r FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = c.doc_id AND {_overlap_sql('c', 't', C.TEXT_SHARE)})),
g AS (SELECT doc_id, 0 AS r, CAST([] AS bigint[]) AS kept FROM f WHERE r = 1
 UNION ALL SELECT g.doc_id, f.r, CASE WHEN len(kept) < {C.MOST} AND NOT EXISTS (SELECT 1 FROM f e WHERE e.doc_id = f.doc_id AND list_contains(kept, e.cand_id) AND {_overlap_sql('f', 'e', C.PHOTO_SHARE)}) THEN list_append(kept, f.cand_id) ELSE kept END FROM g JOIN f ON f.doc_id = g.doc_id AND f.r = g.r + 1),
w AS (SELECT doc_id, arg_max(kept, r) AS kept FROM g GROUP BY doc_id)
SELECT f.doc_id, f.cand_id, f.x, f.y, f.confidence FROM f JOIN w ON w.doc_id = f.doc_id WHERE list_contains(kept, f.cand_id)
"""


def _shapes(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A shape of one of three kinds for each box, and two points on each page."""
    kind = F.element_at(F.array(F.lit("rect"), F.lit("ellipse"), F.lit("arrow")), (F.col("seq") % 3 + 1).cast("int"))
    shapes = boxes.select("doc_id", F.col("box_id").alias("shape_id"), "seq", kind.alias("kind"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.lit(4.0).alias("width"))
    point = lambda n, x, y: F.struct(F.lit(n).alias("point_id"), x.alias("px"), F.lit(y).alias("py"))
    points = boxes.select("doc_id").distinct().select("doc_id", F.inline(F.array(point(1, F.lit(115.0), 30.0), point(2, (F.col("doc_id") % 9 * 7 + 60).cast("double"), 41.0))))
    return shapes, points


def _shape_sql(boxes: str) -> str:
    """Distances to the outline of a rectangle, to an ellipse as the tools reckon it, and to a segment."""
    return f"""
WITH s AS (SELECT doc_id, box_id, seq, seq % 3 AS kind, x AS l, y AS t, x + w AS r, y + h AS b FROM ({boxes})),
p AS (SELECT doc_id, unnest([1, 2]) AS point_id, unnest([115e0, 60e0 + doc_id % 9 * 7]) AS px, unnest([30e0, 41e0]) AS py FROM (SELECT DISTINCT doc_id FROM s) d),
z AS (SELECT p.doc_id, point_id, box_id, seq, kind, least(px - l, r - px, py - t, b - py) AS depth, greatest(l - px, px - r, 0) AS dx, greatest(t - py, py - b, 0) AS dy, greatest(1, (r - l) / 2) AS rx, greatest(1, (b - t) / 2) AS ry,
 px - (l + r) / 2 AS ox, py - (t + b) / 2 AS oy, px - l AS ax, py - t AS ay, r - l AS w, b - t AS h FROM p JOIN s ON s.doc_id = p.doc_id),
a AS (SELECT *, greatest(0, least(1, (ax * w + ay * h) / (w * w + h * h))) AS along FROM z),
d AS (SELECT *, CASE kind WHEN 0 THEN CASE WHEN depth >= 0 THEN depth ELSE sqrt(dx * dx + dy * dy) END WHEN 1 THEN abs(sqrt((ox / rx) ** 2 + (oy / ry) ** 2) - 1) * least(rx, ry) ELSE sqrt((ax - along * w) ** 2 + (ay - along * h) ** 2) END AS away FROM a)
SELECT doc_id, point_id, arg_max(box_id, seq) AS shape_id FROM d WHERE away <= 8 GROUP BY doc_id, point_id
"""


def _analyses(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a page has (some boxes are the user's), and what a new analysis of it finds."""
    current = boxes.withColumn("is_manual", F.col("seq") % 3 == 0).withColumn("type", F.when(F.col("seq") % 7 == 5, "manual").otherwise(F.col("type")))
    found = boxes.filter("seq < 5 AND doc_id % 5 != 0").withColumn("seq", F.col("seq") * 10).withColumn("label", F.lit("new"))
    return current, found


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return talk.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.concat("role", F.lit(" 10:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0")).alias("sender"), "text")


#: Lines by repeated search for the last character that still fits; all characters of these texts are of the narrow kind.
_DRAWN_SQL = f"""
WITH RECURSIVE m AS MATERIALIZED (SELECT conv_id AS doc_id, turn AS seq, concat(role, ' 10:', lpad(CAST(turn % 60 AS varchar), 2, '0')) AS sender, regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g') AS text FROM conversations),
l AS (SELECT doc_id, seq, text, 0 AS k, CAST(0 AS bigint) AS start, CAST(0 AS bigint) AS stop FROM m
 UNION ALL SELECT doc_id, seq, text, k + 1, stop, least(length(text), stop + CAST({W.TEXT_WIDTH} * 2 / {W.FONT} AS bigint)) FROM l WHERE stop < length(text)),
n AS (SELECT doc_id, seq, max(k) AS lines FROM l GROUP BY doc_id, seq),
p AS (SELECT m.doc_id, m.seq, sender, coalesce(sum({W.ABOVE_TEXT} + lines * {W.PITCH} + {W.BELOW_TEXT}) OVER before, 0) AS top, coalesce(sum(lines + 1) OVER before, 0) AS first FROM m JOIN n ON n.doc_id = m.doc_id AND n.seq = m.seq
 WINDOW before AS (PARTITION BY m.doc_id ORDER BY m.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(first AS integer) AS line_no, sender AS text, {W.SENDER_X}e0 AS x0, CAST(top AS double) AS y0, {W.SENDER_X}e0 + 10 * length(sender) AS x1, CAST(top + {W.LINE_HEIGHT} AS double) AS y1 FROM p
UNION ALL SELECT l.doc_id, CAST(first + k AS integer), substr(text, start + 1, stop - start), {W.TEXT_X}e0, CAST(top + {W.ABOVE_TEXT} + (k - 1) * {W.PITCH} AS double), {W.TEXT_X}e0 + 10 * (stop - start), CAST(top + {W.ABOVE_TEXT} + (k - 1) * {W.PITCH} + {W.LINE_HEIGHT} AS double) FROM l JOIN p ON p.doc_id = l.doc_id AND p.seq = l.seq WHERE k > 0
"""


def memoised_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses of each document, from a table kept by content that half of the documents have filled before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_path(spark, "memo")
    rule = [r for r in S.FREE if r.category == "email"]

    def work(rows: DataFrame) -> DataFrame:
        lines = rows.select("memo_key", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
        return lines.groupBy("memo_key").agg(F.sum(F.size(S.pii_spans(F.col("line"), rule))).alias("result"))

    memo.memoised(docs.filter("doc_id % 2 = 0"), ["text"], work, path)
    return memo.memoised(docs, ["text"], work, path).select("doc_id", F.col("result").alias("emails"))


_EMAIL = next(r.pattern for r in S.FREE if r.category == "email").replace("'", "''")
_MEMO_SQL = f"SELECT doc_id, CAST(list_sum(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: len(regexp_extract_all(l, '{_EMAIL}')))) AS bigint) AS emails FROM documents"


def engine_boxes(lines: DataFrame) -> DataFrame:
    """All that the engine does for recognised pages, through its front door: every fourth page stands askew, and has a sender's picture."""
    pages = lines.groupBy("doc_id").agg(F.min("y0").alias("y"))
    angles = pages.select("doc_id", (F.col("doc_id") % 4).cast("double").alias("angle"))
    avatars = pages.filter("doc_id % 4 = 1").select("doc_id", F.lit(0.0).alias("x"), F.col("y"), F.lit(9.0).alias("w"), F.lit(20.0).alias("h"))
    return engine.boxes(lines, engine.Options(keywords=("hello there",)), avatars=avatars, angles=angles)


def _sides() -> Column:
    hundredths = lambda x: F.round(x * 100).cast("long").cast("string")
    return F.array_join(F.transform("aligned", lambda e: F.concat(hundredths(e["bbox"]["x0"]), F.lit(":"), hundredths(e["bbox"]["x1"]))), ",")


def registered(ocr_lines: Callable, page_boxes: Callable, ocr_sql: str, box_sql: str) -> dict[str, tuple[Callable, str | None]]:
    q: dict[str, tuple[Callable, str | None]] = {}
    q["aligned_lines"] = (
        lambda s, d: Y.aligned_lines(symbol_lines(ocr_lines(s, d))).select("doc_id", "line_no", "text", _sides().alias("sides")),
        f"WITH {_aligned_sql(ocr_sql)} SELECT doc_id, line_no, string_agg(ch, '' ORDER BY i) AS text, string_agg(concat(CAST(round(a * 100) AS bigint), ':', CAST(round(b * 100) AS bigint)), ',' ORDER BY i) AS sides FROM s GROUP BY doc_id, line_no",
    )
    q["range_boxes"] = (lambda s, d: range_boxes(ocr_lines(s, d)), _boxes_sql(ocr_sql))
    q["avatar_candidates"] = (lambda s, d: C.accepted(*_candidates(ocr_lines(s, d), page_boxes(s, d))).select("doc_id", "cand_id", "x", "y", "confidence"), _candidate_sql(ocr_sql, box_sql))
    q["reanalysed_boxes"] = (
        lambda s, d: A.reanalysed(*_analyses(page_boxes(s, d))).select("doc_id", "box_id", "seq", "type", "label", "is_manual"),
        f"""
WITH b AS ({box_sql}), c AS (SELECT * REPLACE (seq % 3 = 0 AS is_manual, CASE WHEN seq % 7 = 5 THEN 'manual' ELSE type END AS type) FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place FROM c WHERE is_manual OR type = 'manual'),
f AS (SELECT * REPLACE (seq * 10 AS seq, 'new' AS label) FROM b WHERE seq < 5 AND doc_id % 5 != 0), l AS (SELECT doc_id, max(seq) AS last FROM f GROUP BY doc_id)
SELECT f.doc_id, f.box_id, f.seq, f.type, f.label, f.is_manual FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.box_id = f.box_id)
UNION ALL SELECT m.doc_id, m.box_id, coalesce(last, 0) + place, m.type, m.label, m.is_manual FROM m LEFT JOIN l ON l.doc_id = m.doc_id
""",
    )
    q["drawn_conversations"] = (lambda s, d: W.drawn_lines(messages(s, d), symbols=False).select("doc_id", "line_no", "text", "x0", "y0", "x1", "y1"), _DRAWN_SQL)
    q["shape_hit"] = (lambda s, d: L.shape_at(*_shapes(page_boxes(s, d)), 6.0), _shape_sql(box_sql))
    q["memoised_emails"] = (lambda s, d: memoised_emails(s, d), _MEMO_SQL)
    q["engine_boxes"] = (lambda s, d: engine_boxes(ocr_lines(s, d)), None)
    return q


