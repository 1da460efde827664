"""Drawn pages, and large pages: what stands near is compared, not all with all."""

import json
import time

import pytest
from pyspark.sql import functions as F

from maskora import engine
from maskora.operators import layout as L
from maskora.sources import drawn as W
from maskora.streaming import edits as E


def brute(text, width, size=20):
    lines, line, wide = [], "", 0
    for ch in text:
        w = size if ord(ch) > 0x2FFF else size / 2
        if line and wide + w > width:
            lines.append(line)
            line, wide = "", 0
        line, wide = line + ch, wide + w
    return lines + [line] * bool(line)


@pytest.mark.parametrize("width", [0, 5, 20, 35, 100])
def test_wrapping(spark, width):
    texts = ["", "a", "abcdef", "山田太郎", "ab山cd田", "𠮷" * 9, "a b  c   "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["w"] for r in df.select("t", W.wrapped(F.col("t"), width).alias("w")).collect()}
    assert got == {t: (brute(t, width) if width > 0 else [t] if t else []) for t in texts}


MESSAGES = [
    (1, 0, "山田 太郎", "お疲れ様です。株式会社テックラボの山田です。先ほど佐藤さんからご連絡いただいた件ですが、"),
    (1, 1, "鈴木 一郎", "以下の連絡先に折り返し希望とのことです。TEL: 090-1234-5678"),
    (1, 2, None, "Email: tanaka@frontier-sample.jp"),
    (2, 0, "a", None),
    (2, 1, None, None),
]


def test_characters_have_exact_boxes(spark):
    df = spark.createDataFrame(MESSAGES, "doc_id long, seq long, sender string, text string")
    rows = W.drawn_lines(df).collect()
    assert [(r["text"], r["y0"]) for r in rows if r["doc_id"] == 2] == [("a", 0.0)]
    for r in rows:
        assert "".join(s["text"] for s in r["symbols"]) == r["text"] and r["x1"] - r["x0"] <= W.TEXT_WIDTH
        edges = [(s["bbox"]["x0"], s["bbox"]["x1"]) for s in r["symbols"]]
        assert edges[0][0] == r["x0"] and edges[-1][1] == r["x1"] and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    tops = sorted((r["line_no"], r["y0"]) for r in rows if r["doc_id"] == 1)
    assert [y for _, y in tops] == sorted(y for _, y in tops)


def test_detectors_hide_what_is_drawn(spark):
    """End to end: each box covers just the characters of its text."""
    df = spark.createDataFrame(MESSAGES, "doc_id long, seq long, sender string, text string")
    lines = engine.page_lines(W.drawn_lines(df))
    drawn = {(r["doc_id"], s["bbox"]["x0"], s["bbox"]["y0"]): s["text"] for r in lines.collect() for s in r["aligned"]}
    boxes = engine.boxes(lines, engine.Options(padding=0.0)).collect()
    assert {b["text"] for b in boxes} >= {"株式会社テックラボ", "佐藤さん", "090-1234-5678", "tanaka@frontier-sample.jp"}
    for b in boxes:
        inside = [t for (d, x, y), t in sorted(drawn.items(), key=lambda kv: (kv[0][2], kv[0][1])) if d == b["doc_id"] and b["y"] <= y < b["y"] + b["h"] and b["x"] <= x and x + 10 <= b["x"] + b["w"]]
        assert "".join(inside).replace(" ", "") == b["text"].replace(" ", ""), b


def test_a_page_of_a_hundred_thousand_lines(spark):
    """Labels and values on one page: linear in the lines, where all pairs would be 2.5e9."""
    text = F.when(F.col("id") % 4 == 0, "TEL").when(F.col("id") % 4 == 1, F.concat(F.lit("090-1234-"), F.lpad((F.col("id") % 10_000).cast("string"), 4, "0"))).when(F.col("id") % 4 == 2, "alice 10:24").otherwise("hello there")
    top = F.floor(F.col("id") / 2) * 30.0
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("line_no"), text.alias("text"), (10.0 + 200 * (F.col("id") % 2)).alias("x0"), top.alias("y0"), (110.0 + 200 * (F.col("id") % 2)).alias("x1"), (top + 20).alias("y1"), F.lit(90.0).alias("confidence"))
    begin = time.time()
    values = L.label_values(df)
    assert values.count() == 25_000 and values.filter("value_line = label_line + 1").count() == 25_000
    assert L.sender_headers(df).count() == 24_999  # all but the last have a line below
    drags = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("drag_id"), F.lit(12.0).alias("sx"), (F.col("id") * 30.0 + 10).alias("sy"), F.lit(100.0).alias("cx"), (F.col("id") * 30.0 + 12).alias("cy"))
    assert L.snap_drags(drags, df).filter("snapped").count() == 1000
    assert time.time() - begin < 120


def test_edges_and_selections():
    page = E.Page()
    todo = [("add", {"id": "a", "rect": [10, 5, 20, 9]}), ("add", {"id": "b", "rect": [50, 5, 20, 9]}), ("drag_edge", {"id": "a", "fixed": 10, "x": 40}), ("drag_edge", {"id": "a", "fixed": 10, "x": 4.0}), ("drag_edge", {"id": "a", "fixed": 10, "x": 4.2})]
    for op, p in todo:
        page.apply(op, p)
    assert page.boxes[0]["rect"] == [4.0, 5, 8, 9] and len(page.history) == 3
    page.apply("drop_edge", {})
    page.apply("drop_edge", {})
    assert len(page.history) == 4
    page.apply("undo", {})
    assert page.boxes[0]["rect"] == [10, 5, 20, 9]
    for op, p, selected, anchor in [("toggle_select", {"id": "a"}, ["b", "a"], "a"), ("toggle_select", {"id": "a"}, ["b"], "b"), ("toggle_select", {"id": "no"}, ["b"], "b"), ("marquee", {"base": ["b"], "ids": ["a", "b"]}, ["b", "a"], "b"), ("select_all", {}, ["a", "b"], "b"), ("select", {"ids": []}, [], None), ("marquee", {"ids": ["a", "b"]}, ["a", "b"], "b")]:
        page.apply(op, p)
        assert (page.selected, page.anchor) == (selected, anchor), op
    assert json.loads(json.dumps(page.__dict__))["dragged"] is False
