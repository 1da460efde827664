import json

import pytest

from maskora.operators import boxes as B
from maskora.operators import layout as L
from maskora.operators import propagate as P
from maskora.operators import redact as R
from maskora.sources import pages as S
from maskora.streaming import edits as E

LINES = "doc_id long, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"
BOXES = "doc_id long, box_id string, seq int, type string, label string, text string, x double, y double, w double, h double, rotation double, enabled boolean, is_manual boolean"


def lines(spark, *rows):
    return spark.createDataFrame([(1, i, t, *map(float, b), 90.0) for i, (t, b) in enumerate(rows)], LINES)


def boxes(spark, *rows):
    return spark.createDataFrame([(1, f"b{i}", i, kind, label, text, *map(float, r), 0.0, True, kind == "manual") for i, (kind, label, text, r) in enumerate(rows)], BOXES)


def test_label_values(spark):
    df = lines(spark, ("氏名", (10, 10, 50, 30)), ("山田太郎", (420, 10, 520, 30)), ("09012345678", (10, 34, 170, 54)), ("住所", (10, 80, 50, 100)), ("東京都港区芝1-2", (10, 104, 150, 124)), ("芝ビル3号室", (10, 126, 150, 146)))
    values = L.label_values(df)
    assert {(r["category"], r["value"]) for r in values.collect()} == {("person", "山田太郎"), ("address", "東京都港区芝1-2")}
    assert [r["value"] for r in L.address_continuations(df, values).collect()] == ["芝ビル3号室"]


def test_senders(spark):
    head, body = ("alice 10:24", (10, 10, 100, 30)), ("hello there", (12, 55, 200, 75))
    assert L.sender_headers(lines(spark, head)).collect() == []
    assert [r["text"] for r in L.sender_headers(lines(spark, head, body)).collect()] == ["alice 10:24"]
    avatars = spark.createDataFrame([(1, -25.0, 5.0, 30.0, 30.0)], "doc_id long, x double, y double, w double, h double")
    assert [r["text"] for r in L.sender_headers(lines(spark, ("bob", (10, 10, 60, 30)), body), avatars).collect()] == ["bob"]


@pytest.mark.parametrize("second,n", [((60, 10, 100, 20), 2), ((10, 0, 30, 20), 1)])
def test_dedupe(spark, second, n):
    assert B.dedupe_boxes(boxes(spark, ("pii", "電話番号", "", (0, 0, 100, 20)), ("person", "人名", "x", second))).count() == n


def test_merges(spark):
    near = boxes(spark, ("pii", "a", "x", (0, 0, 10, 20)), ("pii", "a", "y", (11, 0, 10, 20)), ("pii", "a", "z", (40, 0, 10, 20)), ("person", "人名", "山田様", (51, 0, 10, 20)))
    assert {r["text"] for r in B.merge_adjacent(near).collect()} == {"xy", "z", "山田様"}
    split = lines(spark, ("Hello", (0, 0, 50, 20)), ("world", (60, 1, 110, 21)), ("次の行", (0, 40, 60, 60)))
    assert {r["text"] for r in B.merge_fragments(split).collect()} == {"Hello world", "次の行"}


def test_redacted_text(spark):
    df = lines(spark, ("📩山田と会話", (0, 0, 60, 20)), ("   ", (0, 30, 60, 50)), ("電話: 03-1234-5678", (0, 60, 180, 80)))
    bx = boxes(spark, ("person", "人名", "山田", (10, 0, 20, 20)), ("pii", "電話番号", "03-1234-5678", (0, 200, 5, 5)), ("pii", "電話番号", "03-1234-5678", (0, 62, 5, 5)))
    assert R.redacted_text(df, bx).first()["redacted_text"].startswith("📩 [人名]と会話\n")
    assert R.redaction_stats(df, bx).first()["person"] == 1
    assert "---" in R.with_instruction(R.redacted_text(df, bx), "reply").first()["redacted_text"]


def test_propagation(spark):
    texts = ["山田太郎が来た", "山田次郎", "山田太郎町", "田山田太郎", "📩 山 田 太 郎に相談、山田太郎へ連絡", "ABC Inc in ABC Incidental", "ＡＢＣ Ｉｎｃ"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")
    names = spark.createDataFrame([(1, "person", "山田太郎"), (1, "company", "abcinc")], "doc_id long, kind string, entity string")
    got = {(r["line_no"], r["text"]) for r in P.propagate(df, names).collect()}
    assert got == {(0, "山田太郎"), (4, "山 田 太 郎"), (4, "山田太郎"), (5, "ABC Inc"), (6, "ＡＢＣ Ｉｎｃ")}
    hits = {(r["line_no"], r["start"], r["end"]) for r in P.keyword_hits(df, ["ABC inc ", "", "太郎"]).collect()}
    assert (6, 0, 7) in hits and (0, 2, 4) in hits and (4, 6, 9) in hits


def test_geometry(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(L.range_box(F.lit(2), F.lit(4), F.lit(6), F.lit(100.0), F.lit(100.0), F.lit(160.0), F.lit(120.0)).alias("b"), L.padded(*map(F.lit, (100.0, 100.0, 80.0, 60.0)), 2.0, F.lit(500.0), F.lit(500.0), True).alias("p")).first()
    assert tuple(row["b"]) == (120.0, 100.0, 20.0, 20.0)
    assert row["p"]["x"] <= 94 and row["p"]["y"] <= 96 and row["p"]["w"] >= 92 and row["p"]["h"] >= 68
    a = spark.createDataFrame([(1, 10.0, 100.0, 80.0, 20.0)], "doc_id long, x double, y double, w double, h double")
    b = spark.createDataFrame([(1, 102.0, 98.0, 16.0, 24.0)], a.schema)
    assert tuple(L.absorb_strokes(a, b, 1.6).first())[1:5] == (10.0, 98.0, 108.0, 24.0)
    drags = spark.createDataFrame([(1, 1, 12.0, 15.0, 98.0, 18.0), (1, 2, 12.0, 15.0, 98.0, 300.0)], "doc_id long, drag_id int, sx double, sy double, cx double, cy double")
    snapped = {r["drag_id"]: r for r in L.snap_drags(drags, lines(spark, ("x", (10, 10, 100, 30)))).collect()}
    assert tuple(snapped[1])[2:] == (0, 9.0, 8.0, 92.0, 24.0, True) and not snapped[2]["snapped"]
    shapes = spark.createDataFrame([(1, "r", 1, "rect", 0.0, 0.0, 100.0, 50.0, 4.0), (1, "e", 2, "ellipse", 200.0, 0.0, 300.0, 60.0, 4.0), (1, "a", 3, "arrow", 0.0, 100.0, 100.0, 100.0, 4.0)], "doc_id long, shape_id string, seq int, kind string, x1 double, y1 double, x2 double, y2 double, width double")
    points = spark.createDataFrame([(1, 1, 0.0, 25.0), (1, 2, 50.0, 25.0), (1, 3, 250.0, 0.0), (1, 4, 250.0, 30.0), (1, 5, 50.0, 103.0)], "doc_id long, point_id int, px double, py double")
    assert {r["point_id"]: r["shape_id"] for r in L.shape_at(shapes, points, 6.0).collect()} == {1: "r", 3: "e", 5: "a"}


EVENTS = [("add", {"id": f"b{i}", "rect": [0, 0, 10, 10]}) for i in range(3)] + [("update", {"ids": ["b0", "b1"], "patch": {"label": "x"}}), ("undo", {}), ("add", {"id": "small", "rect": [0, 0, 4, 9]}), ("toggle", {"id": "b1"}), ("select", {"ids": ["b0", "b2", "b0", "no"]}), ("remove", {"id": "b2"})]


def events(spark, todo=EVENTS, doc_id=1):
    return spark.createDataFrame([(doc_id, i, op, json.dumps(p)) for i, (op, p) in enumerate(todo)], "doc_id long, seq long, op string, payload string")


def test_edits(spark):
    row = E.replay(events(spark)).first()
    found = json.loads(row["boxes"])
    assert [b["id"] for b in found] == ["b0", "b1"] and [b["label"] for b in found] == ["手動", "手動"] and [b["enabled"] for b in found] == [True, False]
    assert row["anchor"] == "b0" and json.loads(row["selected"]) == ["b0"] and row["depth"] == 6 and not row["can_redo"]
    for n in (29, 30, 31):
        row = E.replay(events(spark, [("add", {"id": str(i), "rect": [0, 0, 9, 9]}) for i in range(n)] + [("undo", {})] * 40)).first()
        assert len(json.loads(row["boxes"])) == max(0, n - 29)
    moves = [("add_shape", {"shape": {"id": "s", "x1": 10}}), ("update_shape", {"id": "s", "patch": {"x1": 20}, "record": False}), ("update_shape", {"id": "s", "patch": {"x1": 30}, "record": False}), ("commit", {})]
    state = lambda tail: E.replay(events(spark, moves + tail)).first()["shapes"]
    assert [json.loads(state([("undo", {})] * k)) for k in range(3)] == [[{"id": "s", "x1": 30}], [{"id": "s", "x1": 10}], []]


def test_sources(spark):
    blobs = spark.createDataFrame([("./jpn.traineddata", bytearray(3000)), ("a/eng.traineddata", bytearray(5000)), ("other", bytearray(9))], "key string, value binary")
    assert tuple(S.cache_stats(blobs).first()) == (2, 8000, ["eng", "jpn"], True)
    assert [r["key"] for r in S.without_models(blobs).collect()] == ["other"]
    box = (0.0, 0.0, 9.0, 9.0)
    tree = spark.createDataFrame([(1, None, [([([(" ab ", box, 80.0, [("ab", box, 80.0, [("a", box, 1.0), ("b", box, 1.0)])]), ("  ", box, 1.0, [])],)],)])], S.RECOGNITION)
    row = S.flatten_recognition(tree).first()
    assert row["text"] == "ab" and len(row["symbols"]) == 2 and S.full_text(tree).first()["full_text"] == "ab"


def test_long_log_is_carried_over_batches(spark):
    todo = [(op, {"id": f"b{i % 7}", "rect": [0, 0, 9 + i % 5, 9], "patch": {"label": str(i)}}) for i in range(60) for op in ("add", "toggle", "update", "undo")]
    page = E.Page()
    for op, p in todo:
        page.apply(op, p)
    table = events(spark, todo, 1).union(events(spark, EVENTS, 2)).union(events(spark, todo, 3)).union(events(spark, EVENTS, None)).union(events(spark, [("open", {})], 4))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 7)
    try:
        done = E.replay(table)
        got = {r["doc_id"]: r.asDict() for r in done.collect()}
    finally:
        spark.conf.set(batch, before)
    assert set(got) == {1, 2, 3, 4, None} and all(got[k] == page.row(k, len(todo) - 1) for k in (1, 3))
    assert got[2]["boxes"] == got[None]["boxes"] == E.replay(events(spark)).first()["boxes"] and got[4]["seq"] == 0
    assert "collect_list" not in done._jdf.queryExecution().toString()
