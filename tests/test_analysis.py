"""Candidates, new analyses, results kept by content, and the engine's front door on whole pages."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from maskora import engine
from maskora.operators import analysis as A
from maskora.operators import boxes as B
from maskora.operators import candidates as C
from maskora.operators import layout as L
from maskora.operators import redact as R
from maskora.operators import symbols as Y
from maskora.sources import memo

AREA = "doc_id long, cand_id long, x double, y double, w double, h double, confidence double"


def areas(rng, n, side=60.0):
    return [(d, i, rng.uniform(-50, 600), rng.uniform(-50, 600), rng.choice([0.0, side, side * 3, side / 4]), rng.choice([side, side / 2, -1.0]), rng.choice([0.5, 0.7, 0.7, 0.9])) for d in (1, 2) for i in range(n)]


def share(a, b):
    wide, high = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return wide * high / min(a[4] * a[5], b[4] * b[5]) if a[0] == b[0] and wide > 0 and high > 0 else 0


def test_candidates_against_all_pairs(spark):
    rng = random.Random(1)
    ours, texts = areas(rng, 80), areas(rng, 25)
    df = spark.createDataFrame([*ours, (3, 1, None, 0.0, 5.0, 5.0, 0.5), (None, 1, 0.0, 0.0, 5.0, 5.0, 0.5)], AREA)
    clear = C.apart_from(df, spark.createDataFrame(texts, AREA), 0.15)
    want = {(a[0], a[1]) for a in ours if not any(share(a, t) >= 0.15 for t in texts)} | {(3, 1), (None, 1)}
    assert {(r["doc_id"], r["cand_id"]) for r in clear.collect()} == want
    for most in (20, 3):
        kept = []
        for d in (1, 2):
            mine = []
            for a in sorted((a for a in ours if a[0] == d), key=lambda a: (-a[6], a[1])):
                if len(mine) < most and all(share(a, k) < 0.3 for k in mine):
                    mine.append(a)
            kept += [(a[0], a[1], n) for n, a in enumerate(mine, 1)]
        got = C.suppressed(spark.createDataFrame(ours, AREA), 0.3, most).collect()
        assert sorted((r["doc_id"], r["cand_id"], r["place"]) for r in got) == sorted(kept)


def test_candidates_of_empty_tables(spark):
    none = spark.createDataFrame([], AREA)
    some = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0, 0.5)], AREA)
    assert C.accepted(none, some).count() == 0 and C.accepted(some, none).count() == 1 and C.accepted(some, none, some).count() == 0
    plan = C.apart_from(some, some)._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_x" in plan and "Cartesian" not in plan


BOX = "doc_id long, box_id string, seq long, type string, label string, is_manual boolean"


def test_reanalysis(spark):
    current = spark.createDataFrame([(1, "a", 1, "person", "edited", False), (1, "m", 2, "manual", "own", False), (1, "both", 3, "pii", "own", True), (2, "n", 7, "custom", "own", True), (3, "gone", 1, "pii", "old", False), (1, "m", 9, "manual", "again", True)], BOX)
    found = spark.createDataFrame([(1, "a", 10, "person", "new", False), (1, "both", 11, "pii", "new", False), (4, "x", 5, "pii", "new", None)], BOX)
    rows = lambda df: sorted(map(tuple, df.collect()))
    once = A.reanalysed(current, found)
    assert rows(once) == [(1, "a", 10, "person", "new", False), (1, "both", 13, "pii", "own", True), (1, "m", 12, "manual", "own", False), (2, "n", 1, "custom", "own", True), (4, "x", 5, "pii", "new", None)]
    assert rows(A.reanalysed(once, found)) == rows(once)
    none = spark.createDataFrame([], BOX)
    assert rows(A.reanalysed(none, found)) == rows(found) and rows(A.reanalysed(current, none)) == [(1, "both", 2, "pii", "own", True), (1, "m", 1, "manual", "own", False), (2, "n", 1, "custom", "own", True)]


def test_selection_after_a_change(spark):
    picked = spark.createDataFrame([(1, "a", 0, True), (1, "b", 1, False), (1, "c", 2, False), (2, "a", 0, False), (2, "b", 1, True), (3, "z", 0, True)], "doc_id long, box_id string, pos int, anchor boolean")
    boxes = spark.createDataFrame([(1, "b"), (1, "c"), (1, "c"), (2, "b"), (2, "a")], "doc_id long, box_id string")
    assert sorted(map(tuple, A.pruned_selection(picked, boxes).collect())) == [(1, "b", 1, False), (1, "c", 2, True), (2, "a", 0, False), (2, "b", 1, True)]


def test_memo_works_out_what_is_new(spark, tmp_path):
    path, seen = str(tmp_path / "memo"), []

    def work(rows):
        seen.append(rows.count())
        return rows.select("memo_key", F.upper("text").alias("result"))

    pages = lambda ids: spark.createDataFrame([(i, f"text {i % 90}" if i % 7 else None, i) for i in ids], "id long, text string, memo_extra long")
    first = memo.memoised(pages(range(100)), ["text"], work, path)
    assert {(r["id"], r["result"]) for r in first.collect()} == {(i, f"TEXT {i % 90}" if i % 7 else None) for i in range(100)} and first.columns == ["id", "text", "memo_extra", "result"]
    distinct = len({i % 90 for i in range(100) if i % 7}) + 1
    memo.memoised(pages(range(100)), ["text"], work, path)
    more = spark.createDataFrame([(1, "text 1", 1), (500, "new", 1), (501, "new", 1)], "id long, text string, memo_extra long")
    assert [r["result"] for r in memo.memoised(more, ["text"], work, path).orderBy("id").collect()] == ["TEXT 1", "NEW", "NEW"]
    memo.memoised(more, ["text"], work, path, options="other")
    assert seen == [0, distinct, 0, 0, 0, 1, 0, 2]
    assert spark.read.parquet(path).count() == distinct + 3


PAGE = "doc_id long, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def line(no, text, y, x=10.0, step=10.0, confidence=90.0, doc=1):
    return (doc, no, text, x, float(y), x + step * len(text), float(y) + 20, confidence)


def found(spark, rows, options=engine.Options(), **more):
    return engine.boxes(spark.createDataFrame(rows, PAGE), options, **more).collect()


PLAIN = ["設定", "資料 作成", "山口県", "氏名: 山田太郎", "Email: taro@example.jp", "また山田太郎へ"]


def test_switches(spark):
    rows = [line(k, t, 100 + 50 * k) for k, t in enumerate(PLAIN)]
    assert {b["type"] for b in found(spark, rows, engine.Options(persons=False))} == {"pii"}
    rows = [line(0, "氏名: 勅使河原花子", 100), line(1, "Email: taro@example.jp", 150)]
    assert {(b["type"], b["text"]) for b in found(spark, rows, engine.Options(pii=False))} == {("person", "勅使河原花子")}


def test_pages_through_the_front_door(spark):
    """Plain lines on page 2; senders, values beside labels and a slope on page 1; no picture on page 3, hardly a slope on page 4."""
    first = [line(0, "alice 10:24", 100), line(1, "本文の連絡です", 125), line(2, "bob", 160), line(3, "もう一つの本文", 185), line(4, "住所", 300, confidence=99.0), line(5, "東京都港区芝1-2", 300, x=200.0, confidence=99.5), line(6, "芝ビル3階 305号室", 322, x=200.0), line(7, "担当者", 400), line(8, "勅使河原花子", 400, x=200.0), line(9, "勅使河原花子に聞く", 450)]
    rows = first + [line(k, t, 100 + 50 * k, doc=2) for k, t in enumerate(PLAIN)] + [(3, *r[1:]) for r in first[2:4]] + [(4, *r[1:]) for r in first[:2]]
    avatars = spark.createDataFrame([(1, 0.0, 155.0, 8.0, 30.0)], "doc_id long, x double, y double, w double, h double")
    angles = spark.createDataFrame([(1, 2.5), (4, 0.5)], "doc_id long, angle double")
    every = found(spark, rows, avatars=avatars, angles=angles)
    got = {(b["label"], b["text"]): b for b in every if b["doc_id"] == 1}
    assert ("送信者名", "alice") in got and ("送信者名", "bob") in got and got["送信者名", "alice"]["reason"] == "チャット送信者名の推定"
    assert any(k[0] == "住所" and k[1].startswith("東京都港区芝1-2") for k in got)
    assert any("芝ビル3階" in k[1] for k in got)
    assert ("人名", "勅使河原花子") in got and ("人名 (文書内一致)", "勅使河原花子") in got
    assert got["人名", "勅使河原花子"]["confidence"] == 0.9 and all(b["rotation"] == 2.5 for b in got.values())
    assert all(b["confidence"] <= 0.98 for b in got.values() if "項目ラベル" in b["reason"])
    second = [b for b in every if b["doc_id"] == 2]
    assert {(b["type"], b["text"]) for b in second} >= {("person", "山田太郎"), ("pii", "taro@example.jp")} and all(b["y"] >= 245 for b in second)
    assert sum(b["text"] == "山田太郎" for b in second) == 2
    assert not [b for b in every if b["doc_id"] == 3 and b["label"] == "送信者名"]
    assert {(b["text"], b["rotation"]) for b in every if b["doc_id"] == 4} == {("alice", 0.0)}


def test_pieces_of_a_line_with_symbols(spark):
    """Two pieces of one line become one, and ranges get their boxes from the characters' own."""
    def piece(no, text, x):
        symbols = [(c, (x + 12.0 * i, 100.0, x + 12.0 * i + 12, 120.0), 90.0) for i, c in enumerate(text)]
        return (1, no, text, x, 100.0, x + 12.0 * len(text), 120.0, 90.0, [], symbols)

    df = spark.createDataFrame([piece(0, "氏名: ", 10.0), piece(1, "山 田 太 郎", 62.0), (1, 2, "ab", 10.0, 300.0, 30.0, 320.0, 50.0, None, None)], PAGE + f", words {Y.SYMBOLS}, symbols {Y.SYMBOLS}")
    lines = engine.page_lines(df)
    row = lines.filter("text like '氏名%'").first()
    assert row["text"] == "氏名: 山田太郎" and len(row["aligned"]) == len(row["text"]) and lines.count() == 2
    boxes = engine.boxes(lines)
    b = [b for b in boxes.collect() if b["text"] == "山田太郎"][0]
    assert (b["x"], b["w"]) == (62.0 - 3, 12 * 7 + 6.0)
    cover = R.character_cover(lines, boxes).filter("line_no = 0").collect()
    assert sorted(c["pos"] for c in cover) == [4, 5, 6, 7]


def test_small_rules(spark):
    lines = spark.createDataFrame([line(0, "a", 0), line(1, "b", 50)], PAGE)
    pages = spark.createDataFrame([(1, 1000.0), (2, 1000.0), (3, 100.0)], "doc_id long, height double")
    assert {r[0]: r[1] for r in L.typical_line_height(lines, pages).collect()} == {1: 24.0, 2: 22.0, 3: 16.0}
    status = spark.createDataFrame([(1, "ok"), (2, "ok"), (1, "timeout"), (1, None)], "doc_id long, status string")
    assert [tuple(r) for r in L.usable_results(status, lines).collect()] == [(1, "ok")]
    boxes = spark.createDataFrame([(k, t, m, w, 9.0) for k, (t, m, w) in enumerate([("pii", False, 9.0), ("pii", True, 9.0), ("face", False, 9.0), ("manual", False, 9.0), ("person", None, 3.9), ("person", None, 4.0)])], "k int, type string, is_manual boolean, w double, h double")
    assert [r["k"] for r in L.text_boxes(boxes).orderBy("k").collect()] == [0, 5]
    labels = [("person", "人名 (文書内一致)", "人名"), ("pii", " 電話番号", "TEL"), ("pii", "", "個人情報"), ("manual", "手動指定", "手動"), ("custom", "my own", "my own"), ("pii", "PW", "PW"), ("face", None, "顔写真"), ("else", None, ""), ("pii", "Card No", "カード"), ("company", "手動", "会社名")]
    df = spark.createDataFrame([(a, b) for a, b, _ in labels], "kind string, label string")
    assert [r[0] for r in df.select(R.compact_label(F.col("kind"), F.col("label"))).collect()] == [c for *_, c in labels]
    texts = spark.createDataFrame([(1, "x")], "doc_id long, redacted_text string")
    assert R.with_instruction(texts).first()[1].startswith("以下のチャット履歴の要点") and R.with_instruction(texts, "none").first()[1] == "x"


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[:3])
def test_fragments_keep_their_characters(order):
    def row(no, text, x):
        return {"line_no": no, "text": text, "raw_text": text, "x0": x, "y0": 0.0, "x1": x + 10 * len(text), "y1": 20.0, "confidence": 80.0, "words": None, "symbols": [], "aligned": [{"text": c, "bbox": {"x0": x + 10 * i, "y0": 0.0, "x1": x + 10 * i + 10, "y1": 20.0}, "confidence": 1.0} for i, c in enumerate(text)]}

    rows = [row(0, "ab", 0.0), row(1, "cd", 30.0), row(2, "山", 52.0)]
    made = B.merge_fragments_page([rows[i] for i in order])
    assert len(made) == 1 and made[0]["text"] == "ab cd山" and "".join(e["text"] for e in made[0]["aligned"]) == made[0]["text"]
