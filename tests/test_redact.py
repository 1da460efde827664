"""What a span covers never stays readable, however spans overlap; and what is redacted holds nothing that the detectors find."""

import itertools
import random
import re

from pyspark.sql import functions as F

from maskora import engine
from maskora.operators import redact as R

SPANS = "id int, line string, spans array<struct<start:int,end:int,type:string,label:string,text:string>>"


def redacted(spark, rows):
    df = spark.createDataFrame([(i, line, [(a, b, "pii", label, line[a:b]) for a, b, label in spans]) for i, (line, spans) in enumerate(rows)], SPANS)
    return [r["out"] for r in df.select("id", R.redact_spans(F.col("line"), F.col("spans")).alias("out")).orderBy("id").collect()]


def test_chained_nested_and_equal_spans(spark):
    line = "AAAAABBBBBCCCCCDDDDDEEEEE"
    rows = [
        (line, [(0, 10, "a"), (5, 15, "b"), (12, 20, "c")]),
        (line, [(0, 20, "a"), (5, 10, "b"), (18, 25, "c")]),
        (line, [(5, 10, "b"), (5, 10, "a"), (5, 15, "c")]),
        (line, [(0, 5, "人名"), (5, 10, "人名 (文書内一致)"), (15, 20, "x")]),
        (line, []),
    ]
    assert redacted(spark, rows) == ["[a]EEEEE", "[a]", "AAAAA[c]DDDDDEEEEE", "[人名]CCCCC[x]EEEEE", line]


def test_no_covered_character_stays(spark):
    rng = random.Random(3)
    line = "".join(chr(0x4E00 + i) for i in range(40))
    rows = []
    for _ in range(200):
        spans = []
        for _ in range(rng.randrange(1, 7)):
            a = rng.randrange(39)
            spans.append((a, rng.randrange(a + 1, 41), rng.choice("xyz")))
        rows.append((line, spans))
    for (_, spans), out in zip(rows, redacted(spark, rows), strict=True):
        hidden = set(itertools.chain.from_iterable(range(a, b) for a, b, _ in spans))
        assert [c for c in out if c in line] == [c for i, c in enumerate(line) if i not in hidden]


def test_nothing_is_found_in_redacted_lines(spark):
    """With names found again across the document's lines; what is left is redacted once more and does not change."""
    texts = ["氏名: 山田太郎 TEL: 090-1234-5678", "山田太郎様より連絡", "トヨタ自動車株式会社 三菱銀行", "Email: a@example.jp Password: pw-1234", "担当 山田太郎 です", None, ""]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")
    out = {r["line_no"]: r["redacted"] for r in engine.redact_plain(lines).collect()}
    assert len(out) == len(texts) and out[5] is None and out[6] == ""
    assert out[4] == "担当 [人名] です"
    bare = [(1, i, re.sub(r"\[[^\]]*\]", "", t)) for i, t in out.items() if t]
    again = engine.redact_plain(spark.createDataFrame(bare, "doc_id long, line_no int, line string"), engine.Options(propagate=False))
    assert [(r["line_no"], r["redacted"]) for r in again.orderBy("line_no").collect()] == [(i, t) for _, i, t in sorted(bare)]


def test_lines_beyond_the_range_of_whole_numbers(spark):
    schema = "doc_id long, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"
    lines = spark.createDataFrame([(1, 300_000, "TEL: 090-1234-5678", 10.0, 10.0, 190.0, 30.0, 90.0)], schema)
    assert [r["label"] for r in engine.boxes(lines).collect()] == ["電話番号"]
