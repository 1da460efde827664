"""Work that follows few bytes is dealt to many tasks, and nothing costly is worked out twice on its way."""

import pytest

from maskora.operators import spans as S
from maskora.sources.tables import jp_lines

SF_DIR = "/root/testdata/sf0.001"


def test_customer_lines_are_dealt_to_all_cores(spark, tmp_path):
    """One small file is one split; the detectors on its lines are not one task."""
    spark.range(400).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    lines = jp_lines(spark, str(tmp_path))
    sizes = lines.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 400 and sum(n > 0 for n in sizes) >= 8
    found = S.detect_pii(lines, [r for r in S.FREE if r.category == "money"])
    found.collect()
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alignment_is_planned_once(spark):
    """A filter on the aligned text went below the alignment, and worked it out once more."""
    from maskora.plans import catalogue

    filters = [x for x in _plan(catalogue.queries()["range_boxes"](spark, SF_DIR)).splitlines() if x.lstrip(" +-:").startswith("Filter")]
    assert not any("transform" in x or "lambda" in x for x in filters)


def test_address_lines_are_read_where_they_were_written(spark):
    """Both steps found all labels' values anew."""
    from maskora.plans import catalogue

    plan = _plan(catalogue.queries()["layout_address_continuation"](spark, SF_DIR))
    assert "Join" not in plan and "l_partkey" not in plan


def test_covered_characters_are_no_lambda(spark):
    """Each character's condition is one on rows; only the occurrences of a box's text are a lambda."""
    from maskora.operators import redact as R
    from maskora.plans import catalogue as K

    plan = _plan(R.character_cover(K.ocr_lines(spark, SF_DIR), K.page_boxes(spark, SF_DIR)))
    assert "filter(sequence" not in plan and "explode(sequence(low" in plan


def test_cover_of_odd_boxes(spark):
    """Boxes beside, around and far from a line, narrow and without a number, against each character's own reckoning."""
    import math

    from maskora.operators import redact as R

    text, x0, x1 = "abcdefghij", 10.0, 75.0
    sides = [(-1e300, 2e300), (10.0, 0.0), (13.2, 3.1), (74.0, 50.0), (-40.0, 52.0), (80.0, 5.0), (-9.0, 3.0), (float("-inf"), 30.0), (30.0, float("inf")), (16.5, 6.5), (40.0, 0.4)]
    lines = spark.createDataFrame([(i, 0, text, x0, 0.0, x1, 18.0, 90.0) for i in range(len(sides))], "doc_id long, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    boxes = spark.createDataFrame([(i, "b", 1, "pii", "", "", x, 0.0, w, 18.0, True) for i, (x, w) in enumerate(sides)], "doc_id long, box_id string, seq int, type string, label string, text string, x double, y double, w double, h double, enabled boolean")
    want, share = [], (x1 - x0) / len(text)
    for i, (x, w) in enumerate(sides):
        for k in range(len(text)):
            a, b = math.floor(x0 + k * share + 0.5), math.floor(x0 + (k + 1) * share + 0.5)
            if x <= (a + b) / 2 <= x + w or max(0.0, min(x + w, b) - max(x, a)) / max(1, b - a) >= 0.35:
                want.append((i, k))
    assert sorted((r.doc_id, r.pos) for r in R.character_cover(lines, boxes).collect()) == want


def test_lines_are_rewritten_once(spark):
    """The filter on empty lines, and the one of an inner explode, went below the rewriting."""
    from maskora.plans import catalogue

    for name in ("redacted_text", "redaction_stats"):
        filters = [x for x in _plan(catalogue.queries()[name](spark, SF_DIR)).splitlines() if x.lstrip(" +-:").startswith("Filter")]
        assert not any("array_union" in x for x in filters)


def test_each_distinct_text_is_looked_at_once(spark, monkeypatch):
    """Detectors ran on every line, however often pages say the same; null and empty texts show nothing."""
    from maskora import engine
    from maskora.sources import scratch

    tables, write = {}, scratch.materialised
    monkeypatch.setattr(scratch, "materialised", lambda df, name: tables.setdefault(name, write(df, name)))
    texts = ["佐藤様 a@b.example", "TEL: 090-1234-5678", "", None]
    rows = [(d, n, texts[n % 4], 0.0, 30.0 * n, 90.0, 30.0 * n + 18, 90.0) for d in range(20) for n in range(8)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    found = engine.page_spans(lines, engine.Options(companies=False, propagate=False)).filter("not layout").groupBy("line_no", "label", "start", "end").count().collect()
    assert tables["text-spans"].count() == 4 and tables["label-texts"].count() == 3 and tables["address-texts"].count() == 3
    assert {tuple(x) for x in found} == {(n, *s, 20) for n in (0, 4) for s in (("人名", 0, 3), ("メールアドレス", 4, 15))} | {(n, "電話番号", 5, 18, 20) for n in (1, 5)}
