"""Folds of a page's rows: only pages on which two rows may be one are folded, and nothing depends on how batches cut them."""

import random

import pytest

from maskora.operators import boxes as B

BOX = "doc_id long, box_id string, seq int, type string, label string, text string, x double, y double, w double, h double, rotation double, enabled boolean, is_manual boolean, extra array<int>"
LINE = "doc_id long, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, raw_text string"


def some_boxes() -> list[dict]:
    r = random.Random(5)
    out = []
    for doc in (None, *range(150)):
        for seq in range(r.choice((1, 2, 6, 30))):
            out.append({
                "doc_id": doc, "box_id": f"b{seq}", "seq": seq, "type": r.choice(("person", "pii", "face", "custom")), "label": "l", "text": r.choice((None, "", "a", "b様")), "x": r.choice((0.0, 1.0, 19.0, 21.0, 40.0, 400.0)),
                "y": r.choice((0.0, 1.0, 50.0)), "w": r.choice((0.0, 20.0, 22.0)), "h": r.choice((0.0, 17.0, 18.0)), "rotation": r.choice((None, 0.0, 2.0)), "enabled": r.random() < 0.9, "is_manual": r.random() < 0.1, "extra": [seq],
            })
    return out


def some_lines() -> list[dict]:
    r = random.Random(6)
    out = []
    for doc in (None, *range(150)):
        for n in range(r.choice((1, 2, 6, 30))):
            x, y, text = r.choice((0.0, 25.0, 60.0, 400.0)), r.choice((0.0, 3.0, 30.0)), r.choice(("ab", "漢字", "c"))
            out.append({"doc_id": doc, "line_no": n, "text": text, "x0": x, "y0": y, "x1": x + 10 * len(text), "y1": y + r.choice((0.0, 16.0, 18.0)), "confidence": float(n), "raw_text": r.choice((None, text))})
    return out


def by_page(rows: list[dict], page) -> list[str]:
    pages: dict = {}
    for x in rows:
        pages.setdefault(x["doc_id"], []).append(x)
    return sorted(str(x) for rows in pages.values() for x in page(rows))


@pytest.mark.parametrize("name", ["dedupe_boxes", "merge_adjacent", "merge_fragments"])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_pages_are_whole_however_batches_cut_them(spark, name, batch):
    rows, schema = (some_lines(), LINE) if name == "merge_fragments" else (some_boxes(), BOX)
    page = getattr(B, {"dedupe_boxes": "dedupe_page"}.get(name, f"{name}_page"))
    wanted = by_page(rows, page)
    assert len(wanted) < len(rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        found = getattr(B, name)(spark.createDataFrame([tuple(x.values()) for x in rows], schema).repartition(5))
        assert sorted(str(x.asDict(True)) for x in found.collect()) == wanted
        assert found.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        assert getattr(B, name)(spark.createDataFrame([], schema)).count() == 0
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["dedupe_boxes", "merge_adjacent", "merge_fragments"])
def test_pages_are_not_gathered_into_arrays(spark, name):
    """Every page went to Python as an array of rows and back, whether or not anything was to be joined."""
    rows = spark.createDataFrame([], LINE if name == "merge_fragments" else BOX)
    plan = getattr(B, name)(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan
