from pyspark.sql import functions as F

from maskora.operators import selection as C

BOXES = "doc_id long, seq int, label string, y double, h double, enabled boolean, label_scale double, rotation double"


def boxes(spark):
    return spark.createDataFrame([(1, 0, "a", 10.0, 20.0, True, None, 0.0), (1, 1, None, 80.0, 20.0, False, 1.6, 0.5), (2, 0, "a", 0.0, 4.0, False, 1.0, None), (2, 1, "a", 5.0, 4.0, True, 1.0, 0.05)], BOXES)


def test_protection_and_labels(spark):
    df, first = boxes(spark), F.col("seq") == 0
    assert [r["enabled"] for r in C.toggle_protection(df, F.lit(True)).orderBy("doc_id", "seq").collect()] == [False] * 4
    assert [r["enabled"] for r in C.toggle_protection(df, F.col("doc_id") == 2).orderBy("doc_id", "seq").collect()] == [True, False, False, False]
    assert [r["label"] for r in C.relabel(df, F.lit(True), "b").orderBy("doc_id", "seq").collect()] == ["a", None, "b", "b"]
    assert {r["label"] for r in C.relabel(df, F.lit(True), "", touched=True).collect()} == {"", None}
    assert [tuple(r) for r in C.more_with_label(df, first).orderBy("doc_id").collect()] == [(1, "a", 0), (2, "a", 1)]


def test_steps(spark):
    df, every, page = boxes(spark), F.lit(True), F.lit(90.0)
    assert [(r["y"], r["h"]) for r in C.step_thickness(df, every, 1, page).orderBy("doc_id", "seq").collect()] == [(9.0, 22.0), (68.0, 22.0), (0.0, 5.0), (4.5, 5.0)]
    assert [r["y"] for r in C.step_down(df, every, -1, page).orderBy("doc_id", "seq").collect()] == [8.0, 70.0, 0.0, 4.0]
    assert [r["label_scale"] for r in C.step_label_scale(df, every, 1).orderBy("doc_id", "seq").collect()] == [1.1, 1.6, 1.1, 1.1]
    assert [r["rotation"] for r in C.without_rotation(df).orderBy("doc_id", "seq").collect()] == [None, None, None, 0.05]


def test_small_rules(spark):
    words = spark.createDataFrame([(" a ",), ("a",), ("",), (None,)], "keyword string")
    assert [r["keyword"] for r in C.keyword_list(words).collect()] == ["a"]
    row = spark.range(1).select(C.stroke_rotation(F.lit(None).cast("double"), F.lit(0.2), F.lit(True)).alias("a"), C.stroke_rotation(F.lit(0.05), F.lit(3.0), F.lit(True)).alias("b"), C.image_point(F.lit(15.0), F.lit(5.0), F.lit(100.0), F.lit(250.0)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (0.2, None, 25)
