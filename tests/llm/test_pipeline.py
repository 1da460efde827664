import hashlib
import random

import corpus_pipeline
from maskora.llm import decontaminate, quality
from tests.llm.fixtures import awkward_docs, prose
from tests.llm.test_bpe_codec import PLAIN
from tests.llm.test_near_dedup import brute, groups
from tests.llm.test_quality import junk


def test_run_equals_plain_stages(spark, tmp_path):
    rng = random.Random(4)
    rows = {i: t for i, t in [*awkward_docs(), *groups(9)[:300]] if i is not None}
    rows |= {5000 + i: junk(prose(60, 7000 + i), rng) for i in range(60)}
    item = prose(25, 99_999)
    rows |= {6000 + i: f"{prose(30, 8000 + i)} {item} {prose(30, 9000 + i)}" for i in range(5)}
    labels = [(i, int(not 5000 <= i < 5060), 0) for i in rows if i % 3]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "absent words of an item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    good = {r["doc_id"] for r in quality.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r["predicted"]}
    assert good and {i for i in rows if 5000 <= i < 5060}.isdisjoint(good)
    kept = sorted(good)
    last = {rows[i] or "": i for i in kept}
    kept = sorted(last.values())
    kept = [i for i, _, _, stays in brute([(i, rows[i]) for i in kept], 5) if stays]
    kept = [i for i in kept if not 6000 <= i < 6005]
    want = []
    for i in kept:
        ids = PLAIN.encode_ordinary(rows[i] or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((rows[i] or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, folder)
            assert out.columns == docs.columns and out.count() == frame.count()
    assert decontaminate.EDITS == 0.2
