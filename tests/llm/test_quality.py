import random
import zlib

import numpy as np

from maskora.llm import quality as q
from tests.llm.fixtures import awkward_docs, docs_frame, prose


def junk(text, rng):
    return " ".join(w + rng.choice(["***", "&&&", "%%%"]) if rng.random() < 0.7 else w.upper() for w in text.split())


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng.randrange(20, 200), i)
        rows.append((i, text if good else junk(text, rng)))
        labels.append((i, int(good), 0))
    frame = spark.createDataFrame([*labels, (None, 1, 0), (10**6, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = q.quality_scores(docs_frame(spark, rows), frame).collect()
    truth = {i: y for i, y, _ in labels}
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_awkward_rows_and_no_labels(spark):
    rows = awkward_docs()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.quality_scores(docs_frame(spark, rows), none).collect()
    assert len(got) == len(rows) and all(r["predicted"] == 1 for r in got)
    assert q.quality_scores(docs_frame(spark, []), none).collect() == []
    assert q.accepted(docs_frame(spark, rows), none).count() == len(rows)


def test_statistics_do_not_depend_on_the_batch():
    texts = [t for _, t in awkward_docs()] + ["A!b\nA!b\n\n", "é 1"]
    whole = q.statistics(texts)
    assert np.allclose(whole, np.concatenate([q.statistics([t]) for t in texts]))
    assert not whole[60:62].any()
    row = dict(zip(q.FEATURES, q.statistics(["Ab ab\nAb ab\nxx 12"])[0], strict=True))
    assert row["words_distinct"] == 3 / 6 and row["lines_distinct"] == 2 / 3 and row["commonest_word"] == 4 / 6 and row["digit"] == 2 / 17


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < 0)).astype(float)
    forest = q.fit(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97
    for row, score in zip(x[:20], forest.score(x[:20]), strict=True):
        total = forest.start
        for f, t, v in zip(forest.features, forest.thresholds, forest.leaves, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - len(f)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
