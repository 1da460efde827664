import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskora.llm import decontaminate as dc
from tests.llm.fixtures import awkward_docs, docs_frame


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in items:
            v = words(s)
            if not v or not w or not set(v) & set(w):
                continue
            n = min(len(v), len(w))
            found = [(plain_edits(v, w[a : a + n]), a, n) for a in range(len(w) - n + 1) if len(set(v) & set(w[a : a + n])) >= len(set(v)) * 0.3]
            d_, a, n = min(found, default=(10**9, 0, 0))
            if d_ <= int(dc.EDITS * len(v) + 1e-9):
                out[d, i] = (a, n, d_)
    return out


def planted(seed, n_docs=150):
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, fresh(rng.choice([1, 2, 4, 5, 9, 16, 30, 60]))) for i in range(24)]
    docs = []
    for d in range(n_docs):
        i, item = rng.choice(items)
        k, body = int(dc.EDITS * len(item)), list(item)
        for _ in range(rng.randrange(k + 1)):
            at = rng.randrange(len(body))
            body[at : at + 1] = rng.choice([[], [body[at], "new"], ["other"]]) if len(body) > 3 else ["other"]
        if rng.random() < 0.3:
            body = []
        docs.append((1000 + d, " ".join(fresh(rng.randrange(0, 90)) + body + fresh(rng.randrange(0, 90)))))
    return docs, [(i, " ".join(x).upper() if i % 2 else "\n ".join(x)) for i, x in items]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=90), st.lists(st.integers(0, 4), max_size=90))
def test_edit_distance(a, b):
    assert dc.edits_between(a, b) == plain_edits(a, b)


def test_recall_and_exactness(spark):
    docs, items = planted(1)
    items += [(90, None), (91, " "), (92, items[3][1]), (93, items[3][1])]
    rows = [*awkward_docs(), *docs]
    frame = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, start_word int")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["edits"]) for r in dc.leaks(docs_frame(spark, rows), frame).collect()}
    want = brute(docs, items)
    assert {k: v for k, v in got.items() if k in want}.keys() <= want.keys() and set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and len(want) > 60
    exact = {k for k, v in want.items() if v[2] == 0}
    assert all(got[k] == want[k] for k in exact)
    assert sum(got[k][2] == want[k][2] for k in got) >= 0.95 * len(got)
    kept = {r["doc_id"] for r in dc.clean(docs_frame(spark, docs), frame).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_slices_change_nothing(spark, monkeypatch):
    docs, items = planted(2, 40)
    frame = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, dc.leaks(docs_frame(spark, docs), frame).collect()))
    monkeypatch.setattr(dc, "SLICE_BYTES", 800)
    assert sorted(map(tuple, dc.leaks(docs_frame(spark, docs), frame).collect())) == one
    assert dc.leaks(docs_frame(spark, []), frame).collect() == []
    assert dc.leaks(docs_frame(spark, docs), frame.limit(0)).collect() == []


def test_recall_at_the_largest_distance():
    rng = np.random.default_rng(5)
    missed = tried = 0
    for n in (15, 30, 60):
        for _ in range(60):
            item = rng.integers(1, 2**63, n).astype(np.uint64)
            body = item.tolist()
            for _ in range(int(dc.EDITS * n)):
                at = rng.integers(len(body))
                body[at : at + 1] = [[], [body[at], int(rng.integers(1, 2**63))], [int(rng.integers(1, 2**63))]][rng.integers(3)]
            h = np.array([*item, *body, *rng.integers(1, 2**63, n)], np.uint64)
            s = dc.signatures(h, np.array([0, n]), np.array([n, min(n, len(h) - n)]), np.array([n, n]))
            if dc.edits_between(item.tolist(), h[n : 2 * n].tolist()) <= int(dc.EDITS * n):
                tried += 1
                missed += not (s[0] == s[1]).any()
    assert tried > 50 and missed <= 0.03 * tried, (missed, tried)


@pytest.mark.parametrize("n, pairs", [(200, 40), (400, 24), (800, 12)])
def test_recall_of_long_items_at_the_largest_distance(n, pairs):
    rng = np.random.default_rng(n)
    texts = [[f"v{x}" for x in rng.integers(10**9, size=n)] for _ in range(pairs)]
    items = dc.Items([(i, " ".join(t)) for i, t in enumerate(texts)])
    for t in texts:
        for at in rng.choice(n, int(dc.EDITS * n), replace=False):
            t[at] = f"u{rng.integers(10**9)}"
    h, bounds = dc.all_word_hashes([" ".join(t) for t in texts])
    got = [(t, ids[0], d) for t, ids, _, _, d in items.matches(h, bounds)]
    assert set(got) <= {(i, i, int(dc.EDITS * n)) for i in range(pairs)} and len(got) >= 0.97 * pairs, len(got)
