import pyarrow as pa
import math
import re
import subprocess
import sys
import zlib
from collections import Counter

import pytest

from maskora.llm import lm_scoring
from tests.llm.fixtures import awkward_docs, docs_frame, prose


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def brute(rows, order):
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    grams = Counter()
    for (_, text), out in zip(rows, held, strict=True):
        if not out:
            seq = [None, *tokens(text)]
            for at in range(1, len(seq)):
                for k in range(1, order + 1):
                    if at - k + 1 >= 0:
                        grams[tuple(seq[at - k + 1 : at + 1])] += 1
    n = sum(c for g, c in grams.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in grams)
    result = []
    for (i, text), out in zip(rows, held, strict=True):
        seq, base, score = [None, *tokens(text)], 0.0, 0.0
        for at in range(1, len(seq)):
            p = (grams[(seq[at],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                if at - k + 1 >= 0:
                    g = tuple(seq[at - k + 1 : at + 1])
                    history = grams[g[:-1]]
                    p = (grams[g] + lm_scoring.MASS * p) / (history + lm_scoring.MASS)
            score += math.log10(p)
        result.append((i, out, len(seq) - 1, sum(grams[(w,)] > 0 for w in seq[1:]), n, base, score))
    return result


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block", [2_000, 8 << 20])
def test_scores_equal_brute_force(spark, monkeypatch, order, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_scoring, "BUCKET_KEYS", block)
    rows = awkward_docs()
    got = sorted((tuple(r) for r in lm_scoring.lm_scores(docs_frame(spark, rows), order).collect()), key=repr)
    want = sorted(brute(rows, order), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty_table(spark):
    assert lm_scoring.lm_scores(docs_frame(spark, [])).collect() == []


def test_nothing_to_learn_from(spark):
    rows = [(i, "a b a") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm_scoring.lm_scores(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows) > 1
    assert {tuple(r)[1:] for r in got} == {(True, 4, 0, 0, 0.0, 0.0)}


def test_worker_needs_no_other_imports():
    """What a task calls works where nothing but the module has been imported."""
    code = (
        "import pyarrow as pa, zstandard; from unittest import mock; from maskora.llm import lm_scoring as m\n"
        "b = pa.record_batch({'doc_id': [1, 2], 'text': ['a b c', 'a b d'], 'held_out': [False, True]})\n"
        "with mock.patch.object(m, 'TaskContext') as t:\n"
        "    t.get.return_value.partitionId.return_value = 0\n"
        "    block = pa.Table.from_batches(m._pack([b]))\n"
        "asked = m._requests(block, 1, 3)\n"
        "answers, v = m._answers(asked), m._vocabulary(asked)\n"
        "for c in ('tokens', 'types'): answers = answers.append_column(c, pa.array(v[c].to_pylist() * answers.num_rows))\n"
        "print(m._scores(block, answers, 3).num_rows)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=False)
    assert out.stdout.strip() == "2", out.stderr


def block_of(texts):
    docs = pa.table({"doc_id": range(len(texts)), "text": texts, "held_out": [False] * len(texts)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_table(docs)
    return pa.table({"block": [1], "packed": [sink.getvalue().to_pybytes()]})


def test_messages_follow_the_distinct_ngrams():
    """No message is empty: many buckets cost a small block no more than its n-grams, whatever the corpus."""
    for texts in (["a b c", "a b d"], [prose(400, k) for k in range(5)]):
        sent = {b: [len(x) // lm_scoring._LOW_BYTES for x in lm_scoring._requests(block_of(texts), b, 3)["low"].to_pylist()] for b in (1, 100, 10_000, 1_000_000)}
        ngrams = sum(sent[1])
        assert len(sent[1]) == 3 and ngrams <= 3 * sum(len(tokens(t)) + 1 for t in texts)
        assert all(sum(s) == ngrams and min(s) > 0 and len(s) <= ngrams for s in sent.values())


def test_blocks_are_packed_by_bytes(monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 60)
    monkeypatch.setattr(lm_scoring, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    b = pa.record_batch({"doc_id": range(6), "text": ["日本語" * 3] * 5 + ["x" * 100], "held_out": [False] * 6})
    sizes = [lm_scoring._unpack(pa.Table.from_batches([x])).num_rows for x in lm_scoring._pack([b])]
    assert sizes == [2, 2, 1, 1]
