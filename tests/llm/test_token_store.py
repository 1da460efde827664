import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskora.llm import token_store as ts
from tests.llm.fixtures import awkward_docs, docs_frame

PLAIN = Tokenizer.from_file(ts.TOKENIZER)
PLAIN.encode_special_tokens = True
ENCODER = ts.Encoder(open(ts.TOKENIZER).read())


def value(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_read_back_equals_the_library(spark):
    rows = [*awkward_docs(), (-5, "a  b\n\n c <|endoftext|> d "), (2**40, " lead")]
    got = ts.stored_tokens(docs_frame(spark, rows)).collect()
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(got) == len(rows)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    want = sorted(((i, len(v) // 4, zlib.crc32(v)) for i, t in rows for v in [value(t)]), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == want


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(" \t\n'sabé1,日 \x1c\x85<|endoftext>"))
def test_ids_equal_the_library(text):
    got = np.frombuffer(ENCODER.memo.encode([text])[0], "<u2").tolist()
    assert got == PLAIN.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    """A tokenizer that lower-cases or splits otherwise gives the library's own ids."""
    path = ts.public_tokenizers.path("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), ts.Encoder(open(path).read())
    whole.encode_special_tokens = True
    whole.no_truncation()
    texts = ["Some  Text, IT'S 2024\n\n and more", "", None, " lead", "日本語 text", "a " * 3_000]
    got = [np.frombuffer(x, f"<u{encoder.width}").tolist() for x in encoder.memo.encode(texts)]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert isinstance(encoder.memo, ts._WholeTexts) and not isinstance(ENCODER.memo, ts._WholeTexts)


def test_lookup_in_all_shards(spark, tmp_path):
    rows = awkward_docs()
    manifest = ts.write_shards(docs_frame(spark, rows), str(tmp_path))
    wanted = [7, 100, 105, -3, 10**15, 0, 7]
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in ts.lookup(manifest, wanted).collect())
    assert got == sorted((i, tuple(np.frombuffer(value(t), "<u4").tolist())) for i, t in rows if i in wanted)
    assert ts.lookup(manifest, []).collect() == []


def test_empty_table(spark):
    assert ts.stored_tokens(docs_frame(spark, [])).collect() == []


class Sink(io.BytesIO):
    def close(self):
        self.data = self.getvalue()

    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("block", [1, 100, 1 << 20])
def test_lookup(block):
    sink = Sink()
    w = ts.ShardWriter(sink, 4, block)
    rows = [(None, b"null"), *((i * 3 - 50, bytes([i]) * (i % 7)) for i in range(100)), (1000, b"a"), (1000, b"b")]
    for i, v in rows:
        w.add(ts.key_of(i), v)
    w.close()
    r = ts.ShardReader(sink)
    assert [(ts.id_of(k), v) for k, v in r.scan()] == rows
    for i in [None, *range(-60, 1010)]:
        assert r.get(i) == [v for k, v in rows if k == i]
    absent = [i for i in range(10_000, 20_000) if r.may_have(ts.key_of(i))]
    assert len(absent) < 300


def test_damage_is_found():
    sink = Sink()
    w = ts.ShardWriter(sink)
    w.add(ts.key_of(1), b"abcd")
    w.close()
    bad = Sink(sink.data[:5] + b"!" + sink.data[6:])
    with pytest.raises(ValueError):
        list(ts.ShardReader(bad).scan())


def test_chunks_are_encoded_together():
    """Many new chunks of all kinds are split by one call, and their ids are the library's whatever the memo keeps."""
    encoder, calls = ts.Encoder(open(ts.TOKENIZER).read()), []
    encoder._split = lambda t, f=encoder._split: calls.append(1) or f(t)
    kinds = ["it's{}", "n{}n", "été{},", "x{}\n\nY", "日本{}", "a{}\t ", "é{}\xa0b", "z" * 80 + "{}"]
    texts = [" ".join(k.format(i + j) for i in range(50) for k in kinds) for j in (0, 20, 900)]
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.memo.encode(texts)] == want
    assert len(calls) == 1
    encoder.memo._limit = 0
    assert [np.frombuffer(encoder.memo.encode([t])[0], "<u2").tolist() for t in texts + texts] == want + want
