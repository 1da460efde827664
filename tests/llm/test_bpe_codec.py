import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from maskora.llm import bpe_codec
from tests.llm.fixtures import awkward_docs, docs_frame

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe_codec.Codec(bpe_codec.model_proto(bpe_codec.read_ranks(PATH)))


def ids_of(text):
    import numpy as np

    return np.frombuffer(CODEC.encode([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(" \t\n'sabé1,日 \x1c"))
def test_ids_equal_tiktoken(text):
    assert ids_of(text) == PLAIN.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode([text])[0]) == text.encode()


def test_every_token_round_trips():
    for token, rank in RANKS.items():
        assert CODEC.decode([rank]) == token


def test_memo_limit_changes_nothing():
    small = bpe_codec.Codec(bpe_codec.model_proto(bpe_codec.read_ranks(PATH)))
    small._memo._limit = 3
    texts = [t for _, t in awkward_docs()]
    assert small.encode(texts) == CODEC.encode(texts)


def test_operator(spark):
    rows = awkward_docs()
    got = sorted((tuple(r) for r in bpe_codec.round_trip(docs_frame(spark, rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = PLAIN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe_codec.round_trip(docs_frame(spark, [])).collect() == []


def test_encode_then_decode(spark):
    rows = awkward_docs()[:80]
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(docs_frame(spark, rows)))
    assert sorted(map(repr, (bytes(r["data"]) for r in back.collect()))) == sorted(repr((t or "").encode()) for _, t in rows)
