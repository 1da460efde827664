"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

Each token's bytes become one printable character a byte; the pieces are scored by their negative rank, so
that the merge of the best-scored pair is the merge of the lowest rank; normalisation is the identity. A text
is split by the pattern of the rank file, each match is encoded by itself, and ids are decoded by mapping the
pieces' characters back to bytes. The model holds nothing of the corpus and is a few MB (checked), so each
worker gets a copy.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_memo import ChunkMemo
from .words import pieces

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL_LIMIT = 64 << 20
#: Bytes that stand for themselves in the mapped pieces; the others are shifted beyond U+0100 in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}
_MAP = {chr(b): c for b, c in BYTE_CHARS.items()}
_TRANSLATE = str.maketrans(_MAP)
_BPE, _NORMAL, _UNKNOWN = 2, 1, 2


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        found = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    return [token for _, token in found]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: integers and booleans as varints, floats in 32 bits, the rest by length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_TRANSLATE)


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model in which piece ``i`` is token ``i``; one unknown piece follows the tokens."""
    out = [_field(1, _field(1, mapped(t).encode()) + _field(2, -float(i)) + _field(3, _NORMAL)) for i, t in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN)))
    n = len(tokens)
    out.append(_field(2, _field(3, _BPE) + _field(4, n + 1) + _field(40, n)))
    out.append(_field(3, _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)))
    return b"".join(out)


class Codec:
    def __init__(self, proto: bytes, pattern: str = public_tokenizers.PATTERN):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self._split = regex.compile(pattern).findall
        unknown = self._model.unk_id()
        size = self._model.vocab_size()
        pieces_ = [self._model.id_to_piece(i) for i in range(size) if i != unknown]
        self._whole = {p: i for i, p in enumerate(pieces_)}
        back = {c: b for b, c in BYTE_CHARS.items()}
        self._bytes = [bytes(back[c] for c in p) for p in pieces_]
        self._digits = [str(i) for i in range(size)]
        self._memo = ChunkMemo(self._encode_many)

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        split = [[mapped(m.encode()) for m in self._split(t)] for t in texts]
        flat = [m for s in split for m in s]
        whole = self._whole
        rest = [m for m in flat if m not in whole]
        found = iter(self._model.encode(rest, num_threads=1))
        ids = [[whole[m]] if m in whole else next(found) for m in flat]
        out, at = [], 0
        for s in split:
            out.append(np.array([i for x in ids[at : at + len(s)] for i in x], "<u4").tobytes())
            at += len(s)
        return out

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        return [x for i, j in pieces(texts) for x in self._memo.encode(texts[i:j])]

    def decode(self, ids: bytes | list[int]) -> bytes:
        """The bytes of the ids; an id that is not in the vocabulary raises IndexError."""
        numbers = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        table = self._bytes
        return b"".join([table[i] for i in numbers])

    def ids_text(self, ids: bytes) -> str:
        table = self._digits
        return " ".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def _codec(proto: bytes) -> Codec:
    return Codec(proto)


def _model(spark, ranks: str):
    proto = model_proto(read_ranks(ranks))
    if len(proto) > MODEL_LIMIT:
        raise ValueError(f"a vocabulary of {len(proto)} bytes is too large for each worker to hold")
    return spark.sparkContext.broadcast(proto)


def encode_documents(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for each row; null and empty texts have no ids. No shuffle."""
    model = _model(docs.sparkSession, ranks)

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in _codec(model.value).encode(b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, data)`` for rows of ``(doc_id, ids)``: the bytes that the ids stand for; null ids as none."""
    model = _model(encoded.sparkSession, ranks)

    def run(batches):
        for b in batches:
            data = [_codec(model.value).decode(x or []) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row, encoded and decoded in one pass.

    Null and empty texts have no ids, and both digests are those of nothing; a very long text is encoded alone. Rows are independent: repeated
    rows give repeated results, an empty table none; other columns are not read.
    """
    model = _model(docs.sparkSession, ranks)

    def run(batches):
        codec = _codec(model.value)
        for b in batches:
            ids, texts = [], b["text"].to_pylist()
            out = []
            for i, j in pieces(texts):
                for ids in codec.encode(texts[i:j]):
                    out.append((len(ids) // 4, hashlib.sha256(codec.ids_text(ids).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, d = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
