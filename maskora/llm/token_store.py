"""Token ids in sorted-string-table shards.

Documents are range-partitioned by identifier; each partition writes one shard, a file of

    data blocks | sparse block index | Bloom filter | footer

A data block holds entries in key order with prefix-compressed keys, compressed as a whole; ids take two bytes
where the vocabulary allows it, else four. The index has the first key, place, size, row count and CRC-32 of each
block. The footer, of fixed size at the end, has the places of
index and filter, the row and token counts, the bytes of an id and a magic number. A lookup reads the footer, asks the filter,
searches the index in two halves again and again, and reads one block (or the few that share a key).

Shards go to the shared folder through pyarrow's file systems; a task writes under a name of its own, and the
manifest, a table with a row for each shard, says which files count, so repeated attempts leave no trace.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_codec import BYTE_CHARS
from .chunk_memo import ChunkMemo
from .files import create, open_file
from .shared import scratch, written
from .words import pieces

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 32 << 20
#: Matches whose ids a worker remembers (longer ones than 64 characters never); matches or chunks that are encoded as one text.
MATCHES, _TOGETHER = 400_000, 4000
#: Bytes to mapped characters, but for the end of a line.
_MAPPED = str.maketrans({chr(b): c for b, c in BYTE_CHARS.items() if b != 0x0A})
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"MSKSST01"
#: index place, index size, filter place, filter size, rows, tokens, blocks, bytes of an id
FOOTER = struct.Struct("<8Q8s")
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<BQIII")


def key_of(doc_id: int | None) -> bytes:
    """Eight bytes whose order is the order of the identifiers; a null one is the empty key, before all others."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bits(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % size for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes ``(key, value)`` in key order. One block and the filter's keys are all that is held."""

    def __init__(self, sink, width: int = 4, block_bytes: int = BLOCK_BYTES):
        self._sink, self._block_bytes, self.width = sink, block_bytes, width
        self._pack = zstandard.ZstdCompressor(level=1).compress
        self._at = self.rows = self.tokens = 0
        self._keys: list[bytes] = []
        self._index: list[bytes] = []
        self._start()

    def _start(self) -> None:
        self._block, self._size, self._count, self._first, self._last = [], 0, 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        if self._size and self._size + len(value) > self._block_bytes:
            self._flush()
        shared = 0
        if self._count:
            shared = next((i for i, (x, y) in enumerate(zip(key, self._last)) if x != y), min(len(key), len(self._last)))  # noqa: B905
        else:
            self._first = key
        entry = _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self._block.append(entry)
        self._size += len(entry)
        self._count += 1
        self._last = key
        if not self._keys or self._keys[-1] != key:
            self._keys.append(key)
        self.rows += 1
        self.tokens += len(value) // self.width

    def _flush(self) -> None:
        if not self._count:
            return
        block = self._pack(b"".join(self._block))
        crc = zlib.crc32(block)
        self._sink.write(block)
        self._index.append(_INDEX.pack(len(self._first), self._at, len(block), self._count, crc) + self._first)
        self._at += len(block)
        self._start()

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self._keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        for k in self._keys:
            bloom[_bits(k, bits)] = True
        index, packed = b"".join(self._index), np.packbits(bloom).tobytes()
        bloom_at = self._at + len(index)
        self._sink.write(index)
        self._sink.write(struct.pack("<Q", bits) + packed)
        self._sink.write(FOOTER.pack(self._at, len(index), bloom_at, len(packed) + 8, self.rows, self.tokens, len(self._index), self.width, MAGIC))
        self._sink.close()


class ShardReader:
    """Lookups and scans of one shard over a seekable file."""

    def __init__(self, source):
        self._source = source
        end = source.size()
        at, size, bloom_at, bloom_size, self.rows, self.tokens, blocks, self.width, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, self._blocks, pos = self._read(at, size), [], 0
        for _ in range(blocks):
            n, place, length, count, crc = _INDEX.unpack_from(raw, pos)
            pos += _INDEX.size + n
            self._blocks.append((raw[pos - n : pos], place, length, count, crc))
        self._first = [b[0] for b in self._blocks]
        self._bloom_place = bloom_at, bloom_size
        self._bloom = None

    def _read(self, at: int, n: int) -> bytes:
        self._source.seek(at)
        return self._source.read(n)

    def may_have(self, key: bytes) -> bool:
        if self._bloom is None:
            raw = self._read(*self._bloom_place)
            self._bloom = struct.unpack_from("<Q", raw)[0], np.unpackbits(np.frombuffer(raw, np.uint8, offset=8))
        size, bits = self._bloom
        return all(bits[i] for i in _bits(key, size))

    def _entries(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, length, count, crc = self._blocks[number]
        raw, pos, key = self._read(place, length), 0, b""
        if zlib.crc32(raw) != crc:
            raise ValueError("a damaged block")
        raw = zstandard.ZstdDecompressor().decompress(raw)
        for _ in range(count):
            shared, rest, n = _ENTRY.unpack_from(raw, pos)
            pos += _ENTRY.size + rest
            key = key[:shared] + raw[pos - rest : pos]
            yield key, raw[pos : pos + n]
            pos += n

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of all rows with this identifier."""
        key = key_of(doc_id)
        if not self._blocks or not self.may_have(key):
            return []
        first, last = max(0, bisect_left(self._first, key) - 1), bisect_right(self._first, key)
        return [v for b in range(first, last) for k, v in self._entries(b) if k == key]

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for b in range(len(self._blocks)):
            yield from self._entries(b)


def _splits_at_words(tokenizer_json: str) -> bool:
    """Whether a tokenizer splits by PATTERN and changes nothing before its merges, so that chunks can be encoded apart."""
    settings = json.loads(tokenizer_json)
    splits, model = settings.get("pre_tokenizer") or {}, settings["model"]
    return (
        settings.get("normalizer") is None
        and splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space", True)
        and model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and all(t["special"] for t in settings.get("added_tokens") or [])
    )


class _WholeTexts:
    """In place of a memo for tokenizers of which nothing is known: each text goes through all of the library."""

    def __init__(self, encode_many):
        self._encode_many = encode_many

    def encode(self, texts: list) -> list[bytes]:
        return self._encode_many([t or "" for t in texts])


class Encoder:
    """Whole texts to ids with the tokenizers library; special tokens' strings in a text are ordinary text.

    Tokenizers that do not split by PATTERN, or that change texts first, encode every text as a whole. For the others:

    Distinct printable chunks of the Latin script are split by the library's own pattern here, as one text; their distinct
    matches go through its merges many at a time, as one text with a delimiter that no match holds, and the ids are dealt
    back by the characters that each stands for. Other chunks go through all of the library, many as one text.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._dtype = f"<u{self.width}"
        if not _splits_at_words(tokenizer_json):
            self.memo = _WholeTexts(self._encode_many)
            return
        model = Tokenizer.from_str(tokenizer_json).model
        if hasattr(model, "_resize_cache"):  # the memo below is the cache
            model._resize_cache(0)
        self._merges = Tokenizer(model)
        self._merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        vocabulary = self._merges.get_vocab()
        self._sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self._sizes[i] = len(token)
        self._split = regex.compile(public_tokenizers.PATTERN).findall
        self._matches: dict[str, bytes] = {}
        self.memo = ChunkMemo(self._encode_many, self._encode_chunks)

    def _dealt(self, ids: list[int], sizes: list[int]) -> list[bytes]:
        """The ids of a text cut into pieces of so many bytes."""
        ids = np.array(ids, self._dtype)
        ends, reached = np.cumsum(sizes), np.cumsum(self._sizes[ids])
        cuts = np.searchsorted(reached, ends, "right")
        if (reached[cuts - 1] != ends).any():
            raise ValueError("the vocabulary does not cover all bytes")
        return _pieces(ids.tobytes(), (cuts * self.width).tolist())

    def _merged(self, matches: list[str]) -> list[bytes]:
        """Ids of printable matches."""
        out = []
        for at in range(0, len(matches), _TOGETHER):
            text = "\n".join(matches[at : at + _TOGETHER]).encode().decode("latin-1").translate(_MAPPED)
            (e,) = self._merges.encode_batch_fast([text], add_special_tokens=False)
            out += self._dealt(e.ids, [len(m) for m in text.split("\n")])
        return out

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of any chunks; where one begins, a match begins in all that is joined."""
        out = []
        for at in range(0, len(chunks), _TOGETHER):
            group = chunks[at : at + _TOGETHER]
            (e,) = self._tokenizer.encode_batch_fast(["".join(group)], add_special_tokens=False)
            out += self._dealt(e.ids, [len(t.encode()) for t in group])
        return out

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self._dtype).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _printable(self, chunks: list[str]) -> list[bytes]:
        """Ids of printable chunks of the Latin script."""
        if len(self._matches) > MATCHES:
            self._matches = {}
        known, matches = self._matches, self._split("".join(chunks))
        new = list(set(matches).difference(known))
        known.update(zip(new, self._merged(new), strict=True))
        found = [known[m] for m in matches]
        ends, reached = np.cumsum([len(t) for t in chunks]), np.cumsum([len(m) for m in matches])
        last = np.searchsorted(reached, ends)
        if (reached[last] != ends).any():
            raise ValueError("a match goes over the end of a chunk")
        for m in new:
            if len(m) > 64:
                del known[m]
        return _pieces(b"".join(found), np.cumsum([len(x) for x in found])[last].tolist())

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        simple = [t.isprintable() and (t.isascii() or max(t) < "\u0250") for t in chunks]
        if not any(simple):
            return self._joined(chunks)
        known, others = iter(self._printable(list(compress(chunks, simple)))), iter(self._joined([t for t, x in zip(chunks, simple, strict=True) if not x]))
        return [next(known) if x else next(others) for x in simple]


def _pieces(data: bytes, ends: list[int]) -> list[bytes]:
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=2)
def _encoder(tokenizer_json: str) -> Encoder:
    return Encoder(tokenizer_json)


def open_shard(path: str) -> ShardReader:
    return ShardReader(open_file(path))


def write_shards(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the texts, write the shards into ``folder`` and return their manifest, a row for each shard:
    ``(path, first_id, hashed, n_rows, n_tokens, last_id)`` in order of ``(first_id, hashed)``."""
    with open(tokenizer) as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hashed", F.xxhash64("text"))
    shards = (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES + 1

    def run(batches):
        encoder, writer, path, first, doc_id = _encoder(model.value), None, f"{folder}/{uuid.uuid4().hex}.sst", None, None
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            for i, j in pieces(texts):
                for doc_id, value in zip(ids[i:j], encoder.memo.encode(texts[i:j]), strict=True):
                    if writer is None:
                        writer, first = ShardWriter(create(path), encoder.width), (doc_id, b["hashed"][0].as_py())
                    writer.add(key_of(doc_id), value + END_ID.to_bytes(encoder.width, "little"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first_id": first[0], "hashed": first[1], "n_rows": writer.rows, "n_tokens": writer.tokens, "last_id": doc_id}], MANIFEST)

    ordered = base.repartitionByRange(max(shards, docs.sparkSession.sparkContext.defaultParallelism), "doc_id", "hashed").sortWithinPartitions("doc_id", "hashed")
    return written(ordered.mapInArrow(run, "path string, first_id long, hashed long, n_rows long, n_tokens long, last_id long"), "token-manifest")


MANIFEST = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("hashed", pa.int64()), ("n_rows", pa.int64()), ("n_tokens", pa.int64()), ("last_id", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all rows, read from the files. ``start`` counts the ids of
    all rows before, over all shards; only the manifest, a row for each shard, is put in one order for that."""
    before = Window.orderBy("first_id", "hashed", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        for b in batches:
            for path, at in zip(b["path"].to_pylist(), b["base"].to_pylist(), strict=True):
                rows = []
                shard = open_shard(path)
                for key, value in shard.scan():
                    n = len(value) // shard.width
                    rows.append((id_of(key), at, n, zlib.crc32(np.frombuffer(value, f"<u{shard.width}").astype("<u4").tobytes())))
                    at += n
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=ROWS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=ROWS)

    shards = max(1, manifest.count())
    return placed.select("path", "base").repartition(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids)``, a row for each stored row with one of the ids, end id included; unknown ids give none.

    Only shards whose range holds an asked id are opened, and of these only what the filter and the index point to.
    """
    asked = sorted({*doc_ids})

    def run(batches):
        for b in batches:
            for path, low, high in zip(*(b[x].to_pylist() for x in ("path", "first_id", "last_id")), strict=True):
                shard, found = open_shard(path), []
                for doc_id in asked[0 if low is None else bisect_left(asked, low) : bisect_right(asked, high)]:
                    found += [(doc_id, np.frombuffer(v, f"<u{shard.width}").astype(np.int64)) for v in shard.get(doc_id)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    held = F.exists(F.array(*map(F.lit, asked)).cast("array<bigint>"), lambda x: F.coalesce(F.col("first_id") <= x, F.lit(True)) & (x <= F.col("last_id")))
    return manifest.filter(held).select("path", "first_id", "last_id").mapInArrow(run, "doc_id long, ids array<long>")


def stored_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all rows to shards in ascending doc_id order and read them back.

    Null and empty texts hold the end id alone. A null doc_id comes before all others; rows repeated with one
    doc_id come in the order of their texts' hashes, each with its own place. A very long text is encoded
    alone and is one entry of its shard. An empty table writes no shard and gives an empty result. Other columns are
    not read.
    """
    return read_shards(write_shards(docs, scratch(docs.sparkSession, "token-shards"), tokenizer, id_col, text_col))


def query(spark, sf_dir: str) -> DataFrame:
    return stored_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
