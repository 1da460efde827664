"""Words of whole texts as 64-bit hashes, with numpy over the bytes of many texts at once.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D); A-Z is lower-cased, all other
bytes are kept. Texts are handled in pieces of about ``PIECE`` bytes, so memory does not follow the batch;
a longer text is a piece by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finalizer)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd_constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACE_BYTES = _SPACE.tobytes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = odd_constants(11, 256)[_LOWER]
_BYTE[_SPACE] = 0
_BASE = U64(0x9E3779B97F4A7C55)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_kept = (np.zeros(0, U64),) * 3


def pieces(texts: list, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with at most ``limit`` characters together, or one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n`` powers of the base, from the first, and of its inverse, from none, and room for as many values; those for pieces of usual size are kept."""
    global _kept
    if n <= len(_kept[0]):
        return _kept
    powers = (np.multiply.accumulate(np.concatenate([[first], np.full(max(n, PIECE >> 2) - 1, x, U64)])) for first, x in ((_BASE, _BASE), (U64(1), _INVERSE)))
    found = (*powers, np.empty(max(n, PIECE >> 2), U64))
    if n <= 2 * PIECE:
        _kept = found
    return found


def _hash_piece(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A word's bytes are summed with the powers of their places in the piece, which its first place is then taken from."""
    raw = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    joined = b" ".join([*raw, b""])
    a, space = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_SPACE_BYTES), bool)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(a) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, closes = edges[::2], edges[1::2]
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    if not len(starts):
        return np.zeros(0, U64), bounds
    power, inverse, room = _powers(len(a))
    h = np.take(_BYTE, a, mode="clip", out=room[: len(a)])
    h *= power[: len(a)]
    h = np.add.reduceat(h, starts) * inverse[starts]
    return mix64(h + (closes - starts).astype(U64) * U64(0xD6E8FEB86659FD93)), bounds


def word_hashes(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first, hashes, bounds)`` for consecutive pieces: text ``first + k`` has words ``hashes[bounds[k]:bounds[k + 1]]``."""
    for i, j in pieces(texts):
        yield (i, *_hash_piece(texts[i:j]))


def all_word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all the texts' words in order, and the bounds of each text."""
    hashes, bounds, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    for _, h, b in word_hashes(texts):
        hashes.append(h)
        bounds.append(b[1:] + at)
        at += len(h)
    return np.concatenate(hashes), np.concatenate(bounds)
