"""Token ids of whole texts by way of their distinct space-delimited chunks.

The pattern that splits texts before the merges always starts a new match at a space that a non-space
follows. A text may therefore be cut there, each distinct chunk encoded once, and the ids joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

_CUT = re.compile(r" (?=\S)")


class ChunkMemo:
    """``encode_many`` maps a list of strings to the bytes of their ids; ``encode_chunks`` does so for chunks, which
    start with a space and a non-space.

    The memo has two halves. A chunk that is looked up goes into the young half; when that holds ``limit`` bytes, it
    becomes the old half and what was old and not looked up since is forgotten. So a worker's memory is bounded,
    whatever the texts hold; a chunk longer than ``longest`` is never kept. Results do not depend on any of this.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], encode_chunks: Callable[[list[str]], list[bytes]] | None = None, limit: int = 96 << 20, longest: int = 64):
        self._encode_many, self._encode_chunks = encode_many, encode_chunks or encode_many
        self._limit, self._longest = limit, longest
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._size = 0

    def _learned(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not in the young half; those that are no place to cut are left out."""
        found = {x: self._old[x] for x in missing if x in self._old}
        new = [x for x in missing if x not in found and x and not x[0].isspace()]
        found.update(zip(new, self._encode_chunks([" " + x for x in new]), strict=True))
        kept = found
        if max(map(len, found), default=0) > self._longest:
            kept = {x: ids for x, ids in found.items() if len(x) <= self._longest}
        self._young.update(kept)
        self._size += 150 * len(kept) + sum(map(len, kept)) + sum(map(len, kept.values()))  # with the objects around them
        return found

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text; a null one counts as empty."""
        if self._size > self._limit:
            self._old, self._young, self._size = self._young, {}, 0
        cut = [t.split(" ") if t else [""] for t in texts]
        heads = [c[0] for c in cut]
        for c in cut:
            del c[0]
        learned = self._learned(set(chain.from_iterable(cut)).difference(self._young))
        get, out = self._young.get, []
        for t, c, head in zip(texts, cut, self._encode_many(heads), strict=True):
            found = list(map(get, c))
            if None in found:  # too long to be kept, or a space that more white space or the end follows, which is no place to cut
                found = [learned.get(x) if ids is None else ids for x, ids in zip(c, found, strict=True)]
            if None in found:
                first, *rest = _CUT.split(t)
                out.append(b"".join(self._encode_many([first, *(" " + x for x in rest)])))
            else:
                out.append(head + b"".join(found))
        return out
