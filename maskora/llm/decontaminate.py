"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH over item-sized windows.

Texts are sequences of word hashes and distances are word edits. A document is contaminated by an item of n
words when a window of n of its words (or the whole document, if shorter) is within floor(EDITS * n) edits.

The CGK random walk copies a window into a longer string, stepping on by a random bit that depends on the step
and the current symbol; windows at a small edit distance get strings at a small Hamming distance. A repetition
draws new bits and samples PICKS steps of the walk; a window is compared with an item when all samples agree in
one of the repetitions. Each edit can throw the walks out of step, so at the largest allowed distance the chance that
a repetition agrees falls with the item's length n: it was measured at 0.26 for 30 words, 0.17 for 60, 0.08 for 200,
0.043 for 400, 0.027 for 800 and 0.015 for 1600, always above AGREE[0] * n^-AGREE[1]. ``repeats`` takes so many
repetitions that all miss with MISS at most. Every candidate is then verified exactly, by the bit-parallel edit
distance.

Windows that cannot be within the distance are not embedded: k edits spoil at most k * q of the item's
n - q + 1 q-grams, so a window with fewer of the rest is out. This loses nothing.

Items are read in slices of SLICE_BYTES at most, a pass over the documents for each, so what goes to the workers
is bounded however long the benchmark is. There is no shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, all_word_hashes, mix64, odd_constants, word_hashes

EDITS = 0.2
#: Fewest repetitions, and samples in each.
REPEATS, PICKS = 32, 2
MISS = 0.001
AGREE = 4.0, 0.8
SLICE_BYTES = 8 << 20
_STEP = odd_constants(502, 1)[0]
_SIGN = odd_constants(503, 2)
_GRAM = odd_constants(504, 3)
_MOST = 4096 * REPEATS  # walks that are made at a time


def repeats(sizes: np.ndarray) -> np.ndarray:
    """Repetitions for items of so many words, in steps of half of REPEATS."""
    agree = np.minimum(0.2, AGREE[0] * np.maximum(sizes, 1) ** -AGREE[1])
    half = REPEATS // 2
    return np.maximum(REPEATS, np.ceil(np.log(MISS) / np.log1p(-agree) / half).astype(np.int64) * half)


def edits_between(a: list[int], b: list[int]) -> int:
    """Edit distance, a word of ``b`` at a time with one big integer for all of ``a``."""
    if not a:
        return len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for x in b:
        eq = places.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | full & ~(diagonal | up), up & diagonal
        distance += bool(rise & last) - bool(fall & last)
        rise = rise << 1 | 1
        fall <<= 1
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal & full
    return distance


def _folded(texts) -> list[str]:
    """Lower case, of all scripts; a null text is empty."""
    return [(t or "").lower() for t in texts]


def _grams(h: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(h) - q + 1)
    return mix64(reduce(np.add, (h[i : i + n] * _GRAM[i] for i in range(q))))


def signatures(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For windows of ``h`` the sampled walk of each repetition that the longest needs; ``sizes`` are the items' words, which set the walk's length."""
    count = int(repeats(sizes).max(initial=REPEATS))
    walk = odd_constants(501, count)
    # where in the walk the samples lie, as a share of its length; it has used up n words after about 2 n steps
    places = (mix64(np.arange(1, count * PICKS + 1, dtype=U64)) / 2.0**64).reshape(count, PICKS)
    out = np.empty((len(starts), count), U64)
    most = max(1, _MOST // count)
    for a in range(0, len(starts), most):
        at = np.repeat(starts[a : a + most][:, None], count, 1)
        end = at + lengths[a : a + most][:, None]
        steps = 2 * sizes[a : a + most]
        picks = (places[None] * steps[:, None, None]).astype(np.int64)
        sign = np.repeat(steps[:, None].astype(U64), count, 1)
        for j in range(picks.max(initial=-1) + 1):
            symbol = np.where(at < end, h[np.minimum(at, len(h) - 1)], U64(0))
            for p in range(PICKS):
                taken = picks[:, :, p] == j
                if taken.any():
                    sign[taken] = (sign[taken] ^ symbol[taken]) * _SIGN[p]
            at += (((symbol ^ U64(j * int(_STEP) & 2**64 - 1)) * walk) >> U64(63)).astype(np.int64)
        out[a : a + most] = mix64(sign + np.arange(count, dtype=U64))
    return out


def _signed(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray):
    """``(window, signature)`` of all windows, those with as many repetitions together and only some at a time."""
    counts = repeats(sizes)
    for count in np.unique(counts):
        like, most = np.flatnonzero(counts == count), max(1, _MOST // count)
        for a in range(0, len(like), most):
            some = like[a : a + most]
            yield from zip(some.tolist(), signatures(h, starts[some], lengths[some], sizes[some]).tolist(), strict=True)


class Items:
    """The distinct word sequences of a slice of the benchmark, their q-grams and their signatures."""

    def __init__(self, rows: list[tuple[int, str]]):
        h, bounds = all_word_hashes(_folded(t for _, t in rows))
        found: dict[tuple, list[int]] = {}
        for (item, _), a, b in zip(rows, bounds[:-1], bounds[1:], strict=True):
            if b > a:
                found.setdefault(tuple(h[a:b].tolist()), []).append(item)
        self.words, self.ids = [list(k) for k in found], list(found.values())
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.most = np.floor(EDITS * self.sizes + 1e-9).astype(np.int64)
        self.need: dict[int, np.ndarray] = {}
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        q_of = np.zeros(len(self.words), int)
        for q in (1, 2, 3):
            q_of[self.sizes - q + 1 - q * self.most > 0] = q
        for q in sorted(set(q_of.tolist())):
            keys, owner = [], []
            for i in np.flatnonzero(q_of == q):
                g = np.unique(_grams(np.array(self.words[i], U64), q))
                keys.append(g)
                owner.append(np.full(len(g), i))
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            by = np.argsort(keys, kind="stable")
            keys, owner = keys[by], owner[by]
            distinct, first = np.unique(keys, return_index=True)
            coarse = np.zeros(1 << 20, bool)
            coarse[(distinct >> U64(44)).astype(np.int64)] = True
            self.grams[q] = distinct, np.append(first, len(keys)), owner, coarse
            self.need[q] = self.sizes - q + 1 - q * self.most
        flat = np.array([x for w in self.words for x in w], U64)
        starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.table: list[dict[int, list[int]]] = [{} for _ in range(repeats(self.sizes).max(initial=REPEATS))]
        for i, row in _signed(flat, starts, self.sizes, self.sizes):
            for r, x in enumerate(row):
                self.table[r].setdefault(x, []).append(i)

    def windows(self, h: np.ndarray, bounds: np.ndarray):
        """``(text, start, length, size)`` of the windows that may be within the distance of an item of that size."""
        out = set()
        for q, (distinct, first, owner, coarse) in self.grams.items():
            if len(h) < q:
                continue
            grams = _grams(h, q)
            at = np.flatnonzero(coarse[(grams >> U64(44)).astype(np.int64)])
            place = np.searchsorted(distinct, grams[at])
            place = np.minimum(place, len(distinct) - 1)
            real = distinct[place] == grams[at]
            at, place = at[real], place[real]
            text = np.searchsorted(bounds, at, "right") - 1
            inside = at + q <= bounds[text + 1]
            at, place, text = at[inside], place[inside], text[inside]
            count = first[place + 1] - first[place]
            item = owner[np.repeat(first[place], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            at, text = np.repeat(at, count), np.repeat(text, count)
            by = np.lexsort((at, item, text))
            at, text, item = at[by], text[by], item[by]
            new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])) if len(at) else np.zeros(0, int)
            sizes = np.diff(np.append(new, len(at)))
            for a, n in zip(new[sizes >= self.need[q][item[new]]], sizes[sizes >= self.need[q][item[new]]], strict=True):
                t, i, hits = int(text[a]), int(item[a]), at[a : a + n]
                size, low, high = int(self.sizes[i]), int(bounds[text[a]]), int(bounds[text[a] + 1])
                length = min(size, high - low)
                starts = np.arange(max(low, int(hits[0]) - length + q), min(high - length, int(hits[-1])) + 1)
                enough = np.searchsorted(hits, starts + length - q, "right") - np.searchsorted(hits, starts, "left") >= self.need[q][i]
                out.update((t, int(s), length, size) for s in starts[enough])
        return sorted(out)

    def matches(self, h: np.ndarray, bounds: np.ndarray):
        """``(text, item ids, start word, words, edits)`` of the best window for each text and item that match."""
        windows = self.windows(h, bounds)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if windows:
            text, start, length, size = map(np.array, zip(*windows, strict=True))
            for w, row in _signed(h, start, length, size):
                for i in {i for r, x in enumerate(row) for i in self.table[r].get(x, ())}:
                    key = int(text[w]), i
                    a = int(start[w])
                    if best.get(key, (1,))[0]:  # nothing is better than an exact copy
                        d = edits_between(self.words[i], h[a : a + int(length[w])].tolist())
                        if d <= self.most[i]:
                            best[key] = min(best.get(key, (d, a + 1, 0)), (d, a, int(length[w])))
        return [(t, self.ids[i], a - int(bounds[t]), n, d) for (t, i), (d, a, n) in sorted(best.items())]


_ROWS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())])


def _slices(benchmark: DataFrame):
    """Items in slices of about SLICE_BYTES, one longer item by itself."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    slices = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES + 1
    for k in range(slices):
        yield Items(sorted(((r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()), key=repr))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, edits)``: for each contaminated row and item the nearest window, the first of equally near ones.

    Words are lower-cased and white space does not count. Null and wordless texts and items match nothing;
    all windows of a very long text are looked at, a piece of the table at a time.
    Repeated rows give repeated results; items with equal words each give theirs. A row without doc_id keeps
    its null. Empty tables give an empty result. Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for items in _slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in batches:
                ids, out = b["doc_id"].to_pylist(), []
                for first, h, bounds in word_hashes(_folded(b["text"].to_pylist())):
                    for t, items_, a, n, d in shared.value.matches(h, bounds):
                        out += [{"doc_id": ids[first + t], "item_id": x, "start_word": a, "n_words": n, "edits": d} for x in items_]
                yield pa.RecordBatch.from_pylist(out, _ROWS)

        parts.append(base.mapInArrow(run, "doc_id long, item_id long, start_word long, n_words long, edits long"))
    return reduce(DataFrame.unionAll, parts)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, whole, in one pass for each slice of the benchmark.

    Null and wordless texts are never contaminated and stay; repeated rows share a verdict; empty tables on either
    side are allowed. All columns of ``docs`` are returned as they came, whatever their names.
    """
    for items in _slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, h, bounds in word_hashes(_folded(b["text"].to_pylist())):
                    keep[[first + t for t, *_ in shared.value.matches(h, bounds)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
