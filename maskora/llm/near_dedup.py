"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets are one class. A class has COORDINATES minwise tokens; each of TREES trees
branches it by the tokens of two chosen coordinates, each branch by two others, and those by two others again; the
coordinates depend on the path. A node holds the classes that agree on all tokens of its path.

A node is compared in two passes. In the first, SKETCH four-bit minwise values are compared: each member with all
members before it, in a node of more than LEAF with the LEADERS first ones; the most typical members come first, those
whose tokens are commonest, so the copies of one original are hung on it. A member is linked with one partner at
most, the first that is surely alike or else the most alike; these links are confirmed on full sets and give
components. The second pass looks only at nodes that hold several components. Every link that is still to be found
has an end outside the node's largest component, so the members outside it, the strangers, are compared with all
members, exhaustively and on the sets themselves; a member is linked with one member of each other component. Only
members with a partner whose size and parity bits allow a link bring their sets; this loses no link (see ``_bits``). Where
more than LEAF strangers meet, the node branches on by DEEPER more coordinates, and both passes run on the new nodes;
where no coordinate is left, the strangers are compared a block of LEAF at a time.

So a group of n near copies costs about n links for each node, not n squared, and the rows that Spark moves are
members and links, never all pairs. A node of more than PART members is dealt to several tasks: each gets the
node's first member (pass one) or all its strangers (pass two) and a share of the others.

Recall. Two documents of similarity s share no path of a tree with probability 1 - q, q = 1 - (1 - s q2)^2, q2 =
1 - (1 - s q3)^2, q3 = 1 - (1 - s)^2: 0.059 at 0.8, so 1.2e-5 in all TREES. A class must share MIN_SHARED of its first
coordinates with others to go on (a partner of similarity 0.8 shares fewer with probability 6e-5). Sketches discard
pairs that look less alike than 0.65, 4.1 standard deviations below 0.8. What is left is confirmed on full sets,
so no false link is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import star_links
from .shared import written
from .words import U64, mix64, odd_constants, pieces, word_hashes

SHINGLE, PERCENT = 5, 80
TREES, COORDINATES, DEEPER = 4, 80, 3
#: Coordinates of a tree: two of the first depth, two below each, and two below each of those.
_TREE = 14
_PATHS = [(i, 2 + 2 * i + j, 6 + 4 * i + 2 * j + k) for i in range(2) for j in range(2) for k in range(2)]
FIRST, MIN_SHARED = 12, 4
#: Members that are compared exhaustively, first members of a larger node that the others are compared with, members for a task.
LEAF, LEADERS, PART = 1024, 64, 8192
SKETCH = 128
#: Of the SKETCH four-bit values: equal ones at a similarity of about 0.65, for a link, and of 0.8, for a sure one.
LINK_EQUAL, SURE_EQUAL = 86, 104
#: At most so many ids (with a class and its set key) are broadcast to pick out the texts, sets or members that may have a link.
BROADCAST_IDS = 2_000_000
#: A deeper level gets tables of its own classes alone where these are at most one in so many.
NARROW = 4
#: Characters that are read at a time. Pairs whose sketches a task compares at a time; shingles of members that meet strangers together, and pairs or meetings of these.
_TEXT, _PAIRS, _PRINTS, _CELLS = 1 << 18, 1 << 18, 1 << 20, 1 << 21
_LONGS = SKETCH // 16
_S = [f"s{q}" for q in range(_LONGS)]
_XOR, _TIMES = odd_constants(101, SKETCH).astype(np.uint32), odd_constants(202, SKETCH).astype(np.uint32) | np.uint32(1)
_NIBBLES = U64(0x1111111111111111)


def shingle_sets(texts: list, words: int):
    """For each text in order its sorted distinct shingle hashes; a text of fewer words has its whole sequence as one."""
    times = odd_constants(303, words)
    for _, h, bounds in word_hashes(texts):
        if len(h) >= words:
            n = len(h) - words + 1
            rolled = mix64(sum((h[i : i + n] * times[i] for i in range(1, words)), h[:n] * times[0]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                s = np.sort(rolled[a : b - words + 1])  # np.unique takes four times as long
                again = np.flatnonzero(s[1:] == s[:-1])
                yield np.delete(s, again) if len(again) else s
            elif b > a:
                short = sum((h[a + i : a + i + 1] * times[i] for i in range(b - a)), np.array([b - a], U64))
                yield mix64(short)
            else:
                yield np.zeros(0, U64)


def _minwise(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens, one row of SKETCH for each (non-empty) set."""
    flat = np.concatenate(sets)
    flat = (flat >> U64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, v, high = np.empty((SKETCH, len(sets)), np.uint32), np.empty_like(flat), np.empty_like(flat)
    for k in range(SKETCH):
        np.bitwise_xor(flat, _XOR[k], out=v)
        v *= _TIMES[k]
        np.right_shift(v, np.uint32(15), out=high)
        v ^= high
        np.minimum.reduceat(v, starts, out=out[k])
    return np.ascontiguousarray(out.T)


def _set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _bits(s: np.ndarray) -> bytes:
    """Whether an even or odd number of shingles falls on each of 2^k places, at least as many as shingles and 64.

    Of two sets' bits as many differ as the sets differ in shingles, at most. More places are folded to fewer by
    exclusive or.
    """
    n = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U64(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1, bitorder="little").tobytes()


def _sketches(batches, words: int):
    for b in batches:
        ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
        for i, j in pieces(texts, _TEXT):
            sets = list(shingle_sets(texts[i:j], words))
            full = [s for s in sets if len(s)]
            coords = np.zeros((len(sets), SKETCH), np.uint32)
            if full:
                coords[[k for k, s in enumerate(sets) if len(s)]] = _minwise(full)
            bits = (coords & np.uint32(15)).astype(U64).reshape(len(sets), _LONGS, 16) << (U64(4) * np.arange(16, dtype=U64))
            packed = np.bitwise_or.reduce(bits, axis=2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[i:j], pa.int64()),
                    b["text_key"][i:j],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_key(s) for s in sets], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(coords[:, :COORDINATES]).view(np.int32).ravel()), COORDINATES).cast(pa.list_(pa.int32())),
                    *(pa.array(np.ascontiguousarray(packed[:, q])) for q in range(_LONGS)),
                ],
                ["doc_id", "text_key", "n_shingles", "set_key", "coords", *_S],
            )


def _full_sets(batches, words: int):
    """The classes' sets, from texts of their first doc_ids; a text with another set than the class's is passed by."""
    for b in batches:
        texts, keys = b["text"].to_pylist(), b["set_key"].to_pylist()
        for i, j in pieces(texts, _TEXT):
            sets = list(shingle_sets(texts[i:j], words))
            own = [k for k, s in enumerate(sets) if _set_key(s) == keys[i + k]]
            cls = b["cls"][i:j].take(pa.array(own, pa.int64()))
            columns = [pa.array([len(sets[k]) for k in own], pa.int64()), pa.array([_bits(sets[k]) for k in own], pa.binary()), pa.array([sets[k].tobytes() for k in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([cls, *columns], ["cls", "n", "bits", "members"])


def _prints(batches):
    """Sets in four bytes a shingle; equal halves of different shingles can only add to an overlap."""
    for b in batches:
        halves = [np.sort(np.frombuffer(x.as_buffer(), U64).astype(np.uint32)).tobytes() for x in b["members"]]
        yield pa.RecordBatch.from_arrays([b["cls"], pa.array(halves, pa.binary())], ["cls", "prints"])


def _overlaps(batches):
    for b in batches:
        common, total = [], []
        for x, y in zip(b["left"], b["right"], strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            n = len(np.intersect1d(x, y, assume_unique=True))
            common.append(n)
            total.append(len(x) + len(y) - n)
        yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b[name].to_numpy(zero_copy_only=False)


def _equal_values(sketches: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the SKETCH values of the rows ``x`` and ``y`` are equal."""
    d = sketches[x] ^ sketches[y]
    d |= d >> U64(1)
    d |= d >> U64(2)
    return SKETCH - np.bitwise_count(d & _NIBBLES).sum(axis=1, dtype=np.int64)


def _chunks(counts: np.ndarray, most: int):
    """Ranges of rows whose counts add up to ``most`` about."""
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _first_links(batches, percent: int, leaf: int, leaders_of_large: int):
    """Pass one over rows that come node by node, first members first: the members that have a partner, each with one at most.

    All that is carried from batch to batch are the first members of the node that is not ended.
    """
    names = ["part", "node", "cls", "n_shingles", "size", "head"]
    carried, had = None, 0  # the open node's first members, and how many members it has had
    for b in batches:
        rows = {c: _column(b, c) for c in names} | {"sketch": np.stack([_column(b, c) for c in _S], axis=1).view(U64)}
        kept = 0
        if carried is not None and len(rows["part"]) and carried["part"][0] == rows["part"][0]:
            kept = len(carried["part"])
            rows = {c: np.concatenate([carried[c], rows[c]]) for c in rows}
        else:
            had = 0
        n = len(rows["part"])
        if n == kept:
            continue
        first = np.flatnonzero(np.concatenate([[True], rows["part"][1:] != rows["part"][:-1]]))
        begin = np.repeat(first, np.diff(np.append(first, n)))
        large = rows["size"] > leaf
        leaders = np.minimum(np.arange(n) - begin, np.where(large, leaders_of_large, leaf))
        leaders[:kept] = 0
        partner, wanted = np.full(n, -1), large.copy()
        wanted[:kept] = False
        for a, e in _chunks(leaders, _PAIRS):
            count = leaders[a:e]
            row = np.repeat(np.arange(a, e), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            other = begin[row] + nth
            equal = _equal_values(rows["sketch"], row, other)
            small, big = np.minimum(rows["n_shingles"][row], rows["n_shingles"][other]), np.maximum(rows["n_shingles"][row], rows["n_shingles"][other])
            ok = np.flatnonzero((equal >= LINK_EQUAL) & (100 * small >= percent * big))
            if not len(ok):
                continue
            row, other, nth, equal = row[ok], other[ok], nth[ok], equal[ok]
            wanted[row] = wanted[other] = True
            rank = np.where(equal >= SURE_EQUAL, SKETCH + 1, equal) * 2 * leaf - nth
            by = np.lexsort((rank, row))
            last = by[np.append(row[by][1:] != row[by][:-1], True)]
            partner[row[last]] = other[last]
        out = np.flatnonzero(wanted & ~rows["head"])  # a head is a copy of a row that comes as well
        best = rows["cls"][partner[out]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["node"][out]), pa.array(rows["cls"][out]), pa.array(rows["size"][out]), pa.array(best, mask=partner[out] < 0)], ["node", "cls", "size", "best"]
        )
        open_from = first[-1]
        most = leaders_of_large if large[-1] else leaf
        carried = {c: x[open_from : open_from + most].copy() for c, x in rows.items()}


class _Strangers:
    """The strangers of a node with their sets as postings, and what meets them."""

    def __init__(self, percent: int):
        self.percent = percent
        self.prints, self.component, self.cls = [], [], []
        self._ready = False

    def add(self, prints, component, cls):
        self.prints += prints
        self.component.append(component)
        self.cls.append(cls)

    def _index(self):
        flat = np.concatenate(self.prints)
        self.sizes = np.array([len(p) for p in self.prints])
        by = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(self.prints)), self.sizes)[by]
        self.keys, first = np.unique(flat[by], return_index=True)
        self.first = np.append(first, len(flat))
        self.classes, self.components = np.concatenate(self.cls), np.concatenate(self.component)
        names, self.number = np.unique(self.components, return_inverse=True)
        self.numbers = len(names)
        self._ready = True

    def links(self, prints: list, component: np.ndarray):
        """For each of the members and each other component the first stranger in it that is alike, as ``(members, strangers)``."""
        if not self._ready:
            self._index()
        n, sizes = len(self.sizes), np.array([len(p) for p in prints])
        for i, j in _chunks(sizes, _PRINTS):
            flat = np.concatenate(prints[i:j])
            at = np.searchsorted(self.keys, flat)
            at[at == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[at] == flat)
            at, member = at[hit], np.repeat(np.arange(i, j), sizes[i:j])[hit]
            first, count = self.first[at], self.first[at + 1] - self.first[at]
            met = np.bincount(member - i, weights=count, minlength=j - i).astype(np.int64)
            for a, e in _chunks(np.maximum(met, n), _CELLS):
                a, e = a + i, e + i
                mine = slice(*np.searchsorted(member, [a, e]))
                c = count[mine]
                places = np.repeat(first[mine] - np.cumsum(c) + c, c) + np.arange(c.sum())
                cells = np.repeat((member[mine] - a) * n, c) + self.owner[places]
                common = np.bincount(cells, minlength=(e - a) * n).reshape(e - a, n)
                alike = (100 * common >= self.percent * (self.sizes + sizes[a:e, None] - common)) & (self.components != component[a:e, None])
                members, strangers = np.nonzero(alike)
                one = np.unique(members * self.numbers + self.number[strangers], return_index=True)[1]
                yield members[one] + a, strangers[one]


def _bits_apart(flat: np.ndarray, at: np.ndarray, width: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many parity bits the rows ``x`` and ``y`` differ; row i's bits are the ``width[i]`` values from ``flat[at[i]]``."""
    apart, least = np.empty(len(x), np.int64), np.minimum(width[x], width[y])
    for w in np.unique(least):
        these = np.flatnonzero(least == w)
        for a in range(0, len(these), step := max(1, _CELLS // int(w))):
            some = these[a : a + step]
            d = np.zeros((len(some), w), U64)
            for rows in (x[some], y[some]):
                for fold in range(int(width[rows].max() // w)):
                    has = np.flatnonzero(width[rows] > fold * w)
                    d[has] ^= flat[(at[rows[has]] + fold * w)[:, None] + np.arange(w)]
            apart[some] = np.bitwise_count(d).sum(axis=1, dtype=np.int64)
    return apart


def _may_link(batches, percent: int):
    """Of the rows of pass two, those with a partner in another component that size and parity bits allow; strangers may be repeated.

    A link's sets differ in (100 - percent) / (100 + percent) of the sum of their sizes, at most. What is carried from
    batch to batch are the strangers of the part that is not ended.
    """
    names = ["part", "lead", "cls", "component", "n"]
    carried = None
    for b in batches:
        rows = {c: _column(b, c) for c in names}
        bits = [np.frombuffer(x.as_buffer(), U64) for x in b["bits"]]
        kept = 0
        if carried is not None and len(bits) and carried[0]["part"][0] == rows["part"][0]:
            kept = len(carried[1])
            rows, bits = {c: np.concatenate([carried[0][c], rows[c]]) for c in names}, carried[1] + bits
        n = len(bits)
        if n == kept:
            continue
        first = np.flatnonzero(np.concatenate([[True], rows["part"][1:] != rows["part"][:-1]]))
        begin = np.repeat(first, np.diff(np.append(first, n)))
        leads = np.repeat(np.add.reduceat(rows["lead"].astype(np.int64), first), np.diff(np.append(first, n)))
        met = np.where(rows["lead"], 0, leads)
        width = np.array([len(x) for x in bits])
        at, flat = np.cumsum(width) - width, np.concatenate(bits)
        wanted = np.zeros(n, bool)
        for a, e in _chunks(met, _PAIRS):
            row = np.repeat(np.arange(a, e), met[a:e])
            other = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(met[a:e]) - met[a:e], met[a:e])
            x, y = rows["n"][row], rows["n"][other]
            ok = np.flatnonzero((rows["component"][row] != rows["component"][other]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)))
            apart = _bits_apart(flat, at, width, row[ok], other[ok])
            ok = ok[(100 + percent) * apart <= (100 - percent) * (x[ok] + y[ok])]
            wanted[row[ok]] = wanted[other[ok]] = True
        out = np.flatnonzero(wanted)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][out]) for c in names[:4]], names[:4])
        open_leads = np.flatnonzero(rows["lead"][first[-1] :]) + first[-1]
        carried = ({c: rows[c][open_leads] for c in names}, [bits[k] for k in open_leads]) if len(open_leads) else None


def _cross_links(batches, percent: int):
    """Pass two over rows that come node by node, strangers first: links ``(a, b)`` between components.

    What is held are the open node's strangers, LEAF at most. A stranger meets the strangers from the first row of a
    follower on, so strangers of one part meet each other there as well.
    """
    part, strangers = None, None
    for b in batches:
        parts, leads, cls, component = (_column(b, c) for c in ("part", "lead", "cls", "component"))
        prints = [np.frombuffer(x.as_buffer(), np.uint32) for x in b["prints"]]
        cuts = (np.flatnonzero((parts[1:] != parts[:-1]) | (leads[1:] != leads[:-1])) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(parts)], strict=True):
            if i == j:
                continue
            if parts[i] != part:
                part, strangers = parts[i], _Strangers(percent)
            if leads[i]:
                strangers.add(prints[i:j], component[i:j], cls[i:j])
            elif strangers.cls:
                for members, others in strangers.links(prints[i:j], component[i:j]):
                    if len(members):
                        yield pa.RecordBatch.from_arrays([pa.array(cls[i:j][members], pa.int64()), pa.array(strangers.classes[others], pa.int64())], ["a", "b"])


class _Join:
    """The tables of one run: ``active`` (classes that may have links, with tokens and sketch) and ``sets`` (theirs)."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.percent, self.words, self.docs = percent, words, docs
        sketches = docs.mapInArrow(
            lambda it: _sketches(it, words),
            "doc_id long, text_key long, n_shingles long, set_key binary, coords array<int>, " + ", ".join(f"{c} long" for c in _S),
        )
        self.sketches = written(sketches, "sketches")
        named = self.sketches.filter("doc_id is not null and n_shingles > 0")
        of_set = ["n_shingles", "coords", *_S]  # as keys these are grouped by hash; in a minimum they would be sorted
        classes = named.groupBy("set_key", *of_set).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        # the written number tells classes apart, even those of one doc_id with several texts
        self.classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "set_key", "copies", "rep", *of_set), "classes")
        self.links = None

    def find_active(self) -> None:
        picks = self.classes.select("cls", F.posexplode(F.slice("coords", 1, FIRST)).alias("pick", "token"))
        picks = picks.select("cls", (F.col("pick") * F.lit(1 << 32) + F.col("token")).alias("token"))
        common = picks.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = picks.join(common.hint("shuffle_hash"), "token").groupBy("cls").agg(F.count(F.lit(1)).alias("shared"), F.sum(F.log2("n")).cast("float").alias("typical"))
        active = shared.filter(F.col("shared") >= MIN_SHARED).select("cls", "typical")
        self.active = written(self.classes.join(active, "cls"), "active")
        self.n_active = self.active.count()
        firsts = self.active.select(F.col("rep").alias("doc_id"), "set_key", "cls")
        few = self.n_active <= BROADCAST_IDS  # else a join by id, which moves the texts once
        texts = self.docs.select("doc_id", "text").join(F.broadcast(firsts) if few else firsts, "doc_id").select("cls", "set_key", "text")
        words = self.words
        self.sets = written(texts.mapInArrow(lambda it: _full_sets(it, words), "cls long, n long, bits binary, members binary"), "sets")
        if self.sets.count() > self.n_active:  # rows are repeated
            self.sets = written(self.sets.dropDuplicates(["cls"]), "sets")

    def first_nodes(self) -> DataFrame:
        tokens = F.col("coords")
        node = [F.xxhash64(F.lit(t * len(_PATHS) + k), *(tokens[t * _TREE + c] for c in path)) for t in range(TREES) for k, path in enumerate(_PATHS)]
        return self.active.select(F.explode(F.array(*node)).alias("node"), "cls")

    def narrow(self, classes: DataFrame) -> None:
        """From now on the tables hold the given classes alone, if these are few."""
        classes = written(classes.distinct(), "narrow")
        n = classes.count()
        if n * NARROW > self.n_active:
            return
        few = F.broadcast(classes) if n <= BROADCAST_IDS else classes
        self.n_active, self.active, self.sets = n, written(self.active.join(few, "cls", "left_semi"), "active"), written(self.sets.join(few, "cls", "left_semi"), "sets")

    def sized(self, nodes: DataFrame) -> DataFrame:
        """Members of nodes of two or more, dealt to parts; each part of a large node starts with the node's first member."""
        member = ["cls", "n_shingles", "typical", *_S]
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        nodes = written(nodes.join(sizes.hint("shuffle_hash"), "node"), "nodes")  # most nodes have one member, so only now members get wide
        parts = F.ceil(F.col("size") / PART).cast("int")
        salted = F.when(F.col("size") > PART, F.xxhash64("node", F.pmod(F.xxhash64("cls"), parts).cast("int"))).otherwise(F.col("node"))
        active = self.active.select(*member)
        rows = nodes.join(active, "cls").select(salted.alias("part"), "node", "size", *member, F.lit(False).alias("head"))
        large = nodes.filter(f"size > {PART}")
        if large.isEmpty():
            return rows
        first = F.min(F.struct((-F.col("typical")).alias("order"), *member)).alias("first")
        heads = large.join(active, "cls").groupBy("node", "size").agg(first).select("node", "size", "first.*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        heads = heads.select(F.xxhash64("node", "salt").alias("part"), "node", "size", *member, F.lit(True).alias("head"))
        return rows.unionByName(heads)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The links ``(a, b)`` among the pairs, by their full sets."""
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        n = pairs.count()
        if not n:
            return pairs
        sets = self.sets.select("cls", "members")
        if 2 * n <= BROADCAST_IDS:
            sets = sets.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "cls", "left_semi")
        x, y = sets.select(F.col("cls").alias("a"), F.col("members").alias("left")), sets.select(F.col("cls").alias("b"), F.col("members").alias("right"))
        overlaps = pairs.join(x, "a").join(y, "b").mapInArrow(_overlaps, "a long, b long, common long, total long")
        return written(overlaps.filter(f"100 * common >= {self.percent} * total").select("a", "b"), "links")

    def level(self, nodes: DataFrame, depth: int) -> DataFrame | None:
        """Both passes over the nodes of a depth; returns the nodes of the next, if there are any."""
        percent, leaf, leaders = self.percent, LEAF, LEADERS
        rows = self.sized(nodes).repartition("part").sortWithinPartitions("part", F.desc("typical"), "cls")
        found = written(rows.mapInArrow(lambda it: _first_links(it, percent, leaf, leaders), "node long, cls long, size long, best long"), "members")
        links = self.confirm(found.filter("best is not null").select(F.col("cls").alias("a"), F.col("best").alias("b")))
        # links of one pass are enough as stars: what they join stays joined
        stars = star_links(links if self.links is None else self.links.unionByName(links))
        members = written(self.labelled(found.select("node", "cls"), stars), "labelled")
        by_component = members.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = F.max(F.struct("n", "component"))
        mixed = by_component.groupBy("node").agg(F.sum("n").alias("size"), largest["component"].alias("largest"), (F.sum("n") - largest["n"]).alias("strangers")).filter("strangers > 0")
        mixed = members.join(mixed, "node").withColumn("stranger", F.col("component") != F.col("largest")).drop("largest")
        mixed = written(mixed, "mixed")
        last = FIRST_DEEPER + (depth + 1) * DEEPER > COORDINATES
        crossing = self.cross(mixed if last else mixed.filter(f"strangers <= {LEAF}"))
        self.links = stars.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(self.confirm(crossing))
        large = mixed.filter(f"strangers > {LEAF}").select("node", "cls")
        if last or large.isEmpty():
            return None
        self.narrow(large.select("cls"))
        picked = large.join(self.active, "cls").select("node", "cls", F.posexplode(F.slice("coords", FIRST_DEEPER + depth * DEEPER + 1, DEEPER)).alias("pick", "token"))
        return picked.select(F.xxhash64("node", "pick", "token").alias("node"), "cls")

    def cross(self, mixed: DataFrame) -> DataFrame:
        """Links between a node's components: every stranger with every member, a part and a block of strangers at a time."""
        parts, blocks = F.ceil(F.col("size") / PART).cast("int"), F.ceil(F.col("strangers") / LEAF).cast("int")
        all_blocks = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
        all_parts = F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")
        block_of, salt_of = F.pmod(F.xxhash64("cls", F.lit(7)), blocks).cast("int"), F.pmod(F.xxhash64("cls"), parts).cast("int")
        meets = mixed.select("node", "cls", "component", F.lit(False).alias("lead"), salt_of.alias("salt"), all_blocks)
        leads = mixed.filter("stranger").select("node", "cls", "component", F.lit(True).alias("lead"), block_of.alias("block"), all_parts)
        rows = meets.unionByName(leads).select(F.xxhash64("node", "salt", "block").alias("part"), "cls", "component", "lead")
        percent = self.percent
        rows = rows.join(self.sets.select("cls", "n", "bits"), "cls").repartition("part").sortWithinPartitions("part", F.desc("lead"), "cls")
        rows = rows.mapInArrow(lambda it: _may_link(it, percent), "part long, lead boolean, cls long, component long")
        rows = written(rows.distinct(), "meetings")
        n = rows.count()
        if not n:
            return rows.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
        sets = self.sets.select("cls", "members")
        if n <= BROADCAST_IDS:
            sets = sets.join(F.broadcast(rows.select("cls").distinct()), "cls", "left_semi")
        prints = sets.mapInArrow(_prints, "cls long, prints binary")
        rows = rows.join(prints, "cls").repartition("part").sortWithinPartitions("part", F.desc("lead"), "cls")
        return rows.mapInArrow(lambda it: _cross_links(it, percent), "a long, b long")

    @staticmethod
    def labelled(rows: DataFrame, stars: DataFrame) -> DataFrame:
        """The rows with the component of their class, which is the class itself where nothing is linked with it."""
        hung = stars.groupBy(F.col("u").alias("cls")).agg(F.min("v").alias("component"))
        return rows.join(hung, "cls", "left").withColumn("component", F.coalesce("component", "cls"))

    def verdicts(self) -> DataFrame:
        """``(set_key, copies, rep, component_id)`` of all classes: the smallest doc_id of the class's component."""
        found = self.labelled(self.classes.select("cls", "set_key", "copies", "rep"), star_links(self.links))
        least = found.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        return found.join(least, "component", "left").select("set_key", "copies", "rep", F.coalesce("component_id", "rep").alias("component_id"))


#: Coordinates from here on are for the depths below the trees'.
FIRST_DEEPER = TREES * _TREE


def _verdicts(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    run = _Join(base, words, percent)
    run.find_active()
    nodes, depth = run.first_nodes(), 0
    while nodes is not None:
        nodes = run.level(nodes, depth)
        depth += 1
    changed = run.verdicts().filter("copies > 1 or component_id != rep").select("set_key", "component_id")
    return run.sketches.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(changed, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        "text_key",
    )


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each input row.

    A document's set has its distinct shingles of ``words`` words; a shorter text is one shingle. Documents are
    linked when 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id reachable, and
    the row that has it is kept. Null and wordless texts have no shingles and are linked with nothing, as are
    rows without doc_id, which stay. Rows repeated with a doc_id and text have one verdict; where one doc_id has
    several texts, each text is linked as its own set says. Very long texts are read a piece at a time and their
    sets are held whole. Other columns are not read.
    """
    return _verdicts(docs, words, percent, id_col, text_col).drop("text_key")


def one_of_each(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept. A row is known by its doc_id and text: of one doc_id with several texts, those that are kept stay."""
    kept = _verdicts(docs, words, percent, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_text")).distinct()
    same = docs[id_col].eqNullSafe(kept["_kept_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == kept["_kept_text"])
    return docs.join(kept, same, "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


#: Every pair of sets that share a shingle is counted, so it serves for small tables.
SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS varchar[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS shingles FROM t),
k AS MATERIALIZED (SELECT r, doc_id, len(shingles) AS n, sha256(array_to_string(list_sort(shingles), chr(10))) AS set_key, shingles FROM s),
c AS MATERIALIZED (SELECT set_key, min(doc_id) AS rep, any_value(n) AS n, any_value(shingles) AS shingles FROM k WHERE n > 0 AND doc_id IS NOT NULL GROUP BY set_key),
u AS MATERIALIZED (SELECT set_key, n, unnest(shingles) AS shingle FROM c),
l AS MATERIALIZED (SELECT a.set_key AS a, b.set_key AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.set_key <> b.set_key GROUP BY a.set_key, b.set_key, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT set_key AS a, set_key AS b FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
m AS (SELECT reach.a AS set_key, min(c.rep) AS component_id FROM reach JOIN c ON c.set_key = reach.b GROUP BY reach.a)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.doc_id IS NULL THEN NULL ELSE coalesce(m.component_id, k.doc_id) END AS component_id, coalesce(k.doc_id = coalesce(m.component_id, k.doc_id), true) AS kept
FROM k LEFT JOIN m ON m.set_key = k.set_key
"""
