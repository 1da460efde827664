"""Language-model scoring with a weighted backoff automaton.

Smoothed n-grams are states: a state has an arc for each token that was seen after it and a failure arc to the
state of the shorter history, with a weight. A text is scored in one walk from left to right that carries the
state and adds log-probabilities. The model is a Dirichlet-smoothed n-gram model of ORDER tokens,

    p_1(w)     = (c(w) + 1) / (N + V + 1)
    p_k(w | h) = (c(h w) + MASS * p_{k-1}(w | h')) / (c(h) + MASS),

so the failure arc of h costs log10(MASS / (c(h) + MASS)), and the root's failure is the unknown token. The
distribution over the V known tokens and one unknown token sums to one in each state.

The full model grows with the corpus and is on no machine. Scan tasks pack their rows into blocks of BLOCK_BYTES
of text; a block asks for the corpus counts of its own distinct n-grams, in hash ranges (buckets); each bucket
adds up what the blocks have counted and answers each of them in place; a block then builds the part of the
automaton that its texts can reach (states, arcs, failure links) and walks it. The packed texts are shuffled
once: both uses of a block read the same exchange. Neither a hot n-gram nor a hot source nor a repeated doc_id
fills a task: in a bucket an n-gram comes once from a block at most, and blocks are cut by size alone. A task
holds one block or one bucket, whatever the corpus; a message is never empty, so there is one for each n-gram of a
block at most, and far fewer while a block has many n-grams of a bucket. Each bucket tells its tokens and types once;
their sums N and V go to all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, all_word_hashes, mix64, odd_constants, pieces

ORDER = 3
#: Weight of the shorter history in a smoothed state, in tokens.
MASS = 4.0
BLOCK_BYTES = 8 << 20
#: N-grams that all blocks together ask of a bucket, about.
BUCKET_KEYS = 4_000_000
#: Tokens of a text that are walked in one go; the state depends on ORDER - 1 tokens alone, so a walk can start anywhere after these.
SEGMENT = 512
HELD_OUT_OF, HELD_OUT = 7, 2
END = mix64(np.array([0x5EED], U64))[0]
_MULTIPLY = odd_constants(29, 8)


def _token_stream(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and one end token after them; bounds of each text."""
    h, b = all_word_hashes(texts)
    n = np.diff(b)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(bounds[-1], END, U64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = h
    return out, bounds


def _ngram_keys(tokens: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a k-gram ends, and its key. A text starts after an end token; nothing reaches back beyond that."""
    into = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    at = np.flatnonzero(into >= k - 2)
    key = tokens[at] * _MULTIPLY[0]
    for back in range(1, k):
        before = tokens[np.maximum(at - back, 0)]
        before[into[at] < back] = END
        key += before * _MULTIPLY[back]
    return at, mix64(key ^ _MULTIPLY[4 + k % 4])


def _pack(batches) -> Iterator[pa.RecordBatch]:
    """The rows of a task as compressed blocks, each with a number of its own."""
    number, rows, size = TaskContext.get().partitionId() << 32, [], 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for r in rows:
                out.write_batch(r)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "packed"])

    for b in batches:
        lengths = pc.binary_length(b["text"]).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            fits = max(int(np.searchsorted(np.cumsum(lengths[at:]), BLOCK_BYTES - size, "right")), 0 if rows else 1)
            if fits:
                rows.append(b.slice(at, fits))
                size += int(lengths[at : at + fits].sum())
                at += fits
            if at < b.num_rows:
                yield block()
                number, rows, size = number + 1, [], 0
    if rows:
        yield block()


def _unpack(block: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(block["packed"][0].as_buffer()).read_all()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the number of each key among them."""
    by = np.argsort(keys)
    keys = keys[by]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.empty(len(by), np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], number


def _planes(x: np.ndarray) -> bytes:
    """The width, and byte planes, compressed: equal high bytes lie together."""
    x = x.astype(np.min_scalar_type(x.max(initial=0)))
    return bytes([x.itemsize]) + zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def _from_planes(data: bytes) -> np.ndarray:
    x = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(x.T).view(f"<u{data[0]}").ravel()


_LOW, _LOW_BYTES = U64((1 << 40) - 1), 5


def _steps(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as steps from one to the next: the five low bytes as they are, for they are random, and the rest packed."""
    steps = np.diff(keys, prepend=keys[:1])
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :_LOW_BYTES]).tobytes(), _planes(steps >> U64(40))


def _from_steps(start: int, low: bytes, high: bytes) -> np.ndarray:
    steps = np.zeros((len(low) // _LOW_BYTES, 8), np.uint8)
    steps[:, :_LOW_BYTES] = np.frombuffer(low, np.uint8).reshape(-1, _LOW_BYTES)
    steps = steps.view(U64).ravel() | _from_planes(high).astype(U64) << U64(40)
    return np.cumsum(steps, dtype=U64) + U64(start)


def _requests(block: pa.Table, buckets: int, order: int) -> pa.Table:
    """Messages to the buckets: the block's distinct n-grams of each order there, and their training counts. Buckets of which it has none get none."""
    docs = _unpack(block)
    tokens, bounds = _token_stream(docs["text"].to_pylist())
    train = np.repeat(~docs["held_out"].to_numpy(), np.diff(bounds))
    edges = (np.arange(1, buckets, dtype=U64) << U64(32)) // U64(buckets) << U64(32)
    rows = []
    for k in range(1, order + 1):
        at, keys = _ngram_keys(tokens, bounds, k)
        keys, number = _distinct(keys)
        counts = np.bincount(number[train[at]], minlength=len(keys))
        bucket = np.searchsorted(edges, keys, "right")
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = keys[low:high]
            rows.append((int(bucket[low]), k, int(part[:1].view(np.int64).sum()), *_steps(part), _planes(counts[low:high])))
    columns = dict(zip(["bucket", "n", "start", "low", "high", "counts"], map(list, zip(*rows, strict=True)), strict=True))
    return pa.table({"block": np.full(len(rows), block["block"][0].as_py()), **columns})


def _sums(bucket: pa.Table, messages: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (some of) a bucket's messages: how many n-grams each has, the number of each n-gram, and the corpus counts by number."""
    rows = bucket if messages is None else bucket.take(pa.array(messages))
    keys = [_from_steps(start & 2**64 - 1, low, high) for start, low, high in zip(*(rows[c].to_pylist() for c in ("start", "low", "high")), strict=True)]
    keys = keys or [np.zeros(0, U64)]
    sizes = np.array([len(x) for x in keys])
    distinct, number = _distinct(np.concatenate(keys))
    counts = np.concatenate([_from_planes(x) for x in rows["counts"].to_pylist()] or [np.zeros(0)])
    return sizes, number, np.bincount(number, weights=counts, minlength=len(distinct)).astype(np.int64)


def _vocabulary(bucket: pa.Table) -> pa.Table:
    """A bucket's training tokens and types."""
    *_, sums = _sums(bucket, np.flatnonzero(bucket["n"].to_numpy() == 1))
    return pa.table({"tokens": [int(sums.sum())], "types": [int((sums > 0).sum())]})


def _answers(bucket: pa.Table) -> pa.Table:
    """To each block the corpus counts of the n-grams it has asked for, in their order."""
    sizes, number, sums = _sums(bucket)
    out = [_planes(sums[number[end - n : end]]) for n, end in zip(sizes, np.cumsum(sizes), strict=True)]
    return pa.table({"block": bucket["block"], "bucket": bucket["bucket"], "n": bucket["n"], "totals": pa.array(out, pa.binary())})


class Automaton:
    """The part of the backoff automaton that the texts' n-grams reach. State 0 is the root, the empty history.

    ``totals[k]`` has the corpus count of each distinct (k + 1)-gram, ``places[k]`` and ``numbers[k]`` where one ends
    and which it is. Arcs lie in order of (state, token); a token is the number of its unigram.
    """

    def __init__(self, totals: list, places: list, numbers: list, bounds: np.ndarray, n: int, v: int):
        order = len(numbers)
        self.tokens, self._width = numbers[0], len(totals[0])
        end = self.tokens[bounds[1] - 1]
        begins = np.zeros(bounds[-1], bool)
        begins[bounds[:-1]] = True
        self.unknown = np.log10(1 / (n + v + 1))
        self.fail, self.fail_weight = [np.zeros(1, np.int32)], [np.zeros(1)]
        keys, targets, weights = [], [], []
        # of the n-gram of one token less that ends at each place: its state, its count, its probability after its history
        state, seen_before, p_shorter, states = np.zeros(bounds[-1], np.int32), None, None, 1
        for k, (total, at, x) in enumerate(zip(totals, places, numbers, strict=True), 1):
            once = np.empty(len(total), np.int64)
            once[x] = np.arange(len(x))
            where = at[once]  # a place for each distinct n-gram
            if k == 1:
                p = (total + 1) / (n + v + 1)
                source = np.zeros(len(total), np.int32)
            else:
                start = begins[where]
                source = np.where(start, end_state, state[where - 1])
                history = np.where(start, end_count, seen_before[where - 1])
                p = (total + MASS * p_shorter[where]) / (history + MASS)
            live = total > 0
            suffix = state[where]
            if k < order:
                own = np.where(live, states - 1 + np.cumsum(live), 0).astype(np.int32)
                states += int(live.sum())
                self.fail.append(suffix[live])
                self.fail_weight.append(np.log10(MASS / (total[live] + MASS)))
            else:
                own = suffix
            keys.append(source[live].astype(np.int64) * self._width + self.tokens[where[live]])
            targets.append(own[live])
            weights.append(np.log10(p[live]))
            if k < order:
                if k == 1:
                    end_state, end_count = own[end], total[end]
                state[at] = own[x]
                seen_before, p_shorter = np.zeros(bounds[-1]), np.zeros(bounds[-1])
                seen_before[at], p_shorter[at] = total[x], p[x]
        self.fail, self.fail_weight = np.concatenate(self.fail), np.concatenate(self.fail_weight)
        keys = np.concatenate([*keys, [np.iinfo(np.int64).max]])
        by = np.argsort(keys)
        self._arcs = keys[by]
        self._target = np.concatenate([*targets, [0]]).astype(np.int32)[by]
        self._weight = np.concatenate([*weights, [0.0]])[by]
        self.start = int(end_state) if order > 1 else 0

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10-probabilities: failure arcs are followed until a state has an arc for the token."""
        to, log_p, left = np.zeros(len(state), np.int64), np.zeros(len(state)), np.arange(len(state))
        while len(left):
            key = state[left] * self._width + token[left]
            arc = np.searchsorted(self._arcs, key)
            hit = self._arcs[arc] == key
            done = left[hit]
            log_p[done] += self._weight[arc[hit]]
            to[done] = self._target[arc[hit]]
            left = left[~hit]
            root = state[left] == 0
            log_p[left[root]] += self.unknown
            left = left[~root]
            log_p[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return to, log_p

    def walk(self, bounds: np.ndarray, order: int) -> np.ndarray:
        """Log10-probability of each text. All texts, and the segments of a long one, take their steps together; a
        segment comes into its state on the order - 1 tokens before it, which it does not count."""
        counts = -(-np.diff(bounds) // SEGMENT)
        text = np.repeat(np.arange(len(counts)), counts)
        begin = bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * SEGMENT
        until = np.minimum(begin + SEGMENT, bounds[1:][text])
        warm = np.where(begin > bounds[:-1][text], order - 1, 0)
        state = np.where(warm > 0, 0, self.start)
        score, by = np.zeros(len(text)), np.argsort(-(until - begin + warm), kind="stable")
        begin, until, warm, state = begin[by] - warm[by], until[by], warm[by], state[by]
        lengths = until - begin
        for t in range(lengths[0]):
            live = int(np.searchsorted(-lengths, -t, "left"))
            state[:live], log_p = self.step(state[:live].copy(), self.tokens[begin[:live] + t])
            score[:live] += np.where(t >= warm[:live], log_p, 0.0)
        return np.bincount(text[by], weights=score, minlength=len(counts))


def _scores(block: pa.Table, answers: pa.Table, order: int) -> pa.Table:
    docs = _unpack(block)
    tokens, bounds = _token_stream(docs["text"].to_pylist())
    answers = answers.sort_by([("n", "ascending"), ("bucket", "ascending")])
    of_order = answers["n"].to_numpy()
    n, v = answers["tokens"][0].as_py(), answers["types"][0].as_py()
    packed = answers["totals"].to_pylist()
    totals, places, numbers = [], [], []
    for k in range(1, order + 1):
        at, keys = _ngram_keys(tokens, bounds, k)
        keys, number = _distinct(keys)
        total = np.concatenate([_from_planes(packed[i]).astype(np.float64) for i in np.flatnonzero(of_order == k)])
        if len(total) != len(keys):
            raise ValueError("the answers do not fit the block")
        totals.append(total)
        places.append(at)
        numbers.append(number)
    del packed, answers, keys
    automaton = Automaton(totals, places, numbers, bounds, n, v)
    known = totals[0][numbers[0]]
    del totals, places, numbers
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "held_out": docs["held_out"],
            "n_tokens": np.diff(bounds).astype(np.int64),
            "n_known": np.add.reduceat((known > 0).astype(np.int64), bounds[:-1]),
            "train_tokens": np.full(docs.num_rows, n, np.int64),
            "base_score": np.add.reduceat(np.log10((known + 1) / (n + v + 1)), bounds[:-1]),
            "score": automaton.walk(bounds, order),
        }
    )


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row.

    Null and empty texts are scored as the end token alone. Rows whose crc32(doc_id as text) mod 7 is 2 teach
    the model nothing; a null doc_id counts as the empty text there. Repeated rows count as often as they come.
    Without any training row every token is unknown, with probability 1 / (0 + 0 + 1). A text longer than a block
    is a block by itself and is walked in segments. An empty table gives no rows. Other columns are not read.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % HELD_OUT_OF == HELD_OUT).alias("held_out"),
    )
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size * order // 5 // BUCKET_KEYS + 1
    blocks = base.mapInArrow(_pack, "block long, packed binary")
    requests = blocks.groupBy("block").applyInArrow(lambda t: _requests(t, buckets, order), "block long, bucket long, n long, start long, low binary, high binary, counts binary")
    # both read one exchange; the totals are a row for each bucket, added up before they reach the blocks
    asked = requests.groupBy("bucket")
    answers = asked.applyInArrow(_answers, "block long, bucket long, n long, totals binary")
    totals = asked.applyInArrow(_vocabulary, "tokens long, types long").agg(F.struct(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).alias("t"))
    answers = answers.withColumn("t", totals.scalar()).select("block", "bucket", "n", "totals", "t.tokens", "t.types")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _scores(a, b, order), SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
