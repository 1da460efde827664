"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are read from the text alone. Trees are grown on at most ``SAMPLE`` labelled rows (those with
the smallest hashes of their doc_id), with features cut into quantile bins and split gains summed from
histograms, and flattened into arrays; a batch of documents walks all trees at once, a level at a time.
The model has a few thousand numbers whatever the corpus, so it goes to the workers with the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import odd_constants, word_hashes

#: The model is fitted on no more rows than this.
SAMPLE = 20_000
HELD_OUT_OF, HELD_OUT, KEEP_AT = 4, 2, 0.7
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 80, 4, 64, 0.12, 8, 1.0

_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _MARK, _SYMBOL, _LEAD, _REST = range(1, 10)
_CLASS = np.zeros(256, np.int64)
for _kind, _bytes in ((_LOWER, range(97, 123)), (_UPPER, range(65, 91)), (_DIGIT, range(48, 58)), (_BLANK, b" \t"), (_LINE, b"\n\r\x0b\x0c"), (_MARK, b".,;:'\"()-?"), (_SYMBOL, b"!#$%&*+/<=>@[\\]^_`{|}~"), (_LEAD, range(192, 256)), (_REST, range(128, 192))):
    _CLASS[list(_bytes)] = _kind
FEATURES = ("log_bytes", "upper", "digit", "blank", "line", "mark", "symbol", "foreign", "other", "word_bytes", "words_distinct", "pairs_distinct", "lines_distinct", "line_words", "commonest_word", "symbols_a_word", "marks_a_word")
_PAIR = odd_constants(71, 2)


def statistics(texts: list) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts have zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, h, bounds in word_hashes(texts):
        j = i + len(bounds) - 1
        raw = [(t or "").encode() for t in texts[i:j]]
        sizes = np.array([len(r) for r in raw])
        kinds = _CLASS[np.frombuffer(b"".join(raw), np.uint8)] + np.repeat(np.arange(len(raw)) * 10, sizes)
        counts = np.bincount(kinds, minlength=10 * len(raw)).reshape(-1, 10).astype(float)
        words, size = np.maximum(np.diff(bounds), 1), np.maximum(sizes, 1)
        pairs = h[:-1] * _PAIR[0] + h[1:] * _PAIR[1]
        rows = out[i:j]
        rows[:, 0] = np.log1p(sizes)
        for k, kind in enumerate((_UPPER, _DIGIT, _BLANK, _LINE, _MARK, _SYMBOL, _LEAD, 0)):
            rows[:, 1 + k] = counts[:, kind] / size
        rows[:, 9] = (sizes - counts[:, _BLANK] - counts[:, _LINE]) / words
        for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                _, times = np.unique(h[a:b], return_counts=True)
                lines = [x for x in (texts[i + r] or "").split("\n") if x]
                rows[r, 10] = len(times) / (b - a)
                rows[r, 11] = len(np.unique(pairs[a : b - 1])) / (b - a - 1) if b - a > 1 else 1.0
                rows[r, 12] = len(set(lines)) / max(1, len(lines))
                rows[r, 13] = (b - a) / max(1, len(lines))
                rows[r, 14] = times.max() / (b - a)
        rows[:, 15] = counts[:, _SYMBOL] / words
        rows[:, 16] = counts[:, _MARK] / words
    return out


class Forest:
    """Complete trees of DEPTH levels as arrays: split features and thresholds by level order, then leaf values."""

    def __init__(self, features: np.ndarray, thresholds: np.ndarray, leaves: np.ndarray, start: float):
        self.features, self.thresholds, self.leaves, self.start = features, thresholds, leaves, start

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost logistic loss. Without rows every score is almost 1: nothing speaks against a document."""
    share = np.clip((y.sum() + 1) / (len(y) + 1), 1e-3, 1 - 1e-6)
    start, splits, leaves = float(np.log(share / (1 - share))), 2**DEPTH - 1, 2**DEPTH
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, splits), int), np.zeros((0, splits)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    total, n = np.full(len(y), start), x.shape[1]
    found = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, w = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(splits, int), np.full(splits, np.inf)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            cells = local[:, None] * (n * BINS) + np.arange(n) * BINS + binned
            shape = nodes, n, BINS
            sums = [np.bincount(cells.ravel(), np.repeat(v, n), nodes * n * BINS).reshape(shape).cumsum(2) for v in (g, w, np.ones(len(y)))]
            gl, wl, cl = (s[:, :, :-1] for s in sums)
            ga, wa, ca = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (wl + RIDGE) + (ga - gl) ** 2 / (wa - wl + RIDGE) - ga**2 / (wa + RIDGE)
            gain[(cl < LEAST_ROWS) | (ca - cl < LEAST_ROWS)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS - 1)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        local = at - splits
        leaf = RATE * np.bincount(local, g, leaves) / (np.bincount(local, w, leaves) + RIDGE)
        total += leaf[local]
        found.append((feature, threshold, leaf))
    f, t, v = map(np.array, zip(*found, strict=True))
    return Forest(f, t, v, start)


def _held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT_OF == HELD_OUT


def _statistics_batches(batches):
    for b in batches:
        rows = statistics(b["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([b["label"], pa.array(list(rows), pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled rows outside the held-out quarter; rows without a label or doc_id teach nothing."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(~_held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text").mapInArrow(_statistics_batches, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["x"], r["label"]))  # the same model, however the rows came
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], float))


def scored(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row; no shuffle."""

    def run(batches):
        for b in batches:
            score = forest.score(statistics(b["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= KEEP_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _held_out(F.col(id_col)).alias("held_out"))
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs``.

    Null and empty texts have statistics of zero and get the score of those. A null doc_id is not held out.
    Repeated rows get the same score, and repeated labels teach as often as they come, within the sample. An
    empty table gives an empty result; without labels every score is almost 1. Other columns are not read.
    """
    return scored(docs, train(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, whole and in one pass.

    Null and empty texts are judged by the score of no text; repeated rows share a verdict; an empty table stays
    empty. All columns of ``docs`` are returned as they came, whatever their names.
    """
    forest = train(docs, labels)
    columns = docs.columns

    def run(batches):
        for b in batches:
            keep = forest.score(statistics(b["text"].to_pylist())) >= KEEP_AT
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema).select(columns)


def query(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
