"""Vector code compression: product-quantiser codes by partial-distance search.

Components become integers and a vector is cut into PARTS parts; each part position has a codebook of ENTRIES
entries, fitted in ROUNDS rounds of assigning and averaging over all rows. A part's nearest entry is found one
dimension at a time, in descending variance of the codebook: squared differences are added up for all entries at
once, and a mask drops an entry as soon as its sum strictly exceeds the best complete distance so far.

Spark deals the rows: a task assigns its own vectors and passes on sums of (part, entry), at most PARTS * ENTRIES
of them, which are added up by key. Only codebooks (ENTRIES rows wide) reach the driver; vectors never do.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Up to so many labels their sums are broadcast (some MB); beyond, they are joined over SALTS parts of each label.
BROADCAST_LABELS, SALTS = 100_000, 32
#: Vectors that are searched in one go.
BLOCK = 2048


class Codebooks(NamedTuple):
    """``entries[p]`` has the integer entries of part position p, by index."""

    entries: tuple[np.ndarray, ...]

    @property
    def sha256(self) -> str:
        """Of all decimal components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e.tolist()).encode()).hexdigest()


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(SCALE * x); their squared distances must fit a long."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    largest = np.abs(x).max(initial=0.0)
    if width * (2.0 * SCALE * largest + 2) ** 2 >= 2.0**63:
        raise OverflowError(f"squared distances of components as large as {largest} do not fit a long")
    return np.floor(x * SCALE).astype(np.int64)


def search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each row of ``x``; ties go to the lower index."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    first = (x[:, :1] - book[None, :, 0]) ** 2
    guess = book[first.argmin(axis=1)]
    best = ((x - guess) ** 2).sum(axis=1)  # a complete distance for each row to start with
    row, entry = np.nonzero(first <= best[:, None])
    total = first[row, entry]
    for d in range(1, x.shape[1]):
        total = total + (x[row, d] - book[entry, d]) ** 2
        alive = total <= best[row]
        row, entry, total = row[alive], entry[alive], total[alive]
    # the entries that are left have complete distances, by row and index; the best one of a row is never dropped
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, starts) if len(starts) else total
    at = np.flatnonzero(total == np.repeat(least, np.diff(np.append(starts, len(row)))))
    at = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
    return entry[at], total[at]


def _assigned(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column for each part."""
    width = x.shape[1] // len(books.entries)
    codes, errors = np.empty((len(x), len(books.entries)), np.int64), np.empty((len(x), len(books.entries)), np.int64)
    for p, book in enumerate(books.entries):
        for at in range(0, len(x), BLOCK):
            codes[at : at + BLOCK, p], errors[at : at + BLOCK, p] = search(x[at : at + BLOCK, p * width : (p + 1) * width], book)
    return codes, errors


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(vec_id, vector, label)`` without null vectors and those with null or non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return vectors.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.col(label_col).alias("label"))


def _updated(kept: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """One round: each entry becomes the componentwise floor of the mean of the parts assigned to it."""

    def sums(batches):
        w, total = width // PARTS, None
        for b in batches:
            if b.num_rows:
                x = _integers(b["vector"], width)
                codes, _ = _assigned(x, books)
                if total is None:
                    total, count = np.zeros((PARTS * ENTRIES, w), np.int64), np.zeros(PARTS * ENTRIES, np.int64)
                for p in range(PARTS):
                    np.add.at(total, p * ENTRIES + codes[:, p], x[:, p * w : (p + 1) * w])
                    count += np.bincount(p * ENTRIES + codes[:, p], minlength=len(count))
        if total is not None:
            used = np.flatnonzero(count)
            rows = np.repeat(used, w)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.tile(np.arange(w), len(used))), pa.array(total[used].ravel()), pa.array(count[rows])], ["entry", "pos", "total", "n"])

    parts = kept.select("vector").mapInArrow(sums, "entry long, pos long, total long, n long")
    means = parts.groupBy("entry", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    entries = [e.copy() for e in books.entries]
    for r in means.collect():  # components of the codebooks, whatever the number of vectors
        entries[r["entry"] // ENTRIES][r["entry"] % ENTRIES, r["pos"]] = int(r["total"]) // r["n"]
    return Codebooks(tuple(entries))


def fit(kept: DataFrame, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    """Codebooks of the ``usable`` rows, and the width of the vectors: the commonest one that PARTS divides."""
    widths = kept.groupBy(F.size("vector").alias("width")).count().filter(f"width > 0 AND width % {PARTS} = 0")
    commonest = widths.orderBy(F.desc("count"), F.desc("width")).first()
    if commonest is None:
        return Codebooks(()), 0
    width = commonest["width"]
    kept = kept.filter(F.size("vector") == width)
    first = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    x = _integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width)
    books = Codebooks(tuple(np.ascontiguousarray(p) for p in np.split(x, PARTS, axis=1)))
    for _ in range(rounds):
        books = _updated(kept, books, width)
    return books, width


def encode(kept: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """``(vec_id, code, error, label)`` of the ``usable`` rows as wide as the codebooks."""
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches):
        for b in batches:
            codes, errors = _assigned(_integers(b["vector"], width), books)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(["".join(r) for r in hexes[codes].tolist()], pa.string()), pa.array(errors.sum(axis=1)), b["label"]], ["vec_id", "code", "error", "label"])

    kind = kept.schema["label"].dataType.simpleString()
    return kept.filter(F.size("vector") == width).mapInArrow(run, f"vec_id long, code string, error long, label {kind}")


def with_label_errors(encoded: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``encoded`` with ``label_error``, the sum of the errors of its label; null labels are one group.

    The sums are broadcast if there are few of them (counted first); else a label's rows are dealt over SALTS parts.
    """
    sums = written(encoded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    if sums.limit(broadcast_labels + 1).count() <= broadcast_labels:
        return encoded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = encoded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    copies = sums.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_part"))).drop("_label", "_salt", "_part")


def compressed(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for each row with a usable vector.

    Null vectors, and vectors with null or non-finite components, are dropped. All vectors are as wide as most are
    (the commonest width that PARTS divides, the larger of two as common); empty ones and other widths are dropped.
    Codebooks start from the rows with the ENTRIES smallest vec_ids (null last, equal ones by vector; repeated rows
    count as often as they come), fewer where there are fewer. Repeated rows give repeated results; an empty table
    gives none. Components so large that a squared distance does not fit a long raise OverflowError. Texts are not
    read, and other columns are not either.
    """
    kept = usable(vectors, id_col, vec_col, label_col)
    books, width = fit(kept, rounds)
    if not width:
        return kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    encoded = written(encode(kept, books, width), "vector-codes")
    return with_label_errors(encoded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Rounds of assigning and averaging as plain joins of all parts with all entries of their position."""
    steps = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS double)) AS bigint)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS piece FROM e, (SELECT unnest(range({PARTS})) AS part) k)",
        f"c0 AS MATERIALIZED (SELECT part, r AS entry, piece AS centre FROM x WHERE r < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        distance = "list_sum(list_transform(range(1, len(piece) + 1), lambda i: (piece[i] - centre[i]) ** 2))"
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, CAST(min(d) AS bigint) AS distance, arg_min(entry, (d, entry)) AS entry FROM (SELECT r, x.part, entry, {distance} AS d FROM x JOIN c{k} USING (part)) z GROUP BY r, part)")
        if k < ROUNDS:
            steps.append(
                f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.part, c{k}.entry, coalesce(mean, centre) AS centre FROM c{k} LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS mean FROM (
 SELECT part, entry, i, CAST(floor(CAST(sum(piece[i]) AS double) / count(*)) AS bigint) AS m FROM (SELECT a{k}.part, a{k}.entry, piece, unnest(range(1, len(piece) + 1)) AS i FROM a{k} JOIN x USING (r, part)) y GROUP BY part, entry, i) w GROUP BY part, entry) n ON n.part = c{k}.part AND n.entry = c{k}.entry)"""
            )
    return f"""
WITH {', '.join(steps)},
f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS bigint) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(centre, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256 FROM f JOIN e USING (r), h
"""


SQL = _sql()
