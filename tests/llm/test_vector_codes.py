import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from maskora.llm import vector_codes as V


def brute(rows):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    widths = [len(v) for _, v, _ in kept if v and len(v) % 16 == 0]
    if not widths:
        return []
    width = max(set(widths), key=lambda w: (widths.count(w), w))
    kept = sorted(((i, v, label) for i, v, label in kept if len(v) == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // 16
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    parts = [[v[p * w : (p + 1) * w] for p in range(16)] for v in ints]
    books = [[parts[r][p] for r in range(min(64, len(parts)))] for p in range(16)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(piece, e, strict=True)), k) for k, e in enumerate(books[p])) for p, piece in enumerate(row)] for row in parts]

    for _ in range(2):
        found = assign()
        for p in range(16):
            for k in range(len(books[p])):
                mine = [parts[r][p] for r in range(len(parts)) if found[r][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    return sorted([(i, "".join(f"{k:02x}" for _, k in f), e, labels[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)], key=repr)


def rows_of(n, width=32, seed=1):
    rng = random.Random(seed)
    single = lambda x: float(np.float32(x))
    rows = [(i, [single(rng.gauss(0, 0.2)) for _ in range(width)], rng.choice([0, 1, 2, 2, 2, None])) for i in rng.sample(range(10 * n), n)]
    return rows


def awkward(width=32):
    rows = rows_of(150, width)
    rows += [(5000, None, 1), (5001, [None] + [0.5] * (width - 1), 1), (5002, [float("nan")] + [0.5] * (width - 1), 1), (5003, [float("inf")] * width, 2), (5004, [], 2), (5005, [1.0] * 16, 2), (5006, [1.0] * (width + 1), 2)]
    rows += [(None, rows[0][1], 2), (rows[1][0], rows[1][1], rows[1][2]), (rows[2][0], rows[3][1], None), (6000, [-1.0] * width, 7), (6001, [0.0] * width, None)]
    rows += [(7000 + i, rows[5][1], 1) for i in range(40)]
    return rows


def frame(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, code string, error int, pos int, entry string, n int, total string"
    return spark.createDataFrame([(*r, "x", 1, 1, "x", 1, "x") for r in rows], schema)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_awkward_rows(spark):
    rows = awkward()
    assert found(V.compressed(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0] * 5, 1)], rows_of(1), rows_of(7, 16), [(i, [0.25] * 16, i % 3) for i in range(100)]])
def test_small_tables(spark, rows):
    assert found(V.compressed(frame(spark, rows))) == brute(rows)


def test_against_sql(spark):
    rows = [r for r in awkward() if r[0] is not None and (r[1] is None or len(r[1]) == 32)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in rows])
    assert found(V.compressed(frame(spark, rows))) == sorted(con.execute(V.SQL).fetchall(), key=repr)


def test_labels_beyond_the_broadcast(spark):
    rows = awkward()
    df = frame(spark, rows)
    kept = V.usable(df, "vec_id", "embedding", "label")
    encoded = V.encode(kept, *V.fit(kept))
    one, other = (found(V.with_label_errors(encoded, n).select("vec_id", "code", "error", "label_error")) for n in (100, 0))
    assert one == other == [r[:4] for r in brute(rows)]


def test_search_is_exhaustive_search():
    rng = np.random.default_rng(3)
    for low, high in ((-3, 3), (-200, 200), (0, 1)):
        x, book = rng.integers(low, high, (500, 5)), rng.integers(low, high, (64, 5))
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        entry, total = V.search(x, book)
        assert (entry == d.argmin(axis=1)).all() and (total == d.min(axis=1)).all()


def test_components_too_large_for_a_long(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        V.compressed(frame(spark, [(1, [1e30] * 16, 1), (2, [0.0] * 16, 1)])).collect()
