import hashlib
import random
import zlib

import duckdb
import pytest

from maskora.llm import prefix_trie as P


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda r: (r[0], r[1], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
    convs = {c: [r[2:] for r in sorted(ts, key=order)] for c, ts in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        remainder = c % 100 if c >= 0 else -(-c % 100)
        made[c] = convs.get(c - remainder, [])[:h] + own[h:]
    nodes = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    below = {n: [0, 0] for n in nodes}
    children = {n: 0 for n in nodes}
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        saved = (len(members) - 1) * len(n[-1][1]) if n else 0
        for d in range(len(n) + 1):
            below[n[:d]][0] += children[n] == 0
            below[n[:d]][1] += saved
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], *below[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, longest + 1)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if words > 2 else "user", rng.choice(["a", "𠮷𠮷", "", "hello there", "ünï"][:words])))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x", 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, name int, conv string, top long, digest string")


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


AWKWARD = [
    (None, 0, "user", "lost"), (1, None, "user", "early"), (1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 1, "user", "tie"), (2, 5, "user", "only late"), (2, -3, "user", "before"),
    (300, 0, "u", "ser"), (301, 0, "us", "er"), (-5, 0, "user", "a"), (-105, 0, "user", "a"), (-100, 0, "user", "a"), (-100, 1, "user", "b"), (7, 0, "user", "x" * 100_000), (8, 0, "user", "x" * 100_000), (9, 0, "user", None), (9, None, None, "n"),
]


@pytest.mark.parametrize(
    "rows",
    [AWKWARD + random_rows(1, range(95, 330), 12, 2), AWKWARD, [(5, 0, "user", "a")], [(c, t, "user", "same") for c in range(40) for t in range(20)], [(1, t, "user", str(t % 3)) for t in range(70)] + [(2, t, "user", str(t % 3)) for t in range(65)]],
)
def test_against_brute_force(spark, rows):
    assert found(P.trie(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert found(P.trie(frame(spark, []))) == found(P.trie(frame(spark, [(None, 1, "user", "x")]))) == []


def test_against_sql(spark):
    rows = random_rows(2, [*range(90, 330), -7, -120, 1_000_000], 9, 3)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert found(P.trie(frame(spark, rows))) == sorted(con.execute(P.SQL).fetchall(), key=repr)


def test_long_id_lists_come_in_pieces(spark, monkeypatch):
    members = [(2, 5, c) for c in range(5, 4000)] + [(2, 9, c) for c in (9, 4001)] + [(3, 5, 5)]
    df = spark.createDataFrame(members, "depth long, top long, conv long")
    monkeypatch.setattr(P, "PIECE", 60)
    expected = {(d, t): hashlib.sha256(",".join(str(c) for x, y, c in members if (x, y) == (d, t)).encode()).hexdigest() for d, t, _ in members}
    assert {(r["depth"], r["top"]): r["ends_sha256"] for r in P.list_digests(df).collect()} == expected


def test_names_are_dense_and_shared(spark):
    df = spark.createDataFrame([(i, i % 7, i % 3) for i in range(500)], "id long, a long, b long").repartition(8)
    rows = P.named(df, ["a", "b"]).collect()
    by_key = {(r["id"] % 7, r["id"] % 3): r["name"] for r in rows}
    assert len(rows) == 500 and sorted(by_key.values()) == list(range(21))
    assert all(by_key[r["id"] % 7, r["id"] % 3] == r["name"] for r in rows)
