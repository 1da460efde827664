import random
import re

import numpy as np
import pyarrow as pa
import pytest

from maskora.llm import components, near_dedup
from maskora.llm.components import connected_components
from tests.llm.fixtures import awkward_docs, docs_frame


def shingles(text, k):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t, k))
    parent = {i: i for i in sets}
    ids = sorted(i for i in sets if sets[i])
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    pairs = {(a, b) for v in where.values() if len(v) < 2000 for x, a in enumerate(v) for b in v[x + 1 :]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(parent, a), root(parent, b)
            parent[max(x, y)] = min(x, y)
    out = []
    for i, t in rows:
        c = None if i is None else root(parent, i)
        out.append((i, len(shingles(t, k)), c, i is None or i == c))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def groups(seed):
    """Near copies of several bases at varying distances, chains of edits, and texts that share a passage."""
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, at = [], 1000
    for _ in range(12):
        base = fresh(rng.choice([8, 40, 150, 400]))
        for _ in range(rng.choice([2, 3, 12, 40])):
            rows.append((at, edited(base, rng, rng.randrange(1 + len(base) // 25))))
            at += 1
    chain = fresh(120)
    for _ in range(30):
        chain = edited(chain, rng, 1).split(" ")
        rows.append((at, " ".join(chain)))
        at += 1
    passage = fresh(60)
    for _ in range(200):
        rows.append((at, " ".join(fresh(rng.randrange(20, 200)) + passage + fresh(5))))
        at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaf,leaders,part,words", [(1024, 64, 8192, 4), (16, 4, 40, 5), (3, 2, 7, 4)])
def test_components_equal_brute_force(spark, monkeypatch, leaf, leaders, part, words):
    """With small limits nodes branch on, are dealt to several tasks, and strangers come in blocks."""
    for name, value in {"LEAF": leaf, "LEADERS": leaders, "PART": part}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rows = [*awkward_docs(), *groups(leaf + words)]
    assert found(near_dedup.near_duplicates(docs_frame(spark, rows), words)) == brute(rows, words)


def test_last_depth_compares_blocks_of_strangers(spark, monkeypatch):
    """No coordinate is left below the trees, so more strangers than a block holds are met block by block."""
    monkeypatch.setattr(near_dedup, "COORDINATES", near_dedup.FIRST_DEEPER)
    for name, value in {"LEAF": 3, "LEADERS": 2, "PART": 7}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(8)
    base = [f"v{i}" for i in range(100)]
    rows = [(i, edited(base, rng, 3 + i % 9)) for i in range(150)]
    assert found(near_dedup.near_duplicates(docs_frame(spark, rows), 4)) == brute(rows, 4)


def test_one_doc_id_with_several_texts(spark):
    rng = random.Random(4)
    a, b = ([f"{x}{i}" for i in range(60)] for x in "pq")
    rows = [(1, " ".join(a)), (2, edited(a, rng, 1)), (2, " ".join(b)), (3, edited(b, rng, 1)), (None, " ".join(b))]
    got = near_dedup.near_duplicates(docs_frame(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1), (2, 1), (2, 2), (3, 2), (None, None)], key=repr)
    kept = near_dedup.one_of_each(docs_frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)


def test_empty_table(spark):
    assert found(near_dedup.near_duplicates(docs_frame(spark, []))) == []


def test_components(spark):
    links = [(1, 2), (2, 1), (3, 2), (5, 5), (9, 8), (8, 7), (7, 6), (6, 4)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 4), (7, 4), (8, 4), (9, 4)]


@pytest.mark.parametrize("merged", [1, 50, 1 << 20])
def test_components_of_links_merged_in_tasks(spark, monkeypatch, merged):
    """Chains, hubs and repeated links give the same whatever a task merges at once; a chain in one task takes no round."""
    rng = random.Random(merged)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + rng.randrange(300)) for _ in range(400)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    rng.shuffle(links)
    parent = {i: i for x in links for i in x}
    for a, b in links:
        x, y = root(parent, a), root(parent, b)
        parent[max(x, y)] = min(x, y)
    monkeypatch.setattr(components, "MERGED", merged)
    rounds = []
    monkeypatch.setattr(components, "_star", lambda *a, f=components._star: rounds.append(1) or f(*a))
    got = connected_components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()
    assert sorted(map(tuple, got)) == sorted((i, root(parent, i)) for i in parent)
    assert merged < len(links) or not rounds


def test_strangers_meet_members_many_at_a_time(monkeypatch):
    """Links of members met together equal those of each member alone, in whatever batches they come."""
    rng = random.Random(6)
    base = [rng.randrange(1 << 32) for _ in range(200)]
    rows = []
    for part in range(5):
        sets = [sorted({*rng.sample(base, 190), *(rng.randrange(1 << 32) for _ in range(rng.randrange(40)))}) for _ in range(40)]
        rows += [(part, k < 15, 100 * part + k, rng.randrange(6), s) for k, s in enumerate(sets)]
        rows += [(part, False, 100 * part + k, rows[-40 + k][3], sets[k]) for k in range(15)]
    want = set()
    for part, lead, cls, component, s in rows:
        best = {}
        for p, is_lead, other, c, o in rows:
            n = len({*s} & {*o})
            if not lead and p == part and is_lead and c != component and 100 * n >= 80 * (len(s) + len(o) - n):
                best.setdefault(c, (cls, other))
        want |= {*best.values()}
    for size, cells in ((7, 20), (1000, 1 << 21)):
        monkeypatch.setattr(near_dedup, "_CELLS", cells)
        monkeypatch.setattr(near_dedup, "_PRINTS", 100 * cells)
        table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(["part", "lead", "cls", "component"])})
        table = table.append_column("prints", pa.array([np.array(r[4], np.uint32).tobytes() for r in rows], pa.binary()))
        got = [(x["a"], x["b"]) for b in near_dedup._cross_links(table.to_batches(size), 80) for x in b.to_pylist()]
        assert len(got) == len({*got}) and {*got} == want and want


def test_only_members_that_may_link_bring_their_sets():
    """Size and parity bits keep each row that has a link to another component, in whatever batches rows come, and leave most others."""
    rng = np.random.default_rng(9)
    rows = []
    for part in range(30):
        base = rng.integers(0, 1 << 63, rng.integers(1, 700)).astype(np.uint64)
        for k in range(20):
            own = base[rng.random(len(base)) < (0.9 if k % 4 else 0.4)]
            s = np.unique(np.concatenate([own, rng.integers(0, 1 << 63, 1 + rng.integers(0, 1 + len(base) // 8)).astype(np.uint64)]))
            rows.append((part, False, 100 * part + k, int(rng.integers(4)), s))
        rows += [(part, True, *r[2:]) for r in rows[-7:]]
    rows.sort(key=lambda r: (r[0], not r[1], r[2]))
    linked, met = set(), set()
    for part, lead, cls, component, s in rows:
        for p, is_lead, other, c, o in rows:
            if not lead and p == part and is_lead and c != component:
                n = len(np.intersect1d(s, o))
                pair = {(part, False, cls, component), (part, True, other, c)}
                met |= pair
                linked |= pair if 100 * n >= 80 * (len(s) + len(o) - n) else set()
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(["part", "lead", "cls", "component"])})
    table = table.append_column("n", pa.array([len(r[4]) for r in rows])).append_column("bits", pa.array([near_dedup._bits(r[4]) for r in rows], pa.binary()))
    for size in (3, 50, 1000):
        got = {tuple(x.values()) for b in near_dedup._may_link(table.to_batches(size), 80) for x in b.to_pylist()}
        assert linked and linked <= got <= met and len(got - linked) < len(met - linked) / 2


def test_deeper_levels_hold_their_own_classes_alone(spark, monkeypatch):
    """Below the trees only the classes of nodes with many strangers are read; the sets of all others stay where they are."""
    for name, value in {"LEAF": 16, "LEADERS": 4, "PART": 40}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(12)
    base = [f"v{i}" for i in range(100)]
    rows = [(i, edited(base, rng, 3 + i % 9)) for i in range(120)]
    for i in range(400):
        pair = [f"p{i}_{k}" for k in range(60)]
        rows += [(1000 + 2 * i, " ".join(pair)), (1001 + 2 * i, edited(pair, rng, 1))]
    held = []
    monkeypatch.setattr(near_dedup._Join, "level", lambda run, nodes, depth, f=near_dedup._Join.level: held.append(run.sets.count()) or f(run, nodes, depth))
    assert found(near_dedup.near_duplicates(docs_frame(spark, rows), 4)) == brute(rows, 4)
    assert len(held) > 1 and held[0] > 800 and max(held[1:]) <= 120
