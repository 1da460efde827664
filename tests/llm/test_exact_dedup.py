import hashlib
import random

from maskora.llm import exact_dedup
from tests.llm.fixtures import awkward_docs, docs_frame, prose


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, exact_dedup.exact_duplicates(df).collect()), key=repr)


def test_awkward_rows(spark):
    rows = awkward_docs()
    rows += [(200 + i, prose(5_000, 9) + ("." if i == 1 else "")) for i in range(4)] + [(300, "x" * 49_999), (301, "x" * 50_000)]
    assert found(docs_frame(spark, rows)) == brute(rows)


def test_equal_chunk_hashes_are_told_apart(spark, monkeypatch):
    rows = [(i, f"text number {i % 7}") for i in range(20)]
    rows += [(30, f"text number {i}") for i in range(9)] + [(None, "text number 3"), (None, "text number 8")]
    real = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: real(c) % 2)
    assert found(docs_frame(spark, rows)) == brute(rows)


def test_cuts_follow_the_content_in_every_script(spark):
    """Texts that begin differently have most chunks in common, none is as long as the longest allowed."""
    rng = random.Random(1)
    japanese = ["また明日の会議は、", "資料を確認。", "東京に行く", "大阪", "新しい机", "電話番号です。"]
    spaced = ["слово ", "другое ", "да ", "λόγος ", "كلمة ", "단어 ", "предложение "]
    for words in (japanese, spaced, [*japanese, *spaced, "word ends ", "and "]):
        text = "".join(rng.choice(words) for _ in range(6_000))
        rows = [(1, text), (2, "Ж" * 37 + text), (3, text[101:])]
        texts = docs_frame(spark, rows).select("doc_id", exact_dedup._chunks(exact_dedup.F.col("text")).alias("chunks")).collect()
        chunks = {r["doc_id"]: r["chunks"] for r in texts}
        assert all("".join(chunks[i]) == t for i, t in rows)
        assert max(len(c) for c in chunks[1]) < exact_dedup.MAX_CHUNK
        assert all(len({*chunks[1]} & {*chunks[k]}) >= 0.5 * len({*chunks[1]}) for k in (2, 3))


def test_empty_table_and_rows_that_stay(spark):
    assert found(docs_frame(spark, [])) == []
    rows = awkward_docs()
    df = docs_frame(spark, rows)
    kept = exact_dedup.without_copies(df)
    assert kept.columns == df.columns
    assert {(r["doc_id"], r["text"] or "") for r in kept.collect()} >= {(i, t or "") for i, t in rows if i in (101, 106, 114)} - {(101, "")}


def test_rows_are_known_by_doc_id_and_text(spark):
    rows = [(1, "same"), (2, "same"), (1, "own"), (None, "same"), (None, "alone"), (5, None), (6, "")]
    kept = exact_dedup.without_copies(docs_frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(2, "same"), (1, "own"), (None, "alone"), (6, "")], key=repr)
