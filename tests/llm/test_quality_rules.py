import re
from collections import Counter

import duckdb
import pytest

from maskora.llm import quality_rules as Q
from tests.llm.fixtures import awkward_docs, docs_frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_dup = len(lines) - len(set(lines))
    stop = sum(w.lower().rstrip(".,;:") in Q.STOP_WORDS for w in words)
    n = len(words)
    base_failed = n < 50 or 100 * len(covered) > 50 * n
    values = dict(zip(Q.MEASURES, (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), n_dup, len(covered), len(lines), stop), strict=True))
    broken = []
    for r in Q.RULES:
        part, whole = (100 * values[r.part], values[r.whole]) if r.whole else (values[r.part], 1)
        if (r.least is not None and part < r.least * whole) or (r.most is not None and part > r.most * whole):
            broken.append(r.name)
    return (*values.values(), base_failed, not base_failed and not broken, ",".join(broken))


def cases():
    rows = awkward_docs()
    rows += [
        (200, "a a a a"), (201, "a b c a b c"), (202, "a b c b a b c b a"), (203, "a b\na b\n \na b"), (204, "x y # * & z <|>"), (205, "a\rb\x0bc\x0cd\te"),
        (206, "the of and " * 40), (207, "\n\n\n"), (208, "𠮷 𠮷 𠮷 𠮷 𠮷"), (209, "The, OF. und; " + prose(200, 77)), (210, " ".join(f"the w{i} of v{i}" for i in range(60))), (211, "| a | b |\n" * 30),
    ]
    return rows


def found(df):
    return sorted(map(tuple, Q.judged(df).collect()), key=repr)


def test_measures_and_verdicts(spark):
    rows = cases()
    expected = sorted([(i, *brute(t)) for i, t in rows], key=repr)
    assert found(docs_frame(spark, rows)) == expected
    assert any(r[9] for r in expected)


def test_against_sql(spark):
    rows = cases()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert found(docs_frame(spark, rows)) == sorted(con.execute(Q.SQL).fetchall(), key=repr)


def test_empty_table_and_rows_that_stay(spark):
    assert found(docs_frame(spark, [])) == []
    df = docs_frame(spark, cases())
    kept = Q.accepted(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(i) for i, t in cases() if brute(t)[-2])


@pytest.mark.parametrize("rule,broken", [(Q.Rule("r", "n_words", None, 2, None), {1}), (Q.Rule("r", "n_words", None, None, 1), {2, 3}), (Q.Rule("r", "n_symbols", "n_words", None, 50), {3}), (Q.Rule("r", "n_stop_words", "n_words", 50, None), {1, 3})])
def test_rule_table(spark, rule, broken):
    df = docs_frame(spark, [(1, "one"), (2, "the one"), (3, "# &")])
    assert {r[0] for r in Q.judged(df, (rule,)).filter("failed != ''").collect()} == broken


def test_one_projection_without_user_functions(spark):
    plan = Q.judged(docs_frame(spark, cases()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_long_text_of_copies(spark):
    text = "same words here " * 60_000
    got = Q.judged(docs_frame(spark, [(1, text)])).first()
    assert (got["n_words"], got["n_repeat_words"], got["kept"]) == (180_000, 180_000, False)
