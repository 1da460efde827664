"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = [f"w{i}" for i in range(40)] + ["Über", "naïve", "𠮷田", "THE", "the"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_docs():
    rows = [(i, prose(30 + i % 17, i)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "one two three"), (105, prose(30_000, 5)), (106, "x" * 50_000)]
    rows += [(110 + i, rows[3][1]) for i in range(5)] + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1])]
    return rows


def docs_frame(spark, rows):
    """Documents with extra columns named like those that the operators make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, block long, pos int, key long, kept boolean, score double"
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 1, 1, 1, False, 0.5) for i, t in rows], schema)
