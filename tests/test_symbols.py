"""Characters with boxes of their own, and the four ways in which a range gets its box."""

import random

import pytest
from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators import symbols as Y

LINE = f"doc_id long, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, words {Y.SYMBOLS}, symbols {Y.SYMBOLS}"


def piece(text, x0, x1, y0=40.0, y1=80.0):
    return (text, (float(x0), y0, float(x1), y1), 90.0)


def aligned(spark, text, words=(), symbols=(), box=(0.0, 40.0, 120.0, 80.0), **options):
    df = spark.createDataFrame([(1, 0, text, *box, 95.0, list(words) if words is not None else None, list(symbols) if symbols is not None else None)], LINE)
    row = Y.aligned_lines(df, **options).first()
    return row["text"], [(e["text"], e["bbox"]["x0"], e["bbox"]["x1"]) for e in row["aligned"]]


def test_characters_beyond_the_plane_keep_their_boxes(spark):
    text, got = aligned(spark, "📩𠮷田", symbols=[piece("📩", 0, 40), piece("𠮷", 40, 80), piece("田", 80, 120)])
    assert text == "📩𠮷田" and got == [("📩", 0, 40), ("𠮷", 40, 80), ("田", 80, 120)]


def test_spaces(spark):
    text, got = aligned(spark, "山 、 田", symbols=[piece("山", 0, 20), piece(" ", 20, 30), piece("、", 30, 40), piece(" ", 40, 50), piece("田", 50, 70)])
    assert text == "山、田" and got[2] == ("田", 50, 70)
    text, got = aligned(spark, "x", symbols=[piece(" ", 0, 5), piece("A", 5, 10), piece("\t", 10, 15), piece("　", 15, 20), piece("b", 20, 25), piece(" ", 25, 30), piece(" ", 30, 35)])
    assert text == "A b " and got == [("A", 5, 10), (" ", 10, 15), ("b", 20, 25), (" ", 25, 30)]
    # what stays after the first pass is removed by the cleaning, without moving the others
    symbols = [piece("山", 0, 20), piece(" ", 20, 30), piece("\v", 30, 40), piece(" ", 40, 50), piece("田", 50, 70)]
    assert aligned(spark, "x", symbols=symbols) == ("山田", [("山", 0, 20), ("田", 50, 70)])
    assert len(aligned(spark, "x", symbols=symbols, clean=False)[0]) == 5


def test_words_shares_and_raw_text(spark):
    assert aligned(spark, "x", symbols=[piece("ＡＢc", 0, 30)]) == ("ABc", [("A", 0, 10), ("B", 10, 20), ("c", 20, 30)])
    assert aligned(spark, "x", words=[piece("ab", 0, 20), piece("", 5, 6), piece("c", 30, 33)]) == ("abc", [("a", 0, 10), ("b", 10, 20), ("c", 30, 33)])
    assert aligned(spark, " 山 田 ab ", None, None) == ("山田 ab", [(c, round(i * 24), round((i + 1) * 24)) for i, c in enumerate("山田 ab")])
    assert aligned(spark, None, None, None) == ("", []) and aligned(spark, "", [], []) == ("", [])


def brute_map(s):
    half = s.translate(str.maketrans(T.WIDE, T.NARROW))
    import regex

    cjk = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
    spaces, out = " \t\n\r　 ", []
    for i, ch in enumerate(half):
        if ch not in spaces:
            out.append(i)
            continue
        j = i
        while j < len(half) and half[j] in spaces:
            j += 1
        if i and half[i - 1] not in spaces and not (cjk.match(half[i - 1]) and j < len(half) and cjk.match(half[j])):
            out.append(i)
    return out


def test_normalised_map_is_linear_and_right(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("山田ァabＡ 　\t 、📩") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", " ", "📩 氏名：𠮷 田 太 郎 Email：ａｂｃ@example.jp", "山 " * 50_000]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string").select("i", T.normalized_map(F.col("s")).alias("m"), T.normalize_recognised(F.col("s")).alias("n")).collect()
    for r in got:
        assert r["m"] == brute_map(lines[r["i"]]) and len(r["m"]) == len(r["n"])


def box_of(spark, text, start, end, aligned=None, symbols=None, words=None, box=(100.0, 100.0, 160.0, 120.0)):
    df = spark.createDataFrame([(text, *box, aligned, symbols, words)], f"text string, x0 double, y0 double, x1 double, y1 double, aligned {Y.SYMBOLS}, symbols {Y.SYMBOLS}, words {Y.SYMBOLS}")
    r = df.select(Y.span_box(F.lit(start), F.lit(end), F.col("text"), {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}, F.col("aligned"), F.col("symbols"), F.col("words")).alias("b")).first()["b"]
    return None if r is None else (r["mode"], r["x"], r["y"], r["w"], r["h"])


def single(text, x0, step=10):
    return [piece(c, x0 + step * i, x0 + step * (i + 1), 100.0, 120.0) for i, c in enumerate(text)]


def test_range_by_own_boxes(spark):
    assert box_of(spark, "山田と山田", 3, 5, single("山田と山田", 100)) == (1, 130, 100, 20, 20)
    assert box_of(spark, "山田", 1, 1, single("山田", 100)) is None and box_of(spark, "山田", 0, 3) is None and box_of(spark, "", 0, 0) is None


def test_range_by_occurrence(spark):
    symbols = [piece("山田", 100, 120, 100.0, 120.0), piece("と", 120, 130, 100.0, 120.0), piece("山田", 130, 150, 100.0, 120.0)]
    assert box_of(spark, "山田と山田", 3, 5, symbols=symbols) == (2, 130, 100, 20, 20)
    assert box_of(spark, "山 田と山田", 0, 3, symbols=symbols) == (2, 100, 100, 20, 20)
    # the nearest of several, the earlier of two as near, and overlapping ones
    assert box_of(spark, "xxababab", 4, 6, symbols=single("ababab", 0)) == (2, 40, 100, 20, 20)
    assert box_of(spark, "xaa", 1, 3, symbols=single("aazaa", 0)) == (2, 0, 100, 20, 20)
    assert box_of(spark, "xaa", 1, 3, symbols=single("zaaa", 0)) == (2, 10, 100, 20, 20)
    # aligned entries that do not fit the text are searched before the recogniser's symbols
    assert box_of(spark, "ab山田", 2, 4, aligned=single("山田", 300), symbols=single("ab山田", 100)) == (2, 300, 100, 20, 20)


def test_range_by_words_and_shares(spark):
    assert box_of(spark, "内容山田連絡", 2, 4, words=[piece("内容山田連絡", 100, 160, 100.0, 120.0)]) == (3, 120, 100, 20, 20)
    assert box_of(spark, "ab cd ab", 6, 8, words=[piece("ab", 0, 20, 100.0, 120.0), piece("cd", 30, 50, 100.0, 120.0), piece("ab", 60, 80, 100.0, 120.0)]) == (3, 60, 100, 20, 20)
    assert box_of(spark, "ab cd", 1, 4, words=[piece("ab", 0, 20), piece("cd", 30, 50)])[0] == 4
    assert box_of(spark, "内容山田連絡", 4, 6, symbols=[piece("山田", 400, 420, 100.0, 120.0)]) == (4, 140, 100, 20, 20)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_occurrence_is_that_of_a_scan(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        shown, text = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        start = rng.randrange(len(text))
        rows.append((k, text, start, rng.randrange(start + 1, len(text) + 1), single(shown, 0, 10) + [piece("zz", 900, 950, 100.0, 120.0)] * (len(shown) == len(text))))
    df = spark.createDataFrame([(k, t, a, b, s) for k, t, a, b, s in rows], f"k int, text string, a int, b int, symbols {Y.SYMBOLS}")
    box = {k: F.lit(v) for k, v in (("x0", 0.0), ("y0", 100.0), ("x1", 100.0), ("y1", 120.0))}
    got = {r["k"]: r["b"] for r in df.select("k", Y.span_box(F.col("a"), F.col("b"), F.col("text"), box, symbols=F.col("symbols")).alias("b")).collect()}
    for k, text, a, b, s in rows:
        shown = "".join(x[0] for x in s)
        at = [i for i in range(len(shown)) if shown.startswith(text[a:b], i)]
        if at:
            best = min(at, key=lambda i: (abs(i - a), i))
            assert (got[k]["mode"], got[k]["x"], got[k]["w"]) == (2, 10 * best, 10 * (b - a))
        else:
            assert got[k]["mode"] == 4
