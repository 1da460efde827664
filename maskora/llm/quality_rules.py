"""Quality rules: a table of thresholds, compiled into one Spark projection.

``measures`` reads a text once and counts its words, lines, symbols, stop words and repeated passages with
built-in functions; ``RULES`` bounds ratios of those counts; ``failed_rules`` turns the table into one column.
No user function, no shuffle: a row is judged by itself, wherever it lies. All work on a text is linear but
for one sort of its three-word windows, which is made only where a window occurs twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:"
WINDOW = 3
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "this", "at", "from",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "est", "que", "pour", "dans", "qui", "sur", "au", "pas", "par", "avec",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "für", "im", "ist", "dem", "nicht", "ein", "als", "eine",
    "el", "y", "los", "se", "del", "las", "por", "con", "una", "no", "para", "su", "es", "al", "lo",
)


class Rule(NamedTuple):
    """``least`` <= 100 * part / whole <= ``most``, in whole numbers; without ``whole`` the part itself is bounded."""

    name: str
    part: str
    whole: str | None
    least: int | None
    most: int | None


RULES = (
    Rule("words", "n_words", None, LEAST_WORDS, 1_000_000),
    Rule("repetition", "n_repeat_words", "n_words", None, MOST_REPEATED),
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text has twice or more."""
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<string>"))

    def covered(at: Column) -> Column:
        fresh = F.transform(at, lambda p, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1))))
        return F.aggregate(fresh, F.lit(0), lambda n, x: n + x)

    def places(sorted_windows: Column) -> Column:
        like = lambda x, k: F.coalesce(F.get(sorted_windows, k)["w"] == x["w"], F.lit(False))
        twice = F.filter(sorted_windows, lambda x, k: like(x, k - 1) | like(x, k + 1))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def of_windows(w: Column) -> Column:
        by_window = F.sort_array(F.transform(w, lambda x, p: F.struct(x.alias("w"), p.alias("p"))))
        found = _bound(_bound(by_window, places), covered)
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(found)

    return _bound(windows, of_windows)


def measures(text: Column) -> Column:
    """A struct of MEASURES (long) of a text; null is an empty text, which has none of anything."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        stop = F.filter(w, lambda x: F.rtrim(F.lower(x), F.lit(MARKS)).isin(*STOP_WORDS))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(stop).cast("long").alias("n_stop_words"),
        )

    return _bound(words, of_words)


def failed_rules(value, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row breaks, in the table's order; ``value`` gives the column of a measure."""
    broken = []
    for r in rules:
        part, whole = (value(r.part) * 100, value(r.whole)) if r.whole else (value(r.part), F.lit(1))
        low = part < whole * r.least if r.least is not None else F.lit(False)
        high = part > whole * r.most if r.most is not None else F.lit(False)
        broken.append(F.when(low | high, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, *MEASURES, base_failed, kept, failed)`` for each row; ``failed`` names the broken rules, comma-joined.

    ``base_failed`` holds where a text has fewer than 50 words, or where more than half of them lie in repeated
    windows, whatever ``rules`` are; ``kept`` needs that not, and no broken rule. Null and empty texts, and texts of
    white space, have no words and fail. Rows are judged one by one: repeated rows share a verdict, a null doc_id is
    passed on, an empty table gives none, other columns are not read. A very long text is one row of arrays of its
    words and windows, some tens of times its size at most while it is read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    value = lambda name: F.col("m.lines." + name) if name in ("n_lines", "n_dup_lines") else F.col("m." + name)
    base_failed = (value("n_words") < LEAST_WORDS) | (value("n_repeat_words") * 100 > value("n_words") * MOST_REPEATED)
    failed = failed_rules(value, rules)
    return base.select("doc_id", *(value(m).alias(m) for m in MEASURES), base_failed.alias("base_failed"), (~base_failed & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed"))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, with all their columns."""
    m = measures(F.col(text_col))
    value = lambda name: F.col("_m.lines." + name) if name in ("n_lines", "n_dup_lines") else F.col("_m." + name)
    return docs.withColumn("_m", m).filter(F.size(failed_rules(value, rules)) == 0).drop("_m")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _rules_sql() -> str:
    out = []
    for r in RULES:
        part, whole = (f"100 * {r.part}", r.whole) if r.whole else (r.part, "1")
        sides = ([f"{part} < {r.least} * {whole}"] if r.least is not None else []) + ([f"{part} > {r.most} * {whole}"] if r.most is not None else [])
        out.append(f"CASE WHEN {' OR '.join(sides)} THEN '{r.name}' END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
o AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
g AS (SELECT r, p, [{', '.join(f'lead(word, {k}) OVER in_text' for k in range(WINDOW))}] AS win, lead(p, {WINDOW - 1}) OVER in_text AS last FROM o WINDOW in_text AS (PARTITION BY r ORDER BY p)),
n AS (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS times FROM g WHERE last IS NOT NULL),
c AS (SELECT r, count(DISTINCT p + i) AS n_repeat_words FROM n, (SELECT unnest(range({WINDOW})) AS i) k WHERE times > 1 GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS bigint) AS n_words, CAST(length(array_to_string(words, '')) AS bigint) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS bigint) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(lines) AS bigint) AS n_lines,
 CAST(len(list_filter(words, lambda x: list_contains({list(STOP_WORDS)!r}, rtrim(lower(x), '{MARKS}')))) AS bigint) AS n_stop_words FROM w LEFT JOIN c ON c.r = w.r),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {_rules_sql()} AS broken FROM m)
SELECT doc_id, {', '.join(MEASURES)}, base_failed, NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS failed FROM f
"""
