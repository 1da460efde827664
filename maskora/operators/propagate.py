"""Custom keywords, and names that a document confirms, found again in all its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators.names import HONORIFICS


def _occurrences(text: Column, word: Column) -> Column:
    """Starts of a literal's occurrences, left to right without overlap."""
    parts = F.split(text, F.concat(F.lit("\\Q"), word, F.lit("\\E")), -1)
    return F.aggregate(
        F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["pos"] + F.length(p) + F.length(word)).alias("pos"), F.concat(acc["out"], F.array(acc["pos"] + F.length(p))).alias("out")), lambda acc: acc["out"],
    )


def keyword_hits(lines: DataFrame, keywords: list[str]) -> DataFrame:
    """``(doc_id, line_no, keyword, start, end)`` of each folded keyword in the folded line, in the line's own places."""
    words = sorted({w.strip() for w in keywords if w and w.strip()})
    if not words:
        return lines.select("doc_id", "line_no", F.lit("").alias("keyword"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    line = F.coalesce("line", F.lit(""))
    rows = lines.select("doc_id", "line_no", line.alias("line")).withColumns({"folded": T.keyword_fold(F.col("line"))})
    rows = rows.select("*", F.explode(F.array(*map(F.lit, words))).alias("keyword")).withColumn("word", T.keyword_fold(F.col("keyword")))
    rows = rows.filter((F.length("word") > 0) & F.contains("folded", "word")).withColumn("map", T.normalized_map(F.col("line")))
    hits = rows.select("doc_id", "line_no", "keyword", "map", F.length("word").alias("n"), F.explode(_occurrences(F.col("folded"), F.col("word"))).alias("at"))
    found = T.original_range(F.col("map"), F.col("at"), F.col("at") + F.col("n"))
    return hits.select("doc_id", "line_no", "keyword", found["start"].alias("start"), found["end"].alias("end"))


def searchable(lines: DataFrame) -> DataFrame:
    """Lines with ``search`` (folded, no white space) and ``places``, the original place of each of its characters."""
    line = F.coalesce("line", F.lit(""))
    rows = lines.select("doc_id", "line_no", line.alias("line"))
    return rows.select("*", T.search_fold(F.col("line")).alias("search"), _places(F.col("line")).alias("places"))


def _places(line: Column) -> Column:
    chars = F.regexp_extract_all(T.normalize_recognised(line), F.lit("(?s)."), F.lit(0))
    return T.bound(T.normalized_map(line), lambda m: F.filter(F.transform(chars, lambda ch, i: F.when(~ch.rlike(f"[{T.WS}]"), F.get(m, i))), lambda at: at.isNotNull()))


def confirmed_names(persons: DataFrame, companies: DataFrame) -> DataFrame:
    """``(doc_id, kind, entity)``: each detected text, for persons also without its honorific, folded; two characters or more, not digits alone."""
    titles = "|".join(f"\\Q{h}\\E" for h in sorted(HONORIFICS, key=len, reverse=True))
    p = persons.select("doc_id", F.lit("person").alias("kind"), F.explode(F.array(F.col("text"), F.regexp_replace("text", f"(?:{titles})\\z", ""))).alias("text"))
    c = companies.select("doc_id", F.lit("company").alias("kind"), "text")
    names = p.unionByName(c).select("doc_id", "kind", T.search_fold(F.col("text")).alias("entity"))
    return names.filter((F.length("entity") >= 2) & ~F.col("entity").rlike(r"^[0-9]+\z")).distinct()


def propagate(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``(doc_id, line_no, kind, entity, start, end, text)``: exact occurrences of a document's names in its lines.

    The join is on ``doc_id``; a name counts only where the characters beside it do not belong to a longer one.
    """
    line = F.coalesce("line", F.lit(""))
    rows = lines.select("doc_id", "line_no", line.alias("line"), T.search_fold(line).alias("search")).join(names, "doc_id").filter(F.contains("search", "entity"))
    rows = rows.withColumn("places", _places(F.col("line")))  # only where a name is
    hits = rows.select("*", F.explode(_occurrences(F.col("search"), F.col("entity"))).alias("at"))
    start = F.element_at("places", F.col("at") + 1)
    end = F.element_at("places", F.col("at") + F.length("entity")) + 1
    hits = hits.withColumns({"start": start, "end": end})
    before, after = F.when(F.col("start") > 0, F.substring(F.col("line"), F.col("start"), F.lit(1))).otherwise(""), F.substring(F.col("line"), F.col("end") + 1, F.lit(1))
    name, latin = rf"[{T.HAN}{T.KATA}A-Za-z0-9_]", "[A-Za-z0-9_]"
    person = before.rlike(name) | after.rlike(name)
    company = (F.col("entity").rlike("(?i)^[a-z0-9]") & before.rlike(latin)) | (F.col("entity").rlike(r"(?i)[a-z0-9]\z") & after.rlike(latin))
    clear = hits.filter(~F.when(F.col("kind") == "person", person).otherwise(company))
    return clear.select("doc_id", "line_no", "kind", "entity", "start", "end", F.substring(F.col("line"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
