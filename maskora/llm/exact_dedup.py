"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own characters say so, each chunk gets a verified identifier, and two texts are
equal when their ordered identifier lists are. Only distinct chunks move for verification; the lists that
are compared afterwards hold eight bytes for a chunk, so long documents are not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Shortest and longest chunk in characters. A cut falls between them, at the first place that the characters
#: around it choose; without such a place, at the longest.
MIN_CHUNK, MAX_CHUNK = 256, 4096


def _chosen() -> str:
    """About a quarter of the characters of each other script: 8 of 32 neighbours, and 64 of 256 in the large blocks."""
    small = [c for low, high in ((0x370, 0xE80), (0x3040, 0x3100)) for c in range(low, high, 8) if c >> 3 & 3 == 0]
    large = [c for c in range(0x3400, 0xD7C0, 64) if c >> 6 & 3 == 0]
    return "[" + "".join([f"\\u{c:04X}-\\u{c + 7:04X}" for c in small] + [f"\\u{c:04X}-\\u{c + 63:04X}" for c in large]) + "]"


_OTHER = r"(?=[^\x00-\u024F])"
#: In Latin script after a word that ends in one of some letters, before one that starts with one of some. In others
#: before a chosen character: after a chosen one and a space, or after a wide mark or one of some frequent characters
#: of scripts without spaces. Places are some tens of characters apart: where every word was one, chunks of texts that
#: begin differently would meet again late, as each starts its own count of MIN_CHUNK.
PLACES = (r"(?<=[dnrst][\s.,])(?=[a-eA-E])", rf"{_OTHER}(?:(?<={_chosen()}\s)|(?<=[\u3000-\u3002\uFF01-\uFF0F\uFF1A-\uFF1Fは的ะ]))(?={_chosen()})")
CUT = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:{'|'.join(PLACES)})|(?s).{{1,{MAX_CHUNK}}}"


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_sha256, keys, fixes)``: the recipe of each row.

    A row is known by doc_id and digest where one doc_id has several texts.

    ``keys`` are the 64-bit hashes of the chunks in order. Hashes that stand for more than one chunk in this
    corpus are told apart by ``fixes``, a list of ``(pos, ordinal)``, so equal recipes mean equal texts.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    occurrences = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(_chunks(F.col("text"))).alias("pos", "chunk"))
    occurrences = occurrences.withColumn("key", F.xxhash64("chunk"))
    distinct = occurrences.select("key", "chunk").distinct()
    shared_keys = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("key")
    ambiguous = written(occurrences.join(shared_keys, "key", "left_semi").select("key", "chunk").distinct(), "ambiguous-chunks")
    numbered = ambiguous.withColumn("ordinal", F.row_number().over(Window.partitionBy("key").orderBy("chunk")) - 1)
    fixes = (
        occurrences.join(numbered.filter("ordinal > 0"), ["key", "chunk"])
        .groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_sha256").alias("_sha256"))
        .agg(F.sort_array(F.collect_set(F.struct("pos", "ordinal"))).alias("fixes"))
    )
    recipes = base.select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        F.transform(_chunks(F.col("text")), lambda c: F.xxhash64(c)).alias("keys"),
    )
    if ambiguous.isEmpty():
        return recipes.withColumn("fixes", F.array().cast("array<struct<pos:int,ordinal:int>>"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_sha256") == F.col("_sha256"))
    return recipes.join(fixes, same, "left").select(
        "doc_id", "text_sha256", "keys", F.coalesce("fixes", F.array().cast("array<struct<pos:int,ordinal:int>>")).alias("fixes")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each input row.

    Null texts count as empty, and all empty texts form one group. Of equal texts the largest doc_id stays;
    a null doc_id stays only where its whole group has none. doc_id is a row's identity: rows repeated with
    the same doc_id and text each count in ``group_size`` and share one verdict. Other columns are not read.
    A very long text is cut like any other, into a list of chunks in its row. An empty table gives an empty result.
    """
    recipes = written(chunk_recipes(docs, id_col, text_col), "recipes")
    groups = (
        recipes.groupBy("keys", "fixes")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    return recipes.join(groups, ["keys", "fixes"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no row with a larger doc_id has, with all their columns.

    A row is known by its doc_id and text: where one doc_id has several texts, each is judged by its own group, and
    rows repeated with both all stay. Nulls and empty texts are as in ``exact_duplicates``.
    """
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).distinct()
    same = docs[id_col].eqNullSafe(kept["_kept_id"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == kept["_kept_text"])
    return docs.join(kept, same, "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
