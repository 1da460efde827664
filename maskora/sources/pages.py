"""Sources and sinks around the engine: recogniser output, image files, key/blob stores, fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskora.functions import text as T

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
GLYPH = f"struct<text:string,bbox:{BOX},confidence:double>"
#: A recogniser's result: blocks of paragraphs of lines of words of symbols.
RECOGNITION = f"doc_id long, text string, blocks array<struct<paragraphs:array<struct<lines:array<struct<text:string,bbox:{BOX},confidence:double,words:array<struct<text:string,bbox:{BOX},confidence:double,symbols:array<{GLYPH}>>>>>>>>>"
IMAGE = r"(?i)\.(?:png|jpe?g|webp|bmp|gif|tiff?)$"


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, modificationTime, length, content)`` of the image files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.col("path").rlike(IMAGE))


def watch_image_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream over a landing folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{png,jpg,jpeg,webp,bmp,gif,tif,tiff}").load(folder)


def flatten_recognition(results: DataFrame) -> DataFrame:
    """``(doc_id, line_no, text, x0, y0, x1, y1, confidence, words, symbols)``: non-blank lines in reading order."""
    lines = F.flatten(F.transform(F.flatten(F.transform("blocks", lambda b: b["paragraphs"])), lambda p: p["lines"]))
    kept = F.filter(lines, lambda x: F.length(T.trim_all(F.coalesce(x["text"], F.lit("")))) > 0)
    rows = results.select("doc_id", F.posexplode(kept).alias("line_no", "line"))
    words = F.transform("line.words", lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox"), w["confidence"].alias("confidence")))
    symbols = F.flatten(F.transform("line.words", lambda w: F.coalesce(w["symbols"], F.array().cast(f"array<{GLYPH}>"))))
    return rows.select("doc_id", "line_no", T.trim_all(F.col("line.text")).alias("text"), "line.bbox.*", F.coalesce("line.confidence", F.lit(0.0)).alias("confidence"), words.alias("words"), symbols.alias("symbols"))


def full_text(results: DataFrame) -> DataFrame:
    """The recogniser's own text, or the lines joined."""
    lines = flatten_recognition(results).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("joined"))
    return results.select("doc_id", "text").join(lines, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("text") != "", F.col("text")), "joined", F.lit("")).alias("full_text"))


_KEY = r"([^/]*)\.traineddata$"


def cache_stats(blobs: DataFrame, needed: tuple[str, ...] = ("eng", "jpn")) -> DataFrame:
    """One row for a store ``(key, value)``: items, bytes, languages, and whether all needed ones are there."""
    models = blobs.filter(F.col("key").rlike(_KEY)).select(F.regexp_extract("key", _KEY, 1).alias("language"), F.coalesce(F.octet_length("value"), F.lit(0)).alias("bytes"))
    found = models.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.array_sort(F.collect_set("language")).alias("languages"))
    return found.withColumn("is_cached", F.size(F.array_except(F.array(*map(F.lit, needed)), F.col("languages"))) == 0)


def without_models(blobs: DataFrame) -> DataFrame:
    """What a cleared store keeps: all other keys."""
    return blobs.filter(~F.coalesce(F.col("key").rlike(_KEY), F.lit(False)))


def review_flag(enabled: Column, confidence: Column) -> Column:
    return F.coalesce(enabled & (confidence < 0.45), F.lit(False))


def write_masked(images: DataFrame, path: str) -> None:
    """Masked planes ``(doc_id, width, height, channels, pixels)`` as Parquet."""
    images.write.mode("overwrite").parquet(path)


def write_redacted(texts: DataFrame, path: str) -> None:
    """Redacted texts ``(doc_id, redacted_text)`` as Parquet."""
    texts.write.mode("overwrite").parquet(path)
