"""Results of analyses over time: boxes of a new analysis beside what the user has made, and what is left of a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reanalysed(current: DataFrame, found: DataFrame) -> DataFrame:
    """The boxes of each page after a new analysis: those it ``found``, then the manual ones of ``current``, by ``(doc_id, box_id)``.

    Automatic boxes of the earlier analysis go, also those that were edited; manual boxes stay as they are, also where
    the analysis found the same id. Found boxes keep their ``seq``; manual ones follow in their own order, so the same
    analysis applied twice gives the same boxes. Both tables have the same columns; pages that only one side knows are
    pages too. Of a box that comes twice on one side the first by ``seq`` counts.
    """
    key = ["doc_id", "box_id"]
    columns = [c for c in current.columns if c not in key]
    once = Window.partitionBy(*key).orderBy("seq")
    first = lambda df: df.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    manual = first(current.filter(F.coalesce("is_manual", F.lit(False)) | (F.col("type") == "manual")))
    a = first(found).select(*key, F.struct(*columns).alias("found"))
    b = manual.select(*key, F.struct(*columns).alias("manual"))
    last = found.groupBy("doc_id").agg(F.max("seq").alias("last"))
    merged = a.join(b, key, "full").join(last, "doc_id", "left")
    place = F.row_number().over(Window.partitionBy("doc_id", F.col("manual").isNull()).orderBy("manual.seq", "box_id"))
    box = F.coalesce("manual", "found")
    kind = dict(current.dtypes)["seq"]
    seq = F.when(F.col("manual").isNull(), F.col("found.seq")).otherwise(F.coalesce("last", F.lit(0)) + place).cast(kind)
    out = merged.select(*key, box.alias("box"), seq.alias("seq"))
    return out.select(*(F.col(c) if c in (*key, "seq") else F.col(f"box.{c}").alias(c) for c in current.columns))


def pruned_selection(selection: DataFrame, boxes: DataFrame) -> DataFrame:
    """``selection(doc_id, box_id, pos, anchor)`` without boxes that are gone; a lost anchor moves to the last that is left."""
    left = selection.join(boxes.select("doc_id", "box_id").distinct(), ["doc_id", "box_id"], "left_semi")
    facts = left.groupBy("doc_id").agg(F.max("pos").alias("_last"), F.bool_or("anchor").alias("_kept"))
    anchor = F.when(F.col("_kept"), F.col("anchor")).otherwise(F.col("pos") == F.col("_last"))
    return left.join(facts, "doc_id").select("doc_id", "box_id", "pos", anchor.alias("anchor"))
