"""Results kept by content: what was worked out for a row with the same content and options is not worked out again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def content_key(columns: list[str], options: str = "") -> Column:
    """sha-256 of some columns as JSON (nulls told from empty values) and of the options that the result depends on."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns), F.lit(options).alias("_options")), {"ignoreNullFields": "false"}), 256)


def _kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def memoised(rows: DataFrame, content: list[str], work: Callable[[DataFrame], DataFrame], path: str, options: str = "") -> DataFrame:
    """``rows`` with the column ``result`` of ``work``, from the table at ``path`` where their content is known.

    ``work`` gets ``(memo_key, *content)``, one row for each content that is not in the table yet (an anti-join on the
    key), and returns ``(memo_key, result)``; its rows are appended before anything is read, so calling this runs a
    job. A key that ``work`` gives no row has a null result and is asked for again. A failed append leaves the table as
    it was; two runs at once may both work a content out, and its rows are then equal and count once.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("memo_key", content_key(content, options))
    schema = work(keyed.select("memo_key", *content).limit(0)).schema
    new = keyed.select("memo_key", *content).join(_kept(spark, path, schema).select("memo_key"), "memo_key", "left_anti").dropDuplicates(["memo_key"])
    work(new).write.mode("append").parquet(path)
    known = _kept(spark, path, schema).dropDuplicates(["memo_key"])
    return keyed.join(known, "memo_key", "left").drop("memo_key")
