"""Line tables of the engine, from the tables at hand. ``JP_LINE`` is SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = "CASE c_custkey % 6 WHEN 0 THEN '山田太郎' WHEN 1 THEN '佐藤花子' WHEN 2 THEN '鈴木一郎' WHEN 3 THEN '高橋美咲' WHEN 4 THEN '田中健' ELSE '渡辺直子' END"
_EIGHT = "lpad(CAST(c_custkey * 7919 % 100000000 AS string), 8, '0')"
#: One line of Japanese business text for each customer, of fourteen kinds.
JP_LINE = f"""CASE c_custkey % 14
WHEN 0 THEN concat('氏名: ', {_NAME}, ' TEL: 090-', substr({_EIGHT}, 1, 4), '-', substr({_EIGHT}, 5, 4))
WHEN 1 THEN concat('〒', substr({_EIGHT}, 1, 3), '-', substr({_EIGHT}, 4, 4), ' 東京都千代田区丸の内', CAST(c_custkey % 9 + 1 AS string), '-', CAST(c_custkey % 7 + 1 AS string))
WHEN 2 THEN concat('合計 ', CAST(c_custkey % 900 + 100 AS string), ',000円 (税 ￥', CAST(c_custkey AS string), ')')
WHEN 3 THEN concat('個人番号の控え 1234', substr({_EIGHT}, 1, 4), substr({_EIGHT}, 5, 4), ' 以上')
WHEN 4 THEN concat('株式会社テック', CAST(c_custkey AS string), 'の', {_NAME}, 'です')
WHEN 5 THEN concat('先ほど', {_NAME}, '様から連絡、お疲れ様です')
WHEN 6 THEN concat('Email: user', CAST(c_custkey AS string), '@example.jp Password: pw-', {_EIGHT})
WHEN 7 THEN concat('口座番号: ', substr({_EIGHT}, 1, 7), ' 支店番号: ', substr({_EIGHT}, 1, 3))
WHEN 8 THEN concat('会員番号: m_', CAST(c_custkey AS string), ' 生年月日: 1980年', CAST(c_custkey % 12 + 1 AS string), '月', CAST(c_custkey % 28 + 1 AS string), '日')
WHEN 9 THEN concat('カード番号: 4111 1111 1111 ', substr({_EIGHT}, 1, 4))
WHEN 10 THEN concat('ｔｏｋｅｎ ghp_1234567890ABCDEFGHIJ', {_EIGHT}, ' を確認')
WHEN 11 THEN concat('トヨタ', CAST(c_custkey % 50 AS string), '自動車株式会社 三菱銀行 ', {_NAME}, '部長')
WHEN 12 THEN concat('会 議 の 資 料 : ', {_NAME}, '　　共有')
ELSE concat('東京都の会議は2026年10月 @user_', CAST(c_custkey AS string), ' お知らせ') END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by their key to more tasks than there are cores: a small file is read by few, and little of it can be much work.

    The number is given, so that adaptive execution does not join the parts again by their size.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, line_no, line)``: long texts are cut into lines before anything is detected."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def jp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").selectExpr("c_custkey AS doc_id", "0 AS line_no", f"{JP_LINE} AS line")
