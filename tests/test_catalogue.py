"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from maskora.operators import redact as R
from maskora.operators import spans as S
from maskora.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    cursor = duck.execute(catalogue.oracle_sql()[name])
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_flagship_on_planted_rows(spark, tmp_path):
    """Marks that would follow their like are not repeated, and the white space between them stays."""
    card, mail = "4111 1111 1111 1111", "a.b@example.com"
    texts = [f"{card} {card}", f"x {card}\t {card} {card} y", f"{mail} {mail},{mail}", f"{card} {mail} {card}", f"{card}\n{card}", f"{card} and {card}", "4111111111111112", None, "", f"{mail}\n\n {mail} "]
    spark.createDataFrame([(i, t, ("en", "de")[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in catalogue.flagship(spark, str(tmp_path)).select("chars", "lang", "redacted_chars", "spans").collect())
    assert got == sorted(con.execute(f"SELECT chars, lang, redacted_chars, spans FROM ({catalogue.oracle_sql()['flagship']})").fetchall())
    line = spark.createDataFrame([(t,) for t in texts[:2]], "line string")
    spans = R.redact_spans(F.col("line"), F.transform(S.pii_spans(F.col("line"), [r for r in S.FREE if r.category == "credit_card"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("pii").alias("type"), s["label"].alias("label"), s["text"].alias("text"))))
    assert [r[0] for r in line.select(spans).collect()] == ["[カード情報] ", "x [カード情報]\t   y"]


@pytest.mark.parametrize("name", ["person_spans", "company_spans", "pii_all_spans"])
def test_detectors_are_planned_once(spark, name):
    plan = catalogue.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if x.lstrip(" +-:").startswith("Filter")]
    assert len(plan) < 300_000 and not any("regexp_extract_all" in x for x in filters)
