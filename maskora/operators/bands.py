"""Interval joins within a page by bands: rows meet where their vertical ranges share a band, not all with all.

A band is BAND pixels high. A row is dealt to each band that its range covers, so it costs a copy for every BAND pixels
of its height, and a pair is kept in one band only, the first that both cover. What is compared on a page then follows
the rows that stand near each other, however many the page has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 64.0


def banded(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """``rows`` with ``band``, once for each band of the range, and ``first_band``. Rows with a null end are in none."""
    first, last = F.floor(F.least(low, high) / BAND), F.floor(F.greatest(low, high) / BAND)
    return rows.withColumn("first_band", first).withColumn("band", F.explode(F.sequence(first, last))).filter(low.isNotNull() & high.isNotNull())


def share_band(a: str, b: str, once: bool = True) -> Column:
    """The condition of the join of two banded tables by their aliases; with ``once`` a pair that shares several bands meets once."""
    c = F.col
    same = (c(f"{a}.doc_id") == c(f"{b}.doc_id")) & (c(f"{a}.band") == c(f"{b}.band"))
    return same & (c(f"{a}.band") == F.greatest(c(f"{a}.first_band"), c(f"{b}.first_band"))) if once else same
