"""Connected components of a link table, by alternating large and small stars.

Each round hangs every node on the smallest neighbour it sees; a hub's links are summed before they move
(minimum per node), and the join that deals out the minimum splits a hub's rows, so no group meets in a task.
Before links are written, each task merges those that it happens to hold, MERGED at a time, so few rounds are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Links that a task merges at once.
MERGED = 1 << 20


def _stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars ``(u, v)`` that join what the links join: each id that is not the least of its component, and the least."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ends, 2)
    least = np.arange(len(ids))
    while (apart := least[x] != least[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(least, np.maximum(least[x], least[y]), np.minimum(least[x], least[y]))
        while (least[least] != least).any():
            least = least[least]
    hung = np.flatnonzero(least != np.arange(len(ids)))
    return ids[hung], ids[least[hung]]


def _merged(batches, most: int):
    held, n = [], 0

    def stars():
        u, v = _stars_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        held.append((b["u"].to_numpy(), b["v"].to_numpy()))
        n += len(b)
        if n >= most:
            yield stars()
            held, n = [], 0
    if held:
        yield stars()


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links ``(u, v)`` with u > v; each node's neighbours are hung on the least of them (and of itself)."""
    seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else links
    least = seen.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("least"))
    hung = seen.join(least, "u")
    if both_ways:
        moved = hung.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:  # the node's own link to the least comes with the link that had it
        own = F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v"))
        moved = hung.select(own.alias("u"), F.col("least").alias("v"))
    return moved.filter("u != v")


def _state(links: DataFrame) -> tuple[int, bool]:
    """How many ids there are, and whether each hangs on one other at most and nothing hangs on an id that hangs."""
    ends = links.select(F.col("u").alias("id"), "v").unionByName(links.select(F.col("v").alias("id"), F.lit(None).cast("long").alias("v")))
    ends = ends.groupBy("id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.when(F.col("v").isNull(), 1)).alias("holds"))
    n, bad = ends.agg(F.count(F.lit(1)), F.count(F.when((F.col("low") != F.col("high")) | (F.col("low").isNotNull() & (F.col("holds") > 0)), 1))).first()
    return n, not bad


def star_links(links: DataFrame) -> DataFrame:
    """The written table ``(u, v)``, in which rows may be repeated: each id of a link ``(a, b)`` that is not the least of
    its component, and the least."""
    most = MERGED
    now = links.filter("a != b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    now = written(now.mapInArrow(lambda it: _merged(it, most), "u long, v long"), "links")
    while not (state := _state(now))[1]:
        tasks = links.sparkSession.sparkContext.defaultParallelism + state[0] // MERGED
        now = written(_star(_star(now, True), False).coalesce(tasks).mapInArrow(lambda it: _merged(it, most), "u long, v long"), "links")
    return now


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in a link ``(a, b)``; the component is the smallest id reachable.

    Repeated links, both directions and links of an id to itself are allowed; an empty table gives none.
    """
    hung = star_links(links).groupBy("u").agg(F.min("v").alias("v"))
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ids.join(hung, ids["id"] == hung["u"], "left").select("id", F.coalesce("v", "id").alias("component"))
