"""Registered queries of the keyed state machines, over the event table; their SQL is a recursive fold of one event after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskora.streaming import analyses, watch

_FLIGHT_OPS = "CASE WHEN event_id * 7 % 10 < 2 THEN 'open' WHEN event_id * 7 % 10 < 6 THEN 'start' WHEN event_id * 7 % 10 < 9 THEN 'finish' ELSE 'fail' END"
_WATCH_OPS = "CASE WHEN event_id * 7 % 10 < 2 THEN 'start' WHEN event_id * 7 % 10 < 8 THEN 'progress' WHEN event_id * 7 % 10 < 9 THEN 'done' ELSE 'error' END"


def flight_events(events: DataFrame) -> DataFrame:
    """Requests for analyses: users are pages."""
    return events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "ts", F.expr(_FLIGHT_OPS).alias("op"), F.to_json(F.struct((F.col("event_id") % 3 > 0).alias("reuse"))).alias("payload"))


def job_events(events: DataFrame) -> DataFrame:
    """Progress of jobs: users are jobs, and a second is a millisecond of the event table, so that some jobs are in time."""
    at = F.timestamp_millis(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000))
    value = (F.col("event_id") * 13 % 40).cast("double") / 32
    return events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), at.alias("ts"), F.expr(_WATCH_OPS).alias("op"), F.to_json(F.struct(value.alias("value"))).alias("payload"))


_FLIGHT_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS doc_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {_FLIGHT_OPS} AS op, event_id % 3 > 0 AS reuse FROM events),
s AS (SELECT DISTINCT doc_id, CAST(-1 AS bigint) AS seq, CAST(0 AS bigint) AS n, CAST(0 AS bigint) AS image, CAST(0 AS bigint) AS revision, CAST(NULL AS bigint) AS running, CAST(NULL AS bigint) AS of_image, CAST(NULL AS varchar) AS waiting,
 CAST(0 AS bigint) AS runs, CAST(0 AS bigint) AS published, CAST(0 AS bigint) AS superseded, CAST(0 AS bigint) AS discarded, CAST(0 AS bigint) AS failed, CAST(NULL AS bigint) AS last_published FROM e
 UNION ALL SELECT doc_id, seq, n, image + CASE WHEN op = 'open' THEN 1 ELSE 0 END,
  revision + CASE WHEN op = 'open' OR asks OR goes_on THEN 1 ELSE 0 END,
  CASE WHEN (asks AND running IS NULL) OR goes_on THEN revision + 1 WHEN ends THEN NULL ELSE running END,
  CASE WHEN (asks AND running IS NULL) OR goes_on THEN image WHEN ends THEN NULL ELSE of_image END,
  CASE WHEN op = 'open' OR goes_on THEN NULL WHEN asks AND running IS NOT NULL THEN CASE WHEN reuse AND waiting IS DISTINCT FROM 'full' THEN 'reuse' ELSE 'full' END ELSE waiting END,
  runs + CASE WHEN (asks AND running IS NULL) OR goes_on THEN 1 ELSE 0 END,
  published + CASE WHEN good AND running = revision THEN 1 ELSE 0 END, superseded + CASE WHEN good AND running != revision THEN 1 ELSE 0 END,
  discarded + CASE WHEN ends AND op = 'finish' AND NOT good THEN 1 ELSE 0 END, failed + CASE WHEN ends AND op = 'fail' THEN 1 ELSE 0 END, CASE WHEN good AND running = revision THEN revision ELSE last_published END
 FROM (SELECT s.* REPLACE (e.seq AS seq, e.n AS n), op, reuse, op = 'start' AND image > 0 AS asks, op IN ('finish', 'fail') AND running IS NOT NULL AS ends, op IN ('finish', 'fail') AND running IS NOT NULL AND waiting IS NOT NULL AS goes_on,
  coalesce(op = 'finish' AND of_image = image, false) AS good FROM s JOIN e ON e.doc_id = s.doc_id AND e.n = s.n + 1) z)
SELECT doc_id, seq, image, revision, running, waiting, runs, published, superseded, discarded, failed, last_published FROM s QUALIFY n = max(n) OVER (PARTITION BY doc_id)
"""

_N, _S, _C = watch.NOTICE_MS, watch.STALL_MS, watch.CAP_MS
# An attempt of which nothing more is heard ends at ``due``; a second one that begins there can only stall.
_WATCH_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS doc_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, epoch_ms(ts) // 1000 AS t, {_WATCH_OPS} AS op, event_id * 13 % 40 / 32 AS value FROM events),
s AS (SELECT DISTINCT doc_id, CAST(-1 AS bigint) AS seq, CAST(0 AS bigint) AS n, CAST(NULL AS varchar) AS outcome, CAST(0 AS bigint) AS attempt, CAST(0 AS bigint) AS begun, CAST(0 AS bigint) AS moved, CAST(0 AS double) AS highest, false AS noticed,
 CAST(0 AS bigint) AS jobs, CAST(0 AS bigint) AS notices, CAST(0 AS bigint) AS stalls, CAST(0 AS bigint) AS caps, CAST(0 AS bigint) AS timeouts, CAST(0 AS bigint) AS results FROM e
 UNION ALL SELECT doc_id, seq, n, CASE WHEN op = 'start' OR again THEN 'running' WHEN running AND op = 'done' THEN 'done' WHEN running AND op = 'error' THEN 'failed' ELSE outcome END,
  CASE WHEN op = 'start' THEN 1 WHEN again THEN attempt + 1 ELSE attempt END, CASE WHEN op = 'start' OR again THEN t ELSE begun END, CASE WHEN op = 'start' OR again OR moves THEN t ELSE moved END,
  CASE WHEN op = 'start' OR again THEN 0 WHEN moves THEN value ELSE highest END, noticed AND op != 'start' AND NOT again, jobs + CASE WHEN op = 'start' THEN 1 ELSE 0 END, notices, stalls, caps, timeouts, results + CASE WHEN running AND op = 'done' THEN 1 ELSE 0 END
 FROM (SELECT *, outcome IS NOT DISTINCT FROM 'running' AS running, outcome IS NOT DISTINCT FROM 'running' AND op = 'error' AND attempt < {watch.ATTEMPTS} AS again, outcome IS NOT DISTINCT FROM 'running' AND op = 'progress' AND value > highest AND value <= 1 AS moves FROM (
  SELECT doc_id, seq, n, t, op, value, jobs, results, CASE WHEN lost OR spent THEN 'timeout' ELSE outcome END AS outcome, CASE WHEN ends AND attempt < {watch.ATTEMPTS} THEN attempt + 1 ELSE attempt END AS attempt,
   CASE WHEN ends AND attempt < {watch.ATTEMPTS} THEN due ELSE begun END AS begun, CASE WHEN ends AND attempt < {watch.ATTEMPTS} THEN due ELSE moved END AS moved, CASE WHEN ends AND attempt < {watch.ATTEMPTS} THEN 0 ELSE highest END AS highest,
   CASE WHEN ends AND attempt < {watch.ATTEMPTS} THEN t >= due + {_N} ELSE noticed OR (live AND t >= begun + {_N}) END AS noticed,
   notices + CASE WHEN live AND NOT noticed AND t >= begun + {_N} THEN 1 ELSE 0 END + CASE WHEN ends AND attempt < {watch.ATTEMPTS} AND t >= due + {_N} THEN 1 ELSE 0 END AS notices,
   stalls + CASE WHEN ends AND moved + {_S} <= begun + {_C} THEN 1 ELSE 0 END + CASE WHEN spent THEN 1 ELSE 0 END AS stalls, caps + CASE WHEN ends AND moved + {_S} > begun + {_C} THEN 1 ELSE 0 END AS caps, timeouts + CASE WHEN lost OR spent THEN 1 ELSE 0 END AS timeouts
  FROM (SELECT *, live AND t >= due AS ends, live AND t >= due AND attempt >= {watch.ATTEMPTS} AS lost, live AND attempt < {watch.ATTEMPTS} AND t >= due + {_S} AS spent FROM (
   SELECT s.* REPLACE (e.seq AS seq, e.n AS n), t, op, value, outcome IS NOT DISTINCT FROM 'running' AS live, least(moved + {_S}, begun + {_C}) AS due FROM s JOIN e ON e.doc_id = s.doc_id AND e.n = s.n + 1) a) b) c) d)
SELECT doc_id, seq, outcome, attempt, jobs, notices, stalls, caps, timeouts, results FROM s QUALIFY n = max(n) OVER (PARTITION BY doc_id)
"""


def registered(events: Callable) -> dict[str, tuple[Callable, str | None]]:
    return {
        "analysis_flights": (lambda s, d: analyses.replay(flight_events(events(s, d))), _FLIGHT_SQL),
        "watched_jobs": (lambda s, d: watch.replay(job_events(events(s, d))), _WATCH_SQL),
    }
