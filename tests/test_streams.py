"""Stateful streams against their batch twins, with late events, permuted files and controlled clocks."""

import json
import random
import time
from datetime import UTC, datetime, timedelta

import pytest

from maskora.streaming import analyses, edits, watch

SCHEMA = "doc_id long, seq long, ts timestamp, op string, payload string"
BEGIN = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


def edit_events(rng, docs, n):
    rows = []
    for d in docs:
        for k in range(n):
            op = rng.choice(["add", "add", "update", "toggle", "remove", "undo", "redo", "select"])
            rows.append((d, k, at(20 * k + d), op, json.dumps({"id": f"b{rng.randrange(4)}", "rect": [0, 0, 5 + k, 9], "patch": {"label": str(k)}})))
    return rows


def flight_events(rng, docs, n):
    return [(d, k, at(20 * k + d), "open" if k == 0 else rng.choice(["start", "start", "finish", "fail", "open"]), json.dumps({"reuse": rng.random() < 0.5})) for d in docs for k in range(n)]


def job_events(rng, docs, n):
    rows = []
    for d in docs:
        t = d
        for k in range(n):
            t += rng.choice([5, 20, 30, 50, 70, 130])
            rows.append((d, k, at(t), rng.choice(["start", "progress", "progress", "progress", "done", "error"]), json.dumps({"value": rng.random()})))
    return rows


MACHINES = {"edits": (edits, edit_events), "analyses": (analyses, flight_events), "watch": (watch, job_events)}


@pytest.mark.parametrize("name,seed,files", [("edits", 1, 5), ("edits", 2, 2), ("analyses", 3, 5), ("analyses", 4, 3), ("watch", 5, 4), ("watch", 6, 1)])
def test_any_split_and_order_gives_the_replay(spark, tmp_path, name, seed, files):
    """Events are shuffled within the delay, dealt to files, and read a file at a time; a late mark for another key releases the last."""
    machine, make = MACHINES[name]
    rng = random.Random(seed)
    rows = make(rng, [1, 2, 7], 12)
    jittered = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, 290)))
    cuts = sorted(rng.sample(range(1, len(rows)), files - 1))
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(jittered[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(99, 0, at(99_999), "none", None)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = machine.follow(stream, "5 minutes").writeStream.outputMode("append").format("memory").queryName(f"s{seed}").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    query.awaitTermination(240)
    got = {}
    for r in spark.table(f"s{seed}").collect():
        if r["doc_id"] not in got or r["seq"] >= got[r["doc_id"]]["seq"]:
            got[r["doc_id"]] = r
    want = {r["doc_id"]: r for r in machine.replay(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v for k, v in got.items() if k != 99} == want


def flight(*ops):
    f = analyses.Flight()
    for op in ops:
        f.apply(*op) if isinstance(op, tuple) else f.apply(op, {})
    return f


REUSE = ("start", {"reuse": True})


def test_latest_request_wins():
    assert flight("start", "finish").runs == 0
    f = flight("open", "start", "finish")
    assert (f.runs, f.published, f.last_published, f.running) == (1, 1, 2, None)
    f = flight("open", "start", REUSE, REUSE)
    assert (f.runs, f.waiting, f.revision) == (1, "reuse", 4)
    f = flight("open", "start", REUSE, "start", REUSE)
    assert f.waiting == "full"
    f.apply("finish", {})
    assert (f.superseded, f.published, f.runs, f.running, f.waiting, f.revision) == (1, 0, 2, [6, 1], None, 6)
    f.apply("finish", {})
    assert (f.published, f.last_published) == (1, 6)
    f = flight("open", "start", "start", "open", "finish")
    assert (f.discarded, f.runs, f.running) == (1, 1, None)
    f = flight("open", "start", "fail", "finish")
    assert (f.failed, f.published, f.superseded) == (1, 0, 0)


def watched(*events):
    w = watch.Watch()
    for t, op, *value in events:
        w.apply(op, {"value": value[0]} if value else {}, t * 1000)
    return w


def test_timers():
    w = watched((0, "start"), (24, "none"))
    assert (w.notices, w.attempt, w.outcome) == (0, 1, "running")
    assert watched((0, "start"), (25, "none")).notices == 1
    w = watched((0, "start"), (44, "progress", 0.5), (59, "none"))
    assert (w.stalls, w.caps, w.attempt) == (0, 0, 1)
    w = watched((0, "start"), (44, "progress", 0.5), (60, "none"))
    assert (w.stalls, w.caps, w.attempt, w.begun) == (0, 1, 2, 60_000)
    w = watched((0, "start"), (30, "progress", 0.5), (35, "progress", 0.5), (36, "progress", 0.2), (37, "progress", 1.5), (38, "progress", float("nan")), (80, "none"))
    assert w.caps == 1 and w.attempt == 2  # the limit of 60 s comes before a stall at 75 s
    w = watched((0, "start"), (10, "progress", 0.5), (20, "progress", 0.5), (55, "none"))
    assert (w.stalls, w.begun) == (1, 55_000)
    w = watched((0, "start"), (500, "none"))
    assert (w.stalls, w.timeouts, w.outcome, w.notices, w.attempt) == (2, 1, "timeout", 2, 2)
    assert watched((0, "start"), (500, "progress", 0.1), (501, "done")).results == 0
    w = watched((0, "start"), (10, "error"), (12, "done"))
    assert (w.attempt, w.results, w.outcome) == (2, 1, "done")
    assert watched((0, "start"), (10, "error"), (12, "error")).outcome == "failed"
    w = watched((0, "start"), (10, "error"), (12, "error"), (20, "start"), (21, "done"))
    assert (w.jobs, w.results, w.attempt) == (2, 1, 1)


def test_alarms_fire_without_events(spark, tmp_path):
    """A clock that runs a thousand times as fast: a job that is started and left alone ends by its timers."""
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, at(0), "start", None), (2, 0, at(0), "start", None), (2, 1, at(1), "done", None)], SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = watch.alarms(stream, clock=lambda ms: ms * 1000).writeStream.outputMode("update").format("memory").queryName("alarms").trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        rows, begin = [], time.time()
        while not rows and time.time() - begin < 60:
            query.awaitTermination(1)
            rows = spark.table("alarms").filter("outcome = 'timeout'").collect()
    finally:
        query.stop()
    assert [(r["doc_id"], r["stalls"], r["timeouts"], r["notices"]) for r in rows] == [(1, 2, 1, 2)]
    assert spark.table("alarms").filter("doc_id = 2").orderBy("seq").collect()[-1]["outcome"] == "done"
