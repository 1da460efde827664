"""Keyed state machines over events that may come late: the same fold over a table and over a stream.

Events are ``(doc_id, seq, ts, op, payload)`` with ``seq`` rising with ``ts`` in a key. A machine has ``apply(op, payload,
at_ms)``, ``row(doc_id, seq)`` and the state in ``__dict__``. Over a table a key's events are sorted and the state goes
from row to row. Over a stream events wait in the key's state until the watermark has passed them, and are then taken
in order of ``seq``; so neither the order in which they come nor how they fall into micro-batches changes the result.
Events later than the watermark allows are dropped, as Spark does for every stateful operator.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def _payload(text) -> dict:
    return json.loads(text) if text else {}


def replayed(events: DataFrame, machine: Callable, ddl: str, schema: pa.Schema) -> DataFrame:
    """The row of each key after all its events (``ts`` may be missing where the machine has no clock). A task holds a batch of events and one state, however long a log is."""
    columns = ["doc_id", "seq", "at", "op", "payload"]
    at = F.unix_millis(F.col("ts").cast("timestamp")) if "ts" in events.columns else F.lit(0)
    logs = events.select("doc_id", "seq", at.alias("at"), "op", "payload").repartition("doc_id").sortWithinPartitions("doc_id", "seq", "op", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            out = []
            for key, n, at, op, payload in zip(*(b[c].to_pylist() for c in columns), strict=True):
                if state is None or key != doc_id:
                    if state is not None:
                        out.append(state.row(doc_id, seq))
                    state, doc_id = machine(), key
                state.apply(op, _payload(payload), at)
                seq = n
            yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([state.row(doc_id, seq)], schema)

    return logs.mapInArrow(run, ddl)


def followed(events: DataFrame, machine: Callable, ddl: str, delay: str) -> DataFrame:
    """The row of each key, anew whenever the watermark, ``delay`` behind the latest ``ts``, has released events of it.

    ``events`` is a stream. A key's state is the machine's and the events that wait; these are as many as come in
    ``delay``. After a restart the checkpoint has both.
    """
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        m = machine(held)
        for b in batches:
            waiting += [[int(n), int(at), op, payload] for n, at, op, payload in zip(b["seq"], b["at"], b["op"], b["payload"], strict=True)]
        mark = state.getCurrentWatermarkMs()
        ready = sorted((e for e in waiting if e[1] <= mark), key=lambda e: (e[0], e[2], e[3] or ""))
        waiting = [e for e in waiting if e[1] > mark]
        for _, at, op, payload in ready:
            m.apply(op, _payload(payload), at)
        state.update((json.dumps([m.__dict__, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(min(e[1] for e in waiting), mark + 1))
        if ready:
            yield pd.DataFrame([m.row(key[0], ready[-1][0])])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = timed.withColumn("at", F.unix_millis("ts")).select("doc_id", "seq", "ts", "at", "op", F.coalesce("payload", F.lit("")).alias("payload"))
    return timed.groupBy("doc_id").applyInPandasWithState(run, ddl, "held string", "append", GroupStateTimeout.EventTimeTimeout)
