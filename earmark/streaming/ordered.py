"""Streams whose state depends on the order of events: rows are held until the watermark has passed them.

A row waits in list state; when the watermark passes the earliest one, all rows it has passed are folded in the order of time.
So the result is that of a sequential run, whatever order the rows of the last hours came in. Rows behind the watermark are late
and dropped by Spark. Timers end the state: a key that has nothing held and nothing remembered leaves no rows.

These processors need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Thresholds
from ..operators import learning

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds rows to the watermark; subclasses fold them. Rows carry ``at``, their time in microseconds, ``id``, and the columns named."""

    names: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id long, row string")
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None: ...

    def fold(self, key: tuple, rows: list, now: int) -> pd.DataFrame | None: ...

    def until(self) -> int | None:
        """Time in milliseconds at which remembered state ends by itself; None if there is none."""
        return None

    def expire(self, now: int) -> None: ...

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.at), int(r.id), r.row) for pdf in rows for r in pdf.itertuples(index=False)]
        self.held.appendList(new)
        self._wake(min(new)[0] // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        ready = [r for r in held if r[0] < mark * 1000]
        left = held[len(ready) :]
        if held:
            if left:
                self.held.put(left)
            else:
                self.held.clear()
        out = self.fold(key, [SimpleNamespace(at=r[0], id=r[1], **dict.fromkeys(self.names) | json.loads(r[2])) for r in ready], mark) if ready else None
        self.expire(mark)
        for t in (left[0][0] // 1000 if left else None, self.until()):
            if t is not None:
                self._wake(max(t, mark))
        if out is not None and len(out):
            yield out

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(int(ms) + 1)

    def close(self) -> None: ...


class Admission(InOrder):
    """At most ``limit`` admitted events of a key in any ``seconds``; the state is the admitted times inside the window."""

    out = "id long, key long, admitted boolean, retry_after long"

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def start(self, handle):
        self.recent = handle.getListState("recent", "at long")

    def _times(self) -> list[int]:
        return [r[0] for r in self.recent.get()] if self.recent.exists() else []

    def _keep(self, times: list[int]) -> None:
        if times:
            self.recent.put([(t,) for t in times])
        else:
            self.recent.clear()

    def fold(self, key, rows, now):
        times, out = self._times(), []
        for r in rows:
            times = [t for t in times if t > r.at - self.seconds * 1_000_000]
            ok = len(times) < self.limit
            wait = 0 if ok else max(1, -(-(self.seconds * 1_000_000 - (r.at - times[0])) // 1_000_000))
            if ok:
                times.append(r.at)
            out.append((r.id, key[0], ok, wait))
        self._keep(times)
        return pd.DataFrame(out, columns=["id", "key", "admitted", "retry_after"])

    def until(self):
        times = self._times()
        return max(times) // 1000 + self.seconds * 1000 if times else None

    def expire(self, now):
        times = self._times()
        if times and max(times) // 1000 + self.seconds * 1000 <= now:
            self._keep([])


class Learning(InOrder):
    """The learning registry: the entries of a bucket as map state, each with its bounded features."""

    out = learning.FOUND
    names = ("items", "duration", "mert", "cover", "hint")
    def __init__(self, pitches: int, forget_seconds: int = 90 * 86400, t: Thresholds = DEFAULT):
        self.pitches, self.forget, self.t = pitches, forget_seconds * 1_000_000, t

    def start(self, handle):
        self.entries = handle.getMapState("entries", "unknown_id long", "last_seen long, entry string")

    def _load(self) -> learning.Bucket:
        found = {}
        if self.entries.exists():
            for k, v in self.entries.iterator():
                found[k[0]] = learning.Entry(**json.loads(v[1]))
        return learning.Bucket(found, self.forget, self.pitches, self.t)

    def fold(self, key, rows, now):
        bucket = self._load()
        before, out, touched = set(bucket.entries), [], set()
        for r in rows:
            r.bucket, r.sighting_id, r.seen_at = key[0], r.id, r.at
            out.append(bucket.fold(r))
            touched.add(out[-1][2])
        for k in before - set(bucket.entries):
            self.entries.removeKey((k,))
        for k in touched & set(bucket.entries):
            e = bucket.entries[k]
            self.entries.updateValue((k,), (e.last_seen, json.dumps(asdict(e))))
        return learning.frame(out)

    def until(self):
        seen = [v[0] for _, v in self.entries.iterator()] if self.entries.exists() else []
        return (min(seen) + self.forget) // 1000 if seen else None

    def expire(self, now):
        if self.entries.exists():
            for k in [k for k, v in self.entries.iterator() if (v[0] + self.forget) // 1000 <= now]:
                self.entries.removeKey(k)


def folded(stream: DataFrame, key: str, processor: InOrder, *, time: str, late: str) -> DataFrame:
    """stream (key, id, ``time`` as timestamp, columns of the processor) through its processor, ``late`` behind the latest event."""
    # what a processor needs goes as one text: nested arrays of a batch can't be read by all versions of Arrow
    row = F.to_json(F.struct(*processor.names)) if processor.names else F.lit("{}")
    rows = stream.withWatermark(time, late).select(key, time, F.unix_micros(time).alias("at"), "id", row.alias("row"))
    return rows.groupBy(key).transformWithStateInPandas(processor, processor.out, "Append", "EventTime")
