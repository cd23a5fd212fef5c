"""State across windows of a stream: incidents that stay alive, and the history that baselines are made of.

Both keep typed state for each key (transformWithState), which takes the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` = ROCKSDB. They give what ``operators.liveness.lifelines`` and
``operators.baseline.history`` give on the same rows, also over restarts from a checkpoint.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.baseline import HORIZON
from ..operators.liveness import TTL_MS, incident_id

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIVES = "problem_key string, start_ms bigint, end_ms bigint, incident_id string, status string, is_new boolean, first_seen_ms bigint, last_seen_ms bigint, times_seen bigint"


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _sorted(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable", na_position="last")


class Liveness(StatefulProcessor):
    """One value a problem: its incident, when it was first and last seen, and how often. A timer drops it once it can't go on."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("incident", "incident_id string, first_seen_ms bigint, last_seen_ms bigint, times_seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], list(self.held.get()) if self.held.exists() else None
        frame = _sorted(rows, ["end_ms", "start_ms"])
        for fresh, start, end in zip(frame["fresh_id"], map(_whole, frame["start_ms"]), map(_whole, frame["end_ms"]), strict=True):
            last = held[2] if held else None
            new = held is None or (end is not None and last is not None and end - last > self.ttl_ms)
            if new:
                held = [fresh, end if start is None else start, last, 0]
            held[2] = max((x for x in (held[2], end) if x is not None), default=None)
            held[3] += 1
            out.append((key[0], start, end, held[0], "open" if new else "active", new, *held[1:]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held[2] is not None:
            self.handle.registerTimer(held[2] + self.ttl_ms + 1)
        self.held.update(tuple(held))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in LIVES.split(", ")])
        yield made.astype({c: "Int64" for c in ("start_ms", "end_ms", "first_seen_ms", "last_seen_ms", "times_seen")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def live_incidents(seen: DataFrame, delay: str = "10 minutes", ttl_ms: int = TTL_MS) -> DataFrame:
    """The stream ``seen`` (problem_key, start_ms, end_ms) with the incident that each row opens or continues (LIVES), as ``lifelines`` has it.

    A problem's state goes when the watermark, ``delay`` behind the latest end_ms, is more than ``ttl_ms`` past it. Rows behind the
    watermark are dropped by Spark. Rows of a batch count in the order of end_ms; a row without one doesn't move what was last seen.
    """
    rows = seen.select("problem_key", "start_ms", "end_ms", incident_id(F.coalesce("problem_key", F.lit(""))).alias("fresh_id"), F.timestamp_millis(F.col("end_ms")).alias("at"))
    return rows.withWatermark("at", delay).groupBy("problem_key").transformWithStateInPandas(Liveness(ttl_ms), LIVES, "Append", "EventTime")


class Ring(StatefulProcessor):
    """A list for each key: the latest ``horizon`` windows and their values, in order."""

    def __init__(self, at: str, value: str, names: list[str], horizon: int):
        self.at, self.value, self.names, self.horizon = at, value, names, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("past", "at bigint, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(a), float(v)) for a, v in self.held.get()] if self.held.exists() else []
        frame, pasts = _sorted(rows, [self.at]), []
        for at, value in zip(frame[self.at].tolist(), frame[self.value].tolist(), strict=True):
            place = bisect_left(held, (at,))
            pasts.append([v for _, v in held[max(0, place - self.horizon) : place]])
            held.insert(place, (at, float(value)))
            del held[: -self.horizon]
        self.held.put(held)
        yield frame[self.names].assign(past=pasts)

    def close(self) -> None:
        pass


def baseline_history(metrics: DataFrame, key: list[str], at: str, value: str, horizon: int = HORIZON) -> DataFrame:
    """The stream ``metrics`` (key columns, at: whole number of a window, value; neither null) with ``past``: the values of up to
    ``horizon`` windows of its key before each. ``baseline.change`` reads it as it reads that of ``baseline.history``.

    State is at most ``horizon`` rows a key. A window that comes after a later one gets the past that is still held, and takes its place in it.
    """
    names = [*key, at, value]
    rows = metrics.select(*key, F.col(at).cast("bigint").alias(at), F.col(value).cast("double").alias(value))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", past array<double>"
    return rows.groupBy(*key).transformWithStateInPandas(Ring(at, value, names, horizon), schema, "Append", "None")
