"""Streams: windowed signals, once-only receipts, and multi-line assembly across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..sources.readers import commit_window


def once(events: DataFrame, ref: str, ts: str, delay: str) -> DataFrame:
    """Each reference once within the watermark: re-deliveries of overlapping reads go."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([ref])


def window_counts(events: DataFrame, ts: str = "ts", window: str = "60 seconds", delay: str = "2 minutes") -> DataFrame:
    """Counts, first, last and least severity by template and window; a window is given when the watermark passes its end."""
    rows = events.withWatermark(ts, delay).groupBy(F.window(ts, window), "template_id")
    return rows.agg(F.count("*").alias("count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.min(T.severity_number(F.col("severity"))).alias("severity_min"))


ASSEMBLY = "kind string, stream string, event_no bigint, text string, line_count int, emission_reason string, pending_records int, pending_chars bigint"
_STATE = "number bigint, lines array<string>, last bigint"


def assembly(classified: DataFrame, idle: str | None = "10 minutes", most_records: int | None = None, most_chars: int | None = None) -> DataFrame:
    """Events of streams of lines (stream, ordinal, line, header), and what stays pending (ASSEMBLY).

    Rows of kind "event": a header ends what is pending; so does ``idle`` time without lines. Of kind "status": what each stream of
    the batch has pending after it, for ``guards``. Of kind "late": a line whose ordinal isn't above those of earlier batches; it
    belongs to an event that may be out already, so it is handed out and joins none.

    State is the one pending event of each stream, of at most ``most_records`` lines and ``most_chars`` characters where those are given: a stream that
    would hold more fails the batch. Lines of a batch are taken in the order of ordinal. Spark keeps running batches while a
    time-out may come, so a query that should end by itself (availableNow) needs ``idle=None``.
    """
    millis = {"second": 1_000, "minute": 60_000, "hour": 3_600_000}
    wait = int(idle.split()[0]) * millis[idle.split()[1].rstrip("s")] if idle else None

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        number, pending, last = state.get if state.exists else (0, [], None)
        pending, before = list(pending), last
        size = sum(map(len, pending))

        def event(reason: str) -> None:
            out.append(("event", key[0], number, "\n".join(pending), len(pending), reason, None, None))

        if state.hasTimedOut:
            if pending:
                event("explicit_stream_close")
            pending, size = [], 0
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("ordinal", kind="stable")
            for ordinal, line, header in zip(rows["ordinal"], rows["line"], rows["header"], strict=True):
                if before is not None and ordinal <= before:
                    out.append(("late", key[0], None, line, 1, None, None, None))
                    continue
                last = int(ordinal)
                if not line.strip():
                    continue
                if header and pending:
                    event("next_header")
                    pending, size, number = [], 0, number + 1
                pending.append(line)
                size += len(line)
                for code, seen, limit in (("PENDING_RECORD_LIMIT", len(pending), most_records), ("PENDING_CHARACTER_LIMIT", size, most_chars)):
                    if limit is not None and seen > limit:
                        raise RuntimeError(f"{code}: {seen} > {limit} in stream {key[0]}")
            state.update((number, pending, last))
            if wait:
                state.setTimeoutDuration(wait)
        out.append(("status", key[0], None, None, None, None, len(pending), size))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in ASSEMBLY.split(", ")])
        yield made.astype({"event_no": "Int64", "line_count": "Int32", "pending_records": "Int32", "pending_chars": "Int64"})

    return classified.groupBy("stream").applyInPandasWithState(each, ASSEMBLY, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def segments(classified: DataFrame, idle: str | None = "10 minutes") -> DataFrame:
    """The events of ``assembly``: stream, event_no, text, line_count, emission_reason."""
    return assembly(classified, idle).where("kind = 'event'").select("stream", "event_no", "text", "line_count", "emission_reason")


def to_table(stream: DataFrame, path: str, query: str, checkpoint: str):
    """Starts a query that writes each batch once, whatever is retried."""
    return stream.writeStream.foreachBatch(lambda df, batch: commit_window(df, path, query, batch) and None).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
