"""Bounds on what a monitored stream may hold: a batch that goes beyond one fails whole, before anything of it is committed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import Ledger


class LimitExceeded(RuntimeError):
    """A batch would hold more than allowed."""

    def __init__(self, code: str, seen: int, limit: int):
        super().__init__(f"{code}: {seen} > {limit}")
        self.code, self.seen, self.limit = code, seen, limit


@dataclass(frozen=True)
class Bounds:
    """How many streams, patterns and signal groups a window may have, and how many pending records and characters all streams."""

    streams: int = 10_000
    patterns: int = 5_000
    groups: int = 5_000
    pending_records: int = 20_000
    pending_chars: int = 8_000_000


#: The key that is counted for each bound on cardinality, over a batch's columns.
KEYS = {"streams": ("stream",), "patterns": ("template_id",), "groups": ("group_type", "template_id", "identity", "window_start_ms")}
_CODES = {"streams": "STREAM_CARDINALITY_LIMIT", "patterns": "PATTERN_CARDINALITY_LIMIT", "groups": "SIGNAL_CARDINALITY_LIMIT", "pending_records": "PENDING_RECORD_LIMIT", "pending_chars": "PENDING_CHARACTER_LIMIT"}


def _key(columns: tuple[str, ...]) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 256)


def keys_of(batch: DataFrame) -> DataFrame:
    """(kind, key), once each: what of a batch counts against the bounds on cardinality. Kinds whose columns it lacks don't count."""
    found = [F.struct(F.lit(kind).alias("kind"), _key(columns).alias("key")) for kind, columns in KEYS.items() if set(columns) <= set(batch.columns)]
    if not found:
        return batch.sparkSession.createDataFrame([], "kind string, key string")
    return batch.select(F.inline(F.array(*found))).distinct()


def check(keys: DataFrame, pending: DataFrame | None, bounds: Bounds) -> None:
    """Raise LimitExceeded if ``keys`` (kind, key; once each) or ``pending`` (stream, pending_records, pending_chars; one row a stream) goes beyond ``bounds``.

    All counting is Spark's; a handful of numbers comes back.
    """
    seen = {r["kind"]: r["n"] for r in keys.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if pending is not None:
        seen |= pending.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pending_records", "pending_chars")]).first().asDict()
    for kind, limit in asdict(bounds).items():
        if seen.get(kind, 0) > limit:
            raise LimitExceeded(_CODES[kind], seen[kind], limit)


def newest_pending(held: DataFrame | None, batch: int, status: DataFrame) -> DataFrame:
    """One row a stream: what it has pending after this batch, else what it last had."""
    rows = status.select("stream", "pending_records", "pending_chars", F.lit(batch).cast("bigint").alias("batch"))
    rows = rows if held is None else rows.unionByName(held.select(*rows.columns))
    return rows.groupBy("stream").agg(F.max_by(F.struct("pending_records", "pending_chars"), "batch").alias("x")).select("stream", "x.*")


def guarded(path: str, query: str, bounds: Bounds = Bounds(), window: Callable[[int], str] = lambda batch: "all") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: commits a batch's rows with the keys and pending counts that they add, or fails before it writes.

    The batch is of ``windows.assembly`` (rows of kind "status" carry what a stream has pending) or of any stream whose columns KEYS names.
    Keys count once within what ``window`` names for a batch (a monitored window; all batches are one by default), over all its batches. A
    batch that fails leaves no trace: Spark hasn't noted it as done, so starting the query again, with higher bounds say, takes it anew, and
    one that was committed just before a crash isn't committed twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        ledger = Ledger(batch.sparkSession, path)
        if ledger.holds(query, number):
            return
        batch = batch.persist()  # counted, then written
        try:
            status = batch.where("kind = 'status'") if "kind" in batch.columns else None
            rows = batch if status is None else batch.where("kind <> 'status'")
            own = F.lit(window(number)).alias("scope")
            fresh, held = keys_of(batch).select(own, "kind", "key"), ledger.read("keys", query)
            if held is not None:
                fresh = fresh.join(held, ["scope", "kind", "key"], "left_anti")
            fresh = fresh.persist()
            every = fresh if held is None else fresh.unionByName(held.where(F.col("scope") == window(number)))
            pending = None if status is None else newest_pending(ledger.read("pending", query), number, status)
            check(every, pending, bounds)
            tables = {"rows": rows, "keys": fresh}
            if status is not None:
                tables["pending"] = status.select("stream", "pending_records", "pending_chars", F.lit(number).cast("bigint").alias("batch"))
            ledger.commit(query, number, tables)
            fresh.unpersist()
        finally:
            batch.unpersist()

    return each
