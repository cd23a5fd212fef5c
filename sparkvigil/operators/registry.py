"""A registry of validated templates: the first to write one wins, and a full one takes no more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 50_000
ENTRIES = "key string, template string, written_ms bigint"


def promoted(known: DataFrame | None, proposals: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The entries (ENTRIES) that ``proposals`` (key, template, written_ms) add to ``known``, at most as many as leave it at ``capacity``.

    A key that is known keeps its template. Of several proposals for a key the first counts: by written_ms, nulls last, then by template; of the new keys the first come in,
    by the same order and then by key. So the winner depends on the rows alone, not on how they are dealt out. Null keys and templates are no proposals.
    """
    rows = proposals.where("key is not null and template is not null").select("key", "template", F.col("written_ms").cast("bigint").alias("written_ms"))
    first = F.min(F.struct(F.col("written_ms").isNull(), "written_ms", "template")).alias("x")
    new = rows.groupBy("key").agg(first).select("key", "x.template", "x.written_ms")
    room = capacity
    if known is not None:
        new = new.join(known.select("key"), "key", "left_anti")
        room = max(0, capacity - known.count())
    # the first of all new keys: each task gives at most so many, and the capacity bounds what meets
    return new.orderBy(F.asc_nulls_last("written_ms"), "template", "key").limit(room)


def merged(known: DataFrame | None, proposals: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The registry after ``promoted``: nothing that was in it changes."""
    new = promoted(known, proposals, capacity)
    return new if known is None else known.select("key", "template", "written_ms").unionByName(new)


def looked_up(events: DataFrame, registry: DataFrame, key: str = "template") -> DataFrame:
    """``events`` with stored_template and registered: the registry's template for their ``key``, and whether it has one."""
    held = registry.select(F.col("key").alias("_key"), F.col("template").alias("stored_template"))
    return events.join(held, F.col(key) == F.col("_key"), "left").withColumn("registered", F.col("_key").isNotNull()).drop("_key")


def trusted(events: DataFrame, known: DataFrame | None = None, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(events, registry): templated events with the templates that stand for them, and the registry they leave.

    An event's template is proposed if it is reliable; event_id and ts_ms say which came first. Events whose template
    the registry has, after this, are reliable with the stored one; the others, unfit or met when it was full, keep their own and aren't.
    """
    own = events.where("template_reliable").select(F.col("template").alias("key"), "template", F.col("ts_ms").alias("written_ms"))
    registry = merged(known, own, capacity)
    met = looked_up(events, registry)
    out = met.withColumn("template", F.coalesce("stored_template", "template")).withColumn("template_reliable", F.col("registered"))
    return out.drop("stored_template", "registered"), registry
