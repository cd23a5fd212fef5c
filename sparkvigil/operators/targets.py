"""What can be monitored: namespaces, workloads and containers seen lately, and whether one is alive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

LEVELS = ("namespace", "workload", "container")
DISCOVERY_MS, VALIDATION_MS = 86_400_000, 900_000
MOST, SAMPLES, CHARACTERS, NAME = 200, 10, 2000, 200


def _between(records: DataFrame, end_ms: int, span_ms: int) -> DataFrame:
    return records.where((F.col("ts_ms") >= end_ms - span_ms) & (F.col("ts_ms") < end_ms))


def usable(name: Column) -> Column:
    """Not blank, at most NAME characters, none below a blank."""
    return F.coalesce((F.trim(name) != "") & (F.length(name) <= NAME) & ~name.rlike(r"[\x00-\x1F]"), F.lit(False))


def options(records: DataFrame, level: str, end_ms: int, most: int = MOST) -> DataFrame:
    """(the levels above, level's value, truncated): under every parent at once, the first ``most`` values by name of the day before ``end_ms``.

    ``truncated`` says that the parent has more. Records without a value of this level, or of one above, make no option; names that aren't
    ``usable`` neither. The list is for a person to choose from, so its limit is the feature; only ``most`` + 1 names a parent are ranked.
    """
    names = LEVELS[: LEVELS.index(level) + 1]
    seen = _between(records, end_ms, DISCOVERY_MS).select(*names).distinct()
    for name in names:
        seen = seen.where(usable(F.col(name)))
    over = W.partitionBy(*names[:-1]) if len(names) > 1 else W.partitionBy(F.lit(0))
    ranked = seen.withColumn("nth", F.row_number().over(over.orderBy(level))).where(F.col("nth") <= most + 1)
    return ranked.withColumn("truncated", F.max("nth").over(over) > most).where(F.col("nth") <= most).select(*names, "truncated")


def validated(records: DataFrame, end_ms: int, level: str = "container", samples: int = SAMPLES) -> DataFrame:
    """One row a target seen in the day before ``end_ms``: events and latest time of its last 15 minutes, its newest ``samples`` messages then, redacted and clipped, and state LIVE or QUIET.

    ``records`` holds the levels, ts_ms, sequence and message. Newest means time, then sequence, then text, so ties have one order. Null messages count, but are no sample.
    """
    names = list(LEVELS[: LEVELS.index(level) + 1])
    found = _between(records, end_ms, DISCOVERY_MS)
    for name in names:
        found = found.where(usable(F.col(name)))
    late = F.col("ts_ms") >= end_ms - VALIDATION_MS
    counts = found.groupBy(*names).agg(F.count_if(late).alias("events"), F.max(F.when(late, F.col("ts_ms"))).alias("latest_ms"))
    newest = W.partitionBy(*names).orderBy(F.desc("ts_ms"), F.desc("sequence"), "message")
    told = found.where(late & F.col("message").isNotNull()).withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= samples)
    text = F.left(T.redact(F.col("message")), F.lit(CHARACTERS))
    lists = told.select(*names, "nth", text.alias("text")).groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("samples"))
    out = counts.join(lists, names, "left")
    return out.withColumn("samples", F.coalesce("samples", F.expr("cast(array() as array<string>)"))).withColumn("state", F.when(F.col("events") > 0, "LIVE").otherwise("QUIET"))


def out_of_scope(records: DataFrame, scope: dict[str, str]) -> DataFrame:
    """(field, n): how many records disagree with each field of ``scope``; a run over these records must not be published. Nulls disagree. Fields without a violation have no row."""
    wrong = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in scope.items()]))
    return records.select(F.explode(wrong).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
