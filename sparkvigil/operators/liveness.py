"""How long incidents live: the same problem seen again in time goes on, later it opens anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TTL_MS = 86_400_000
#: What is held of a problem between windows.
STORE = "problem_key string, incident_id string, first_seen_ms bigint, last_seen_ms bigint, times_seen bigint"


def incident_id(problem_key: Column) -> Column:
    return F.concat(F.lit("inc:"), F.substring(F.sha2(problem_key, 256), 1, 32))


def lifelines(seen: DataFrame, known: DataFrame | None = None, ttl_ms: int = TTL_MS) -> DataFrame:
    """Adds incident_id, status (open or active), is_new, first_seen_ms, last_seen_ms and times_seen to ``seen``.

    ``seen`` holds problem_key, start_ms, end_ms, a row for each time that a problem was found; ``known`` is the store that earlier rows
    left (STORE). Rows of a problem count in the order of end_ms. One is active if the problem was last seen at most ``ttl_ms`` before
    its end; else it opens an incident. Rows without an end come last and don't move what was last seen. Rows without a problem_key are a problem too.
    """
    rows = seen
    if known is not None:
        held = known.select(*[F.col(c).alias("known_" + c) for c in ("problem_key", "incident_id", "first_seen_ms", "last_seen_ms", "times_seen")])
        rows = rows.join(held, F.col("problem_key").eqNullSafe(F.col("known_problem_key")) & F.col("known_incident_id").isNotNull(), "left").drop("known_problem_key")
    else:
        rows = rows.withColumn("known_incident_id", F.lit(None).cast("string")).withColumns({f"known_{c}": F.lit(None).cast("bigint") for c in ("first_seen_ms", "last_seen_ms", "times_seen")})
    order = W.partitionBy("problem_key").orderBy(F.asc_nulls_last("end_ms"), F.asc_nulls_last("start_ms"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.greatest(F.max("end_ms").over(before), F.col("known_last_seen_ms"))).withColumn("_nth", F.row_number().over(order))
    unmet = (F.col("_nth") == 1) & F.col("known_incident_id").isNull()
    rows = rows.withColumn("is_new", unmet | F.coalesce(F.col("end_ms") - F.col("_last") > ttl_ms, F.lit(False)))
    rows = rows.withColumn("_life", F.sum(F.col("is_new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    life = W.partitionBy("problem_key", "_life").orderBy("_nth").rowsBetween(W.unboundedPreceding, 0)
    goes_on = F.col("_life") == 0
    return rows.withColumns({
        "incident_id": F.when(goes_on, F.col("known_incident_id")).otherwise(incident_id(F.coalesce("problem_key", F.lit("")))),
        "status": F.when(F.col("is_new"), "open").otherwise("active"),
        "first_seen_ms": F.when(goes_on, F.col("known_first_seen_ms")).otherwise(F.first(F.coalesce("start_ms", "end_ms")).over(life)),
        "last_seen_ms": F.greatest("_last", "end_ms"),
        "times_seen": F.count("*").over(life) + F.when(goes_on, F.coalesce("known_times_seen", F.lit(0))).otherwise(0),
    }).drop("_last", "_nth", "_life", "known_incident_id", "known_first_seen_ms", "known_last_seen_ms", "known_times_seen")


def store(tracked: DataFrame, known: DataFrame | None = None, now_ms: int | None = None, ttl_ms: int = TTL_MS) -> DataFrame:
    """What to hold after ``tracked`` (of ``lifelines``): a row for each problem, the latest; those last seen more than ``ttl_ms`` before ``now_ms`` go."""
    latest = F.struct(F.col("last_seen_ms").isNotNull(), "last_seen_ms", "times_seen", "first_seen_ms")
    rows = tracked.select("problem_key", "incident_id", "first_seen_ms", "last_seen_ms", "times_seen")
    rows = rows if known is None else rows.unionByName(known.select(*rows.columns))
    out = rows.groupBy("problem_key").agg(F.max_by(F.struct("incident_id", "first_seen_ms", "last_seen_ms", "times_seen"), latest).alias("x")).select("problem_key", "x.*")
    return out if now_ms is None else out.where(F.col("last_seen_ms").isNull() | (now_ms - F.col("last_seen_ms") <= ttl_ms))
