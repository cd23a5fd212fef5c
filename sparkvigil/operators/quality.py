"""How good an analysis is: line accounting, event boundaries, event times, and whether a line pattern may be used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.admission import shape

#: An audit shows so many affected events.
SAMPLES = 200
#: A pattern that fits so many lines may not miss lines that are so much alike.
FITTING, ALIKE = 3, 0.75
#: Tokens of a line that its shape is made of, and where its blocks begin.
TOKENS, BLOCKS = 8, (0, 3, 6)
COVERED, UNMATCHED, READ = 95.0, 0.05, 95.0
BASES = ("message_explicit", "message_source_timezone", "source_record", "untimed")


def boundaries(events: DataFrame) -> DataFrame:
    """One row about the events of ``segment.assemble``: how many there are, how many of each boundary status, and how many end only because the analysis does."""
    n = lambda column, value: F.count_if(F.col(column) == value)
    return events.agg(
        F.count("*").alias("total_events"), n("boundary_status", "complete").alias("complete"), n("boundary_status", "possible_incomplete").alias("possible_incomplete"),
        n("boundary_status", "confirmed_truncated").alias("confirmed_truncated"), n("boundary_status", "orphan").alias("orphan"), n("emission_reason", "analysis_end").alias("analysis_end_events"),
    )


def affected(events: DataFrame, most: int = SAMPLES) -> DataFrame:
    """The first ``most`` events, by stream and number, whose boundaries aren't complete: references and counts, no text. A report: ``boundaries`` counts all."""
    stream = F.substring(F.sha2(F.to_json(F.array(F.col("stream").cast("string"))), 256), 1, 32)
    rows = events.where(F.col("boundary_status") != "complete").orderBy("stream", "event_no").limit(most)
    return rows.select("stream", "event_no", stream.alias("stream_id"), "boundary_status", "emission_reason", "line_count", "start_ordinal", "end_ordinal")


def accounting(classified: DataFrame, events: DataFrame) -> DataFrame:
    """One row: physical lines and what became of them in ``events``; zero_loss says that every line with text stands in one event. Empty tables give zeros and no loss."""
    held = F.size(F.split("text", "\n"))
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    of_lines = classified.agg(F.count("*").alias("lines"), F.count_if(~F.col("blank")).alias("nonblank"), F.count_if(F.col("regex_match") & ~F.col("start")).alias("internal"))
    of_events = events.agg(
        F.count("*").alias("events"), F.count_if(F.col("line_count") == 1).alias("single"), F.count_if(F.col("line_count") > 1).alias("multiline"), F.min("line_count").alias("min_lines"), F.max("line_count").alias("max_lines"),
        F.coalesce(F.sum(F.when(empty, 0).otherwise(held)), F.lit(0)).alias("accounted"),
    )
    both = of_lines.unionByName(of_events, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    rate = F.when(F.col("nonblank") > 0, F.round(F.col("internal") / F.col("nonblank") * 100, 2)).otherwise(0.0)
    return one.withColumn("zero_loss", F.col("nonblank") == F.col("accounted")).withColumn("undersegmentation_rate", rate)


def _shapes(line: Column) -> Column:
    return F.transform(F.slice(F.filter(F.split(line, r"\s+"), lambda t: t != ""), 1, TOKENS), shape)


def partial_misses(lines: DataFrame, line: str = "line", matched: str = "matched") -> DataFrame:
    """One row: matched, unmatched, similar_unmatched and suspicious, of (line, matched); blank lines don't count.

    A line that a pattern misses is suspicious if at least ALIKE of its first TOKENS token shapes stand in the same places of some line that the pattern
    fits (of the longer one's), once FITTING lines fit. Of 8 places 2 may differ, of 4 to 7 one, of fewer none: so one of the blocks that begin at
    BLOCKS is equal and not empty, and different shapes meet by their blocks only; a shape that has met one is done.
    """
    rows = lines.where(F.coalesce(F.col(line), F.lit("")).rlike(r"(?U)\S")).select(_shapes(F.col(line)).alias("shape"), F.coalesce(F.col(matched), F.lit(False)).alias("fits"))
    counted = rows.groupBy("shape", "fits").agg(F.count("*").alias("n"))
    ends = (*BLOCKS[1:], TOKENS)
    block = F.array(*[F.struct(F.lit(i).alias("i"), F.slice("shape", lo + 1, hi - lo).alias("part")) for i, (lo, hi) in enumerate(zip(BLOCKS, ends, strict=True))])
    met = counted.select("shape", "fits", "n", F.explode(F.filter(block, lambda b: F.size(b["part"]) > 0)).alias("block"))
    missed = met.where(~F.col("fits")).select("shape", "n", "block")
    fitting = met.where("fits").select(F.col("shape").alias("other"), F.col("block").alias("at"))
    same = F.size(F.filter(F.zip_with("shape", "other", lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
    near = missed.join(fitting, (F.col("block") == F.col("at")) & (same >= ALIKE * F.greatest(F.size("shape"), F.size("other"))), "left_semi").select("shape", "n").distinct()
    totals = counted.select(F.when(F.col("fits"), F.col("n")).otherwise(0).alias("matched"), F.when(F.col("fits"), 0).otherwise(F.col("n")).alias("unmatched"), F.lit(0).alias("similar_unmatched"))
    every = totals.unionByName(near.select(F.lit(0).alias("matched"), F.lit(0).alias("unmatched"), F.col("n").alias("similar_unmatched")))
    one = every.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in every.columns])
    return one.withColumn("suspicious", (F.col("matched") >= FITTING) & (F.col("similar_unmatched") > 0))


def verdict(statistics: DataFrame, accounted: DataFrame, misses: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """One row: accepted, and the reasons against, of a line pattern, from ``segment.statistics``, ``accounting`` and ``partial_misses`` of the same lines.

    ``parsed`` (boolean column ok, a row an event) is what a parser made of the events: with any, READ percent must be read.
    """
    parts = [statistics.select("headers", "matched", "internal", "coverage", "unmatched_ratio"), accounted.select("zero_loss"), misses.select("suspicious")]
    if parsed is not None:
        parts.append(parsed.agg((F.count_if("ok") * 100 / F.nullif(F.count("*"), F.lit(0))).alias("read_percent")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    against = {
        "no_activity": F.coalesce(F.col("matched") - F.col("internal"), F.lit(0)) <= 0, "no_headers": F.coalesce("headers", F.lit(0)) == 0, "internal_headers": F.col("internal") > 0, "lines_lost": ~F.col("zero_loss"),
        "low_coverage": F.coalesce(F.col("coverage"), F.lit(0.0)) < COVERED, "unmatched_headers": F.col("unmatched_ratio") > UNMATCHED, "partial_miss": F.col("suspicious"),
    }
    if parsed is not None:
        against["parser"] = F.col("read_percent") < READ
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in against.items()]))
    return one.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def time_counters(parsed: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """(kind, name, status, n): counters of event times, zeros left out.

    ``parsed`` is what ``parse.canonical`` gives; ``delivered`` (key, ts_ms) what went on to the analysis. Keys are unique in both. Rows that agree in
    all that is counted are counted first, so that only their few kinds are spread over the counters.
    """
    went = delivered.select(F.col(key).alias("_went"), F.col("ts_ms").alias("_then"))
    rows = parsed.join(went, F.col(key) == F.col("_went"), "left").select(
        F.col("format").alias("parser"), F.coalesce("time_status", F.when(F.col("basis") == "source_record", "source_record").otherwise("resolved")).alias("status"), "basis",
        F.col("ts_ms").isNotNull().alias("timed"), F.col("_went").isNotNull().alias("went"), F.col("_then").isNotNull().alias("then"), F.col("ts_ms").eqNullSafe(F.col("_then")).alias("same"),
    )
    n = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    event, timed, went_on, then = F.col("parser").isNotNull(), F.col("timed"), F.col("went"), F.col("then")
    named = {
        "events_total": F.lit(True), "parser_no_event": ~event, "parsed_events_total": event, "source_timestamp_present": event & (timed | (F.col("status") != "missing")),
        "source_timestamp_not_detected": event & ~timed & (F.col("status") == "missing"), "parsed_timestamp_resolved": event & timed, "parsed_timestamp_unresolved": event & ~timed,
        "downstream_events_total": went_on, "downstream_timestamp_resolved": went_on & then, "downstream_timestamp_unresolved": went_on & ~then, "parsed_events_not_delivered": event & ~went_on,
        "parsed_resolved_not_delivered": event & ~went_on & timed, "timestamp_lost": event & went_on & timed & ~then, "timestamp_changed": event & went_on & ~F.col("same"),
    }
    none = F.lit(None).cast("string")
    one = lambda kind, name, status: F.struct(F.lit(kind).alias("kind"), name.alias("name"), status.alias("status"))
    marks = [F.when(c, one("count", F.lit(k), none)) for k, c in named.items()]
    marks += [F.when(event, one("basis", F.col("basis"), none)), F.when(event, one("parser", F.col("parser"), F.col("status")))]
    spread = n.select("n", F.explode(F.array_compact(F.array(*marks))).alias("m"))
    return spread.groupBy("m.kind", "m.name", "m.status").agg(F.sum("n").alias("n"))


def basis_counts(basis: Column) -> Column:
    """Aggregate: map of how often each of BASES occurs, zeros left out."""
    counts = F.map_from_arrays(F.array(*[F.lit(b) for b in BASES]), F.array(*[F.count_if(basis == b) for b in BASES]))
    return let(counts, lambda m: F.map_filter(m, lambda k, v: v > 0))
