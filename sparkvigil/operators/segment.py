"""Multi-line assembly: physical lines to events, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P


def lines(texts: DataFrame, stream: str, text: str = "text") -> DataFrame:
    """(stream, ordinal, line): every physical line of each text, without its line end."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")
    return texts.select(F.col(stream).alias("stream"), F.posexplode(split).alias("ordinal", "line"))


def is_blank(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*$")


def classify(numbered: DataFrame, policy: str | None = None) -> DataFrame:
    """Adds blank, regex_match, start, kind and reason to (stream, ordinal, line).

    In this order: blanks; known continuations (indented, traceback, structured keys) whatever else fits;
    strong headers; the policy's pattern; JSON openings, which begin an event if none is open or after a blank
    line; all else continues. Only the JSON rule looks at other lines, so that a window decides.
    """
    line = F.col("line")
    order = W.partitionBy("stream").orderBy("ordinal")
    out = numbered.withColumn("blank", is_blank(line))
    before = F.coalesce(F.sum((~F.col("blank")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("before", before).withColumn("after_blank", F.coalesce(F.lag("blank").over(order), F.lit(True)))
    veto, strong = F.lit(False), F.lit(False)
    for p in P.CONTINUATIONS:
        veto = veto | line.rlike(p)
    for p in P.STRONG_HEADERS:
        strong = strong | line.rlike(p)
    hit = line.rlike("^(?:" + policy + ")") if policy else F.lit(False)
    opens = F.startswith(line, F.lit('{"')) | line.rlike(r"(?U)^\{(\s|$)")
    fresh = (F.col("before") == 0) | F.col("after_blank")
    reason = (
        F.when(F.col("blank"), "blank")
        .when(veto, "known_multiline_continuation")
        .when(strong, "deterministic_strong_header")
        .when(hit, "policy_regex_header")
        .when(opens, "json_context")
        .otherwise("continuation_default")
    )
    out = out.withColumn("regex_match", hit & ~F.col("blank")).withColumn("reason", reason)
    start = F.col("reason").isin("deterministic_strong_header", "policy_regex_header") | ((F.col("reason") == "json_context") & fresh)
    return out.withColumn("start", start).withColumn("kind", F.when(~start, "continuation").when(F.col("reason") == "deterministic_strong_header", "strong_header").otherwise("contextual_header"))


def assemble(classified: DataFrame, closed: bool = False) -> DataFrame:
    """Events of (stream, event_no): text, line_count, start_ordinal, end_ordinal, orphan, emission_reason, boundary_status.

    Lines before the first header make an orphan event; blanks before any text belong to none; later blanks
    count, but aren't part of the text. The last event of a stream ends with the analysis (or with the
    stream, where ``closed``), and may be incomplete; the others end at the next header.
    """
    order = W.partitionBy("stream").orderBy("ordinal")
    numbered = classified.withColumn("event_no", F.sum(F.col("start").cast("int")).over(order))
    held = numbered.where(~(F.col("blank") & (F.col("before") == 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("blank"), F.struct("ordinal", "line")))), lambda x: x["line"]), "\n")
    events = held.groupBy("stream", "event_no").agg(
        text.alias("text"), F.count("*").alias("line_count"), F.min("ordinal").alias("start_ordinal"), F.max("ordinal").alias("end_ordinal"),
        F.max(F.col("start").cast("int")).alias("headers"),
    )
    last = F.col("event_no") == F.max("event_no").over(W.partitionBy("stream"))
    end = "explicit_stream_close" if closed else "analysis_end"
    return events.select(
        "stream", "event_no", "text", "line_count", "start_ordinal", "end_ordinal", (F.col("headers") == 0).alias("orphan"),
        F.when(last, end).otherwise("next_header").alias("emission_reason"),
        F.when(F.col("headers") == 0, "orphan").when(last, "possible_incomplete").otherwise("complete").alias("boundary_status"),
    )


def dispositions(records: DataFrame) -> DataFrame:
    """Adds why a record can't be assembled, or null: framing, then stream identity, then policy."""
    parts = ["source_scope", "pod_instance", "container_instance", "channel"]
    given = [F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in parts]
    none, every = ~given[0] & ~given[1] & ~given[2] & ~given[3], given[0] & given[1] & given[2] & given[3]
    why = F.when(F.col("framing") != "PHYSICAL_LINE", "unsupported_framing").when(none, "missing_stream_identity").when(~every, "incomplete_stream_identity").when(F.col("policy").isNull(), "no_policy")
    return records.withColumn("disposition", why)


def statistics(classified: DataFrame) -> DataFrame:
    """One row: how well a policy's headers cover the lines, for its admission."""
    size = F.count("*").alias("lines")
    got = classified.agg(
        size, F.sum((~F.col("blank")).cast("int")).alias("nonblank"), F.sum(F.col("start").cast("int")).alias("headers"),
        F.sum(F.col("regex_match").cast("int")).alias("matched"),
        F.sum((F.col("start") & ~F.col("regex_match")).cast("int")).alias("unmatched"),
        F.sum((F.col("regex_match") & ~F.col("start")).cast("int")).alias("internal"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    got = got.withColumn("coverage", 100 * F.when(F.col("headers") > 0, (F.col("headers") - F.col("unmatched")) / F.col("headers"))).withColumn("unmatched_ratio", ratio("unmatched", "headers"))
    admitted = (F.col("headers") > 0) & (F.col("internal") == 0) & (F.col("coverage") >= 95) & (F.col("unmatched_ratio") <= 0.05)
    return got.withColumn("admitted", F.coalesce(admitted, F.lit(False)))
