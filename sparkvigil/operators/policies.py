"""Learned line policies as rows: which patterns a stream has, what their groups mean, which samples teach them, and whether they are good enough.

A policy is a row of a table (policy_id, regex, groups): groups maps field names (timestamp, severity, message, host, service, component, trace_id,
span_id, or attr:NAME) to a group of the pattern, by name or number. Patterns come from rows and not from the plan, so
a new policy needs no new query. ``compiled`` checks and prepares the table; all else takes what it gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import times
from ..functions.text import first_pairs, let
from ..plans.admission import faults

# What severities mean, how many samples a format may have, how many teach it, and what shares admit it.
SEVERITIES = {
    "V": "DEBUG", "VERBOSE": "DEBUG", "D": "DEBUG", "DEBUG": "DEBUG", "I": "INFO", "INFO": "INFO", "INFORMATION": "INFO", "W": "WARNING", "WARN": "WARNING",
    "WARNING": "WARNING", "E": "ERROR", "ERR": "ERROR", "ERROR": "ERROR", "C": "CRITICAL", "CRIT": "CRITICAL", "CRITICAL": "CRITICAL", "F": "FATAL", "FATAL": "FATAL",
}
SAMPLES, TEACHING, ADMITTED, YEARS = 150, 40, 0.90, (1980, 2100)
MISSED, MATCHED = 24, 8
# Explicit assignments in a message, and the shapes of a sample's first line, in the order in which they are applied.
ASSIGNMENT = r"""(?<![\w.-])([A-Za-z_][A-Za-z0-9_.-]*)=("[^"\r\n]*"|'[^'\r\n]*'|[^\s,()\[\]{}]+)"""
SHAPES = (
    (r"\b\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"), (r"\b\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?", "<TS>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"), (r"\b0x[0-9a-fA-F]+\b", "<HEX>"), (r"\b[0-9a-fA-F]{8,}\b", "<HEX>"), (r"\b\d+\b", "<N>"), (r"\s+", " "),
)
FIELDS = ("timestamp", "severity", "message", "host", "service", "component", "trace_id", "span_id")


def compiled(policies: DataFrame) -> DataFrame:
    """(policy_id, regex, pattern, groups, fault) of (policy_id, regex, groups map<string,string>): ``pattern`` in Spark's dialect, ``groups`` by number.

    ``fault`` is what makes a policy unfit: of its pattern (see ``admission.faults``), "no_message_group" where fields of a header are
    claimed without a body, "no_such_group" where the pattern lacks a group, or null. The table is one that operators keep: a row a policy.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for policy, regex, groups in zip(frame["policy_id"], frame["regex"], frame["groups"], strict=True):
                regex, claims = regex or "", {k: v for k, v in dict(groups or {}).items() if v}
                wrong = faults(regex)
                if not wrong and set(claims) - {"message"} and "message" not in claims:
                    wrong = ["no_message_group"]
                if "does_not_compile" in wrong or not regex:
                    out.append((policy, regex, None, {}, wrong[0]))
                    continue
                held = re.compile(regex)
                number = {k: int(v) if v.isdigit() else held.groupindex.get(v, -1) for k, v in claims.items()}
                plain = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\{held.groupindex[m[1]]}", re.sub(r"\(\?P<\w+>", "(", regex))
                there = {k: v for k, v in number.items() if 0 <= v <= held.groups}
                wrong = wrong or ["no_such_group"] * (there != number)
                out.append((policy, regex, plain, there, wrong[0] if wrong else None))
            yield pd.DataFrame(out, columns=["policy_id", "regex", "pattern", "groups", "fault"])

    return policies.select("policy_id", "regex", "groups").mapInPandas(each, "policy_id string, regex string, pattern string, groups map<string,int>, fault string")


def first_line(log: Column) -> Column:
    return F.regexp_replace(F.substring_index(log, "\n", 1), r"\r+$", "")


def matches(line: Column, pattern: Column) -> Column:
    """Whether a pattern of a row fits the beginning of the row's line; null without a pattern."""
    return F.rlike(line, F.concat(F.lit("(?U)^(?:"), pattern, F.lit(")")))


def explicit(message: Column) -> Column:
    """map of the message's explicit key=value, quotes removed; the first value of a key stays."""
    keys, values = F.regexp_extract_all(message, F.lit(ASSIGNMENT), F.lit(1)), F.regexp_extract_all(message, F.lit(ASSIGNMENT), F.lit(2))
    plain = lambda v: F.when(F.length(v) >= 2, F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2")).otherwise(v)
    return first_pairs(keys, values, plain)


def captured(line: Column, pattern: Column, groups: Column) -> Column:
    """map of field to what its group caught in ``line``, trimmed; what caught nothing is left out."""
    full = F.concat(F.lit("(?U)^(?:"), pattern, F.lit(")"))
    # a map of a row says which groups: only those that are claimed are taken
    pairs = F.transform(F.map_entries(groups), lambda e: F.struct(e["key"].alias("key"), F.regexp_replace(F.call_function("regexp_extract", line, full, e["value"]), r"(?U)^\s+|\s+$", "").alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"] != ""))


def fields(log: Column, pattern: Column, groups: Column) -> Column:
    """struct(severity, message, stamp, service, host, component, trace_id, span_id, attributes) of an event by its row's policy; null where the
    pattern is null or doesn't fit its first line.

    Continuation lines follow the message as they are; without a message group the whole event is the message. Assignments in the message
    go before attributes of the header that have the same name.
    """
    line = first_line(log)
    rest = F.when(F.instr(log, "\n") > 0, F.substr(log, F.instr(log, "\n"))).otherwise("")

    def made(got: Column) -> Column:
        of = lambda k: F.try_element_at(got, F.lit(k))
        level = F.upper(of("severity"))
        names = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
        claimed = F.transform_keys(F.map_filter(got, lambda k, v: F.startswith(k, F.lit("attr:"))), lambda k, v: F.substr(k, F.lit(6)))

        def told(message: Column) -> Column:
            attributes = let(explicit(message), lambda said: F.map_concat(said, F.map_filter(claimed, lambda k, v: ~F.map_contains_key(said, k))))
            return F.struct(
                F.coalesce(F.try_element_at(names, level), level).alias("severity"), message.alias("message"), of("timestamp").alias("stamp"), of("service").alias("service"), of("host").alias("host"),
                of("component").alias("component"), of("trace_id").alias("trace_id"), of("span_id").alias("span_id"), attributes.alias("attributes"),
            )

        return let(F.coalesce(F.concat(of("message"), rest), log), told)

    return F.when(matches(line, pattern), let(captured(line, pattern, groups), made))


def assigned(events: DataFrame, assignments: DataFrame, policies: DataFrame, stream: str = "stream") -> DataFrame:
    """``events`` with the policy of their stream: policy_id, pattern and groups, null where it has none or an unfit one.

    ``assignments`` (stream, policy_id) holds a row a stream; ``policies`` is ``compiled``. Streams are joined by key, so their number is no part of the plan.
    """
    return events.join(held(assignments, policies), F.col(stream) == F.col("_stream"), "left").drop("_stream")


def held(assignments: DataFrame, policies: DataFrame) -> DataFrame:
    """(_stream, policy_id, pattern, groups) of the streams that have a fit policy."""
    fit = policies.where("fault IS NULL").select("policy_id", "pattern", "groups")
    return assignments.select(F.col("stream").alias("_stream"), "policy_id").dropDuplicates(["_stream"]).join(fit, "policy_id")


def sampled(lines: DataFrame, most: int = SAMPLES) -> DataFrame:
    """(stream, nth, sample): the first ``most`` lines of each stream (stream, ordinal, line) that aren't blank. A sample is bounded by what it is for."""
    rows = lines.where(F.col("line").rlike(r"(?U)\S"))
    nth = F.row_number().over(W.partitionBy("stream").orderBy("ordinal")) - 1
    return rows.select("stream", nth.alias("nth"), F.col("line").alias("sample")).where(F.col("nth") < most)


def signatures(samples: DataFrame) -> DataFrame:
    """(stream, signature): what a stream's samples look like without their numbers: 24 hex digits, equal for equal formats in equal order."""
    head = F.left(F.substring_index("sample", "\n", 1), F.lit(500))
    head = F.regexp_replace(F.regexp_replace(head, r"(?U)\d+", "#"), "[0-9a-fA-F]{8,}", "<HEX>")
    rows = samples.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("nth", head.alias("head")))).alias("heads"))  # SAMPLES at most
    joined = F.array_join(F.transform("heads", lambda x: x["head"]), "\n")
    return rows.select("stream", F.left(F.sha2(joined, 256), F.lit(24)).alias("signature"))


def shape(sample: Column) -> Column:
    """A sample's first line with stamps, addresses, hex words and numbers as labels."""
    head = F.left(F.substring_index(sample, "\n", 1), F.lit(500))
    for pattern, by in SHAPES:
        head = F.regexp_replace(head, "(?U)" + pattern, by)
    return F.left(F.trim(head), F.lit(220))


def representative(samples: DataFrame, limit: int = TEACHING) -> DataFrame:
    """(stream, pick, nth, sample): up to ``limit`` samples of each stream that show what it has, in the order in which they are picked.

    First the first sample of each shape; then samples spread evenly over the stream's; then the rest in order. ``nth`` counts from 0 without gaps.
    """
    by_shape = W.partitionBy("stream", "shape").orderBy("nth")
    rows = samples.withColumn("shape", shape(F.col("sample"))).withColumn("first", F.row_number().over(by_shape) == 1)
    rows = rows.withColumn("size", F.count("*").over(W.partitionBy("stream")))
    most = F.least(F.lit(limit), F.col("size"))
    # the places round(i (size - 1) / (most - 1)), halves to even; a sample at one of them is spread
    spread = F.when(most == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.bround(i * (F.col("size") - 1) / F.greatest(most - 1, F.lit(1))).cast("int")))
    rows = rows.withColumn("turn", F.when(F.col("first"), 0).when(F.array_contains(spread, F.col("nth")), 1).otherwise(2))
    pick = F.row_number().over(W.partitionBy("stream").orderBy("turn", "nth"))
    return rows.withColumn("pick", pick).where(F.col("pick") <= limit).select("stream", "pick", "nth", "sample")


def _family(line: Column) -> Column:
    """The shapes of a line's first four tokens and their lengths in steps of four: runs of digits as D, of letters as A, repeated marks once."""
    tokens = F.slice(F.filter(F.split(line, r"(?U)\s+"), lambda t: t != ""), 1, 4)

    def shaped(t: Column) -> Column:
        kinds = F.regexp_replace(F.regexp_replace(F.left(t, F.lit(48)), r"(?U)\p{L}", "A"), r"(?U)\d", "D")
        return F.concat_ws(":", F.regexp_replace(kinds, r"(?s)(.)\1+", "$1"), F.least(F.floor(F.length(t) / 4), F.lit(8)).cast("string"))

    return F.array_join(F.transform(tokens, shaped), "|")


def contrasted(samples: DataFrame, pattern: Column, missed: int = MISSED, matched: int = MATCHED) -> DataFrame:
    """(stream, matched, pick, nth, sample): the lines by which a pattern is mended: up to ``missed`` that it misses and ``matched`` that it fits, of each stream.

    Families (``_family``) take turns in the order of their first lines, each with its lines in order, so no frequent form hides a rare one. Lines of a family
    that differ in numbers alone count once. ``pattern`` is a column of ``samples``; where it is null nothing fits.
    """
    alike = F.trim(F.regexp_replace(F.regexp_replace(F.left("sample", F.lit(200)), r"(?U)\d+", "<N>"), r"(?U)\s+", " "))
    rows = samples.withColumn("matched", F.coalesce(matches(F.col("sample"), pattern), F.lit(False))).withColumn("family", _family(F.col("sample"))).withColumn("alike", alike)
    group = ["stream", "matched"]
    rows = rows.withColumn("once", F.row_number().over(W.partitionBy(*group, "family", "alike").orderBy("nth"))).where("once = 1")
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy(*group, "family").orderBy("nth"))).withColumn("lead", F.min("nth").over(W.partitionBy(*group, "family")))
    rows = rows.withColumn("pick", F.row_number().over(W.partitionBy(*group).orderBy("turn", "lead")))
    return rows.where(F.col("pick") <= F.when(F.col("matched"), matched).otherwise(missed)).select("stream", "matched", "pick", "nth", "sample")


@F.pandas_udf(IntegerType())
def _start(line: pd.Series, regex: pd.Series, group: pd.Series) -> pd.Series:
    """Where a group begins in a line; -1 if it has no part."""
    held = {p: re.compile(p) for p in regex.dropna().unique()}
    found = ((held[p].match(x) if isinstance(x, str) and isinstance(p, str) and g == g else None, g) for x, p, g in zip(line, regex, group, strict=True))
    return pd.Series([m.start(int(g)) if m else -1 for m, g in found], dtype="int32")


def admitted(samples: DataFrame, policies: DataFrame, least: float = ADMITTED) -> DataFrame:
    """(policy_id, samples, passed, ratio, admitted, fault): whether each policy reads its samples (policy_id, sample) well enough.

    A sample passes if the pattern fits; the message isn't blank, its group has caught it and, where header fields are claimed, it doesn't begin the line; each claimed
    field and attribute is filled; and a claimed time that is an instant lies in the years YEARS. A policy with a fault, or without samples, isn't admitted.
    """
    # policies are few and texts many: no text is shuffled for its policy's sake, and what can't pass isn't read further
    rows = samples.join(F.broadcast(policies), "policy_id").withColumn("line", F.when(F.col("fault").isNull(), first_line(F.col("sample"))))
    line, full, of = F.col("line"), F.concat(F.lit("(?U)^(?:"), F.col("pattern"), F.lit(")")), F.col("groups")
    caught = lambda group: F.call_function("regexp_extract", line, full, group)
    none = F.lit(None).cast("string")
    stamp = F.regexp_replace(caught(F.try_element_at(of, F.lit("timestamp"))), r"(?U)^\s+|\s+$", "")
    year = F.year(F.timestamp_micros(times.resolve(stamp, none, none)[0]))
    timely = F.when(F.map_contains_key(of, F.lit("timestamp")), year.isNull() | year.between(*YEARS)).otherwise(True)
    body = F.map_contains_key(of, F.lit("message"))
    filled = F.forall(F.map_values(of), lambda group: caught(group).rlike(r"(?U)\S"))  # the message too, where it is claimed
    # instr keeps a pattern until the next; rlike compiles a row's pattern for each row
    fits = F.regexp_instr(line, full) > 0
    reads = F.when(fits, F.when(filled, (body | F.col("sample").rlike(r"(?U)\S")) & timely))
    rows = rows.select("policy_id", "regex", "line", F.coalesce(reads, F.lit(False)).alias("reads"), F.try_element_at(of, F.lit("message")).alias("said"), (F.size(of) > 1).cast("int").alias("from"))
    asked = F.col("reads") & F.col("said").isNotNull()
    ok = F.col("reads") & (F.col("said").isNull() | (_start(F.when(asked, F.col("line")), F.when(asked, F.col("regex")), "said") >= F.col("from")))
    counted = rows.groupBy("policy_id").agg(F.count("*").alias("samples"), F.count_if(F.coalesce(ok, F.lit(False))).alias("passed"))
    out = policies.select("policy_id", "fault").join(counted, "policy_id", "left").na.fill(0, ["samples", "passed"])
    passed = F.when(F.col("fault").isNull(), F.col("passed")).otherwise(0)
    out = out.withColumn("passed", passed).withColumn("ratio", F.when(F.col("samples") > 0, F.col("passed") / F.col("samples")).otherwise(0.0))
    return out.select("policy_id", "samples", "passed", "ratio", (F.col("ratio") >= least).alias("admitted"), "fault")
