"""Whole analyses: logs or alarms to signals, edges, incidents, root causes and plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..operators import incidents as I
from ..operators import parse, segment, signals
from ..operators.graph import dependency_paths, written
from ..sources.readers import PACKAGE_SEVERITY


@dataclass
class Findings:
    signals: DataFrame
    edges: DataFrame
    incidents: DataFrame
    roots: DataFrame
    plans: DataFrame


def downstream(events: DataFrame, dependencies: DataFrame | None = None, rules: DataFrame | None = None, known: DataFrame | None = None, window_ms: int = 60_000) -> Findings:
    """Templated events to findings. ``dependencies`` holds (src, dst): src depends on dst."""
    gated = written(signals.noise_gate(signals.aggregate(events, window_ms)), "signals")
    paths = None if dependencies is None else written(dependency_paths(dependencies, 4), "paths")
    edges = written(I.correlate(signals.rollup(gated.where("qualified")), paths), "edges")
    found = written(I.incidents(gated, edges, known), "incidents")
    roots = I.rank_roots(found, edges, gated, rules)
    return Findings(gated, edges, found, roots, I.plan(found, roots))


def analyse_logs(lines: DataFrame, policy: str | None = None, **options) -> Findings:
    """(stream, ordinal, line) to findings."""
    events = segment.assemble(segment.classify(lines, policy))
    return downstream(parse.templated(parse.canonical(events.select("stream", "event_no", F.col("text").alias("raw")))), **options)


def alarm_events(alarms: DataFrame) -> DataFrame:
    """Structured alarms as templated events; neither parsed nor mined."""
    names = F.create_map(*[F.lit(x) for pair in PACKAGE_SEVERITY.items() for x in pair])
    have = set(alarms.columns)
    message = F.coalesce(F.col("message"), F.col("alarm_type")) if "message" in have else F.col("alarm_type")
    return alarms.select(
        F.col("alarm_id").cast("string").alias("event_id"), F.floor(times.normalise(F.col("timestamp")) / 1000).cast("bigint").alias("ts_ms"), "host", "service", F.lit(None).cast("string").alias("component"),
        F.element_at(names, F.col("severity").cast("int")).alias("severity"), F.lower("alarm_type").alias("alarm_type"), message.alias("template"), F.lit(True).alias("template_reliable"),
        T.alarm_template_id(F.col("service"), F.col("alarm_type")).alias("template_id"),
    )


def analyse_alarms(alarms: DataFrame, dependencies: DataFrame | None = None, **options) -> Findings:
    """A package's alarms to findings; its dependencies in their own columns."""
    links = None if dependencies is None else dependencies.select(F.trim("kaynak_servis").alias("src"), F.trim("hedef_servis").alias("dst"))
    return downstream(alarm_events(alarms), links, **options)
