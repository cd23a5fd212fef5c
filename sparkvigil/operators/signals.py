"""Signals: events rolled up by template, identity and window, and the noise gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .quality import basis_counts

#: A signal names so many of its events.
IDS = 8

#: The sets of a signal, and the column of an event that each collects.
SETS = {
    "pod_names": "pod_name", "pod_template_hashes": "pod_template_hash", "service_ids": "service_id", "hosts": "host_name", "data_centers": "data_center", "racks": "rack",
    "environments": "environment", "business_criticalities": "business_criticality", "source_systems": "source_system", "namespaces": "namespace_name",
}


def _set(name: str) -> Column:
    return F.array_sort(F.collect_set(F.nullif(F.trim(F.col(name)), F.lit(""))))


def aggregate(events: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """One signal for each (alarm_type or template_id, template_id, identity, window).

    ``events`` holds event_id, ts_ms (null: untimed), template_id, template, template_reliable, severity (text),
    service, component, host, and optionally alarm_type, namespace, process_time_ms, source_order and any of the
    columns that SETS names, and basis, of which basis_counts tells how often each occurs. Events without a template go. Untimed events share one window, null. Lists are sorted.
    """
    have = set(events.columns)
    pick = lambda name, kind="string": F.col(name) if name in have else F.lit(None).cast(kind)
    rows = events.where(F.coalesce(F.col("template_id"), F.lit("")) != "")
    service, component, host = (T.known(F.col(c)) for c in ("service", "component", "host"))
    rows = rows.select(
        "*", F.coalesce(service, component, host, F.lit("unknown")).alias("identity"),
        (F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(window_ms))).alias("window_start_ms"),
        T.severity_number(F.col("severity")).alias("severity_number"),
        F.coalesce(F.nullif(F.trim(pick("alarm_type")), F.lit("")), F.col("template_id")).alias("group_type"),
        F.struct(pick("source_order", "bigint").isNull().alias("x"), pick("source_order", "bigint").alias("o"), F.col("event_id").cast("string").alias("id")).alias("order_key"),
    )
    first = lambda c: F.min_by(c, "order_key")
    sets = [_set(c).alias(name) for name, c in SETS.items() if c in have]
    if "basis" in have:
        sets.append(basis_counts(F.col("basis")).alias("basis_counts"))
    out = rows.groupBy("group_type", "template_id", "identity", "window_start_ms").agg(
        F.count("*").alias("count"), F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms"),
        F.min("severity_number").alias("severity_min"), first("template").alias("template"), first("service").alias("service"),
        first("component").alias("component"), first("host").alias("host"), first(pick("alarm_type")).alias("alarm_type"), first(pick("namespace")).alias("namespace"),
        F.round(F.avg(F.col("template_reliable").cast("int")), 4).alias("reliable_ratio"),
        F.round(F.avg(pick("process_time_ms").try_cast("double")), 2).alias("avg_latency"),
        *sets,
    )
    # the first ids are limited on each side of the exchange, so that no group's ids meet in one row
    keys = ["group_type", "template_id", "identity", "window_start_ms"]
    early = rows.select(*keys, "order_key", F.row_number().over(W.partitionBy(*keys).orderBy("order_key")).alias("nth")).where(F.col("nth") <= IDS)
    ids = early.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("order_key")), lambda x: x["id"]).alias("event_ids"))
    ids = ids.select(*[F.col(k).alias("of_" + k) for k in keys], "event_ids")
    same = [F.col(k).eqNullSafe(F.col("of_" + k)) for k in keys]
    out = out.join(ids, same).drop(*["of_" + k for k in keys])
    identity = F.concat_ws("|", "group_type", "template_id", "identity", F.coalesce(F.col("window_start_ms").cast("string"), F.lit("untimed")))
    scope = F.coalesce(F.nullif(F.concat_ws("/", T.known(F.col("namespace")), T.known(F.col("service"))), F.lit("")), T.known(F.col("component")), T.known(F.col("host")), F.lit("general"))
    return out.withColumn("signal_id", F.concat(F.lit("sig:"), F.substring(F.sha2(identity, 256), 1, 32))).withColumn("window_end_ms", F.col("window_start_ms") + window_ms).withColumn(
        "burst_score", F.round(F.least(F.lit(1.0), F.col("count") / 10), 4)
    ).withColumn("scope", scope)


def noise_gate(signals: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Adds qualification_score, qualified, qualification_evidence and qualification_reason.

    Severity gives up to .60, failure words .30, success words without them -.40, a known template .05. From ten
    events on, one pod alone gives .40, else one release alone .30. Signals of the baseline monitor
    (monitor_anomaly not null, or an id that begins with monitor:) pass, unless they are informational or tell of success.
    """
    have = set(signals.columns)
    text, sev = F.coalesce(F.col("template"), F.lit("")), F.coalesce(F.col("severity_min"), F.lit(7))
    failure, success = T.is_failure(text), T.is_success(text)
    pods = F.coalesce(F.size("pod_names"), F.lit(0)) if "pod_names" in have else F.lit(0)
    hashes = F.coalesce(F.size("pod_template_hashes"), F.lit(0)) if "pod_template_hashes" in have else F.lit(0)
    trusted = (F.coalesce(F.col("template_id"), F.lit("")) != "") & ~F.startswith(F.col("template_id"), F.lit("unknown"))
    many = F.coalesce(F.col("count"), F.lit(1)) >= 10
    terms = [
        (sev <= 2, 0.60, "critical_severity"), ((sev > 2) & (sev <= 3), 0.55, "error_severity"), ((sev > 3) & (sev <= 4), 0.20, "warning_severity"),
        (failure, 0.30, "failure_semantics"), (~failure & success, -0.40, "success_penalty"), (trusted, 0.05, "trusted_template"),
        (many & (pods == 1), 0.40, "isolated_to_single_pod"), (many & (pods != 1) & (hashes == 1), 0.30, "isolated_to_single_release"),
    ]
    total = F.lit(0.0)
    for when, points, _ in terms:
        total = total + F.when(when, F.lit(points)).otherwise(0.0)
    # whole hundredths, so that binary sums don't sway the threshold
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2)
    evidence = F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, _, name in terms]))
    monitor = F.coalesce(F.startswith(F.col("signal_id"), F.lit("monitor:")), F.lit(False))
    if "monitor_anomaly" in have:
        monitor = monitor | F.col("monitor_anomaly").isNotNull()
    harmless = ((sev >= 5) | success) & ~failure
    score = F.when(monitor & harmless, F.lit(0.10)).when(monitor, F.lit(1.0)).otherwise(score)
    evidence = F.when(monitor & harmless, F.array(F.lit("successful_operation_filtered"))).when(monitor, F.array(F.lit("monitor_baseline"))).otherwise(evidence)
    out = signals.withColumn("qualification_score", score).withColumn("qualification_evidence", evidence)
    out = out.withColumn("qualified", F.col("qualification_score") >= threshold)
    return out.withColumn("qualification_reason", F.when(F.col("qualified"), "qualified_signal").otherwise("suppressed_as_noise"))


def rollup(signals: DataFrame) -> DataFrame:
    """Signals of one service and template (its first 100 characters) over all windows: counts summed, times spanned, sets united."""
    order = F.struct(F.col("first_seen_ms").isNull(), "first_seen_ms", "signal_id")
    keep = [c for c in signals.columns if c not in ("count", "first_seen_ms", "last_seen_ms", "service", "short", "pod_names")]
    pods = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("pod_names")))).alias("pod_names")] if "pod_names" in signals.columns else []
    return signals.withColumn("short", F.left("template", F.lit(100))).groupBy("service", "short").agg(
        F.sum("count").alias("count"), F.min("first_seen_ms").alias("first_seen_ms"), F.max("last_seen_ms").alias("last_seen_ms"),
        F.array_sort(F.collect_set("signal_id")).alias("aggregated_signal_ids"), F.count("*").alias("windows"),
        *[F.min_by(F.col(c), order).alias(c) for c in keep], *pods,
    ).drop("short")
