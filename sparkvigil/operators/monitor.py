"""The windowed monitor: lanes, ownership, watermarks, reconciliation, findings and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import written

QUARANTINE, ESCALATE = 3, 3
# How many findings a run shows, and the kinds and rules that may be shown.
FINDINGS = 10
KINDS = ("total_volume", "log_rate", "pod_volume", "container_volume", "pattern_frequency", "new_pattern", "pattern_disappearance", "error_severity", "pod_error_concentration", "container_error_concentration")
RULES = ("median_mad_and_ratio", "new_template_and_absent_from_recent_history", "at_least_90_percent_of_parsed_errors")


def lane(ts_ms: Column, start: Column, end: Column) -> Column:
    return F.when(ts_ms < start, "PRE_OVERLAP").when(ts_ms < end, "OWNED_WINDOW").otherwise("POST_OVERLAP")


def owned(events: DataFrame, receipts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Adds decision to events (ref, ts_ms, orphan): duplicates of a receipt or of an earlier row first, then orphans, then what lies outside."""
    marked = events.join(receipts.select("ref").distinct().withColumn("_seen", F.lit(True)), "ref", "left")
    again = F.row_number().over(W.partitionBy("ref").orderBy("ts_ms")) > 1
    outside = F.col("ts_ms").isNull() | (lane(F.col("ts_ms"), start, end) != "OWNED_WINDOW")
    decision = F.when(F.coalesce("_seen", F.lit(False)) | again, "duplicate").when(F.col("orphan"), "orphan").when(outside, "outside_window").otherwise("accepted")
    return marked.withColumn("decision", decision).drop("_seen")


def reference_hash(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def contiguous_watermark(runs: DataFrame) -> DataFrame:
    """(monitor_id, watermark_ms): the end of the last window of the unbroken run of SUCCESS from the first.

    ``runs`` holds monitor_id, start_ms, end_ms, status, once a window. A window that failed, is missing or doesn't begin where the last ended stops it.
    """
    order = W.partitionBy("monitor_id").orderBy("start_ms")
    broken = (F.col("status") != "SUCCESS") | (F.coalesce(F.lag("end_ms").over(order), F.col("start_ms")) != F.col("start_ms"))
    rows = runs.withColumn("gaps", F.sum(broken.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy("monitor_id").agg(F.max(F.when(F.col("gaps") == 0, F.col("end_ms"))).alias("watermark_ms"))


def reconcile(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, expected, got, ok): counts agree within max(10, 5 %)."""
    both = expected.join(got, key, "full_outer").withColumn("expected", F.coalesce("expected", F.lit(0))).withColumn("got", F.coalesce("got", F.lit(0)))
    return both.withColumn("ok", F.abs(F.col("expected") - F.col("got")) <= F.greatest(F.lit(10.0), 0.05 * F.col("expected")))


def failure_state(attempts: DataFrame) -> DataFrame:
    """(monitor_id, window, attempts, local, status): WINDOW_LOCAL failures quarantine a window at the third; UNKNOWN ones of one signature escalate at the third; SYSTEMIC block.

    ``attempts`` holds monitor_id, window, attempt, classification and signature.
    """
    local = F.sum((F.col("classification") == "WINDOW_LOCAL").cast("int"))
    same = attempts.where("classification = 'UNKNOWN'").groupBy("monitor_id", "window", "signature").agg(F.count("*").alias("n")).groupBy("monitor_id", "window").agg(F.max("n").alias("same"))
    rows = attempts.groupBy("monitor_id", "window").agg(F.count("*").alias("attempts"), local.alias("local"), F.max((F.col("classification") == "SYSTEMIC").cast("int")).alias("systemic")).join(same, ["monitor_id", "window"], "left")
    status = F.when(F.col("local") >= QUARANTINE, "QUARANTINED").when(F.col("systemic") == 1, "BLOCKED").when(F.col("same") >= ESCALATE, "ESCALATED").otherwise("RETRY")
    return rows.select("monitor_id", "window", "attempts", "local", status.alias("status"))


def findings(incidents: DataFrame, anomalies: DataFrame, most: int = FINDINGS) -> DataFrame:
    """(run_id, nth, kind, ref, title, rule, severity, count, first_seen_ms, last_seen_ms, finding_id): the ``most`` findings that each run shows.

    ``incidents`` holds run_id and incident_id, ``anomalies`` run_id, signal_id, kind and qualified; both may have severity, count, first_seen_ms, last_seen_ms, and anomalies
    rule. Incidents come first, then qualified anomalies; within each by ref, a hash of the id, so that nothing of a source's
    names shows. Titles and rules are those allowed, whatever a row says; a count that is missing is 1.
    """
    def side(rows: DataFrame, kind: str, name: str, title: Column, rule: Column) -> DataFrame:
        pick = lambda c, t: (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
        ref = F.left(F.sha2(F.coalesce(F.col(name).cast("string"), F.lit("")), 256), F.lit(32))
        return rows.select("run_id", F.lit(kind).alias("kind"), ref.alias("ref"), title.alias("title"), rule.alias("rule"), pick("severity", "string"), F.coalesce(pick("count", "bigint"), F.lit(1)).alias("count"), pick("first_seen_ms", "bigint"), pick("last_seen_ms", "bigint"))

    said = F.col("rule") if "rule" in anomalies.columns else F.lit(None).cast("string")
    shown = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("Anomaly")
    rows = side(incidents, "incident", "incident_id", F.lit("Incident"), F.lit(None).cast("string")).unionByName(
        side(anomalies.where("qualified"), "anomaly", "signal_id", shown, F.when(said.isin(*RULES), said)))
    order = W.partitionBy("run_id").orderBy(F.col("kind") == "anomaly", "ref", "title", "count", "first_seen_ms")
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return rows.withColumn("finding_id", F.sha2(F.concat_ws(":", F.col("run_id").cast("string"), "kind", "ref"), 256))


def newest(rows: DataFrame, key: str, at: str, keep: int) -> DataFrame:
    """The ``keep`` newest of each key, one for each time: rings of baselines, findings and registries."""
    once = rows.withColumn("_d", F.row_number().over(W.partitionBy(key, at).orderBy(*[F.col(c) for c in rows.columns if c not in (key, at)]))).where("_d = 1").drop("_d")
    return once.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc()))).where(F.col("_n") <= keep).drop("_n")


def retained(rows: DataFrame, at_ms: str, kind: str, now_ms: int, days: dict[str, int]) -> DataFrame:
    """Rows whose kind's retention, in days, hasn't passed; kinds without one stay."""
    keep = F.lit(True)
    for name, n in days.items():
        keep = keep & ~((F.col(kind) == name) & (F.col(at_ms) < now_ms - n * 86_400_000))
    return rows.where(keep)


def stratified_sample(numbered: DataFrame, strata: int = 10, each: int = 15) -> DataFrame:
    """Of each stream's lines (stream, ordinal, line), the first ``each`` of ``strata`` equal parts; nothing random."""
    order = W.partitionBy("stream").orderBy("ordinal")
    parts = numbered.withColumn("stratum", F.ntile(strata).over(order))
    return parts.withColumn("_n", F.row_number().over(W.partitionBy("stream", "stratum").orderBy("ordinal"))).where(F.col("_n") <= each).drop("_n")


def resolve_policy(lines: DataFrame, policies: list[tuple[str, str]], strict: bool = True) -> DataFrame:
    """(policy_id, matched, missed, streams, rank) of safe policies, best first: most matches, fewest misses, most streams, then id.

    ``lines`` is a bounded sample (stream, line); the policies, at most a hundred or so, are part of the plan. ``strict`` leaves out those without a match.
    """
    hits = [F.col("line").rlike("^(?:" + pattern + ")") for _, pattern in policies]
    # one scan: each stream's counts first, then those of all streams
    each = lines.groupBy("stream").agg(*[F.count_if(h).alias(f"m{i}") for i, h in enumerate(hits)], *[F.count_if(~h).alias(f"x{i}") for i, h in enumerate(hits)])
    row = lambda i, name: F.struct(F.lit(name).alias("policy_id"), F.sum(f"m{i}").alias("matched"), F.sum(f"x{i}").alias("missed"), F.count_if(F.col(f"m{i}") > 0).alias("streams"))
    out = each.agg(F.array(*[row(i, name) for i, (name, _) in enumerate(policies)]).alias("rows")).select(F.inline("rows"))
    out = out.where("matched > 0") if strict else out
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.col("matched").desc(), "missed", F.col("streams").desc(), "policy_id")))


def lineage(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, ref, depth): each of ``roots`` (root), all its ancestors and all its descendants over (parent, child) edges, once each.

    depth counts the least steps to a descendant, and below 0 those to an ancestor; a ref on a cycle is a descendant. There is no
    limit: each direction goes on until its front, written to the checkpoint folder at every step, is empty.
    """
    start = written(roots.select("root", F.col("root").alias("ref"), F.lit(0).alias("depth")).distinct(), "roots")
    down, up = (_reached(edges.select(F.col(a).alias("of"), F.col(b).alias("to")), start, step) for a, b, step in (("parent", "child", 1), ("child", "parent", -1)))
    return down.unionByName(up.join(down.select("root", "ref"), ["root", "ref"], "left_anti"))


def _reached(edges: DataFrame, start: DataFrame, step: int) -> DataFrame:
    found, front, depth = written(start, "found"), start, 0
    path = found.inputFiles()[0].rpartition("/")[0]
    while not front.isEmpty():
        depth += step
        near = front.join(edges, front["ref"] == edges["of"]).select("root", F.col("to").alias("ref"), F.lit(depth).alias("depth")).where("ref is not null").distinct()
        front = written(near.join(found.select("root", "ref"), ["root", "ref"], "left_anti"), "front")
        front.write.mode("append").parquet(path)
        found = start.sparkSession.read.schema(start.schema).parquet(path)
    return found
