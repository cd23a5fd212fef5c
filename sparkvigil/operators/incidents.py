"""Correlation of signals, incidents, their context, root causes and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .graph import components, written

GAP_MS, SAME_SERVICE_MS, TOPOLOGY_MS = 300_000, 180_000, 60_000
ROOTS, CONTEXT_TEMPLATES = 5, 20
#: Sizes of the buckets of time: gap_ms times a power of eight, up to some twenty years for five minutes.
LEVELS = 8


def _mentions(rows: DataFrame) -> DataFrame:
    """(text, names): the services, of three characters or more, that each different text holds. They meet by the name's first three."""
    names = rows.where(F.length("svc") >= 3).select("svc").distinct().select("svc", F.lower("svc").alias("low"), F.left(F.lower("svc"), F.lit(3)).alias("gram"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring("text", i, 3)))
    texts = rows.where(F.length("text") >= 3).select("text").distinct().select("text", F.explode(grams).alias("gram"))
    return texts.join(names, "gram").where(F.contains("text", F.col("low"))).groupBy("text").agg(F.collect_set("svc").alias("names"))


def _meetings(rows: DataFrame, paths: DataFrame | None, gap_ms: int) -> DataFrame:
    """Pairs (a_..., b_...) of ``rows`` that time and one of the rules of ``correlate`` may link; a pair may come more than once.

    Both sides carry keys: what the classes of a root and a cascade, or of two roots, are within a service (rc, cr, rr), the own service against those that the
    other's text names or its topology reaches (m), and the reverse (n). b starts in the time that a covers, in buckets of
    ``gap_ms`` times a power of eight: a long signal takes wider ones, so it is in about eight of them, however long it is.
    """
    found = rows.join(_mentions(rows), "text", "left").withColumn("names", F.coalesce("names", F.expr("cast(array() as array<string>)")))
    if paths is not None:
        hops = paths.where("hops between 1 and 2").select("src", "dst")
        around = hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy(F.col("src").alias("svc")).agg(F.collect_set("dst").alias("around"))
        found = found.join(around, "svc", "left").withColumn("around", F.coalesce("around", F.expr("cast(array() as array<string>)")))
    else:
        found = found.withColumn("around", F.expr("cast(array() as array<string>)"))
    tagged = lambda tag, names: F.transform(names, lambda x: F.concat(F.lit(tag), x))
    own = F.when(F.col("svc") != "", F.array("svc")).otherwise(F.expr("cast(array() as array<string>)"))
    none = F.expr("cast(array() as array<string>)")
    root, cascade = F.col("kind").isin(*P.ROOT_CLASSES), F.col("kind").isin(*P.CASCADE_CLASSES)
    # a root and a cascade meet, and roots of different classes; cascades, or roots of one class, of a busy service don't
    a_class = F.when(root, F.concat(tagged("rc:", own), F.transform(own, lambda x: F.concat(F.lit("rr:"), F.col("kind"), F.lit(":"), x)))).when(cascade, tagged("cr:", own)).otherwise(none)
    others = F.filter(F.array(*[F.lit(k) for k in P.ROOT_CLASSES]), lambda k: k != F.col("kind"))
    b_class = F.when(root, F.concat(tagged("cr:", own), F.flatten(F.transform(own, lambda x: F.transform(others, lambda k: F.concat(F.lit("rr:"), k, F.lit(":"), x)))))).when(cascade, tagged("rc:", own)).otherwise(none)
    a_keys = F.concat(a_class, tagged("m:", own), tagged("n:", F.col("names")))
    b_keys = F.concat(b_class, tagged("m:", F.array_union("names", "around")), tagged("n:", own))

    low, high = F.expr(f"first div {gap_ms}"), F.expr(f"greatest(last, first) div {gap_ms} + 1")
    level = F.least(F.lit(LEVELS - 1), F.floor(F.log2(high - low + 1) / 3).cast("int"))
    a = found.withColumn("level", level).withColumn("low", low).withColumn("high", high)
    a = a.withColumn("bucket", F.explode(F.expr("sequence(shiftright(low, 3 * level), shiftright(high, 3 * level))"))).withColumn("key", F.explode(a_keys))
    used = F.broadcast(rows.select(level.alias("level")).distinct())  # LEVELS rows at most
    b = found.withColumn("low", low).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).join(used, "level", "left_semi")
    b = b.withColumn("bucket", F.expr("shiftright(low, 3 * level)")).withColumn("key", F.explode(b_keys))
    at = ["key", "level", "bucket"]
    return a.select(*at, *[F.col(c).alias("a_" + c) for c in rows.columns]).hint("merge").join(b.select(*at, *[F.col(c).alias("b_" + c) for c in rows.columns]), at).drop(*at)


def correlate(signals: DataFrame, paths: DataFrame | None = None, gap_ms: int = GAP_MS) -> DataFrame:
    """Edges (source, target, score, evidence, time_gap_ms, source_service, target_service, dependency_path).

    ``signals`` holds signal_id, first_seen_ms, last_seen_ms, template_id, template, alarm_type, severity_min and
    service; untimed ones take no part. A pair (a before b, at most ``gap_ms`` from a's end to b's start) is
    linked by, in this order: a text that names the other's service (.78); within a service and three minutes,
    a root class and its cascade (.75) or two root classes (.65); then topology, ``paths`` (src depends on dst), of one hop (.82)
    or two (.72) where that scores more. Pairs meet by what links them and by time, see ``_meetings``.
    """
    rows = signals.where("first_seen_ms is not null and last_seen_ms is not null").select(
        "signal_id", F.col("first_seen_ms").alias("first"), F.col("last_seen_ms").alias("last"), "template_id",
        F.lower(F.coalesce("template", F.lit(""))).alias("text"), F.coalesce(T.known(F.col("service")), F.lit("")).alias("svc"),
        T.failure_class(F.col("template"), F.col("alarm_type"), F.col("severity_min")).alias("kind"),
    )
    rows = written(rows, "timed")  # read six times
    later = (F.col("b_first") > F.col("a_first")) | ((F.col("b_first") == F.col("a_first")) & (F.col("b_signal_id") > F.col("a_signal_id")))
    gap = F.greatest(F.lit(0), F.col("b_first") - F.col("a_last"))
    same = (F.col("a_svc") != "") & (F.col("a_svc") == F.col("b_svc"))
    pairs = _meetings(rows, paths, gap_ms).where(later & (gap <= gap_ms)).where(~(same & F.coalesce(F.col("a_template_id") == F.col("b_template_id"), F.lit(False))))
    root = lambda c: F.col(c).isin(*P.ROOT_CLASSES)
    cascade = lambda c: F.col(c).isin(*P.CASCADE_CLASSES)
    names = lambda x, y: (F.length(x) >= 3) & F.contains(F.col(y), F.lower(F.col(x)))
    near = same & (gap <= SAME_SERVICE_MS)

    def edge(score: float, forward: bool, *evidence: str) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(forward).alias("forward"), F.array(*[F.lit(e) for e in evidence]).alias("evidence"))

    by_text = (
        F.when(names("a_svc", "b_text"), edge(0.78, True, "text_reference", "time_proximity"))
        .when(names("b_svc", "a_text"), edge(0.78, False, "text_reference", "time_proximity"))
        .when(near & root("b_kind") & cascade("a_kind"), edge(0.75, False, "root_class_first", "cascade_follows"))
        .when(near & root("a_kind") & cascade("b_kind"), edge(0.75, True, "root_class_first", "cascade_follows"))
        .when(near & root("a_kind") & root("b_kind") & (F.col("a_kind") != F.col("b_kind")), edge(0.65, True, "layers_fail_together"))
    )
    pairs = pairs.withColumn("edge", by_text)
    if paths is not None:
        hops = paths.where("hops between 1 and 2")
        forth = hops.select(F.col("src").alias("a_svc"), F.col("dst").alias("b_svc"), F.col("hops").alias("hops_ab"), F.col("path").alias("path_ab"))
        back = hops.select(F.col("dst").alias("a_svc"), F.col("src").alias("b_svc"), F.col("hops").alias("hops_ba"), F.col("path").alias("path_ba"))
        pairs = pairs.join(forth, ["a_svc", "b_svc"], "left").join(back, ["a_svc", "b_svc"], "left")
        # a depends on b: b is the root; else b depends on a
        reverse = F.col("hops_ab").isNotNull()
        count = F.coalesce("hops_ab", "hops_ba")
        first, dependent = F.when(reverse, F.col("b_first")).otherwise(F.col("a_first")), F.when(reverse, F.col("a_first")).otherwise(F.col("b_first"))
        score = F.when(count == 1, 0.82).otherwise(0.72)
        fits = count.isNotNull() & (F.col("a_svc") != F.col("b_svc")) & (first <= dependent + TOPOLOGY_MS) & (score > F.coalesce(F.col("edge.score"), F.lit(0.0)))
        topo = F.struct(score.alias("score"), (~reverse).alias("forward"), F.array(F.lit("service_topology"), F.concat(count.cast("string"), F.lit("_hop"))).alias("evidence"))
        pairs = pairs.withColumn("edge", F.when(fits, topo).otherwise(F.col("edge"))).withColumn("path", F.coalesce("path_ab", "path_ba"))
    else:
        pairs = pairs.withColumn("path", F.lit(None).cast("array<string>"))
    pick = lambda c, d: F.when(F.col("edge.forward"), F.col(c)).otherwise(F.col(d))
    edges = pairs.where(F.col("edge.score") >= 0.55).select(
        pick("a_signal_id", "b_signal_id").alias("source"), pick("b_signal_id", "a_signal_id").alias("target"), F.col("edge.score").alias("score"), F.col("edge.evidence").alias("evidence"),
        F.abs(F.col("b_first") - F.col("a_first")).alias("time_gap_ms"), F.coalesce(F.nullif(pick("a_svc", "b_svc"), F.lit("")), F.lit("unknown_service")).alias("source_service"),
        F.coalesce(F.nullif(pick("b_svc", "a_svc"), F.lit("")), F.lit("unknown_service")).alias("target_service"), F.col("path").alias("dependency_path"),
        F.struct("a_first", "a_signal_id", "b_first", "b_signal_id").alias("at"),
    )
    best = F.row_number().over(W.partitionBy("source", "target").orderBy(F.col("score").desc(), "at"))
    return edges.withColumn("n", best).where("n = 1").drop("n", "at")


def cluster(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """(signal_id, cluster): components of the edges between given signals, and of signals of one workload and failure domain."""
    ids = signals.select("signal_id")
    known = edges.join(ids.withColumnRenamed("signal_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("signal_id", "target"), "target", "left_semi")
    placed = signals.select("signal_id", F.coalesce(T.known(F.col("service")), F.lit("unknown")).alias("w"), T.failure_domain(F.col("template")).alias("d"))
    lead = placed.groupBy("w", "d").agg(F.min("signal_id").alias("lead"))
    alike = placed.join(lead, ["w", "d"]).select(F.col("signal_id").alias("a"), F.col("lead").alias("b"))
    return components(known.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(alike)).select(F.col("node").alias("signal_id"), F.col("root").alias("cluster"))


def _marks(signals: DataFrame) -> DataFrame:
    text = F.trim(F.coalesce("template", F.lit("")))
    noise = text.rlike(P.NOISE_SNIPPET) | (F.length(text) < 15)
    failure = T.matches(text, P.ROOT_FAILURE_WORDS)
    return (
        signals.withColumn("is_noise", noise).withColumn("is_root", failure).withColumn("is_symptom", T.matches(text, P.SYMPTOM_WORDS))
        .withColumn("is_progress", T.matches(text, P.PROGRESS_WORDS) & ~failure).withColumn("workload", F.coalesce(T.known(F.col("service")), F.lit("unknown")))
    )


def incidents(signals: DataFrame, edges: DataFrame, known: DataFrame | None = None, ttl_ms: int = 86_400_000) -> DataFrame:
    """Incidents of the qualified signals.

    A cluster is one if a member that isn't noise tells of a root failure or a symptom, and it has more than one
    signal or pod, or five events. The root signal is the first by: not noise, not progress, root failure, no symptom,
    severity, most outgoing edges, time, id. ``known`` (problem_key, incident_id, last_seen_ms) makes an incident
    active if its problem was seen within ``ttl_ms`` before its end; otherwise it is new.
    """
    good = _marks(signals.where("qualified"))
    members = good.join(cluster(good, edges), "signal_id")
    out_degree = edges.groupBy(F.col("source").alias("signal_id")).agg(F.count("*").alias("outgoing"))
    members = members.join(out_degree, "signal_id", "left").withColumn("outgoing", F.coalesce("outgoing", F.lit(0)))
    rank = F.struct(F.col("is_noise").cast("int").alias("a"), F.col("is_progress").cast("int").alias("b"), (-F.col("is_root").cast("int")).alias("c"), F.col("is_symptom").cast("int").alias("d"), F.col("severity_min").alias("e"), (-F.col("outgoing")).alias("f"), F.col("first_seen_ms").isNull().alias("g"), F.col("first_seen_ms").alias("h"), F.col("signal_id").alias("i"))
    pods = F.size(F.array_distinct(F.flatten(F.collect_list("pod_names")))) if "pod_names" in signals.columns else F.lit(0)
    pods = F.greatest(pods, F.count_distinct(F.when(F.col("identity") != "unknown", F.col("identity")))) if "identity" in signals.columns else pods
    timed = (F.count("first_seen_ms") == F.count("*")) & (F.count("last_seen_ms") == F.count("*"))
    strings = lambda c: F.array_sort(F.collect_set(c))
    got = members.groupBy("cluster").agg(
        F.max((~F.col("is_noise") & (F.col("is_root") | F.col("is_symptom"))).cast("int")).alias("told"), pods.alias("pods"),
        F.sum("count").alias("event_count"), F.count("*").alias("signal_count"), F.min("severity_min").alias("severity_min"),
        F.round(F.max("qualification_score"), 3).alias("qualification_score"), F.when(timed, F.min("first_seen_ms")).alias("start_ms"), F.when(timed, F.max("last_seen_ms")).alias("end_ms"),
        strings(F.when(F.col("workload") != "unknown", F.col("workload"))).alias("services"), strings(F.coalesce("component", F.lit("unknown"))).alias("components"),
        strings("template_id").alias("template_ids"), strings("signal_id").alias("signal_ids"), F.min_by(F.struct("signal_id", "workload", "template", (F.col("alarm_type") if "alarm_type" in signals.columns else F.lit(None).cast("string")).alias("alarm_type")), rank).alias("root"),
    ).where((F.col("told") == 1) & ((F.col("signal_count") > 1) | (F.col("pods") > 1) | (F.col("event_count") >= 5)))
    ends = members.select(F.col("signal_id").alias("source"), F.col("cluster").alias("sc")), members.select(F.col("signal_id").alias("target"), F.col("cluster").alias("tc"))
    inner = edges.join(ends[0], "source").join(ends[1], "target").where("sc = tc").groupBy(F.col("sc").alias("cluster")).agg(F.count("*").alias("correlation_count"))
    got = got.join(inner, "cluster", "left").withColumn("correlation_count", F.coalesce("correlation_count", F.lit(0)))
    domain = T.failure_domain(F.col("root.template"))
    got = got.withColumn("domain", domain).withColumn("problem_key", F.concat_ws(":", F.col("root.workload"), "domain"))
    if known is not None:
        seen = known.select("problem_key", F.col("incident_id").alias("known_id"), F.col("last_seen_ms").alias("seen_ms"))
        got = got.join(seen, "problem_key", "left").withColumn("active", F.col("known_id").isNotNull() & (F.coalesce("end_ms", "seen_ms") - F.col("seen_ms") <= ttl_ms))
    else:
        got = got.withColumn("active", F.lit(False)).withColumn("known_id", F.lit(None).cast("string"))
    fresh = F.concat(F.lit("inc:"), F.substring(F.sha2("problem_key", 256), 1, 32))
    return got.select(
        F.when(F.col("active"), F.col("known_id")).otherwise(fresh).alias("incident_id"), "cluster", "problem_key", F.when(F.col("active"), "active").otherwise("open").alias("status"), (~F.col("active")).alias("is_new"),
        "start_ms", "end_ms", "event_count", "signal_count", (F.col("correlation_count") > 0).alias("correlated"), "correlation_count", "severity_min", "qualification_score", F.lit(0.88).alias("confidence"),
        "services", "components", "template_ids", "signal_ids", F.col("root.template").alias("root_cause_template"), F.col("root.signal_id").alias("root_signal_id"), F.col("root.workload").alias("root_entity"), F.col("domain").alias("root_domain"), F.col("root.alarm_type").alias("root_alarm_type"),
    )


def foremost(found: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` incidents by severity, start (untimed last) and id, with their place from 1; the first is the primary one. A report, so its limit is the feature."""
    order = [F.col("severity_min").asc_nulls_last(), F.col("start_ms").asc_nulls_last(), F.col("incident_id")]
    return found.orderBy(*order).limit(most).withColumn("place", F.row_number().over(W.orderBy(*order)))


def confirmed(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Ids of the signals that an operator-confirmed rule fits: its root signal's text, or two of its keywords of over 4 characters.

    ``rules`` (root_text, keywords array) is a control table that operators write by hand; only its confirmed rows are given here.
    """
    text = F.lower(F.coalesce("template", F.lit("")))
    hits = F.size(F.filter("keywords", lambda k: (F.length(k) > 4) & F.contains(text, F.lower(k)))) >= 2
    whole = (F.coalesce(F.col("root_text"), F.lit("")) != "") & F.contains(text, F.lower("root_text"))
    return signals.join(rules, hits | whole, "left_semi").select("signal_id")


def rank_roots(found: DataFrame, edges: DataFrame, signals: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(incident_id, rank, signal_id, score, evidence): the ROOTS likeliest root causes of each incident.

    Ordered by: not synthetic, confirmed by an operator, the incident's own root, infrastructure words, no symptom, severity, outgoing
    edges within the incident, time, qualification, id. The score falls by .12 a rank from .85, to .40 at least, and
    rises by .03 an outgoing edge, by .15 and to .98 at most; a confirmed first is .99.
    """
    each = found.select("incident_id", "root_signal_id", F.explode("signal_ids").alias("signal_id"))
    members = each.select("incident_id", "signal_id")
    source, target = members.withColumnRenamed("signal_id", "source"), members.withColumnRenamed("signal_id", "target").withColumnRenamed("incident_id", "other")
    degree = edges.join(source, "source").join(target, "target").where("incident_id = other").groupBy("incident_id", F.col("source").alias("signal_id")).agg(F.count("*").alias("outgoing"))
    rows = each.join(signals.select("signal_id", "template", "severity_min", "first_seen_ms", "qualification_score", "qualification_evidence"), "signal_id").join(degree, ["incident_id", "signal_id"], "left")
    rows = rows.withColumn("outgoing", F.coalesce("outgoing", F.lit(0)))
    if rules is not None:
        rows = rows.join(confirmed(signals, rules).withColumn("confirmed", F.lit(True)), "signal_id", "left")
    rows = rows.withColumn("confirmed", F.coalesce("confirmed", F.lit(False)) if rules is not None else F.lit(False))
    synthetic = F.startswith("signal_id", F.lit("monitor:")) | F.contains("signal_id", F.lit("baseline"))
    order = [synthetic, ~F.col("confirmed"), F.col("signal_id") != F.col("root_signal_id"), ~T.matches(F.col("template"), P.INFRA_ROOT_WORDS), T.matches(F.col("template"), P.RCA_SYMPTOM_WORDS), F.col("severity_min"), F.col("outgoing").desc(), F.col("first_seen_ms").asc_nulls_last(), F.col("qualification_score").desc(), F.col("signal_id")]
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("incident_id").orderBy(*order)) - 1).where(F.col("rank") < ROOTS)
    base = F.greatest(F.lit(0.40), 0.85 - 0.12 * F.col("rank")) + F.least(F.lit(0.15), 0.03 * F.col("outgoing"))
    score = F.when(F.col("confirmed") & (F.col("rank") == 0), 0.99).otherwise(F.round(F.least(F.lit(0.98), base), 3))
    extra = F.array_compact(F.array(F.when(F.col("confirmed"), F.lit("operator_confirmed")), F.when(F.col("outgoing") > 0, F.concat(F.lit("triggers_"), F.col("outgoing").cast("string")))))
    return rows.select("incident_id", "rank", "signal_id", score.alias("score"), F.concat("qualification_evidence", extra).alias("evidence"))


#: Fixed values: (owner, next step, alarm type parts, entity endings, template parts), in the order in which they are tried.
OWNERS = (
    ("Database Operations", "verify_db_connection_pool_and_sessions", ("database", "db_"), ("-db",), ("operationalerror", "psycopg", "deadlock", "closed the connection", "can't reconnect")),
    ("Network Operations", "check_network_connectivity_and_firewall", ("network",), ("-gw",), ("connection refused", "no route to host", "broken pipe", "socket closed")),
    ("Platform / Infrastructure SRE", "inspect_pod_memory_and_restart_history", ("oom", "resource"), (), ("out of memory", "oomkilled", "heap space", "gc_pressure")),
    ("Integration / Storage Operations", "verify_storage_credentials_and_bucket_access", ("storage", "ext_"), (), ("nosuchkey", "bucket", "failed to download", "s3:")),
)
CODE_PARTS = ("traceback", "panic:", "nullpointer", "keyerror", "indexerror")


def owner_of(template: Column, alarm_type: Column, entity: Column) -> Column:
    """struct(owner, step) of the first rule that fits."""
    text, kind = F.lower(F.coalesce(template, F.lit(""))), F.lower(F.coalesce(alarm_type, F.lit("")))
    entity = F.coalesce(entity, F.lit("unknown"))
    made = lambda o, s: F.struct(o.alias("owner"), F.lit(s).alias("step"))
    out = None
    for owner, step, kinds, endings, parts in OWNERS:
        fits = F.lit(False)
        for k in kinds:
            fits = fits | F.contains(kind, F.lit(k))
        for e in endings:
            fits = fits | F.endswith(entity, F.lit(e))
        if owner == "Network Operations":
            fits = fits | F.contains(entity, F.lit("provider"))
        for p in parts:
            fits = fits | F.contains(text, F.lit(p))
        out = (F if out is None else out).when(fits, made(F.lit(owner), step))
    code = F.lit(False)
    for p in CODE_PARTS:
        code = code | F.contains(text, F.lit(p))
    named = F.concat(F.when(entity != "unknown", entity).otherwise("Application"), F.lit(" Service Owner"))
    out = out.when(code, made(named, "investigate_application_traceback_and_rollback"))
    return out.otherwise(made(F.when(entity != "unknown", F.concat(entity, F.lit(" Service Owner"))).otherwise("SRE / NOC"), "prepare_operator_review"))


def plan(found: DataFrame, roots: DataFrame) -> DataFrame:
    """One plan an incident: who looks at what next. Nothing is ever executed without a human."""
    candidates = roots.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("rank", "signal_id", "score", "evidence"))).alias("root_cause_candidates"))
    who = owner_of(F.col("root_cause_template"), F.col("root_alarm_type"), F.col("root_entity"))
    return found.withColumn("who", who).join(candidates, "incident_id", "left").select(
        "incident_id", F.col("who.step").alias("recommended_next_step"), F.col("who.owner").alias("owner"), "status", F.coalesce("start_ms", "end_ms").alias("opened_at_ms"),
        F.lit(False).alias("execution_allowed"), F.lit(True).alias("requires_human_approval"), F.col("signal_count").alias("evidence_count"), "confidence", "root_cause_candidates",
    )


def context(found: DataFrame, signals: DataFrame, inventory: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """(incident_id, templates, services, hosts, host_inventory, dependencies): templates ordered root first, then severity, then count; 20 at most, 40 paths at most."""
    each = found.select("incident_id", "root_signal_id", F.explode("signal_ids").alias("signal_id")).join(signals, "signal_id")
    per = each.groupBy("incident_id", "template").agg(F.max((F.col("signal_id") == F.col("root_signal_id")).cast("int")).alias("is_root"), F.min("severity_min").alias("severity"), F.sum("count").alias("count"))
    order = W.partitionBy("incident_id").orderBy(F.col("is_root").desc(), "severity", F.col("count").desc(), "template")
    top = per.withColumn("n", F.row_number().over(order)).where(F.col("n") <= CONTEXT_TEMPLATES)
    out = top.groupBy("incident_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "template", "count", "severity"))), lambda x: F.struct(x["template"], x["count"], x["severity"])).alias("templates"))
    sets = each.groupBy("incident_id").agg(F.array_sort(F.collect_set(T.known(F.col("service")))).alias("services"), F.array_sort(F.collect_set(T.known(F.col("host")))).alias("hosts"))
    out = out.join(sets, "incident_id")
    if inventory is not None:
        rows = sets.select("incident_id", F.explode("hosts").alias("host")).join(inventory, "host")
        out = out.join(rows.groupBy("incident_id").agg(F.array_sort(F.collect_set(F.struct(*[c for c in inventory.columns]))).alias("host_inventory")), "incident_id", "left")
    if paths is not None:
        names = sets.select("incident_id", F.explode("services").alias("src"))
        pairs = names.join(paths.where("hops between 1 and 4"), "src").join(names.withColumnRenamed("src", "dst"), ["incident_id", "dst"])
        nth = pairs.withColumn("n", F.row_number().over(W.partitionBy("incident_id").orderBy("src", "dst"))).where("n <= 40")
        out = out.join(nth.groupBy("incident_id").agg(F.sort_array(F.collect_list("path")).alias("dependencies")), "incident_id", "left")
    return out
