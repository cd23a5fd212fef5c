"""The engine's operators over the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import text as T
from .functions import times, variants
from .functions.generalise import generalise
from .operators import anomalies, baseline, evidence, graph, headers, incidents, liveness, monitor, parse, quality, registry, segment, signals, targets
from .operators import policies as line_policies
from .plans.pipeline import downstream
from .sources import hits, readers
from .sources.readers import host_enriched

DAY = 86_400_000
#: What each type of event stands for: (severity, message).
MEANING = {
    "error": ("ERROR", "database deadlock detected while saving"), "purchase": ("WARNING", "request timed out in checkout"),
    "signup": ("INFO", "signup completed successfully"), "click": ("INFO", "click handled"), "view": ("DEBUG", "view rendered"),
}
_SQL_SEVERITY = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (s, _) in MEANING.items()) + " END"
_SQL_MESSAGE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, (_, m) in MEANING.items()) + " END"
_SQL_NUMBER = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 WHEN 'view' THEN 7 ELSE 6 END"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as templated events: a type is a template, a user a pod, and five services share the users."""
    e = _read(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for k, (s, _) in MEANING.items() for x in (k, s)])
    said = F.create_map(*[F.lit(x) for k, (_, m) in MEANING.items() for x in (k, m)])
    return e.select(
        "event_id", "event_type", "user_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.concat(F.lit("tpl_"), "event_type").alias("template_id"),
        said[F.col("event_type")].alias("template"), names[F.col("event_type")].alias("severity"), (F.col("event_type") != "view").alias("template_reliable"),
        F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("service"), F.lit("unknown").alias("component"), F.lit(None).cast("string").alias("host"),
        F.concat(F.lit("pod"), F.col("user_id").cast("string")).alias("pod_name"), F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("pod_template_hash"),
        F.col("event_id").alias("source_order"), (F.col("value") * 10).cast("string").alias("process_time_ms"),
    )


def _signals_sql(window: int) -> str:
    return f"""
SELECT 'tpl_' || event_type AS template_id, 'svc' || (user_id % 5) AS identity, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {window} AS window_start_ms,
  count(*) AS count, min((epoch_us(ts) // 1000)) AS first_seen_ms, max((epoch_us(ts) // 1000)) AS last_seen_ms, min({_SQL_NUMBER}) AS severity_min,
  round(least(1.0, count(*) / 10), 4) AS burst_score, CASE event_type WHEN 'view' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reliable_ratio,
  array_to_string(list_sort(list(DISTINCT 'pod' || user_id)), ',') AS pods, array_to_string(list_sort(list(DISTINCT 'h' || (user_id % 3))), ',') AS hashes,
  array_to_string((list(event_id ORDER BY event_id))[1:8], ',') AS ids, {_SQL_MESSAGE} AS template
FROM events GROUP BY event_type, user_id % 5, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {window}"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        "template_id", "identity", "window_start_ms", "count", "first_seen_ms", "last_seen_ms", "severity_min", "burst_score", "reliable_ratio",
        F.array_join("pod_names", ",").alias("pods"), F.array_join("pod_template_hashes", ",").alias("hashes"), F.array_join("event_ids", ",").alias("ids"), "template",
    )


@_query(_signals_sql(60_000))
def signal_window_60s(spark, sf_dir):
    return _flat(signals.aggregate(_events(spark, sf_dir), 60_000))


@_query(_signals_sql(DAY))
def signal_window_daily(spark, sf_dir):
    return _flat(signals.aggregate(_events(spark, sf_dir), DAY))


_GATE_SQL = f"""
WITH s AS ({_signals_sql(DAY)}),
t AS (SELECT *, regexp_matches(template, '(?i)\\b(deadlock|timed out)\\b') AS fail, regexp_matches(template, '(?i)\\b(successfully|completed)\\b') AS good,
  len(string_split(pods, ',')) AS np, len(string_split(hashes, ',')) AS nh FROM s),
u AS (SELECT *, CASE WHEN severity_min <= 3 THEN 55 WHEN severity_min <= 4 THEN 20 ELSE 0 END + CASE WHEN fail THEN 30 WHEN good THEN -40 ELSE 0 END + 5
  + CASE WHEN count >= 10 AND np = 1 THEN 40 WHEN count >= 10 AND nh = 1 THEN 30 ELSE 0 END AS points FROM t)
SELECT template_id, identity, window_start_ms, round(greatest(0, least(100, points)) / 100, 2) AS qualification_score, points >= 70 AS qualified,
  concat_ws(',', CASE WHEN severity_min <= 3 THEN 'error_severity' WHEN severity_min <= 4 THEN 'warning_severity' END, CASE WHEN fail THEN 'failure_semantics' WHEN good THEN 'success_penalty' END, 'trusted_template',
    CASE WHEN count >= 10 AND np = 1 THEN 'isolated_to_single_pod' WHEN count >= 10 AND nh = 1 THEN 'isolated_to_single_release' END) AS evidence FROM u"""


@_query(_GATE_SQL)
def noise_gate(spark, sf_dir):
    gated = signals.noise_gate(signals.aggregate(_events(spark, sf_dir), DAY))
    return gated.select("template_id", "identity", "window_start_ms", "qualification_score", "qualified", F.array_join("qualification_evidence", ",").alias("evidence"))


@_query(
    f"""WITH s AS ({_signals_sql(DAY)}) SELECT identity AS service, template, sum(count)::BIGINT AS count, min(first_seen_ms) AS first_seen_ms, max(last_seen_ms) AS last_seen_ms, count(*) AS windows,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(pods, ','))))), ',') AS pods FROM s GROUP BY identity, template"""
)
def rollup_signals(spark, sf_dir):
    got = signals.rollup(signals.aggregate(_events(spark, sf_dir), DAY))
    return got.select("service", "template", "count", "first_seen_ms", "last_seen_ms", "windows", F.array_join("pod_names", ",").alias("pods"))


@_query("SELECT 'tpl_' || event_type AS template_id, count(*) AS n, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms, count(DISTINCT user_id) AS pods FROM events GROUP BY event_type")
def pattern_metrics(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("template_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count_distinct("pod_name").alias("pods"))


@_query(
    f"SELECT (epoch_us(ts) // 1000) // {DAY} AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS error_pods FROM events GROUP BY 1"
)
def severity_histogram(spark, sf_dir):
    error = F.col("severity") == "ERROR"
    return _events(spark, sf_dir).groupBy(F.expr(f"ts_ms div {DAY}").alias("day")).agg(F.count("*").alias("total"), F.count_if(error).alias("errors"), F.count_distinct(F.when(error, F.col("pod_name"))).alias("error_pods"))



@_query(
    f"""SELECT event_type, {_SQL_MESSAGE} AS template, CASE event_type WHEN 'error' THEN 'database_error' WHEN 'purchase' THEN 'symptom_cascade' ELSE 'informational' END AS failure_class,
  CASE WHEN event_type = 'error' THEN 'database' ELSE 'application' END AS failure_domain, count(*) AS n FROM events GROUP BY ALL"""
)
def failure_classes(spark, sf_dir):
    e = _events(spark, sf_dir)
    kind = T.failure_class(F.col("template"), F.lit(None).cast("string"), T.severity_number(F.col("severity")))
    return e.groupBy("event_type", "template", kind.alias("failure_class"), T.failure_domain(F.col("template")).alias("failure_domain")).agg(F.count("*").alias("n"))


def _classes_sql(text: str, severity: int) -> str:
    """failure_class, failure_domain and failure of a text without an alarm type, by the fixed words."""
    hit = lambda words: f"regexp_matches({text}, '" + P.words(words).replace("'", "''") + "')"
    kind = " ".join(f"WHEN {hit(words)} THEN '{name}'" for name, words in P.FAILURE_CLASSES.items())
    domain = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in P.FAILURE_DOMAINS.items())
    return f"CASE {kind} ELSE '{'generic_error' if severity <= 3 else 'informational'}' END AS failure_class, CASE {domain} ELSE 'application' END AS failure_domain, {hit(P.FAILURE_WORDS)} AS failure"


#: Every word of the classes and of success that is no expression; events say one each.
_SAID = [w for words in (*P.FAILURE_CLASSES.values(), P.SUCCESS_WORDS) for w in words if not set(w) & set("\\()[]+*?.|'")]


@_query(f"WITH w AS (SELECT event_id, 'user' || user_id || ' saw ' || ({_SAID!r})[(event_id % {len(_SAID)} + 1)::INTEGER] || CASE user_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN ' and ' || ({_SAID!r})[(user_id % {len(_SAID)} + 1)::INTEGER] ELSE '.' END AS said FROM events) SELECT event_id, said, {_classes_sql('said', 3)} FROM w")
def failure_classes_of_words(spark, sf_dir):
    e, words = _read(spark, sf_dir, "events"), F.array(*[F.lit(w) for w in _SAID])
    of = lambda c: F.get(words, (F.col(c) % len(_SAID)).cast("int"))
    tail = F.when(F.col("user_id") % 3 == 0, F.lit("x")).when(F.col("user_id") % 3 == 1, F.concat(F.lit(" and "), of("user_id"))).otherwise(".")
    said = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(" saw "), of("event_id"), tail)
    return e.select("event_id", said.alias("said")).select("event_id", "said", T.failure_class(F.col("said"), F.lit(None).cast("string"), F.lit(3)).alias("failure_class"), T.failure_domain(F.col("said")).alias("failure_domain"), T.is_failure(F.col("said")).alias("failure"))


@_query(f"SELECT doc_id, {_classes_sql('text', 6)} FROM documents")
def failure_classes_of_documents(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", T.failure_class(F.col("text"), F.lit(None).cast("string"), F.lit(6)).alias("failure_class"), T.failure_domain(F.col("text")).alias("failure_domain"), T.is_failure(F.col("text")).alias("failure"))


@_query()
def mask_full(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", T.mask(T.premask(F.col("text"))).alias("template"))
    return d.select("doc_id", F.sha2("template", 256).alias("template_sha256"), T.template_id(F.col("template")).alias("template_id"), T.reliable(F.col("template")).alias("reliable"), F.length(T.bounded(F.col("template"))).alias("bounded"))



@_query(f"SELECT event_type, count(*) AS n, 'id=<NUM> took <NUM> of <IP> at <URL> tag <HEX>' AS template, 5/9 > 0.6 AS gate_closed FROM events GROUP BY event_type")
def mask_access_lines(spark, sf_dir):
    e = _events(spark, sf_dir)
    line = F.concat(F.lit("id="), "event_id", F.lit(" took "), (F.col("value") * 10).cast("int"), F.lit(" of 10.0.0."), F.col("user_id") % 250, F.lit(" at https://h.example/"), "user_id", F.lit(" tag 0xAB"), F.col("user_id") % 9)
    template = T.mask(line)
    return e.withColumn("template", template).groupBy("event_type", "template", (~T.reliable(F.col("template"))).alias("gate_closed")).agg(F.count("*").alias("n"))


@_query(
    r"""SELECT event_id, 'svc ' || event_type || ' [redacted], next' AS redacted FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'see https://[redacted]@h.example/x' FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 'sent [redacted] ok' FROM events WHERE event_id % 3 = 2"""
)
def redact_secrets(spark, sf_dir):
    e = _events(spark, sf_dir)
    id_ = F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("svc "), "event_type", F.lit(' api_key="k'), id_, F.lit('", next')))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("see https://user"), id_, F.lit(":pw@h.example/x")))
        .otherwise(F.concat(F.lit("sent Bearer abc"), id_, F.lit(" ok")))
    )
    return e.select("event_id", T.redact(line).alias("redacted"))


@_query()
def redact_documents(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").withColumn("safe", T.redact(F.col("text")))
    return d.select("doc_id", (F.col("safe") != F.col("text")).alias("changed"), F.length("safe").alias("left_chars"), F.sha2("safe", 256).alias("safe_sha256"), T.evidence_line(F.col("text")).alias("evidence"))


_SEGMENT_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS ordinal, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS x FROM documents)),
c AS (SELECT *, regexp_matches(line, '^\s*$') AS blank,
  regexp_matches(line, '^\s') OR regexp_matches(line, '^(?:Traceback \(most recent call last\):|Caused by:|Suppressed:|\.\.\. \d+ more\b|at\s+\S+|File\s+"|[A-Za-z_][\w.]*?(?:Error|Exception):)')
    OR regexp_matches(line, '(?i)^(?:caused_by:|detail:|dependency chain:|symptom:|recommendation:|client:|server:|request:|upstream:|host:)') AS veto,
  starts_with(line, 'Licensed') OR starts_with(line, 'The ') AS hit, starts_with(line, '{"') OR regexp_matches(line, '^\{(\s|$)') AS opens FROM l),
s AS (SELECT *, NOT blank AND NOT veto AND hit AS start FROM c),
n AS (SELECT *, sum(start::INT) OVER w AS event_no, coalesce(sum((NOT blank)::INT) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
e AS (SELECT doc_id, event_no, count(*) AS line_count, min(ordinal) AS start_ordinal, max(ordinal) AS end_ordinal, max(start::INT) = 0 AS orphan, sha256(string_agg(line, chr(10) ORDER BY ordinal) FILTER (NOT blank)) AS text_sha256
  FROM n WHERE NOT (blank AND before = 0) GROUP BY doc_id, event_no)
SELECT doc_id, event_no::BIGINT AS event_no, line_count, start_ordinal::INTEGER AS start_ordinal, end_ordinal::INTEGER AS end_ordinal, orphan, text_sha256,
  CASE WHEN event_no = max(event_no) OVER (PARTITION BY doc_id) THEN 'analysis_end' ELSE 'next_header' END AS emission_reason FROM e"""


@_query(_SEGMENT_SQL)
def segment_lines(spark, sf_dir):
    numbered = segment.lines(_read(spark, sf_dir, "documents"), "doc_id")
    e = segment.assemble(segment.classify(numbered, "(?:Licensed|The )"))
    return e.select(F.col("stream").alias("doc_id"), "event_no", "line_count", "start_ordinal", "end_ordinal", "orphan", F.sha2("text", 256).alias("text_sha256"), "emission_reason")


@_query(
    _SEGMENT_SQL.rsplit("e AS (", 1)[0].rstrip().rstrip(",")
    + " SELECT count(*) AS lines, sum((NOT blank)::INT)::BIGINT AS nonblank, sum(start::INT)::BIGINT AS headers, sum((hit AND NOT blank)::INT)::BIGINT AS matched, sum((hit AND NOT blank AND NOT start)::INT)::BIGINT AS internal FROM n"
)
def validator_statistics(spark, sf_dir):
    got = segment.statistics(segment.classify(segment.lines(_read(spark, sf_dir, "documents"), "doc_id"), "(?:Licensed|The )"))
    return got.select("lines", "nonblank", "headers", "matched", "internal")


@_query()
def format_detect(spark, sf_dir):
    parts = [_read(spark, sf_dir, t).select(F.lit(t).alias("origin"), T.detect_format(F.col(c)).alias("format")) for t, c in (("documents", "text"), ("events", "props"), ("pages", "html"), ("conversations", "text"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("origin", "format").agg(F.count("*").alias("n"))


@_query(
    "SELECT event_id, 'json' AS format, 'PARSED' AS delivery, CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, event_type AS message, 'svc' || (user_id % 5) AS service, json_extract_string(props, '$.k') AS k, (epoch_us(ts) // 1000) AS ts_ms, 'message_explicit' AS basis FROM events"
)
def json_canonical(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    level = F.when(F.col("event_id") % 3 == 0, "50").when(F.col("event_id") % 3 == 1, "warn").otherwise("info")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    raw = F.to_json(F.struct(stamp.alias("time"), level.alias("level"), F.col("event_type").alias("msg"), F.concat(F.lit("svc"), F.col("user_id") % 5).alias("service"), F.get_json_object("props", "$.k").alias("k")))
    got = parse.canonical(e.select("event_id", raw.alias("raw")).withColumnRenamed("event_id", "source_id"))
    return got.select(F.col("source_id").alias("event_id"), "format", "delivery", "severity", "message", "service", F.try_element_at("attributes", F.lit("k")).alias("k"), "ts_ms", "basis")


@_query("SELECT event_id, 'kv' AS format, 'ERROR' AS severity, 'failed ' || event_type AS message, user_id::VARCHAR AS u, CASE WHEN event_id % 2 = 0 THEN 'a b' ELSE 'c' END AS q FROM events")
def kv_canonical(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    raw = F.concat(F.lit("level=error u="), "user_id", F.lit(" u=again msg='failed "), "event_type", F.lit("' q="), F.when(F.col("event_id") % 2 == 0, F.lit('"a b"')).otherwise("c"))
    got = parse.canonical(e.select(F.col("event_id").alias("source_id"), raw.alias("raw")))
    return got.select(F.col("source_id").alias("event_id"), "format", "severity", "message", F.try_element_at("attributes", F.lit("u")).alias("u"), F.try_element_at("attributes", F.lit("q")).alias("q"))


@_query("SELECT event_id, 'syslog' AS format, list_extract(['EMERGENCY','ALERT','CRITICAL','ERROR','WARNING','NOTICE','INFO','DEBUG'], (event_id % 192 % 8 + 1)::INTEGER) AS severity, 'host' || (user_id % 7) AS host, 'app' AS service, event_type || ' n=' || user_id AS message FROM events")
def syslog_canonical(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    raw = F.concat(F.lit("<"), F.col("event_id") % 192, F.lit(">1 2024-01-01T00:00:00Z host"), F.col("user_id") % 7, F.lit(" app "), "event_type", F.lit(" n="), "user_id")
    got = parse.canonical(e.select(F.col("event_id").alias("source_id"), raw.alias("raw")))
    return got.select(F.col("source_id").alias("event_id"), "format", "severity", "host", "service", "message")


@_query()
def canonical_documents(spark, sf_dir):
    got = parse.templated(parse.canonical(_read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"))))
    return got.select("doc_id", "format", "delivery", "severity", "basis", "time_status", "template_id", "template_reliable")


@_query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_ms(date_trunc('second', ts)) WHEN 1 THEN epoch_ms(date_trunc('second', ts)) - 7200000 WHEN 2 THEN epoch_ms(date_trunc('second', ts)) END AS ts_ms,
  CASE event_id % 4 WHEN 3 THEN 'untimed' WHEN 2 THEN 'message_source_timezone' ELSE 'message_explicit' END AS basis, CASE event_id % 4 WHEN 3 THEN 'timezone_missing' END AS status FROM events"""
)
def time_quality(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    clock = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    kind = F.col("event_id") % 4
    rows = e.select("event_id", F.when(kind == 0, F.concat(F.replace(clock, F.lit(" "), F.lit("T")), F.lit("Z"))).when(kind == 1, F.concat(clock, F.lit(" +0200"))).otherwise(clock).alias("stamp"), F.when(kind == 2, "UTC").alias("zone"))
    at, basis = times.resolve(F.col("stamp"), F.col("zone"), F.lit(None).cast("string"))
    return rows.select("event_id", F.floor(at / 1000).cast("bigint").alias("ts_ms"), basis.alias("basis"), times.status(F.col("stamp"), F.col("zone")).alias("status"))


@_query("SELECT s_suppkey, s_name, n_name AS nation, n_nationkey IS NULL AS missing, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def host_enrich(spark, sf_dir):
    s, n, r = (_read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    inv = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select(F.col("n_nationkey").cast("string").alias("host"), "n_name", "r_name")
    got = host_enriched(s.withColumn("host", F.concat(F.lit(" "), F.col("s_nationkey").cast("string"))), inv)
    return got.select("s_suppkey", "s_name", F.col("inv_n_name").alias("nation"), F.col("inventory_missing").alias("missing"), F.col("inv_r_name").alias("region"))


def _nation_edges(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    code = lambda c: F.lpad(c.cast("string"), 2, "0")
    return n.select(code(F.col("k")).alias("src"), code((F.col("k") * 7 + 3) % 25).alias("dst")).unionByName(n.select(code(F.col("k")).alias("src"), code((F.col("k") * 3 + 1) % 25).alias("dst")))


@_query(
    """WITH RECURSIVE k AS (SELECT n_nationkey::INT AS k FROM nation),
e AS (SELECT DISTINCT lpad(k::VARCHAR, 2, '0') AS src, lpad(d::VARCHAR, 2, '0') AS dst FROM (SELECT k, (k * 7 + 3) % 25 AS d FROM k UNION ALL SELECT k, (k * 3 + 1) % 25 FROM k) WHERE k <> d),
p AS (SELECT src, src AS dst, 0 AS hops, [src] AS path FROM (SELECT src FROM e UNION SELECT dst FROM e) UNION ALL SELECT p.src, e.dst, hops + 1, list_append(path, e.dst) FROM p JOIN e ON p.dst = e.src WHERE hops < 4 AND NOT list_contains(path, e.dst)),
b AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) AS n FROM p) SELECT src, dst, hops::INTEGER AS hops, array_to_string(path, '>') AS path FROM b WHERE n = 1"""
)
def dependency_paths(spark, sf_dir):
    return graph.dependency_paths(_nation_edges(spark, sf_dir), 4).select("src", "dst", "hops", F.array_join("path", ">").alias("path"))


def _event_signals(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(
        F.concat(F.lit("s"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("signal_id"), F.col("ts_ms").alias("first_seen_ms"), F.col("ts_ms").alias("last_seen_ms"), "template_id", "template",
        F.lit(None).cast("string").alias("alarm_type"), T.severity_number(F.col("severity")).alias("severity_min"), F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("service"),
    )


@_query(
    """WITH s AS (SELECT 's' || lpad(event_id::VARCHAR, 10, '0') AS id, (epoch_us(ts) // 1000) AS t, event_type AS k, user_id AS u FROM events)
SELECT CASE WHEN a.k = 'error' THEN a.id ELSE b.id END AS source, CASE WHEN a.k = 'error' THEN b.id ELSE a.id END AS target, 0.75::DOUBLE AS score, 'root_class_first,cascade_follows' AS evidence, abs(b.t - a.t) AS time_gap_ms
FROM s a JOIN s b ON a.u = b.u AND a.k IN ('error', 'purchase') AND b.k IN ('error', 'purchase') AND a.k <> b.k AND (b.t > a.t OR b.t = a.t AND b.id > a.id) AND b.t - a.t <= 180000"""
)
def correlate_interval(spark, sf_dir):
    return incidents.correlate(_event_signals(spark, sf_dir)).select("source", "target", "score", F.array_join("evidence", ",").alias("evidence"), "time_gap_ms")


@_query("SELECT c_custkey AS node, (c_custkey - 1) % 97 + 1 AS root FROM customer")
def connected_components(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    return graph.components(c.select("a", F.greatest(F.col("a") - 97, F.when(F.col("a") <= 97, F.col("a")).otherwise(F.lit(1))).alias("b")))


def _findings(spark, sf_dir):
    links = spark.createDataFrame([("svc0", "svc1"), ("svc1", "svc2"), ("svc3", "svc2")], "src string, dst string")
    return downstream(_events(spark, sf_dir), links, window_ms=DAY)


@_query()
def incident_summary(spark, sf_dir):
    return _findings(spark, sf_dir).incidents


@_query()
def rank_root_causes(spark, sf_dir):
    return _findings(spark, sf_dir).roots


@_query()
def incident_plans(spark, sf_dir):
    return _findings(spark, sf_dir).plans


@_query()
def evidence_packs(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return evidence.packs(f.incidents, f.signals, f.edges, f.roots)


@_query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'stored block rdd_<ID>' WHEN 1 THEN 'to db.example.com:5432 at /data/subdir<ID>/x' ELSE 'phase_2 done' END AS template FROM events".replace("db.example.com:5432", "<ID>:<NUM>"))
def structural_templates(spark, sf_dir):
    kind, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    said = F.when(kind == 0, F.concat(F.lit("stored block rdd_"), user)).when(kind == 1, F.concat(F.lit("to db.example.com:5432 at /data/subdir"), user, F.lit("/x"))).otherwise("phase_2 done")
    return _events(spark, sf_dir).select("event_id", generalise(said)["template"].alias("template"))


_OWNER_TEXTS = ("sqlalchemy deadlock", "connection refused by peer", "container oomkilled", "nosuchkey in bucket", "traceback of keyerror", "nothing known")


@_query(
    "SELECT p_partkey, " + "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(("Database Operations", "Network Operations", "Platform / Infrastructure SRE", "Integration / Storage Operations"))) + " WHEN 4 THEN p_brand || ' Service Owner' ELSE p_brand || ' Service Owner' END AS owner, "
    + "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(("verify_db_connection_pool_and_sessions", "check_network_connectivity_and_firewall", "inspect_pod_memory_and_restart_history", "verify_storage_credentials_and_bucket_access", "investigate_application_traceback_and_rollback"))) + " ELSE 'prepare_operator_review' END AS step FROM part"
)
def plan_owner(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    said = F.get(F.array(*[F.lit(t) for t in _OWNER_TEXTS]), (F.col("p_partkey") % 6).cast("int"))
    return p.select("p_partkey", incidents.owner_of(said, F.lit(None).cast("string"), F.col("p_brand")).alias("o")).select("p_partkey", "o.owner", "o.step")


def _daily(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type", F.expr(f"ts_ms div {DAY}").alias("day")).agg(F.count("*").alias("n"))


_BASE_SQL = f"""
WITH d AS (SELECT event_type, (epoch_us(ts) // 1000) // {DAY} AS day, count(*) AS n FROM events GROUP BY 1, 2),
h AS (SELECT *, list(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS past FROM d),
b AS (SELECT *, CASE WHEN len(past) >= 5 THEN list_median(past)::DOUBLE END AS baseline FROM h),
m AS (SELECT *, CASE WHEN baseline IS NOT NULL THEN list_median(list_transform(past, lambda x: abs(x - baseline)))::DOUBLE END AS mad FROM b)"""


@_query(_BASE_SQL.replace("list_median(", "list_aggregate(").replace("(past)::", "(past, 'median')::").replace("abs(x - baseline)))::", "abs(x - baseline)), 'median')::") + " SELECT event_type, day, n, baseline, mad FROM m")
def baseline_mad(spark, sf_dir):
    return baseline.change(baseline.history(_daily(spark, sf_dir), ["event_type"], "day", "n"), "n").select("event_type", "day", "n", "baseline", "mad")


@_query(
    _BASE_SQL.replace("list_median(", "list_aggregate(").replace("(past)::", "(past, 'median')::").replace("abs(x - baseline)))::", "abs(x - baseline)), 'median')::").replace("count(*) AS n", "count(*) * CASE WHEN (epoch_us(min(ts)) // 1000) // 86400000 % 7 = 3 THEN 9 WHEN (epoch_us(min(ts)) // 1000) // 86400000 % 7 = 5 THEN 0 ELSE 1 END AS n")
    + " SELECT event_type, day, CASE WHEN n > greatest(baseline * 3, baseline + 6 * mad) AND n >= 5 THEN 'spike' WHEN baseline >= 5 AND n < least(baseline * 0.25, baseline - 6 * mad) THEN 'collapse' END AS direction FROM m"
)
def anomaly_changes(spark, sf_dir):
    d = _daily(spark, sf_dir).withColumn("n", F.col("n") * F.when(F.col("day") % 7 == 3, 9).when(F.col("day") % 7 == 5, 0).otherwise(1))
    return baseline.change(baseline.history(d, ["event_type"], "day", "n"), "n").select("event_type", "day", "direction")


@_query(
    f"""WITH c AS (SELECT 'pod' || user_id AS template_id, (epoch_us(ts) // 1000) // {DAY} AS "window", count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT unnest(range(lo, hi + 1)) AS "window", lo FROM (SELECT min("window") AS lo, max("window") AS hi FROM c)),
g AS (SELECT t.template_id, s."window", s.lo, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT template_id FROM c) t CROSS JOIN s LEFT JOIN c ON c.template_id = t.template_id AND c."window" = s."window"),
h AS (SELECT *, list(n::DOUBLE) OVER (PARTITION BY template_id ORDER BY "window" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS past FROM g),
b AS (SELECT *, CASE WHEN len(past) >= 5 THEN list_aggregate(past, 'median') END AS baseline FROM h), m AS (SELECT *, CASE WHEN baseline IS NOT NULL THEN list_aggregate(list_transform(past, lambda x: abs(x - baseline)), 'median') END AS mad, len(list_filter(past, lambda x: x > 0)) AS seen FROM b),
k AS (SELECT *, CASE WHEN n > 0 AND n > greatest(baseline * 3, baseline + 6 * mad) AND n >= 5 AND seen > 0 THEN 'pattern_frequency' WHEN n > 0 AND coalesce(seen, 0) = 0 AND len(past) >= 5 THEN 'new_pattern'
  WHEN n = 0 AND seen >= 5 AND baseline >= 5 AND n < least(baseline * 0.25, baseline - 6 * mad) THEN 'pattern_disappearance' END AS kind FROM m)
SELECT "window", template_id, kind, n AS current, baseline FROM k WHERE kind IS NOT NULL"""
)
def pattern_changes(spark, sf_dir):
    d = _events(spark, sf_dir).groupBy(F.col("pod_name").alias("template_id"), F.expr(f"ts_ms div {DAY}").alias("window")).agg(F.count("*").alias("n"))
    return baseline.patterns(d)


@_query(
    f"""WITH c AS (SELECT (epoch_us(ts) // 1000) // {DAY} AS "window", CASE WHEN user_id % 20 = 0 THEN 'odd' ELSE 'main' END AS pod, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY "window") AS total, row_number() OVER (PARTITION BY "window" ORDER BY n DESC, pod) AS r FROM c) SELECT "window", pod, n, total::BIGINT AS total, n / total AS ratio FROM t WHERE r = 1 AND total >= 10 AND n / total >= 0.9"""
)
def error_concentration(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'error'")
    c = e.groupBy(F.expr(f"ts_ms div {DAY}").alias("window"), F.when(F.col("user_id") % 20 == 0, "odd").otherwise("main").alias("pod")).agg(F.count("*").alias("n"))
    return baseline.concentration(c, "pod")


@_query(
    f"""WITH c AS (SELECT (epoch_us(ts) // 1000) // {DAY} AS "window", 'pod' || user_id AS pod, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY n DESC, pod) AS r FROM c) SELECT "window", CASE WHEN r <= 32 THEN pod ELSE '[other]' END AS pod, sum(n)::BIGINT AS n FROM r GROUP BY 1, 2"""
)
def histogram_top32(spark, sf_dir):
    return baseline.window_metrics(_events(spark, sf_dir), F.expr(f"ts_ms div {DAY}"), "pod", "pod_name")


@_query("SELECT (event_id % 1000)::VARCHAR AS ref, (epoch_us(ts) // 1000) AS ts_ms, CASE WHEN event_id % 1000 % 7 = 0 THEN 'duplicate' WHEN row_number() OVER (PARTITION BY event_id % 1000 ORDER BY (epoch_us(ts) // 1000)) > 1 THEN 'duplicate' WHEN event_id % 5 = 0 THEN 'orphan' WHEN (epoch_us(ts) // 1000) NOT BETWEEN 1704153600000 AND 1705363199999 THEN 'outside_window' ELSE 'accepted' END AS decision FROM events")
def window_ownership(spark, sf_dir):
    e = _events(spark, sf_dir).select((F.col("event_id") % 1000).cast("string").alias("ref"), "ts_ms", (F.col("event_id") % 5 == 0).alias("orphan"), "event_id")
    receipts = e.where(F.col("event_id") % 1000 % 7 == 0).select("ref")
    return monitor.owned(e, receipts, F.lit(1704153600000), F.lit(1705363200000)).select("ref", "ts_ms", "decision")


@_query("SELECT CASE WHEN (epoch_us(ts) // 1000) < 1704153600000 THEN 'PRE_OVERLAP' WHEN (epoch_us(ts) // 1000) < 1705363200000 THEN 'OWNED_WINDOW' ELSE 'POST_OVERLAP' END AS lane, count(*) AS n FROM events GROUP BY 1")
def acquisition_lanes(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(monitor.lane(F.col("ts_ms"), F.lit(1704153600000), F.lit(1705363200000)).alias("lane")).agg(F.count("*").alias("n"))


@_query(
    f"""WITH r AS (SELECT event_type AS monitor_id, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS s, count(*) % 11 <> 0 AS ok FROM events GROUP BY 1, 2),
g AS (SELECT *, sum((NOT ok OR coalesce(lag(s) OVER w + {DAY}, s) <> s)::INT) OVER w AS gaps FROM r WINDOW w AS (PARTITION BY monitor_id ORDER BY s)) SELECT monitor_id, max(CASE WHEN gaps = 0 THEN s + {DAY} END) AS watermark_ms FROM g GROUP BY 1""".replace("lag(s) OVER w + ", "lag(s) OVER (PARTITION BY monitor_id ORDER BY s) + ").replace("sum((NOT ok OR coalesce", "sum(bad) OVER w AS gaps FROM (SELECT *, (NOT ok OR coalesce").replace("<> s)::INT) OVER w AS gaps FROM r WINDOW", "<> s)::INT AS bad FROM r) WINDOW")
)
def contiguous_watermark(spark, sf_dir):
    r = _events(spark, sf_dir).groupBy(F.col("event_type").alias("monitor_id"), F.expr(f"ts_ms div {DAY} * {DAY}").alias("start_ms")).agg(F.count("*").alias("n"))
    runs = r.select("monitor_id", "start_ms", (F.col("start_ms") + DAY).alias("end_ms"), F.when(F.col("n") % 11 != 0, "SUCCESS").otherwise("FAILED").alias("status"))
    return monitor.contiguous_watermark(runs)


@_query("SELECT event_type, count(*) AS expected, count(*) FILTER (event_id % 13 <> 0 OR event_type <> 'view') AS got, abs(count(*) - count(*) FILTER (event_id % 13 <> 0 OR event_type <> 'view')) <= greatest(10, 0.05 * count(*)) AS ok FROM events GROUP BY 1")
def count_reconciliation(spark, sf_dir):
    e = _events(spark, sf_dir)
    got = e.where("event_id % 13 <> 0 or event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("got"))
    return monitor.reconcile(e.groupBy("event_type").agg(F.count("*").alias("expected")), got, "event_type")


@_query(
    "WITH a AS (SELECT event_type AS m, user_id % 50 AS w, CASE event_id % 3 WHEN 0 THEN 'WINDOW_LOCAL' WHEN 1 THEN 'UNKNOWN' ELSE 'TRANSIENT' END AS c, user_id % 2 AS s FROM events), "
    "u AS (SELECT m, w, max(n) AS same FROM (SELECT m, w, s, count(*) AS n FROM a WHERE c = 'UNKNOWN' GROUP BY ALL) GROUP BY ALL) SELECT a.m AS monitor_id, a.w AS \"window\", count(*) AS attempts, count(*) FILTER (c = 'WINDOW_LOCAL') AS local, "
    "CASE WHEN count(*) FILTER (c = 'WINDOW_LOCAL') >= 3 THEN 'QUARANTINED' WHEN any_value(same) >= 3 THEN 'ESCALATED' ELSE 'RETRY' END AS status FROM a LEFT JOIN u USING (m, w) GROUP BY ALL"
)
def failure_quarantine(spark, sf_dir):
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_id") % 3 == 0, "WINDOW_LOCAL").when(F.col("event_id") % 3 == 1, "UNKNOWN").otherwise("TRANSIENT")
    return monitor.failure_state(e.select(F.col("event_type").alias("monitor_id"), (F.col("user_id") % 50).alias("window"), kind.alias("classification"), (F.col("user_id") % 2).alias("signature")))


@_query(
    r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS ordinal, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS x FROM documents)),
s AS (SELECT *, ntile(10) OVER (PARTITION BY doc_id ORDER BY ordinal) AS stratum FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stratum ORDER BY ordinal) AS n FROM s) SELECT doc_id, ordinal::INTEGER AS ordinal, stratum::INTEGER AS stratum, line FROM r WHERE n <= 15"""
)
def stratified_sample(spark, sf_dir):
    return monitor.stratified_sample(segment.lines(_read(spark, sf_dir, "documents"), "doc_id")).select(F.col("stream").alias("doc_id"), "ordinal", "stratum", "line")


@_query("SELECT event_type, event_id, (epoch_us(ts) // 1000) AS ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000) DESC) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) ORDER BY event_id) AS d FROM events) WHERE d = 1) WHERE n <= 30")
def newest_ring(spark, sf_dir):
    return monitor.newest(_events(spark, sf_dir).select("event_type", "event_id", "ts_ms"), "event_type", "ts_ms", 30)


@_query("SELECT event_id, event_type FROM events WHERE NOT (event_type = 'error' AND (epoch_us(ts) // 1000) < 1706659200000 - 7 * 86400000) AND NOT (event_type = 'view' AND (epoch_us(ts) // 1000) < 1706659200000 - 3 * 86400000)")
def retention(spark, sf_dir):
    return monitor.retained(_events(spark, sf_dir), "ts_ms", "event_type", 1706659200000, {"error": 7, "view": 3}).select("event_id", "event_type")


@_query(r"""WITH p(id, pat) AS (VALUES ('the', '(?:The|Of) '), ('all', '.'), ('none', 'zzzz')), l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents),
g AS (SELECT id AS policy_id, count(*) FILTER (regexp_matches(line, '^(?:' || pat || ')')) AS matched, count(*) FILTER (NOT regexp_matches(line, '^(?:' || pat || ')')) AS missed, count(DISTINCT doc_id) FILTER (regexp_matches(line, '^(?:' || pat || ')')) AS streams FROM l, p GROUP BY id)
SELECT *, row_number() OVER (ORDER BY matched DESC, missed, streams DESC, policy_id)::INTEGER AS rank FROM g WHERE matched > 0""")
def policy_resolution(spark, sf_dir):
    rows = segment.lines(_read(spark, sf_dir, "documents"), "doc_id")
    return monitor.resolve_policy(rows, [("the", "(?:The|Of) "), ("all", "."), ("none", "zzzz")])


@_query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under the mit license') OR (contains(lower(text), 'license') AND contains(lower(text), 'version'))")
def feedback_rules(spark, sf_dir):
    rules = spark.createDataFrame([("Licensed under the MIT License", ["unused"]), (None, ["license", "version", "the"])], "root_text string, keywords array<string>")
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("signal_id"), F.col("text").alias("template"))
    return incidents.confirmed(d, F.broadcast(rules)).select(F.col("signal_id").alias("doc_id"))


@_query("WITH RECURSIVE c AS (SELECT DISTINCT conv_id, 0 AS depth FROM conversations UNION ALL SELECT conv_id, depth + 1 FROM c JOIN (SELECT DISTINCT conv_id, turn FROM conversations) USING (conv_id) WHERE turn = depth + 1) SELECT 'c' || conv_id || ':0' AS root, 'c' || conv_id || ':' || depth AS ref, depth::INTEGER AS depth FROM c")
def lineage_closure(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    roots = c.select(name(F.lit(0)).alias("root")).distinct()
    return monitor.lineage(c.where("turn > 0").select(name(F.col("turn") - 1).alias("parent"), name(F.col("turn")).alias("child")), roots).select("root", "ref", "depth")


@_query("SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'shop' || user_id WHEN 1 THEN 'cart-api' WHEN 2 THEN 'service_7' ELSE 'ns' || (user_id % 3) END AS workload FROM events")
def workload_resolution(spark, sf_dir):
    kind = F.col("event_id") % 4
    named = F.when(kind == 0, F.concat(F.lit(" shop"), F.col("user_id").cast("string"))).otherwise("unknown")
    pods = F.when(kind == 1, F.array(F.lit("none"), F.lit("cart-api-5f6d7c8b9-x2z4q"))).otherwise(F.array(F.lit("unknown")))
    ids = F.when(kind == 2, F.array(F.lit("7"))).otherwise(F.expr("cast(array() as array<string>)"))
    w = T.workload([named], pods, F.array(F.lit("abc")), ids, F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")))
    return _events(spark, sf_dir).select("user_id", "event_id", w.alias("workload"))


@_query("SELECT event_id, event_id - min(event_id) OVER w AS back, max(event_id) OVER w - event_id AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)")
def stream_context(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-20, 20)
    e = _events(spark, sf_dir)
    return e.select("event_id", (F.col("event_id") - F.min("event_id").over(w)).alias("back"), (F.max("event_id").over(w) - F.col("event_id")).alias("ahead"))


# -- policies as rows

POLICIES = [
    ("numbered", r"^#(?P<pid>\d+) <(?P<host>\w+)> (?P<unit>[a-z]+): (?P<text>.*)$", {"attr:pid": "pid", "host": "host", "component": "unit", "message": "text"}),
    ("tilde", r"^~(\d+)~ ([EWI]) ~ (\w+) ~ (.*)$", {"attr:pid": "1", "severity": "2", "component": "3", "message": "4"}),
    ("capital", r"^(?P<first>[A-Z][a-z]+)[ ,](?P<body>.+)", {"component": "first", "message": "body"}),
    ("worded", r"^([^\W\d_]+) (\w+.*)", {"component": "1", "message": "2"}), ("any", r"^.+", {"message": "1"}),
]


def _policies(spark: SparkSession) -> DataFrame:
    return line_policies.compiled(spark.createDataFrame(POLICIES, "policy_id string, regex string, groups map<string,string>"))


_LINES_SQL = r"l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS ordinal, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS x FROM documents))"
_SAMPLES_SQL = _LINES_SQL + r", s AS (SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS nth, line AS sample FROM l WHERE regexp_matches(line, '\S')) WHERE nth < 150)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_policies.sampled(segment.lines(_read(spark, sf_dir, "documents"), "doc_id"))


@_query(
    """WITH e AS (SELECT event_id, user_id % 3 AS s, user_id % 7 AS h, event_type AS k, (round(value * 100))::BIGINT AS v FROM events),
r AS (SELECT *, CASE WHEN s = 0 AND k <> 'view' THEN 'numbered' WHEN s = 1 AND k <> 'view' THEN 'tilde' END AS policy_id,
  CASE WHEN k = 'view' THEN 'rendered ' || k || ' of ' || v || ' parts' WHEN s = 1 THEN 'amount ' || v || ' was seen' ELSE 'amount ' || v || ' of unit' || h || ' came' END AS body FROM e)
SELECT event_id, policy_id, CASE WHEN s < 2 AND k = 'view' THEN 'FALLBACK' ELSE 'PARSED' END AS delivery, CASE WHEN s = 2 AND k <> 'view' THEN '#' || event_id || ' <host' || h || '> ' || k || ': ' || body ELSE body END AS message,
  CASE WHEN policy_id = 'numbered' THEN 'host' || h END AS host, CASE WHEN policy_id IS NOT NULL THEN k END AS component, CASE WHEN policy_id IS NOT NULL THEN event_id::VARCHAR END AS pid,
  CASE WHEN policy_id = 'tilde' THEN CASE WHEN k = 'error' THEN 'ERROR' WHEN k = 'purchase' THEN 'WARNING' ELSE 'INFO' END END AS severity FROM r"""
)
def policy_canonical(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    value, said = F.round(F.col("value") * 100).cast("bigint"), F.col("event_type")
    body = F.when(said == "view", F.concat(F.lit("rendered view of "), value, F.lit(" parts"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("amount "), value, F.lit(" was seen"))).otherwise(F.concat(F.lit("amount "), value, F.lit(" of unit"), F.col("user_id") % 7, F.lit(" came")))
    level = F.when(said == "error", "E").when(said == "purchase", "W").otherwise("I")
    line = (
        F.when(said == "view", body)
        .when(F.col("user_id") % 3 == 1, F.concat(F.lit("~"), "event_id", F.lit("~ "), level, F.lit(" ~ "), said, F.lit(" ~ "), body))
        .otherwise(F.concat(F.lit("#"), "event_id", F.lit(" <host"), F.col("user_id") % 7, F.lit("> "), said, F.lit(": "), body))
    )
    raw = e.select(F.col("event_id").alias("source_id"), (F.col("user_id") % 3).cast("string").alias("stream"), line.alias("raw"))
    streams = spark.createDataFrame([("0", "numbered"), ("1", "tilde")], "stream string, policy_id string")
    got = parse.canonical(raw, assignments=streams, policies=_policies(spark))
    return got.select(F.col("source_id").alias("event_id"), "policy_id", "delivery", "message", "host", "component", F.try_element_at("attributes", F.lit("pid")).alias("pid"), F.when(F.col("policy_id") == "tilde", F.col("severity")).alias("severity"))


@_query(
    "WITH " + _SAMPLES_SQL + r""", p AS (SELECT * FROM (VALUES ('numbered', '^#(\d+) <(\w+)> ([a-z]+): (.*)$', 4, NULL), ('tilde', '^~(\d+)~ ([EWI]) ~ (\w+) ~ (.*)$', 4, NULL), ('capital', '^([A-Z][a-z]+)[ ,](.+)', 2, NULL), ('worded', '^([\p{L}]+) ([\p{L}\p{N}_]+.*)', 2, NULL), ('any', '^.+', 0, 'catch_all')) AS t(policy_id, pattern, n, fault)),
g AS (SELECT policy_id, fault, regexp_matches(sample, pattern) AND (n < 2 OR regexp_extract(sample, pattern, 2) <> '') AND (n < 4 OR regexp_extract(sample, pattern, 4) <> '') AND fault IS NULL AS ok FROM s, p)
SELECT policy_id, count(*) AS samples, count(*) FILTER (ok) AS passed, count(*) FILTER (ok) / count(*) AS ratio, count(*) FILTER (ok) / count(*) >= 0.9 AS admitted, fault FROM g GROUP BY policy_id, fault"""
)
def policy_admission(spark, sf_dir):
    each = F.explode(F.array(*[F.lit(p[0]) for p in POLICIES])).alias("policy_id")
    return line_policies.admitted(_samples(spark, sf_dir).select(each, "sample"), _policies(spark))


@_query("WITH " + _SAMPLES_SQL + r""" SELECT doc_id, left(sha256(string_agg(regexp_replace(regexp_replace(left(sample, 500), '\d+', '#', 'g'), '[0-9a-fA-F]{8,}', '<HEX>', 'g'), chr(10) ORDER BY nth)), 24) AS signature FROM s GROUP BY doc_id""")
def sample_signatures(spark, sf_dir):
    return line_policies.signatures(_samples(spark, sf_dir)).select(F.col("stream").alias("doc_id"), "signature")


_SHAPE_SQL = "left(sample, 500)"
for _pattern, _by in line_policies.SHAPES:
    _SHAPE_SQL = f"regexp_replace({_SHAPE_SQL}, '{_pattern}', '{_by}', 'g')"


@_query(
    "WITH " + _SAMPLES_SQL + rf""", h AS (SELECT *, left(trim({_SHAPE_SQL}), 220) AS shape, count(*) OVER (PARTITION BY doc_id) AS size FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, shape ORDER BY nth) = 1 AS first, least(12, size) AS most FROM h),
t AS (SELECT *, CASE WHEN first THEN 0 WHEN list_contains(CASE WHEN most = 1 THEN [0] ELSE list_transform(range(most), lambda i: round_even(i * (size - 1) / (most - 1), 0)::INT) END, nth) THEN 1 ELSE 2 END AS turn FROM f)
SELECT doc_id, pick::INTEGER AS pick, nth::INTEGER AS nth, sha256(sample) AS sample_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, nth) AS pick FROM t) WHERE pick <= 12"""
)
def representative_samples(spark, sf_dir):
    return line_policies.representative(_samples(spark, sf_dir), 12).select(F.col("stream").alias("doc_id"), "pick", "nth", F.sha2("sample", 256).alias("sample_sha256"))


@_query(
    "WITH " + _LINES_SQL + r""", s AS (SELECT doc_id, ordinal AS nth, line AS sample, regexp_matches(line, '^(?:Th|De|La|Ein|An)') AS matched FROM l WHERE regexp_matches(line, '\S')),
k AS (SELECT *, list_filter(string_split_regex(sample, '\s+'), lambda t: t <> '')[1:4] AS tokens, trim(regexp_replace(regexp_replace(left(sample, 200), '\d+', '<N>', 'g'), '\s+', ' ', 'g')) AS alike FROM s),
c AS (SELECT *, list_transform(tokens, lambda t: string_split(regexp_replace(regexp_replace(left(t, 48), '\p{L}', 'A', 'g'), '\d', 'D', 'g'), '')) AS kinds FROM k),
f AS (SELECT *, array_to_string(list_transform(list_zip(kinds, tokens), lambda z: array_to_string(list_filter(z[1], lambda c, i: i = 1 OR z[1][i - 1] <> c), '') || ':' || least(length(z[2]) // 4, 8)), '|') AS family FROM c),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, matched, family, alike ORDER BY nth) AS once FROM f) WHERE once = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, matched, family ORDER BY nth) AS turn, min(nth) OVER (PARTITION BY doc_id, matched, family) AS lead FROM o)
SELECT doc_id, matched, pick::INTEGER AS pick, nth::INTEGER AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, matched ORDER BY turn, lead) AS pick FROM t) WHERE pick <= CASE WHEN matched THEN 8 ELSE 24 END"""
)
def contrasted_samples(spark, sf_dir):
    lines = segment.lines(_read(spark, sf_dir, "documents"), "doc_id").where(F.col("line").rlike(r"(?U)\S"))
    rows = lines.select("stream", F.col("ordinal").alias("nth"), F.col("line").alias("sample"))
    return line_policies.contrasted(rows, F.lit("(?:Th|De|La|Ein|An)")).select(F.col("stream").alias("doc_id"), "matched", "pick", "nth")


# -- incidents over windows, findings, and what a window may hold


@_query(
    """WITH e AS (SELECT event_id, 'user' || user_id || ':' || event_type AS problem_key, epoch_us(ts) // 1000 AS t FROM events WHERE event_type IN ('error', 'purchase')),
g AS (SELECT *, lag(t) OVER w AS before FROM e WINDOW w AS (PARTITION BY problem_key ORDER BY t)), n AS (SELECT *, before IS NULL OR t - before > 86400000 AS is_new FROM g),
l AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY problem_key ORDER BY t ROWS UNBOUNDED PRECEDING) AS life FROM n)
SELECT event_id, problem_key, 'inc:' || left(sha256(problem_key), 32) AS incident_id, CASE WHEN is_new THEN 'open' ELSE 'active' END AS status, is_new, min(t) OVER v AS first_seen_ms, t AS last_seen_ms, row_number() OVER v AS times_seen
FROM l WINDOW v AS (PARTITION BY problem_key, life ORDER BY t ROWS UNBOUNDED PRECEDING)"""
)
def incident_lifelines(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type in ('error', 'purchase')")
    seen = e.select("event_id", F.concat(F.lit("user"), "user_id", F.lit(":"), "event_type").alias("problem_key"), F.col("ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"))
    return liveness.lifelines(seen).select("event_id", "problem_key", "incident_id", "status", "is_new", "first_seen_ms", "last_seen_ms", "times_seen")


@_query(
    f"""WITH e AS (SELECT (epoch_us(ts) // 1000) // {DAY} AS run_id, user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT run_id, CASE WHEN k = 'error' THEN 'incident' ELSE 'anomaly' END AS kind, left(sha256(k || user_id), 32) AS ref, CASE k WHEN 'error' THEN 'Incident' WHEN 'view' THEN 'pod_volume' WHEN 'click' THEN 'new_pattern' ELSE 'Anomaly' END AS title, n AS count FROM e WHERE k <> 'signup'),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY kind = 'anomaly', ref) AS nth FROM c) SELECT run_id, nth::INTEGER AS nth, kind, ref, title, count, sha256(run_id || ':' || kind || ':' || ref) AS finding_id FROM r WHERE nth <= 10"""
)
def findings(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(F.expr(f"ts_ms div {DAY}").alias("run_id"), "user_id", "event_type").agg(F.count("*").alias("count"))
    name = F.concat("event_type", F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "view", "pod_volume").when(F.col("event_type") == "click", "new_pattern").otherwise("made up")
    anomalies = e.where("event_type <> 'error'").select("run_id", name.alias("signal_id"), kind.alias("kind"), "count", (F.col("event_type") != "signup").alias("qualified"))
    return monitor.findings(e.where("event_type = 'error'").select("run_id", name.alias("incident_id"), "count"), anomalies).select("run_id", "nth", "kind", "ref", "title", "count", "finding_id")


@_query(
    "SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'streams' AS kind, user_id::VARCHAR AS k FROM events UNION ALL SELECT DISTINCT 'patterns', event_type FROM events "
    f"UNION ALL SELECT DISTINCT 'groups', event_type || '|' || (user_id % 5) || '|' || ((epoch_us(ts) // 1000) // {DAY}) FROM events) GROUP BY kind"
)
def cardinality_keys(spark, sf_dir):
    from .streaming import guards

    e = _events(spark, sf_dir).select(F.col("pod_name").alias("stream"), "template_id", F.col("template_id").alias("group_type"), F.col("service").alias("identity"), F.expr(f"ts_ms div {DAY}").alias("window_start_ms"))
    return guards.keys_of(e).groupBy("kind").agg(F.count("*").alias("n"))


# -- anomalies of a monitor, a type of event being one

_PAST_SQL = "CASE WHEN len(past) >= 5 THEN list_aggregate(past, 'median')::DOUBLE END AS baseline"
_MAD_SQL = "CASE WHEN baseline IS NOT NULL THEN list_aggregate(list_transform(past, lambda x: abs(x - baseline)), 'median')::DOUBLE END AS mad"
_SPIKE_SQL = "current > greatest(baseline * 3, baseline + 6 * mad) AND current >= 5"
_WINDOWS_SQL = f"""d AS (SELECT event_type AS monitor, (epoch_us(ts) // 1000) // {DAY} AS "window", count(*) AS n, count(*) FILTER (user_id % 10 < 2) AS bad FROM events GROUP BY 1, 2),
w AS (SELECT monitor, "window", 86400 AS seconds, n * CASE WHEN "window" % 9 = 4 THEN 9 WHEN "window" % 13 = 5 THEN 0 ELSE 1 END AS total, bad * CASE WHEN "window" % 11 = 6 THEN 12 ELSE 1 END AS errors FROM d)"""


def _windows(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(F.col("event_type").alias("monitor"), F.expr(f"ts_ms div {DAY}").alias("window")).agg(F.count("*").alias("n"), F.count_if(F.col("user_id") % 10 < 2).alias("bad"))
    total = F.col("n") * F.when(F.col("window") % 9 == 4, 9).when(F.col("window") % 13 == 5, 0).otherwise(1)
    return e.select("monitor", "window", F.lit(86400).alias("seconds"), total.alias("total"), (F.col("bad") * F.when(F.col("window") % 11 == 6, 12).otherwise(1)).alias("errors"))


def _rounded(found):
    near = lambda c: F.round(c, 9).alias(c)
    return found.select("monitor", "window", "kind", "identity", "direction", near("current"), near("baseline"), near("mad"))


_VOLUMES_SQL = f"""WITH {_WINDOWS_SQL},
k AS (SELECT monitor, "window", 'total_volume' AS kind, total::DOUBLE AS current FROM w UNION ALL SELECT monitor, "window", 'log_rate', total / 86400 FROM w UNION ALL SELECT monitor, "window", 'error_severity', errors::DOUBLE FROM w),
h AS (SELECT *, list(current) OVER (PARTITION BY monitor, kind ORDER BY "window" ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS past FROM k), b AS (SELECT *, {_PAST_SQL} FROM h), m AS (SELECT *, {_MAD_SQL} FROM b),
c AS (SELECT *, CASE WHEN {_SPIKE_SQL} THEN 'spike' WHEN kind <> 'error_severity' AND baseline >= 5 AND current < least(baseline * 0.25, baseline - 6 * mad) THEN 'collapse' END AS direction FROM m)
SELECT monitor, "window", kind, NULL::VARCHAR AS identity, direction, round(current, 9) AS current, round(baseline, 9) AS baseline, round(mad, 9) AS mad FROM c WHERE direction IS NOT NULL"""


@_query(_VOLUMES_SQL)
def anomaly_volumes(spark, sf_dir):
    return _rounded(anomalies.volumes(_windows(spark, sf_dir)))


_GRID_SQL = """x AS (SELECT monitor, "window", row_number() OVER (PARTITION BY monitor ORDER BY "window") AS nth FROM w),
g AS (SELECT i.monitor, i.identity, x.nth, x."window", coalesce(c.n, 0)::DOUBLE AS current FROM (SELECT DISTINCT monitor, identity FROM c) i JOIN x USING (monitor) LEFT JOIN c ON c.monitor = i.monitor AND c.identity = i.identity AND c."window" = x."window"),"""


@_query(
    f"""WITH {_WINDOWS_SQL}, c AS (SELECT event_type AS monitor, (epoch_us(ts) // 1000) // {DAY} AS "window", 'pod' || (user_id % 12) AS identity, count(*) * CASE WHEN ((epoch_us(min(ts)) // 1000) // {DAY} + user_id % 12) % 11 = 0 THEN 12 ELSE 1 END AS n FROM events GROUP BY 1, 2, user_id % 12),
{_GRID_SQL} h AS (SELECT *, list(current) OVER (PARTITION BY monitor, identity ORDER BY nth ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS past FROM g), b AS (SELECT *, {_PAST_SQL} FROM h), m AS (SELECT *, {_MAD_SQL} FROM b)
SELECT monitor, "window", 'pod_volume' AS kind, identity, 'spike' AS direction, current, baseline, mad FROM m WHERE {_SPIKE_SQL}"""
)
def anomaly_members(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(F.col("event_type").alias("monitor"), F.expr(f"ts_ms div {DAY}").alias("window"), (F.col("user_id") % 12).alias("pod")).agg(F.count("*").alias("n"))
    n = F.col("n") * F.when((F.col("window") + F.col("pod")) % 11 == 0, 12).otherwise(1)
    counts = e.select("monitor", "window", F.lit("pod").alias("member"), F.concat(F.lit("pod"), "pod").alias("identity"), n.alias("n"))
    return _rounded(anomalies.members(counts, _windows(spark, sf_dir)))


@_query(
    f"""WITH {_WINDOWS_SQL}, c AS (SELECT event_type AS monitor, (epoch_us(ts) // 1000) // {DAY} AS "window", 'user' || user_id AS identity, count(*) * 5 AS n FROM events GROUP BY 1, 2, 3),
{_GRID_SQL} h AS (SELECT *, list(current) OVER (PARTITION BY monitor, identity ORDER BY nth ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS past FROM g), b AS (SELECT *, {_PAST_SQL} FROM h), m AS (SELECT *, {_MAD_SQL} FROM b),
k AS (SELECT *, CASE WHEN {_SPIKE_SQL} THEN 'pattern_frequency' WHEN current > 0 AND nth > 5 AND list_sum(past) = 0 THEN 'new_pattern' WHEN current = 0 AND nth > 5 AND list_aggregate(past, 'min') > 0 AND baseline >= 5 AND current < least(baseline * 0.25, baseline - 6 * mad) THEN 'pattern_disappearance' END AS kind FROM m)
SELECT monitor, "window", kind, identity, CASE kind WHEN 'pattern_frequency' THEN 'spike' WHEN 'new_pattern' THEN 'new' ELSE 'collapse' END AS direction, current, CASE WHEN kind = 'new_pattern' THEN 0 ELSE baseline END AS baseline, CASE WHEN kind <> 'new_pattern' THEN mad END AS mad FROM k WHERE kind IS NOT NULL"""
)
def anomaly_patterns(spark, sf_dir):
    counts = _events(spark, sf_dir).groupBy(F.col("event_type").alias("monitor"), F.expr(f"ts_ms div {DAY}").alias("window"), F.concat(F.lit("user"), "user_id").alias("template_id")).agg((F.count("*") * 5).alias("n"))
    return _rounded(anomalies.patterns(counts, _windows(spark, sf_dir)))


@_query(
    f"""WITH c AS (SELECT event_type AS monitor, (epoch_us(ts) // 1000) // {DAY} AS "window", CASE WHEN user_id % 20 = 0 THEN 'odd' ELSE 'main' END AS identity, count(*) AS n FROM events GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY monitor, "window") AS errors, row_number() OVER (PARTITION BY monitor, "window" ORDER BY n DESC, identity) AS r FROM c)
SELECT monitor, "window", 'pod_error_concentration' AS kind, identity, 'concentration' AS direction, n::DOUBLE AS current, NULL::DOUBLE AS baseline, NULL::DOUBLE AS mad FROM t WHERE r = 1 AND errors >= 10 AND n / errors >= 0.9"""
)
def anomaly_concentrations(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(F.col("event_type").alias("monitor"), F.expr(f"ts_ms div {DAY}").alias("window"), F.when(F.col("user_id") % 20 == 0, "odd").otherwise("main").alias("identity")).agg(F.count("*").alias("n"))
    windows = e.groupBy("monitor", "window").agg(F.sum("n").alias("errors"))
    return _rounded(anomalies.concentrations(e.withColumn("member", F.lit("pod")), windows))


@_query(
    f"WITH v AS ({_VOLUMES_SQL}), g AS ({_GATE_SQL}) SELECT 'monitor' AS origin, true AS qualified, count(*) AS n, max(\"window\" * {DAY}) AS latest_ms FROM v HAVING count(*) > 0 "
    "UNION ALL SELECT 'events', qualified, count(*), max(window_start_ms) FROM g GROUP BY qualified"
)
def signals_with_anomalies(spark, sf_dir):
    found = anomalies.as_signals(anomalies.volumes(_windows(spark, sf_dir)), DAY)
    both = signals.noise_gate(anomalies.with_signals(signals.aggregate(_events(spark, sf_dir), DAY), found))
    return both.groupBy(F.when(F.col("monitor_anomaly").isNull(), "events").otherwise("monitor").alias("origin"), "qualified").agg(F.count("*").alias("n"), F.max("window_start_ms").alias("latest_ms"))


# -- hits, pages, registry, stamps


@_query(
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN 'pod' || user_id ELSE 'pod' || user_id || CASE event_id % 5 WHEN 0 THEN '-nested' ELSE '-literal' END END AS pod_name, event_id % 5 = 4 AS missing,
  CASE WHEN event_id % 5 = 2 THEN event_type END AS log_level, CASE WHEN event_id % 3 <> 1 THEN json_extract_string(props, '$.k') END AS logger, CASE WHEN event_id % 3 <> 1 THEN 'GET' END AS http_method, CASE WHEN event_id % 3 <> 1 THEN (200 + user_id % 300)::VARCHAR END AS http_status FROM events"""
)
def hit_attributes(spark, sf_dir):
    e, kind = _read(spark, sf_dir, "events"), F.col("event_id") % 5
    pod = F.concat(F.lit("pod"), F.col("user_id").cast("string"))
    inner = F.to_json(F.struct((200 + F.col("user_id") % 300).alias("status_code"), F.lit("get").alias("method"), F.get_json_object("props", "$.k").alias("logger")))
    said = F.when(F.col("event_id") % 3 == 1, "plain text").otherwise(inner)
    part = lambda s, **c: F.to_json(F.struct(said.alias("message"), *[v.alias(k) for k, v in c.items()], *s))
    nested = F.struct(F.concat(pod, F.lit("-nested")).alias("pod_name")).alias("kubernetes")
    literal = F.concat(pod, F.lit("-literal")).alias("kubernetes.pod_name")
    hit = F.when(kind == 0, part([nested])).when(kind == 1, part([nested, literal])).when(kind == 2, part([literal], level=F.col("event_type"))).when(kind == 3, part([F.struct(pod.alias("pod_name"), F.lit(" ").alias("pod_ip")).alias("kubernetes")])).otherwise(part([F.lit("none").alias("kubernetes")]))
    rows = e.select("event_id", F.try_parse_json(hit).alias("v"))
    rows = rows.select("event_id", variants.missing(F.col("v"), "kubernetes.pod_name").alias("missing"), variants.hit_attributes(F.col("v")).alias("a"))
    return rows.select("event_id", "missing", *[F.try_element_at("a", F.lit(k)).alias(k) for k in ("pod_name", "log_level", "logger", "http_method", "http_status")])


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < DATE '1997-01-01' OR (o_orderdate = DATE '1997-01-01' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 250")
def keyset_page(spark, sf_dir):
    import datetime

    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return readers.keyset_page(orders, "o_orderdate", "o_orderkey", 250, (datetime.date(1997, 1, 1), 5000))


@_query(
    """WITH p AS (SELECT 'user' || (user_id % 700) AS key, event_type AS template, epoch_us(ts) // 1000 AS t FROM events), f AS (SELECT key, t, template FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, template) AS n FROM p) WHERE n = 1 AND key NOT IN ('user1', 'user2'))
SELECT 'user1' AS key, 'kept' AS template, 0 AS written_ms UNION ALL SELECT 'user2', 'kept', 0 UNION ALL SELECT * FROM (SELECT key, template, t FROM f ORDER BY t, template, key LIMIT 98)"""
)
def template_registry(spark, sf_dir):
    known = spark.createDataFrame([("user1", "kept", 0), ("user2", "kept", 0)], registry.ENTRIES)
    own = _events(spark, sf_dir).select(F.concat(F.lit("user"), F.col("user_id") % 700).alias("key"), F.col("event_type").alias("template"), F.col("ts_ms").alias("written_ms"))
    return registry.merged(known, own, 100)


@_query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN 'a ' || user_id WHEN 2 THEN user_id::VARCHAR END AS stamp FROM events"
)
def kv_stamps(spark, sf_dir):
    e, kind, user = _read(spark, sf_dir, "events"), F.col("event_id") % 4, F.col("user_id").cast("string")
    line = (
        F.when(kind == 0, F.concat(F.lit("k=(time=1) note=\"time=2\" time="), user, F.lit(", timestamps=3")))
        .when(kind == 1, F.concat(F.lit("time=0 list=[1, 2] timestamp='a "), user, F.lit("' end")))
        .when(kind == 2, F.concat(F.lit("]) @timestamp="), user, F.lit(" {time=5")))
        .otherwise(F.concat(F.lit("don't say time="), user))
    )
    return e.select("event_id", parse.kv_stamp(line).alias("stamp"))


@_query(
    """WITH e AS (SELECT event_id, user_id AS u, event_type AS k, event_id % 5 AS f, epoch_ms(date_trunc('second', ts)) AS t FROM events)
SELECT event_id, 'structured_text' AS format, CASE f WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 3 THEN CASE u % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' ELSE 'ERROR' END WHEN 4 THEN 'ERROR' END AS severity,
  CASE f WHEN 0 THEN k || ' v=' || u WHEN 1 THEN k || ' n=' || u || ' myid=2' WHEN 2 THEN k || ' ' || u WHEN 3 THEN 'GET /' || k || ' HTTP/1.0 (HTTP ' || (200 + 200 * (u % 3) + CASE WHEN u % 3 = 2 THEN -97 ELSE 0 END) || ')' ELSE 'ERROR [' || 'pay-' || k || '] failed ' || u END AS message,
  CASE f WHEN 0 THEN 'CBS' WHEN 1 THEN 'Election' WHEN 2 THEN 'Step_' || k END AS component, CASE f WHEN 4 THEN 'pay-' || k END AS service, CASE f WHEN 3 THEN '10.0.0.' || (u % 250) END AS host,
  CASE f WHEN 0 THEN u::VARCHAR WHEN 1 THEN u::VARCHAR WHEN 3 THEN u::VARCHAR END AS number, CASE f WHEN 1 THEN '2' END AS myid, CASE f WHEN 1 THEN '774' END AS line, CASE f WHEN 3 THEN t END AS ts_ms,
  CASE WHEN f <> 3 THEN 'timezone_missing' END AS time_status FROM e"""
)
def header_canonical(spark, sf_dir):
    """Events as lines of five header families, read again."""
    e, t = _read(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    u, k, clock = F.col("user_id"), F.col("event_type"), F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    status = 200 + 200 * (u % 3) + F.when(u % 3 == 2, -97).otherwise(0)
    made = [
        F.concat(clock, F.lit(", Info                  CBS    "), k, F.lit(" v="), u), F.concat(clock, F.lit(",747 - WARN  [Peer[myid=1]/0:0:Election@774] - "), k, F.lit(" n="), u, F.lit(" myid=2")),
        F.concat(F.date_format(t, "yyyyMMdd-H:m:s:SSS"), F.lit("|Step_"), k, F.lit("|30002312|"), k, F.lit(" "), u),
        F.concat(F.lit("10.0.0."), u % 250, F.lit(" - - ["), F.date_format(t, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), k, F.lit(' HTTP/1.0" '), status, F.lit(" "), u),
        F.concat(clock, F.lit(" ERROR [pay-"), k, F.lit("] failed "), u),
    ]
    raw = F.get(F.array(*made), (F.col("event_id") % 5).cast("int"))
    got = parse.canonical(e.select(F.col("event_id").alias("source_id"), raw.alias("raw")))
    a = lambda key: F.try_element_at("attributes", F.lit(key))
    number = F.coalesce(a("v"), a("n"), a("response_size_bytes"))
    return got.select(F.col("source_id").alias("event_id"), "format", "severity", "message", "component", "service", "host", number.alias("number"), a("myid").alias("myid"), a("line").alias("line"), "ts_ms", "time_status")


@_query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_ms(date_trunc('second', ts)) + 7 * (event_id % 9) WHEN 1 THEN epoch_ms(date_trunc('second', ts)) WHEN 2 THEN epoch_us(ts) // 1000
  ELSE epoch_ms(date_trunc('minute', ts)) - 7200000 END AS ts_ms, CASE WHEN event_id % 4 = 3 THEN 'message_explicit' ELSE 'message_source_timezone' END AS basis FROM events"""
)
def stamp_families(spark, sf_dir):
    """Clocks with their own separators, with weekdays, and without seconds beside an offset."""
    e, t = _read(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    millis = F.lpad((7 * (F.col("event_id") % 9)).cast("string"), 3, "0")
    made = [F.concat(F.date_format(t, "yyyyMMdd-H:m:s"), F.lit(":"), millis), F.date_format(t, "E MMM d HH:mm:ss yyyy"), F.date_format(t, "yyyy-MM-dd-HH.mm.ss.SSSSSS"), F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm"), F.lit("+02:00"))]
    rows = e.select("event_id", F.get(F.array(*made), (F.col("event_id") % 4).cast("int")).alias("stamp"))
    at, basis = times.resolve(F.col("stamp"), F.lit("UTC"), F.lit(None).cast("string"))
    return rows.select("event_id", F.floor(at / 1000).cast("bigint").alias("ts_ms"), basis.alias("basis"))


@_query(
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' WHEN 2 THEN 'DOUBLE' WHEN 3 THEN 'STRING' ELSE 'BIGINT' END AS kind, "
    "CASE event_id % 5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '00' || user_id WHEN 2 THEN user_id || '.5' WHEN 3 THEN event_type ELSE '-' || (user_id + 1) END AS value FROM events"
)
def typed_attributes(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    u = F.col("user_id")
    value = F.get(F.array(u.cast("string"), F.concat(F.lit("00"), u), F.concat(u, F.lit(".5")), F.concat(F.lit('"'), "event_type", F.lit('"')), F.concat(F.lit("-"), u + 1)), (F.col("event_id") % 5).cast("int"))
    rows = e.select("event_id", headers.typed_attributes(headers.scalar_pairs(F.concat(F.lit("op=x, size="), value, F.lit(" size=again list=[1,2]")))).alias("a"))
    held = F.try_element_at("a", F.lit("size"))
    return rows.select("event_id", F.schema_of_variant(held).alias("kind"), held.cast("string").alias("value"))


def _segmented(spark, sf_dir):
    classified = segment.classify(segment.lines(_read(spark, sf_dir, "documents"), "doc_id"), "(?:Licensed|The )")
    return classified, segment.assemble(classified)


@_query(
    "SELECT count(*) AS total_events, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'possible_incomplete') AS possible_incomplete, 0::BIGINT AS confirmed_truncated, count(*) FILTER (status = 'orphan') AS orphan, "
    "count(*) FILTER (emission_reason = 'analysis_end') AS analysis_end_events FROM (SELECT *, CASE WHEN orphan THEN 'orphan' WHEN emission_reason = 'analysis_end' THEN 'possible_incomplete' ELSE 'complete' END AS status FROM (" + _SEGMENT_SQL + "))"
)
def boundary_counts(spark, sf_dir):
    return quality.boundaries(_segmented(spark, sf_dir)[1])


@_query(
    "SELECT doc_id, event_no, CASE WHEN orphan THEN 'orphan' ELSE 'possible_incomplete' END AS boundary_status, emission_reason, line_count, start_ordinal, end_ordinal FROM (" + _SEGMENT_SQL + ") WHERE orphan OR emission_reason = 'analysis_end' ORDER BY doc_id, event_no LIMIT 200"
)
def boundary_samples(spark, sf_dir):
    return quality.affected(_segmented(spark, sf_dir)[1]).withColumnRenamed("stream", "doc_id").drop("stream_id")


@_query(
    _SEGMENT_SQL.rsplit("e AS (", 1)[0]
    + "g AS (SELECT doc_id, event_no, count(*) AS line_count, sum((NOT blank)::INT) AS held FROM n WHERE NOT (blank AND before = 0) GROUP BY doc_id, event_no) "
    "SELECT *, nonblank = accounted AS zero_loss, round(internal / nonblank * 100, 2) AS undersegmentation_rate FROM (SELECT count(*) AS lines, sum((NOT blank)::INT)::BIGINT AS nonblank, sum((hit AND NOT blank AND NOT start)::INT)::BIGINT AS internal FROM n), "
    "(SELECT count(*) AS events, count(*) FILTER (line_count = 1) AS single, count(*) FILTER (line_count > 1) AS multiline, min(line_count) AS min_lines, max(line_count) AS max_lines, sum(held)::BIGINT AS accounted FROM g)"
)
def line_accounting(spark, sf_dir):
    return quality.accounting(*_segmented(spark, sf_dir))


@_query(
    "WITH " + _LINES_SQL + r""", s AS (SELECT list_transform(list_filter(regexp_split_to_array(line, '\s+'), lambda t: t <> '')[1:8], lambda t: regexp_replace(regexp_replace(t, '[\p{L}\p{M}]+', 'a', 'g'), '\d+', '9', 'g')) AS shape,
  starts_with(line, 'Licensed') OR starts_with(line, 'The ') AS fits FROM l WHERE regexp_matches(line, '\S')), c AS (SELECT shape, fits, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT *, NOT fits AND EXISTS (SELECT 1 FROM c AS o WHERE o.fits AND len(list_filter(list_zip(c.shape, o.shape), lambda x: x[1] = x[2])) >= 0.75 * greatest(len(c.shape), len(o.shape))) AS near FROM c)
SELECT *, matched >= 3 AND similar_unmatched > 0 AS suspicious FROM (SELECT coalesce(sum(n) FILTER (fits), 0)::BIGINT AS matched, coalesce(sum(n) FILTER (NOT fits), 0)::BIGINT AS unmatched, coalesce(sum(n) FILTER (near), 0)::BIGINT AS similar_unmatched FROM m)"""
)
def partial_misses(spark, sf_dir):
    lines = segment.lines(_read(spark, sf_dir, "documents"), "doc_id")
    return quality.partial_misses(lines.select("line", F.col("line").rlike("^(?:Licensed|The )").alias("matched")))


@_query(
    """WITH e AS (SELECT event_id % 5 AS f, event_id % 7 = 0 AS gone, event_id % 11 = 0 AS lost FROM events), p AS (SELECT *, f < 2 AS timed, CASE f WHEN 0 THEN 'message_explicit' WHEN 1 THEN 'source_record' ELSE 'untimed' END AS basis,
  CASE f WHEN 0 THEN 'resolved' WHEN 2 THEN 'timezone_missing' ELSE 'missing' END AS status FROM e),
c AS (SELECT 'count' AS kind, unnest(['events_total', 'parser_no_event', 'parsed_events_total', 'source_timestamp_present', 'source_timestamp_not_detected', 'parsed_timestamp_resolved', 'parsed_timestamp_unresolved', 'downstream_events_total',
    'downstream_timestamp_resolved', 'downstream_timestamp_unresolved', 'parsed_events_not_delivered', 'parsed_resolved_not_delivered', 'timestamp_lost', 'timestamp_changed']) AS name, NULL::VARCHAR AS status,
  unnest([true, f = 4, f < 4, f < 3, f = 3, timed, f IN (2, 3), f < 4 AND NOT gone, timed AND NOT gone AND NOT lost, f < 4 AND NOT gone AND NOT (timed AND NOT lost), f < 4 AND gone, timed AND gone, timed AND NOT gone AND lost, timed AND NOT gone AND lost]) AS said FROM p)
SELECT kind, name, status, count(*) AS n FROM c WHERE said GROUP BY ALL UNION ALL SELECT 'basis', basis, NULL, count(*) FROM p WHERE f < 4 GROUP BY ALL UNION ALL SELECT 'parser', 'json', status, count(*) FROM p WHERE f < 4 GROUP BY ALL"""
)
def time_counters(spark, sf_dir):
    """Events as JSON: with an instant, with the record's own, with a clock alone, with none, and blank; some don't arrive, some lose their time."""
    e, t = _read(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    f = (F.col("event_id") % 5).cast("int")
    stamp = F.when(f == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(f == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    raw = F.when(f == 4, F.lit(" ")).otherwise(F.to_json(F.struct(stamp.alias("time"), F.col("event_type").alias("msg"))))
    rows = e.select(F.col("event_id").alias("source_id"), raw.alias("raw"), F.when(f == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("source_timestamp"))
    parsed = parse.canonical(rows)
    went = parsed.where(F.col("format").isNotNull() & (F.col("source_id") % 7 != 0)).select("source_id", F.when(F.col("source_id") % 11 != 0, F.col("ts_ms")).alias("ts_ms"))
    return quality.time_counters(parsed, went, "source_id")


def _records(spark, sf_dir):
    """Events as records of three namespaces, and the end of their time."""
    e = _read(spark, sf_dir, "events")
    r = e.select(
        F.concat(F.lit("ns"), F.col("user_id") % 3).alias("namespace"), F.concat(F.lit("w"), F.col("user_id") % 700).alias("workload"), F.col("event_type").alias("container"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("sequence"), F.concat(F.lit("password=hush; did "), F.col("event_type"), F.lit(" "), F.col("event_id")).alias("message"),
    )
    return r, (r.agg(F.max("ts_ms")).first()[0] or 0) + 1


_RECORDS_SQL = "WITH r AS (SELECT 'ns' || (user_id % 3) AS namespace, 'w' || (user_id % 700) AS workload, event_type AS container, epoch_us(ts) // 1000 AS ts_ms, event_id AS sequence FROM events), f AS (SELECT *, max(ts_ms) OVER () + 1 AS e FROM r), d AS (SELECT * FROM f WHERE ts_ms >= e - 86400000) "


@_query(
    _RECORDS_SQL + "SELECT namespace, workload, n > 20 AS truncated FROM (SELECT namespace, workload, row_number() OVER (PARTITION BY namespace ORDER BY workload) AS nth, count(*) OVER (PARTITION BY namespace) AS n FROM (SELECT DISTINCT namespace, workload FROM d)) WHERE nth <= 20"
)
def target_options(spark, sf_dir):
    records, end = _records(spark, sf_dir)
    return targets.options(records, "workload", end, most=20)


@_query(
    _RECORDS_SQL + ", s AS (SELECT *, ts_ms >= e - 900000 AS late, row_number() OVER (PARTITION BY namespace, container ORDER BY ts_ms DESC, sequence DESC) AS nth FROM d) "
    "SELECT namespace, container, count(*) FILTER (late) AS events, max(ts_ms) FILTER (late) AS latest_ms, coalesce(string_agg('[redacted]; did ' || container || ' ' || sequence, '|' ORDER BY nth) FILTER (late AND nth <= 10), '') AS samples, "
    "CASE WHEN count(*) FILTER (late) > 0 THEN 'LIVE' ELSE 'QUIET' END AS state FROM s GROUP BY namespace, container"
)
def target_validation(spark, sf_dir):
    records, end = _records(spark, sf_dir)
    merged = records.select("namespace", F.col("container").alias("workload"), "ts_ms", "sequence", "message")
    got = targets.validated(merged, end, "workload")
    return got.select("namespace", F.col("workload").alias("container"), "events", "latest_ms", F.array_join("samples", "|").alias("samples"), "state")


@_query(
    """WITH h AS (SELECT event_id // 20 AS page, event_id AS id, CASE WHEN event_id % 97 = 0 THEN 'message' WHEN event_id % 89 = 0 THEN 'timestamp' WHEN event_id % 83 = 0 THEN 'pod' WHEN event_id % 79 = 0 THEN 'sequence' END AS fault FROM events),
w AS (SELECT *, count(fault) OVER (PARTITION BY page) AS bad FROM h)
SELECT page, 'kept' AS outcome, count(*) AS hits, 0::BIGINT AS faulty, NULL AS fault FROM w WHERE bad = 0 GROUP BY page
UNION ALL SELECT page, 'refused', count(*), count(fault), (list(fault ORDER BY id) FILTER (fault IS NOT NULL))[1] FROM w WHERE bad > 0 GROUP BY page"""
)
def strict_hits(spark, sf_dir):
    """Events as hits, twenty a page, some of them broken: whole pages and refusals."""
    e, i = _read(spark, sf_dir, "events"), F.col("event_id")
    message = F.when(i % 97 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    at = F.when(i % 89 == 0, F.lit("true")).otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    pod = F.when(i % 83 == 0, F.lit('" "')).otherwise(F.concat(F.lit('"pod'), "user_id", F.lit('"')))
    sequence = F.when(i % 79 == 0, F.lit("1.5")).otherwise(i.cast("string"))
    source = F.concat(F.lit('{"message":'), message, F.lit(',"@timestamp":'), at, F.lit(',"sequence":'), sequence, F.lit(',"cluster_id":"c","kubernetes":{"namespace_name":"n","pod_name":'), pod, F.lit(',"container_name":"x"}}'))
    rows = e.select(F.floor(i / 20).cast("bigint").alias("page"), F.lit("logs").alias("index"), F.lpad(i.cast("string"), 12, "0").alias("id"), F.lit(None).cast("bigint").alias("version"), F.try_parse_json(source).alias("source"))
    whole, refused = hits.pages(hits.checked(rows), "page")
    kept = whole.groupBy("page").agg(F.lit("kept").alias("outcome"), F.count("*").alias("hits"), F.lit(0).cast("bigint").alias("faulty"), F.lit(None).cast("string").alias("fault"))
    return kept.unionByName(refused.select("page", F.lit("refused").alias("outcome"), "hits", "faulty", "fault"))


@_query(
    "SELECT 'tpl_' || event_type AS template_id, 'svc' || (user_id % 5) AS identity, count(*) AS count, nullif(count(*) FILTER (event_id % 3 = 0), 0) AS explicit, nullif(count(*) FILTER (event_id % 3 = 1), 0) AS record, nullif(count(*) FILTER (event_id % 3 = 2), 0) AS zoned, (count(DISTINCT event_id % 3)) AS kinds "
    f"FROM events GROUP BY event_type, user_id % 5, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {DAY}"
)
def signal_bases(spark, sf_dir):
    basis = F.get(F.array(F.lit("message_explicit"), F.lit("source_record"), F.lit("message_source_timezone")), (F.col("event_id") % 3).cast("int"))
    got = signals.aggregate(_events(spark, sf_dir).withColumn("basis", basis), DAY)
    n = lambda k: F.try_element_at("basis_counts", F.lit(k))
    return got.select("template_id", "identity", "count", n("message_explicit").alias("explicit"), n("source_record").alias("record"), n("message_source_timezone").alias("zoned"), F.size("basis_counts").cast("bigint").alias("kinds"))


@_query("SELECT *, row_number() OVER (ORDER BY severity_min, start_ms, incident_id)::INTEGER AS place FROM (SELECT 'inc' || user_id AS incident_id, min(" + _SQL_NUMBER + ") AS severity_min, min(epoch_us(ts) // 1000) AS start_ms FROM events GROUP BY user_id) ORDER BY severity_min, start_ms, incident_id LIMIT 5")
def foremost_incidents(spark, sf_dir):
    """Each user's events as one incident: the five foremost."""
    found = _events(spark, sf_dir).groupBy(F.concat(F.lit("inc"), F.col("user_id")).alias("incident_id")).agg(F.min(T.severity_number(F.col("severity"))).alias("severity_min"), F.min("ts_ms").alias("start_ms"))
    return incidents.foremost(found)
