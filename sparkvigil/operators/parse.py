"""Raw events to canonical events: one parser for each format, routing, and what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions import times
from ..functions.generalise import generalise
from . import headers
from . import policies as line_policies
from .headers import unquoted

_FIELDS = "struct<severity: string, message: string, stamp: string, service: string, host: string, component: string, attributes: map<string, string>>"


def _fields(severity: Column, message: Column, stamp: Column, attributes: Column, service: Column | None = None, host: Column | None = None, component: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    named = {"severity": severity, "message": message, "stamp": stamp, "service": service, "host": host, "component": component}
    return F.struct(*[(none if c is None else c.cast("string")).alias(k) for k, c in named.items()], attributes.cast("map<string,string>").alias("attributes"))


def _without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def _get(m: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(m, F.lit(key)), F.lit(""))


def json_fields(log: Column) -> Column:
    """Time, level and message by the usual names; the rest are attributes, nested ones as JSON. No message: all that is left."""
    return T.let(F.from_json(log, "map<string,string>"), _json_fields)


def _json_fields(m: Column) -> Column:
    stamp = F.coalesce(_get(m, "timestamp"), _get(m, "time"), _get(m, "@timestamp"))
    level = F.upper(F.trim(F.coalesce(_get(m, "level"), _get(m, "severity"), _get(m, "status"), F.lit("INFO"))))
    numbers = F.create_map(*[F.lit(x) for pair in P.NUMERIC_LEVELS.items() for x in pair])
    rest = _without(m, "timestamp", "time", "@timestamp", "level", "severity", "status", "message", "msg")
    message = F.coalesce(_get(m, "message"), _get(m, "msg"), F.to_json(rest))
    return _fields(F.coalesce(F.try_element_at(numbers, level), level), F.trim(message), stamp, rest)


def kv_pairs(log: Column) -> Column:
    """map of key=value, quotes removed; the first value of a repeated key stays."""
    return T.first_pairs(F.regexp_extract_all(log, F.lit(P.KV_PAIR), F.lit(1)), F.regexp_extract_all(log, F.lit(P.KV_PAIR), F.lit(2)), unquoted)


# The names of an event's own time, in the order in which they count.
STAMP_KEYS = ("timestamp", "time", "@timestamp")
_STAMP = r"""^(timestamp|time|@timestamp)=("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\s,\]\})]+)"""


def kv_stamp(log: Column) -> Column:
    """The time that the first line of ``log`` assigns at its top level: outside quotes and brackets, at the start or after white space; null if none does.

    One pass over the line's characters carries the depth of brackets, the open quote and the first value of each of STAMP_KEYS. A quote
    that nothing closes, or a bracket, hides what follows; a value may hold anything but white space, commas and closing brackets, or is quoted.
    """
    header = F.substring_index(log, "\n", 1)

    def scanned(chars: Column) -> Column:
        none = F.lit(None).cast("string")
        start = F.struct(F.lit(0).alias("depth"), none.alias("quote"), F.lit(False).alias("escaped"), F.lit(0).alias("until"), F.expr("cast(map() as map<string,string>)").alias("found"))

        def step(s: Column, i: Column) -> Column:
            c = F.get(chars, i)

            def after(depth=s["depth"], quote=s["quote"], escaped=F.lit(False), until=s["until"], found=s["found"]) -> Column:
                return F.struct(depth.alias("depth"), quote.alias("quote"), escaped.alias("escaped"), until.alias("until"), found.alias("found"))

            # only a letter that may begin a key, in a place for one, costs a look ahead
            place = (s["depth"] == 0) & c.isin("t", "@") & ((i == 0) | F.get(chars, i - 1).rlike(r"(?U)\s"))
            tail = F.when(place, F.array_join(F.slice(chars, i + 1, F.size(chars)), ""))
            key, value = F.regexp_extract(tail, _STAMP, 1), F.regexp_extract(tail, _STAMP, 2)
            plain = F.when(F.left(value, F.lit(1)).isin('"', "'"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
            added = F.when(F.map_contains_key(s["found"], key), s["found"]).otherwise(F.map_concat(s["found"], F.create_map(key, plain)))
            return (
                F.when(i < s["until"], s)
                .when(s["quote"].isNotNull(), F.when(s["escaped"], after()).when(c == "\\", after(escaped=F.lit(True))).when(c == s["quote"], after(quote=none)).otherwise(after()))
                .when(c.isin('"', "'"), after(quote=c))
                .when(c.isin("{", "[", "("), after(depth=s["depth"] + 1))
                .when(c.isin("}", "]", ")"), after(depth=F.greatest(F.lit(0), s["depth"] - 1)))
                .when(place & (F.coalesce(key, F.lit("")) != ""), after(until=i + F.length(F.regexp_extract(tail, _STAMP, 0)), found=added))
                .otherwise(s)
            )

        found = F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step)["found"]
        return F.coalesce(*[F.try_element_at(found, F.lit(k)) for k in STAMP_KEYS])

    # lines without such an assignment aren't scanned
    chars = F.when(header.rlike(r"(?:^|\s)(?:timestamp|time|@timestamp)="), F.split(header, ""))
    return F.get(F.transform(F.filter(F.array(chars), lambda x: x.isNotNull()), scanned), F.lit(0))


def kv_fields(log: Column) -> Column:
    """Level and message by name, else a bracketed level and what follows the last ' - '; time from the first line's own assignment."""
    return T.let(kv_pairs(log), lambda m: _kv_fields(log, m))


def _kv_fields(log: Column, m: Column) -> Column:
    level = F.coalesce(_get(m, "level"), _get(m, "severity"), F.nullif(F.regexp_extract(log, r"(?i)\[(ERROR|WARN|WARNING|INFO|DEBUG|CRITICAL|FATAL)\]", 1), F.lit("")))
    message = F.coalesce(_get(m, "msg"), _get(m, "message"), F.element_at(F.split(log, " - "), -1))
    return _fields(level, F.regexp_replace(message, "^[\"' ]+|[\"' ]+$", ""), kv_stamp(log), _without(m, "timestamp", "time", "level", "severity", "msg", "message"))


def syslog_fields(log: Column) -> Column:
    """RFC 5424 and 3164: severity from the priority, mod 8, else from a level word; 3164 stamps have no year and give no instant."""
    def part(p: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(log, p, i), F.lit(""))

    new = log.rlike(P.RFC5424)
    pri = F.when(new, part(P.RFC5424, 1)).otherwise(part(P.RFC3164, 1)).try_cast("int")
    names = F.array(*[F.lit(s) for s in P.SYSLOG_SEVERITIES])
    pick = lambda a, b: F.when(new, part(P.RFC5424, a)).otherwise(part(P.RFC3164, b))
    message = pick(5, 5)
    app = F.regexp_replace(pick(4, 4), r"\[\d+\]$", "")
    level = F.coalesce(F.get(names, pri % 8), F.upper(F.nullif(F.regexp_extract(message, P.LEVEL_WORD, 1), F.lit(""))))
    out = _fields(level, message, pick(2, 2), kv_pairs(F.coalesce(message, F.lit(""))), service=app, host=pick(3, 3))
    return F.when(new | log.rlike(P.RFC3164), out)


def structured_fields(log: Column) -> Column:
    """Texts of a known header family by its parts; else header stamp, level word and service within 256 characters, access logs with severity by status, and the rest of the text as message."""
    kept = lambda k: _fields(k["severity"], k["message"], k["stamp"], k["attributes"], host=k["host"], component=k["component"]).cast(_FIELDS)
    known = T.let(headers.by_family(log), lambda k: F.when(k.isNotNull(), kept(k)))
    return F.coalesce(known, T.let(headers.optional(log), lambda more: T.let(times.header_stamp(log), lambda stamp: _stamped(log, stamp, more))))


def _stamped(log: Column, stamp: Column, more: Column) -> Column:
    head = F.left(F.substring_index(log, "\n", 1), F.lit(256))
    code = F.regexp_extract(head, r'"[A-Z]+ \S+ [^"]*" (\d{3})\b', 1)
    by_status = F.when(code >= "500", "ERROR").when(code >= "400", "WARNING").when(code != "", "INFO")
    level = F.coalesce(by_status, F.upper(F.nullif(F.regexp_extract(head, P.LEVEL_WORD, 1), F.lit(""))))
    klog = F.regexp_extract(head, r"^([IWEF])\d{4}\s", 1)
    level = F.coalesce(level, F.when(klog == "I", "INFO").when(klog == "W", "WARNING").when(klog == "E", "ERROR").when(klog == "F", "FATAL"))
    after = F.substring(log, F.instr(log, stamp) + F.length(stamp), F.length(log))
    message = F.when(stamp.isNotNull(), F.regexp_replace(after, r"^[\]\s|:\-]+", "")).otherwise(log)
    none = F.expr("cast(map() as map<string,string>)")
    pairs = F.map_filter(F.map_concat(kv_pairs(log), F.when(code != "", F.create_map(F.lit("http_status"), code)).otherwise(none)), lambda k, v: k != "")
    attributes = headers.over(pairs, F.coalesce(more["attributes"], none))
    service, component = F.coalesce(more["service"], T.infer_service(head)), F.coalesce(more["component"], T.infer_component(head))
    return _fields(level, F.coalesce(F.nullif(message, F.lit("")), log), stamp, attributes, service=service, component=component).cast(_FIELDS)


def positional_fields(log: Column) -> Column:
    """Fixed columns: two location columns and two dates must agree."""
    p = (
        r"(?i)^(\S+)\s+\d+\s+(\d{4})\.(\d{2})\.(\d{2})\s+(?<location>\S+)\s+(\2-\3-\4-\d{2}\.\d{2}\.\d{2}\.\d+)\s+\k<location>\s+"
        r"([A-Za-z][A-Za-z0-9_.-]*)\s+([A-Za-z][A-Za-z0-9_.-]*)\s+(FATAL|CRITICAL|ERROR|SEVERE|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE)\s+([\s\S]*)"
    )
    g = lambda i: F.regexp_extract(log, p, i)
    out = _fields(F.upper(g(9)), g(10), g(6), F.create_map(F.lit("facility"), g(7)), host=g(5), component=g(8))
    return F.when(log.rlike(p), out)


def plain_fields(log: Column) -> Column:
    """The whole text is the message; a level word within the first line's 512 characters."""
    first = F.left(F.substring_index(log, "\n", 1), F.lit(512))
    level = F.upper(F.nullif(F.regexp_extract(first, P.LEVEL_WORD, 1), F.lit("")))
    return _fields(level, log, times.header_stamp(log), F.expr("cast(map() as map<string,string>)"))


PARSERS = {
    "json": json_fields, "syslog": syslog_fields, "positional_structured": positional_fields,
    "structured_text": structured_fields, "kv": kv_fields, "plain_text": plain_fields,
}


def canonical(raw: DataFrame, text: str = "raw", zone: str | None = None, assignments: DataFrame | None = None, policies: DataFrame | None = None, stream: str = "stream") -> DataFrame:
    """Adds the canonical columns to raw events: format, delivery, severity, message, service, host, component, trace_id,
    span_id, attributes, ts_ms, basis and event_id.

    Plain text of a stream that ``assignments`` (stream, policy_id) gives one of ``policies`` (``policies.compiled``) is read by that policy; it adds
    policy_id, null where no policy was used.

    A format's parser that finds nothing falls back to plain text (FALLBACK); blank events are IGNORED. ``zone`` (a column, null where
    unknown) localises clocks without offset; ``source_timestamp``, where there is one, is the record's own time.
    """
    log = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    given = raw.columns
    if policies is not None:
        held = line_policies.held(assignments, policies).select("_stream", F.col("policy_id").alias("_policy"), F.col("pattern").alias("_pattern"), F.col("groups").alias("_groups"))
        raw = raw.join(held, F.col(stream) == F.col("_stream"), "left").drop("_stream")
    rows = raw.withColumn("_log", log).withColumn("format", T.format_of(F.col("_log")))
    parsed = None
    if policies is not None:
        by_policy = line_policies.fields(F.col("_log"), F.col("_pattern"), F.col("_groups"))
        parsed = F.when((F.col("format") == "plain_text") & F.col("_pattern").isNotNull(), T.let(by_policy, lambda own: _with_traces(own).cast(_FIELDS)))
    for name, parser in PARSERS.items():
        parsed = (F if parsed is None else parsed).when(F.col("format") == name, parser(F.col("_log")).cast(_FIELDS))
    rows = rows.withColumn("_own", parsed).withColumn("_f", F.coalesce("_own", F.when(F.col("format").isNotNull(), plain_fields(F.col("_log")).cast(_FIELDS))))
    delivery = F.when(F.col("format").isNull(), "IGNORED").when(F.col("_own").isNull(), "FALLBACK").otherwise("PARSED")
    a = F.col("_f.attributes")
    first = lambda own, *keys: F.coalesce(*([F.nullif(F.col(f"_f.{own}"), F.lit(""))] if own else []), *[_get(a, k) for k in keys])
    z = F.col(zone) if zone else F.lit(None).cast("string")
    source = F.col("source_timestamp").cast("string") if "source_timestamp" in raw.columns else F.lit(None).cast("string")
    rows = rows.withColumn("_time", times.reading(F.col("_f.stamp"), z)).withColumn("_record", times.normalise(source))
    at, basis = times.resolved(F.col("_time"), F.col("_record"))
    out = rows.withColumn("delivery", delivery).withColumn("severity", T.normal_severity(F.col("_f.severity"))).withColumn("message", F.coalesce(F.nullif(F.col("_f.message"), F.lit("")), F.col("_log")))
    out = out.withColumn("service", first("service", "service", "service_name", "app", "application")).withColumn("host", first("host", "host", "hostname")).withColumn("component", first("component", "component", "logger"))
    out = out.withColumn("trace_id", first(None, "trace_id", "traceId")).withColumn("span_id", first(None, "span_id", "spanId"))
    moved = ("service", "service_name", "app", "application", "host", "hostname", "component", "logger", "trace_id", "traceId", "span_id", "spanId")
    out = out.withColumn("attributes", _without(a, *moved)).withColumn("ts_ms", F.floor(at / 1000).cast("bigint")).withColumn("basis", basis).withColumn("time_status", times.status_of(F.col("_f.stamp"), z, F.col("_time")))
    if policies is not None:
        out = out.withColumn("policy_id", F.when((F.col("format") == "plain_text") & F.col("_own").isNotNull(), F.col("_policy")))
    identity = F.concat_ws("|", *[F.col(c).cast("string") for c in given if c != text and not c.startswith("attr")], text)
    return out.withColumn("event_id", F.substring(F.sha2(identity, 256), 1, 32)).drop("_log", "_own", "_f", "_time", "_record", "_policy", "_pattern", "_groups")


def _with_traces(own: Column) -> Column:
    """A policy's fields as those of the other parsers, whose trace and span stand among the attributes."""
    none = F.expr("cast(map() as map<string,string>)")
    named = lambda k: F.when(own[k].isNotNull(), F.create_map(F.lit(k), own[k])).otherwise(none)
    rest = F.map_filter(own["attributes"], lambda k, v: ~k.isin("trace_id", "span_id"))
    return F.when(own.isNotNull(), _fields(own["severity"], own["message"], own["stamp"], F.map_concat(rest, named("trace_id"), named("span_id")), own["service"], own["host"], own["component"]))


def templated(events: DataFrame) -> DataFrame:
    """Adds masked, template, template_id and template_reliable; events with a blank message go.

    Stateless: a template is what masking and generalisation leave of the message, so equal messages have equal templates on any partitioning.
    """
    # no filter on the message: pushed below the parsers, it would parse every event a second time
    said = F.trim(F.coalesce("message", F.lit(""))) != ""
    rows = events.withColumn("template", F.explode(F.when(said, F.array(generalise(T.mask(T.premask(F.col("message"))))["template"]))))
    return rows.withColumn("template_id", T.template_id(F.col("template"))).withColumn("template_reliable", T.reliable(F.col("template")))
