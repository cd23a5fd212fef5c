"""Text functions: masking, redaction, severity, failure classes, workloads, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def first_pairs(keys: Column, values: Column, plain) -> Column:
    """map of each key to ``plain`` of its first value, in the order of their first places; ``keys`` and ``values`` go by place. The pairs are found once and sorted, not sought for each key."""
    placed = F.transform(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"), x["value"].alias("value")))
    first = let(F.sort_array(placed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"])))
    ordered = F.sort_array(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["key"].alias("key"), x["value"].alias("value"))))
    return F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["key"].alias("key"), plain(x["value"]).alias("value"))))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _replace(text: Column, rules) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, "(?U)" + pattern, by)
    return text


def _masked(text: Column, rules, needs) -> Column:
    """``_replace`` where each rule searches only the texts that hold what it can't match without. Whether there is a digit is asked once."""

    def step(rule, need, digit: Column):
        after = lambda x: F.regexp_replace(x, "(?U)" + rule[0], rule[1])
        return lambda x: after(x) if need is None else F.when(digit if need == P.DIGIT else F.contains(x, F.lit(need)), after(x)).otherwise(x)

    def steps(x: Column, digit: Column) -> Column:
        for rule, need in zip(rules, needs, strict=True):
            x = let(x, step(rule, need, digit))
        return x

    return let(text, lambda x: let(x.rlike(P.DIGIT), lambda digit: steps(x, digit)))


def premask(text: Column) -> Column:
    """URLs, ids, addresses, hashes, paths, files and long numbers as general labels; empty for null."""
    return _masked(F.coalesce(text, F.lit("")), P.PREMASKS, P.PREMASK_NEEDS)


def mask(message: Column) -> Column:
    """A message with its runtime values masked: identity fields first, then typed values, then compounds and numbers."""
    return _masked(collapse(message), P.MASKS, P.MASK_NEEDS)


def variable_ratio(template: Column) -> Column:
    """Share of tokens that hold a variable marker; null without tokens."""
    tokens = F.filter(F.split(template, " "), lambda t: t != "")
    variable = F.filter(tokens, lambda t: _any(*[F.contains(t, F.lit(m)) for m in P.VARIABLE_TOKENS]))
    return F.when(F.size(tokens) > 0, F.size(variable) / F.size(tokens))


def reliable(template: Column, most: float = 0.6) -> Column:
    """The quality gate: a literal token at least, and at most such a share of variable ones."""
    ratio = variable_ratio(template)
    return F.coalesce((ratio < 1) & (ratio <= most), F.lit(False))


def template_id(template: Column) -> Column:
    return F.concat(F.lit("tpl_"), F.substring(F.sha2(template, 256), 1, 16))


def alarm_template_id(service: Column, alarm_type: Column) -> Column:
    return F.concat(F.lit("alarm:"), F.substring(F.sha1(F.concat_ws("|", service, alarm_type)), 1, 12))


def bounded(template: Column, limit: int = 8192, marker: str = " ... ") -> Column:
    """At most ``limit`` characters: the head, a marker and the tail of longer templates."""
    head = (limit - len(marker)) // 2
    tail = limit - len(marker) - head
    cut = F.concat(F.left(template, F.lit(head)), F.lit(marker), F.right(template, F.lit(tail)))
    return F.when(F.length(template) <= limit, template).otherwise(cut)


def redact(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Known secrets (longest first), private keys, labelled values, bearer tokens, JWTs, vendor keys and URL logins, as [redacted]."""
    for s in sorted((s for s in secrets if s), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("[redacted]"))
    return _replace(text, P.REDACTIONS)


def _any(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def matches(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text, F.lit("")).rlike(P.words(words))


def is_failure(text: Column) -> Column:
    return matches(text, P.FAILURE_WORDS)


def is_success(text: Column) -> Column:
    return matches(text, P.SUCCESS_WORDS)


def normal_severity(value: Column) -> Column:
    """Upper case without quotes; WARN is WARNING; null for blank."""
    up = F.trim(F.regexp_replace(F.upper(value), "^[\"' ]+|[\"' ]+$", ""))
    return F.when(F.trim(value) == "", None).when(up == "WARN", "WARNING").otherwise(up)


def severity_number(value: Column) -> Column:
    """1 (fatal) to 7 (debug); 6 for anything else, null included."""
    known = F.create_map(*[F.lit(x) for pair in P.SEVERITY_NUMBERS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(F.coalesce(value, F.lit("INFO")))), F.lit(6))


def failure_class(text: Column, alarm_type: Column, severity: Column) -> Column:
    """The alarm's own type where it has one, else the first failure class whose words occur, else by severity."""
    own = F.lower(F.trim(F.coalesce(alarm_type, F.lit(""))))
    out = F.when(~own.isin("", "none", "unknown"), own)
    for name, words in P.FAILURE_CLASSES.items():
        out = out.when(matches(text, words), name)
    return out.when(severity <= 3, "generic_error").otherwise("informational")


def failure_domain(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for name, parts in P.FAILURE_DOMAINS.items():
        out = out.when(_any(*[F.contains(low, F.lit(p)) for p in parts]), name)
    return out.otherwise("application")


def known(value: Column) -> Column:
    """The trimmed value, or null where it says that it is missing."""
    v = F.trim(value)
    return F.when(F.lower(v).isin(*P.MISSING), None).otherwise(v)


def workload(named: list[Column], pods: Column, hashes: Column, service_ids: Column, namespace: Column) -> Column:
    """The first named field that says something; else what a pod's name says before its template
    hash or suffix; else service_<first service id>; else the namespace."""

    def before_hash(pod: Column) -> Column:
        cut = F.transform(hashes, lambda h: F.when(F.contains(pod, F.concat(F.lit("-"), h, F.lit("-"))), F.split_part(pod, F.concat(F.lit("-"), h, F.lit("-")), F.lit(1))))
        return F.get(F.filter(cut, lambda x: x.isNotNull() & (x != "")), F.lit(0))

    def of(pod: Column) -> Column:
        short = F.regexp_replace(pod, P.POD_SUFFIX, "")
        return F.coalesce(before_hash(pod), F.when((short != "") & (short != pod), short))

    usable = F.filter(F.transform(pods, lambda p: known(p)), lambda p: p.isNotNull())
    by_pod = F.get(F.filter(F.transform(usable, of), lambda x: x.isNotNull()), F.lit(0))
    by_id = F.concat(F.lit("service_"), known(F.get(service_ids, F.lit(0))))
    return F.coalesce(*[known(c) for c in named], by_pod, by_id, known(namespace))


def infer_service(text: Column) -> Column:
    first, second = (F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in P.SERVICE_NAMES)
    return F.substring_index(F.coalesce(first, second), ":", 1)


def infer_component(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, P.JAVA_COMPONENT, 1), F.lit(""))


def evidence_line(text: Column, limit: int = 240) -> Column:
    """Redacted, the error line of a traceback if there is one, on one line, clipped."""
    safe = redact(F.coalesce(text, F.lit("")))
    error = F.regexp_extract(safe, r"(?m)^([A-Za-z_][\w.]*(?:Error|Exception)\b[^\n]*)$", 1)
    line = collapse(F.when(error != "", error).otherwise(safe))
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit - 1)), F.lit("…"))).otherwise(line)


def looks_like_kv(log: Column) -> Column:
    """Two assignments, or one near the start: after at most 64 characters and 4 words."""
    at = F.regexp_instr(log, F.lit(P.KV_ASSIGNMENT))
    prefix = F.trim(F.substring(log, F.lit(1), F.greatest(at - 1, F.lit(0))))
    short = (prefix == "") | ((F.length(prefix) <= 64) & (F.size(F.split(prefix, r"\s+")) <= 4))
    return F.contains(log, F.lit("=")) & (log.rlike(P.KV_TWO) | ((at > 0) & short))


def detect_format(log: Column) -> Column:
    """json, syslog, positional_structured, structured_text, kv or plain_text; null for blank text."""
    return let(F.regexp_replace(log, r"(?U)^\s+|\s+$", ""), format_of)


def format_of(t: Column) -> Column:
    """``detect_format`` of a text without white space at its ends."""
    is_json = F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull()
    structured = _any(*[t.rlike(p) for p in P.STRUCTURED])
    return (
        F.when(t == "", None)
        .when(is_json, "json")
        .when(F.startswith(t, F.lit("<")) | t.rlike(P.SYSLOG_START), "syslog")
        .when(t.rlike(P.POSITIONAL), "positional_structured")
        .when(structured, "structured_text")
        .when(~F.startswith(t, F.lit("{")) & looks_like_kv(t), "kv")
        .otherwise("plain_text")
    )
