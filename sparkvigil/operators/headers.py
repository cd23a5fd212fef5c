"""Structured text: lines whose layout says what is stamp, level, component and message, and what else a header tells."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import times
from ..functions.text import first_pairs, let


class Family(NamedTuple):
    """A layout of the first line: its pattern and the groups of its parts (0: it has none)."""

    pattern: str
    stamp: int
    severity: int
    component: int
    message: int
    context: int = 0
    line: int = 0


# Patterns that decide results.
_LEVELS = "FATAL|CRITICAL|ERROR|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE"
_VERBS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS"
_DOTTED = r"([A-Za-z_$][\w.$-]*(?:\.[A-Za-z_$][\w.$-]*)+)"
FAMILIES = {
    "servicing": Family(rf"(?i)^(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}),\s*({_LEVELS})\s{{2,}}(CBS|CSI)\s{{2,}}(.*)$", 1, 2, 3, 4),
    "quorum": Family(rf"(?i)^(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}},\d{{3}})\s+-\s+({_LEVELS})\s+\[(.*:)([A-Za-z_$][\w.$-]*)@(\d+)\]\s+-\s+(.*)$", 1, 2, 4, 6, 3, 5),
    "pipes": Family(r"^(\d{8}-\d{1,2}:\d{1,2}:\d{1,2}:\d{1,3})\|([^|\r\n]+)\|(\d+)\|(.*)$", 1, 0, 2, 4),
}
ACCESS = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(.*?)"\s+(\d{3})\s+(\d+)'
SCALAR_PAIR = r"""(?<![\w.-])([A-Za-z_][A-Za-z0-9_.-]*)=("[^"\r\n]*"|'[^'\r\n]*'|[^\s,()\[\]{}]+)"""
SERVICES = (r"^\[([a-z][a-z0-9]*(?:-[a-z0-9]+)+)\](?=\s|$)", r"^([a-z][a-z0-9-]*-service)\s+(?=[A-Za-z_][A-Za-z0-9_.-]*=)")
COMPONENTS = (rf"(?i)^\s*\[[^\]]+\]\s+{_DOTTED}\s*:", rf"(?i)^\s*(?:\d+\s+)?{_DOTTED}\s*(?:\[|:)")
PRODUCER = r"(?i)^([A-Za-z0-9_.-]+\.(?:exe|com|bat|cmd|bin))\s+-\s+\S"
REQUEST_ID = r"\b(req-[0-9a-fA-F-]{8,})\b"
REQUEST = rf'(?i)"(?:{_VERBS})\s+[^"\r\n]*"'
CLIENT = rf'(?i)(?:^|\]\s+|\s)((?:\d{{1,3}}\.){{3}}\d{{1,3}})(?:,(?:\d{{1,3}}\.){{3}}\d{{1,3}})?\s+(?="(?:{_VERBS})\s)'
STATUS = r"(?i)\bstatus\s*[:=]\s*(\d{3})\b"
#: A level counts within so many characters behind the stamp.
NEAR = 256

_NONE = "cast(map() as map<string,string>)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")


def scalar_pairs(text: Column) -> Column:
    """map of the plain key=value pairs, quotes removed; values that open a bracket aren't plain; the first value of a repeated key stays."""
    return first_pairs(F.regexp_extract_all(text, F.lit(SCALAR_PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(SCALAR_PAIR), F.lit(2)), unquoted)


def typed(value: Column) -> Column:
    """A scalar as VARIANT: whole numbers, then decimal fractions, else the text. Numbers with leading zeros and those too long stay texts; nulls stay null."""
    sign_zero = value.rlike(r"^[+-]?0\d+$")
    whole = F.when(value.rlike(r"^[+-]?\d+$") & ~sign_zero, value.try_cast("bigint"))
    fraction = F.when(value.rlike(r"^[+-]?(?:\d+\.\d*|\.\d+|\d+(?:\.\d*)?[eE][+-]?\d+)$"), value.try_cast("double"))
    finite = F.when(F.abs(fraction) < float("inf"), fraction)
    return F.when(whole.isNotNull(), whole.cast("variant")).when(finite.isNotNull(), finite.cast("variant")).when(value.isNotNull(), value.cast("variant"))


def typed_attributes(attributes: Column) -> Column:
    """map<string, string> to map<string, variant>."""
    return F.transform_values(attributes, lambda k, v: typed(v))


def _attributes(named: dict[str, Column]) -> Column:
    """A map of those that aren't null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in named.items()])
    return F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))


def over(low: Column, high: Column) -> Column:
    """Both maps; where both have a key, ``high`` has its say."""
    return let(high, lambda h: F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(h, k)), h))


def _row(**parts: Column) -> Column:
    none = F.lit(None).cast("string")
    names = ("family", "stamp", "severity", "component", "host", "message")
    return F.struct(*[parts.get(n, none).cast("string").alias(n) for n in names], parts["attributes"].alias("attributes"))


def by_family(log: Column) -> Column:
    """struct(family, stamp, severity, component, host, message, attributes) of a text whose first line has a known layout; else null.

    Only the first line counts, so that what follows it isn't part of the message. Access lines have their severity from the status.
    """
    head = F.substring_index(log, "\n", 1)
    out = None
    for name, f in FAMILIES.items():
        part = lambda i, p=f.pattern: _found(head, p, i) if i else F.lit(None).cast("string")
        component = F.upper(part(f.component)) if name == "servicing" else part(f.component)
        message = F.regexp_extract(head, f.pattern, f.message)
        attributes = F.expr(_NONE) if name == "pipes" else scalar_pairs(message)
        if f.context:
            around = over(scalar_pairs(F.coalesce(part(f.context), F.lit(""))), attributes)
            attributes = over(_attributes({"line": part(f.line)}), around)
        row = _row(family=F.lit(name), stamp=part(f.stamp), severity=F.upper(part(f.severity)), component=component, message=message, attributes=attributes)
        out = (F if out is None else out).when(head.rlike(f.pattern), row)
    host, stamp, request, status, size = (F.regexp_extract(head, ACCESS, i) for i in range(1, 6))
    severity = F.when(status >= "500", "ERROR").when(status >= "400", "WARNING").otherwise("INFO")
    named = {"http_status": status, "http_status_code": status, "response_size_bytes": size, "client_ip": host}
    row = _row(family=F.lit("access"), stamp=stamp, severity=severity, host=host, message=F.concat(F.trim(request), F.lit(" (HTTP "), status, F.lit(")")), attributes=_attributes(named))
    return out.when(head.rlike(ACCESS), row)


def optional(log: Column) -> Column:
    """struct(service, component, attributes) of a text with a stamp in its first line: what stands in a place that leaves no doubt of its role.

    Services and components stand right behind the level (or behind the stamp, where no level is near). A client's address and a status count
    only beside a quoted HTTP request. Attributes are the plain pairs of the first line and those.
    """
    head = F.substring_index(log, "\n", 1)

    def behind(stamp: Column) -> Column:
        """The first line after the stamp and the bracket that closes it."""
        return F.ltrim(F.regexp_replace(F.substring(head, F.instr(head, stamp) + F.length(stamp), F.length(head)), r"^\]", ""))

    def parted(tail: Column) -> Column:
        """(level or empty, what follows it)."""
        near = F.left(tail, F.lit(NEAR))

        def split(level: Column) -> Column:
            at = F.regexp_instr(near, F.lit(P.LEVEL_WORD)) + F.length(level)
            return F.struct(level.alias("level"), F.when(level == "", tail).otherwise(F.ltrim(F.regexp_replace(F.ltrim(F.substring(tail, at, F.length(tail))), r"^\]", ""))).alias("after"))

        return let(F.regexp_extract(near, P.LEVEL_WORD, 1), split)

    def roles(parts: Column) -> Column:
        after, asked, client = parts["after"], head.rlike(REQUEST), _found(head, CLIENT)
        service = F.coalesce(*[_found(after, p) for p in SERVICES])
        component = F.coalesce(*[_found(after, p) for p in COMPONENTS], F.when(parts["level"] == "", _found(after, PRODUCER)))
        right = F.forall(F.split(client, r"\."), lambda x: x.cast("int") <= 255)
        named = {"request_id": _found(head, REQUEST_ID), "client_ip": F.when(asked & right, client), "http_status": F.when(asked, _found(head, STATUS))}
        return F.struct(service.alias("service"), component.alias("component"), over(scalar_pairs(head), _attributes(named)).alias("attributes"))

    return let(times.first_stamp(log), lambda stamp: F.when(stamp.isNotNull(), let(let(behind(stamp), parted), roles)))
