"""Hits of a search source as VARIANT: dotted paths, and the attributes that a hit carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes of a hit and where they stand, the first that isn't empty counts; and those of a structured message.
HIT_ATTRIBUTES = {
    "hostname": ("hostname",), "log_level": ("level",), "sequence": ("openshift.sequence",), "service_id": ("tcmonit_retag_tcserviceid", "kubernetes.namespace_labels.tcserviceid"),
    "pod_name": ("kubernetes.pod_name",), "pod_ip": ("kubernetes.pod_ip",), "container_name": ("kubernetes.container_name",), "container_image": ("kubernetes.container_image",),
    "container_iostream": ("kubernetes.container_iostream",), "pod_template_hash": ("kubernetes.labels.pod-template-hash",),
}
MESSAGE_ATTRIBUTES = {"http_status": "status_code", "process_time_ms": "process_time_ms", "request_id": "request_id", "http_method": "method", "http_url": "url", "logger": "logger"}


def _quoted(key: str) -> str:
    if "'" not in key:
        return f"['{key}']"
    if '"' not in key:
        return f'["{key}"]'
    raise ValueError(f"a key with both kinds of quotes has no path: {key}")


def at(hit: Column, path: str) -> Column:
    """The VARIANT at a dotted path: SQL null where it is missing, a VARIANT null where the hit says null.

    Any tail of the path may be a key of its own, dots and all, and goes before the nested one: ``a.b.c``, then ``a`` with ``b.c``, then nested.
    """
    parts = path.split(".")
    tries = ["$" + "".join(_quoted(p) for p in parts[:i]) + _quoted(".".join(parts[i:])) for i in range(len(parts))]
    return F.coalesce(*[F.try_variant_get(hit, t, "variant") for t in tries])


def missing(hit: Column, path: str) -> Column:
    return at(hit, path).isNull()


def text(value: Column) -> Column:
    """A scalar VARIANT as text; null for missing, null, empty and nested ones."""
    kind = F.schema_of_variant(value)
    nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    said = F.when(~nested & ~F.is_variant_null(value), F.try_variant_get(value, "$", "string"))
    return F.when(said.rlike(r"(?U)\S"), said)


def _known(pairs: dict[str, Column]) -> Column:
    held = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(held, lambda x: x["value"].isNotNull()))


def message_attributes(message: Column) -> Column:
    """map of what a message that is a JSON object says of its request; empty for any other. The message is parsed once."""
    body = F.trim(F.regexp_replace(message, r"(?U)^\s+|\s+$", ""))
    whole = F.when(F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")), F.try_parse_json(body))

    def said(v: Column) -> Column:
        got = {name: text(F.try_variant_get(v, "$" + _quoted(key), "variant")) for name, key in MESSAGE_ATTRIBUTES.items()}
        got["http_method"] = F.upper(got["http_method"])
        got["process_time_ms"] = F.when(got["process_time_ms"].try_cast("double").isNotNull(), got["process_time_ms"].try_cast("double").cast("string"))
        return _known(got)

    return F.coalesce(F.get(F.transform(F.filter(F.array(whole), lambda v: v.isNotNull()), said), F.lit(0)), F.expr("cast(map() as map<string,string>)"))


def hit_attributes(hit: Column) -> Column:
    """map of a hit's attributes (HIT_ATTRIBUTES), then those of its message; what is missing, null, blank or nested is left out.

    ``hit`` is a VARIANT, as ``try_parse_json`` gives it; null gives an empty map.
    """
    own = _known({name: F.coalesce(*[text(at(hit, p)) for p in paths]) for name, paths in HIT_ATTRIBUTES.items()})
    return F.map_concat(own, message_attributes(F.try_variant_get(at(hit, "message"), "$", "string")))
