"""Structural generalisation of templates: runtime names whose place in the text gives them away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The words that make the token after (or before) them an identity, and the rules in the order in which they are applied.
IDENTITY_BEFORE = ("block", "partition", "task", "attempt", "container", "session", "object", "instance", "for", "from", "to", "of", "stored")
IDENTITY_AFTER = ("stored", "not", "for", "from", "to")
IDENTITY_PREFIXES = ("rdd_", "broadcast_", "task_", "attempt_", "container_")
CREATED_BEFORE = ("generating", "generated", "creating", "created", "allocating", "allocated", "spawning", "spawned")
_UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
_WRAP, _END = r"[\[\](){}:,;'\"]*", r"(?=[\[\](){}:,;.'\"]*(?:\s|$))"
_COUNTER = r"[A-Za-z][A-Za-z0-9.-]*_"
RULES = (
    ("labeled-hex-address", r"(?i)(\b(?:iar|dear|address|addr|pc)\b\s*[:=]?\s+)(?=[0-9a-f]*[a-f])[0-9a-f]{6,16}\b", "$1<HEX>"),
    ("explicit-program-path", r"(?i)(\b(?:program|loading)\s+)(?:[A-Z]:)?[/\\][^\s,:;]+", "$1<ID>"),
    ("embedded-uuid", rf"(?<![0-9A-Fa-f]){_UUID}(?![0-9A-Fa-f-])", "<UUID>"),
    ("path-compound-runtime-id", r"([/\\]_?[A-Za-z][A-Za-z0-9.-]*_)(?=[A-Za-z0-9_-]*\d)(?=[A-Za-z0-9_-]*[_-])[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)+", "$1<ID>"),
    ("path-runtime-counter", r"([/\\][A-Za-z][A-Za-z_-]{2,})\d+(?=[/\\]|$)", "$1<ID>"),
    ("contextual-runtime-counter", rf"(?i)((?:^|\s){_WRAP}(?:{'|'.join(IDENTITY_BEFORE)}){_WRAP}\s+{_WRAP}{_COUNTER})\d+{_END}", "$1<ID>"),
    ("contextual-runtime-counter", rf"(?i)((?:^|\s){_WRAP}(?:{'|'.join(IDENTITY_PREFIXES)}))\d+{_END}", "$1<ID>"),
    ("contextual-runtime-counter", rf"(?i)((?:^|\s){_WRAP}{_COUNTER})\d+(?={_WRAP}\s+{_WRAP}(?:{'|'.join(IDENTITY_AFTER)}){_WRAP}(?:\s|$))", "$1<ID>"),
    ("contextual-dotted-runtime-counter", rf"(?i)((?:^|\s){_WRAP}(?:{'|'.join(CREATED_BEFORE)}){_WRAP}\s+{_WRAP}[A-Za-z][A-Za-z0-9_-]*\.)\d+{_END}", "$1<ID>"),
    ("structured-leading-process", r"^((?:\[[^\]]+\]\s+)?)[A-Za-z0-9_.+-]+\.exe(\s+-\s+)", "$1<ID>$2"),
    ("structured-host-port", r"((?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}|[A-Za-z][A-Za-z0-9._-]*):(?:<NUM>|\d{1,5})", "<ID>:<NUM>"),
)
#: What a template must hold for each rule to match anywhere in it; None: unknown.
NEEDS = (None, r"[/\\]", "-", r"[/\\]", r"[/\\]", r"\d", r"\d", r"\d", r"\d", r"\.exe", ":")


def generalise(template: Column) -> Column:
    """struct(template, rules): the template after all rules, and the names of those that changed it, in order."""
    held = F.array(F.struct(F.coalesce(template, F.lit("")).alias("t"), F.expr("cast(array() as array<string>)").alias("r")))
    for (name, pattern, by), need in zip(RULES, NEEDS, strict=True):
        held = F.transform(held, _step(name, pattern, by, need))
    return F.struct(held[0]["t"].alias("template"), F.array_distinct(held[0]["r"]).alias("rules"))


def _step(name: str, pattern: str, by: str, need: str | None):
    def step(x: Column) -> Column:
        told = lambda after: F.struct(after.alias("t"), F.when(after != x["t"], F.array_append(x["r"], F.lit(name))).otherwise(x["r"]).alias("r"))
        done = let(F.regexp_replace(x["t"], pattern, by), told)
        return done if need is None else F.when(x["t"].rlike(need), done).otherwise(x)

    return step
