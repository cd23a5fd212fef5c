"""The evidence pack: a bounded, diverse account of each incident, and the gate for what is said about it."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import written

GROUPS, EDGES, ROOTS, CHARS, PACK_CHARS, PACK_BYTES = 8, 10, 3, 240, 12_000, 24_000
#: The longest interpretation and note that are read, in characters.
MOST_OUTPUT, NOTE = 4_096, 500


def groups(incidents: DataFrame, signals: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each incident and (template, service, component): counts, times, severity, score, degree, root rank, representative.

    Occurrences are summed and times spanned over the windows; the representative is the member of the best root rank, then
    severity, time and id.
    """
    each = incidents.select("incident_id", "root_signal_id", F.explode("signal_ids").alias("signal_id")).join(signals, "signal_id")
    ranks = roots.select("incident_id", "signal_id", F.col("rank").alias("root_rank"), F.col("score").alias("root_score"))
    each = each.join(ranks, ["incident_id", "signal_id"], "left")
    member = each.select("incident_id", "signal_id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("signal_id")).groupBy("signal_id").agg(F.count("*").alias("degree"))
    each = each.join(member.join(ends, "signal_id").select("incident_id", "signal_id", "degree"), ["incident_id", "signal_id"], "left")
    order = F.struct(F.coalesce("root_rank", F.lit(99)), F.col("signal_id") != F.col("root_signal_id"), "severity_min", F.coalesce("first_seen_ms", F.lit(1 << 60)), "signal_id")
    return each.groupBy("incident_id", "template_id", F.coalesce("service", F.lit("")).alias("service"), F.coalesce("component", F.lit("")).alias("component")).agg(
        F.sum("count").alias("occurrences"), F.count("*").alias("windows"), F.min("severity_min").alias("severity"), F.max("qualification_score").alias("score"), F.min("first_seen_ms").alias("first_ms"),
        F.max("last_seen_ms").alias("last_ms"), F.sum(F.coalesce("degree", F.lit(0))).alias("degree"), F.min("root_rank").alias("root_rank"), F.max("root_score").alias("root_score"),
        F.min_by("signal_id", order).alias("representative"), F.max((F.col("signal_id") == F.col("root_signal_id")).cast("int")).alias("is_root"),
        T.evidence_line(F.min_by("template", order), CHARS).alias("pattern"),
    )


def chosen(found: DataFrame, most: int = GROUPS) -> DataFrame:
    """The groups of each incident's pack, numbered by ``place`` from 1.

    First come up to ROOTS groups that hold a ranked root; then, place by place, the best of the rest: the incident's root, a service and
    component that the pack lacks, a template that it lacks, then ``base``: severity, degree, score, time, representative. A pick looks past
    at most ``most`` components and as many templates, so a group outside the first most + 1 of its component or template, and
    then outside the first 2 * most * (most + 1) + 1, is never picked: what is compared in one row is bounded, and nothing is lost.
    """
    base = [F.col("severity"), F.col("degree").desc(), F.col("score").desc(), F.col("first_ms").asc_nulls_last(), F.col("representative")]
    order = [F.col("is_root").desc(), *base]
    rank = lambda *by: F.row_number().over(W.partitionBy("incident_id", *by).orderBy(*order))
    roots = F.row_number().over(W.partitionBy("incident_id").orderBy(F.col("root_rank").asc_nulls_last(), "representative"))
    rows = found.withColumn("root_place", F.when(F.col("root_rank").isNotNull(), roots)).withColumn("base", rank())
    near = (rank("service", "component") <= most + 1) & (rank("template_id") <= most + 1)
    rows = rows.withColumn("near", near).withColumn("nth", F.row_number().over(W.partitionBy("incident_id", "near").orderBy(*order)))
    rows = rows.where((F.col("root_place") <= ROOTS) | (F.col("base") <= most + 1) | (F.col("near") & (F.col("nth") <= 2 * most * (most + 1) + 1)))
    place = F.concat(F.col("service"), F.lit("\x00"), F.col("component"))
    one = F.struct(F.coalesce("root_place", F.lit(1 << 30)).alias("root"), (1 - F.col("is_root")).alias("other"), F.col("base"), place.alias("at"), F.col("template_id").alias("of"))
    cases = rows.groupBy("incident_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    first = F.slice(F.filter("all", lambda g: g["root"] <= ROOTS), 1, min(ROOTS, most))

    def pick(acc: Column, _: Column) -> Column:
        left = F.filter("all", lambda g: ~F.exists(acc, lambda c: c["base"] == g["base"]))
        seen = lambda g, name: F.exists(acc, lambda c: c[name] == g[name])
        best = F.array_min(F.transform(left, lambda g: F.struct(g["other"].alias("a"), seen(g, "at").alias("b"), seen(g, "of").alias("c"), g["base"].alias("d"), g.alias("g"))))
        return F.when((F.size(left) == 0) | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(best["g"])))

    picked = cases.select("incident_id", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, pick)).alias("place", "g"))
    return rows.drop("near", "nth", "root_place").join(picked.select("incident_id", "place", F.col("g.base").alias("base")), ["incident_id", "base"]).withColumn("place", F.col("place") + 1).drop("base")


def pack_case(rows: list[dict], edges: list[dict]) -> str:
    """The case as JSON within PACK_CHARS and PACK_BYTES; ``rows`` are chosen groups by place, ``edges`` join places, best first.

    Over the budget go, in turn, the weakest edges but one, groups without a root, all but 80 characters of patterns, the weaker roots, the last edge.
    """
    rows, links, clip = list(rows), list(edges), CHARS
    is_root = lambda r: r["root_rank"] is not None and not math.isnan(r["root_rank"])

    def drop() -> bool:
        nonlocal clip
        plain = [r for r in rows if not is_root(r)]
        if len(links) > 1:
            links.pop()
        elif plain and len(rows) > 1:
            rows.remove(plain[-1])
        elif clip > 80:
            clip = 80
        elif len(rows) > 1:
            rows.pop()
        elif links:
            links.pop()
        else:
            return False
        return True

    while True:
        known = {r["place"] for r in rows}
        signals = [{"ref": f"S{r['place']}", "pattern": r["pattern"][:clip], "service": r["service"], "severity": int(r["severity"]), "occurrences": int(r["occurrences"]), "windows": int(r["windows"])} for r in rows]
        body = {"signals": signals, "edges": [{"from": f"S{e['source']}", "to": f"S{e['target']}", "score": e["score"]} for e in links if {e["source"], e["target"]} <= known], "roots": [f"S{r['place']}" for r in rows if is_root(r)][:ROOTS]}
        text = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        if len(text) <= PACK_CHARS and len(text.encode()) <= PACK_BYTES:
            return text
        if not drop():
            raise ValueError("a single group exceeds the budget")


def packs(incidents: DataFrame, signals: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(incident_id, pack, chars, bytes) of every incident. Edges meet their groups by signal, in joins; a pack sees its chosen groups and best edges alone."""
    picked = written(chosen(groups(incidents, signals, edges, roots)), "groups")
    each = incidents.select("incident_id", F.explode("signal_ids").alias("signal_id")).join(signals.select("signal_id", "template_id", F.coalesce("service", F.lit("")).alias("service"), F.coalesce("component", F.lit("")).alias("component")), "signal_id")
    member = written(each.join(picked.select("incident_id", "template_id", "service", "component", "place"), ["incident_id", "template_id", "service", "component"]).select("incident_id", "signal_id", "place"), "members")
    ends = [member.select("incident_id", F.col("signal_id").alias(c), F.col("place").alias(c + "_place")) for c in ("source", "target")]
    best = W.partitionBy("incident_id").orderBy(F.col("score").desc(), "source", "target")
    inner = edges.select("source", "target", "score").join(ends[0], "source").join(ends[1], ["incident_id", "target"]).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= EDGES)
    inner = inner.select("incident_id", F.col("source_place").alias("source"), F.col("target_place").alias("target"), "score", "nth")

    def each_case(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        text = pack_case(left.astype({"root_rank": "float64"}).sort_values("place").to_dict("records"), right.sort_values("nth").to_dict("records")) if len(left) else "{}"
        return pd.DataFrame([(key[0], text, len(text), len(text.encode()))], columns=["incident_id", "pack", "chars", "bytes"])

    return picked.groupBy("incident_id").cogroup(inner.groupBy("incident_id")).applyInPandas(each_case, "incident_id string, pack string, chars int, bytes int")


def _no_number(name: str):
    raise ValueError(f"{name} is no number of JSON")


def _claims(reply: str | None) -> dict | None:
    """The reply's JSON object; None if it isn't one or has a number that JSON lacks."""
    try:
        value = json.loads(reply or "", parse_constant=_no_number)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def faults(reply: str | None, pack: str) -> list[str]:
    """All that speaks against showing an interpretation of ``pack``, sorted; none if it may be shown.

    An interpretation blames signals of its pack: {"blame": [{"signal": "S1", "share": 0.7, "edges": ["S1>S2"]}, ...], "note": "..."}. Each
    signal is blamed once, by a share above 0, all shares being 1 at most. Its edges are the pack's, touch the signal, and there is one
    at least if the pack has any that does. The note, which may be left out, is text of at most NOTE characters.
    """
    if len(reply or "") > MOST_OUTPUT:
        return ["too_long"]
    said, held = _claims(reply), json.loads(pack)
    if said is None:
        return ["not_an_object"]
    blame, note, out = said.get("blame"), said.get("note", ""), set()
    if set(said) - {"blame", "note"}:
        out.add("unknown_field")
    if not isinstance(note, str) or len(note) > NOTE:
        out.add("bad_note")
    if not isinstance(blame, list) or not blame or not all(isinstance(b, dict) and set(b) == {"signal", "share", "edges"} for b in blame):
        return sorted(out | {"bad_blame"})
    known = {s["ref"] for s in held.get("signals", [])}
    links = {f"{e['from']}>{e['to']}": {e["from"], e["to"]} for e in held.get("edges", [])}
    names = [b["signal"] for b in blame if isinstance(b["signal"], str)]
    if len(names) < len(blame) or set(names) - known:
        return sorted(out | {"unknown_signal"})
    if len(set(names)) < len(names):
        out.add("blamed_twice")
    shares = [b["share"] for b in blame]
    if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and 0 < x <= 1 for x in shares) or sum(shares) > 1 + 1e-9:
        out.add("bad_share")
    for b in blame:
        given = b["edges"] if isinstance(b["edges"], list) else [None]
        if not all(isinstance(e, str) and b["signal"] in links.get(e, ()) for e in given):
            out.add("foreign_edge")
        elif not given and any(b["signal"] in ends for ends in links.values()):
            out.add("no_edge_given")
    return sorted(out)


_INTERPRETED = "incident_id string, faults array<string>, blame array<struct<place: int, share: double>>, note string"


def interpreted(packed: DataFrame, replies: DataFrame) -> DataFrame:
    """(incident_id, faults, blame, note) of every pack (incident_id, pack) with its reply (incident_id, reply): who is blamed, by the group's place in
    the pack, and by how much. Where there are faults, or no reply ("no_reply"), nothing of the reply is handed on. An incident has one reply at most.
    """
    def each(frames):
        for frame in frames:
            out = []
            for incident, pack, reply in zip(frame["incident_id"], frame["pack"], frame["reply"], strict=True):
                wrong = faults(reply, pack) if isinstance(reply, str) else ["no_reply"]
                said = {} if wrong else json.loads(reply)
                out.append((incident, wrong, None if wrong else [{"place": int(b["signal"][1:]), "share": float(b["share"])} for b in said["blame"]], said.get("note")))
            yield pd.DataFrame(out, columns=["incident_id", "faults", "blame", "note"])

    return packed.select("incident_id", "pack").join(replies.select("incident_id", "reply"), "incident_id", "left").mapInPandas(each, _INTERPRETED)
