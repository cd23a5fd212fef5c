import json
import random

import pytest
from pyspark.sql import functions as F

from sparkvigil.functions.generalise import generalise
from sparkvigil.operators import evidence
from sparkvigil.plans import admission


def test_generalised_templates(spark):
    cases = {
        "fault at address deadbeef": ("fault at address <HEX>", ["labeled-hex-address"]), "loading /opt/x/run.sh now": ("loading <ID> now", ["explicit-program-path"]),
        "at /data/subdir62/x": ("at /data/subdir<ID>/x", ["path-runtime-counter"]), "stored block rdd_7": ("stored block rdd_<ID>", ["contextual-runtime-counter"]), "phase_2 of three": ("phase_2 of three", []),
        "generating core.862": ("generating core.<ID>", ["contextual-dotted-runtime-counter"]), "version core.862": ("version core.862", []), "chrome.exe - open": ("<ID> - open", ["structured-leading-process"]), "to db.example.com:5432": ("to <ID>:<NUM>", ["structured-host-port"]),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", generalise(F.col("t")).alias("g"))
    assert {r.t: (r.g.template, r.g.rules) for r in df.collect()} == cases


GROUP = "incident_id string, template_id string, service string, component string, occurrences long, windows long, severity int, score double, first_ms long, last_ms long, degree long, root_rank int, root_score double, representative string, is_root int, pattern string"


def group(i, **over):
    row = {"incident_id": "i", "template_id": f"t{i}", "service": f"s{i % 3}", "component": "c", "occurrences": 5, "windows": 1, "severity": 3, "score": 0.9, "first_ms": i, "last_ms": 9, "degree": 0, "root_rank": None, "root_score": None, "representative": f"sig{i:02d}", "is_root": 0, "pattern": "p" * 240}
    return row | over


def brute_choice(rows, most=8):
    out = sorted((r for r in rows if r["root_rank"] is not None), key=lambda r: (r["root_rank"], r["representative"]))[:3]
    while len(out) < min(most, len(rows)):
        places, templates = {(r["service"], r["component"]) for r in out}, {r["template_id"] for r in out}
        left = [r for r in rows if r not in out]
        out.append(min(left, key=lambda r: (-r["is_root"], (r["service"], r["component"]) in places, r["template_id"] in templates, r["severity"], -r["degree"], -r["score"], r["first_ms"], r["representative"])))
    return [r["representative"] for r in out]


def test_choice_is_bounded_diverse_and_stable(spark):
    rng, rows = random.Random(3), [group(i) for i in range(12)] + [group(20, root_rank=0, is_root=1), group(21, root_rank=1, severity=4)]
    for case in range(6):
        pairs = rng.sample([(t, s) for t in range(40) for s in range(30)], 400)
        rows += [group(k, incident_id=f"c{case}", template_id=f"t{t % (3 + 8 * case)}-{t}", service=f"s{s % (2 + 5 * case)}-{s}", severity=rng.randrange(1, 8), degree=rng.randrange(3), root_rank=k if k < case else None, is_root=int(k == 0), representative=f"r{k:03d}") for k, (t, s) in enumerate(pairs)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], GROUP).repartition(5)
    got = {}
    for r in evidence.chosen(df).orderBy("place").collect():
        got.setdefault(r.incident_id, []).append(r.representative)
    assert got == {i: brute_choice([r for r in rows if r["incident_id"] == i]) for i in {r["incident_id"] for r in rows}}
    assert len(got["i"]) == 8 and got["i"][:2] == ["sig20", "sig21"]


def test_packs_stay_within_the_budget():
    rows = [group(i, place=i + 1, root_rank=float(i) if i < 2 else float("nan")) for i in range(8)]
    edges = [{"source": 1, "target": i, "score": 0.9 - i / 100} for i in range(2, 9)]
    text = evidence.pack_case(rows, edges)
    body = json.loads(text)
    assert len(body["edges"]) == 7 and body["roots"] == ["S1", "S2"] and "sig0" not in text and len(text) <= 12_000
    wide = json.loads(evidence.pack_case([r | {"service": "é" * 4000} for r in rows], edges))
    assert len(wide["edges"]) <= 1 and {"S1"} <= {s["ref"] for s in wide["signals"]} and len(wide["signals"]) < 8


PACK = json.dumps({"signals": [{"ref": f"S{i}"} for i in (1, 2, 3, 4)], "edges": [{"from": "S1", "to": "S2", "score": 0.8}, {"from": "S3", "to": "S1", "score": 0.7}], "roots": ["S1"]})


def blame(*rows, **more):
    return json.dumps({"blame": [dict(zip(("signal", "share", "edges"), r, strict=True)) for r in rows]} | more)


def test_gate_of_interpretations(spark):
    good = blame(("S1", 0.6, ["S1>S2"]), ("S4", 0.4, []), note="the queue first")
    assert evidence.faults(good, PACK) == [] == evidence.faults(blame(("S2", 1, ["S1>S2"])), PACK)
    cases = {
        "": ["not_an_object"], "[]": ["not_an_object"], '{"blame": NaN}': ["not_an_object"], "{}": ["bad_blame"], blame(): ["bad_blame"], "x" * 5000: ["too_long"],
        blame(("S9", 0.5, [])): ["unknown_signal"], blame((1, 0.5, [])): ["unknown_signal"], blame(("S4", 0.5, []), ("S4", 0.1, [])): ["blamed_twice"], blame(("S4", 0.7, []), ("S1", 0.7, ["S1>S2"])): ["bad_share"],
        blame(("S4", True, [])): ["bad_share"], blame(("S4", 0, [])): ["bad_share"], blame(("S2", 0.5, ["S3>S1"])): ["foreign_edge"], blame(("S1", 0.5, ["S2>S1"])): ["foreign_edge"], blame(("S1", 0.5, "S1>S2")): ["foreign_edge"],
        blame(("S1", 0.5, [])): ["no_edge_given"], blame(("S4", 0.5, []), note=5, more=1): ["bad_note", "unknown_field"], blame(("S4", 2, ["S1>S2"]), note="n" * 501): ["bad_note", "bad_share", "foreign_edge"],
    }
    assert {k: evidence.faults(k, PACK) for k in cases} == cases
    packed = spark.createDataFrame([(i, PACK) for i in ("a", "b", "c")], "incident_id string, pack string")
    got = {r.incident_id: r for r in evidence.interpreted(packed, spark.createDataFrame([("a", good), ("b", "{}"), ("z", good)], "incident_id string, reply string")).collect()}
    assert [(r.place, r.share) for r in got["a"].blame] == [(1, 0.6), (4, 0.4)] and got["a"].note == "the queue first" and got["a"].faults == []
    assert (got["b"].faults, got["b"].blame) == (["bad_blame"], None) and (got["c"].faults, got["c"].blame, got["c"].note) == (["no_reply"], None, None) and len(got) == 3


def test_patterns_are_admitted(spark):
    assert [admission.unsafe(p) for p in ("", "x", "^" + "a" * 1000, "^.*", "^(", r"^\d{4}-\d{2}")] == ["empty", "unanchored", "too_long", "catch_all", "does_not_compile", None]
    assert admission.unsafe("^a" + "|^b" * 25) == "too_many_alternatives" and admission.alternatives(r"a(b|c)[|]\||d") == 2
    df = spark.createDataFrame([("2024-01-01 10:00 INFO x", "2025-12-31 11:11 WARN y", "other")], "a string, b string, c string")
    r = df.select(admission.signature(F.col("a")) == admission.signature(F.col("b")), admission.similarity(F.col("a"), F.col("b")), admission.similarity(F.col("a"), F.col("c"))).first()
    assert r[0] and r[1] == 1.0 and r[2] == 0.0
