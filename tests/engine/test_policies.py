"""Policies as rows, against Python's own expressions and loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkvigil.operators import parse
from sparkvigil.operators import policies as P

TABLE = "policy_id string, regex string, groups map<string,string>"
POLICIES = [
    ("pipes", r"^(?P<when>\S+)\|(?P<level>[A-Za-z]+)\|(?P<unit>\w+)\|(?P<text>.+)$", {"timestamp": "when", "severity": "level", "component": "unit", "message": "text"}),
    ("marks", r"^#(\d+) (?:<(\w+)> )?([a-z]+): (.*)", {"attr:pid": "1", "host": "2", "service": "3", "message": "4"}),
    ("lacking", r"^~(\d+) (.+)", {"attr:pid": "1", "message": "2", "trace_id": "9"}),
    ("whole", r"^%% ", {}),
    ("bodyless", r"^(?P<level>[EWI]) ", {"severity": "level"}),
    ("loose", r"^.*", {}),
    ("broken", r"^(oops", {"message": "1"}),
    ("same", r"^(?P<a>\w+)-(?P=a) (?P<m>.+)", {"message": "m", "component": "a"}),
]
LINES = [
    ("p", "2024-01-02T03:04:05Z|warn|core|queue is slow pid=7 name='x y'"), ("p", "2024-01-02T03:04:05Z|E|core|first\nsecond line\n third a=1"), ("p", "no header at all"), ("p", "x|fatal|u|m\r\nrest"),
    ("m", "#12 <h1> billing: failed pid=99 code=05"), ("m", "#13 billing: ok"), ("m", "#14 billing: "), ("m", '{"level": "error", "msg": "json stays json"}'), ("w", "%% all of it stays k=v"),
    ("s", "ab-ab body text"), ("s", "ab-ac body text"), ("none", "%% no policy for this stream"), ("b", "E unfit policy"), (None, "no stream"), ("p", ""), ("p", None),
]


@pytest.fixture(scope="module")
def table(spark):
    return P.compiled(spark.createDataFrame(POLICIES, TABLE))


def test_compiled(table):
    got = {r.policy_id: r for r in table.collect()}
    assert {k: r.fault for k, r in got.items()} == {"pipes": None, "marks": None, "whole": None, "bodyless": "no_message_group", "loose": "catch_all", "broken": "does_not_compile", "same": None, "lacking": "no_such_group"}
    assert got["pipes"].groups == {"timestamp": 1, "severity": 2, "component": 3, "message": 4} and got["marks"].groups == {"attr:pid": 1, "host": 2, "service": 3, "message": 4}
    assert got["same"].pattern == r"^(\w+)-\1 (.+)"


ASSIGNED = [("p", "pipes"), ("m", "marks"), ("w", "whole"), ("s", "same"), ("b", "bodyless"), ("x", "gone")]


def test_fields_by_a_stream_s_policy(spark, table):
    raw = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(LINES)], "nth int, stream string, raw string").repartition(3)
    held = P.assigned(raw, spark.createDataFrame(ASSIGNED, "stream string, policy_id string"), table)
    got = {r.nth: r.f for r in held.select("nth", P.fields(F.col("raw"), F.col("pattern"), F.col("groups")).alias("f")).collect()}
    assert len(got) == len(LINES)
    said = lambda i: (got[i].stamp, got[i].severity, got[i].component, got[i].message, got[i].attributes)
    assert said(0) == ("2024-01-02T03:04:05Z", "WARNING", "core", "queue is slow pid=7 name='x y'", {"pid": "7", "name": "x y"})
    assert said(1) == ("2024-01-02T03:04:05Z", "ERROR", "core", "first\nsecond line\n third a=1", {"a": "1"})
    assert said(3) == ("x", "FATAL", "u", "m\nrest", {})
    assert (got[4].host, got[4].service, got[4].message, got[4].attributes) == ("h1", "billing", "failed pid=99 code=05", {"pid": "99", "code": "05"})
    assert (got[5].host, got[5].service, got[5].message, got[5].attributes) == (None, "billing", "ok", {"pid": "13"})
    assert got[6].message == "#14 billing: "  # the body's group catches nothing: the whole event
    assert got[8].message == "%% all of it stays k=v" and got[8].attributes == {"k": "v"}
    assert (got[9].component, got[9].message) == ("ab", "body text")
    assert sorted(i for i, f in got.items() if f is None) == [2, 7, 10, 11, 12, 13, 14, 15]


def test_plain_text_alone_goes_by_policy_and_falls_back(spark, table):
    rows = [("m", "#12 <h1> billing: it failed"), ("m", "#13 no colon here"), ("m", '{"level": "error", "msg": "json stays json"}'), ("m", "level=error msg=kv code=5"), ("other", "#12 <h1> billing: it failed"), ("m", ""), (None, "#12 <h1> billing: it failed")]
    raw = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "nth int, stream string, raw string")
    out = parse.canonical(raw, assignments=spark.createDataFrame(ASSIGNED, "stream string, policy_id string"), policies=table)
    got = {r.nth: (r.format, r.policy_id, r.delivery, r.host, r.message) for r in out.collect()}
    assert got == {
        0: ("plain_text", "marks", "PARSED", "h1", "it failed"), 1: ("plain_text", None, "FALLBACK", None, "#13 no colon here"), 2: ("json", None, "PARSED", None, "json stays json"), 3: ("kv", None, "PARSED", None, "kv"),
        4: ("plain_text", None, "PARSED", None, "#12 <h1> billing: it failed"), 5: (None, None, "IGNORED", None, ""), 6: ("plain_text", None, "PARSED", None, "#12 <h1> billing: it failed"),
    }
    assert {len(r.event_id) for r in out.collect()} == {32} and set(out.columns) == {*parse.canonical(raw).columns, "policy_id"}


def admits(regex, groups, samples):
    """Passes of a policy whose pattern is sound, sample by sample."""
    n, held = 0, re.compile(regex)
    for text in samples:
        line = text.split("\n")[0].rstrip("\r")
        m = held.match(line)
        if not m:
            continue
        at = {k: int(v) if v.isdigit() else held.groupindex[v] for k, v in groups.items()}
        got = {k: (m.group(i) or "").strip() for k, i in at.items()}
        body = m.start(at["message"]) if "message" in at else 1
        year = re.match(r"(\d{4})-\d\d-\d\dT", got.get("timestamp", ""))
        n += all(got.values()) and bool(text.strip()) and body >= (1 if set(groups) - {"message"} else 0) and not (year and not 1980 <= int(year[1]) <= 2100)
    return n


def test_admission(spark, table):
    rng = random.Random(2)
    samples = {
        "pipes": [f"{y}-01-02T03:04:05Z|{s}|u|text {i}" for i, (y, s) in enumerate([(2024, "E"), (1975, "W"), (2101, "I"), (2024, "E")] * 3)] + ["2024|E|u| ", "a|b|c|d\nmore"],
        "marks": [f"#{i} <h> svc: text" for i in range(19)] + ["#5 svc: no host"],
        "same": ["a-a body", "b-b", "a-b body", "zz-zz zz"], "bodyless": ["E x"], "whole": ["%% a", "%% ", "no"],
    }
    rows = [(k, t) for k, v in samples.items() for t in rng.sample(v, len(v))]
    got = {r.policy_id: r for r in P.admitted(spark.createDataFrame(rows, "policy_id string, sample string"), table).collect()}
    assert set(got) == {p[0] for p in POLICIES}
    for name, regex, groups in POLICIES:
        r = got[name]
        if r.fault or name not in samples:
            assert (r.passed, r.admitted) == (0, False)
        else:
            assert (r.samples, r.passed) == (len(samples[name]), admits(regex, groups, samples[name])), name
            assert r.ratio == r.passed / r.samples and r.admitted == (r.ratio >= 0.9)
    assert got["marks"].admitted and got["marks"].passed == 19 and got["pipes"].passed == 7


def shape(text):
    head = text.split("\n")[0][:500]
    for pattern, by in P.SHAPES:
        head = re.sub(pattern, by, head)
    return head.strip()[:220]


def representative(samples, limit):
    bounded = [x for x in samples if x.strip()][:150]
    limit = min(limit, len(bounded))
    first = {}
    for i, x in enumerate(bounded):
        first.setdefault(shape(x), i)
    picked = sorted(first.values())
    spread = [0] if limit == 1 else [round(i * (len(bounded) - 1) / (limit - 1)) for i in range(limit)] if limit else []
    for group in (sorted(set(spread)), range(len(bounded))):
        picked += [i for i in group if i not in picked]
    return picked[:limit]


def contrasted(samples, pattern):
    out = {}
    for hit, most in ((False, 24), (True, 8)):
        families = {}
        for i, line in enumerate(x for x in samples if x.strip()):
            if bool(re.match(pattern, line)) != hit:
                continue
            key = []
            for token in line.split()[:4]:
                kinds = ["D" if c.isdigit() else "A" if c.isalpha() else c for c in token[:48]]
                key.append("".join(k for j, k in enumerate(kinds) if not j or kinds[j - 1] != k) + f":{min(len(token) // 4, 8)}")
            alike = re.sub(r"\s+", " ", re.sub(r"\d+", "<N>", line[:200])).strip()
            families.setdefault("|".join(key), {}).setdefault(alike, i)
        rows = [list(f.values()) for f in families.values()]
        turns = [f[t] for t in range(max(map(len, rows), default=0)) for f in rows if t < len(f)]
        out[hit] = turns[:most]
    return out


@pytest.fixture(scope="module")
def streams(spark):
    rng = random.Random(4)
    kinds = [lambda i: f"2024-01-02 03:04:{i % 60:02d} ERROR job {i} failed", lambda i: f"10.0.0.{i % 250} GET /x/{i}", lambda i: f"[{i}] tag: value{i % 3}", lambda i: f"0x{i:08x} word", lambda i: "word " * (i % 5), lambda i: f"--- part {i % 2} ---", lambda i: "Ünï çödé " + "x" * (i % 30)]
    held = {f"s{n}": [rng.choice(kinds[: 1 + n % 7])(i) for i in range(n)] for n in (1, 2, 3, 39, 41, 100, 150, 233)}
    held["one"] = ["same line"] * 60
    rows = [(s, i, x) for s, v in held.items() for i, x in enumerate(v)]
    rng.shuffle(rows)
    return held, spark.createDataFrame(rows, "stream string, ordinal int, line string").repartition(4)


@pytest.mark.parametrize("limit", [1, 2, 7, 40])
def test_representative_samples(streams, limit):
    held, lines = streams
    got = {}
    for r in P.representative(P.sampled(lines), limit).collect():
        got.setdefault(r.stream, {})[r.pick] = r.nth
    want = {s: dict(enumerate(representative(v, limit), 1)) for s, v in held.items()}
    assert got == {s: v for s, v in want.items() if v}


def test_samples_that_contrast_and_signatures(streams):
    held, lines = streams
    pattern = r"(?:2024|\[\d)"
    got = {}
    for r in P.contrasted(P.sampled(lines, 10_000), F.lit(pattern)).collect():
        got.setdefault((r.stream, r.matched), {})[r.pick] = r.nth
    want = {(s, hit): dict(enumerate(v, 1)) for s, x in held.items() for hit, v in contrasted(x, pattern).items() if v}
    assert got == want
    signed = {r.stream: r.signature for r in P.signatures(P.sampled(lines)).collect()}
    assert all(re.fullmatch("[0-9a-f]{24}", v) for v in signed.values()) and len(signed) == len(held)
    twin = lines.where("stream = 's39'").select(F.lit("twin").alias("stream"), "ordinal", F.regexp_replace("line", "[0-9]", "5").alias("line"))
    assert P.signatures(P.sampled(twin)).first().signature == signed["s39"]
    assert P.signatures(P.sampled(lines.limit(0))).count() == P.representative(P.sampled(lines.limit(0))).count() == 0
