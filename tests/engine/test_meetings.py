"""Operators that meet rows without all pairs or grids, against brute force."""

import random
from statistics import median

from sparkvigil.functions import patterns as P
from sparkvigil.functions import text as T
from sparkvigil.operators import baseline, incidents, signals

TEXTS = ("connection refused by <*>", "orders-api timeout while calling", "out of memory", "deadlock in cart-db", "LEDGER broken pipe", "all fine", None, "cart-db slow")
SERVICES = ("Orders", "orders-api", "ledger", "cart-db", "cart", "ab", None, "")
HOPS = [("Orders", "ledger", 1), ("Orders", "cart-db", 2), ("ledger", "cart-db", 1), ("cart", "cart-db", 3)]
SCHEMA = "signal_id string, first_seen_ms long, last_seen_ms long, template_id string, template string, alarm_type string, severity_min int, service string"


def _score(a, b, hops):
    """(score, forward) of the pair, a before b, or None."""
    gap = max(0, b["first"] - a["last"])
    if (b["first"], b["id"]) <= (a["first"], a["id"]) or gap > incidents.GAP_MS:
        return None
    same = a["svc"] != "" and a["svc"] == b["svc"]
    if same and a["template_id"] is not None and a["template_id"] == b["template_id"]:
        return None
    near, roots, falls = same and gap <= incidents.SAME_SERVICE_MS, P.ROOT_CLASSES, P.CASCADE_CLASSES
    found = None
    if len(a["svc"]) >= 3 and a["svc"].lower() in b["text"]:
        found = (0.78, True)
    elif len(b["svc"]) >= 3 and b["svc"].lower() in a["text"]:
        found = (0.78, False)
    elif near and b["kind"] in roots and a["kind"] in falls:
        found = (0.75, False)
    elif near and a["kind"] in roots and b["kind"] in falls:
        found = (0.75, True)
    elif near and a["kind"] in roots and b["kind"] in roots and a["kind"] != b["kind"]:
        found = (0.65, True)
    reverse = (a["svc"], b["svc"]) in hops
    count = hops.get((a["svc"], b["svc"])) or hops.get((b["svc"], a["svc"]))
    if count:
        first, dependent = (b["first"], a["first"]) if reverse else (a["first"], b["first"])
        score = 0.82 if count == 1 else 0.72
        if first <= dependent + incidents.TOPOLOGY_MS and score > (found or (0.0,))[0]:
            found = (score, not reverse)
    return found


def test_every_pair_that_a_rule_links_meets(spark):
    rng, rows = random.Random(3), []
    for i in range(160):
        first = rng.randint(0, 4 * 3_600_000) if rng.random() > 0.05 else None
        last = None if first is None else first + rng.choice([0, 1000, 60_000, 900_000, 7_200_000, 40 * 86_400_000, -5])
        text = rng.choice(TEXTS)
        rows.append((f"s{i}", first, last, f"t{TEXTS.index(text)}" if rng.random() > 0.1 else None, text, rng.choice([None, "db_alarm"]), rng.choice([None, 1, 3, 6]), rng.choice(SERVICES)))
    table = spark.createDataFrame(rows, SCHEMA)
    kinds = {r.signal_id: r.kind for r in table.select("signal_id", T.failure_class(table["template"], table["alarm_type"], table["severity_min"]).alias("kind")).collect()}
    nodes = [{"id": r[0], "first": r[1], "last": r[2], "template_id": r[3], "text": (r[4] or "").lower(), "svc": r[7] or "", "kind": kinds[r[0]]} for r in rows if r[1] is not None]
    for hops in (None, {(s, d): n for s, d, n in HOPS if n <= 2}):
        want = {}
        for a in nodes:
            for b in nodes:
                found = _score(a, b, hops or {})
                if found:
                    ends = (a["id"], b["id"]) if found[1] else (b["id"], a["id"])
                    want[ends] = max(want.get(ends, 0.0), found[0])
        paths = spark.createDataFrame([(s, d, n, [s, d]) for s, d, n in HOPS], "src string, dst string, hops int, path array<string>") if hops else None
        got = [((r.source, r.target), r.score) for r in incidents.correlate(table, paths).collect()]
        assert len(want) > 100 and len(got) == len(want) and dict(got) == want
    assert incidents.correlate(table.limit(0), paths).count() == 0


def test_patterns_without_a_grid(spark):
    rng, rows = random.Random(4), []
    for t in (None, *[f"t{k}" for k in range(12)]):
        rate = rng.random()
        rows += [(w, t, rng.choice([1, 4, 5, 6, 8, 9, 40, 0])) for w in range(3, 40) if rng.random() < rate]
    have = {(t, w): n for w, t, n in rows if t is not None}
    lo, hi, want = min(w for w, _, _ in rows), max(w for w, _, _ in rows), set()
    for t in {t for t, _ in have}:
        for w in range(lo, hi + 1):
            n, past = have.get((t, w), 0), [have.get((t, v), 0) for v in range(max(lo, w - 5), w)]
            if len(past) < 5:
                continue
            base = median(past)
            mad, seen = median(abs(x - base) for x in past), sum(x > 0 for x in past)
            if n >= 5 and seen and n > max(3 * base, base + 6 * mad):
                want.add((w, t, "pattern_frequency"))
            elif n and not seen:
                want.add((w, t, "new_pattern"))
            elif not n and seen == 5 and base >= 5 and n < min(base / 4, base - 6 * mad):
                want.add((w, t, "pattern_disappearance"))
    table = spark.createDataFrame(rows, "window long, template_id string, n long")
    got = [(r.window, r.template_id, r.kind) for r in baseline.patterns(table).collect()]
    assert len({k for _, _, k in want}) == 3 and len(got) == len(set(got)) and set(got) == want
    assert baseline.patterns(table.limit(0)).count() == 0


def test_a_signal_names_its_first_events(spark):
    schema = "event_id string, ts_ms long, template_id string, template string, template_reliable boolean, severity string, service string, component string, host string, source_order long"
    rows = [(f"e{i:03d}", None if i % 3 == 0 else i, "t", "text", True, "error", "web", None, None, None if i % 5 == 0 else 1000 - i) for i in range(400)]
    got = {r.window_start_ms: (r["count"], r.event_ids) for r in signals.aggregate(spark.createDataFrame(rows, schema)).collect()}
    for window in (None, 0):
        mine = sorted(((r[9] is None, r[9] or 0, r[0]) for r in rows if (r[1] is None) == (window is None)))
        assert got[window] == (len(mine), [x[2] for x in mine[: signals.IDS]])
    assert len(got) == 2
