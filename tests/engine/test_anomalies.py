"""The ten kinds against a loop over windows, and their way through the noise gate."""

import random
from statistics import median

import pytest

from sparkvigil.operators import anomalies, signals


def changed(value, past, collapse=True):
    if len(past) < 5:
        return None
    center = median(past)
    mad = median(abs(x - center) for x in past)
    if value > max(3 * center, center + 6 * mad) and value >= 5:
        return "spike"
    return "collapse" if collapse and center >= 5 and value < min(center / 4, center - 6 * mad) else None


@pytest.fixture(scope="module")
def made():
    rng = random.Random(21)
    windows, members, patterns, errors = {}, {}, {}, {}
    for m in ("a", "b"):
        for w in sorted(rng.sample(range(60), 45)):  # windows with gaps
            burst = rng.random() < 0.12
            pods = {f"p{i}": rng.randrange(8, 12) * (9 if burst and rng.random() < 0.5 else 1) for i in range(5) if rng.random() < 0.9}
            cons = {c: rng.randrange(20, 30) * (8 if rng.random() < 0.05 else 1) for c in ("c1", "c2", "[other]")}
            pats = {f"t{i}": rng.randrange(9, 14) * (7 if rng.random() < 0.05 else 1) for i in range(4) if rng.random() < 0.85} | {f"n{w}": 3 for _ in range(rng.random() < 0.3)}
            bad = {p: rng.choice([0, 1, 30 if rng.random() < 0.2 else 2]) for p in (*pods, "unknown")}
            bad = {k: v for k, v in bad.items() if v}
            windows[m, w] = (0 if rng.random() < 0.05 else 10 if rng.random() < 0.5 else 12, sum(pods.values()) if rng.random() < 0.93 else 0, sum(bad.values()), rng.random() < 0.97, True)
            members[m, w], patterns[m, w], errors[m, w] = {"pod": pods, "container": cons}, pats, {"pod": bad, "container": {"c1": sum(bad.values())} if bad else {}}
    return windows, members, patterns, errors


def brute(windows, members, patterns, errors):
    out = set()
    for m in {m for m, _ in windows}:
        order = sorted(w for n, w in windows if n == m)
        for at, w in enumerate(order):
            past, five = order[max(0, at - 30) : at], order[max(0, at - 5) : at]
            seconds, total, bad, *_ = windows[m, w]
            rate = lambda x: windows[m, x][1] / max(1, windows[m, x][0])  # noqa: B023, E731
            for kind, now, then in (("total_volume", total, [windows[m, x][1] for x in past]), ("log_rate", rate(w), [rate(x) for x in past]), ("error_severity", bad, [windows[m, x][2] for x in past])):
                if d := changed(now, then, kind != "error_severity"):
                    out.add((m, w, kind, None, d, float(now)))
            for flag, member in ((3, "pod"), (4, "container")):
                if all(windows[m, x][flag] for x in (*past, w)):
                    for who, n in members[m, w][member].items():
                        if d := changed(n, [members[m, x][member].get(who, 0) for x in past], False):
                            out.add((m, w, member + "_volume", who, d, float(n)))
                rows = sorted(errors[m, w][member].items(), key=lambda r: (-r[1], r[0]))[:1]
                for who, n in rows:
                    if bad >= 10 and n / bad >= 0.9 and who not in ("unknown", "[other]"):
                        out.add((m, w, member + "_error_concentration", who, "concentration", float(n)))
            for t, n in patterns[m, w].items():
                if changed(n, [patterns[m, x].get(t, 0) for x in five], False):
                    out.add((m, w, "pattern_frequency", t, "spike", float(n)))
                elif len(five) == 5 and not any(t in patterns[m, x] for x in five):
                    out.add((m, w, "new_pattern", t, "new", float(n)))
            for t in {t for x in five for t in patterns[m, x]} - patterns[m, w].keys():
                if len(five) == 5 and all(t in patterns[m, x] for x in five) and changed(0, [patterns[m, x][t] for x in five]):
                    out.add((m, w, "pattern_disappearance", t, "collapse", 0.0))
    return out


def tables(spark, windows, members, patterns, errors):
    flat = lambda d: [(m, w, k, i, n) for (m, w), by in d.items() for k, v in by.items() for i, n in v.items()]
    member = "monitor string, window int, member string, identity string, n int"
    return (
        spark.createDataFrame([(*k, *v) for k, v in windows.items()], "monitor string, window int, seconds int, total int, errors int, pod_exact boolean, container_exact boolean").repartition(3),
        spark.createDataFrame(flat(members), member).repartition(3),
        spark.createDataFrame([(m, w, t, n) for (m, w), v in patterns.items() for t, n in v.items()], "monitor string, window int, template_id string, n int").repartition(3),
        spark.createDataFrame(flat(errors), member).repartition(3),
    )


def test_all_kinds(spark, made):
    found = anomalies.every(*tables(spark, *made)).collect()
    got = {(r.monitor, r.window, r.kind, r.identity, r.direction, r.current) for r in found}
    want = brute(*made)
    assert got == want and len(found) == len(got)
    assert len({r.kind for r in found}) == 10
    assert {r.rule for r in found} == {anomalies.BY_HISTORY, anomalies.BY_ABSENCE, anomalies.BY_SHARE}
    first = {m: min(w for n, w in made[0] if n == m) for m in "ab"}
    assert all(r.window > first[r.monitor] for r in found if "concentration" not in r.kind)


def test_empty_tables_and_known_patterns(spark, made):
    windows, members, patterns, errors = tables(spark, *made)
    none = [t.limit(0) for t in (windows, members, patterns, errors)]
    assert anomalies.every(*none).count() == 0
    assert anomalies.every(windows, *none[1:]).where("kind not in ('total_volume', 'log_rate', 'error_severity')").count() == 0
    assert anomalies.patterns(patterns.selectExpr("*", "false as is_new"), windows).where("kind = 'new_pattern'").count() == 0


def test_anomalies_pass_the_gate_beside_signals(spark, made):
    found = anomalies.every(*tables(spark, *made))
    texts = spark.createDataFrame([(f"t{i}", f"connection refused by peer {i}") for i in range(3)] + [("t3", "job completed successfully")], "template_id string, template string")
    own = spark.createDataFrame([("sig:1", "t1", "user logged in", "svc", 6, 3), ("sig:2", "t2", "database deadlock detected", "svc", 3, 30)], "signal_id string, template_id string, template string, service string, severity_min int, count long")
    both = signals.noise_gate(anomalies.with_signals(own, anomalies.as_signals(found, 60_000, texts)))
    rows = both.collect()
    assert len(rows) == found.count() + 2 and len({r.signal_id for r in rows}) == len(rows)
    gate = {r.signal_id: (r.qualified, r.qualification_evidence) for r in rows}
    assert gate["sig:1"][0] is False and gate["sig:2"][0] is True
    for r in rows:
        if r.monitor_anomaly:
            good = r.template == "job completed successfully"
            assert gate[r.signal_id] == ((False, ["successful_operation_filtered"]) if good else (True, ["monitor_baseline"])), r
    assert any(r.monitor_anomaly and r.template == "job completed successfully" for r in rows) and any(r.template == "total volume" for r in rows)
