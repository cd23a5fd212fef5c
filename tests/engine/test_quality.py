"""Quality of boundaries, lines and times, partial misses against all pairs, targets, strict hits and uploads."""

import random
import re

from pyspark.sql import functions as F

from sparkvigil.operators import incidents, quality, segment, targets
from sparkvigil.sources import hits


def segmented(spark, texts, policy="H"):
    classified = segment.classify(segment.lines(spark.createDataFrame(list(enumerate(texts)), "s long, text string"), "s"), policy)
    return classified, segment.assemble(classified)


def test_boundaries_and_accounting(spark):
    classified, events = segmented(spark, ["H a\n b\n\nH c", "x\nH d\n  H e", "", None])
    b = quality.boundaries(events).first()
    assert (b.total_events, b.complete, b.possible_incomplete, b.orphan, b.analysis_end_events) == (4, 1, 2, 1, 2)
    a = quality.accounting(classified, events).first()
    # " H e" begins like a header behind blanks, so it isn't one that the policy would fit
    assert (a.lines, a.nonblank, a.internal, a.events, a.single, a.multiline, a.min_lines, a.max_lines, a.accounted, a.zero_loss) == (9, 6, 0, 4, 2, 2, 1, 3, 6, True)
    assert [(r.stream, r.event_no) for r in quality.affected(events, 2).collect()] == [(0, 2), (1, 0)]
    lost = quality.accounting(classified, events.where("event_no > 0")).first()
    assert (lost.accounted, lost.zero_loss) == (5, False)
    none = segmented(spark, [])
    assert quality.accounting(*none).first().zero_loss and quality.boundaries(none[1]).first().total_events == 0


def shape(line):
    return [re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", t)) for t in line.split()[:8]]


def test_partial_misses_against_all_pairs(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(" ".join(rng.choice(["ab", "7", "a-7", "[x]", "7:7", "=", ""]) for _ in range(rng.randrange(1, 10))), rng.random() < 0.15) for _ in range(120)]
        fits = [shape(x) for x, m in rows if m and x.strip()]
        near = [x for x, m in rows if not m and x.strip() and any(sum(a == b for a, b in zip(shape(x), f, strict=False)) >= 0.75 * max(len(shape(x)), len(f)) for f in fits)]
        got = quality.partial_misses(spark.createDataFrame(rows, "line string, matched boolean")).first()
        assert (got.matched, got.unmatched, got.similar_unmatched) == (len(fits), sum(not m and bool(x.strip()) for x, m in rows), len(near))
        assert got.suspicious == (len(fits) >= 3 and bool(near))
    odd = quality.partial_misses(spark.createDataFrame([(None, True), ("  ", True), ("a b", None)], "line string, matched boolean")).first()
    assert tuple(odd) == (0, 1, 0, False)


def judged(spark, texts, policy, ok=None):
    classified, events = segmented(spark, texts, policy)
    lines = classified.select("line", F.col("regex_match").alias("matched"))
    parsed = None if ok is None else spark.createDataFrame([(x,) for x in ok], "ok boolean")
    v = quality.verdict(segment.statistics(classified), quality.accounting(classified, events), quality.partial_misses(lines), parsed).first()
    return v.accepted, list(v.reasons)


def test_patterns_are_accepted_only_if_all_holds(spark):
    good = ["\n".join(f"#{i} begins\n  and goes on" for i in range(8))]
    assert judged(spark, good, r"#\d") == (True, [])
    assert judged(spark, good, r"#\d", [True] * 19 + [False]) == (True, [])
    assert judged(spark, good, r"#\d", [True] * 18 + [False] * 2) == (False, ["parser"])
    assert judged(spark, good, r"#\d", [None])[1] == ["parser"]
    assert judged(spark, good, r"#[0-5]") == (False, ["partial_miss"])
    assert set(judged(spark, good, "never")[1]) == {"no_activity", "no_headers", "low_coverage"}


def test_time_counters_of_nothing_and_of_all_lost(spark):
    cols = "k long, format string, time_status string, basis string, ts_ms long"
    empty = spark.createDataFrame([], cols)
    assert quality.time_counters(empty, empty, "k").count() == 0
    rows = spark.createDataFrame([(1, "json", None, "message_explicit", 5), (2, "json", None, "message_explicit", 6), (3, None, "missing", "untimed", None), (4, "kv", "missing", "source_record", 7)], cols)
    went = spark.createDataFrame([(1, None), (2, 7)], "k long, ts_ms long")
    got = {(r.kind, r.name, r.status): r.n for r in quality.time_counters(rows, went, "k").collect()}
    assert got[("count", "timestamp_lost", None)] == 1 and got[("count", "timestamp_changed", None)] == 2 and got[("count", "parsed_resolved_not_delivered", None)] == 1
    assert got[("count", "events_total", None)] == 4 and got[("count", "parser_no_event", None)] == 1 and ("count", "source_timestamp_not_detected", None) not in got


RECORD = "namespace string, workload string, container string, ts_ms long, sequence long, message string"


def test_targets(spark):
    end = 100_000_000
    rows = [("a", f"w{i:03}", "c", end - 1, i, f"m{i}") for i in range(5)] + [("b", "w", "c", end - 900_001, 1, "old"), ("b", "w", "c", end, 2, "too late"), ("b", " ", "c", end - 1, 1, "x"), (None, "w", "c", end - 1, 1, "x"), ("b", "x\ty", "c", end - 1, 1, "x")]
    rows += [("a", "w000", "c", end - 1, 0, None), ("a", "w000", "c", end - 2, 9, "token=abc"), ("a", "w000", "c", end - 1, 0, "m0")]
    r = spark.createDataFrame(rows, RECORD)
    assert [tuple(x) for x in targets.options(r, "namespace", end).orderBy("namespace").collect()] == [("a", False), ("b", False)]
    assert [tuple(x) for x in targets.options(r, "workload", end, most=3).orderBy("namespace", "workload").collect()] == [("a", "w000", True), ("a", "w001", True), ("a", "w002", True), ("b", "w", False)]
    got = {(x.namespace, x.workload): x for x in targets.validated(r, end, "workload", samples=3).collect()}
    assert (got["a", "w000"].events, got["a", "w000"].samples) == (4, ["m0", "m0", "[redacted]"]) and got["a", "w000"].latest_ms == end - 1
    assert (got["b", "w"].events, got["b", "w"].state, got["b", "w"].samples, got["b", "w"].latest_ms) == (0, "QUIET", [], None)
    assert {x.field: x.n for x in targets.out_of_scope(r, {"namespace": "a", "container": "c"}).collect()} == {"namespace": 5}
    assert targets.validated(spark.createDataFrame([], RECORD), end).count() == 0


GOOD = '{"message":"m","@timestamp":5,"sequence":1,"cluster_id":"c","kubernetes":{"namespace_name":"n","pod_name":"p","container_name":"x"}}'


def test_strict_hits(spark):
    cases = {
        None: GOOD, "source": None, "message": GOOD.replace('"m"', "7"), "message_size": GOOD.replace('"m"', '"' + "m" * 11 + '"'), "timestamp": GOOD.replace(":5", ":true"), "cluster_id": GOOD.replace('"c"', '" "'),
        "namespace": GOOD.replace('"n"', "3"), "pod": GOOD.replace("pod_name", "other"), "sequence": GOOD.replace(":1,", ":1.5,"),
    }
    rows = [(i, "logs", f"id{i}", 1, x) for i, x in enumerate(cases.values())] + [(20, " ", "id", 1, GOOD), (21, "logs", None, 1, GOOD), (22, "logs", "id", 0, GOOD), (23, "logs", "id", None, GOOD.replace('"m"', '""')), (24, "logs", "id", None, GOOD.replace(":5", ':"2024"'))]
    h = spark.createDataFrame(rows, "page int, index string, id string, version long, s string").select("page", "index", "id", "version", F.try_parse_json("s").alias("source"))
    got = {r.page: r for r in hits.checked(h, longest=10).collect()}
    assert [got[i].fault for i in range(len(cases))] == list(cases) and [got[i].fault for i in range(20, 25)] == ["index", "id", "version", None, None]
    assert (got[0].message, got[0].timestamp, got[0].sequence, got[0].pod, got[23].message) == ("m", "5", "1", "p", "")
    whole, refused = hits.pages(hits.checked(h).withColumn("page", (F.col("page") >= 20).cast("int") + F.when(F.col("page") >= 23, 1).otherwise(0)), "page")
    assert [r.id for r in whole.collect()] == ["id", "id"] and {(r.page, r.hits, r.faulty) for r in refused.collect()} == {(0, 9, 7), (1, 3, 3)}


def test_uploads(spark):
    files = [("a.json", '\ufeff[{"b":1,"a":"x"},{}]'), ("b.json", ' {"a":null}\n'), ("c.json", "[1,2]"), ("d.log", '[{"a":1}]\n'), ("e.txt", "x\r\n\ny\n"), ("f.txt", ""), ("g.txt", None)]
    got = [(r.path[0], r.ordinal, r.line) for r in hits.uploaded(spark.createDataFrame(files, "path string, text string")).orderBy("path", "ordinal").collect()]
    assert got == [("a", 0, '{"a":"x","b":1}'), ("a", 1, "{}"), ("b", 0, '{"a":null}'), ("c", 0, "[1,2]"), ("d", 0, '[{"a":1}]'), ("e", 0, "x"), ("e", 1, ""), ("e", 2, "y"), ("f", 0, ""), ("g", 0, "")]
    assert [r.line for r in hits.csv_lines(spark.createDataFrame([("x", None)], "a string, b string")).collect()] == ['{"a":"x","b":null}']


def test_foremost_incidents_have_one_order(spark):
    rows = [("c", 3, 5), ("a", 3, None), ("b", 3, 5), ("z", 1, 9), ("n", None, 1)]
    found = spark.createDataFrame(rows, "incident_id string, severity_min int, start_ms long").repartition(3)
    assert [(r.incident_id, r.place) for r in incidents.foremost(found, 4).orderBy("place").collect()] == [("z", 1), ("b", 2), ("c", 3), ("a", 4)]
