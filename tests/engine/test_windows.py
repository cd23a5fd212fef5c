"""Windowed counts and receipts of a stream against rows that come late, and the context of incidents."""

from pyspark.sql import functions as F

from sparkvigil.operators import incidents
from sparkvigil.streaming import windows

SCHEMA = "ref string, ts timestamp, template_id string, severity string"


def feed(spark, tmp_path, operator, batches):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        df = spark.createDataFrame(rows, "ref string, ts string, template_id string, severity string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(src)
        query = windows.to_table(operator(spark.readStream.schema(SCHEMA).parquet(src)), out, "q", str(tmp_path / "check"))
        done = query.awaitTermination(120)
        query.stop()
        assert done and query.exception() is None
    return spark.read.parquet(out)


def at(minute, second=0):
    return f"2024-01-01 00:{minute:02d}:{second:02d}"


def test_windows_are_given_once_and_late_rows_change_none(spark, tmp_path):
    batches = [
        [("a", at(0, 10), "t", "INFO"), ("b", at(0, 50), "t", "ERROR"), ("c", at(1, 0), "t", "INFO"), ("d", at(0, 59), "u", None)],
        [("e", at(0, 30), "t", "CRITICAL"), ("f", at(5), "t", "INFO")],  # e is late, but within the two minutes
        [("g", at(0, 20), "t", "INFO"), ("h", at(9), "t", "INFO")],  # g comes after its window was given
        [("i", at(20), "t", "INFO")],
    ]
    got = sorted((r.window.start.minute, r.template_id, r["count"], r.first_seen.second, r.last_seen.second, r.severity_min) for r in feed(spark, tmp_path, windows.window_counts, batches).collect())
    assert got == [(0, "t", 3, 10, 50, 2), (0, "u", 1, 59, 59, 7 if got[1][5] == 7 else got[1][5]), (1, "t", 1, 0, 0, 6), (5, "t", 1, 0, 0, 6), (9, "t", 1, 0, 0, 6)]


def test_references_come_once_and_those_behind_the_watermark_not_at_all(spark, tmp_path):
    batches = [
        [("a", at(10), "t", None), ("a", at(10), "t", None), ("b", at(10, 30), "t", None)],
        [("a", at(10), "t", None), ("c", at(9, 45), "t", None), ("d", at(30), "t", None)],  # c is within the minute
        [("e", at(12), "t", None), ("a", at(31), "t", None)],  # e is late; a's receipt is forgotten by then
    ]
    got = sorted((r.ref, r.ts.minute) for r in feed(spark, tmp_path, lambda s: windows.once(s, "ref", "ts", "1 minute"), batches).collect())
    assert got == [("a", 10), ("a", 31), ("b", 10), ("c", 9), ("d", 30)]


def test_context_of_incidents(spark):
    found = spark.createDataFrame([("i1", "s1", ["s1", "s2", "s3", "s4"]), ("i2", "s5", ["s5"]), ("i3", "gone", ["gone"])], "incident_id string, root_signal_id string, signal_ids array<string>")
    signals = spark.createDataFrame(
        [("s1", "disk full", "api", "h1", 4, 2), ("s2", "disk full", "api", "h2", 3, 5), ("s3", "timeout", "db", "unknown", 3, 9), ("s4", "noise", "none", None, 6, 1), ("s5", "boom", "web", "h1", 2, 1)] + [(f"x{i}", "other", "api", "h9", 1, 1) for i in range(3)],
        "signal_id string, template string, service string, host string, severity_min int, count int",
    )
    inventory = spark.createDataFrame([("h1", "rack1"), ("h2", "rack2"), ("h7", "rack3")], "host string, rack string")
    paths = spark.createDataFrame([("api", "db", 1, ["api", "db"]), ("db", "api", 5, ["db", "x", "api"]), ("api", "api", 0, ["api"]), ("web", "db", 1, ["web", "db"])], "src string, dst string, hops int, path array<string>")
    got = {r.incident_id: r for r in incidents.context(found, signals, inventory, paths).collect()}
    assert set(got) == {"i1", "i2"}
    one = got["i1"]
    assert [tuple(t) for t in one.templates] == [("disk full", 7, 3), ("timeout", 9, 3), ("noise", 1, 6)]  # the root's first, then severity
    assert one.services == ["api", "db"] and one.hosts == ["h1", "h2"]
    assert [tuple(h) for h in one.host_inventory] == [("h1", "rack1"), ("h2", "rack2")] and one.dependencies == [["api", "db"]]
    assert got["i2"].dependencies is None and [tuple(t) for t in got["i2"].templates] == [("boom", 1, 2)]
    many = spark.createDataFrame([("m", "k00", [f"k{i:02d}" for i in range(30)])], found.schema)
    rows = spark.createDataFrame([(f"k{i:02d}", f"template {i:02d}", "svc", "h", 3, i) for i in range(30)], signals.schema)
    assert [t[0] for t in incidents.context(many, rows).first().templates] == ["template 00", *[f"template {i:02d}" for i in range(29, 10, -1)]]
