"""One commit for several tables, and bounds that fail a batch before it."""

import pytest
from pyspark.sql import functions as F

from sparkvigil.sources.ledger import Ledger
from sparkvigil.streaming import guards, windows

LINES = "stream string, ordinal int, line string, header boolean"


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def failing(df):
    return df.select(F.when(F.col("v") >= 0, F.raise_error("injected").cast("int")).otherwise(F.col("v")).alias("v"))


def view(ledger):
    read = lambda name: None if (df := ledger.read(name)) is None else sorted(r.v for r in df.collect())
    return {name: read(name) for name in ("rows", "metrics", "findings", "receipts")} | {"facts": [m["facts"] for m in ledger.manifests()]}


def test_a_failure_before_any_write_leaves_the_old_view_whole(spark, tmp_path, monkeypatch):
    ledger, names = Ledger(spark, str(tmp_path / "ledger")), ("rows", "metrics", "findings", "receipts")
    assert view(ledger) == dict.fromkeys(names) | {"facts": []}
    assert ledger.commit("m", 0, {n: rows(spark, i) for i, n in enumerate(names)}, {"watermark_ms": 60})
    old = view(ledger)
    assert old == {"rows": [0], "metrics": [1], "findings": [2], "receipts": [3], "facts": [{"watermark_ms": 60}]}
    for at in range(len(names)):
        tables = {n: failing(rows(spark, 9)) if i == at else rows(spark, 9) for i, n in enumerate(names)}
        with pytest.raises(Exception, match="injected"):
            ledger.commit("m", 1, tables, {"watermark_ms": 120})
        assert view(ledger) == old and not ledger.holds("m", 1)

    def broken(*_):
        raise OSError("before the manifest")

    with monkeypatch.context() as m:
        m.setattr(ledger, "_publish", broken)
        with pytest.raises(OSError):
            ledger.commit("m", 1, {n: rows(spark, 9) for n in names})
    assert view(ledger) == old
    assert ledger.commit("m", 1, {n: rows(spark, 7) for n in names}, {"watermark_ms": 120})
    assert not ledger.commit("m", 1, {n: rows(spark, 8) for n in names}, {"watermark_ms": 180})  # a repeated batch
    assert view(ledger) == {"rows": [0, 7], "metrics": [1, 7], "findings": [2, 7], "receipts": [3, 7], "facts": [{"watermark_ms": 60}, {"watermark_ms": 120}]}
    assert ledger.read("rows", "other") is None and [m["batch"] for m in ledger.manifests("m")] == [0, 1]


def test_of_two_commits_of_one_name_one_wins_and_schemas_may_grow(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.commit("a", 0, {"rows": rows(spark, 1)})
    assert ledger._publish("a", 0, "{}") is False
    ledger.commit("b", 0, {"rows": spark.createDataFrame([(2, "x")], "v int, more string"), "new": rows(spark)})
    assert sorted((r.v, r.more) for r in ledger.read("rows").collect()) == [(1, None), (2, "x")]
    assert ledger.read("new").count() == 0


def run(spark, tmp_path, bounds, **more):
    """Starts the guarded query where the last run ended; the failure, or None."""
    stream = windows.assembly(spark.readStream.schema(LINES).parquet(str(tmp_path / "in")), idle=None, **more)
    query = stream.writeStream.foreachBatch(guards.guarded(str(tmp_path / "out"), "logs", bounds)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    except Exception as e:
        return str(e)
    finally:
        query.stop()


def test_a_batch_beyond_a_bound_commits_nothing_and_once_after_it_is_raised(spark, tmp_path):
    def put(*lines):
        spark.createDataFrame(lines, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    ledger = Ledger(spark, str(tmp_path / "out"))
    state = lambda: (len(ledger.manifests()), sorted((r.kind, r.stream, r.text) for r in ledger.read("rows").collect()), ledger.read("keys").count())
    tight = guards.Bounds(streams=2, pending_records=4, pending_chars=30)
    put(("a", 0, "h1", True), ("a", 1, " x", False), ("b", 0, "hb", True))
    assert run(spark, tmp_path, tight) is None
    assert state() == (1, [], 2)
    # a third stream
    put(("a", 2, "h2", True), ("c", 0, "hc", True))
    said = run(spark, tmp_path, tight)
    assert "STREAM_CARDINALITY_LIMIT: 3 > 2" in said
    assert state() == (1, [], 2)
    assert run(spark, tmp_path, guards.Bounds(streams=3, pending_records=4, pending_chars=30)) is None
    after = (2, [("event", "a", "h1\n x")], 3)
    assert state() == after
    assert run(spark, tmp_path, tight) is None and state() == after  # nothing new, nothing twice
    # pending lines of all streams: a 1, b 1, c 1 and two more
    put(("b", 1, " y", False), ("b", 2, " z", False))
    assert "PENDING_RECORD_LIMIT: 5 > 4" in run(spark, tmp_path, guards.Bounds(streams=3, pending_records=4))
    assert state() == after
    assert run(spark, tmp_path, guards.Bounds(streams=3, pending_records=5)) is None
    assert {r.stream: (r.pending_records, r.pending_chars) for r in guards.newest_pending(None, 0, ledger.read("pending").where("batch = 2")).collect()} == {"b": (3, 6)}
    # within one stream the assembly itself refuses; late lines join no event
    put(("b", 3, "long " * 9, False))
    assert "PENDING_CHARACTER_LIMIT: 51 > 40" in run(spark, tmp_path, guards.Bounds(), most_chars=40)
    put(("a", 1, "again", False), ("a", 3, "h3", True))
    assert run(spark, tmp_path, guards.Bounds()) is None
    assert sorted((r.kind, r.stream, r.text) for r in ledger.read("rows").collect()) == [("event", "a", "h1\n x"), ("event", "a", "h2"), ("late", "a", "again")]


def test_cardinality_of_patterns_and_groups(spark):
    batch = spark.createDataFrame([(f"s{i % 2}", f"t{i % 3}", "g", "x", i) for i in range(12)] + [("s0", None, "g", None, None)], "stream string, template_id string, group_type string, identity string, window_start_ms int")
    keys = guards.keys_of(batch)
    assert {r.kind: r["count"] for r in keys.groupBy("kind").count().collect()} == {"streams": 2, "patterns": 4, "groups": 13}
    guards.check(keys, None, guards.Bounds(streams=2, patterns=4, groups=13))
    for name, code in (("patterns", "PATTERN"), ("groups", "SIGNAL")):
        with pytest.raises(guards.LimitExceeded, match=f"{code}_CARDINALITY_LIMIT"):
            guards.check(keys, None, guards.Bounds(**{name: 3}))
    assert guards.keys_of(spark.createDataFrame([(1,)], "v int")).count() == 0
