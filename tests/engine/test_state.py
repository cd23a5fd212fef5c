"""Streams with state give what the batch operators give, also when they are stopped and started again between batches."""

import random

import pytest
from pyspark.sql import functions as F

from sparkvigil.operators import baseline, liveness
from sparkvigil.streaming import state

pytest.importorskip("google.protobuf")  # the state server's messages

HOUR = 3_600_000
SEEN = "problem_key string, start_ms bigint, end_ms bigint"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def feed(spark, tmp_path, schema, operator, batches):
    """The rows of a stream that is started anew for each batch."""
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = operator(spark.readStream.schema(schema).parquet(src))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        done = query.awaitTermination(180)
        query.stop()
        assert done and query.exception() is None
    return spark.read.parquet(out)


def test_an_incident_opens_goes_on_and_opens_again_after_a_day(rocks, tmp_path):
    day = 24 * HOUR
    batches = [
        [("db:database", 0, 1000), ("gw:network", 0, 500)],
        [("db:database", 2000, 3000), ("db:database", 1500, 2500)],
        [("db:database", day, 3000 + day)],  # just in time
        [("db:database", 3 * day, 3 * day + 1)],
        [("gw:network", 3 * day, 3 * day + 5), (None, None, 3 * day + 7)],
    ]
    got = feed(rocks, tmp_path, SEEN, lambda s: state.live_incidents(s, "1 minute"), batches)
    want = liveness.lifelines(rocks.createDataFrame([r for b in batches for r in b], SEEN))
    key = lambda r: (r["problem_key"] or "", r["end_ms"])
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=key)
    assert rows(got) == rows(want)
    assert [(r["status"], r["times_seen"]) for r in rows(got) if r["problem_key"] == "db:database"] == [("open", 1), ("active", 2), ("active", 3), ("active", 4), ("open", 1)]
    assert [r["status"] for r in rows(got) if r["problem_key"] == "gw:network"] == ["open", "open"]


def test_lifelines_against_a_plain_loop_and_through_the_store(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", "hot", "hot"]), None, rng.randrange(0, 400 * HOUR)) for _ in range(120)]
    rows = [(k, e - rng.randrange(HOUR), e) for k, _, e in {r[2]: r for r in rows}.values()]
    want = {}
    for k, s, e in sorted(rows, key=lambda r: r[2]):
        first, last, n = want.get(k, [(None, None, 0)])[-1]
        new = last is None or e - last > 24 * HOUR
        want.setdefault(k, []).append((s if new else first, e, 1 if new else n + 1))
    flat = lambda df: {(r.problem_key, r.end_ms): (r.first_seen_ms, r.last_seen_ms, r.times_seen) for r in df.collect()}
    expected = {(k, e): (f, e, n) for k, v in want.items() for f, e, n in v}
    assert flat(liveness.lifelines(spark.createDataFrame(rows, SEEN))) == expected
    # the same in three windows with the store between them
    store, got = None, {}
    for lo in (0, 130, 260):
        part = spark.createDataFrame([r for r in rows if lo * HOUR <= r[2] < (lo + 140 if lo == 260 else lo + 130) * HOUR], SEEN)
        tracked = liveness.lifelines(part, store)
        got |= flat(tracked)
        store = spark.createDataFrame(liveness.store(tracked, store).collect(), liveness.STORE)
    assert got == expected
    assert liveness.store(liveness.lifelines(spark.createDataFrame([], SEEN)), store, now_ms=10**12).count() == 0


def test_lifelines_of_untimed_rows(spark):
    rows = [("a", None, None), ("a", None, None), ("b", 5, 10), ("b", None, None)]
    got = sorted((r.problem_key, r.status, r.first_seen_ms, r.last_seen_ms, r.times_seen) for r in liveness.lifelines(spark.createDataFrame(rows, SEEN)).collect() if r.problem_key == "b")
    assert got == [("b", "active", 5, 10, 2), ("b", "open", 5, 10, 1)]
    assert sorted(r.status for r in liveness.lifelines(spark.createDataFrame(rows[:2], SEEN)).collect()) == ["active", "open"]


def test_streamed_baselines_equal_the_batch(rocks, tmp_path):
    rng = random.Random(7)
    schema = "pattern string, region int, day bigint, n bigint"
    rows = [(p, r, d, max(0, int(rng.gauss(20, 4))) * (9 if (d + r) % 17 == 0 else 1)) for p in "ab" for r in (1, 2) for d in range(44) if rng.random() < 0.9]
    batches = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((0, 3), (3, 4), (4, 36), (36, 44))]
    for b in batches:
        rng.shuffle(b)
    key = ["pattern", "region"]
    # the ring holds 30 windows, so that the last ones have dropped the first
    got = feed(rocks, tmp_path, schema, lambda s: baseline.change(state.baseline_history(s, key, "day", "n"), "n"), batches)
    want = baseline.change(baseline.history(rocks.createDataFrame(rows, schema), key, "day", "n"), "n")
    flat = lambda df: sorted((r.pattern, r.region, r.day, float(r.n), r.past, r.baseline, r.mad, r.direction) for r in df.select(*key, "day", "n", "past", "baseline", "mad", "direction").collect())
    assert flat(got) == flat(want)
    assert max(len(r.past) for r in got.collect()) == 30
    assert got.where("direction = 'spike'").count() > 0
    held = rocks.read.format("statestore").option("stateVarName", "past").load(str(tmp_path / "check"))
    assert held.groupBy("key").count().agg(F.max("count")).first()[0] <= 30
