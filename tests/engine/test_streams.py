from pyspark.sql import functions as F

from sparkvigil.streaming import windows


def finish(query):
    """Never waits for ever."""
    done = query.awaitTermination(120)
    query.stop()
    assert done and query.exception() is None


def test_segments_across_batches(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "stream string, ordinal int, line string, header boolean"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        finish(windows.to_table(windows.segments(spark.readStream.schema(schema).parquet(src), idle=None), out, "segments", check))

    run([("a", 0, "h1", True), ("a", 1, " x", False), ("b", 0, "h", True)])
    assert spark.read.parquet(out).count() == 0  # nothing has ended yet
    run([("a", 2, " y", False), ("a", 3, "h2", True), ("b", 1, "h", True)])
    got = sorted((r.stream, r.text, r.line_count) for r in spark.read.parquet(out).collect())
    assert got == [("a", "h1\n x\n y", 3), ("b", "h", 1)]


def test_once_and_committed_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("r1", "2024-01-01 00:00:01", "t", "ERROR"), ("r1", "2024-01-01 00:00:01", "t", "ERROR"), ("r2", "2024-01-01 00:00:30", "t", "INFO"), ("r3", "2024-01-01 01:00:00", "t", "INFO")]
    df = spark.createDataFrame(rows, "ref string, ts string, template_id string, severity string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(src)
    finish(windows.to_table(windows.once(spark.readStream.schema(df.schema).parquet(src), "ref", "ts", "1 minute"), out, "refs", str(tmp_path / "check")))
    assert spark.read.parquet(out).count() == 3
    assert windows.commit_window(df, out, "refs", 0) is False
    assert spark.read.parquet(out).count() == 3
