"""Baselines and anomalies: median, deviation, and what departs from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from .graph import written

LEAST, HORIZON, MULTIPLIER, SPIKE, COLLAPSE = 5, 30, 6, 3.0, 0.25


def median(values: Column) -> Column:
    """The median of an array without nulls; null for an empty one."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return let(F.sort_array(values), middle)


def history(metrics: DataFrame, key: list[str], at: str, value: str, horizon: int = HORIZON) -> DataFrame:
    """Adds ``past``: the values of up to ``horizon`` windows before each, latest last."""
    before = W.partitionBy(*key).orderBy(at).rowsBetween(-horizon, -1)
    return metrics.withColumn("past", F.collect_list(F.col(value).cast("double")).over(before))


def change(rows: DataFrame, value: str, collapse: bool = True) -> DataFrame:
    """Adds baseline, mad, high, low and direction (spike, collapse or null) of ``value`` against ``past``.

    From LEAST windows on: a spike is above 3 medians and above the median by 6 deviations, and at least 5; a
    collapse below a quarter and below the median by 6 deviations, of a median of at least 5.
    """
    held = rows.withColumn("_change", changed(F.col(value), F.col("past"), collapse))
    return held.withColumns({c: F.col(f"_change.{c}") for c in ("baseline", "mad", "high", "low", "direction")}).drop("_change")


def changed(v: Column, past: Column, collapse: bool = True) -> Column:
    """struct(baseline, mad, high, low, direction) of ``v`` against the array ``past``, as ``change`` says. Each is worked out once, also where a filter on it is pushed down."""

    def judged(high: Column, low: Column, base: Column, mad: Column) -> Column:
        direction = F.when((v > high) & (v >= 5), "spike")
        if collapse:
            direction = direction.when((base >= 5) & (v < low), "collapse")
        return F.struct(base.alias("baseline"), mad.alias("mad"), high.alias("high"), low.alias("low"), direction.alias("direction"))

    def limits(base: Column, mad: Column) -> Column:
        return judged(F.greatest(base * SPIKE, base + MULTIPLIER * mad), F.least(base * COLLAPSE, base - MULTIPLIER * mad), base, mad)

    def of(p: Column) -> Column:
        deviation = lambda base: F.when(base.isNotNull(), median(F.transform(p, lambda x: F.abs(x - base))))
        return let(F.when(F.size(p) >= LEAST, median(p)), lambda base: let(deviation(base), lambda mad: limits(base, mad)))

    return let(past, of)


def window_metrics(events: DataFrame, window: Column, key: str, value: str, top: int = 32) -> DataFrame:
    """(window, key, n): exact counts a window and key; keys beyond the ``top`` by count, then name, are summed as [other]."""
    counts = events.groupBy(window.alias("window"), F.coalesce(F.col(value), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("window").orderBy(F.col("n").desc(), key))
    named = counts.withColumn(key, F.when(rank <= top, F.col(key)).otherwise("[other]"))
    return named.groupBy("window", key).agg(F.sum("n").alias("n"))


def patterns(counts: DataFrame, windows: int = LEAST) -> DataFrame:
    """(window, template_id, kind, current, baseline): patterns of each window, against the ``windows`` before it.

    ``counts`` holds window (consecutive numbers), template_id, n. pattern_frequency is a spike; new_pattern is one
    that none of the earlier windows has; pattern_disappearance one that all have, with a median of at least 5, and this one hasn't.
    """
    counts = counts.where("window is not null and template_id is not null").select("template_id", F.col("window").cast("bigint").alias("window"), F.coalesce("n", F.lit(0)).alias("n"))
    counts = written(counts, "counts")  # read three times
    span = counts.agg(F.min("window").alias("lo"), F.max("window").alias("hi"))
    # a count goes to its own window and to those whose past it is; no other window can have a kind
    each = counts.where("n > 0").crossJoin(F.broadcast(span)).withColumn("ago", F.explode(F.sequence(F.lit(0), F.lit(windows)))).withColumn("window", F.col("window") + F.col("ago")).where("window <= hi")
    at = lambda k: F.coalesce(F.sum(F.when(F.col("ago") == k, F.col("n"))), F.lit(0))
    length = F.least(F.lit(windows), F.max(F.col("window") - F.col("lo"))).cast("int")
    past = F.slice(F.array(*[at(k).cast("double") for k in range(windows, 0, -1)]), F.lit(windows + 1) - length, length)
    rows = each.groupBy("template_id", "window").agg(at(0).alias("n"), past.alias("past"))
    rows = change(rows, "n")
    seen = F.size(F.filter("past", lambda x: x > 0))
    kind = (
        F.when((F.col("n") > 0) & (F.col("direction") == "spike") & (seen > 0), "pattern_frequency")
        .when((F.col("n") > 0) & (seen == 0) & (F.size("past") >= windows), "new_pattern")
        .when((F.col("n") == 0) & (seen >= windows) & (F.col("direction") == "collapse"), "pattern_disappearance")
    )
    return rows.withColumn("kind", kind).where("kind is not null").select("window", "template_id", "kind", F.col("n").alias("current"), "baseline")


def concentration(errors: DataFrame, key: str, least: int = 10, share: float = 0.9) -> DataFrame:
    """(window, key, n, total, ratio): the member with the most errors of a window, where it has ``share`` of at least ``least``."""
    total = F.sum("n").over(W.partitionBy("window"))
    first = F.row_number().over(W.partitionBy("window").orderBy(F.col("n").desc(), key))
    rows = errors.withColumn("total", total).withColumn("first", first).withColumn("ratio", F.col("n") / total)
    return rows.where((F.col("first") == 1) & (F.col("total") >= least) & (F.col("ratio") >= share) & ~F.col(key).isin("unknown", "[other]")).drop("first")
