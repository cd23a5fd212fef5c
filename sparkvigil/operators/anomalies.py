"""What departs from the windows before it: ten kinds of anomalies of a monitor, and the signals that they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .baseline import HORIZON, LEAST, change, changed

# The least errors of a window that can be concentrated, the share that is, and the kinds' severities where they aren't 4.
LEAST_ERRORS, SHARE = 10, 0.9
SEVERITIES = {"pattern_frequency": 3, "error_severity": 3, "pod_error_concentration": 3, "container_error_concentration": 3}
BY_HISTORY, BY_ABSENCE, BY_SHARE = "median_mad_and_ratio", "new_template_and_absent_from_recent_history", "at_least_90_percent_of_parsed_errors"
COLUMNS = ("monitor", "window", "kind", "identity", "direction", "current", "baseline", "mad", "threshold", "observations", "rule")


def _out(rows: DataFrame, rule: str = BY_HISTORY, **given: Column) -> DataFrame:
    """The common columns of changed rows; identity is null where there is none."""
    named = {"identity": F.lit(None).cast("string"), "threshold": F.when(F.col("direction") == "spike", F.col("high")).otherwise(F.col("low")), "observations": F.size("past"), "rule": F.lit(rule)} | given
    have = {c: F.col(c) for c in COLUMNS if c in rows.columns} | named if rule == BY_HISTORY else named
    return rows.select(*[have.get(c, F.col(c)).alias(c) for c in COLUMNS])


def numbered(windows: DataFrame) -> DataFrame:
    """``windows`` with nth, the number of a window among its monitor's, from 1. History is counted in windows that there are."""
    return windows.withColumn("nth", F.row_number().over(W.partitionBy("monitor").orderBy("window")))


def volumes(windows: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """total_volume, log_rate (a second) and error_severity of ``windows`` (monitor, window, seconds, total, errors), against up to ``horizon`` windows before. Errors only spike."""
    of = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("current"))
    seconds = F.greatest(F.lit(1), F.col("seconds"))
    rows = windows.select("monitor", "window", F.inline(F.array(of("total_volume", F.col("total")), of("log_rate", F.col("total") / seconds), of("error_severity", F.col("errors")))))
    before = W.partitionBy("monitor", "kind").orderBy("window").rowsBetween(-horizon, -1)
    rows = change(rows.withColumn("past", F.collect_list("current").over(before)), "current")
    return _out(rows.where("direction = 'spike' or (direction = 'collapse' and kind <> 'error_severity')"))


def _pasts(counts: DataFrame, windows: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """``counts`` (monitor, window, keys, n > 0) with nth, after (the monitor's next window), seen (its counts in the ``horizon`` windows before, latest last) and past (the same with 0 for the windows that lack it)."""
    after = F.lead("window").over(W.partitionBy("monitor").orderBy("window"))
    rows = counts.where("n > 0").join(numbered(windows).select("monitor", "window", "nth", after.alias("after")), ["monitor", "window"])
    before = W.partitionBy("monitor", *keys).orderBy("nth").rangeBetween(-horizon, -1)
    rows = rows.withColumn("seen", F.collect_list(F.col("n").cast("double")).over(before))
    return rows.withColumn("past", F.concat(F.array_repeat(F.lit(0.0), F.least(F.lit(horizon), F.col("nth") - 1) - F.size("seen")), "seen"))


def members(counts: DataFrame, windows: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """pod_volume and container_volume: spikes of ``counts`` (monitor, window, member: "pod" or "container", identity, n) against the windows before, absence counting as 0.

    Only where counts are exact in the window and in its whole history: ``windows`` may have pod_exact and container_exact, true by default.
    """
    exact = {m: F.col(f"{m}_exact") if f"{m}_exact" in windows.columns else F.lit(True) for m in ("pod", "container")}
    span = W.partitionBy("monitor").orderBy("window").rowsBetween(-horizon, 0)
    known = windows.select("monitor", "window", *[F.min(F.coalesce(e, F.lit(False))).over(span).alias(m) for m, e in exact.items()])
    fit = known.select("monitor", "window", F.inline(F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("exact")) for m in exact]))).where("exact").drop("exact")
    rows = change(_pasts(counts, windows, ["member", "identity"], horizon), "n", collapse=False).where("direction is not null")
    rows = rows.join(fit, ["monitor", "window", "member"], "left_semi")
    return _out(rows, kind=F.concat("member", F.lit("_volume")), identity=F.col("identity"), current=F.col("n").cast("double"))


def patterns(counts: DataFrame, windows: DataFrame, horizon: int = LEAST) -> DataFrame:
    """pattern_frequency, new_pattern and pattern_disappearance of ``counts`` (monitor, window, template_id, n), against the ``horizon`` windows before.

    A pattern is new if no window of a whole history has it, and may be marked ``is_new`` (false: the registry knew it). It disappears if all windows of a whole history have it,
    with a median of at least 5, and this window doesn't. Identity is the template's id.
    """
    counts = counts if "is_new" in counts.columns else counts.withColumn("is_new", F.lit(True))
    rows = _pasts(counts, windows, ["template_id"], horizon)
    order = W.partitionBy("monitor", "template_id").orderBy("nth")
    rows = rows.withColumn("next", F.lead("nth").over(order)).withColumn("run", F.collect_list(F.col("n").cast("double")).over(order.rangeBetween(1 - horizon, 0)))
    # the last window of an unbroken run of ``horizon`` windows, where the monitor's next one lacks the pattern
    last = (F.size("run") == horizon) & (F.coalesce("next", F.lit(0)) != F.col("nth") + 1) & F.col("after").isNotNull()
    rows = rows.withColumn("_now", changed(F.col("n"), F.col("past"), collapse=False)).withColumn("_gone", F.when(last, changed(F.lit(0), F.col("run"))))
    # one pass over the counts: what each says of its own window, and of the one after it
    no = F.lit(None).cast("double")

    def found(window: Column, kind: str, direction: str, current: Column, of: Column, threshold: Column, past: Column, rule: str) -> Column:
        named = {"window": window, "kind": F.lit(kind), "identity": F.col("template_id"), "direction": F.lit(direction), "current": current.cast("double"), "baseline": of["baseline"], "mad": of["mad"], "threshold": threshold, "observations": F.size(past), "rule": F.lit(rule)}
        return F.struct(*[c.alias(k) for k, c in named.items()])

    now, gone, past = F.col("_now"), F.col("_gone"), F.col("past")
    often = F.when(now["direction"] == "spike", found(F.col("window"), "pattern_frequency", "spike", F.col("n"), now, now["high"], past, BY_HISTORY))
    is_fresh = (F.size("seen") == 0) & (F.col("nth") > horizon) & F.col("is_new") & now["direction"].isNull()
    absent = F.struct(F.lit(0.0).alias("baseline"), no.alias("mad"))
    fresh = F.when(is_fresh, found(F.col("window"), "new_pattern", "new", F.col("n"), absent, F.lit(1.0), past, BY_ABSENCE))
    lost = F.when(gone["direction"] == "collapse", found(F.col("after"), "pattern_disappearance", "collapse", F.lit(0), gone, gone["low"], F.col("run"), BY_HISTORY))
    every = rows.select("monitor", F.inline(F.filter(F.array(often, fresh, lost), lambda x: x.isNotNull())))
    return every.select(*COLUMNS)


def concentrations(errors: DataFrame, windows: DataFrame) -> DataFrame:
    """pod_error_concentration and container_error_concentration: the member with the most ``errors`` (monitor, window, member, identity, n) of a window, where it has SHARE
    of at least LEAST_ERRORS. Ties go to the smaller name; unknown members and the rest of a histogram are none."""
    first = F.row_number().over(W.partitionBy("monitor", "window", "member").orderBy(F.desc("n"), "identity"))
    rows = errors.withColumn("first", first).where("first = 1").join(windows.select("monitor", "window", "errors"), ["monitor", "window"])
    rows = rows.where((F.col("errors") >= LEAST_ERRORS) & (F.col("n") / F.col("errors") >= SHARE) & ~F.col("identity").isin("unknown", "[other]"))
    none = F.lit(None).cast("double")
    return _out(rows, BY_SHARE, monitor=F.col("monitor"), window=F.col("window"), kind=F.concat("member", F.lit("_error_concentration")), identity=F.col("identity"), direction=F.lit("concentration"), current=F.col("n").cast("double"), baseline=none, mad=none, threshold=F.lit(SHARE), observations=F.lit(0))


def every(windows: DataFrame, members_n: DataFrame, patterns_n: DataFrame, errors_n: DataFrame) -> DataFrame:
    """All ten kinds (COLUMNS). A monitor without history has none but concentrations."""
    return volumes(windows).unionByName(members(members_n, windows)).unionByName(patterns(patterns_n, windows)).unionByName(concentrations(errors_n, windows))


def as_signals(found: DataFrame, window_ms: int, templates: DataFrame | None = None) -> DataFrame:
    """Anomalies as signals that ``signals.noise_gate`` and ``incidents.correlate`` take, beside those of events: see ``with_signals``.

    The monitor is their service; their id names monitor, window, kind and what it is about. ``templates`` (template_id, template) gives patterns their text.
    """
    of_pattern = F.startswith("kind", F.lit("pattern_")) | (F.col("kind") == "new_pattern")
    about = F.when(of_pattern, F.col("identity")).otherwise(F.coalesce(F.left(F.sha2("identity", 256), F.lit(16)), F.lit("total")))
    rows = found.withColumn("template_id", F.when(of_pattern, F.col("identity")).otherwise(F.concat(F.lit("monitor:"), "kind")))
    rows = rows.join(templates.select("template_id", "template"), "template_id", "left") if templates is not None else rows.withColumn("template", F.lit(None).cast("string"))
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), F.col("kind")), F.lit(4))
    start = F.col("window") * window_ms
    return rows.select(
        F.concat_ws(":", F.lit("monitor"), "monitor", F.col("window").cast("string"), "kind", about).alias("signal_id"), "template_id", F.coalesce("template", F.replace("kind", F.lit("_"), F.lit(" "))).alias("template"),
        F.col("monitor").alias("service"), F.col("monitor").alias("component"), F.col("monitor").alias("identity"), F.lit(1).cast("bigint").alias("count"), severity.alias("severity_min"), start.alias("window_start_ms"), (start + window_ms).alias("window_end_ms"),
        start.alias("first_seen_ms"), (start + window_ms).alias("last_seen_ms"), F.lit(1.0).alias("reliable_ratio"), F.lit(0.0).alias("burst_score"),
        F.struct("kind", F.col("identity").alias("about"), "direction", "current", "baseline", "mad", "threshold", "observations", "rule").alias("monitor_anomaly"),
    )


def with_signals(signals: DataFrame, found: DataFrame) -> DataFrame:
    """Signals of events and of anomalies (``as_signals``) in one table; what one side lacks is null there."""
    return signals.unionByName(found, allowMissingColumns=True)
