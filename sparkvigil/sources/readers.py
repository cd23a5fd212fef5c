"""Sources: log files, alarm packages, and a paged search source; sinks: registries and window commits."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: The columns that tell a package's files apart.
ALARM_COLUMNS = {"alarm_id", "timestamp", "host", "service", "severity", "alarm_type"}
INVENTORY_COLUMNS = {"host", "servis", "veri_merkezi", "kabin", "ortam", "is_kritikligi"}
DEPENDENCY_COLUMNS = {"kaynak_servis", "hedef_servis", "bagimlilik_tipi", "kritiklik"}
PACKAGE_SEVERITY = {1: "INFO", 2: "WARNING", 3: "WARNING", 4: "ERROR", 5: "CRITICAL"}


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stream, ordinal, line) of each file under ``path``: whole files, so that ordinals are stable."""
    whole = spark.read.format("binaryFile").load(path).select("path", F.decode(F.col("content"), F.lit("UTF-8")).alias("text"))
    return whole.select(F.col("path").alias("stream"), F.posexplode(F.split("text", r"\r?\n")).alias("ordinal", "line"))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stream, ordinal, line) of each file under ``path``, whatever its size: files are read in splits, and no file is one row.

    A split's lines are counted first; the counts before a split, summed, are the ordinal of its first line. Within a split lines
    are numbered as they are read, so lines themselves are neither sorted nor exchanged. Lines end at a line feed, a carriage return or both; nothing follows the last end.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("stream"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    counts = rows.groupBy("stream", "block").agg(F.count("*").alias("lines"), F.min("nth").alias("first"))
    before = F.coalesce(F.sum("lines").over(W.partitionBy("stream").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("stream", "block", "first", before.alias("before"))
    return rows.join(starts, ["stream", "block"]).select("stream", (F.col("before") + F.col("nth") - F.col("first")).alias("ordinal"), F.col("value").alias("line"))


def package(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(alarms, inventory, dependencies) of a ZIP of JSON lists and CSV files, told apart by their columns, not their names.

    A package is a small file that operators upload. The first alarm file counts, and the last of the others.
    Values are text; nested ones are JSON.
    """
    alarms = inventory = dependencies = None
    with zipfile.ZipFile(path) as z:
        for name in sorted(z.namelist()):
            text = z.read(name).decode("utf-8-sig", "replace")
            rows = json.loads(text) if name.endswith(".json") else list(csv.DictReader(io.StringIO(text))) if name.endswith(".csv") else []
            if not isinstance(rows, list) or not rows or not isinstance(rows[0], dict):
                continue
            have = set(rows[0])
            if ALARM_COLUMNS <= have:
                alarms = alarms or rows
            elif INVENTORY_COLUMNS <= have:
                inventory = rows
            elif DEPENDENCY_COLUMNS <= have:
                dependencies = rows
    if alarms is None:
        raise ValueError("the package holds no alarm file")
    return _frame(spark, alarms), inventory and _frame(spark, inventory), dependencies and _frame(spark, dependencies)


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(k for r in rows for k in r))
    said = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return spark.createDataFrame([tuple(said(r.get(k)) for k in names) for r in rows], ", ".join(f"`{k}` string" for k in names))


def quality(alarms: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: alarms, those without inventory, and those whose service differs from it."""
    met = host_enriched(alarms, inventory)
    return met.agg(F.count("*").alias("alarms"), F.count_if(F.col("inventory_missing")).alias("missing"), F.count_if(F.trim("service") != F.trim("inv_servis")).alias("service_differs"))


def host_enriched(alarms: DataFrame, inventory: DataFrame, host: str = "host", also: str = "host") -> DataFrame:
    """Alarms with their host's inventory row, by trimmed name, and whether there is one."""
    rows = inventory.select(F.trim(F.col(also)).alias("_host"), *[F.col(c).alias("inv_" + c) for c in inventory.columns])
    met = alarms.join(rows, F.trim(F.col(host)) == F.col("_host"), "left")
    return met.withColumn("inventory_missing", F.col("_host").isNull()).drop("_host")


def index_dates(start: datetime, end: datetime) -> list[str]:
    """The UTC days that a half-open interval touches."""
    first, last = start.astimezone(UTC).date(), (end - timedelta(microseconds=1)).astimezone(UTC).date()
    return [(first + timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]


def cursor(selection: dict, after: list) -> str:
    """A cursor bound to what was selected."""
    return json.dumps({"selection": hashlib.sha256(json.dumps(selection, sort_keys=True).encode()).hexdigest(), "after": after})


def resume(selection: dict, text: str) -> list:
    held = json.loads(text)
    if held["selection"] != json.loads(cursor(selection, []))["selection"]:
        raise ValueError("the cursor belongs to another selection")
    return held["after"]


def walk(client, lo: int, hi: int, most: int | None = None) -> Iterator[tuple[list, str | None]]:
    """(rows, stop reason or None) of each page of [lo, hi): a span ends with its last page (interval_exhausted), with an empty page that
    points further (current_view_exhausted), or after ``most`` pages (page_budget)."""
    after, number = None, 0
    while True:
        rows, after = client.page(lo, hi, after)
        number += 1
        stop = "interval_exhausted" if after is None else "current_view_exhausted" if not rows else "page_budget" if number == most else None
        yield rows, stop
        if stop:
            return


class PagedReader(DataSourceReader):
    """Reads half-open spans of time, one a partition, page after page, and checks each span's count."""

    def __init__(self, schema, options):
        self.schema, self.options, self.terms = schema, options, {}
        self.start, self.end, self.step = (int(options[k]) for k in ("start_ms", "end_ms", "span_ms"))
        self.most = int(options["max_pages"]) if "max_pages" in options else None

    def _client(self):
        import importlib

        module, _, name = self.options["client"].rpartition(".")
        return getattr(importlib.import_module(module), name)

    def partitions(self):
        return [InputPartition((at, min(at + self.step, self.end))) for at in range(self.start, self.end, self.step)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:  # no time is left
            return
        options = dict(self.options) | ({"terms": dict(self.terms)} if self.terms else {})
        client, (lo, hi) = self._client()(options), partition.value
        expected, got, stop = client.count(lo, hi), 0, None
        for rows, stop in walk(client, lo, hi, self.most):
            for row in rows:
                got += 1
                yield (*row, stop) if len(row) < len(self.schema) else tuple(row)
        if got != expected and stop != "page_budget":
            raise RuntimeError(f"[{lo}, {hi}) should hold {expected} rows and gave {got}: {stop}")


class PushingReader(PagedReader):
    """A paged reader that takes filters: equality on the client's ``terms`` goes to the client, bounds on the time column narrow the spans."""

    def pushFilters(self, filters):
        """Bounds on time narrow the spans, and Spark checks them once more."""
        able, at = getattr(self._client(), "terms", ()), self.schema[0].name
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in able and name not in self.terms:
                self.terms[name] = f.value
                continue
            if name == at and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            elif name == at and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
            yield f


class PagedSource(DataSource):
    """spark.read.format("paged_search"): options client (a dotted name), start_ms, end_ms and span_ms.

    The client, made from the options, has count(lo, hi) and page(lo, hi, after) -> (rows, next after or None), and may name the columns
    whose equality it takes in ``terms``; it finds those asked for in options["terms"]. That needs push_filters = true, and
    spark.sql.python.filterPushdown.enabled in the session. ``max_pages`` stops a span after so many; a last column that the schema has
    beyond the client's rows holds the stop reason of the page that ends a span (see ``walk``), else null.
    """

    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return self.options.get("schema", "ts_ms bigint, record_id string, raw string")

    def reader(self, schema):
        return (PushingReader if self.options.get("push_filters") == "true" else PagedReader)(schema, self.options)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def keyset_page(rows: DataFrame, at: str, key: str, limit: int, before: tuple | None = None) -> DataFrame:
    """The ``limit`` newest rows before (at, key) = ``before``, newest first, ties by the larger key; the first page where that is None.

    The last row's (at, key) is the next page's ``before``, so pages cover all rows once while ``key`` is unique, whatever comes in above. The
    bound on ``at`` reaches the scan.
    """
    if before is not None:
        a, k = map(F.lit, before)
        rows = rows.where((F.col(at) <= a) & ((F.col(at) < a) | (F.col(key) < k)))
    return rows.orderBy(F.desc(at), F.desc(key)).limit(limit)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], newest: str, keep: int | None = None) -> DataFrame:
    """The registry at ``path`` with ``rows`` put in by key, the newest by ``newest`` staying, and at most the ``keep`` latest of all.

    Written beside the old one; the caller swaps the names.
    """
    if _exists(spark, path):  # any other trouble with it must not pass for an empty registry
        rows = spark.read.parquet(path).unionByName(rows)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.col(newest).desc()))).where("_n = 1").drop("_n")
    return rows.orderBy(F.col(newest).desc()).limit(keep) if keep else rows


def commit_window(rows: DataFrame, path: str, query: str, batch: int) -> bool:
    """Writes a batch's rows once: under its own name, which a repeated batch finds taken or replaces whole."""
    target = f"{path}/query={query}/batch={batch}"
    spark = rows.sparkSession
    if _exists(spark, target + "/_SUCCESS"):
        return False
    rows.write.mode("overwrite").parquet(target)
    return True
