"""Search hits to records, by a strict contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import variants
from ..functions.text import let

#: Where a hit's source holds each field of a record.
MAPPING = {
    "message": "message", "timestamp": "@timestamp", "sequence": "sequence", "cluster_id": "cluster_id", "namespace": "kubernetes.namespace_name",
    "pod": "kubernetes.pod_name", "container": "kubernetes.container_name",
}
STREAM = ("cluster_id", "namespace", "pod", "container")
_TEXT, _WHOLE, _NUMBER = ("STRING",), ("BIGINT",), ("STRING", "BIGINT", "DOUBLE", "DECIMAL")


def _kind(value: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL ... of a variant; null where it is missing."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _is(value: Column, kinds: tuple[str, ...]) -> Column:
    return F.coalesce(_kind(value).isin(*kinds), F.lit(False))


def checked(hits: DataFrame, mapping: dict[str, str] = MAPPING, longest: int | None = None) -> DataFrame:
    """Adds the record's fields and ``fault`` to hits (index, id, version, source VARIANT): the first rule that a hit breaks, or null.

    Index and id must be texts that aren't blank; the version, where there is one, at least 1; the message a text (of at most ``longest`` characters);
    the time a number or a text that isn't blank; the sequence a whole number; each part of the stream's identity a text that isn't blank.
    """
    got = hits
    for name, path in mapping.items():
        got = got.withColumn("_" + name, variants.at(F.col("source"), path))
    text = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    plain = {name: F.when(_is(F.col("_message"), _TEXT), F.try_variant_get("_message", "$", "string")) if name == "message" else variants.text(F.col("_" + name)) for name in mapping}
    faults = [
        (~text(F.col("index")), "index"), (~text(F.col("id")), "id"), (F.col("source").isNull(), "source"), (F.coalesce(F.col("version") < 1, F.lit(False)), "version"), (~_is(F.col("_message"), _TEXT), "message"),
        (~_is(F.col("_timestamp"), _NUMBER) | ~text(plain["timestamp"]), "timestamp"), *[(~_is(F.col("_" + s), _TEXT) | ~text(plain[s]), s) for s in STREAM], (~_is(F.col("_sequence"), _WHOLE), "sequence"),
    ]
    if longest is not None:
        faults.insert(5, (F.length(plain["message"]) > longest, "message_size"))
    fault = F.coalesce(*[F.when(c, F.lit(name)) for c, name in faults])
    return got.select("*", *[value.alias(name) for name, value in plain.items()], fault.alias("fault")).drop(*["_" + n for n in mapping])


def pages(checked_hits: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """(records of whole pages, refusals): a page with one faulty hit is refused whole. Refusals are (page, hits, faulty, fault), the fault being the first by id."""
    w = W.partitionBy(page)
    marked = checked_hits.withColumn("_bad", F.count("fault").over(w))
    first = F.min_by("fault", F.when(F.col("fault").isNotNull(), F.struct("id", "fault")))
    refused = checked_hits.groupBy(page).agg(F.count("*").alias("hits"), F.count("fault").alias("faulty"), first.alias("fault")).where(F.col("faulty") > 0)
    return marked.where(F.col("_bad") == 0).drop("_bad", "fault"), refused


def uploaded(files: DataFrame) -> DataFrame:
    """(path, ordinal, line) of uploads (path, text): the elements of a JSON list of objects, or one object, as JSON lines; what isn't such JSON by physical lines.

    Files named .json or .txt are tried as JSON; blanks, a byte order mark and a last line end don't count. For files that fit into a row; CSV goes by ``csv_lines``.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\x{FEFF}", "")
    try_json = F.lower("path").rlike(r"\.(json|txt)$")

    def lines(v: Column) -> Column:
        one = F.schema_of_variant(v)
        listed = F.try_variant_get(v, "$", "array<variant>")
        whole = F.forall(listed, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
        return F.when(F.startswith(one, F.lit("OBJECT")), F.array(F.to_json(v))).when(F.startswith(one, F.lit("ARRAY")) & whole, F.transform(listed, lambda x: F.to_json(x)))

    physical = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    found = F.coalesce(let(F.when(try_json, F.try_parse_json(text)), lines), physical)
    return files.select("path", F.posexplode(found).alias("ordinal", "line"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line): the rows of a table, such as ``spark.read.csv`` with a header gives, as JSON lines; empty fields stay as null members."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
