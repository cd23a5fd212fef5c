"""How filters interact: what each removes, in every order of them, from one pass over the texts."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

#: Sorts after every id: where doc_id is null.
_LAST = (1 << 63) - 1
#: Stands for "repeats an earlier text" among the filters.
REPEATS = None


def contract_filters() -> dict[str, Column | None]:
    """Failure conditions by letter, over a column ``text`` that is never null."""
    text = F.col("text")

    def few_distinct(words: Column) -> Column:
        return F.when(F.size(words) < 100, F.lit(1)).otherwise(0) + F.when(100 * F.size(F.array_distinct(words)) < 80 * F.size(words), F.lit(2)).otherwise(0)

    # words are taken once for both conditions that count them
    counted = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), few_distinct)[0]
    # capitals and marks alone: a short text from one pass over the long one
    marks = F.regexp_replace(text, "[^A-Z#$%&*|]+", "")
    capitals = F.length(F.regexp_replace(marks, "[^A-Z]+", ""))
    return {
        "A": counted.bitwiseAND(1) != 0,
        "B": counted.bitwiseAND(2) != 0,
        "C": 100 * capitals > 10 * F.length(text),
        "D": F.length(marks) > capitals,
        "E": REPEATS,
    }


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None]) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail exactly the filters in ``mask``.

    Bit i of the mask is the i-th filter. A filter is a condition over ``text`` (null
    counts as failing nothing), or REPEATS: the text stands in a row with a
    smaller doc_id too, in any part. A null doc_id comes after all others; rows of one id and
    text are no repeats of each other. ``part`` is lang, null as the empty string.
    ``good`` counts rows whose id has a label quality = 1, ``toxic`` those with toxic = 1, however many labels an id has.

    The texts are read once and never exchanged: what leaves the scan is a digest of 256 bits in
    place of the text. Rows meet by doc_id (labels, rows of one id), then as counts by digest, part and labels, so a
    text with a third of all rows is a few rows by the time its copies meet.
    """
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(filters.values()) if c is not None), F.lit(0))
    scanned = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text")
    ).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("own"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    none = F.lit(0)
    met = scanned.join(known, "doc_id", "left").select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "part", "digest", "own", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    kind = ["digest", "part", "own", "good", "toxic"]
    by_id = met.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    repeats = [i for i, c in enumerate(filters.values()) if c is REPEATS]
    if repeats:
        bit = sum(1 << i for i in repeats)
        first = F.min("least.doc_id").over(Window.partitionBy("digest")) == F.col("least.doc_id")
        by_kind, kept = by_kind.withColumn("kept", F.when(first, F.col("least.n")).otherwise(0)), F.col("kept")
        split = F.explode(F.array(F.struct(F.col("own").alias("mask"), kept.alias("n")), F.struct(F.col("own").bitwiseOR(bit).alias("mask"), (F.col("n") - kept).alias("n"))))
        counted = by_kind.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    else:
        counted = by_kind.withColumnRenamed("own", "mask")
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None] | None = None) -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter does there.

    part, filter_order, step (from 1); documents kept after the step, removed by it,
    redundant (failing its filter, but gone before), unique_fails (failing its filter alone), good_lost and toxic_lost (removed here, with
    that label), shapley (removed by this filter, summed over all orders). Every part of ``docs`` has all rows, zeros
    included; an empty table gives none. Null and empty texts, null ids, repeated rows: see ``cells``. Columns beyond doc_id, lang and text aren't read.

    All orders come from the at most 2^n cells of a part, which one row holds; n filters make n! orders, so n is at most 7.
    """
    filters = contract_filters() if filters is None else filters
    names = list(filters)
    if not 1 <= len(names) <= 7:
        raise ValueError("between 1 and 7 filters")
    held = cells(docs, labels, filters)
    parts = held.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^n
    bits = {f: 1 << i for i, f in enumerate(names)}
    steps = [
        {"filter_order": "".join(order), "step": at + 1, "bit": bits[f], "before": sum(bits[g] for g in order[:at])}
        for order in permutations(names)
        for at, f in enumerate(order)
    ]
    # one literal: the optimiser reads it once, where thousands of columns would keep it busy for seconds
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    rows = parts.select("part", "cells", F.explode(listed).alias("s")).select("part", "cells", "s.*")

    def summed(value, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda total, c: total + F.when(where(c["mask"]), value(c)).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    # of the orders of the k filters that a document fails, each of them comes first in one of k
    share = lambda c: c["n"] * F.element_at(F.array(*[F.lit(factorial(len(names)) // k) for k in range(1, len(names) + 1)]), F.bit_count(c["mask"]))
    return rows.select(
        "part", "filter_order", "step",
        summed(lambda c: c["n"], lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        summed(lambda c: c["n"], here).alias("removed"),
        summed(lambda c: c["n"], lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        summed(lambda c: c["n"], lambda m: m == bit).alias("unique_fails"),
        summed(lambda c: c["good"], here).alias("good_lost"),
        summed(lambda c: c["toxic"], here).alias("toxic_lost"),
        summed(share, lambda m: m.bitwiseAND(bit) != 0).alias("shapley"),
    )


#: DuckDB's form of ``audit`` with the contract's filters, each document and order spelt out.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT doc_id, part, [CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN coalesce(doc_id, 9223372036854775807) > first THEN 'E' END] AS marks FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, list_filter(marks, lambda x: x IS NOT NULL) AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order FROM (SELECT unnest(['A','B','C','D','E']) AS a), (SELECT unnest(['A','B','C','D','E']) AS b), (SELECT unnest(['A','B','C','D','E']) AS c),
  (SELECT unnest(['A','B','C','D','E']) AS d), (SELECT unnest(['A','B','C','D','E']) AS e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT m.part, s.filter_order, s.step, s.own, m.n, m.good, m.toxic, list_contains(m.fails, s.own) AS fail, list_has_any(m.fails, s.before) AS gone, len(m.fails) AS k FROM m, s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fail AND k = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
