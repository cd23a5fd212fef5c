"""Line deduplication by a tree of line templates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, unused

LEAD, PARTS, LEAST, LEAST_GENERAL = 4, 3, 4, 8
EXACT_TEXTS, GENERAL_TEXTS = 2, 3


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def template_keys(line: Column) -> Column:
    """array<bigint>: the line's paths in the template tree, that of its exact template first; empty if it has none.

    A path is the token count, the LEAD leading tokens, and the rest. Tokens
    that hold a digit are variable fields, `<*>`. The rest stands in the
    exact template as it is; the general ones, PARTS of them, have a third of it each
    as one `<*>`, for fields that vary in words. Lines of fewer than LEAST tokens, or of which
    more than half are variable, have no template; those of fewer than LEAST_GENERAL no general one.
    """
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>")).otherwise(line)

    def keys(w: Column) -> Column:
        n, m = F.size(w), F.size(w) - LEAD
        edge = [F.lit(LEAD) + F.floor(m * g / PARTS).cast("int") for g in range(PARTS + 1)]
        each = F.array(F.xxhash64(F.slice(w, 1, LEAD)), *[F.xxhash64(F.slice(w, a + 1, b - a)) for a, b in zip(edge, edge[1:], strict=False)])

        def paths(h: Column) -> Column:
            exact = F.xxhash64(n, F.lit(-1), h)
            general = [F.xxhash64(n, F.lit(g), *[h[i] for i in range(PARTS + 1) if i != g + 1]) for g in range(PARTS)]
            return F.when(n >= LEAST_GENERAL, F.array(exact, *general)).otherwise(F.array(exact))

        fixed = n - F.size(F.filter(w, lambda t: t == "<*>"))
        return F.when((n >= LEAST) & (2 * fixed >= n), _let(each, paths)).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _let(F.regexp_extract_all(masked, F.lit(WORD), F.lit(0)), keys)


def text_hash(text: str = "text") -> Column:
    """128 bits that stand for a text (null: empty): its lines go by them, so two texts must not be taken for one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(hash, drops): for the texts that lose lines, by hash, the numbers (from 0) of those lines.

    A template recurs if its lines stand in EXACT_TEXTS different texts, for a
    general one in GENERAL_TEXTS. A line goes if one of its templates recurs, but stays in
    the template's first text: that of the least doc_id (null last; then by hash). Copies of a text
    are one text, so they keep and lose the same lines.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = rows.select("doc", text_hash().alias("hash"), F.posexplode(F.split("text", "\n")).alias("line", "value"))
    paths = cut(lines.select("doc", "hash", "line", template_keys(F.col("value")).alias("keys")).where("size(keys) > 0"), "lines")
    each = paths.select("doc", "hash", "line", F.posexplode("keys").alias("kind", "key"))
    own = F.struct("doc", "hash")
    seen = each.groupBy("key").agg(F.min(own).alias("first"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    shared = cut(seen.where("low <> high").select("key", F.col("first.hash").alias("first")), "shared")
    met = cut(each.join(shared, "key").select("hash", "line", "kind", "key", "first"), "met")
    texts = met.where("kind > 0").select("key", "hash").distinct().groupBy("key").agg(F.count("*").alias("texts"))
    general = cut(texts.where(F.col("texts") >= GENERAL_TEXTS).select("key"), "general")
    gone = met.where("kind = 0").select("hash", "line", "first").unionByName(met.where("kind > 0").join(general, "key").select("hash", "line", "first"))
    return gone.where("hash <> first").select("hash", "line").distinct().groupBy("hash").agg(F.sort_array(F.collect_set("line")).alias("drops"))


def _marked(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: the line numbers that go (null: none) and the text that is left."""
    own, of, drops, left = unused(docs.columns, "_hash", "_of", "_drops", "_left")
    found = cut(repeated_lines(docs), "drops")
    marked = docs.withColumn(own, text_hash())
    # merged at any size: no switch from broadcasting to shuffling the texts as the corpus grows
    met = marked.join(found.select(F.col("hash").alias(of), F.col("drops").alias(drops)).hint("merge"), F.col(own) == F.col(of), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    rest = _let(lines, lambda w: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col(drops)), lambda i: F.get(w, i)), "\n"))
    return met.withColumn(left, F.when(F.col(drops).isNull(), F.col("text")).otherwise(rest)), drops, left


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines whose templates recur; documents that lose lines and have no word left go.

    n_chars, where there is one, follows the text. Null and empty texts, repeated rows, null ids and
    documents that lose nothing stay as they are.
    """
    met, drops, left = _marked(docs)
    met = met.where(F.col(drops).isNull() | F.col(left).rlike(WORD))
    out = met.withColumn("text", F.col(left))
    if "n_chars" in docs.columns:
        count = F.length(left).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(drops).isNull(), F.col("n_chars")).otherwise(count))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, n_lines, n_dropped, dropped (line numbers, comma-joined) and kept_sha256, of the text that is left."""
    met, drops, left = _marked(docs.select("doc_id", "text"))
    return met.select(
        "doc_id", F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(drops), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce(F.array_join(F.transform(drops, lambda i: i.cast("string")), ","), F.lit("")).alias("dropped"),
        F.sha2(F.coalesce(left, F.lit("")), 256).alias("kept_sha256"),
    )


#: DuckDB's form of ``report``, templates spelt out. It takes doc_id to be unique.
ORACLE = r"""
WITH texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS doc FROM documents GROUP BY 1),
lines AS (SELECT doc, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS value FROM (SELECT doc, string_split(text, chr(10)) AS l FROM texts)),
tokens AS (SELECT doc, line, list_transform(regexp_extract_all(value, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS w FROM lines),
fit AS (SELECT *, len(w) AS n FROM tokens WHERE len(w) >= 4 AND 2 * len(list_filter(w, lambda t: t <> '<*>')) >= len(w)),
paths AS (
  SELECT doc, line, 0 AS kind, w AS path, n FROM fit
  UNION ALL
  SELECT doc, line, g + 1 AS kind, w[1:4 + (n - 4) * g // 3] || ['< >'] || w[4 + (n - 4) * (g + 1) // 3 + 1:] AS path, n
  FROM fit, (SELECT unnest([0, 1, 2]) AS g) WHERE n >= 8),
recur AS (SELECT kind, path, n, min(doc) AS first FROM paths GROUP BY ALL HAVING count(DISTINCT doc) >= CASE WHEN kind = 0 THEN 2 ELSE 3 END),
gone AS (SELECT DISTINCT p.doc, p.line FROM paths p JOIN recur r USING (kind, path, n) WHERE p.doc <> r.first),
drops AS (SELECT doc, list(line ORDER BY line) AS ls FROM gone GROUP BY doc),
per AS (SELECT t.text, string_split(t.text, chr(10)) AS l, coalesce(d.ls, []) AS ls FROM texts t LEFT JOIN drops d USING (doc))
SELECT doc_id, len(l) AS n_lines, len(ls) AS n_dropped, coalesce(array_to_string(ls, ','), '') AS dropped,
  sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(l, range(len(l))), lambda z: NOT list_contains(ls, z[2])), lambda z: z[1]), chr(10)), '')) AS kept_sha256
FROM documents JOIN per ON coalesce(documents.text, '') = per.text
"""
