"""Mixing sources to target weights, block by block. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, unused

WEIGHTS = (1, 2, 3)
BLOCK, SHARD, SEED, MOST = 128, 8192, 20240607, 3
_CELL, _ROUNDS = 1024, 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """One row a source: sid (by code point, null last), source_size, target, blocks, quota and its first slot.

    The targets share the total of all sizes by the weights, which repeat in
    the order of the sources; none is above MOST times its source's size. What
    exceeds that is shared again by weight until none is above: taken by rising
    ratio of limit to weight, the sources at their limit come first, and the
    rest share what those leave. The quota is the target in blocks, to the nearest.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("ratio", "sid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    per = per.withColumn("sid", F.row_number().over(by_name).cast("bigint"))
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights)).cast("int")))
    per = per.withColumn("limit", MOST * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    per = per.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("full", F.col("level") * F.col("weight") > F.col("limit"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(every)
    per = per.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level * F.col("weight")))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
    per = per.withColumn("quota", F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("bigint"))
    first = F.coalesce(F.sum("quota").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return per.select("source", "sid", "documents", "source_size", "target", "blocks", "quota", first.alias("first"))


def _offsets(totals: DataFrame, group: str, at: str, value: str, fan: int = 256) -> DataFrame:
    """(group, at, before): the sum of ``value`` over smaller ``at`` of the group, in two steps of at most ``fan`` and 1/fan of the rows."""
    top = F.floor(F.col(at) / fan).alias("top")
    inner = W.partitionBy(group, "top").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(group).orderBy("top").rowsBetween(W.unboundedPreceding, -1)
    near = totals.select(group, at, value, top).withColumn("near", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    far = totals.groupBy(group, top).agg(F.sum(value).alias("all")).withColumn("far", F.coalesce(F.sum("all").over(outer), F.lit(0)))
    return near.join(far.select(group, "top", "far"), [group, "top"]).select(group, at, (F.col("near") + F.col("far")).alias("before"))


def layout(sized: DataFrame, sources: DataFrame, documents: int) -> DataFrame:
    """``sized`` rows with size > 0, with sid and ``start``: their place in their source's stream of words.

    A stream has its documents in the order of a hash of doc_id (then doc_id, size and
    tie). Sums run within buckets of that hash, then over the buckets, so no source meets in one task.
    """
    bits = max(1, (documents // 512).bit_length())
    rows = sized.where("size > 0").join(sources.select("source", "sid"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("hash", F.xxhash64("doc_id", F.lit(SEED))).withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits))
    running = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("hash", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow))
    within = rows.withColumn("running", running)
    totals = cut(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("t")), "totals")
    placed = within.join(_offsets(totals, "sid", "bucket", "t"), ["sid", "bucket"])
    return placed.withColumn("start", F.col("before") + F.col("running") - F.col("size")).drop("hash", "bucket", "running", "before")


def _hash(*what: Column | str | int) -> Column:
    return F.xxhash64(*[F.lit(x) if isinstance(x, int) else x for x in what])


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 named by ``key``, at x: rounds that swap x with its mirror image around a point, or don't."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(_hash(*key, r, SEED + 1) - at, n)
        return F.when(_hash(*key, r, F.greatest(at, other), SEED + 2).bitwiseAND(1) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), x.cast("bigint"), swap)


def draw(sources: DataFrame, slots: int) -> DataFrame:
    """One row a slot of the mix: shard, slot, sid, epoch and the index of the block that it takes.

    Each shard draws its slots' sources independently, in proportion to the
    quotas, so its counts are multinomial. The k-th slot of a source, over all
    shards, takes index k: in each epoch of as many slots as the source has blocks, a
    permutation maps it to a block, so none comes again before all have come.
    Slots beyond a source's quota are handed, in order, to the sources whose
    draws fell short, so that the totals are the quotas.
    """
    spark = sources.sparkSession
    known = ["sid", "blocks", "quota"]
    cells = sources.where("quota > 0").select(*known, "first", F.explode(F.expr(f"sequence(first div {_CELL}, (first + quota - 1) div {_CELL})")).alias("cell"))
    drawn = spark.range(slots).select((F.col("id") / SHARD).cast("bigint").alias("shard"), F.col("id").alias("slot"))
    drawn = drawn.withColumn("v", F.pmod(_hash("shard", "slot", SEED), F.lit(slots))).withColumn("cell", F.expr(f"v div {_CELL}"))
    met = drawn.join(cells.hint("merge"), "cell").where("v >= first and v < first + quota")
    within = F.row_number().over(W.partitionBy("sid", "shard").orderBy("slot")) - 1
    met = cut(met.select("shard", "slot", *known, within.alias("within")), "slots")
    counts = cut(met.groupBy("sid", "shard").agg(F.count("*").alias("c")), "counts")
    numbered = met.join(_offsets(counts, "sid", "shard", "c"), ["sid", "shard"]).withColumn("k", F.col("within") + F.col("before"))
    totals = counts.groupBy("sid").agg(F.sum("c").alias("drawn"))
    late = sources.join(totals, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    late = late.withColumn("short", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))).withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)))
    before = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    late = cut(late.select(*known, "drawn", "short", F.coalesce(F.sum("short").over(before), F.lit(0)).alias("short_first"), F.coalesce(F.sum("over").over(before), F.lit(0)).alias("over_first")), "late")
    numbered = numbered.drop("within", "before")
    kept = numbered.where("k < quota").select("shard", "slot", *known, "k")
    moved = numbered.where("k >= quota").join(late.select("sid", "over_first"), "sid").select("shard", "slot", (F.col("over_first") + F.col("k") - F.col("quota")).alias("o")).withColumn("cell", F.expr(f"o div {_CELL}"))
    gaps = late.where("short > 0").select(*known, "drawn", "short", "short_first", F.explode(F.expr(f"sequence(short_first div {_CELL}, (short_first + short - 1) div {_CELL})")).alias("cell"))
    moved = moved.join(gaps.hint("merge"), "cell").where("o >= short_first and o < short_first + short").select("shard", "slot", *known, (F.col("drawn") + F.col("o") - F.col("short_first")).alias("k"))
    epoch = F.expr("k div blocks")
    every = kept.unionByName(moved).withColumn("epoch", epoch)
    return every.select("shard", "slot", "sid", "epoch", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("sid"), F.col("epoch")).alias("block"))


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document's words lie in, with the words' range in the document, end exclusive."""
    rows = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    low, high = F.greatest(F.col("block") * block - F.col("start"), F.lit(0)), F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    return rows.withColumn("from", low).withColumn("to", high)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sized documents, sources, the slots drawn, pieces of documents that lie in blocks)."""
    size = word_count(F.coalesce(F.col("text"), F.lit("")))
    sized = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", size.alias("size"), row_hash(docs).alias("tie")), "sizes")
    sources = cut(targets(sized, weights, block), "sources")
    total = sources.agg(F.sum("quota").alias("slots"), F.sum("documents").alias("documents")).first()
    drawn, placed = draw(sources, total.slots or 0), layout(sized, sources, total.documents or 0)
    return sized, sources, drawn, _pieces(placed, block)


def word_count(text: Column) -> Column:
    """The number of words, without an array of them: each word, with the white space around it, becomes one character."""
    blank = r"[\x20\x09-\x0D]*"
    return F.when(text.rlike(WORD), F.length(F.regexp_replace(text, blank + WORD + blank, "w"))).otherwise(0).cast("bigint")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns whose types have one."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken``, the words that the mix takes of each row of ``docs``.

    A null text has no words; rows without words take part with 0. A null
    source is a source; repeated rows are documents of their own. Runs agree:
    all draws come from hashes.
    """
    sized, sources, drawn, pieces = plan(docs, weights, block)
    times = drawn.groupBy("sid", "block").agg(F.count("*").alias("times"))
    words = pieces.hint("merge").join(times, ["sid", "block"], "left").withColumn("words", (F.col("to") - F.col("from")) * F.coalesce("times", F.lit(0)))
    per = words.groupBy("sid", "start", "doc_id", "source", "size").agg(F.sum("words").alias("taken")).drop("sid", "start")
    per = per.unionByName(sized.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("bigint").alias("taken")))
    named = sources.select(F.col("source").alias("named"), "source_size", "target")
    return per.join(named, F.col("source").eqNullSafe(F.col("named"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """The mix as documents: a row of ``docs``'s columns for each document and epoch that takes some of it.

    Its text has the words which that epoch's blocks take, in the document's order and with the
    white space that follows them; n_chars, where there is one, is that text's length.
    """
    _, _, drawn, pieces = plan(docs, weights, block)
    met = pieces.hint("merge").join(drawn.select("sid", "block", "epoch"), ["sid", "block"])
    ranges = met.groupBy("sid", "start", "doc_id", "tie", "epoch").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("ranges"))
    # the key is never null (tie tells null from 0), so that the join takes the window's exchange of the texts
    key, tie, number, spans = unused(docs.columns, "_key", "_tie", "_copy", "_ranges")
    texts = docs.withColumn(tie, row_hash(docs)).withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)))
    copy = F.sum(F.lit(1)).over(W.partitionBy(key, tie).rowsBetween(W.unboundedPreceding, W.currentRow))
    texts = texts.withColumn(number, copy).where(F.col(number) == 1).drop(number)
    chosen = texts.join(ranges.select(F.coalesce("doc_id", F.lit(0)).alias(key), F.col("tie").alias(tie), F.col("ranges").alias(spans)).hint("merge"), [key, tie])
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    whole = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(spans, lambda r: F.slice(w, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), ""))[0]
    chosen = chosen.withColumn("text", whole)
    if "n_chars" in docs.columns:
        chosen = chosen.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns])
