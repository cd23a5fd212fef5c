"""Order MinHash document fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

BUCKETS, TAKEN, K = 64, 2, 3
#: An entry of the sorted sketch, as one long: 6 bits of bucket, 29 of hash, 28 of place.
_HASH_BITS, _PLACE_BITS = 29, 28


def signature(text: Column, k: int = K) -> Column:
    """array<bigint>: for each of BUCKETS buckets its number (upper 6 bits) and the hash of its tuple (lower 57); empty for a text without words.

    The k-mers are of ``k`` words (fewer words: the whole sequence; none: no
    k-mer). An occurrence-numbered k-mer is the pair of a k-mer and the number
    of times it came before; its hash is that of the k-mer at first and of both together after that, and names
    its bucket and its rank there. Each bucket takes
    its TAKEN least pairs, puts them back into text order and hashes the tuple. A bucket that holds fewer goes on with
    those of the buckets after it, round and round, so that short texts too have whole tuples, and with them an order.
    One hash deals the k-mers out to all buckets, so a text is hashed and sorted
    once however many buckets there are. Equal texts have equal signatures.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(F.array(words), lambda w: _of_words(w, k))[0]


def _of_words(w: Column, k: int) -> Column:
    def entry(i: Column, h: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(h, 64 - 6 - _HASH_BITS), _PLACE_BITS).bitwiseOR(i.cast("bigint"))

    def numbered(e: Column) -> Column:
        """The sorted entries, those that repeat a k-mer hashed anew with their number, sorted again if there are any."""
        heads = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.shiftrightunsigned(F.get(e, i), _PLACE_BITS) != F.shiftrightunsigned(F.get(e, i - 1), _PLACE_BITS)))

        def again(h: Column) -> Column:
            numbers = F.flatten(F.transform(h, lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get(h, j + 1), F.size(e)) - s - 1)))
            anew = F.zip_with(e, numbers, lambda x, n: F.when(n == 0, x).otherwise(entry(_place(x), F.xxhash64(F.shiftrightunsigned(x, _PLACE_BITS), n.cast("bigint")))))
            return F.when(F.size(h) == F.size(e), e).otherwise(F.sort_array(anew))

        return F.transform(F.array(heads), again)[0]

    last = F.size(w) - k
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: entry(i, F.xxhash64(*[F.get(w, i + j) for j in range(k)])))
    few = F.array(entry(F.lit(0), F.xxhash64(F.concat_ws(" ", w))))
    entries = F.when(F.size(w) == 0, F.expr("cast(array() as array<bigint>)")).when(last < 0, few).otherwise(many)
    made = F.transform(F.array(F.sort_array(entries)), lambda e: F.when(F.size(e) < 2, e).otherwise(numbered(e)))[0]
    return F.transform(F.array(made), _tuples)[0]


def _bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, _HASH_BITS + _PLACE_BITS)


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, _PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND((1 << _PLACE_BITS) - 1)


def _tuples(entries: Column) -> Column:
    """The tuples of all buckets, by bucket. In sorted entries, a bucket's TAKEN begin with the first entry that isn't below the bucket, so an entry
    that is the first of its bucket serves that bucket and the empty ones before it; the first of all serves those behind the last, too."""
    heads = F.filter(F.sequence(F.lit(0), F.size(entries) - 1), lambda i: (i == 0) | (_bucket(F.get(entries, i)) != _bucket(F.get(entries, i - 1))))

    def tuple_hash(i: Column) -> Column:
        x, y = F.get(entries, i), F.get(entries, (i + 1) % F.size(entries))
        pair = F.when(_place(x) < _place(y), F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x)))
        return F.shiftrightunsigned(F.when(F.size(entries) == 1, F.xxhash64(_hash(x))).otherwise(pair), 7)

    def spread(h: Column) -> Column:
        top = lambda k: _bucket(F.get(entries, F.get(h, k))).cast("int")

        def served(k: Column) -> Column:
            """The k-th head's tuple, under each bucket that it serves; k = the number of heads stands for the first once more."""
            first = F.when(k == 0, F.lit(0)).otherwise(top(k - 1) + 1)
            last = F.when(k == F.size(h), F.lit(BUCKETS - 1)).otherwise(top(k))
            none = F.expr("cast(array() as array<int>)")
            own = F.transform(F.array(tuple_hash(F.get(h, k % F.size(h)))), lambda t: F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(none), lambda b: F.shiftleft(b.cast("bigint"), 57).bitwiseOR(t)))
            return own[0]

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(h)), served))

    made = F.transform(F.array(heads), spread)[0]
    return F.when(F.size(entries) == 0, entries).otherwise(made)


def fingerprint(sig: Column) -> Column:
    """The signature as text: for each bucket, bucket and 32 bits of its tuple's hash, 10 hex digits."""
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(F.shiftrightunsigned(x, 25)), 10, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the buckets that either signature fills, 0 to 1; 1 where neither fills any."""
    filled = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda x: F.shiftrightunsigned(x, 57))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, signature, fingerprint) of whole texts; a null text counts as empty."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.select("doc_id", signature(F.col("text"), k).alias("signature")).withColumn("fingerprint", fingerprint(F.col("signature")))


def following(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, tie, n), which don't repeat, with those of the row after each: by descending doc_id, then tie; after the last, the first.

    Rows are dealt out by ranges of doc_id; each range finds its neighbours by
    a window, and the ranges' edges, one row a range, meet in a last one.
    Null ids come last.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.struct("doc_id", "tie", "n")
    dealt = cut(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    inner = dealt.withColumn("next", F.lead(own).over(W.partitionBy("part").orderBy(*order)))
    ring, whole = W.orderBy("part"), W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edge = dealt.groupBy("part").agg(F.max(own).alias("first"))
    edge = edge.select("part", F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("after"))
    return inner.join(edge, "part").select("doc_id", "tie", "n", F.coalesce("next", "after").alias("next"))


def against_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has the last floor(n / 2) of its n code points replaced by
    the first as many (or all) of the next document, by descending doc_id;
    after the last comes the first. Rows that repeat an id are ordered by a
    hash of their text; of rows that repeat id and text, each is the next of the one before.
    Null texts count as empty; a table of one row is its own next. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # key and tie are never null, so that one exchange of the texts serves both joins and the window
    tie = F.xxhash64("text", F.col("doc_id").isNull()).alias("tie")
    keys = cut(rows.select("doc_id", tie, F.length("text").alias("n")).distinct(), "keys")
    # doc_id comes back from the links: with the same columns on both sides, that exchange is made once
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("key"), tie, "text")
    linked = cut(following(keys), "linked")
    back = linked.select(F.coalesce("next.doc_id", F.lit(0)).cast("bigint").alias("key"), F.col("next.tie").alias("tie"), F.col("next.doc_id").alias("doc_id"), F.struct(F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("key"), "tie", "n").alias("to"))
    number = F.sum(F.lit(1)).over(W.partitionBy("key", "tie").rowsBetween(W.unboundedPreceding, W.currentRow))
    held = rows.join(back.hint("merge"), ["key", "tie"]).withColumn("number", number)
    sent = held.where("number = 1").select(
        F.col("to.key").alias("key"), F.col("to.tie").alias("tie"),
        F.expr("substring(text, 1, int(to.n div 2))").alias("start"), signature(F.col("text"), k).alias("next_signature"),
    )
    met = held.drop("to").join(sent, ["key", "tie"]).select("doc_id", "text", "number", "start", "next_signature")
    half = F.expr("length(text) div 2")
    met = met.select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), half.cast("int").alias("half"), (F.col("number") > 1).alias("copy"), "start", "next_signature")
    start = F.when(F.col("copy"), F.expr("substring(text, 1, half)")).otherwise(F.col("start"))
    met = met.select("doc_id", "n_chars", "copy", signature(F.col("text"), k).alias("own"), F.concat(F.expr("substring(text, 1, int(n_chars) - half)"), start).alias("edited"), "next_signature")
    met = met.select("doc_id", "n_chars", "copy", "own", "next_signature", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("edited"), k).alias("changed"))
    return met.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        F.when(F.col("copy"), F.lit(1.0)).otherwise(likeness(F.col("own"), F.col("next_signature"))).alias("near_next"),
    )
