"""Ranked lexical search: the best documents for each item by summed term weights, found in treaps of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

#: A term, for Spark; and what stands between terms, for Arrow.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LAST = (1 << 63) - 1
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """array<string>: the terms of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """uid, doc_id, n, terms, tfs of every document with a term: n all its terms; terms and tfs those of the vocabulary, by number, and how often."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in (part for whole in batches for part in slices(whole, 2)):
            lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column(2), "")), _BETWEEN)
            words = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            n = np.bincount(doc[there], minlength=len(lists))
            at = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False)
            met = at >= 0
            keys, tfs = np.unique(doc[met] * size + at[met], return_counts=True)
            some = n > 0
            own = np.cumsum(np.concatenate([[0], np.bincount(keys // size, minlength=len(lists))]))[np.concatenate([[True], some])].astype(np.int32)
            columns = [
                batch.column(0).filter(pa.array(some)), batch.column(1).filter(pa.array(some)), pa.array(n[some], pa.int64()),
                pa.ListArray.from_arrays(pa.array(own), pa.array((keys % size).astype(np.int32))), pa.ListArray.from_arrays(pa.array(own), pa.array(tfs.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "uid bigint, doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Treaps:
    """One treap a term over its postings: a search tree by document number whose parents have the larger impacts.

    Nodes are postings, numbered by term and document; the number after the last stands for none. Equal impacts go by a
    hash, so that copies of a document make no long branches.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, vocabulary: int):
        size = len(docs)
        self.doc, self.impact = np.append(docs, -1).astype(np.int32), np.append(impacts, 0)
        self.left, self.right = np.full(size + 1, size, np.int32), np.full(size + 1, size, np.int32)
        self.roots = np.full(vocabulary, size, np.int32)
        mixed = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        order = (impacts << 20) + mixed.astype(np.int64)
        edges = np.flatnonzero(np.diff(terms, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), size], strict=True):
            self.roots[terms[a]] = a + self._build(order[a:b].tolist(), a, b)

    def _build(self, order: list[int], a: int, b: int) -> int:
        """Link the nodes a to b, whose heap order is given, along the right spine of what is built; their root's place."""
        none = len(self.doc) - 1
        left, right, spine = [none] * (b - a), [none] * (b - a), []
        for i, own in enumerate(order):
            below = none
            while spine and order[spine[-1]] < own:
                below = a + spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = a + i
            spine.append(i)
        self.left[a:b], self.right[a:b] = left, right
        return spine[0]

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For subtrees by root, rows being intervals: the roots of what of them lies in [low, high)."""
        none = len(self.doc) - 1
        nodes = nodes.copy()
        rows, columns = np.nonzero(nodes != none)
        while len(rows):
            now = nodes[rows, columns]
            doc = self.doc[now]
            over, under = doc >= high[rows], doc < low[rows]
            off = over | under
            rows, columns, now, over = rows[off], columns[off], now[off], over[off]
            now = np.where(over, self.left[now], self.right[now])
            nodes[rows, columns] = now
            live = now != none
            rows, columns = rows[live], columns[live]
        return nodes

    def best(self, terms: np.ndarray, k: int, until: int, score) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores), best first, of the k best for the sum of ``terms``, ties to the smaller number, among numbers below ``until``.

        All terms' treaps are walked at once by intervals of numbers: the sum of the largest impacts in an
        interval bounds each score there. The most promising intervals come first; each is split at the document of its largest
        impact, which is scored. An interval goes when its bound can't enter the k best.
        """
        roots = self.roots[terms]
        roots = roots[roots < len(self.doc) - 1]
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high, nodes = np.zeros(1, np.int64), np.full(1, until, np.int64), roots[None, :]
        bound = self.impact[nodes].sum(1)
        while True:
            if len(found) == k:
                stay = (bound > scores[-1]) | ((bound == scores[-1]) & (low < found[-1]))
            else:
                stay = bound > 0
            low, high, nodes, bound = low[stay], high[stay], nodes[stay], bound[stay]
            if not len(bound):
                return found, scores
            # few at first, while the k best are poor; then more at a time
            step = 16 if len(found) < k else 256
            now = np.argpartition(-bound, step)[:step] if len(bound) > step else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[now] = False
            a, b, at = low[now], high[now], nodes[now]
            top = self.impact[at].argmax(1)
            d = self.doc[at[np.arange(len(at)), top]].astype(np.int64)
            got = score(d)
            found, scores = np.concatenate([found, d[got > 0]]), np.concatenate([scores, got[got > 0]])
            first = np.lexsort((found, -scores))[:k]
            found, scores = found[first], scores[first]
            halves = [(a, d), (d + 1, b)]
            made = [self.within(at, x, y) for x, y in halves]
            low, high = (np.concatenate([own[rest], *new]) for own, new in ((low, [x for x, _ in halves]), (high, [y for _, y in halves])))
            nodes = np.concatenate([nodes[rest], *made])
            bound = np.concatenate([bound[rest], *[self.impact[x].sum(1) for x in made]])


def shard_best(group: pa.Table, weights: np.ndarray, starts: np.ndarray, wanted: np.ndarray, k: int, documents: int, length: int) -> tuple[np.ndarray, ...]:
    """(item, row, score) of the k best rows of ``group`` for each item, items being runs of ``wanted`` from ``starts``."""
    ids = pc.fill_null(group.column("doc_id"), _LAST).to_numpy()
    rank = np.empty(len(ids), np.int64)
    by_id = np.lexsort((group.column("uid").to_numpy(), ids))
    rank[by_id] = np.arange(len(ids))
    terms, tfs = (group.column(c).combine_chunks() for c in ("terms", "tfs"))
    counts = np.diff(terms.offsets.to_numpy())
    doc = np.repeat(rank, counts)
    term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
    m = 10 + (90 * group.column("n").to_numpy() * documents) // length
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, counts)))
    by_doc = np.argsort(doc, kind="stable")
    own, held = term[by_doc], impact[by_doc]
    edges = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))])
    by_term = np.lexsort((doc, term))
    trees = Treaps(term[by_term], doc[by_term], impact[by_term], len(weights))
    asked = np.zeros(len(weights), bool)
    out: list[tuple] = []

    def score(docs: np.ndarray) -> np.ndarray:
        sizes = edges[docs + 1] - edges[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(edges[docs] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        total = np.concatenate([[0], np.cumsum(held[at] * asked[own[at]])])
        return total[ends] - total[ends - sizes]

    for item, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        asked[wanted[a:b]] = True
        found, scores = trees.best(wanted[a:b], k, len(ids), score)
        asked[wanted[a:b]] = False
        out.append((np.full(len(found), item), by_id[found], scores))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _searched(docs: DataFrame, items: DataFrame, k: int, shard_postings: int) -> DataFrame | None:
    """(item, doc_id, score): the k best of each shard for the items of one block; None if nothing can match."""
    pairs = items.select("item", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).toArrow()
    if not pairs.num_rows:
        return None
    coded = pc.dictionary_encode(pairs.column("term").combine_chunks())
    vocabulary = coded.dictionary
    by_item = np.argsort(pairs.column("item").to_numpy(), kind="stable")
    wanted = coded.indices.to_numpy()[by_item].astype(np.int64)
    item_ids, starts = np.unique(pairs.column("item").to_numpy(), return_index=False, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(starts)])
    held = cut(postings(docs, vocabulary), "postings")
    whole = held.agg(F.count("*").alias("documents"), F.sum("n").alias("length"), F.sum(F.size("terms")).alias("postings")).first()
    if not whole.documents:
        return None
    documents, length = whole.documents, whole.length
    df = held.select(F.explode("terms").alias("term")).groupBy("term").count()
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("count") + 1).cast("double")))
    known = df.select("term", weight.cast("bigint").alias("weight")).toArrow()  # at most a row for each term of the block
    weights = np.zeros(len(vocabulary), np.int64)
    weights[known.column("term").to_numpy()] = known.column("weight").to_numpy()
    shards = max(1, -(-(whole.postings or 0) // shard_postings))

    def each(group: pa.Table) -> pa.Table:
        from sparkvigil.llm import lexical

        item, row, score = lexical.shard_best(group, weights, starts, wanted, k, documents, length)
        return pa.table({"item": pa.array(item_ids[item], pa.int64()), "doc_id": group.column("doc_id").take(pa.array(row)), "score": pa.array(score, pa.int64())})

    dealt = held.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))).where(F.size("terms") > 0)
    return dealt.groupBy("shard").applyInArrow(each, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard_postings: int = 1 << 21, block_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``queries`` (item_id, text) the k rows of ``docs`` with the highest scores above 0.

    N rows of ``docs`` have a term, with L terms in all; a row with n terms has m = 10 + (90 n N) div L. A term that df rows have weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and adds w ((10^9 tf) div (1000 tf + 8 m)) where it stands tf times. Ties go to the
    smaller doc_id, null last; rows that repeat are rows of their own on both sides, so an item_id that stands twice has two rankings. Null and empty texts have
    no term; items without one, and empty tables, give no rows. Columns beyond those named aren't read.

    Documents are dealt by hash to shards of about ``shard_postings`` postings, so no term's list meets in one place; each
    shard builds its treaps and gives its k best for each item, and Spark ranks those. Items go through in blocks of about ``block_bytes`` of text,
    each with one scan of the documents; the terms of a block and their weights are what is sent to the executors. An item larger than a block is a block.
    """
    items = cut(queries.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    total = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = [_searched(docs, items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, shard_postings) for b in range(blocks)]
    found = [p for p in parts if p is not None] or [docs.sparkSession.createDataFrame([], "item bigint, doc_id bigint, score bigint")]
    met = found[0]
    for p in found[1:]:
        met = met.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB's form of ``search`` with k = 10.
ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row_number() OVER () AS row, doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
