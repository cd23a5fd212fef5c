"""Near-duplicates: SimHash fingerprints and pigeonhole blocks, or Jaccard similarity and bands; components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, unused
from .components import connected_components

SEED = 42
#: Least values of the shingle sets, ROWS to a band: two sets of similarity 0.8 share no band with a probability of 3.2e-6.
BANDS, ROWS = 24, 4
#: Counts that order shingles by how common they are; more than 2^20 shingles share slots, which blurs the order of those rarer than their share.
SLOTS = 1 << 20
_DRAWN = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_hashes(text: str | None, words_each: int = 4) -> np.ndarray:
    """The XXH64 of all word shingles, in order; that of the whole of a shorter text; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= words_each:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - words_each].tolist()]
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, (ends[words_each - 1 :] - 1).tolist(), strict=True)], np.uint64)


def simhash64(text: str | None, words_each: int = 4) -> int:
    """Majority of the bits of the XXH64 of all word shingles; 0 for a text without words."""
    return _majority(shingle_hashes(text, words_each))


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of whole texts; a null text counts as empty."""

    def each(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            fp = np.array([simhash64(t, words_each) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(each, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, shared: int) -> list[int]:
    """Masks of every choice of ``shared`` of so many blocks of the 64 bits, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(each, shared)]


def blocks_for(fps: int, most: int) -> int:
    """So many blocks that random fingerprints rarely share the untouched ones: 2^(64 (b - most) / b) values."""
    b = most + 2
    while b < 16 and 2 ** (64 * (b - most) / b) < fps / 4:
        b += 1
    return b


def _hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_links(fps: DataFrame, most: int = 4, bucket: int = 48) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within ``most`` differing bits.

    ``fps`` holds distinct values in ``fp``. Two fingerprints within ``most``
    bits agree on at least b - most of b blocks, so they meet in the bucket of
    some choice of blocks. Buckets of up to ``bucket`` rows give their pairs,
    each verified. Fingerprints that lie in a larger bucket take an exact way
    whose rows grow with their number alone: two words are within 2r bits
    exactly if the balls of radius r around them meet, so each emits its ball
    and links to the least fingerprint found at a point. All pairs within a
    group are never made. ``most`` must be even.
    """
    if most % 2:
        raise ValueError("most must be even")
    blocks = blocks_for(fps.count(), most)
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, blocks - most)])
    keyed = cut(fps.select("fp", F.posexplode(masks).alias("block", "mask")).select("fp", "block", F.col("fp").bitwiseAND(F.col("mask")).alias("part")), "blocks")
    sizes = cut(keyed.groupBy("block", "part").count().where("count > 1"), "sizes")
    small = keyed.join(sizes.where(F.col("count") <= bucket), ["block", "part"]).groupBy("block", "part").agg(F.sort_array(F.collect_list("fp")).alias("fs"))
    pairs = small.select(F.posexplode("fs").alias("i", "a"), "fs").select("a", F.explode(F.expr("slice(fs, i + 2, size(fs))")).alias("b"))
    pairs = pairs.where(_hamming("a", "b") <= most)
    hot = cut(keyed.join(sizes.where(F.col("count") > bucket), ["block", "part"]).select("fp").distinct(), "hot")
    flips = [0, *(_signed(sum(1 << i for i in c)) for r in range(1, most // 2 + 1) for c in combinations(range(64), r))]
    balls = hot.select("fp", F.explode(_constants(flips)).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))
    least = cut(balls.groupBy("z").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").select("z", "b"), "balls")
    met = balls.join(least.hint("merge"), "z").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(met).distinct()


def _constants(values: list[int]) -> Column:
    """A long constant array; folded to one literal when the plan is made."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def components(docs: DataFrame, most: int = 4, words_each: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``.

    component_id is the least doc_id that links of up to ``most`` differing
    bits reach, the document's own included. Equal fingerprints always link,
    that of texts without words (0) too. Rows that repeat stay; null ids take
    part and count as no id. Exact copies are folded before any links are sought.
    """
    marked = cut(fingerprints(docs, words_each, id_col, text_col), "fingerprints")
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = cut(connected_components(near_links(fps.select("fp"), most)).withColumnRenamed("node", "fp"), "roots")
    lead = cut(roots.join(fps, "fp").groupBy("root").agg(F.min("rep").alias("component_id")), "lead")
    known = cut(roots.join(lead, "root").select("fp", "component_id"), "known")
    whole = cut(fps.join(known, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "whole")
    return marked.join(whole, "fp").select("doc_id", "fp", "component_id")


def hex16(name: str) -> Column:
    """16 lowercase hex digits of a bigint's bits."""
    return F.lower(F.lpad(F.hex(F.col(name)), 16, "0"))


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each of BANDS choices of ROWS least values of the set ``h``; sets of similarity J share each with probability J^ROWS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[at : at + 4096] * _TIMES + _PLUS).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, ROWS))]


def _shingled(docs: DataFrame, words_each: int, whole: bool) -> DataFrame:
    """(doc, text_hash, set_hash, n, fp, and the band keys or, if ``whole``, the set itself) of each row of (doc, text_hash, text); a text without words has neither.

    ``fp`` is the SimHash of the text's shingles, repeats included; where the set itself is asked for it is null.
    """
    name = "items" if whole else "keys"

    def each(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            hashes = [shingle_hashes(t, words_each) for t in batch.column("text").to_pylist()]
            fp = pa.nulls(len(hashes), pa.int64()) if whole else pa.array(np.array([_majority(h) for h in hashes], np.uint64).view(np.int64))
            sets = [np.unique(h) for h in hashes]
            lists = sets if whole else [np.array(band_keys(h) if len(h) else [], np.uint64) for h in sets]
            offsets = np.cumsum([0, *map(len, lists)])
            values = pa.array(np.concatenate([*lists, np.zeros(0, np.uint64)]).view(np.int64))
            named = pa.array([xxhash.xxh3_128_digest(h.tobytes(), SEED) for h in sets], pa.binary())
            columns = [batch.column("doc"), batch.column("text_hash"), named, pa.array([len(h) for h in sets], pa.int32()), fp, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "text_hash", "set_hash", "n", "fp", name])

    return docs.mapInArrow(each, f"doc bigint, text_hash binary, set_hash binary, n int, fp bigint, {name} array<bigint>")


def _text_hash() -> Column:
    """128 bits that stand for a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of at least ``similar``."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("of_a")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("items").alias("of_b")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    return both.where(F.col("shared") / (F.size("of_a") + F.size("of_b") - F.col("shared")) >= similar).select("a", "b")


def _commonness(sets: DataFrame) -> np.ndarray:
    """How many items of all sets fall on each of SLOTS slots; an item's slot is its low bits. Of a fixed size, whatever the table's."""
    items = sets.select(F.explode("items").alias("item"))
    found = items.groupBy(F.col("item").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).count().toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["count"].to_numpy()
    return out


def _prefixes(sets: DataFrame, similar: float) -> DataFrame:
    """(node, n, item, i): the rarest items of each set with their places, as many as a set must share one of with any similar set.

    All sets are ordered alike, by commonness and then by value, so results are exact whatever the commonness says.
    """
    common = sets.sparkSession.sparkContext.broadcast(_commonness(sets))

    def each(batches):
        for batch in batches:
            rare = []
            for items in batch.column("items"):
                h = items.values.to_numpy()
                rare.append(h[np.lexsort((h, common.value[h & (SLOTS - 1)]))][: len(h) - _at_least(similar * len(h)) + 1])
            if rare:
                many = [len(h) for h in rare]
                n = pc.list_value_length(batch.column("items")).to_numpy()
                columns = [np.repeat(batch.column("node").to_numpy(), many), np.repeat(n, many), np.concatenate(rare), np.concatenate([np.arange(k, dtype=np.int32) for k in many])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "n", "item", "i"])

    return sets.select("node", "items").mapInArrow(each, "node bigint, n int, item bigint, i int")


def _at_least(x: float) -> int:
    return int(np.ceil(x - 1e-9))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _fits(similar: float) -> Column:
    """Whether sets of ``xn`` and ``yn`` items, whose first common item lies at ``xi`` and ``yi``, can be similar; y is the smaller or of equal size."""
    enough = F.ceil(F.lit(similar / (1 + similar)) * (F.col("xn") + F.col("yn")) - 1e-9)
    sizes = (F.col("yn") <= F.col("xn")) & (F.col("yn") >= F.lit(similar) * F.col("xn") - 1e-9)
    return sizes & (F.least(F.col("xn") - F.col("xi"), F.col("yn") - F.col("yi")) >= enough)


def _central(prefixes: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b): each set with the most central one of an item, that with the fewest items rarer than it."""
    hub = F.min_by(F.struct(F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j")), F.struct("i", "node")).alias("hub")
    hubs = prefixes.groupBy("item").agg(hub, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("item", "hub.*")
    met = prefixes.join(hubs, "item").where("node <> b")
    x = F.col("n") > F.col("m")
    sizes = met.select("node", "b", F.greatest("n", "m").alias("xn"), F.least("n", "m").alias("yn"), F.when(x, F.col("i")).otherwise(F.col("j")).alias("xi"), F.when(x, F.col("j")).otherwise(F.col("i")).alias("yi"))
    return sizes.where(_fits(similar)).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def _unlinked(prefixes: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of different roots that can be similar: every similar pair that no links connect is among them.

    Sizes and places are compared by class, (n, i) of an item, and only classes that fit give pairs, so a frequent item costs no comparison of all its sets.
    """
    both = prefixes.groupBy("item").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("item")
    rows = cut(prefixes.join(both, "item"), "split")
    short = rows.where(F.col("i") <= F.col("n") - F.ceil(F.lit(2 * similar / (1 + similar)) * F.col("n") - 1e-9))
    of = lambda t, k: t.groupBy("item", F.col("n").alias(k + "n"), F.col("i").alias(k + "i")).agg(F.min("root").alias(k + "low"), F.max("root").alias(k + "high"))
    same = (F.col("xlow") == F.col("xhigh")) & (F.col("ylow") == F.col("yhigh")) & (F.col("xlow") == F.col("ylow"))
    classes = cut(of(rows, "x").join(of(short, "y"), "item").where(_fits(similar) & ~same).select("item", "xn", "xi", "yn", "yi"), "classes")
    x = rows.select("item", F.col("n").alias("xn"), F.col("i").alias("xi"), F.col("node").alias("x"), F.col("root").alias("xroot"))
    y = short.select("item", F.col("n").alias("yn"), F.col("i").alias("yi"), F.col("node").alias("y"), F.col("root").alias("yroot"))
    # roots pair first, so that the sets of one large component are not compared with each other only to be thrown away
    apart = x.drop("x").distinct().join(classes, ["item", "xn", "xi"]).join(y.drop("y").distinct(), ["item", "yn", "yi"]).where("xroot <> yroot")
    some = apart.join(x, ["item", "xn", "xi", "xroot"]).join(y, ["item", "yn", "yi", "yroot"])
    return some.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _by_print(nodes: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` whose SimHash fingerprints link (``near_links``) and whose sizes allow that they are similar.

    Nodes of one fingerprint meet its least one, and the least ones of fingerprints that link meet each other. Texts without words have no pairs.
    """
    some = nodes.where("n > 0").select("node", "n", "fp")
    leads = cut(some.groupBy("fp").agg(F.min_by(F.struct("node", "n"), "node").alias("lead")).select("fp", "lead.*"), "prints")
    of = lambda side: leads.select(F.col("fp").alias(side), F.col("node").alias(side + "_node"), F.col("n").alias(side + "_n"))
    near = near_links(leads.select("fp")).join(of("a"), "a").join(of("b"), "b")
    same = some.join(of("b").withColumnRenamed("b", "fp"), "fp").where("node <> b_node")
    columns = lambda t, node, n: t.select(F.greatest(node, "b_node").alias("a"), F.least(node, "b_node").alias("b"), F.least(n, "b_n").alias("less"), F.greatest(n, "b_n").alias("more"))
    pairs = columns(same, "node", "n").unionByName(columns(near, "a_node", "a_n"))
    return pairs.where(F.col("less") / F.col("more") >= similar).select("a", "b").distinct()


def _grouped(docs: DataFrame, similar: float, words_each: int) -> DataFrame:
    """(doc, text_hash, root) of each row of ``docs``: rows of one root are near duplicates, over links at least; see ``similar_components``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), _text_hash().alias("text_hash"), text.alias("text"))
    marked = cut(_shingled(rows, words_each, whole=False), "bands")
    # a node for each different set; its number, unlike a hash of 64 bits, can stand for no other
    alike = marked.groupBy("set_hash").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = cut(alike.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = cut(nodes.select("node", "n", "text_hash", F.explode("keys").alias("key")), "keyed")
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top"), F.min_by("n", "node").alias("m")).where("b <> top")
    shared = cut(keyed.join(least.select("key", "b", "m"), "key"), "buckets")
    near = cut(_by_print(nodes, similar), "near")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = shared.select("text_hash").unionByName(ends.join(nodes.select("node", "text_hash"), "node").select("text_hash")).distinct()
    held = rows.join(texts.hint("merge"), "text_hash", "left_semi").groupBy("text_hash").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    found = _shingled(held.select("doc", "text_hash", "text"), words_each, whole=True).select("set_hash", "items")
    sets = cut(found.join(nodes.select("set_hash", "node"), "set_hash").select("node", "items"), "sets")

    fit = F.least("n", "m") / F.greatest("n", "m") >= similar
    stars = shared.where("node <> b").where(fit).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))
    done = cut(near.unionByName(stars).distinct(), "stars")
    links = cut(_verified(done, sets, similar), "links")
    roots = cut(connected_components(links), "roots")
    rooted = _rooted(shared.select("key", "node"), roots)
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = cut(rooted.join(split, "key").select("node").distinct().join(sets, "node"), "rest")
    rarest = cut(_prefixes(rest, similar), "rarest")
    held_twice = rarest.groupBy("item").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("item")
    prefixes = cut(rarest.join(held_twice, "item"), "prefixes")
    for step in (_central, _unlinked):
        pairs = cut(step(_rooted(prefixes, roots), similar).join(done, ["a", "b"], "left_anti"), "pairs")
        done = done.unionByName(pairs)
        links = links.unionByName(cut(_verified(pairs, rest, similar), "links"))
        roots = cut(connected_components(links), "roots")
    named = cut(_rooted(nodes.select("node", "set_hash"), roots).select("set_hash", "root"), "named")
    return marked.select("doc", "text_hash", "set_hash").join(named, "set_hash").select("doc", "text_hash", "root")


def similar_components(docs: DataFrame, similar: float = 0.8, words_each: int = 5) -> DataFrame:
    """(doc_id, component_id): one row for each row of ``docs``.

    component_id is the least doc_id that links reach, null where all are; texts link if the Jaccard similarity of
    their sets of word shingles is at least ``similar``. Texts of one set are one node, those without words (null, empty) too.
    Rows of one id are told apart by their texts: each is in the component of its own text.
    Candidates are texts whose SimHash fingerprints are within 4 bits; each link is verified on the whole sets. As most pairs
    of similarity 0.8 differ in more bits, texts that share a band key are candidates too. The members of a band's bucket
    meet its least one first, then the most central set that holds a rare shingle of theirs. What no links
    connect by then meets by rare shingles: similar sets share one among their rarest, at places that leave enough to share.
    """
    rows = cut(_grouped(docs, similar, words_each), "grouped")
    lead = rows.groupBy("root").agg(F.min("doc").alias("component_id"))
    return rows.join(lead, "root").select(F.col("doc").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, similar: float = 0.8, words_each: int = 5) -> DataFrame:
    """The rows of ``docs`` that remain when one row of each near-duplicate group stays.

    Groups are those of ``similar_components``, taken by row: whatever ids repeat or are null, one row of each group stays,
    that with the least doc_id (null last), of those the one whose text has the least hash.
    """
    from pyspark.sql import Window as W

    doc, text_hash, number = unused(docs.columns, "_doc", "_hash", "_n")
    first = F.struct(F.col("doc").isNull(), "doc", "text_hash")
    leads = _grouped(docs, similar, words_each).groupBy("root").agg(F.min(first).alias("x"))
    keep = cut(leads.select(F.col("x.doc").alias(doc), F.col("x.text_hash").alias(text_hash)).distinct(), "keep")
    marked = docs.withColumn(number, _text_hash())
    kept = marked.join(keep.hint("merge"), F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.col(number) == F.col(text_hash)), "left_semi")
    one = W.partitionBy("doc_id", number).orderBy(F.col("text").isNull())
    return kept.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).drop(number)
