"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where that is proven right."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

#: Texts whose ids and lengths tell whether a model can be spliced: normalisation would change some of them.
_PROBES = ["", " ", "  a  b ", "ﬁn é é Ａ　\xa0x", "\x00a\tb\r\n\n c", "▁a ▁", "<s>a</s><unk><0x0A>", "日本語😀 \U0010fffe", "aaaaaaaaaaaaaaaaaaa", "it's 12345 x​y"]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A sentencepiece model that also knows where in a text each id ends.

    ``splices`` says whether encodings may be spliced. That takes byte-pair merging (scores are the whole numbers of
    the merges' ranks), and that each code point of a text is one code point of the pieces,
    after one that stands in front of the text; both are looked up when the model is loaded. Texts of other models are encoded whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        ids = range(self._model.get_piece_size())
        pieces = self._model.id_to_piece(list(ids))
        self._plain = np.array([not (self._model.is_byte(i) or self._model.is_control(i) or self._model.is_unknown(i)) for i in ids])
        # of a character's byte tokens, the first counts as the character
        self._lengths = np.array([(not 0x80 <= int(p[1:-1], 16) < 0xC0) if self._model.is_byte(i) else len(p) for i, p in enumerate(pieces)], np.int64)
        self._shift = len(pieces).bit_length()
        ranked = all(float(self._model.get_score(i)).is_integer() for i in ids)
        self.splices = ranked and all(t == "" or self._model.normalize(t) == "▁" + t.replace(" ", "▁") for t in _PROBES) and all(self.keys(t, 0) is not None for t in _PROBES)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)

    def keys(self, text: str, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(begins, ends, keys) of the text's ids, its first code point being number ``start``. Equal keys: same id at the same
        place; byte tokens have none (-1). None if the lengths don't add up to the text's."""
        ids = np.array(self.ids([text])[0], np.int64)
        lengths = self._lengths[ids]
        if lengths.sum() != (len(text) + 1 if text else 0):
            return None
        ends = start - 1 + np.cumsum(lengths)
        return ends - lengths, ends, np.where(self._plain[ids], (ends << self._shift) | ids, -1)


_models: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """One for each path and process."""
    return _models.get(path) or _models.setdefault(path, PieceModel(path))


_FIRST = "uid bigint, doc_id bigint, n_bytes bigint, n_tokens bigint, chunk int, last int, start bigint, text string"
_ENCODED = "uid bigint, chunk int, upto int, last int, n bigint, head array<bigint>, tail array<bigint>"


def _first(docs: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """A row with n_tokens for each text of at most ``size`` code points; for longer ones a row for each chunk, with its text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkvigil.llm import token_counts  # the module of this process, not a copy sent with the task

        own = token_counts.model_at(path)
        names = [c.split()[0] for c in _FIRST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        for batch in (part for whole in batches for part in slices(whole, 2)):
            texts = pc.fill_null(batch.column(2), "")
            sizes = pc.binary_length(texts).to_pylist()
            huge = pc.greater(pc.utf8_length(texts), size).to_pylist() if own.splices else [False] * len(texts)
            texts = texts.to_pylist()
            heads = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes, strict=True))
            short = [i for i, h in enumerate(huge) if not h]
            if short:
                yield rows([(*heads[i], len(ids), 0, 0, 0, None) for i, ids in zip(short, own.ids([texts[i] for i in short]), strict=True)])
            for i in (i for i, h in enumerate(huge) if h):
                starts = range(0, len(texts[i]) - overlap, size - overlap)
                for lo in range(0, len(starts), 64):
                    yield rows([(*heads[i], None, k, len(starts) - 1, starts[k], texts[i][starts[k] : starts[k] + size]) for k in range(lo, min(lo + 64, len(starts)))])

    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(each, _FIRST)


def _encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """Of each chunk the number of its tokens and the keys of those within the overlaps: from its start (head) and up to its end (tail)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkvigil.llm import token_counts

        own = token_counts.model_at(path)
        for batch in (part for whole in batches for part in slices(whole, 5)):
            n, heads, tails = [], [], []
            for start, text in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                found = own.keys(text, start)
                if found is None:  # nothing to align by: the chunk will be joined to its neighbours
                    n.append(len(own.ids([text])[0]))
                    heads.append([])
                    tails.append([])
                    continue
                begins, ends, keys = found
                n.append(len(keys))
                heads.append(keys[ends <= start + overlap])
                tail = keys[begins >= start + len(text) - overlap]
                tails.append(np.where(tail < 0, -2, tail))  # a byte token equals none of the other side
            lists = pa.list_(pa.int64())
            columns = [*(batch.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(heads, lists), pa.array(tails, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ENCODED.split(", ")])

    return chunks.select("uid", "chunk", "upto", "last", "start", "text").mapInArrow(each, _ENCODED)


def _seams(encoded: DataFrame) -> DataFrame:
    """(uid, seam, over): for each two neighbouring chunks, ``seam`` being the last number of the left one, the tokens that
    their counts have too many; null if no token is common to both."""
    left = encoded.where("upto < last").select("uid", F.col("upto").alias("seam"), "tail", F.lit(None).cast("array<bigint>").alias("head"))
    right = encoded.where("chunk > 0").select("uid", (F.col("chunk") - 1).alias("seam"), F.lit(None).cast("array<bigint>").alias("tail"), "head")
    both = left.unionByName(right).groupBy("uid", "seam").agg(F.max("tail").alias("tail"), F.max("head").alias("head"))  # two rows a group
    common = F.get(F.array_intersect("tail", "head"), F.lit(0))
    both = both.withColumn("common", common)
    return both.select("uid", "seam", (F.size("tail") - F.array_position("tail", F.col("common")) + F.array_position("head", F.col("common"))).alias("over"))


def _joined(chunks: DataFrame, apart: DataFrame, overlap: int) -> DataFrame:
    """The chunks of which no seam lies in ``apart`` (uid, seam) drop out; of the others, those in a row become one."""
    texts = apart.select("uid").distinct()
    own = chunks.join(texts, "uid", "left_semi")
    before = own.select("uid", "chunk").join(apart.select("uid", (F.col("seam") + 1).alias("chunk"), F.lit(1).alias("goes_on")), ["uid", "chunk"], "left")
    order = Window.partitionBy("uid").orderBy("chunk")
    runs = before.select("uid", "chunk", F.sum(F.when(F.col("goes_on").isNull(), 1).otherwise(0)).over(order).alias("run"))
    met = own.join(runs, ["uid", "chunk"]).groupBy("uid", "run", "last").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "upto", "start", "text"))).alias("all"))
    rest = F.transform("all", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substr(x["text"], F.lit(overlap + 1))))
    return met.where("size(all) > 1").select("uid", F.col("all")[0]["chunk"].alias("chunk"), F.element_at("all", -1)["upto"].alias("upto"), "last", F.col("all")[0]["start"].alias("start"), F.array_join(rest, "").alias("text"))


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096, size: int = 16384, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``, as the model's library counts its whole text.

    A null text is empty; rows that repeat and rows without an id are rows of their own. Only doc_id and text are read.

    Texts of more than ``size`` code points are encoded in chunks of that size, each of which overlaps the next by ``overlap``.
    Two chunks are spliced behind the first token that both have at the same place. That gives the tokens of the whole text, for
    this reason: merging takes the best pair first, the leftmost of equals. A sequence of tokens is the encoding of its text
    just when each two neighbours are the encoding of theirs: the first merge to cross a
    border would be the best one of the two tokens alone too. Before the splice all neighbours are so in the left chunk, behind it
    in the right one, and the two at the splice are neighbours in the right chunk, which has the common token too. Where an overlap has no common
    token (a long run of one character, say), it is widened to the whole chunk: the chunks on either side become one,
    and this goes on until all are spliced, at worst with the whole text in one.
    """
    if size < 2 * overlap or overlap < 1:
        raise ValueError("a chunk must be at least two overlaps long")
    path = model or default_model()
    first = cut(_first(docs, path, size, overlap), "counted")
    chunks = first.where("n_tokens IS NULL").select("uid", "chunk", F.col("chunk").alias("upto"), "last", "start", "text")
    spread = chunks.repartition("uid", "chunk")  # the chunks of one text to many tasks
    encoded = cut(_encoded(spread, path, overlap), "encoded")
    while True:
        seams = cut(_seams(encoded), "seams")
        apart = seams.where("over IS NULL").select("uid", "seam")
        if apart.isEmpty():
            break
        wider = cut(_joined(chunks, apart, overlap), "wider")
        kept = chunks.join(wider.select("uid", F.explode(F.sequence("chunk", "upto")).alias("chunk")), ["uid", "chunk"], "left_anti")
        stay = encoded.join(wider.select("uid", F.explode(F.sequence("chunk", "upto")).alias("chunk")), ["uid", "chunk"], "left_anti")
        chunks = cut(kept.unionByName(wider), "chunks")
        encoded = cut(stay.unionByName(_encoded(wider, path, overlap)), "encoded")
    parts = encoded.select("uid", "n").unionByName(seams.select("uid", (-F.col("over")).alias("n")))
    totals = parts.groupBy("uid").agg(F.sum("n").alias("total"))
    whole = first.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens")
    spliced = first.where("n_tokens IS NULL AND chunk = 0").select("uid", "doc_id", "n_bytes").join(totals, "uid").select("doc_id", "n_bytes", F.col("total").alias("n_tokens"))
    return whole.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
