"""Best-fit packing of documents into fixed-length token sequences, certified by lower bounds."""

from __future__ import annotations

import os
import zlib
from array import array
from itertools import count, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: A run of plain letters, then of plain marks: each is one word to the tokenizer, whatever stands around it.
_PLAIN = r"\A(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[.,;:!?*#%&$|]*)\z"
_PROBES = ["The the,\tété É é ́x ΣΑΣ İ\n it's IT'S 12345 a.b@c-d\r\n...!! x ", " Word WORD word; ÿes Éa\x0b\x0cb|  日本語 😀 \x1c \xa0", "aßb ﬁ <|endoftext|> under_score", ""]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists in one array, and their lengths."""
    return np.fromiter((i for each in ids for i in each), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


class WordTokenizer:
    """A tokenizer's ids of many texts at once.

    Where a text's ids are those of its runs between white space, one run after the other, without regard to
    the case of plain letters, each different run of a call is taken once, and plain words that aren't remembered are encoded
    together, told apart by the tokens that end a word. At most KEPT words are remembered, those met of late.
    A check against the tokenizer itself decides that when it is loaded; other tokenizers get whole texts.
    """

    KEPT = 800_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._known, self._ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self._lengths, self._met, self._call = np.zeros(0, np.int32), np.zeros(0, np.int32), 0
        probes = [_PROBES[0] * 2, *_PROBES]
        ids, offsets = self._by_runs(pa.array(probes))
        self.by_runs = all(ids[a:b].tolist() == own for (a, b), own in zip(pairwise(offsets), self._own(probes), strict=True))

    def _own(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of plain words, encoded as one text; one by one should that not give them all back."""
        ids = np.array(self._own([" ".join(words)])[0], np.uint32)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words) or (len(ids) and ends[-1] != len(ids)):
            return _flat(self._own(words))
        return ids, np.diff(ends, prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of different plain words."""
        self._call += 1
        at = pc.fill_null(pc.index_in(words, self._known), -1).to_numpy(zero_copy_only=False).copy()
        new = words.filter(pa.array(at < 0))
        ids, lengths = self._fresh(new.to_pylist())
        at[at < 0] = len(self._known) + np.arange(len(new))
        self._known, self._ids = pa.concat_arrays([self._known, new]), np.concatenate([self._ids, ids])
        self._lengths = np.concatenate([self._lengths, lengths.astype(np.int32)])
        self._met = np.concatenate([self._met, np.zeros(len(new), np.int32)])
        self._met[at] = self._call
        starts = np.cumsum(self._lengths) - self._lengths
        out = self._ids[_ranges(starts[at], self._lengths[at])], self._lengths[at]
        if len(self._known) > self.KEPT:
            stay = np.sort(np.argsort(self._met, kind="stable")[-self.KEPT // 2 :])
            self._known, self._ids = self._known.take(pa.array(stay)), self._ids[_ranges(starts[stay], self._lengths[stay])]
            self._lengths, self._met = self._lengths[stay], self._met[stay]
        return out

    def _by_runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        runs = coded.dictionary
        parts = pc.extract_regex(runs, _PLAIN)
        plain = parts.is_valid()
        letters = pc.utf8_lower(pc.struct_field(parts, "letters").filter(plain)).dictionary_encode()
        marks = pc.struct_field(parts, "marks").filter(plain).dictionary_encode()
        other = runs.filter(pc.invert(plain)).to_pylist()
        # the encoded parts: plain words, marks, other runs, and one that is empty
        words = self._words(letters.dictionary)
        rest = _flat([*self._own([*marks.dictionary.to_pylist(), *other]), []])
        flat, lengths = np.concatenate([words[0], rest[0]]), np.concatenate([words[1], rest[1]]).astype(np.int32)
        starts = np.cumsum(lengths) - lengths
        at = plain.to_numpy(zero_copy_only=False)
        pair = np.full((len(runs), 2), len(lengths) - 1)
        pair[at, 0], pair[at, 1] = letters.indices.to_numpy(), len(letters.dictionary) + marks.indices.to_numpy()
        pair[~at, 0] = len(letters.dictionary) + len(marks.dictionary) + np.arange(len(other))
        # from parts to runs, from runs to texts
        flat = flat[_ranges(starts[pair.ravel()], lengths[pair.ravel()])]
        lengths = lengths[pair[:, 0]] + lengths[pair[:, 1]]
        starts = np.cumsum(lengths) - lengths
        index = coded.indices.to_numpy()
        each = lengths[index]
        until = np.concatenate([[0], np.cumsum(each)])
        return flat[_ranges(starts[index], each)], until[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i] : offsets[i + 1]]. Null texts are empty."""
        texts = pc.fill_null(texts, "")
        if self.by_runs:
            return self._by_runs(texts)
        ids, lengths = _flat(self._own(texts.to_pylist()))
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit words."""
        ids, offsets = self.encoded(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in pairwise(offsets.tolist())]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One for each path and process."""
    return _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: uid, doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its ids, then ``end_id``; a null or empty text is ``end_id``
    alone. Longer ones are cut into pieces of ``length`` ids; the last may be
    shorter. Repeated rows and null ids are documents of their own.
    """
    path = tokenizer or default_tokenizer()

    def each(batches):
        from sparkvigil.llm import packing  # the module of this process, not a copy sent with the task

        own = packing.tokenizer_at(path)
        end = array("I", [end_id]).tobytes()
        for batch in (part for whole in batches for part in slices(whole, 1, 6 << 20)):
            ids, offsets = own.encoded(batch.column(1))
            rows: list[tuple] = []
            for doc, (a, b) in zip(batch.column(0).to_pylist(), pairwise(offsets.tolist()), strict=True):
                data = ids[a:b].tobytes() + end
                for k, s in enumerate(range(0, len(data), 4 * length)):
                    cutting = data[s : s + 4 * length]
                    rows.append((doc, k, s // 4, len(cutting) // 4, zlib.crc32(cutting), cutting))
            doc, k, s, n, crc, data = zip(*rows, strict=True)
            cols = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in data], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(each, schema)
    return found.withColumn("uid", F.monotonically_increasing_id())


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of the size bound and two families of dual feasible functions.

    u_k(x) = x where (k + 1) x / C is whole, else floor((k + 1) x / C) C / k; and
    U_e(x) = C above C - e, 0 below e, else x. Both keep the sum of any set that
    fits within C, so the sum over all items divided by C bounds the bins.
    """
    sizes, counts = np.unique(lengths.astype(np.int64), return_counts=True)
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 21):
        whole, part = np.divmod((k + 1) * sizes, capacity)
        value = np.where(part == 0, k * sizes, whole * capacity)  # times k
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    cum_count, cum_size = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sizes * counts)])
    for e in sizes[(sizes <= capacity // 2)]:
        lo, hi = np.searchsorted(sizes, e), np.searchsorted(sizes, capacity - e, "right")
        total = int(cum_size[hi] - cum_size[lo]) + capacity * int(cum_count[-1] - cum_count[hi])
        best = max(best, -(-total // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each to the fullest bin that has room. Ties go by place."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_gap: dict[int, list[int]] = {}
    gaps, used = 0, 0  # the set bits of gaps are the gaps that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            held = by_gap[gap]
            b = held.pop()
            if not held:
                gaps ^= 1 << gap
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if left := gap - size:
            by_gap.setdefault(left, []).append(b)
            gaps |= 1 << left
    return bins, offsets


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values("uid", ignore_index=True)
    lengths = pdf["length"].to_numpy()
    bins, offsets = best_fit_decreasing(lengths, capacity)
    used = int(bins.max()) + 1
    lead = np.empty(used, np.int64)
    lead[bins[offsets == 0]] = pdf["uid"].to_numpy()[offsets == 0]
    fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
    return pdf.drop(columns="part").assign(sequence_id=lead[bins], offset=offsets, fill=fill[bins], certified=used <= lower_bound(lengths, capacity))


def pack(found: DataFrame, length: int = 4096, per_part: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id (the uid of the sequence's first piece) and offset.

    Whole pieces are sequences of their own. The rest are dealt to parts of
    about ``per_part`` pieces, by hash; each part runs best-fit decreasing and
    compares its sequences with its lower bound. Parts whose count isn't
    certified give up the pieces of their sequences with gaps, all parts those
    of sequences that are less than 63/64 full; these pieces are dealt anew, so that
    parts exchange documents, and packed again, until a round saves no sequence.
    """
    found = cut(found, "pieces")
    names = [c for c in found.columns if c != "ids"]
    rest = found.where(F.col("length") < length).select(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id bigint, offset bigint, fill bigint, certified boolean"

    def run(pool: DataFrame, number: int, at: int) -> DataFrame:
        parts = max(1, -(-number // per_part))
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(at)), F.lit(parts)))
        return cut(dealt.groupBy("part").applyInPandas(lambda pdf: _pack_group(pdf, length), schema), "packed")

    def bins(df: DataFrame) -> int:
        return df.where("offset = 0").count()

    placed: list[DataFrame] = []
    now = run(rest, rest.count(), 0)
    for at in count(1):
        loose = (~F.col("certified") & (F.col("fill") < length)) | (F.col("fill") < length - length // 64)
        pool = now.where(loose)
        before = bins(pool)
        if before < 2:
            break
        again = run(pool.select(*names), pool.count(), at)
        if bins(again) >= before:
            break
        placed.append(now.where(~loose))
        now = again
    out = found.where(F.col("length") >= length).select(*names, F.col("uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    for df in [*placed, now]:
        out = out.unionByName(df.select(*names, "sequence_id", "offset"))
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    packed = pack(pieces(docs, tokenizer, length, end_id), length)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
