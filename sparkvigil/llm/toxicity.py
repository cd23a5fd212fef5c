"""Toxicity: a learned lexicon met through Levenshtein automata, weighed by the window around each match."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, slices
from .learning import SAMPLE, held_out, labelled_sample
from .quality import AdditiveModel, fit

#: Words on either side that weigh a match; documents that a word around matches must have; parts of the sample for cross-fitting.
WINDOW, LEAST_AROUND, FOLDS = 4, 3, 3
_WIDTH = 9
#: Prefixes of these lengths are candidate stems; whole words of any length are candidates.
_STEMS = range(4, 11)
_FUZZY_FROM = 5
_WORD = re.compile(r"\w+")
_OPEN, _CLOSE = "\"“«„", "\"”»“"


class LexiconAutomaton:
    """The Levenshtein automata of all tokens, walked through the trie of the lexicon at once.

    A state is the set of (trie node, errors) that a token's characters may
    have led to, an error being a character too many, too few or wrong; states and moves are
    made when first needed and remembered, within a bound. Terms of fewer than
    ``_FUZZY_FROM`` characters allow no error. A stem (``term*``) matches as soon as it has been read, a word at the token's end.
    """

    def __init__(self, terms: list[str], errors: int = 1):
        self._children: list[dict[str, int]] = [{}]
        self._word: list[str | None] = [None]
        self._stem: list[str | None] = [None]
        self._fuzzy = [False]  # whether any term below allows errors
        for term in terms:
            plain, node = term.rstrip("*"), 0
            path = [0]
            for c in plain:
                if c not in self._children[node]:
                    self._children[node][c] = len(self._children)
                    self._children.append({})
                    self._word.append(None)
                    self._stem.append(None)
                    self._fuzzy.append(False)
                node = self._children[node][c]
                path.append(node)
            (self._stem if term.endswith("*") else self._word)[node] = term
            if len(plain) >= _FUZZY_FROM:
                for p in path:
                    self._fuzzy[p] = True
        self._errors = errors
        self._clear()

    def _clear(self) -> None:
        self._ids: dict[frozenset, int] = {}
        self._states: list[frozenset] = []
        self._moves: list[dict[str, int]] = []
        self._hits: list[dict[str, int]] = []
        self._ends: list[dict[str, int]] = []
        self._start = self._state({(0, 0)})

    def _allowed(self, term: str | None, e: int) -> bool:
        return term is not None and (e == 0 or len(term.rstrip("*")) >= _FUZZY_FROM)

    def _state(self, reached: set[tuple[int, int]]) -> int:
        """The number of a state, closed under characters that the token lacks."""
        least: dict[int, int] = {}
        todo = list(reached)
        while todo:
            node, e = todo.pop()
            if e < least.get(node, self._errors + 1) and (e == 0 or self._fuzzy[node]):
                least[node] = e
                todo += [(child, e + 1) for child in self._children[node].values() if e < self._errors]
        key = frozenset(least.items())
        if key not in self._ids:
            self._ids[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
            self._hits.append({self._stem[n]: e for n, e in key if self._allowed(self._stem[n], e)})
            self._ends.append({self._word[n]: e for n, e in key if self._allowed(self._word[n], e)})
        return self._ids[key]

    def _move(self, state: int, c: str) -> int:
        reached = set()
        for node, e in self._states[state]:
            for label, child in self._children[node].items():
                if label == c:
                    reached.add((child, e))
                elif e < self._errors:
                    reached.add((child, e + 1))
            if e < self._errors:
                reached.add((node, e + 1))
        to = self._moves[state][c] = self._state(reached) if reached else -1
        return to

    def match(self, token: str) -> tuple[str, int] | None:
        """The term with the fewest errors (then the longest, then the first), and its errors."""
        if len(self._states) > 50_000:
            self._clear()
        state, found = self._start, {}
        for c in token:
            to = self._moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            for term, e in self._hits[state].items():
                found[term] = min(e, found.get(term, e))
        else:
            for term, e in self._ends[state].items():
                found[term] = min(e, found.get(term, e))
        if not found:
            return None
        term = min(found, key=lambda t: (found[t], -len(t), t))
        return term, found[term]


@dataclass
class Match:
    key: str
    token: str
    quoted: bool
    around: set[str]


class Finder:
    """Matches of a lexicon in texts; tokens seen before are remembered, within a bound."""

    def __init__(self, terms: list[str], benign: frozenset[str] = frozenset()):
        self._automaton, self._benign = LexiconAutomaton(terms), benign
        self._seen: dict[str, str | None] = {}

    def _key(self, token: str) -> str | None:
        if token not in self._seen:
            if len(self._seen) > 300_000:
                self._seen.clear()
            hit = None if token in self._benign else self._automaton.match(token)
            self._seen[token] = f"{hit[0]}~{hit[1]}" if hit else None
        return self._seen[token]

    def matches(self, text: str) -> list[Match]:
        low = text.lower()
        tokens = _WORD.findall(low)
        keys = {t: k for t in set(tokens) if (k := self._key(t))}
        if not keys:
            return []
        spans = [m.start() for m in _WORD.finditer(low)]
        quoted = _quoted(low)
        out = []
        for i, t in enumerate(tokens):
            if t in keys:
                around = {w for w in tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW] if w not in keys}
                out.append(Match(keys[t], t, any(a < spans[i] < b for a, b in quoted), around))
        return out


def _quoted(text: str) -> list[tuple[int, int]]:
    """Ranges between quotation marks that stand on one line."""
    out, at = [], None
    for m in re.finditer("[\"“”«»„\n]", text):
        c = m[0]
        if c == "\n":
            at = None
        elif at is None:
            at = m.start() if c in _OPEN else None
        else:
            if c in _CLOSE:
                out.append((at, m.start()))
            at = None
    return out


@dataclass
class ToxicityModel:
    terms: list[str]
    benign: frozenset[str] = frozenset()
    prior: float = 0.0
    unmatched: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    contexts: dict[str, float] = field(default_factory=dict)
    quoted: tuple[float, float] = (0.0, 0.0)  # outside, inside quotation marks

    shape: AdditiveModel | None = None

    def features(self, text: str, matches: list[Match]) -> list[float]:
        """Each term counts once, at its most damning place; the window's words and quotation marks shift it. Beside that, how many tokens match outside quotation marks: all, different ones, and those of one term."""
        best: dict[str, float] = {}
        open_ = [m for m in matches if not m.quoted]
        per = Counter(m.key.partition("~")[0] for m in open_)
        for m in matches:
            around = max(-3.0, min(3.0, sum(self.contexts.get(w, 0.0) for w in m.around)))
            value = self.weights.get(m.key, 0.0) + around + self.quoted[m.quoted]
            best[m.key] = max(value, best.get(m.key, -99.0))
        top = sorted(best.values(), reverse=True)
        words = math.log1p(text.count(" ") + text.count("\n"))
        return [top[0] if top else self.unmatched, sum(x for x in top if x > 0), float(len(top)), sum(top) / (1 + words), words, sum(top[:2]), float(len(open_)), float(len({m.token for m in open_})), float(max(per.values(), default=0))]

    def scores(self, texts: list[str], finder: Finder) -> np.ndarray:
        """From the evidence of the terms, in a text of its length, by shapes fitted on the sample."""
        if self.shape is None:
            return np.full(len(texts), 1 / (1 + math.exp(-self.prior)))
        x = np.array([self.features(t, finder.matches(t)) for t in texts], np.float64).reshape(len(texts), _WIDTH)
        return self.shape.score(x)


def _sums(sample: DataFrame, count, *by: str) -> DataFrame:
    """(kind, key, toxic, clean), and ``by``: how many documents of either label have a key, by ``count`` of a text."""

    def each(frames):
        sums: Counter = Counter()
        for pdf in frames:
            for text, y, fold in zip(pdf["text"], pdf["y"], pdf["fold"], strict=True):
                sums.update((int(fold), *x, int(y)) for x in count(text))
                if len(sums) > 1_000_000:
                    yield _frame(sums)
                    sums.clear()
        yield _frame(sums)

    found = sample.mapInPandas(each, "fold int, kind string, key string, toxic bigint, clean bigint")
    return found.groupBy(*by, "kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _frame(sums: Counter) -> pd.DataFrame:
    rows = [(fold, kind, key, n if y else 0, 0 if y else n) for (fold, kind, key, y), n in sums.items()]
    return pd.DataFrame(rows, columns=["fold", "kind", "key", "toxic", "clean"])


def _words(text: str) -> set[tuple[str, str]]:
    return {("word", w) for w in _WORD.findall(text.lower())} | {("all", "")}


def _candidates(benign: frozenset[str]):
    def count(text: str) -> set[tuple[str, str]]:
        words = set(_WORD.findall(text.lower())) - benign
        return {("term", w) for w in words} | {("term", w[:n] + "*") for w in words for n in _STEMS if n <= len(w)} | {("all", "")}

    return count


def benign_words(sample: DataFrame, least: int = 3) -> frozenset[str]:
    """Words of at least ``least`` clean documents which toxic ones hold hardly more often.

    They match no stem and nothing by error, whatever they look like. The sample's size bounds their number.
    """
    counts = cut(_sums(sample, _words), "words")
    base = counts.where("kind = 'all'").first()
    if base is None:
        return frozenset()
    share = max(0.3, 2 * base.toxic / (base.toxic + base.clean))
    usual = counts.where((F.col("kind") == "word") & (F.col("clean") >= least) & (F.col("toxic") <= share * (F.col("toxic") + F.col("clean"))))
    return frozenset(r.key for r in usual.select("key").collect())


def learn_lexicon(sample: DataFrame, benign: frozenset[str] = frozenset(), precision: float = 0.5, evidence: float = 22.0) -> list[str]:
    """Terms that mark toxic documents: words, and stems as ``stem*``, of words that aren't benign.

    A candidate needs a toxic share of ``precision`` among the documents that
    hold it and a log-likelihood ratio of ``evidence`` against the base rate; the sample's size bounds how many
    there are. Of a stem and the longer stems and words that begin with it, the
    strongest stays; of equals, the word, then the longest stem.
    """
    counts = cut(_sums(sample, _candidates(benign)), "terms")
    base = counts.where("kind = 'all'").first()
    if base is None or not base.toxic or not base.clean:
        return []
    share = F.lit(base.toxic / (base.toxic + base.clean))
    n, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    ratio = 2 * (F.col("toxic") * F.log(p / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - share))).otherwise(0.0))
    strong = counts.where((F.col("kind") == "term") & (F.col("toxic") >= precision * n)).withColumn("ratio", ratio).where(F.col("ratio") >= evidence)
    chosen: list[str] = []
    stems, begun = set(), set()  # the chosen stems, and whatever a chosen term begins with
    for r in sorted(strong.select("key", "ratio").collect(), key=lambda r: (-r.ratio, r.key.endswith("*"), -len(r.key), r.key)):
        plain = r.key.rstrip("*")
        starts = {plain[:i] for i in range(len(plain) + 1)}
        if not starts & stems and not (r.key.endswith("*") and plain in begun):
            chosen.append(r.key)
            begun |= starts
            if r.key.endswith("*"):
                stems.add(plain)
    return chosen


def _evidence(finder_of):
    def count(text: str) -> set[tuple[str, str]]:
        matches = finder_of().matches(text)
        out = {("all", ""), ("matched" if matches else "unmatched", "")}
        for m in matches:
            out |= {("match", m.key), ("quoted", str(m.quoted))} | {("around", w) for w in m.around}
        return out

    return count


def _once(make):
    """A function without arguments that makes its value when first called, in each process."""
    held: list = []

    def get():
        if not held:
            held.append(make())
        return held[0]

    return get


def _weighed(terms: list[str], benign: frozenset[str], known: dict[tuple[str, str], tuple[int, int]], smooth: float) -> ToxicityModel:
    """The model but for its shapes, from the counts (toxic, clean) of (kind, key)."""
    toxic, clean = known.get(("all", ""), (0, 0))
    model = ToxicityModel(terms, benign, prior=math.log((toxic + 1) / (clean + 1)))

    def ratio(t: float, c: float) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    model.unmatched = ratio(*known.get(("unmatched", ""), (toxic, clean)))
    model.weights = {key: ratio(*n) for (kind, key), n in known.items() if kind == "match"}
    hit, missed = known.get(("matched", ""), (0, 0))

    def within(t: float, c: float) -> float:
        usual = smooth * (t + c + 1) / (hit + missed + 1)
        return math.log((t + usual) / (hit + smooth)) - math.log((c + usual) / (missed + smooth))

    model.contexts = {key: within(*n) for (kind, key), n in known.items() if kind == "around" and sum(n) >= LEAST_AROUND}
    model.quoted = tuple(within(*known.get(("quoted", str(q)), (0, 0))) for q in (False, True))
    return model


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", limit: int = SAMPLE, smooth: float = 20.0) -> ToxicityModel:
    """Fits on at most ``limit`` labelled documents, which bounds what comes to the driver: counts of terms and of the words around them, and a row of evidence a document.

    The shapes are fitted on evidence weighed without the document's own fold, so that they don't trust weights that have seen their document.
    """
    sample = labelled_sample(docs, labels, column, limit).dropDuplicates(["doc_id"])
    sample = cut(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")), "sample")
    benign = benign_words(sample)
    terms = learn_lexicon(sample, benign)
    finder = _once(lambda: Finder(terms, benign))
    counts = _sums(sample, _evidence(finder), "fold").collect()

    def known(without: int) -> dict[tuple[str, str], tuple[int, int]]:
        out: dict[tuple[str, str], tuple[int, int]] = {}
        for r in counts:
            if r.fold != without:
                t, c = out.get((r.kind, r.key), (0, 0))
                out[r.kind, r.key] = t + r.toxic, c + r.clean
        return out

    model = _weighed(terms, benign, known(-1), smooth)
    toxic, clean = (sum(r[y] for r in counts if r.kind == "all") for y in ("toxic", "clean"))
    if toxic and clean:
        parts = [_weighed(terms, benign, known(fold), smooth) for fold in range(FOLDS)]
        names = [f"f{i}" for i in range(_WIDTH)]

        def each(frames):
            for pdf in frames:
                x = [parts[fold].features(t, finder().matches(t)) for t, fold in zip(pdf["text"], pdf["fold"], strict=True)]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"]} | {n: [r[i] for r in x] for i, n in enumerate(names)})

        rows = sample.mapInPandas(each, "doc_id bigint, y int, " + ", ".join(f"{n} double" for n in names)).toPandas().sort_values("doc_id", ignore_index=True)
        model.shape = fit(rows[names].to_numpy(np.float64), rows["y"].to_numpy(np.float64), cycles=60, pair_cycles=20, pairs=3)
    return model


def scored(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 of each whole text; null texts count as empty."""
    at, finder = docs.columns.index("text"), _once(lambda: Finder(model.terms, model.benign))

    def each(batches):
        for batch in (part for whole in batches for part in slices(whole, at)):
            scores = model.scores([t or "" for t in batch.column(at).to_pylist()], finder())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])

    return docs.mapInArrow(each, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; rows that repeat, null ids and empty texts included."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = scored(ids, train(docs, labels)).drop("text")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
