"""Personal data: exact base patterns, and terms that reveal whom they belong to. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with the same leftmost matches, in a form that Java matches in time and
# stack linear in the text: a match begins where a run of its first characters does (or
# where the last match ended), possessive runs aren't tried again, and the repeated groups are single
# character runs that end where the group would.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){12}[0-9])[0-9][0-9\x20-]*?(?<=[0-9])(?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "phone": "+"}
_TERM = r"[\p{L}\p{N}_]{4,}"
#: Terms, or keys of 16 bytes, that are broadcast at most; more of them are joined by exchange.
SENT = 500_000


_SPANS = "array<struct<s: int, e: int, m: string>>"


def running_sums(x: Column) -> Column:
    """array<int>: the sums of an array's values up to each, in as many passes as its size has bits."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(x), F.lit(2)))).cast("int") - 1)
    doubled = lambda acc, k: F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))
    return F.aggregate(passes, x, doubled)


def _located(text: Column, pattern: Column) -> Column:
    """array<struct<s, e, m>>: the matches with their places, in code points, end exclusive."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        ends = F.transform(F.array(running_sums(F.zip_with(gaps, m, lambda g, x: F.length(g) + F.length(x)))), lambda e: F.zip_with(e, m, lambda e, x: F.struct((e - F.length(x)).alias("s"), e.alias("e"), x.alias("m"))))[0]
        return F.when(F.size(m) == 0, F.expr(f"cast(array() as {_SPANS})")).otherwise(ends)

    return F.transform(F.array(found), placed)[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<s, e, m>> of one base kind in ``text``, which is not null."""
    needed = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
    found = F.filter(_located(text, F.lit(PATTERNS[kind])), lambda x: _valid(kind, x["m"]))
    return F.when(needed, found).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def entities(docs: DataFrame, around: int = 120) -> DataFrame:
    """(hash, entity, term), once each: the terms whole within ``around`` characters of a base match, by hash of the text."""
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).where("text rlike '[0-9@]'")

    def named(kind: str) -> Column:
        return F.transform(base_spans(F.col("text"), kind), lambda x: F.struct(F.lower(F.concat(F.lit(kind + ":"), x["m"])).alias("entity"), x["s"].alias("s"), x["e"].alias("e")))

    each = [named(k) for k in KINDS]
    spans = rows.select(F.xxhash64("text").alias("hash"), "text", F.explode(F.concat(*each)).alias("x")).select("hash", "text", "x.*")
    # a character more on either side: a word that reaches it is cut, and doesn't count
    before = F.expr(f"substring(text, greatest(1, s - {around}), least(s, {around + 1}))")
    before = F.when(F.col("s") > around, F.regexp_replace(before, r"^[\p{L}\p{N}_]+", "")).otherwise(before)
    after = F.expr(f"substring(text, e + 1, {around + 1})")
    after = F.when(F.length(after) > around, F.regexp_replace(after, r"[\p{L}\p{N}_]+\z", "")).otherwise(after)
    near = F.concat_ws("\n", before, after)
    return spans.select("hash", "entity", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(near), F.lit(_TERM), F.lit(0)))).alias("term")).distinct()


def disclosing_terms(docs: DataFrame, bits: float = 3.0, share: float = 0.5, support: int = 2) -> DataFrame:
    """(term, bits): terms which tell more about a protected entity than the thresholds allow.

    An entity is a base match's kind and value. From the whole corpus: n(t, e),
    the different texts in which t stands near e; n(e), those that hold e; n(t),
    those that hold t anywhere; N, all. t discloses log2(n(t, e) N / (n(t) n(e))) bits
    about e. Entities and texts near them are told apart by 64-bit hashes. A term is returned if, for some e, n(t, e) >= support,
    n(t, e) / n(t) >= share and the bits reach ``bits``. Copies of one text count once in each, so
    copying alone neither makes a term disclosing nor hides it.
    """
    near = cut(entities(docs), "near")
    of_entity = near.select("entity", "hash").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = cut(near.groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support).join(of_entity, "entity"), "pairs")
    n_t, n = _texts_of_terms(docs)
    known = pairs.join(n_t, "term")
    known = known.withColumn("bits", F.log2(F.col("n_te") * F.lit(float(n)) / (F.col("n_t") * F.col("n_e"))))
    return known.where((F.col("n_te") >= share * F.col("n_t")) & (F.col("bits") >= bits)).groupBy("term").agg(F.max("bits").alias("bits"))


def _words(rows: DataFrame, *names: str) -> DataFrame:
    """``names`` and term: the different terms of each row's text."""
    return rows.select(*names, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))).alias("term"))


def _sent(few: DataFrame) -> DataFrame:
    """A table that is broadcast if it has up to SENT rows, else merged."""
    return F.broadcast(few) if few.count() <= SENT else few.hint("merge")


def _texts_of_terms(docs: DataFrame) -> tuple[DataFrame, int]:
    """(term, n_t): how many different texts hold each term; and the number of different texts.

    Rows are counted by term before anything is exchanged; from that goes what further copies of a text have added.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    again = cut(copies.where("copies > 1"), "copies")
    n = docs.count() - (again.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    held = rows.join(_sent(again.select("key")), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"), (F.count("*") - 1).alias("more"))
    over = _words(held, "more").groupBy("term").agg(F.sum("more").alias("over"))
    every = _words(rows).groupBy("term").agg(F.count("*").alias("rows"))
    counted = every.join(over, "term", "left")
    return counted.select("term", (F.col("rows") - F.coalesce("over", F.lit(0))).alias("n_t")), n


def find(docs: DataFrame, bits: float = 3.0, share: float = 0.5, support: int = 2) -> DataFrame:
    """doc_id, text and an array of spans for each kind (email, ip, card, phone, term) of each row of ``docs``.

    A null text counts as empty; rows that repeat, and null ids, are kept. Term
    spans may overlap base spans; base spans never change.
    """
    terms = cut(disclosing_terms(docs, bits, share, support), "terms")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    based = rows.select("doc_id", "text", "key", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    # without the text, where the caller doesn't need it, this exchanges ids and spans alone
    met = based.join(_term_spans(rows, terms).hint("merge"), "key", "left")
    return met.select("doc_id", "text", *KINDS, F.coalesce("term", F.expr(f"cast(array() as {_SPANS})")).alias("term"))


def _term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term): the spans of ``terms`` in each different text that holds some. Only such texts are exchanged while their keys are few enough to be sent to all."""
    held = cut(_words(rows, "key").join(_sent(terms), "term").groupBy("key").agg(F.collect_set("term").alias("terms")), "held")
    texts = rows.select("key", "text").join(_sent(held.select("key")), "key", "left_semi")
    met = texts.groupBy("key").agg(F.first("text").alias("text")).join(held.hint("merge"), "key")
    spans = F.filter(_located(F.col("text"), F.lit(_TERM)), lambda x: F.array_contains("terms", F.lower(x["m"])))
    return cut(met.select("key", spans.alias("term")), "spans")


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = F.array_join(F.concat(*[_named(k) for k in KINDS]), ",")
    rows = found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], base.alias("base"), F.array_join(_named("term"), ",").alias("more"))
    joined = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more") != "", F.col("more")))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), joined.alias("spans"))


def sanitised(found: DataFrame) -> DataFrame:
    """(doc_id, text) with base matches generalised to their kind and disclosing terms removed; where spans overlap, the first to begin decides."""

    def replaced(kind: str) -> Column:
        by = F.lit("" if kind == "term" else f"[{kind.upper()}]")
        return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), by.alias("by")))

    spans = F.concat(*[replaced(k) for k in (*KINDS, "term")])

    def step(acc: Column, x: Column) -> Column:
        new = x["s"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), x["by"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(new, piece).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    whole = F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, finish)
    return found.select("doc_id", whole.alias("text"))
