"""Control plane: which line patterns are safe, and which are good enough."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST, ALTERNATIVES = 1000, 25
CATCH_ALL = (r"^.*$", r"^.+$", r"^.*", r"^.+", r"^\S+", r"^\s*\S+", r"^")


def alternatives(pattern: str) -> int:
    """Alternatives outside any group or class: what is left of the bars when escapes, classes and groups, innermost first, are erased."""
    left = re.sub(r"\[\^?\]?[^\]]*\]", "", re.sub(r"\\.", "", pattern, flags=re.S))
    while (less := re.sub(r"\([^()]*\)", "", left)) != left:
        left = less
    return left.count("|") + 1


def _matches_anything(pattern: str) -> bool:
    return pattern in CATCH_ALL or all(re.match(pattern, text) for text in ("zz qq", "{1}"))


def _compiles(pattern: str) -> bool:
    try:
        return re.compile(pattern) is not None
    except re.error:
        return False


#: What a pattern must not be, by code, most telling first.
FAULTS = {
    "empty": lambda p: not p.strip(),
    "does_not_compile": lambda p: not _compiles(p),
    "unanchored": lambda p: p[:1] != "^",
    "too_many_alternatives": lambda p: alternatives(p) > ALTERNATIVES,
    "catch_all": lambda p: _compiles(p) and _matches_anything(p),
    "too_long": lambda p: len(p) > LONGEST,
}


def faults(pattern: str) -> list[str]:
    """All that speaks against a pattern deciding boundaries."""
    return [code for code, holds in FAULTS.items() if holds(pattern or "")]


def unsafe(pattern: str) -> str | None:
    """The most telling fault of a pattern, or None."""
    return next(iter(faults(pattern)), None)


def shape(token: Column) -> Column:
    """A token's shape: runs of digits as 9, of letters as a; marks stay."""
    return F.regexp_replace(F.regexp_replace(token, r"(?U)[^\W\d_]+", "a"), r"\d+", "9")


def signature(line: Column, tokens: int = 8) -> Column:
    """A format's signature: a hash of the shapes of a header's first tokens."""
    first = F.slice(F.filter(F.split(line, r"\s+"), lambda t: t != ""), 1, tokens)
    return F.substring(F.sha2(F.array_join(F.transform(first, shape), " "), 256), 1, 24)


def similarity(a: Column, b: Column, tokens: int = 8) -> Column:
    """Share of the first tokens whose shapes agree."""
    cut = lambda x: F.transform(F.slice(F.filter(F.split(x, r"\s+"), lambda t: t != ""), 1, tokens), shape)
    same = F.size(F.filter(F.zip_with(cut(a), cut(b), lambda x, y: x == y), lambda x: x))
    return F.coalesce(same, F.lit(0)) / F.greatest(F.size(cut(a)), F.size(cut(b)), F.lit(1))
