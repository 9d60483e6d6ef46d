"""Search text: cleaning, profiles, and what follows from a profile.  Plain functions, for one query on the driver, and
column expressions for a table of queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as tx

# Words that a full-text query drops, and operators it reserves.
STOP_WORDS = """a an the and or but in on at to for of with by from as is was are be been being have has had do does did will
would could should may might can this that these those""".split()
RESERVED = "and or not near column columns".split()
# What marks a comparison.
COMPARISONS = (" and ", " vs ", " versus ", " compared ", " between ", " difference ")


@dataclass(frozen=True)
class TextQuery:
    """Terms, and whether all of them must match."""

    terms: tuple[str, ...]
    every: bool = False

    @property
    def sanitised(self) -> str:
        return (" AND " if self.every else " OR " if len(self.terms) > 3 else " ").join(self.terms)


def sanitise(query: str) -> TextQuery:
    """Up to six usable words match alternatively; of seven or more, the four longest must all match."""
    plain = re.sub("[\"“”‘’]", "", query)
    kept = []
    for token in re.sub(r"[\^(),+~]", " ", plain).split():
        if token.lower() in RESERVED:
            continue
        token = token[1:] if len(token) > 1 and token[0] == "-" else token
        if token.lower() not in STOP_WORDS:
            kept.append(token)
    if len(kept) < 7:
        return TextQuery(tuple(kept))
    return TextQuery(tuple(sorted(kept, key=lambda t: (-len(t.encode()), t))[:4]), every=True)


def index_terms(text: str) -> list[str]:
    """Words as the full-text index has them."""
    return [w for w in re.split(r"[^0-9a-zÀ-ɏ]+", text.lower()) if w]


def profile_columns(query: Column) -> dict[str, Column]:
    """``char_count, word_count, has_comparison, complexity`` of each query of a table."""
    low, chars = F.lower(query), F.char_length(query)
    cjk, words = tx.cjk_count(query), tx.whitespace_words(query)
    n = F.when(cjk > F.floor(chars / 2), words + F.floor(cjk / 3)).otherwise(words)
    compares = F.lit(False)
    for mark in COMPARISONS:
        compares = compares | low.contains(mark)
    simple = (n <= 4) & ~compares & (chars < 60)
    complex_ = (n > 14) | (compares & (n > 6)) | (chars > 300)
    kind = F.when(simple, "simple").when(complex_, "complex").otherwise("normal")
    return {"char_count": chars, "word_count": n.cast("long"), "has_comparison": compares, "complexity": kind}


def recommended_k(complexity: Column, k: int) -> Column:
    return F.when(complexity == "simple", max(k // 2, 2)).when(complexity == "complex", min(2 * k, 32)).otherwise(k)


def semantic_weight(complexity: Column, word_count: Column) -> Column:
    """The semantic leg's share in a hybrid search."""
    return F.when((complexity == "simple") & (word_count <= 2), 0.85).when(complexity == "simple", 0.6).when(complexity == "complex", 0.3).otherwise(0.5)


@dataclass(frozen=True)
class Profile:
    """A query's shape, as ``profile_columns`` has it, for one query."""

    word_count: int
    complexity: str

    @classmethod
    def of(cls, query: str) -> Profile:
        cjk = len(re.findall(tx.CJK.replace(r"\x{2", r"\U0002").replace(r"\x{", "\\u").replace("}", ""), query)) if not query.isascii() else 0
        n = len(query.split()) + (cjk // 3 if cjk > len(query) // 2 else 0)
        compares = any(mark in query.lower() for mark in COMPARISONS)
        if n <= 4 and not compares and len(query) < 60:
            return cls(n, "simple")
        return cls(n, "complex" if n > 14 or compares and n > 6 or len(query) > 300 else "normal")

    @property
    def weight(self) -> float:
        return {"simple": 0.85 if self.word_count <= 2 else 0.6, "complex": 0.3, "normal": 0.5}[self.complexity]

    @property
    def enhanced(self) -> bool:
        return self.complexity != "simple"

    def top_k(self, k: int) -> int:
        return {"simple": max(k // 2, 2), "complex": min(2 * k, 32), "normal": k}[self.complexity]
