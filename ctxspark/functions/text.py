"""Text primitives as Columns. Case folding is ASCII only; lengths of tokens and spans are bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"

#: Words that a topic slug leaves out, and words of a query that don't count.
SLUG_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "inside", "is", "it", "of", "on", "or", "should", "that", "the", "this", "to", "use", "using", "we", "with", "also", "says", "measured")
QUERY_STOP = ("and", "are", "can", "for", "find", "from", "how", "near", "the", "this", "that", "with", "you")


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def clean(c: Column) -> Column:
    """Trimmed, cut before " but " or else " because ", without punctuation at the end, trimmed again."""
    c = trim(c)
    low = lower(c)
    but, because = F.instr(low, " but "), F.instr(low, " because ")
    at = F.when(but > 0, but).when(because > 0, because)
    cut = F.when(at.isNotNull(), F.substring(c, F.lit(1), at - 1)).otherwise(c)
    return trim(F.rtrim(cut, F.lit(".!?,;")))


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def contains_word(c: Column, *words: str) -> Column:
    """A word stands between characters other than ASCII letters, digits and underscores."""
    return F.regexp_like(c, F.lit(f"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def slug(c: Column) -> Column:
    """The first four tokens of three letters or more that are no stop words, or "general"."""
    kept = F.slice(F.filter(tokens(c), lambda t: (F.length(t) >= 3) & ~t.isin(*SLUG_STOP)), 1, 4)
    return F.when(F.size(kept) > 0, F.array_join(kept, "_")).otherwise("general")


def token_cost(c: Column) -> Column:
    """One token for every four bytes begun, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(c) / 4)).cast("bigint")


def overlap(value: Column, query: Column) -> Column:
    """20 for each token of the query, of three letters or more and no stop word, that the value contains; 80 at most."""
    own = lower(value)
    hits = F.filter(tokens(query), lambda t: (F.length(t) >= 3) & ~t.isin(*QUERY_STOP) & F.contains(own, t))
    return F.least(F.lit(80), 20 * F.size(hits))
