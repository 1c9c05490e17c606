"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import vocab

_WORD = r"[\p{L}\p{N}_]"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def split_a(text: Column) -> Column:
    """Sentences split at white space behind . ! ? (terminators kept)."""
    return _kept(F.split(F.trim(text), r"(?<=[.!?])\s+"))


def split_b(text: Column, longer_than: int = 20) -> Column:
    """Parts between runs of . ! ? that are longer than ``longer_than`` characters."""
    return F.filter(F.transform(F.split(F.trim(text), r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def split_d(text: Column) -> Column:
    """Sentences without terminators; stops of a few abbreviations don't end one."""
    kept = F.regexp_replace(text, r"\b(Dr|Prof|Fig|Table|Eq|et al)\.", "$1\u0001")
    return F.filter(F.transform(F.split(kept, r"[.!?]+\s+"), lambda s: F.trim(F.translate(s, "\u0001", "."))), lambda s: s != "")


def query_tokens(text: Column, stopwords: list[str]) -> Column:
    """Lower-case tokens of letters, digits and hyphens without stop words; [] for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-zA-ZÀ-ÿ0-9\-]+")
    stops = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.filter(parts, lambda t: (t != "") & ~F.array_contains(stops, t))


def word_tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD}{{2,}})"), F.lit(1))


def words(text: Column) -> Column:
    """White-space separated words, none for an empty text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def share_of(text: Column, char_class: str) -> Column:
    """Share of the characters that match a class; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, char_class, ""))) / n).otherwise(F.lit(0.0))


def clean_scientific(text: Column) -> Column:
    """Body text: cut at a bare references line, without citations and without table, figure and formula lines."""
    body = F.split(text, vocab.REFERENCES_LINE).getItem(0)
    body = F.regexp_replace(body, vocab.CITATION_NUMBERS, "")
    body = F.regexp_replace(body, vocab.CITATION_NAMES, "")

    def keep(line: Column) -> Column:
        s = F.trim(line)
        formula = F.length(F.regexp_replace(s, r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length(s), F.lit(1)) > 0.4
        return (s != "") & ~s.rlike(vocab.TABLE_LINE) & ~s.rlike(vocab.FIGURE_LINE) & ~formula

    return F.array_join(F.filter(F.split(body, "\n"), keep), "\n")


def clean_for_detection(text: Column) -> Column:
    """Text without URLs, mail addresses and marks, white space collapsed."""
    t = F.regexp_replace(text, r"https?://\S+|www\.\S+", "")
    t = F.regexp_replace(t, r"\S+@\S+", "")
    return collapse(F.regexp_replace(t, r"[^\p{L}\p{N}_\s'\-]", " "))


def contains_count(text: Column, terms: list[str]) -> Column:
    """How many of ``terms`` occur in the text as substrings."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)))


def weight_sum(text: Column, weights: list[tuple[str, int]]) -> Column:
    """Sum of the weights of all terms that occur in the text as substrings.

    A fold over a constant array: a chain of CASE expressions as long as the list would
    exceed what the JVM compiles.
    """
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in weights])
    return F.aggregate(table, F.lit(0), lambda acc, x: acc + F.when(F.contains(text, x["t"]), x["w"]).otherwise(F.lit(0)))


def pattern_count(text: Column, patterns: list[str]) -> Column:
    """Sum of the numbers of matches of all patterns."""
    out = F.regexp_count(text, F.lit(patterns[0])) if patterns else F.lit(0)
    for p in patterns[1:]:
        out = out + F.regexp_count(text, F.lit(p))
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
