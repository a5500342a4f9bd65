"""Text expressions shared by operators. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width and control characters that show nothing.
HIDDEN = r"[\p{Cf}\p{Cc}]+"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def visible(text: Column) -> Column:
    """The text with hidden characters and every kind of white space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Cf}\p{Cc}\p{Z}\s]+", " "))


def is_blank(text: Column) -> Column:
    """True for null and for texts in which nothing can be seen."""
    return ~F.coalesce(text.rlike(r"[^\p{Cf}\p{Cc}\p{Z}\s]"), F.lit(False))


def folded(text: Column) -> Column:
    """Lower case, full-width ASCII as plain ASCII, hidden characters as blanks; plain texts are only lowered."""
    odd = text.rlike(r"[\p{Cf}\p{Cc}\uFF01-\uFF5E]")
    return F.lower(F.when(odd, F.translate(F.regexp_replace(text, HIDDEN, " "), _WIDE, _NARROW)).otherwise(text))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words_and_numbers(text: Column) -> Column:
    """Like words(), but a decimal number is one token written without needless zeros."""
    tokens = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)+|[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.when(t.rlike(r"^[0-9]+\.[0-9]+$"), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t))


def flat(text: Column) -> Column:
    """words_and_numbers() joined by blanks; a text without decimal numbers takes one replacement only."""
    plain = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.when(text.rlike(r"[0-9]\.[0-9]"), F.array_join(words_and_numbers(text), " ")).otherwise(plain)
