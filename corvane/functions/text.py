"""Text expressions: tokens, n-grams, normal forms and short excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: References in brackets; the sign at the start of a heading or a list line.
REFERENCE, MARKER = r"\[\d+(?:,\s*\d+)*\]", r"^(#{1,6}\s+|[•\-*]\s+)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]{2,}"), 0)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a space; none if there are fewer words."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def normalized(text: Column) -> Column:
    """Lower case, one letter for a pair that is often confused, one space for white space, no footnote marks."""
    plain = F.translate(F.lower(text), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\[\d+\]|<\d+>", " "), r"\s+", " "))


def excerpt(text: Column, most: int = 220) -> Column:
    """One line without table rows, references, bold, code and italic marks, headings' and bullets' signs, of at most
    ``most`` characters, the last an ellipsis where it was cut. An underscore inside a word stays."""

    def line(x: Column) -> Column:
        x = F.replace(F.replace(F.regexp_replace(x, REFERENCE, ""), F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))
        x = F.regexp_replace(x, r"(?<![\p{L}\p{N}_])_(.+?)_(?![\p{L}\p{N}_])", "$1")
        return F.regexp_replace(x, MARKER, "")

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~F.startswith(x, F.lit("|")))
    plain = F.trim(F.regexp_replace(F.array_join(F.transform(lines, line), " "), r"\s+", " "))
    plain = F.regexp_replace(plain, r"\s+([.,;:])", "$1")
    return F.when(F.char_length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…")))


def grouped_digits(number: Column) -> Column:
    """A whole number with a space between groups of three digits."""
    return F.translate(F.format_number(number, 0), ",", " ")


def sentences(text: Column) -> Column:
    """Sentences and list lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[.!?;]\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def numbers(text: Column) -> Column:
    """Numbers as they are written, with a point for the decimal comma."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)"), 1), lambda n: F.translate(n, ",", "."))
