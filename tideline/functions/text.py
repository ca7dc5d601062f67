"""Review texts: length, hash, excerpts and reference marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CONTENT_LENGTH = 20
EXCERPT_CHARS = 150

# fixed values: one bracketed list of review numbers, [1] or [1, 5]
REFERENCE = r"\[\d+(?:\s*,\s*\d+)*\]"
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed_length(text: Column) -> Column:
    """Characters left after removing blanks (only blanks) at both ends; null counts as empty."""
    return F.char_length(F.trim(F.coalesce(text, F.lit(""))))


def is_content(text: Column, min_length: int = MIN_CONTENT_LENGTH) -> Column:
    return trimmed_length(text) >= min_length


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def strip_all(text: Column) -> Column:
    """Without whitespace at both ends; reads the ends only."""
    return F.btrim(text, F.lit(BLANKS))


def has_text(text: Column) -> Column:
    """Whether ``strip_all`` leaves anything."""
    return F.ltrim(text, F.lit(BLANKS)) != ""


def fold_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def excerpt_text(text: Column, limit: int = EXCERPT_CHARS) -> Column:
    """At most ``limit`` characters, cut before a word, with an ellipsis when cut."""
    flat = fold_whitespace(F.replace(text, F.lit("…"), F.lit(" ")))
    head = F.left(flat, F.lit(limit - 1))
    whole_words = F.regexp_replace(head, r" [^ ]*$", "")
    cut = F.concat(F.regexp_replace(whole_words, r"[ ,.;:\-]+$", ""), F.lit("…"))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(cut)


def strip_references(text: Column) -> Column:
    """Text for display: bracketed review numbers removed."""
    return strip_all(F.regexp_replace(text, r"(?U)\s*" + REFERENCE, ""))
