"""String and array column functions for corpus text, all built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delimiters that act as the schema inside strings.
RAW_SYNONYM_SEP = "᛫"      # raw synonym separator in the source corpus
SYNONYM_SEP = "|"               # synonyms of one entry
UNIT_GLUE = " # "               # units of a decomposition
SIGN_GLUE = " | "               # per-sign symbol strings of a sentence
UNKNOWN = "<unk>"               # unit of a sign with no vocabulary entry

# White space as Python's str.split and str.strip see it: the Unicode property and 0x1C-0x1F.
SPACE = r"[\s\x1C-\x1F]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading/trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(_col(c), rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def lower_strip(c: Column | str) -> Column:
    return strip(F.lower(_col(c)))


def replace_separator(c: Column | str, old: str = RAW_SYNONYM_SEP, new: str = SYNONYM_SEP) -> Column:
    """Replace a one-character separator; a null value becomes the empty string."""
    return F.coalesce(F.translate(_col(c), old, new), F.lit(""))


def first_segment(c: Column | str, sep: str = RAW_SYNONYM_SEP) -> Column:
    """Text before the first ``sep``; null becomes the empty string."""
    return F.coalesce(F.substring_index(_col(c), sep, 1), F.lit(""))


def collapse_newlines(c: Column | str) -> Column:
    """Runs of CR/LF become one space; null stays null."""
    return F.regexp_replace(_col(c).cast("string"), r"[\r\n]+", " ")


def whitespace_tokens(c: Column | str) -> Column:
    """``str.split()``: tokens between whitespace runs, no empty tokens."""
    return F.array_remove(F.split(_col(c), rf"(?U){SPACE}+"), "")


def count_substring(c: Column | str, needle: str = UNKNOWN) -> Column:
    """Occurrences of a literal substring (non-overlapping)."""
    s = _col(c)
    return ((F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) /
            F.lit(len(needle))).cast("bigint")


def split_units(c: Column | str, sep: str = "#") -> Column:
    """Answer text -> units, split on ``#``; units keep their outer spaces."""
    return F.split(_col(c), re.escape(sep))


def first_two_distinct(words: Column | str) -> Column:
    """Canonical form from a word list: the first two distinct lower-cased, stripped words
    joined by ``|`` (one word when only one is distinct)."""
    norm = F.array_distinct(F.transform(_col(words), lower_strip))
    return F.array_join(F.slice(norm, 1, 2), SYNONYM_SEP)


def repetition_flag(units: Column, threshold: float = 0.2) -> Column:
    """True when the stripped units repeat too much (distinct < threshold * total) or
    contain the unknown marker; an empty list is never repetitive."""
    u = F.transform(units, strip)
    n = F.size(u)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(False)).otherwise(
        (F.size(F.array_distinct(u)) < F.lit(threshold) * n) | F.array_contains(u, UNKNOWN))


def fill_template(template: str, placeholder: str, value: Column) -> Column:
    """Replace ``{placeholder}`` in a fixed template with a column value."""
    return F.replace(F.lit(template), F.lit("{" + placeholder + "}"), value)


def fixed_decimals(c: Column | str, digits: int) -> Column:
    """Fixed-decimal text, e.g. ``%.4f`` (for report sinks only)."""
    return F.format_string(f"%.{digits}f", _col(c))


def nonempty(c: Column | str) -> Column:
    return F.coalesce(F.length(_col(c)), F.lit(0)) > 0


def top_two_counted(words: Column | str) -> Column:
    """Canonical form of one row's word list: lower+strip, the two most frequent words
    (ties: first seen) joined by ``|``; an empty list gives ``''``.

    A per-row expression for short lists (synonyms of one entry); grouped data uses
    ``operators.vocab.top_two_counted`` instead."""
    norm = F.transform(_col(words), lower_strip)
    uniq = F.array_distinct(norm)
    scored = F.transform(uniq, lambda w, i: F.struct(
        (-F.size(F.filter(norm, lambda x: x == w))).alias("n"), i.alias("i"), w.alias("w")))
    return F.array_join(F.transform(F.slice(F.array_sort(scored), 1, 2), lambda s: s["w"]), SYNONYM_SEP)
