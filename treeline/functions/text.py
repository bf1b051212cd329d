"""Texts, lines, estimates and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def token_estimate(c: Column) -> Column:
    """ceil(characters / 4), 0 for an empty text."""
    return F.ceil(F.char_length(c) / 4).cast("bigint")


def byte_tokens(n: Column) -> Column:
    """ceil(bytes / 4)."""
    return F.floor((n + 3) / 4).cast("bigint")


def lines(c: Column) -> Column:
    """Lines without their ends; a closing line end makes no further line, an empty text has none."""
    parts = F.split(c, "\n", -1)
    cut = F.when(c.endswith("\n") | (c == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.transform(cut, lambda x: F.regexp_replace(x, "\r$", ""))


def line_count(c: Column) -> Column:
    n = F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    return (n + F.when((c != "") & ~c.endswith("\n"), 1).otherwise(0)).cast("bigint")


def outline(c: Column, n: int) -> Column:
    """First ``n`` trimmed lines that are not empty."""
    return F.slice(F.filter(F.transform(lines(c), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != ""), 1, n)


def code_slice(c: Column, first: int, last: int) -> Column:
    """Lines first..last (from 1, inclusive), cut at the end of the text; null if it has fewer than ``first``."""
    kept = lines(c)
    return F.when(F.size(kept) >= first, F.array_join(F.slice(kept, first, last - first + 1), "\n"))


def contains_line(line: Column, needle: str, case_sensitive: bool) -> Column:
    return line.contains(needle) if case_sensitive else ascii_lower(line).contains(needle.translate(str.maketrans(_UPPER, _LOWER)))


def fuzzy(line: Column, needle: str) -> Column:
    """Whether all characters of the needle occur in order, whatever stands between; an empty needle does.

    Between two characters stand only others than the second, so each place is tried once however long the line is.
    """
    import re

    if not needle:
        return F.lit(True)
    esc = [re.escape(x) if x not in "[]^\\-&" else "\\" + x for x in needle]
    return line.rlike("(?s)^" + "".join(f"[^{x}]*+{x}" for x in esc))


def terms(c: Column) -> Column:
    """Distinct lower-case words of letters and digits, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")))


def first_term(c: Column, query_terms: list[str]) -> Column:
    """The first of the sorted terms that occurs in the text."""
    out = F.lit(None).cast("string")
    for t in sorted(query_terms, reverse=True):
        out = F.when(ascii_lower(c).contains(t), t).otherwise(out)
    return out


def call_leaf(c: Column) -> Column:
    """Last non-empty part of a call target split on : . and /, without a closing '!'."""
    parts = F.filter(F.split(c, "[:./]"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.regexp_replace(F.element_at(parts, -1), "!$", ""))


def compact(c: Column, limit: int = 240) -> Column:
    """White space collapsed; a longer text is cut at the last blank within the limit and marked."""
    flat = F.btrim(F.regexp_replace(c, r"\s+", " "))
    head = F.substring(flat, 1, limit - 3)
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("...")))


def slug(c: Column) -> Column:
    """Anchor of a heading: lower case, only letters, digits, blanks, '-' and '_' kept, blanks to '-'."""
    return F.replace(F.regexp_replace(F.lower(F.btrim(c)), r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("-"))


def framed(*cols: Column) -> Column:
    """Fields with their lengths before them, so that different fields never give one string; null has its own mark."""
    return F.concat(*(F.when(c.isNull(), F.lit("-;")).otherwise(F.concat(F.char_length(c).cast("string"), F.lit(":"), c, F.lit(";"))) for c in cols))
