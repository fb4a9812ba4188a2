"""Column expressions for plain text: trimming, line splitting, counting.

Java regexes differ from other dialects in ``\\s``, ``\\w`` and ``$``; every pattern here spells its classes out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space that a full-width trim removes, and the characters that end a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"
# Single characters below 256 share one bit set in a Java class; ranges and properties cost a call each per character.
RARE_BREAK = "[\\r\\x0B\\f\\x1C\\x1D\\x1E\\x85]"
WIDE_BREAKS = ["\u2028", "\u2029"]
SPACE = "[\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \\x85\\xA0[\\u1680-\\u3000&&\\p{Z}]]"
NOT_SPACE = "[^\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
WORD = "[\\p{L}\\p{N}_]"
WORD_START = "(?<![\\p{L}\\p{N}_])"
WORD_END = "(?![\\p{L}\\p{N}_])"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    A lambda that mentions an outer expression computes it again for every element; bound to a variable it does not.
    """
    return F.get(F.transform(F.array(value), use), 0)


def strip(value: Column | str) -> Column:
    return F.btrim(col(value), F.lit(WHITESPACE))


def rstrip(value: Column | str) -> Column:
    return F.rtrim(col(value), F.lit(WHITESPACE))


def lstrip(value: Column | str) -> Column:
    return F.ltrim(col(value), F.lit(WHITESPACE))


def is_blank(value: Column | str) -> Column:
    # Trimming on the left stops at the first other character; trimming on the right walks the whole string.
    return lstrip(value) == ""


def split_newlines(value: Column | str) -> Column:
    """Split on line feeds only; a trailing line feed yields a last empty line."""
    return F.split(col(value), "\n")


def split_lines(value: Column | str) -> Column:
    """Split on every line boundary; a trailing boundary does not start a new line."""
    value = col(value)
    rare = value.rlike(RARE_BREAK)
    for mark in WIDE_BREAKS:
        rare = rare | value.contains(mark)
    unified = F.when(rare, F.regexp_replace(value, LINE_BREAK, "\n")).otherwise(value)
    return F.split(F.regexp_replace(unified, "\n\\z", ""), "\n")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def count_matches(value: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(value), F.lit(pattern))


def count_char(value: Column | str, char: str) -> Column:
    value = col(value)
    return F.length(value) - F.length(F.replace(value, F.lit(char), F.lit("")))


def squeeze_blank_lines(value: Column) -> Column:
    """Three or more line feeds become two."""
    return F.regexp_replace(value, "\n{3,}", "\n\n")


def matches_any(value: Column | str, patterns: list[str]) -> Column:
    """One alternation instead of a chain of rlike calls: the string is scanned once."""
    return col(value).rlike("|".join(f"(?:{p})" for p in patterns))


def positions(array: Column) -> Column:
    """0-based positions of an array, [] for an empty one."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def first_n(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def last_n(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def total(numbers: Column) -> Column:
    """Sum of an array of whole numbers, 0 for an empty one."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)


def replace_matches(value: Column, pattern: str, render, groups: int = 0, outside=None) -> Column:
    """Replace each match by ``render(group_0, ..., group_n)`` and the text between matches by ``outside(text)``.

    ``regexp_replace`` cannot compute on groups; the pieces between matches and the matches themselves can.
    """
    pieces = F.split(value, pattern)
    if outside is not None:
        pieces = F.transform(pieces, outside)
    found = [F.regexp_extract_all(value, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)]
    rendered = F.transform(F.arrays_zip(*found), lambda m: render(*[m[f"g{g}"] for g in range(groups + 1)]))
    return F.array_join(F.zip_with(pieces, rendered, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def match_lines(value: Column, pattern: str) -> Column:
    """All matches with the 1-based line each starts on, as an array of (line, match)."""
    breaks = F.transform(F.split(value, pattern), lambda p: count_char(p, "\n"))
    matches = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))

    def number(found: Column) -> Column:
        inside = F.transform(found["matches"], lambda m: count_char(m, "\n"))
        return let(F.struct(found["matches"].alias("matches"), found["breaks"].alias("breaks"), inside.alias("inside")), lambda f: F.transform(
            f["matches"], lambda m, k: F.struct(
                (total(F.slice(f["breaks"], 1, k + 1)) + total(F.slice(f["inside"], 1, k)) + 1).cast("int").alias("line"), m.alias("match"))))

    return let(F.struct(matches.alias("matches"), breaks.alias("breaks")), number)
