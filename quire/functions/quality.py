"""Readability scores of a page, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# Readable and suspicious characters, weights and bounds of both scores.
UNREADABLE = "[^\\p{L}\\p{N}\\t-\\r\\x1C-\\x20\\x85\\p{Z}.,;:!?\\-()\\[\\]{}]+"
SUSPICIOUS = "[^\\x{0}-\\x{3E8}\\x{4E00}-\\x{9FFF}]+"
NOT_ALNUM = "[^\\p{L}\\p{N}]+"
MIN_CHARS = 10
SUSPICION_WEIGHT = 2
BASE, LENGTH_WEIGHT, FULL_LENGTH, READABLE_WEIGHT, READABLE_CAP = 0.35, 0.25, 120, 0.35, 0.9
RESIDUE_PENALTY, REPEAT_PENALTY, SYMBOL_PENALTY, SYMBOL_LIMIT, TEX_BONUS, CEILING = 0.30, 0.20, 0.20, 0.45, 0.04, 0.92
RESIDUE = "(?i)\\x{FFFD}|\\(cid:\\s*\\d+\\)|cid:\\s*\\d+"
REPEAT = "(?s)(.)\\1{5,}"
ANY_TEX = "\\\\[a-zA-Z]+|\\$|\\\\begin\\{"
REAL_TEX = "\\\\[a-zA-Z]+|\\$[^$]+\\$"
MATH_PATTERNS = ["[+\\-*/=<>∫∑∏√∂∇]", "\\\\[a-zA-Z]+", "\\^|\\{|\\}|_", "[α-ωΑ-Ω]", "\\d+[a-zA-Z]+\\d*"]
FORMULA_SHARE, MIXED_SHARE = 0.3, 0.05


def chars_of(value: Column, runs: str) -> Column:
    """Characters matched by a class, given as a pattern for runs of it."""
    return F.length(value) - F.length(F.regexp_replace(value, runs, ""))


def text_quality(value: Column | str) -> Column:
    """Share of readable characters less twice the share of suspicious ones, within [0, 1]."""
    value = T.col(value)
    total = F.length(value)
    readable = (total - chars_of(value, UNREADABLE)) / total
    suspicious = chars_of(value, SUSPICIOUS) / total
    score = T.clamp(readable - suspicious * SUSPICION_WEIGHT, 0.0, 1.0)
    return F.when(value.isNull() | (F.length(T.strip(value)) < MIN_CHARS), 0.0).otherwise(score)


def vision_quality(value: Column | str) -> Column:
    """Conservative readability of a machine reading, within [0, 0.92]."""
    value = T.col(value)
    compact = F.regexp_replace(value, f"{T.SPACE}+", "")
    size = F.greatest(F.length(compact), F.lit(1))
    symbols = chars_of(compact, NOT_ALNUM)
    readable = F.length(compact) - symbols
    score = (
        F.lit(BASE) + F.least(F.length(compact) / FULL_LENGTH, F.lit(1.0)) * LENGTH_WEIGHT
        + F.least(readable / size, F.lit(READABLE_CAP)) * READABLE_WEIGHT
        - F.when(value.rlike(RESIDUE), RESIDUE_PENALTY).otherwise(0.0)
        - F.when(compact.rlike(REPEAT), REPEAT_PENALTY).otherwise(0.0)
        - F.when((symbols / size > SYMBOL_LIMIT) & ~value.rlike(ANY_TEX), SYMBOL_PENALTY).otherwise(0.0)
        + F.when(value.rlike(REAL_TEX), TEX_BONUS).otherwise(0.0)
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.bround(score, 3), F.lit(CEILING)))
    return F.when(value.isNull() | T.is_blank(value), 0.0).otherwise(bounded)


def content_type(value: Column | str) -> Column:
    """formula, mixed, text or unknown, by the share of mathematical signs."""
    value = T.col(value)
    signs = sum((T.count_matches(value, p) for p in MATH_PATTERNS[1:]), T.count_matches(value, MATH_PATTERNS[0]))
    size = F.length(T.strip(value))
    share = signs / F.greatest(size, F.lit(1))
    return F.when(size == 0, "unknown").when(share > FORMULA_SHARE, "formula").when(share > MIXED_SHARE, "mixed").otherwise("text")
