"""Small pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from quire.functions.text import WHITESPACE

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def strip(value: str) -> str:
    return f"trim({value}, '{WHITESPACE}')"


def rstrip(value: str) -> str:
    return f"rtrim({value}, '{WHITESPACE}')"


def lstrip(value: str) -> str:
    return f"ltrim({value}, '{WHITESPACE}')"


def count(value: str, pattern: str) -> str:
    """Number of matches of a pattern."""
    return f"CAST(len(regexp_extract_all({value}, '{pattern}')) AS BIGINT)"


def lines(value: str) -> str:
    return f"string_split({value}, chr(10))"


def exploded(source: str, text: str, keys: str) -> str:
    """``keys, line_no, line`` for each line of a text column."""
    return (f"SELECT {keys}, CAST(u.i - 1 AS INT) AS line_no, u.line FROM {source}, LATERAL (SELECT unnest(string_split({text}, chr(10))) "
            f"AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS i) u")
