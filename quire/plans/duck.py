"""Pieces of DuckDB SQL that recur in the oracle queries."""

from __future__ import annotations

WS = r"\s"


def low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[\\s　 ]+', ''), '[\\s　 ]+$', '')"


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, '[\\s　 ]+$', '')"


def ltrim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s　 ]+', '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[\\s　 ]+'), lambda w: w <> '')"


def collapse(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def count(x: str, cls: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{cls}', '', 'g')))"


def has(x: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in parts) + ")"


def lit(s: str) -> str:
    if "\n" in s:
        return "(" + " || chr(10) || ".join(lit(x) for x in s.split("\n")) + ")"
    return "'" + s.replace("'", "''") + "'"


def isin(x: str, values) -> str:
    return f"{x} IN ({', '.join(lit(v) for v in values)})"


def lines(x: str) -> str:
    return f"string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10))"
