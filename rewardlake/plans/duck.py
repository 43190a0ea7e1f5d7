"""SQL text builders for the DuckDB oracles.

They spell out, in DuckDB's dialect, the same semantics as the Column
helpers in ``rewardlake.functions`` (Python strip/splitlines, last regex
match, text between markers), so each oracle reads like the query it checks.
"""

from __future__ import annotations

from ..functions.text import PY_LINE_BREAK, PY_SPACE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + PY_SPACE + '+|' + PY_SPACE + '+$')}, '', 'g')"


def split_lines(x: str) -> str:
    a = f"regexp_split_to_array({x}, {lit(PY_LINE_BREAK)})"
    return (f"(case when list_extract({a}, -1) = '' then list_slice({a}, 1, len({a}) - 1) "
            f"else {a} end)")


def last_match(x: str, pattern: str, group: int = 0) -> str:
    return f"list_extract(regexp_extract_all({x}, {lit(pattern)}, {group}), -1)"


def between(x: str, start: str, end: str) -> str:
    s, e = f"strpos({x}, {lit(start)})", f"strpos({x}, {lit(end)})"
    body = f"({s} + {len(start)})"
    return (f"(case when {s} > 0 and {e} > 0 and {e} >= {body} "
            f"then {strip(f'substring({x}, {body}, {e} - {body})')} else '' end)")


def substr_from(x: str, pos: str) -> str:
    return f"substring({x}, {pos}, greatest(length({x}) - ({pos}) + 1, 0))"


def truthy(x: str) -> str:
    return f"coalesce({x} <> '', false)"
