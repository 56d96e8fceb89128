"""SQL twins of the exact rounding expressions in
``touchline.functions.expressions``, for the DuckDB oracle text."""

from __future__ import annotations


def he(num: str, den: str) -> str:
    """half_even_div(num, den) for integer SQL expressions (den > 0)."""
    a = f"ABS({num})"
    d = f"NULLIF({den}, 0)"
    q = f"({a} // {d})"
    r = f"({a} % {d})"
    pos = f"(CASE WHEN {r} * 2 > {d} THEN {q} + 1 WHEN {r} * 2 = {d} THEN {q} + {q} % 2 ELSE {q} END)"
    return f"(CASE WHEN ({num}) < 0 THEN -{pos} ELSE {pos} END)"


def ratio(num: str, den: str, scale: int = 1, places: int = 6) -> str:
    return f"(CAST({he(f'CAST({num} AS BIGINT) * {scale * 10 ** places}', f'CAST({den} AS BIGINT)')} AS DOUBLE) / {10 ** places})"


def guarded(num: str, den: str, scale: int = 1, places: int = 6) -> str:
    return f"(CASE WHEN {den} > 0 THEN {ratio(num, den, scale, places)} ELSE 0.0 END)"


def units(c: str, vp: int) -> str:
    return f"CAST(ROUND(CAST({c} AS DOUBLE) * {10 ** vp}) AS BIGINT)"


def mean(c: str, places: int = 6, vp: int = 0) -> str:
    u = units(c, vp)
    q = he(f"CAST(SUM({u}) AS BIGINT) * {10 ** places}", f"COUNT({u}) * {10 ** vp}")
    return f"(CAST({q} AS DOUBLE) / {10 ** places})"


def mean_diff(a: str, b: str, places: int = 6, vp: int = 0) -> str:
    ua, ub = units(a, vp), units(b, vp)
    num = (f"(CAST(SUM({ua}) AS BIGINT) * COUNT({ub}) - CAST(SUM({ub}) AS BIGINT) * COUNT({ua}))"
           f" * {10 ** places}")
    q = he(num, f"COUNT({ua}) * COUNT({ub}) * {10 ** vp}")
    return f"(CAST({q} AS DOUBLE) / {10 ** places})"
