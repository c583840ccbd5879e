"""Rendering of small results: numbers, tables and the report. Everything here works on collected rows of tests and slots."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from html import escape
from typing import Any

from pyspark.sql import DataFrame


def number(value: Any, digits: int = 3) -> str:
    """M5: 'n/a' for null and NaN, whole numbers as they are, else fixed digits; texts pass."""
    if value is None:
        return "n/a"
    if isinstance(value, (str, bool)):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return "n/a" if math.isnan(value) else f"{value:.{digits}f}"


def probability(p: float | None) -> str:
    """M6: 'n/a', '<0.001' or three digits."""
    return "n/a" if p is None or math.isnan(p) else "<0.001" if p < 0.001 else f"{p:.3f}"


def table(headers: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    """K8: a Markdown table."""
    cells = [list(headers), ["---"] * len(headers), *([number(c) for c in r] for r in rows)]
    return "\n".join("| " + " | ".join(r) + " |" for r in cells)


def section(title: str, df: DataFrame | Callable[[], DataFrame], order: Sequence[str], most_rows: int = 200) -> str:
    """A heading and a small result as a table; a result of more than `most_rows` rows is no report table and is refused."""
    df = df() if callable(df) else df
    rows = df.orderBy(*order).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"{title}: more than {most_rows} rows")
    return f"## {title}\n\n" + (table(df.columns, rows) if rows else "No rows.")


def results(sections: Sequence[tuple[str, DataFrame | Callable[[], DataFrame], Sequence[str]]], title: str = "Results", at_once: int = 6) -> str:
    """K7: the report of all sections, `at_once` of which are made beside one another."""
    with ThreadPoolExecutor(at_once) as pool:
        return "\n\n".join([f"# {title}", *pool.map(lambda s: section(*s), sections)]) + "\n"


def histogram_svg(bins: Sequence[tuple[float, float, int]], title: str, width: int = 480, height: int = 200) -> str:
    """K9: bars of (lo, hi, n) as a drawing, empty bins as gaps and a line at zero."""
    lo, hi = min((b[0] for b in bins), default=-1.0), max((b[1] for b in bins), default=1.0)
    most = max((b[2] for b in bins), default=0) or 1
    x = lambda v: round((v - lo) / ((hi - lo) or 1) * width, 2)
    bars = [f'<rect x="{x(a)}" y="{round(height - n / most * height, 2)}" width="{round(x(b) - x(a), 2)}" height="{round(n / most * height, 2)}"/>' for a, b, n in bins]
    line = f'<line x1="{x(0)}" x2="{x(0)}" y1="0" y2="{height}" stroke="red"/>' if lo <= 0 <= hi else ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}"><title>{escape(title)}</title>{"".join(bars)}{line}</svg>'
