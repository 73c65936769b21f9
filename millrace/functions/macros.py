"""Date macros and table placeholders in SQL text, filled in before Spark reads it."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime, timedelta


def _month(day: date, by: int) -> date:
    months = day.year * 12 + day.month - 1 + by
    return date(months // 12, months % 12 + 1, 1)


# The macro names and the formats that they stand for.
MACROS: dict[str, Callable[[datetime], str]] = {
    "N_YYYY": lambda t: f"{t:%Y}",
    "N_YY": lambda t: f"{t:%y}",
    "N_MM": lambda t: f"{t:%m}",
    "N_M": lambda t: str(t.month),
    "N_DD": lambda t: f"{t:%d}",
    "N_D": lambda t: str(t.day),
    "N_HH": lambda t: f"{t:%H}",
    "N_MI": lambda t: f"{t:%M}",
    "N_SS": lambda t: f"{t:%S}",
    "N_YYYYMMDD": lambda t: f"{t:%Y%m%d}",
    "N_YYYYMM": lambda t: f"{t:%Y%m}",
    "N_YYYYMMP": lambda t: f"{_month(t, -1):%Y%m}",
    "N_YYYYMMDDN": lambda t: f"{t + timedelta(days=1):%Y%m%d}",
    "N_YYYYMMN": lambda t: f"{_month(t, 1):%Y%m}",
    "N_YYYYMMDDP": lambda t: f"{t - timedelta(days=1):%Y%m%d}",
}


def macro_value(name: str, now: datetime) -> str | None:
    build = MACROS.get(name)
    return build(now) if build else None


def expand_macros(text: str, now: datetime | None = None, table: str | None = None) -> str:
    """``eval(NAME)`` becomes the macro's value, ``{JOIN_TABLE}`` the table; unknown names stay."""
    now = now or datetime.now()
    filled = re.sub(r"eval\(\s*(\w+)\s*\)", lambda m: macro_value(m[1], now) or m[0], text)
    return filled if table is None else filled.replace("{JOIN_TABLE}", table)
