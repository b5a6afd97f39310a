"""Calendar periods: date specs, presets and financial years as inclusive bounds."""

from __future__ import annotations

import calendar as _calendar
import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = timedelta(days=1)

# Period names (fixed values).
UNITS = ("days", "weeks", "months", "quarters", "years", "financial-years")
PRESET_UNITS = {
    "week": "weeks",
    "month": "months",
    "quarter": "quarters",
    "year": "years",
    "financial-year": "financial-years",
}
DEFAULT_YEAR_END = (6, 30)

_SPEC = re.compile(r"\+?(\d+)(?:-\+?(\d+))?(?:-\+?(\d+))?")
_LAST_N = re.compile(r"last-(\d+)-(.*)", re.DOTALL)


@dataclass(frozen=True)
class Calendar:
    """What relative dates are relative to.  ``week_start`` counts from Monday = 0."""

    today: date
    week_start: int = 0
    year_end: tuple[int, int] = DEFAULT_YEAR_END

    def __post_init__(self) -> None:
        month, day = self.year_end
        # 2023 has no 29 February, so a year end must exist in every year.
        try:
            date(2023, month, day)
        except ValueError:
            raise ValueError(f"financial year end must exist every year: {month:02d}-{day:02d}")
        if not 0 <= self.week_start <= 6:
            raise ValueError("week_start must be 0 (Monday) to 6 (Sunday)")


def _month_start(day: date, months: int) -> date:
    """First day of the month ``months`` away from the month of ``day``."""
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(year, month + 1, 1)


def period_start(unit: str, cal: Calendar, shift: int = 0) -> date:
    """Start of the period holding today, moved by ``shift`` whole periods."""
    today = cal.today
    if unit == "days":
        return today + shift * DAY
    if unit == "weeks":
        return today - ((today.weekday() - cal.week_start) % 7) * DAY + 7 * shift * DAY
    if unit == "months":
        return _month_start(today, shift)
    if unit == "quarters":
        return _month_start(today, 3 * shift - (today.month - 1) % 3)
    if unit == "years":
        return date(today.year + shift, 1, 1)
    if unit == "financial-years":
        end = date(today.year, *cal.year_end)
        first = today.year - 1 if today <= end else today.year
        if shift <= 0:
            start = date(first, *cal.year_end) + DAY
            return start.replace(year=start.year + shift)
        return date(first + shift, *cal.year_end) + DAY
    raise ValueError(f"no such period: {unit}")


def last_n(count: int, unit: str, cal: Calendar) -> tuple[date, date]:
    """The ``count`` complete periods before the current one."""
    if count <= 0:
        raise ValueError("the number of periods starts at one")
    return period_start(unit, cal, -count), period_start(unit, cal) - DAY


def preset(name: str, cal: Calendar) -> tuple[date, date] | None:
    """Bounds of a named or relative period; ``None`` when the name is not one."""
    if name == "yesterday":
        return last_n(1, "days", cal)
    which, _, rest = name.partition("-")
    if rest in PRESET_UNITS and which in ("this", "last"):
        unit = PRESET_UNITS[rest]
        if which == "last":
            return last_n(1, unit, cal)
        return period_start(unit, cal), period_start(unit, cal, 1) - DAY
    relative = _LAST_N.fullmatch(name)
    if relative:
        return last_n(int(relative[1]), relative[2], cal)
    return None


def date_spec(value: str) -> tuple[date, date]:
    """``YYYY``, ``YYYY-M`` or ``YYYY-M-D`` as inclusive bounds."""
    match = _SPEC.fullmatch(value)
    if not match:
        raise ValueError(f"not a date: {value}")
    year, month, day = (int(p) if p else None for p in match.groups())
    try:
        if month is None:
            return date(year, 1, 1), date(year, 12, 31)
        if day is None:
            return date(year, month, 1), date(year, month, _calendar.monthrange(year, month)[1])
        return date(year, month, day), date(year, month, day)
    except ValueError:
        raise ValueError(f"not a date: {value}")


def resolve(value: str, cal: Calendar | None) -> tuple[date | None, date | None]:
    """Inclusive bounds of any date term; an absent bound is ``None``."""

    def one(part: str) -> tuple[date, date]:
        found = preset(part, cal) if cal is not None else None
        return found or date_spec(part)

    if ".." in value:
        low, high = value.split("..", 1)
        return (one(low)[0] if low else None), (one(high)[1] if high else None)
    return one(value) if value else (None, None)


def financial_year(col: Column | str, year_end: tuple[int, int] = DEFAULT_YEAR_END) -> Column:
    """The calendar year in which the financial year of a date ends."""
    Calendar(date(2023, 1, 1), 0, year_end)
    day = F.col(col) if isinstance(col, str) else col
    ends = F.make_date(F.year(day), F.lit(year_end[0]), F.lit(year_end[1]))
    return F.year(day) + F.when(day > ends, 1).otherwise(0)


def parse_ledger_date(col: Column | str, strict: bool = True) -> Column:
    """``YYYY-MM-DD``, else ``DD/MM/YYYY``; otherwise an error, or NULL when not strict."""
    text = F.col(col) if isinstance(col, str) else col
    parsed = F.coalesce(
        F.try_to_date(text, "yyyy-M-d"), F.try_to_date(text, "d/M/yyyy")
    )
    if not strict:
        return parsed
    problem = F.raise_error(F.concat(F.lit("invalid date: "), F.coalesce(text, F.lit("null"))))
    return F.coalesce(parsed, problem.cast("date"))
