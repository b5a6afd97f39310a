"""Cents: parsing, bounds of amount and confidence terms, formatting, row hashes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_CENTS = re.compile(r"([+-]?)(\d+)(?:\.(\d{0,2}))?")
_PERCENT = re.compile(r"(\d+)(?:\.(\d{1,2}))?%?")


@dataclass(frozen=True)
class Bounds:
    """A numeric interval; an absent end is ``None``.  ``magnitude`` tests the absolute value."""

    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False
    magnitude: bool = False

    @property
    def empty(self) -> bool:
        return self.low is None and self.high is None

    def test(self, col: Column) -> Column | None:
        parts = []
        value = F.abs(col) if self.magnitude else col
        if self.low is not None:
            parts.append(value > self.low if self.low_open else value >= self.low)
        if self.high is not None:
            parts.append(value < self.high if self.high_open else value <= self.high)
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def parse_amount(text: str) -> tuple[int, str, int]:
    """(cents, sign as written, cents covered by the last digit written)."""
    match = _CENTS.fullmatch(text)
    if not match:
        raise ValueError(f"not an amount: {text}")
    sign, whole, fraction = match[1], match[2], match[3] or ""
    cents = int(whole) * 100 + int(fraction.ljust(2, "0"))
    return (-cents if sign == "-" else cents), sign, 10 ** (2 - len(fraction))


def amount_bounds(value: str) -> Bounds:
    """Interval of an amount term: comparison, range, or a bucket as wide as the precision."""
    if value[:1] in ("<", ">"):
        cents = parse_amount(value[1:])[0]
        return Bounds(low=cents, low_open=True) if value[0] == ">" else Bounds(high=cents, high_open=True)
    if ".." in value:
        ends = [parse_amount(p) if p else None for p in value.split("..", 1)]
        signed = any(e and (e[1] or e[0] == 0) for e in ends)
        low, high = (e[0] if e else None for e in ends)
        return Bounds(low, high, magnitude=not signed and not (low is None and high is None))
    if not value:
        return Bounds()
    cents, sign, step = parse_amount(value)
    if step == 1:
        return Bounds(cents, cents, magnitude=not sign)
    if sign == "-":
        return Bounds(cents - step, cents, low_open=True)
    return Bounds(cents, cents + step, high_open=True, magnitude=not sign)


def parse_percent(text: str) -> tuple[float, float]:
    """(fraction, width of the last digit written), both on the 0 to 1 scale."""
    match = _PERCENT.fullmatch(text)
    if not match:
        raise ValueError(f"not a confidence: {text}")
    percent = float(text.removesuffix("%"))
    if percent > 100.0:
        raise ValueError(f"more than a hundred percent: {text}")
    width = {0: 1.0, 1: 0.1, 2: 0.01}[len(match[2] or "")]
    return percent / 100.0, width / 100.0


def confidence_bounds(value: str) -> Bounds:
    if value[:1] in ("<", ">"):
        share = parse_percent(value[1:])[0]
        return Bounds(low=share, low_open=True) if value[0] == ">" else Bounds(high=share, high_open=True)
    if ".." in value:
        low, high = (parse_percent(p)[0] if p else None for p in value.split("..", 1))
        return Bounds(low, high)
    if not value:
        return Bounds()
    share, width = parse_percent(value)
    return Bounds(share - width / 2.0, share + width / 2.0, high_open=True)


def parse_cents(col: Column | str) -> Column:
    """Text to cents; NULL unless an optional sign, digits and at most two decimals."""
    text = F.col(col) if isinstance(col, str) else col
    cents = (text.try_cast("decimal(20,2)") * 100).try_cast("bigint")
    return F.when(text.rlike(r"^[+-]?\d+(\.\d{0,2})?$"), cents)


def format_cents(col: Column | str, symbol: str = "") -> Column:
    """Sign, symbol, whole part and two digits: ``-$12.05``."""
    cents = F.col(col) if isinstance(col, str) else col
    size = F.abs(cents)
    # ``%`` and whole division, not a double, keep every cent of a long.
    whole = F.floor((size - size % 100) / F.lit(100).cast("decimal(3,0)")).cast("bigint")
    return F.format_string(
        "%s%s%d.%02d", F.when(cents < 0, "-").otherwise(""), F.lit(symbol), whole, size % 100
    )


def confidence_percent(col: Column | str) -> Column:
    share = F.col(col) if isinstance(col, str) else col
    return F.concat(F.round(share * 100).cast("bigint").cast("string"), F.lit("%"))


def _little_endian(col: Column) -> Column:
    """The eight bytes of a long, lowest byte first."""
    digits = F.lpad(F.hex(col), 16, "0")
    pairs = [F.substring(digits, start, 2) for start in range(15, 0, -2)]
    return F.unhex(F.concat(*pairs))


def row_hash(date: str, description: str, amount: str, balance: str, given: str | None = "hash") -> Column:
    """The given hash, else SHA-256 over the raw date text, description, amount and balance."""
    bar = F.lit("|").cast("binary")
    digest = F.sha2(
        F.concat(
            F.col(date).cast("binary"), bar,
            F.col(description).cast("binary"), bar,
            _little_endian(F.col(amount)), bar,
            _little_endian(F.col(balance)),
        ),
        256,
    )
    return F.coalesce(F.col(given), digest) if given else digest
