"""Parsing of search values; no Spark needed."""

from datetime import date

import pytest

from passbook.functions.money import Bounds, amount_bounds, confidence_bounds, parse_amount
from passbook.functions.periods import Calendar, last_n, preset, resolve
from passbook.functions.text import tag_name, token_list
from passbook.operators.search import last_sort, parse_sort

CAL = Calendar(date(2024, 5, 15))


@pytest.mark.parametrize(
    "spec, low, high",
    [
        ("2024", date(2024, 1, 1), date(2024, 12, 31)),
        ("2024-2", date(2024, 2, 1), date(2024, 2, 29)),
        ("2024-02-9", date(2024, 2, 9), date(2024, 2, 9)),
        ("2024-01..2024-03", date(2024, 1, 1), date(2024, 3, 31)),
        ("..2024", None, date(2024, 12, 31)),
        ("2024..", date(2024, 1, 1), None),
        ("..", None, None),
        ("yesterday", date(2024, 5, 14), date(2024, 5, 14)),
        ("this-week", date(2024, 5, 13), date(2024, 5, 19)),
        ("last-week", date(2024, 5, 6), date(2024, 5, 12)),
        ("this-month", date(2024, 5, 1), date(2024, 5, 31)),
        ("this-quarter", date(2024, 4, 1), date(2024, 6, 30)),
        ("last-quarter", date(2024, 1, 1), date(2024, 3, 31)),
        ("this-year", date(2024, 1, 1), date(2024, 12, 31)),
        ("this-financial-year", date(2023, 7, 1), date(2024, 6, 30)),
        ("last-financial-year", date(2022, 7, 1), date(2023, 6, 30)),
        ("last-7-days", date(2024, 5, 8), date(2024, 5, 14)),
        ("last-2-weeks", date(2024, 4, 29), date(2024, 5, 12)),
        ("last-3-months", date(2024, 2, 1), date(2024, 4, 30)),
        ("last-2-quarters", date(2023, 10, 1), date(2024, 3, 31)),
        ("last-2-financial-years", date(2021, 7, 1), date(2023, 6, 30)),
        ("last-quarter..yesterday", date(2024, 1, 1), date(2024, 5, 14)),
    ],
)
def test_dates(spec, low, high):
    assert resolve(spec, CAL) == (low, high)


def test_week_start_and_year_end():
    sunday = Calendar(date(2024, 5, 15), week_start=6)
    assert preset("this-week", sunday) == (date(2024, 5, 12), date(2024, 5, 18))
    april = Calendar(date(2024, 4, 6), year_end=(4, 5))
    assert preset("this-financial-year", april) == (date(2024, 4, 6), date(2025, 4, 5))
    with pytest.raises(ValueError):
        Calendar(date(2024, 1, 1), year_end=(2, 29))


@pytest.mark.parametrize("bad", ["2024-13", "2024-02-30", "soon", "last-0-days", "last-2-decades", "2024-1-1-1"])
def test_bad_dates(bad):
    with pytest.raises(ValueError):
        resolve(bad, CAL)
    with pytest.raises(ValueError):
        last_n(0, "days", CAL)


@pytest.mark.parametrize(
    "value, bounds",
    [
        ("7", Bounds(700, 800, high_open=True, magnitude=True)),
        ("7.5", Bounds(750, 760, high_open=True, magnitude=True)),
        ("7.50", Bounds(750, 750, magnitude=True)),
        ("-7", Bounds(-800, -700, low_open=True)),
        ("+7", Bounds(700, 800, high_open=True)),
        ("-7.50", Bounds(-750, -750)),
        ("0", Bounds(0, 100, high_open=True, magnitude=True)),
        (">5", Bounds(low=500, low_open=True)),
        ("<-5", Bounds(high=-500, high_open=True)),
        ("1..50", Bounds(100, 5000, magnitude=True)),
        ("0..", Bounds(0, None)),
        ("..0", Bounds(None, 0)),
        ("-100..-50", Bounds(-10000, -5000)),
        ("..", Bounds()),
    ],
)
def test_amounts(value, bounds):
    assert amount_bounds(value) == bounds


@pytest.mark.parametrize("bad", ["", ".5", "1.234", "--5", "+-5", "x"])
def test_bad_amounts(bad):
    with pytest.raises(ValueError):
        parse_amount(bad)


def test_confidence():
    assert confidence_bounds(">80") == Bounds(low=0.8, low_open=True)
    assert confidence_bounds("40%..60") == Bounds(0.4, 0.6)
    bucket = confidence_bounds("85.5")
    assert (round(bucket.low, 6), round(bucket.high, 6)) == (0.8545, 0.8555)
    for bad in ("101", "-5", "8.", "8.555", "x"):
        with pytest.raises(ValueError):
            confidence_bounds(bad)


def test_sort_terms():
    assert parse_sort("-Amount,date") == [("amount", True), ("date", False)]
    assert last_sort(["date", "amount"]) == [("amount", False)]
    assert last_sort(["date", "nope"]) == []


def test_words():
    assert tag_name(" ##Work/Travel ") == "work/travel"
    assert token_list("Café-Münch's 12_b") == ["cafe", "munch", "s", "12", "b"]
