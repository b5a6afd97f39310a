"""Matching debits to credits of other accounts by interval arithmetic.

Debits and credits of a group each lie on a line, in order of account and id.  Taken one after the
other, each debit gets the first free credit that is not of its own account.  As long as no debit meets
its own account, debit k gets credit k.  Where the debits of an account reach its own credits
``[start, own_end)``, the ``m`` debits that are left there get the credits behind ``own_end``, and the
next debits, which are of other accounts, get the ones passed over: two stretches of the line change
places, and behind them debit k gets credit k again.

So a group is one row for each account that has both signs and the places of its shifts; a shift
depends on how far the one before reached (``reach``).  This recurrence runs in chunks of accounts: a
chunk as a function of the reach it starts from is piecewise linear, such functions are applied one
after the other, and each chunk then starts from its true reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from passbook.operators.ranking import previous_value, rank_sorted
from passbook.session import cut_lineage

#: Debits of a group whose accounts form one chunk.
CHUNK = 1 << 16
#: (first reach, reach after it, slope) of a piece, up to the next piece.
Pieces = list[tuple[int, int, int]]

#: Debits [d0, d1) and credits [c0, c1) of an account.
ENDS = "d0", "d1", "c0", "c1"


def shift(reach: int, d0: int, d1: int, c0: int, c1: int) -> tuple[int, tuple[int, int, int] | None]:
    """The reach after an account with debits [d0, d1) and credits [c0, c1), and its shift, if any."""
    start = max(reach, d0, c0)
    if start >= min(d1, c1):
        return reach, None
    return c1 + d1 - start, (start, c1, d1 - start)


def after(pieces: Pieces, d0: int, d1: int, c0: int, c1: int) -> Pieces:
    """The reach behind one more account, as a function of the first reach.

    No later account looks below the ends of this one, so a reach below them is as good as there.
    """
    low, high, ends = max(d0, c0), min(d1, c1), max(d1, c1)
    out: Pieces = []

    def add(first: int, value: int, slope: int) -> None:
        if out:
            at, had, was = out[-1]
            if was == slope and had + slope * (first - at) == value:
                return
        out.append((first, value, slope))

    for i, (first, value, slope) in enumerate(pieces):
        end = pieces[i + 1][0] if i + 1 < len(pieces) else None
        # Where the value passes one of the limits.
        cuts = {first}
        if slope:
            for limit in (low, high, ends):
                at = first + (limit - value if slope > 0 else value - limit + 1)
                if at > first and (end is None or at < end):
                    cuts.add(at)
        for at in sorted(cuts):
            v = value + slope * (at - first)
            if low >= high or v >= ends:
                add(at, v, slope) if v >= ends else add(at, ends, 0)
            elif v < low:
                add(at, c1 + d1 - low, 0)
            elif v < high:
                add(at, c1 + d1 - v, -slope)
            else:
                add(at, ends, 0)
    return out


def at(pieces: Pieces, reach: int) -> int:
    first, value, slope = max(p for p in pieces if p[0] <= reach)
    return value + slope * (reach - first)


def _accounts(rows: DataFrame, group: list[str]) -> DataFrame:
    """The stretches of each account with both signs, and its chunk."""
    debit = F.col("is_debit")
    ends = rows.groupBy(*group, "account_id").agg(
        F.min(F.when(debit, F.col("place"))).alias("d0"), (F.max(F.when(debit, F.col("place"))) + 1).alias("d1"),
        F.min(F.when(~debit, F.col("place"))).alias("c0"), (F.max(F.when(~debit, F.col("place"))) + 1).alias("c1"),
    )
    # Each account has a debit, so a chunk holds at most as many accounts as places.
    return ends.filter("d0 is not null and c0 is not null").withColumn("chunk", F.floor(F.col("d0") / CHUNK))


def _stream(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition by their first columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _schema(keys: DataFrame, names: list[str], kind: pa.DataType) -> pa.Schema:
    return pa.schema([*to_arrow_schema(keys.schema), *(pa.field(n, kind) for n in names)])


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _reaches(accounts: DataFrame, group: list[str]) -> DataFrame | None:
    """(group, chunk, reach): where each chunk of a group of several starts; None if all have one."""
    keys = [*group, "chunk"]
    big = cut_lineage(accounts.filter("chunk > 0").select(*group).distinct())
    if big.isEmpty():
        return None
    names = ["first", "value", "slope"]
    shape = _schema(accounts.select(*keys), names, pa.list_(pa.int64()))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _stream(batches, len(keys)):
            pieces: Pieces = [(0, 0, 1)]
            for row in rows:
                pieces = after(pieces, *row)
            columns = [[k] for k in key] + [[list(c)] for c in zip(*pieces)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    def chain(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks, reach, out = chunks.sort_values("chunk"), 0, []
        for pieces in zip(*(chunks[n] for n in names)):
            out.append(reach)
            reach = at([tuple(map(int, p)) for p in zip(*pieces)], reach)
        return chunks[keys].assign(reach=out)

    many = accounts.join(big, group, "left_semi").select(*keys, *ENDS).repartition(*keys).sortWithinPartitions(*keys, "d0")
    lists = ", ".join(f"{n} array<bigint>" for n in names)
    kinds = _kinds(accounts.select(*keys))
    return cut_lineage(many.mapInArrow(functions, f"{kinds}, {lists}").groupBy(*group).applyInPandas(chain, f"{kinds}, reach bigint"))


def _shifts(accounts: DataFrame, group: list[str]) -> DataFrame:
    """(group, start, own_end, behind): where debits of an account change places with those after."""
    keys = [*group, "chunk"]
    reaches = _reaches(accounts, group)
    zero = F.lit(0).cast("bigint")
    rows = accounts.withColumn("reach", zero) if reaches is None else (
        accounts.join(reaches, keys, "left").withColumn("reach", F.coalesce("reach", zero))
    )
    shape = _schema(accounts.select(*group), ["start", "own_end", "behind"], pa.int64())

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)

        for key, stretches in _stream(batches, len(keys)):
            reach = stretches[0][-1]
            for *ends, _ in stretches:
                reach, moved = shift(reach, *ends)
                if moved:
                    held.append((*key[:-1], *moved))
            if len(held) >= CHUNK:
                yield batch()
                held.clear()
        if held:
            yield batch()

    ordered = rows.select(*keys, *ENDS, "reach").repartition(*keys).sortWithinPartitions(*keys, "d0")
    return ordered.mapInArrow(follow, f"{_kinds(accounts.select(*group))}, start bigint, own_end bigint, behind bigint")


def match_in_order(rows: DataFrame, group: list[str], most: int | None = None) -> DataFrame:
    """(group, debit, credit) ids: each debit in order of account and id gets the first free credit of another account.

    ``rows`` hold the group, ``id``, ``account_id`` and ``is_debit``; ``most`` is, if known, a bound of the
    rows of one sign in a group.
    """
    ranked = rank_sorted(
        rows.select(*group, "is_debit", "account_id", "id"), [*group, "is_debit"], ["account_id", "id"], "place", most=most
    )
    placed = cut_lineage(ranked.withColumn("place", F.col("place") - 1))
    shifts = cut_lineage(_shifts(_accounts(placed, group), group))
    debits = placed.filter("is_debit").select(*group, F.col("id").alias("debit"), "place", (F.col("place") * 2 + 1).alias("_order"))
    moved = F.struct("start", "own_end", "behind")
    marks = shifts.select(*group, (F.col("start") * 2).alias("_order"), moved.alias("_shift"))
    both = debits.withColumn("_shift", F.lit(None).cast(marks.schema["_shift"].dataType)).unionByName(marks, allowMissingColumns=True)
    # A shift begins at a debit of its own, so there are at most twice as many rows.
    known = previous_value(both, group, "_order", "_shift", "_last", most=None if most is None else 2 * most).filter(
        F.col("debit").isNotNull()
    )
    k, start, own_end, behind = F.col("place"), F.col("_last.start"), F.col("_last.own_end"), F.col("_last.behind")
    credit = (
        F.when(k < start + behind, k - start + own_end)
        .when(k < own_end + behind, k - behind)
        .otherwise(k)
    )
    asked = known.select(*group, "debit", F.when(start.isNull(), k).otherwise(credit).alias("place"))
    given = placed.filter(~F.col("is_debit")).select(*group, "place", F.col("id").alias("credit"))
    return asked.join(given, [*group, "place"]).select(*group, "debit", "credit")
