"""Full text as a postings table ``(ledger_id, term, id, pos)``.

Every matcher returns distinct ``(ledger_id, id)`` pairs for a semi or anti
join.  Filters on ``term`` reach the scan, so an index stored by term
(``segments``) is read only where it must be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import fold_literal, searchable_text, token_list, tokens
from passbook.session import cut_lineage

POSTING_COLUMNS = ["ledger_id", "term", "id", "pos"]
#: A block covers 2^SPAN ids: these as distances from the start of the span, the positions beside them.
SPAN = 8
BLOCK_COLUMNS = "ledger_id string, term string, block long, ids array<int>, places array<int>"


def postings_of(df: DataFrame, text: Column) -> DataFrame:
    """One row per word of ``text``, with its position."""
    return df.select(
        "ledger_id", "id", F.posexplode(tokens(text)).alias("pos", "term")
    ).select(*POSTING_COLUMNS)


def _noted(tx: DataFrame, notes: DataFrame | None) -> tuple[DataFrame, Column]:
    """Transactions with their notes, and the text to index."""
    rows = tx.select("ledger_id", "id", "description", "metadata")
    if notes is None:
        return rows, searchable_text("description", "metadata")
    noted = notes.select("ledger_id", F.col("transaction_id").alias("id"), "note")
    return rows.join(noted, ["ledger_id", "id"], "left"), searchable_text("description", "metadata", "note")


def build_postings(tx: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Postings of every transaction, deleted accounts included."""
    return postings_of(*_noted(tx, notes))


def build_blocks(tx: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The same as blocks: (ledger_id, term, block, ids, places), one row for each term and span of ids.

    The texts are shuffled by span, not their words; the words of a span are grouped as arrays.
    """
    rows, text = _noted(tx, notes)
    span = F.shiftright("id", SPAN)
    # Sorted, so that a task meets the rows of a span one after the other.
    rows = rows.withColumn("block", span).repartition("ledger_id", "block").sortWithinPartitions("ledger_id", "id")
    return rows.select("ledger_id", "id", tokens(text).alias("words")).mapInArrow(_grouped, BLOCK_COLUMNS)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word lists, sorted by ledger and id, as blocks; rows of an unfinished span wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        spans = _spans(batch)
        ends = [*(np.flatnonzero(np.diff(spans)) + 1).tolist(), batch.num_rows]
        if held and not _one_span(held[-1], batch):
            yield from _blocks(held)
            held = []
        begin = 0
        for end in ends[:-1]:
            held.append(batch.slice(begin, end - begin))
            begin = end
            yield from _blocks(held)
            held = []
        held.append(batch.slice(begin))
    yield from _blocks(held)


def _spans(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row that changes where ledger or span do."""
    ledger = batch.column("ledger_id").dictionary_encode("encode").indices.to_numpy()
    ids = batch.column("id")
    block = ids.fill_null(0).to_numpy() >> SPAN
    new = (np.diff(ledger) != 0) | (np.diff(block) != 0) | (np.diff(ids.is_null().to_numpy(zero_copy_only=False)) != 0)
    return np.concatenate([[0], np.cumsum(new)])


def _one_span(before: pa.RecordBatch, after: pa.RecordBatch) -> bool:
    if before.column("ledger_id")[-1].as_py() != after.column("ledger_id")[0].as_py():
        return False
    a, b = before.column("id")[-1].as_py(), after.column("id")[0].as_py()
    return a == b if None in (a, b) else a >> SPAN == b >> SPAN


def _blocks(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the rows of one span, sorted by term."""
    lists = [r.column("words") for r in rows]
    flat = pa.concat_arrays([x.flatten() for x in lists]) if lists else pa.array([], pa.string())
    if not len(flat):
        return
    lengths = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in lists])
    ids = pa.concat_arrays([r.column("id") for r in rows])
    known = not ids.null_count
    near = (ids.fill_null(0).to_numpy() & ((1 << SPAN) - 1)).astype(np.int32)
    at = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    words = flat.dictionary_encode()
    codes = words.indices.to_numpy()
    # Rows come by id, and places ascend in a row, so a stable sort by word leaves both in order.
    order = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=len(words.dictionary))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    n = len(counts)
    ledger = rows[0].column("ledger_id").slice(0, 1).take(pa.array(np.zeros(n, np.int64)))
    block = pa.array(np.full(n, ids[0].as_py() >> SPAN)) if known else pa.nulls(n, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [
            ledger, words.dictionary, block,
            pa.ListArray.from_arrays(offsets, pa.array(np.repeat(near, lengths)[order])),
            pa.ListArray.from_arrays(offsets, pa.array(at[order])),
        ],
        names=["ledger_id", "term", "block", "ids", "places"],
    )


def indexed_rows(tx: DataFrame) -> DataFrame:
    """How many rows a full rebuild covers, per ledger."""
    return tx.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("rows"))


def check_postings(postings: DataFrame, tx: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(ledger_id, id, term, problem) of every missing or phantom pair; empty when in order.

    One aggregation over both sides; a pair seen on one side only is a problem,
    and an id without a transaction is an orphan.
    """
    pair = ["ledger_id", "id", "term"]
    expected = build_postings(tx, notes).select(*pair, F.lit(1).alias("side"))
    actual = postings.select(*pair, F.lit(2).alias("side"))
    sides = (
        expected.unionByName(actual).groupBy(*pair).agg(F.bit_or("side").alias("side"))
        .filter(F.col("side") != 3)
    )
    return _problems(sides, tx)


def check_blocks(blocks: DataFrame, tx: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """``check_postings`` of an index in blocks.

    Spans of ids are compared by their number of pairs of word and id and a digest of these, which are summed up
    where the texts and the blocks are, so that no word is shuffled.  Only spans that differ are taken apart, block
    by block.
    """
    sides = _due(tx, notes).unionByName(_held(blocks), allowMissingColumns=True)
    both = [F.max(f"{name}_{side}").alias(f"{name}_{side}") for name in ("pairs", "digest") for side in ("due", "held")]
    found = sides.groupBy("ledger_id", "block").agg(*both)
    same = F.col("pairs_due").eqNullSafe(F.col("pairs_held")) & F.col("digest_due").eqNullSafe(F.col("digest_held"))
    odd = cut_lineage(found.filter(~same).select(F.col("ledger_id").alias("_ledger"), F.col("block").alias("_block")))

    def of_odd(rows: DataFrame, block: Column) -> DataFrame:
        here = F.col("ledger_id").eqNullSafe(F.col("_ledger")) & block.eqNullSafe(F.col("_block"))
        return rows.join(odd, here, "left_semi")

    changed = of_odd(tx, F.shiftright("id", SPAN))
    return _problems(_odd_pairs(build_blocks(changed, notes), of_odd(blocks, F.col("block"))), tx)


def _digest(items: str, pair: Callable[[Column], Column]) -> Column:
    """A digest of the pairs of an array that does not depend on their order."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda seen, item: seen.bitwiseXOR(pair(item)))


def _of_spans(rows: DataFrame, side: str) -> DataFrame:
    return rows.groupBy("ledger_id", "block").agg(F.sum("_n").alias(f"pairs_{side}"), F.bit_xor("_x").alias(f"digest_{side}"))


def _due(tx: DataFrame, notes: DataFrame | None) -> DataFrame:
    """Pairs of the texts of each span.  Ids that repeat count again, so their span is taken apart."""
    rows, text = _noted(tx, notes)
    near = F.coalesce(F.col("id").bitwiseAND((1 << SPAN) - 1), F.lit(0)).cast("int")
    worded = rows.select(
        "ledger_id", F.shiftright("id", SPAN).alias("block"), near.alias("_near"), F.array_distinct(tokens(text)).alias("_words")
    )
    return _of_spans(worded.select(
        "ledger_id", "block", F.size("_words").cast("long").alias("_n"), _digest("_words", lambda w: F.xxhash64(w, "_near")).alias("_x")
    ), "due")


def _held(blocks: DataFrame) -> DataFrame:
    """Pairs of the index in each span."""
    rows = blocks.select("ledger_id", "block", "term", F.array_distinct("ids").alias("_ids"))
    return _of_spans(rows.select(
        "ledger_id", "block", F.size("_ids").cast("long").alias("_n"), _digest("_ids", lambda i: F.xxhash64("term", i)).alias("_x")
    ), "held")


def _odd_pairs(due: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of id and word that only the texts (side 1) or only the index (side 2) have."""
    key = ["ledger_id", "term", "block"]
    none = F.lit(None).cast("array<int>")
    expected = due.select(*key, F.array_distinct("ids").alias("_due"), none.alias("_held"))
    actual = held.select(*key, none.alias("_due"), F.array_distinct("ids").alias("_held"))
    ids = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    spans = expected.unionByName(actual).groupBy(*key).agg(ids("_due").alias("_due"), ids("_held").alias("_held"))
    odd = F.concat(
        F.transform(F.array_except("_due", "_held"), lambda i: F.struct(i.alias("id"), F.lit(1).alias("side"))),
        F.transform(F.array_except("_held", "_due"), lambda i: F.struct(i.alias("id"), F.lit(2).alias("side"))),
    )
    return spans.select(*key, F.explode(odd).alias("odd")).select(
        "ledger_id", (F.shiftleft("block", SPAN) + F.col("odd.id")).alias("id"), "term", "odd.side"
    )


def _problems(sides: DataFrame, tx: DataFrame) -> DataFrame:
    """What is wrong with pairs seen on one side: 1 the texts, 2 the index."""
    pair = ["ledger_id", "id", "term"]
    known = tx.select("ledger_id", "id", F.lit(True).alias("_known"))
    return sides.join(known, ["ledger_id", "id"], "left").select(
        *pair,
        F.when(F.col("side") == 1, "missing")
        .when(F.col("_known"), "phantom")
        .otherwise("orphan")
        .alias("problem"),
    )


def _terms(words: str | Iterable[str]) -> list[str]:
    parts = [words] if isinstance(words, str) else list(words)
    return [t for p in parts for t in token_list(p)]


def match_all(postings: DataFrame, words: str | Iterable[str]) -> DataFrame:
    """Rows holding every word; one partial aggregation of word bits."""
    terms = list(dict.fromkeys(_terms(words)))
    if not terms:
        return postings.select("ledger_id", "id").distinct()
    hits = postings.filter(F.col("term").isin(terms))
    flags = [F.bool_or(F.col("term") == t).alias(f"_{i}") for i, t in enumerate(terms)]
    found = hits.groupBy("ledger_id", "id").agg(*flags)
    every = reduce(lambda a, b: a & b, [F.col(f"_{i}") for i in range(len(terms))])
    return found.filter(every).select("ledger_id", "id")


def match_any(postings: DataFrame, words: str | Iterable[str]) -> DataFrame:
    terms = _terms(words)
    return postings.filter(F.col("term").isin(terms)).select("ledger_id", "id").distinct()


def match_prefix(postings: DataFrame, prefix: str) -> DataFrame:
    start = fold_literal(prefix).rstrip("*")
    return postings.filter(F.col("term").startswith(start)).select("ledger_id", "id").distinct()


def match_phrase(postings: DataFrame, words: str | Sequence[str]) -> DataFrame:
    """Adjacent words in order.

    A hit of word ``i`` votes for the position where the phrase would start;
    a start with all votes is a match, so no postings are joined to themselves.
    """
    terms = _terms(words)
    if not terms:
        return match_all(postings, [])
    places: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        places.setdefault(t, []).append(i)
    offsets = reduce(
        lambda chain, item: chain.when(
            F.col("term") == item[0], F.array(*[F.lit(i) for i in item[1]])
        ),
        places.items(),
        F,
    )
    votes = postings.filter(F.col("term").isin(list(places))).select(
        "ledger_id", "id", "pos", F.explode(offsets).alias("_i")
    )
    starts = votes.groupBy("ledger_id", "id", (F.col("pos") - F.col("_i")).alias("_start")).agg(
        F.count(F.lit(1)).alias("_votes")
    )
    return starts.filter(F.col("_votes") == len(terms)).select("ledger_id", "id").distinct()


def match_near(postings: DataFrame, first: str, second: str, gap: int) -> DataFrame:
    """Both words with at most ``gap`` words between them.

    Positions are cut into cells as wide as the reach; a close pair lies in one
    cell or two neighbouring ones, so each cell needs only its outermost hits.
    """
    a, b = (token_list(w)[0] for w in (first, second))
    reach = gap + 1
    hits = postings.filter(F.col("term").isin([a, b]))
    if a == b:
        # Two hits of one word: within reach when a cell holds two, or
        # neighbouring cells hold a close pair.
        cells = hits.groupBy("ledger_id", "id", F.floor(F.col("pos") / reach).alias("_cell")).agg(
            F.min("pos").alias("_low"), F.max("pos").alias("_high")
        )
        joined = cells.groupBy("ledger_id", "id").agg(F.sort_array(F.collect_list(F.struct("_cell", "_low", "_high"))).alias("c"))
        close = F.exists("c", lambda x: x["_high"] > x["_low"]) | F.exists(
            F.arrays_zip(
                F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("x"),
                F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("y"),
            ),
            lambda p: p["y"]["_low"] - p["x"]["_high"] <= reach,
        )
        return joined.filter(close).select("ledger_id", "id")
    # Each hit counts in its own cell and as the later one of the pair of cells before; outermost hits suffice.
    cell = F.floor(F.col("pos") / reach)
    spread = hits.select(
        "ledger_id", "id", "pos", (F.col("term") == a).alias("_is_a"),
        F.posexplode(F.array(cell, cell - 1)).alias("_later", "_cell"),
    )

    def outermost(of: Callable, first: bool, later: int) -> Column:
        mine = F.col("_is_a") if first else ~F.col("_is_a")
        return of(F.when(mine & (F.col("_later") == later), F.col("pos")))

    cells = spread.groupBy("ledger_id", "id", "_cell").agg(
        outermost(F.max, True, 0).alias("_a"), outermost(F.max, False, 0).alias("_b"),
        outermost(F.min, True, 1).alias("_next_a"), outermost(F.min, False, 1).alias("_next_b"),
    )
    close = (
        (F.col("_a").isNotNull() & F.col("_b").isNotNull())
        | (F.col("_next_b") - F.col("_a") <= reach)
        | (F.col("_next_a") - F.col("_b") <= reach)
    )
    return cells.filter(close).select("ledger_id", "id").distinct()


def intersect(*sets: DataFrame) -> DataFrame:
    """Rows in all id sets (AND of grouped terms)."""
    return reduce(lambda x, y: x.join(y, ["ledger_id", "id"], "left_semi"), sets)


def union(*sets: DataFrame) -> DataFrame:
    """Rows in any id set (OR of grouped terms)."""
    return reduce(lambda x, y: x.unionByName(y), sets).distinct()


def exclude_match(df: DataFrame, postings: DataFrame, words: str | Iterable[str]) -> DataFrame:
    """Rows of ``df`` whose searchable text does not hold all the words."""
    return df.join(match_all(postings, words), ["ledger_id", "id"], "left_anti")


def match_one_side(links: DataFrame, postings: DataFrame, words: str | Iterable[str]) -> DataFrame:
    """Transfers one leg of which holds all the words on its own."""
    found = match_all(postings, words)
    legs = links.select(
        "ledger_id",
        F.col("id").alias("_link"),
        F.explode(F.array("from_transaction_id", "to_transaction_id")).alias("id"),
    )
    hit = legs.join(found, ["ledger_id", "id"], "left_semi").select(
        "ledger_id", F.col("_link").alias("id")
    ).distinct()
    return links.join(hit, ["ledger_id", "id"], "left_semi")
