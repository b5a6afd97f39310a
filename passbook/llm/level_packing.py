"""Online packing by sum of squares.

Each task packs the documents of its own part of the input as they come.  A level array counts the
partly filled windows at each fill level.  A document goes to the level, or to a new window, that leaves
the smallest sum of squared counts over all levels: no level piles up, so what later documents need to
complete a window is at hand.  Full windows leave the array and are written at once.

Documents longer than a window give full windows and a remainder.  Other documents are cut only to
finish windows: when more than ``OPEN`` are partly filled, and at the end of the part, the fullest
windows are completed with pieces of the emptiest.  The one window left at the end is cut into
sequences whose lengths are powers of two, which need no padding.  Nothing is shuffled, memory holds
the open windows only, and a repeated task packs its part the same way.

Defined results: a NULL text is an empty one, and an empty text is a piece of just the end token.
Rows that repeat an id are documents of their own.  A very long text is cut into windows as it is
encoded whole.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm.packing import Encoder

LENGTH, OPEN = 2048, 4096

#: Id, first token, tokens (little-endian 32-bit), tokens of the whole document.
Piece = tuple[object, int, bytes, int]


def size(piece: Piece) -> int:
    return len(piece[2]) // 4


def cut(piece: Piece, tokens: int) -> tuple[Piece, Piece]:
    doc_id, start, ids, whole = piece
    return (doc_id, start, ids[: 4 * tokens], whole), (doc_id, start + tokens, ids[4 * tokens :], whole)


class Levels:
    """Partly filled windows by fill level; a window is a list of pieces."""

    def __init__(self, length: int = LENGTH):
        self.length, self.open = length, 0
        self.counts = np.zeros(length + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}

    def best(self, tokens: int) -> int:
        """The level at which ``tokens`` more leave the smallest sum of squares, 0 for a new window.

        Moving a window from level a to b changes the sum by 2 (n[b] - n[a]) + 2; a new window and a full
        one lack one side and change it by one less.  The fuller of equal levels is taken.
        """
        counts, rest = self.counts, self.length - tokens
        levels = np.flatnonzero(counts[: rest + 1])
        growth = 2 * (counts[levels + tokens] - counts[levels]) + 2
        if len(levels) and levels[-1] == rest:
            growth[-1] -= 1
        fresh = 2 * counts[tokens] + 1
        if len(levels):
            at = len(levels) - 1 - int(growth[::-1].argmin())
            if growth[at] <= fresh:
                return int(levels[at])
        return 0

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece of at most a window where it is best; the window if that fills it."""
        tokens = size(piece)
        level = self.best(tokens) if tokens < self.length else 0
        window = self._take(level) if level else []
        window.append(piece)
        return self._keep(window, level + tokens)

    def _take(self, level: int) -> list[Piece]:
        at = self.windows[level]
        window = at.pop()
        if not at:
            del self.windows[level]
        self.counts[level] -= 1
        self.open -= 1
        return window

    def _keep(self, window: list[Piece], level: int) -> list[Piece] | None:
        if level == self.length:
            return window
        self.windows.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.open += 1
        return None

    def settle(self) -> Iterator[list[Piece]]:
        """Complete the fullest windows with pieces of the emptiest, until one at most is left open."""
        order = [(level, w) for level in sorted(self.windows) for w in self.windows[level]]
        self.windows, self.open = {}, 0
        self.counts[:] = 0
        low = 0
        while low < len(order):
            level, window = order.pop()
            while level < self.length and low < len(order):
                left, giver = order[low]
                piece = giver.pop()
                if size(piece) > self.length - level:
                    piece, rest = cut(piece, self.length - level)
                    giver.append(rest)
                window.append(piece)
                level += size(piece)
                order[low] = left - size(piece), giver
                if not giver:
                    low += 1
            if self._keep(window, level):
                yield window

    def tail(self) -> Iterator[list[Piece]]:
        """What is open, in sequences whose lengths are powers of two."""
        for level in sorted(self.windows, reverse=True):
            for window in self.windows[level]:
                for power in (1 << i for i in reversed(range(level.bit_length())) if level >> i & 1):
                    sequence: list[Piece] = []
                    while power:
                        piece = window.pop()
                        if size(piece) > power:
                            piece, rest = cut(piece, power)
                            window.append(rest)
                        sequence.append(piece)
                        power -= size(piece)
                    yield sequence
        self.windows, self.open = {}, 0
        self.counts[:] = 0


def sequences(documents: Iterator[tuple[object, bytes]], length: int = LENGTH, most_open: int = OPEN) -> Iterator[list[Piece]]:
    """The pieces of each finished sequence, in order, for documents as (id, tokens)."""
    levels = Levels(length)
    for doc_id, ids in documents:
        whole = len(ids) // 4
        for start in range(0, whole, length):
            piece: Piece = (doc_id, start, ids[4 * start : 4 * (start + length)], whole)
            if full := levels.place(piece):
                yield full
        if levels.open > most_open:
            yield from levels.settle()
    yield from levels.settle()
    yield from levels.tail()


_ENCODERS: dict[tuple[str, str], Encoder] = {}
#: Tokens in a batch of finished sequences, about.
BATCH = 1 << 20


def pack(
    docs: DataFrame, path: str, pattern: str, end_token: int, doc_id: str = "doc_id", text: str = "text",
    length: int = LENGTH, most_open: int = OPEN,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset``.

    ``sequence_id`` is the number of the part of the input and of the sequence in it.
    """
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((path, pattern)) or _ENCODERS.setdefault((path, pattern), Encoder(path, pattern, True))
        base, tail = TaskContext.get().partitionId() << 33, np.array([end_token], "<u4").tobytes()
        kind = pa.null()

        def documents() -> Iterator[tuple[object, bytes]]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                for i, value in zip(*batch.columns):
                    yield i.as_py(), encoder.ids(value.as_py() or "") + tail

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                names=["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        rows, held = [], 0
        for number, pieces in enumerate(sequences(documents(), length, most_open)):
            offset = 0
            for piece in pieces:
                i, start, ids, whole = piece
                rows.append((i, start, size(piece), ids, whole, base + number, offset))
                offset += size(piece)
            held += offset
            if held >= BATCH:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)

    id_kind = source.schema["_id"].dataType.simpleString()
    kind = f"_id {id_kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return source.mapInArrow(run, kind).withColumnRenamed("_id", doc_id)
