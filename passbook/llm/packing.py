"""Packing by bounded-space online best fit.

Each task packs the documents of its own part of the input as they come.  Open sequences sit in a
bitset keyed by free space: a piece goes to the open sequence with the least free space that holds
it.  At most ``OPEN`` sequences are open; one more closes the fullest.  Pieces of ``AHEAD`` documents
at a time are looked at together and placed longest first, which leaves a tenth of the waste.  Nothing is shuffled, memory is
bounded, and a repeated task packs its part the same way.

Defined results: a NULL text is an empty one, and an empty text is a piece of just the end token.
Rows that repeat an id are documents of their own.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, OPEN, AHEAD = 1024, 2048, 1000
#: Cached words of a worker, and the longest that is cached.
CACHE, CACHED = 250_000, 48


class BestFit:
    """Open sequences by free space; ``place`` gives (sequence, offset) of a piece."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        self.bits, self.count, self.next = 0, 0, 0
        self.open: dict[int, list[int]] = {}

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.length, self.next
            self.next += 1
        rest = free - size
        if rest:
            if self.count == self.most:
                # The fullest closes; it may be this one.
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest >= rest:
                    return sequence, self.length - free
                self._take(fullest)
            self.open.setdefault(rest, []).append(sequence)
            self.bits |= 1 << rest
            self.count += 1
        return sequence, self.length - free

    def _take(self, free: int) -> int:
        at = self.open[free]
        sequence = at.pop()
        if not at:
            self.bits &= ~(1 << free)
        self.count -= 1
        return sequence


#: A space with other characters on both sides.
BETWEEN = re.compile(r" (?=\S)(?<=\S )")


class Encoder(dict):
    """Ids of a byte-level vocabulary file of the ``tokenizers`` library; no special tokens are put around a text.

    In such a vocabulary the id of a token is its merge rank, so the rank encoder gives the same ids
    several times faster (a test holds them together).  A space with other characters on both sides
    starts a new match of the split pattern, so the text between two such spaces is encoded by itself
    and its ids are remembered in this mapping.  With ``added``, the strings of the file's added tokens
    inside a text are those tokens, as the library has it; without, they are ordinary text.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, tokens = file["model"]["vocab"], file.get("added_tokens") or []
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in tokens} if added else {}
        if added and any(t.get(flag) for t in tokens for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip or match whole words are not supported")
        # At one place the longest counts; the group keeps the tokens in the split.
        contents = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, contents))})") if contents else None
        shown = _shown_bytes()
        ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if not token.startswith("<|")}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = encoding._core_bpe.encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(" " + word)).tobytes()
        if len(word) <= CACHED:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if len(self) > CACHE:
            self.clear()
        if self.cut is None:
            return self._between(text)
        parts = self.cut.split(text)
        return b"".join([self.added[p] if i % 2 else self._between(p) for i, p in enumerate(parts)])

    def _between(self, text: str) -> bytes:
        """Ids of the text between added tokens."""
        first, *rest = BETWEEN.split(text)
        return b"".join([array("I", self.encode(first)).tobytes(), *map(self.__getitem__, rest)])


def _shown_bytes() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def pack(
    docs: DataFrame, path: str, pattern: str, end_token: int, doc_id: str = "doc_id", text: str = "text",
    length: int = LENGTH, most_open: int = OPEN,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``sequence_id``, ``offset``.

    A document of more than ``length`` tokens is cut into full pieces, the first of which may be
    shorter.  ``sequence_id`` is the number of the part of the input and of the sequence in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((path, pattern)) or _ENCODERS.setdefault((path, pattern), Encoder(path, pattern, True))
        fit, base = BestFit(length, most_open), TaskContext.get().partitionId() << 33
        tail = np.array([end_token], "<u4").tobytes()
        for batch in (b.slice(at, AHEAD) for b in batches for at in range(0, len(b), AHEAD)):
            pieces: list[tuple] = []
            for i, value in enumerate(batch.column(1)):
                ids = encoder.ids(value.as_py() or "") + tail
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    size = (n - start - 1) % length + 1 if piece == 0 else length
                    pieces.append((i, piece, start, size, ids[4 * start : 4 * (start + size)]))
                    start, piece = start + size, piece + 1
            rows = []
            for p in sorted(pieces, key=lambda p: -p[3]):
                sequence, offset = fit.place(p[3])
                rows.append((*p, base + sequence, offset))
            at, *columns = zip(*rows) if rows else [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = f"_id {source.schema['_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"
    return source.mapInArrow(run, kind).withColumnRenamed("_id", doc_id)
