"""Byte-level BPE by monoid tree reduction.

The encoded form of a byte string is an element of a monoid: two neighbours are joined by encoding a
window around their boundary anew and widening it until the tokens outside cannot change.  Tokens
stand if every pair of neighbours is the encoding of its own bytes: merges go by rank, then from the
left, so inside two neighbours they run as they would alone until one crosses a boundary, and the first
that crosses would also cross when the pair is encoded by itself.  A match of the split pattern is
encoded by halves up such a tree; a text is the concatenation of its matches, whose borders no merge
crosses.  Decoding concatenates bytes up a tree.

Defined results: a NULL text is an empty one, with no ids.  Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Byte strings up to this length are leaves.
LEAF = 6
#: Cached words and pairs of a worker, and the longest word that is cached.
CACHE, CACHED = 400_000, 48
#: A space with other characters on both sides; a match of the split pattern starts there.
BETWEEN = re.compile(r" (?=\S)(?<=\S )")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Monoid:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.bytes = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.merged: dict[bytes, list[int]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.known, self.matches = _Memo(lambda word: self.part(" " + word)), _Memo(self._ids)

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a short byte string; those met before are remembered."""
        found = self.merged.get(data)
        if found is None:
            found = self._merge(data)
            if len(data) <= CACHED:
                if len(self.merged) > CACHE:
                    self.merged.clear()
                self.merged[data] = found
        return found

    def _merge(self, data: bytes) -> list[int]:
        """Merge from single bytes, lowest rank first, from the left among equal ranks."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def stands(self, a: int, b: int) -> bool:
        """Is this pair of tokens the encoding of its own bytes?"""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) > CACHE:
                self.stable.clear()
            found = self.stable[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded strings."""
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        i, j, more_left, more_right = len(left) - 1, 1, 1, 1
        while True:
            window = self.merge(b"".join([self.bytes[t] for t in left[i:] + right[:j]]))
            ok_left = i == 0 or self.stands(left[i - 1], window[0])
            ok_right = j == len(right) or self.stands(window[-1], right[j])
            if ok_left and ok_right:
                return left[:i] + window + right[j:]
            if not ok_left:
                i, more_left = max(0, i - more_left), more_left * 2
            if not ok_right:
                j, more_right = min(len(right), j + more_right), more_right * 2

    def reduce(self, data: bytes) -> list[int]:
        """Encode halves, then join them."""
        if len(data) <= self.leaf:
            return self.merge(data) if data else []
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def match(self, data: bytes) -> list[int]:
        """One match of the pattern; a match that is a token as a whole is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.reduce(data)

    def _ids(self, match: str) -> bytes:
        return array("I", self.match(match.encode())).tobytes()

    def part(self, text: str) -> bytes:
        """32-bit ids of a text, match by match."""
        return b"".join(map(self.matches.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """32-bit ids of a whole text; words between single spaces are remembered."""
        for memo in (self.known, self.matches):
            if len(memo) > CACHE:
                memo.clear()
        first, *rest = BETWEEN.split(text)
        return b"".join([self.part(first), *map(self.known.__getitem__, rest)])

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up a tree with leaves of 512 ids."""
        if len(ids) <= 512:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Memo(dict):
    """Results by string; long strings are computed anew."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        value = self.compute(key)
        if len(key) <= CACHED:
            self[key] = value
        return value


_MONOIDS: dict[tuple[str, str], Monoid] = {}


def _monoid(path: str, pattern: str) -> Monoid:
    if (path, pattern) not in _MONOIDS:
        _MONOIDS[path, pattern] = Monoid(read_ranks(path), pattern)
    return _MONOIDS[path, pattern]


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.uint32).astype(np.int32)))


def encode(text: Column, path: str, pattern: str) -> Column:
    """``array<int>`` of the ids of each whole text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        monoid = _monoid(path, pattern)
        for texts in batches:
            yield _lists([monoid.encode(t.as_py() or "") for t in texts])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>").asNondeterministic()(text)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """``ids`` of each whole text and the bytes ``decoded`` from those ids, in one pass."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        monoid = _monoid(path, pattern)
        for texts in batches:
            ids = [monoid.encode(t.as_py() or "") for t in texts]
            # One document at a time becomes Python numbers.
            decoded = [monoid.decode(array("I", i).tolist()) for i in ids]
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(decoded, pa.binary())], names=["ids", "decoded"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<ids:array<int>,decoded:binary>").asNondeterministic()(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of each list of ids; NULL for NULL."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        monoid = _monoid(path, pattern)
        for lists in batches:
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            valid = lists.is_valid().to_pylist()
            # One document at a time becomes Python numbers.
            texts = [monoid.decode(values[a:b].tolist()) if ok else None for ok, a, b in zip(valid, at, at[1:])]
            yield pa.array(texts, pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary").asNondeterministic()(ids)
