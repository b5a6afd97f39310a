"""License scans: windows of a text retrieve templates by MinHash bands, and containment decides.

Words are lower-cased and stripped of marks.  Templates are grouped by length: a group holds those of
more than L / 2 and at most L shingles, L a power of two.  A text is cut into blocks of L shingles and a
window is two neighbouring blocks, so every stretch of L shingles lies in a window.  A band is the
smallest shingle hash in one order; a window that shares a band with a template is a candidate.  A
window that holds the wanted share of a template has a Jaccard similarity of at least ``least``, and a
group has as many bands b as make the chance of a miss, (1 - least)^b, smaller than ``MISS``.
Candidates are confirmed by the exact share of the template's shingles that occur in the window.

Defined results: a NULL text, or one of fewer words than a shingle, has no match and gives no row.
Rows that repeat an id give the matches of each.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, PERCENT, MISS = 5, 80, 1e-6
#: Shingles that are hashed at once.
CHUNK = 1 << 15
SEED = 20_240_531
#: License notices by name.  Fixed texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
    "file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
_MARKS = b".,;:!?\"'()[]{}"
_ORDERS = np.random.default_rng(SEED).integers(0, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_ODD = np.random.default_rng(SEED + 1).integers(0, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles in order of the text."""
    found = [w for w in (w.strip(_MARKS) for w in (text or b"").lower().split()) if w]
    n = len(found) - words + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    out = np.full(n, np.uint64(SEED))
    for k in range(words):
        out = (out ^ h[k : k + n]) * _ODD[k % 16]
        out ^= out >> np.uint64(29)
    return out


def ordered(hashes: np.ndarray, bands: int) -> np.ndarray:
    """The hashes under each order (bands x hashes)."""
    v = (hashes[None, :] ^ _ORDERS[0, :bands, None]) * _ORDERS[1, :bands, None]
    return v ^ (v >> np.uint64(31))


@dataclass
class Group:
    """Templates of one length: number of bands, values of each band with their names, and a sieve."""

    size: int
    bands: int
    names: dict[tuple[int, int], set[str]]
    sieve: np.ndarray


class Index:
    """Band tables of all templates, by length group."""

    def __init__(self, templates: dict[str, str], words: int, percent: int):
        self.words, self.percent = words, percent
        found = {name: np.unique(shingles(text.encode(), words)) for name, text in templates.items()}
        self.sets = {name: s for name, s in found.items() if len(s)}
        self.groups: list[Group] = []
        for size in sorted({1 << (len(s) - 1).bit_length() for s in self.sets.values()}):
            mine = {n: s for n, s in self.sets.items() if 1 << (len(s) - 1).bit_length() == size}
            held = {n: -(-percent * len(s) // 100) for n, s in mine.items()}
            least = min(held[n] / (2 * size + len(s) - held[n]) for n, s in mine.items())
            bands = min(_ORDERS.shape[1], ceil(log(MISS) / log(1 - min(least, 0.999))))
            group = Group(size, bands, {}, np.zeros((bands, 1 << 16), bool))
            for name, s in mine.items():
                for k, v in enumerate(ordered(s, bands).min(1)):
                    group.names.setdefault((k, int(v)), set()).add(name)
                    group.sieve[k, int(v) & 0xFFFF] = True
            self.groups.append(group)

    def scan(self, texts: Iterable[bytes | None]) -> list[list[tuple[str, int, float, int]]]:
        """For each text (name, first word of the best window, containment, windows) of the templates found."""
        out: list[list[tuple[str, int, float, int]]] = []
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            held.append(shingles(text, self.words))
            size += len(held[-1])
            if size >= CHUNK:
                out += self._scan(held)
                held, size = [], 0
        return out + self._scan(held)

    def _scan(self, parts: list[np.ndarray]) -> list[list[tuple[str, int, float, int]]]:
        lengths = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lengths)
        best: list[dict[str, tuple[float, int, int]]] = [{} for _ in parts]
        hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        if not len(hashes) or not self.groups:
            return [[] for _ in parts]
        values = ordered(hashes, max(g.bands for g in self.groups))
        for group in self.groups:
            # Blocks start anew in each text; a window that runs over its end is cut there.
            starts = np.concatenate([np.arange(e - n, e, group.size) for n, e in zip(lengths, ends)])
            blocks = np.minimum.reduceat(values[: group.bands], starts, axis=1)
            windows = np.minimum(blocks, np.roll(blocks, -1, axis=1))
            low = (windows & np.uint64(0xFFFF)).astype(np.int64)
            hit = np.take_along_axis(group.sieve, low, axis=1)
            named: dict[int, set[str]] = {}
            for k, w in zip(*np.nonzero(hit)):
                named.setdefault(int(w), set()).update(group.names.get((int(k), int(windows[k, w])), ()))
            for w in sorted(named):
                start = int(starts[w])
                at = int(np.searchsorted(ends, start, side="right"))
                inside = hashes[start : min(start + 2 * group.size, int(ends[at]))]
                for name in named[w]:
                    s = self.sets[name]
                    share = int(np.isin(s, inside).sum())
                    if 100 * share >= self.percent * len(s):
                        first = start - int(ends[at] - lengths[at]) + int(np.isin(inside, s).argmax())
                        old = best[at].get(name, (-1.0, 0, 0))
                        top = max((old[0], -old[1]), (share / len(s), -first))
                        best[at][name] = (top[0], -top[1], old[2] + 1)
        return [sorted((name, first, share, n) for name, (share, first, n) in b.items()) for b in best]


def scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text",
    words: int = WORDS, percent: int = PERCENT,
) -> DataFrame:
    """One row per document and template found: id, ``license``, ``first_word``, ``containment``, ``windows``.

    Templates are texts of the program, so their index goes to every task; documents are not shuffled.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(templates, words, percent)
        for texts in batches:
            yield pa.array(
                [[dict(zip(("license", "first_word", "containment", "windows"), m)) for m in found]
                 for found in index.scan(t.as_py() for t in texts)],
                pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64()), ("windows", pa.int64())])),
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, "array<struct<license:string,first_word:bigint,containment:double,windows:bigint>>")
    matched = docs.select(F.col(doc_id).alias("_id"), found.asNondeterministic()(F.col(text).cast("binary")).alias("_m"))
    return matched.select(F.col("_id").alias(doc_id), F.explode("_m").alias("_m")).select(doc_id, "_m.*")
