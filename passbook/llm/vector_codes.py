"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

Vectors are scaled to integers and cut into equal consecutive parts; each part position has a codebook
that k-means rounds move over all rows.  Nearest entries are found by memoised grid cells: a part is
hashed by the coarse cell of a grid that holds it, and for each cell a task remembers the entries that
no other entry dominates over its box, that is whose least distance to the box is not above the
smallest greatest distance of any entry.  Only these are evaluated exactly.  The nearest entry of every
point of the box, ties included, is among them, so the codes are those of a full search.

All arithmetic is on whole numbers, so sums do not depend on the order of tasks.  A task sends one
partial sum an entry and component; codebooks have a fixed size and are all that reaches the driver.

Defined results: vectors that are NULL, empty, or hold NULL or non-finite components, and vectors of
another length than the one with the smallest id, take no part.  A length that the parts do not divide
is cut as evenly as possible.  The first entries are the first rows in order of id (NULL last) and
vector, so rows that repeat an id count each; equal entries stay, and all parts go to the first of
them.  With fewer rows than entries a codebook has as many entries as there are rows.  An empty table
gives none.  Errors above the largest long are given as that.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Side of a grid cell in scaled units, and cells that a task remembers for each part position.
SIDE, CELLS = 512, 1 << 15
#: Rows evaluated at a time, bits of a limb of a sum, and the largest long.
ROWS, LIMB, MOST = 4096, 30, (1 << 63) - 1
#: Doubles hold all whole numbers below this.
EXACT = 1 << 53


class Cells:
    """Nearest entries of one part position, with the entries worth evaluating remembered by grid cell."""

    def __init__(self, entries: np.ndarray, side: int = SIDE, most: int = CELLS):
        self.entries, self.side, self.most = entries, side, most
        self.kept: dict[bytes | tuple, int] = {}
        self.masks = np.empty((0, len(entries)), bool)
        self.evaluated = 0

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Of each cell (row) and entry (column) whether the entry may be nearest somewhere in the cell's box.

        Distances to a box are sums over the components, so they are worked out once for each distinct
        coordinate of a component.
        """
        least = np.zeros((len(cells), len(self.entries)), cells.dtype)
        most = np.zeros_like(least)
        for i in range(cells.shape[1]):
            at, which = np.unique(cells[:, i], return_inverse=True)
            low = at[:, None] * self.side
            below, above = low - self.entries[:, i], self.entries[:, i] - (low + self.side - 1)
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)
            least += (near * near)[which]
            most += (far * far)[which]
        return (least <= most.min(1)[:, None]).astype(bool)

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """The masks of the cells of a block of points, from memory where they are known."""
        if cells.dtype == object:
            keys = list(map(tuple, cells.tolist()))
        else:
            small = np.ascontiguousarray(cells, "<i8")
            keys = small.view(f"V{8 * cells.shape[1]}").ravel().tolist()
        first = {k: i for i, k in reversed(list(enumerate(keys)))}
        missing = [k for k in first if k not in self.kept]
        if len(self.kept) + len(missing) > self.most:
            self.kept.clear()
            self.masks, missing = self.masks[:0], list(first)
        if missing:
            self.kept.update(zip(missing, range(len(self.masks), len(self.masks) + len(missing))))
            self.masks = np.concatenate([self.masks, self.undominated(cells[[first[k] for k in missing]])])
        return self.masks[[self.kept[k] for k in keys]]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, ties to the lower index, and its squared distance."""
        found, errors = np.zeros(len(points), np.int64), np.zeros(len(points), points.dtype)
        if not points.shape[1]:
            return found, errors
        for at in range(0, len(points), ROWS):
            block = points[at : at + ROWS]
            masks = self._candidates(block // self.side)
            distance = np.full(masks.shape, np.inf, points.dtype)
            for e, entry in enumerate(self.entries):
                rows = np.flatnonzero(masks[:, e])
                apart = block[rows] - entry
                distance[rows, e] = (apart * apart).sum(1) if apart.dtype == object else np.einsum("ij,ij->i", apart, apart)
            best = distance.argmin(1)  # the first of equals
            found[at : at + ROWS], errors[at : at + ROWS] = best, distance[np.arange(len(block)), best]
            self.evaluated += int(masks.sum())
        return found, errors


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, exactly: as doubles where they hold it, else as Python integers."""
    if not vectors.size or np.abs(vectors).max() < EXACT / scale:
        return np.floor(vectors * scale)
    exact = [x.as_integer_ratio() for x in vectors.ravel().tolist()]
    return np.array([n * scale // d for n, d in exact], object).reshape(vectors.shape)


def _integers(values: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def _same_kind(points: np.ndarray, entries: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if sums and distances between them, and to the boxes around them, are exact so."""
    far = max([side, *(int(np.abs(a).max()) for a in (points, entries) if a.size)])
    if max(16 * far * far * max(1, points.shape[1]), far * len(points)) < EXACT:
        return points.astype(float), entries.astype(float)
    return points if points.dtype == object else _integers(points), entries


class Codebooks:
    """The entries of all part positions: ``entries[part]`` is a matrix of exact integers."""

    def __init__(self, seeds: np.ndarray, parts: int, side: int = SIDE):
        self.bounds = [seeds.shape[1] * p // parts for p in range(parts + 1)]
        self.entries = [_integers(seeds[:, a:b]) for a, b in zip(self.bounds, self.bounds[1:])]
        self.side = side

    def assign(self, vectors: np.ndarray, cells: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part position: its number, the parts, their codes and squared distances.

        ``cells`` is what a task remembers between calls.
        """
        for part, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            points, entries = _same_kind(vectors[:, a:b], self.entries[part], self.side)
            key = part, points.dtype.kind
            if key not in cells:
                cells[key] = Cells(entries, self.side)
            yield part, points, *cells[key].nearest(points)

    def moved(self, sums: dict[tuple[int, int], dict[int, int]]) -> None:
        """Replace each entry that has parts by floor(sum / count); the count stands at place -1."""
        for (part, entry), places in sums.items():
            for i in range(self.entries[part].shape[1]):
                self.entries[part][entry, i] = places.get(i, 0) // places[-1]

    def sha256(self) -> str:
        """Of all components as decimals by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Base 2^30 digits of a whole number, so that sums of any size add up as longs."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    for i in count():
        if not value:
            return
        yield i, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _sums(rows: DataFrame, books: Codebooks, width: int, scale: int) -> dict[tuple[int, int], dict[int, int]]:
    """Count (at -1) and sum of each component of the parts nearest to each entry, over all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict = {}
        sums: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for part, points, codes, _ in books.assign(whole(_matrix(b.column("v"), width), scale), cells):
                for entry in np.unique(codes).tolist():
                    mine = points[codes == entry]
                    for i, x in [(-1, len(mine)), *enumerate(mine.sum(0).tolist())]:
                        sums[part, entry, i] = sums.get((part, entry, i), 0) + int(x)
        out = [(*k, limb, x) for k, total in sums.items() for limb, x in _limbs(total)]
        columns = zip(*out) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "i", "limb", "x"])

    partial = rows.select("v").mapInArrow(add, "part bigint, entry bigint, i bigint, limb bigint, x bigint")
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in partial.groupBy("part", "entry", "i", "limb").agg(F.sum("x").alias("x")).collect():
        places = found.setdefault((r["part"], r["entry"]), {})
        places[r["i"]] = places.get(r["i"], 0) + (r["x"] << (LIMB * r["limb"]))
    return found


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id``, ``label`` and ``v`` of the rows that take part."""
    v = F.col(vector)
    # "x - x" is 0 for finite numbers only.
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (x.cast("double") - x.cast("double") == 0))
    return vectors.where(good).select(F.col(vec_id).alias("id"), F.col(label).alias("label"), v.alias("v"))


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    side: int = SIDE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """The code, error and label error of each vector, and the final codebooks.

    Columns: id, ``code`` (two hex digits a part), ``error`` (squared distances summed over the parts)
    and ``label_error`` (errors summed over equal labels; NULL labels are equal).
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    order = F.asc_nulls_last("id"), F.asc("v")
    stored = cut_lineage(usable(vectors, vec_id, vector, label))
    first = stored.orderBy(*order).select(F.size("v").alias("width")).first()
    width = first["width"] if first else 0
    rows = stored.where(F.size("v") == width)
    seeds = [r["v"] for r in rows.orderBy(*order).select(F.col("v").cast("array<double>").alias("v")).limit(entries).collect()]
    books = Codebooks(whole(np.array(seeds, float).reshape(len(seeds), width), scale), parts, side)
    for _ in range(rounds if seeds else 0):
        books.moved(_sums(rows, books, width, scale))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict = {}
        for b in batches:
            codes, errors = np.empty((len(b), parts), np.uint8), [0] * len(b)
            for part, _, found, distance in books.assign(whole(_matrix(b.column("v"), width), scale), cells):
                codes[:, part] = found
                errors = [e + int(d) for e, d in zip(errors, distance.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array([min(e, MOST) for e in errors], pa.int64())],
                names=["id", "label", "code", "error"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = cut_lineage(rows.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("bigint")
    # Added up before the join: one row a label, whose stored size decides how it is joined.
    labels = cut_lineage(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")))
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(vec_id), "code", "error", "label_error"), books
