"""Quality classifier by compression.

Two Zstandard dictionaries are built from blocks of good and of bad labelled texts.  A text is cut
into blocks, each is compressed with the good dictionary, with the bad one and without any; the
difference of the two sizes, normalised by the plain size, and the plain ratio become a score by a
logistic calibration on labelled texts that built no dictionary.

Defined results: a NULL text scores as an empty one.  Without labels of both classes there is no
dictionary and every text gets the share of good labels (1.0 without any).  Labels without a doc_id or
quality are not learnt from; of repeated labels of a document the lowest counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.session import cut_lineage

BLOCK = 1024
DICTIONARY = 65_536
#: Bounds of the fit: labelled documents of each class, and blocks of them for each dictionary.
SAMPLE_DOCUMENTS = 4_000
SAMPLE_BLOCKS = 12_000
LEVEL = 3
#: Blocks beyond the limit that may come to the driver, and the shifts that leave ever more leading bits of a hash.
SPARE = 2_000
SHIFTS = (52, 40, 28, 16, 4, 0)


@dataclass(frozen=True)
class Model:
    """Dictionaries and the calibration; ``weights`` are None where only ``share`` is known."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float] | None
    share: float


def cut(data: bytes, size: int = BLOCK) -> list[bytes]:
    """All of a text in blocks; an empty text is one empty block."""
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    more = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **more)


def sizes(texts: Iterable[bytes | None], n: int, good: bytes, bad: bytes) -> np.ndarray:
    """Per text: bytes when compressed plainly, with the good and with the bad dictionary, and its length."""
    tools = [_compressor(b""), _compressor(good), _compressor(bad)]
    out = np.empty((n, 4))
    for i, text in enumerate(texts):
        blocks = cut(text or b"")
        out[i, :3] = [sum(len(t.compress(b)) for b in blocks) for t in tools]
        out[i, 3] = len(text or b"")
    return out


def traits(size: np.ndarray) -> np.ndarray:
    """Constant, normalised difference of the compressed sizes, and plain ratio."""
    plain, good, bad, length = size.T
    return np.stack([np.ones(len(size)), (bad - good) / plain, plain / (length + 1)], axis=1)


def scores(texts: Iterable[bytes | None], n: int, model: Model) -> np.ndarray:
    if model.weights is None:
        return np.full(n, model.share)
    z = traits(sizes(texts, n, model.good, model.bad)) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps, with a small ridge on the scaled traits."""
    mean, spread = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.concatenate([x[:, :1], (x[:, 1:] - mean) / spread], axis=1)
    w, ridge = np.zeros(z.shape[1]), 1e-2 * np.eye(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    slopes = w[1:] / spread
    return (float(w[0] - slopes @ mean), *map(float, slopes))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample_documents: int = SAMPLE_DOCUMENTS, sample_blocks: int = SAMPLE_BLOCKS) -> Model:
    """Learn from labels of folds 1 to 4: dictionaries from folds 1 to 3, calibration on fold 4.

    Labels are counted over all rows.  Texts come from at most ``sample_documents`` documents of each
    class, taken by a hash of their id; that list has a fixed bound and is broadcast.  The driver gets
    few more than ``sample_blocks`` blocks of each class from all tasks together (``first_blocks``) and
    two numbers a document.
    """
    marked = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
        .withColumn("_fold", fold(F.col("_id"))).where("_fold <> 0")
    )
    counts = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    if len(counts) < 2:
        return Model(b"", b"", None, share)
    chosen = None
    for one in (0, 1):
        part = marked.where(F.col("_label") == one).orderBy(F.xxhash64("_id"), "_id").limit(sample_documents)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text")).join(
        F.broadcast(chosen), "_id"
    )
    dictionaries = []
    for one in (1, 0):
        rows = first_blocks(sample.where((F.col("_fold") != 4) & (F.col("_label") == one)), sample_blocks)
        rows = rows.orderBy("_place", "_id", "_no", "_tie").limit(sample_blocks).select("_block").collect()
        dictionaries.append(dictionary([bytes(r["_block"]) for r in rows]))
    good, bad = dictionaries
    if not good or not bad:
        return Model(b"", b"", None, share)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = traits(sizes((t.as_py() for t in b.column("_text")), len(b), good, bad))
            yield pa.RecordBatch.from_arrays(
                [b.column("_label"), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["y", "a", "b"]
            )

    seen = sample.where("_fold = 4").select("_label", "_text").mapInArrow(measure, "y int, a double, b double").toArrow()
    y, a, b = (seen.column(c).to_numpy().astype(float) for c in ("y", "a", "b"))
    if len(set(y)) < 2:
        return Model(b"", b"", None, share)
    x = np.stack([np.ones(len(y)), a, b], axis=1)
    # Classes are sampled alike, so each is weighted back to its share of all labels.
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    return Model(good, bad, calibrate(x, y, weight), share)


def first_blocks(sample: DataFrame, most: int) -> DataFrame:
    """Blocks of texts that hold the first ``most`` in the order of ``_place``, ``_id``, ``_no`` and ``_tie``, and few others.

    Each task of an ordered limit sends up to the whole limit to the driver.  So the end of the limit is
    found first, by counts of leading bits of ``_place`` (a hash of id and number), and if rows that
    repeat an id fall together there, of ``_tie`` (a hash of the text).  Only blocks up to it are cut.
    """
    text = F.coalesce("_text", F.lit(b""))
    parts = F.greatest(F.ceil(F.octet_length(text) / BLOCK), F.lit(1)).cast("int")
    texts = sample.select("_id", text.alias("_text"), F.xxhash64("_text").alias("_tie"), parts.alias("_parts"))
    places = cut_lineage(
        texts.select("_id", "_tie", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_no"))
        .select(F.xxhash64("_id", "_no").alias("_place"), "_tie")
    )
    last, upto = places, []
    before, width = 0, most + SPARE + 1
    for key in ("_place", "_tie"):
        for shift in SHIFTS:
            if before + width <= most + SPARE:
                break
            bits = F.shiftright(key, shift)
            counts = sorted(last.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect())
            for end, width in counts:
                if before + width >= most:
                    break
                before += width
            else:
                # All rows are among the first.
                return _cut_blocks(texts, lambda place, tie: F.lit(True))
            last = last.where(bits == end)
            upto = [u for u in upto if u[0] != key] + [(key, shift, end)]

    def inside(place: Column, tie: Column) -> Column:
        (_, shift, end), *more = upto
        bits = F.shiftright(place, shift)
        return (bits < end) | ((bits == end) & (F.shiftright(tie, more[0][1]) <= more[0][2])) if more else bits <= end

    return _cut_blocks(texts, inside)


def _cut_blocks(texts: DataFrame, inside: Callable[[Column, Column], Column]) -> DataFrame:
    """The blocks whose place and tie are ``inside``; others are not cut out of their text."""
    numbers = F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda no: inside(F.xxhash64("_id", no), F.col("_tie")))
    blocks = F.transform(numbers, lambda no: F.struct(no.alias("_no"), F.substring("_text", no * BLOCK + 1, F.lit(BLOCK)).alias("_block")))
    return (
        texts.select("_id", "_tie", blocks.alias("_blocks")).select("_id", "_tie", F.explode("_blocks").alias("_b"))
        .select(F.xxhash64("_id", "_b._no").alias("_place"), "_id", "_b._no", "_tie", "_b._block")
    )


def dictionary(blocks: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or where there is too little to train on the blocks themselves."""
    blocks = [b for b in blocks if b]
    size = max(1024, min(size, sum(map(len, blocks)) // 8))
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size]


def score(text: Column, model: Model) -> Column:
    """Probability of a good label of each whole text, as a vectorised column of compressed sizes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores((t.as_py() for t in texts), len(texts), model), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double").asNondeterministic()(text.cast("binary"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, with the columns they came with."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    scored = docs.select(row.alias("_row"), score(F.col(text), model).alias("_score"))
    return scored.where(F.col("_score") >= threshold).select("_row.*")
