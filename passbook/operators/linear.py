"""One-vs-rest averaged passive-aggressive classifier over sparse features.

A fit makes the exact sequential pass over all labelled rows of a ledger.  The pass keeps the weights
and the names of the features in memory; vectors, labels and the order of the rows stream into scratch
files of the task and are read from there, so a ledger may be larger than the memory of a task.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, MutableSequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.operators.features import DOC
from passbook.session import cut_lineage

# Training constants (fixed values).
EPOCHS = 12
STEP_CAP = 0.25
SHUFFLE_SEED = 0x9E3779B9

# Classes trained together; more classes make more tasks, with the same result.
CLASS_BLOCK = 32

# Bytes of the weights that a task trains at a time.
FIT_BYTES = 128 << 20
# Rows without loss after which the losses of the next rows are found together, for so many rows at most.
CALM = 16
AHEAD = 1 << 14
# Documents of a ledger up to which their products are kept.
TABLE_DOCS = 256
# Stands for a NULL document, which has no vector.
NO_DOC = np.iinfo(np.int64).min
# Rows that are read from a scratch file at a time.
PART = 1 << 20

# Documents scored together, their feature values, and scores that a task holds at a time.
DOCS = 512
DOC_ENTRIES = 1 << 20
SCORES = 1 << 22

_WEIGHTS = "ledger_id string, class long, feature string, weight double"
_WEIGHTS_ARROW = pa.schema([("ledger_id", pa.string()), ("class", pa.int64()), ("feature", pa.string()), ("weight", pa.float64())])
# What a row sent to a fit is: the classes of a block, a document with its vector, or a labelled row.
_CLASSES, _VECTOR, _LABELLED = range(3)


def _draws(seed: int = SHUFFLE_SEED) -> Iterator[int]:
    """The 32-bit xorshift sequence with shifts 13, 17, 5."""
    x = seed
    while True:
        x = (x ^ (x << 13)) & 0xFFFFFFFF
        x ^= x >> 17
        x = (x ^ (x << 5)) & 0xFFFFFFFF
        yield x


def _reshuffled(order: MutableSequence[int], draws: Iterator[int]) -> None:
    """Fisher-Yates from the back, in place."""
    for last in range(len(order) - 1, 0, -1):
        other = next(draws) % (last + 1)
        order[last], order[other] = order[other], order[last]


@dataclass
class Labelled:
    """Vectors of documents one after the other, and the document and label of each row; arrays or files.

    ``room`` gives an array of zeros by name, type and shape, which may be a file as well.
    """

    starts: np.ndarray
    codes: np.ndarray
    values: np.ndarray
    doc: np.ndarray
    label: np.ndarray
    room: Callable[[str, type, tuple[int, ...]], np.ndarray] = lambda name, kind, shape: np.zeros(shape, kind)

    def vector(self, doc: int) -> tuple[np.ndarray, np.ndarray]:
        begin, end = self.starts[doc : doc + 2].tolist()
        return self.codes[begin:end], self.values[begin:end]


class _Weights:
    """Weights (feature, class) and biases of a pass."""

    def __init__(self, rows: Labelled, width: int, classes: int) -> None:
        self.rows, self.sums, self.bias = rows, np.zeros((width, classes)), np.zeros(classes)

    def scores(self, doc: int) -> np.ndarray:
        self.code, self.value = self.rows.vector(doc)
        self.met = self.sums.take(self.code, axis=0)
        return self.value @ self.met + self.bias

    def add(self, doc: int, delta: np.ndarray) -> None:
        """Add ``delta`` times the vector of the document whose scores were the last ones asked for."""
        self.sums[self.code] = self.met + self.value[:, None] * delta
        self.bias += delta

    def refresh(self) -> None:
        pass

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sums, self.bias


class _Table:
    """The same where documents are few: their scores are kept, and a change reaches those of all by their products."""

    def __init__(self, rows: Labelled, width: int, classes: int) -> None:
        docs = len(rows.starts) - 1
        self.rows, self.width = rows, width
        self.parts, self.table = np.zeros((docs, classes)), np.zeros((docs, classes))
        self.products = np.ones((docs, docs))
        dense = np.zeros(width)
        for doc in range(docs):
            code, value = rows.vector(doc)
            dense[code] = value
            for other in range(docs):
                code_of, value_of = rows.vector(other)
                self.products[doc, other] += float(dense[code_of] @ value_of)
            dense[code] = 0.0

    def scores(self, doc: int) -> np.ndarray:
        return self.table[doc]

    def add(self, doc: int, delta: np.ndarray) -> None:
        self.parts[doc] += delta
        self.table += self.products[doc, :, None] * delta

    def refresh(self) -> None:
        """Without the rounding of the changes so far."""
        self.table = self.products @ self.parts

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return _spread(self.rows, self.parts, self.width), self.parts.sum(axis=0)


def _spread(rows: Labelled, parts: np.ndarray, width: int) -> np.ndarray:
    """(feature, class) sums of the vectors of all documents times their (document, class) parts."""
    found = np.zeros((width, parts.shape[1]))
    for doc in range(len(parts)):
        code, value = rows.vector(doc)
        found[code] += value[:, None] * parts[doc]
    return found


def fit_block(rows: Labelled, classes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Averaged weights (feature, class) and biases of the given classes, in ascending order.

    The mean over all steps of a weight is the last weight less a correction: a change by ``delta`` at
    step s misses the average of the steps up to s.  Corrections are summed per document and reach the
    weights at the end.

    Rows on the right side of every class change nothing, so in a run of them the losses of the next
    rows are found together, and the pass goes on at the first row that has one.
    """
    count, docs = len(rows.label), len(rows.starts) - 1
    # Place of the label of a row; that of a class trained elsewhere is after all others.
    kinds = rows.room("kinds", np.int32, (count,))
    members = np.zeros(len(classes) + 1)
    for begin in range(0, count, PART):
        label = rows.label[begin : begin + PART]
        place = np.searchsorted(classes, label)
        place[classes[np.minimum(place, len(classes) - 1)] != label] = len(classes)
        kinds[begin : begin + PART] = place
        members += np.bincount(place, minlength=len(members))
    target = np.where(np.eye(len(classes) + 1, len(classes)) > 0, 1.0, -1.0)
    with np.errstate(divide="ignore"):
        cap = STEP_CAP * np.where(target > 0, count / (2.0 * members[:-1]), count / (2.0 * (count - members[:-1])))
    size = rows.room("size", np.float64, (docs,))
    for doc in range(docs):
        value = rows.vector(doc)[1]
        size[doc] = 1.0 + float(value @ value)
    state = (_Table if docs <= TABLE_DOCS else _Weights)(rows, width, len(classes))
    late = rows.room("late", np.float64, (docs, len(classes)))
    order = rows.room("order", np.int32, (count,))
    order[:] = np.arange(count)
    draws, step, calm = _draws(), 0, 0
    place, doc_of, kind_of, sizes = memoryview(order), memoryview(rows.doc), memoryview(kinds), memoryview(size)
    for _ in range(EPOCHS):
        _reshuffled(place, draws)
        state.refresh()
        at = 0
        while at < count:
            if calm >= CALM:
                skipped = _calm_rows(rows, kinds, order[at : at + calm], target, state)
                at += skipped
                step += skipped
                # A row with a loss is the next one, unless all were without.
                calm = min(2 * calm, AHEAD) if skipped == calm else 0
                if at == count:
                    break
            row = place[at]
            doc, kind = doc_of[row], kind_of[row]
            loss = np.maximum(1.0 - target[kind] * state.scores(doc), 0.0)
            if loss.any():
                delta = np.minimum(loss / sizes[doc], cap[kind]) * target[kind]
                state.add(doc, delta)
                late[doc] += step * delta
                calm = 0
            else:
                calm += 1
            at += 1
            step += 1
    weights, bias = state.whole()
    # A weight set at step s is in force for the steps after it and the closing one.
    return (step * weights - _spread(rows, late, width)) / step, (step * bias - late.sum(axis=0)) / step


def _calm_rows(rows: Labelled, kinds: np.ndarray, part: np.ndarray, target: np.ndarray, state: _Weights | _Table) -> int:
    """How many of the next rows are without loss before the first that has one."""
    docs, place = np.unique(rows.doc[part], return_inverse=True)
    losses = np.empty((len(docs), len(target)), bool)
    for i, doc in enumerate(docs.tolist()):
        losses[i] = (1.0 - target * state.scores(doc) > 0.0).any(axis=1)
    wrong = losses[place, kinds[part]]
    first = int(wrong.argmax())
    return first if wrong[first] else len(part)


class _Fit:
    """The rows of one (ledger, block of classes), collected into scratch files."""

    _FILES = {"codes": np.int32, "values": np.float64, "starts": np.int64, "docs": np.int64, "asked": np.int64, "label": np.int64}

    def __init__(self, ledger: str | None, classes: list[int]) -> None:
        self.ledger, self.classes = ledger, np.array(sorted(classes), dtype=np.int64)
        self.names: dict[str, int] = {}
        self.entries = 0
        self.folder = tempfile.TemporaryDirectory(prefix="fit-")
        self.files = {n: open(f"{self.folder.name}/{n}", "wb") for n in self._FILES}
        self._write("starts", np.zeros(1))

    def _write(self, name: str, found: np.ndarray) -> None:
        self.files[name].write(np.ascontiguousarray(found, dtype=self._FILES[name]).data)

    def _read(self, name: str) -> np.ndarray:
        self.files[name].close()
        path, kind = f"{self.folder.name}/{name}", self._FILES[name]
        # An empty file cannot be mapped.
        return np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.zeros(0, kind)

    def add_vectors(self, docs: np.ndarray, features: pa.ListArray, weights: pa.ListArray) -> None:
        """Documents in ascending order, with the names and values of their features."""
        flat = features.flatten().dictionary_encode()
        known = np.fromiter(
            (self.names.setdefault(n, len(self.names)) for n in flat.dictionary.to_pylist()), np.int32, len(flat.dictionary)
        )
        self._write("codes", known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else known)
        self._write("values", weights.flatten().to_numpy(zero_copy_only=False))
        ends = self.entries + np.cumsum(features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        self._write("starts", ends)
        self._write("docs", docs)
        self.entries += len(flat)

    def add_rows(self, docs: np.ndarray, labels: np.ndarray) -> None:
        """Labelled rows in the order of their ids; a document without vector has no features."""
        self._write("asked", docs)
        self._write("label", labels)

    def _room(self, name: str, kind: type, shape: tuple[int, ...]) -> np.ndarray:
        path = f"{self.folder.name}/{name}-{uuid.uuid4().hex}"
        return np.asarray(np.memmap(path, kind, "w+", shape=shape)) if all(shape) else np.zeros(shape, kind)

    def _rows(self) -> Labelled:
        starts, codes, values, known, asked, label = map(self._read, ("starts", "codes", "values", "docs", "asked", "label"))
        # One more place, that of no features, for documents without vector.
        starts = np.append(starts, starts[-1:])
        doc = self._room("doc", np.int32, (len(asked),))
        for begin in range(0, len(asked), PART):
            part = asked[begin : begin + PART]
            place = np.searchsorted(known, part)
            found = place < len(known)
            found[found] = known[place[found]] == part[found]
            doc[begin : begin + len(part)] = np.where(found, place, len(known))
        return Labelled(starts, codes, values, doc, label, self._room)

    def run(self) -> Iterator[pa.RecordBatch]:
        """The weights; the bias goes under the empty feature name."""
        rows, width = self._rows(), len(self.names)
        if not len(rows.label):
            return
        names = pa.array(list(self.names), pa.string())
        self.names = {}
        # Classes do not depend on each other: as many at a time as the two matrices have room for.
        at_once = max(1, FIT_BYTES // (16 * max(1, width)))
        for start in range(0, len(self.classes), at_once):
            classes = self.classes[start : start + at_once]
            averaged, bias = fit_block(rows, classes, width)
            for low in range(0, width, 1 << 16):
                where, which = np.nonzero(averaged[low : low + (1 << 16)])
                yield self._batch(classes[which], names.take(pa.array(low + where)), averaged[low + where, which])
            yield self._batch(classes, pa.array([""] * len(classes), pa.string()), bias)

    def _batch(self, classes: np.ndarray, features: pa.Array, weights: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([self.ledger] * len(classes), pa.string()), pa.array(classes), features, pa.array(weights)], schema=_WEIGHTS_ARROW
        )

    def close(self) -> None:
        for file in self.files.values():
            file.close()
        self.folder.cleanup()


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Train each (ledger, block of classes); its classes come first, then its documents, then its labelled rows."""
    fit: _Fit | None = None
    try:
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            ends = [*(np.flatnonzero(np.diff(kinds)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            begin = 0
            for end in ends:
                part = batch.slice(begin, end - begin)
                if kinds[begin] == _CLASSES:
                    # A block without rows may be followed by the next one.
                    for ledger, classes in zip(part.column("ledger_id").to_pylist(), part.column("classes").to_pylist()):
                        if fit is not None:
                            yield from fit.run()
                            fit.close()
                        fit = _Fit(ledger, classes)
                elif kinds[begin] == _VECTOR:
                    fit.add_vectors(part.column("doc").to_numpy(), part.column("features"), part.column("weights"))
                else:
                    fit.add_rows(part.column("doc").fill_null(NO_DOC).to_numpy(), part.column("category_id").to_numpy())
                begin = end
        if fit is not None:
            yield from fit.run()
    finally:
        if fit is not None:
            fit.close()


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Train one (ledger, block of classes) that is given as a frame, a document a row."""
    pdf = pdf.sort_values("id", kind="stable")
    fit = _Fit(pdf["ledger_id"].iloc[0], list(pdf["classes"].iloc[0]))
    try:
        docs = np.arange(len(pdf))
        lists = pa.array(pdf["features"].tolist(), pa.list_(pa.string())), pa.array(pdf["weights"].tolist(), pa.list_(pa.float64()))
        fit.add_vectors(docs, *lists)
        fit.add_rows(docs, pdf["category_id"].to_numpy())
        return pa.Table.from_batches(list(fit.run()), _WEIGHTS_ARROW).to_pandas()
    finally:
        fit.close()


def fit_sample(
    examples: DataFrame, vectors: DataFrame, fit_rows: int | None = None, fit_entries: int | None = None
) -> DataFrame:
    """The labelled rows of each ledger that a fit reads: all, or as many as a caller asks for, the same ones in every run.

    The bound on a row number cuts each partition before the shuffle.
    """
    if fit_rows is None and fit_entries is None:
        return examples
    order = Window.partitionBy("ledger_id").orderBy(F.xxhash64("id"), "id")
    chosen = examples.withColumn("_place", F.row_number().over(order))
    if fit_rows is not None:
        chosen = chosen.filter(F.col("_place") <= fit_rows)
    if fit_entries is not None:
        per_doc = vectors.groupBy(*DOC).agg(F.count(F.lit(1)).alias("_k"))
        running = F.sum(F.coalesce("_k", F.lit(0))).over(Window.partitionBy("ledger_id").orderBy("_place"))
        chosen = chosen.join(per_doc, DOC, "left").withColumn("_entries", running)
        chosen = chosen.filter((F.col("_entries") <= fit_entries) | (F.col("_place") == 1))
    return chosen.select(*examples.columns)


def train_linear(
    examples: DataFrame,
    vectors: DataFrame,
    class_block: int = CLASS_BLOCK,
    fit_rows: int | None = None,
    fit_entries: int | None = None,
) -> DataFrame:
    """(ledger_id, class, feature, weight); feature ``''`` is the bias.

    ``examples`` rows are (ledger_id, id, doc, category_id), ``vectors`` the
    long feature table of their documents.  All examples are read, unless the
    caller bounds them.  A ledger whose examples have one class or no feature
    gets no model.
    """
    sample = fit_sample(examples.filter(F.col("category_id").isNotNull()), vectors, fit_rows, fit_entries)
    # Only documents of the examples are packed; sorted, so that each run adds up in the same order.
    packed = cut_lineage(
        vectors.join(sample.select(*DOC).distinct(), DOC, "left_semi")
        .groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("feature", "weight"))).alias("_f"))
        .select(*DOC, "_f.feature", "_f.weight")
    )
    kinds = (
        sample.groupBy("ledger_id")
        .agg(F.sort_array(F.collect_set("category_id")).alias("_classes"))
        .filter(F.size("_classes") > 1)
        .join(packed.select("ledger_id").distinct(), "ledger_id")
    )
    # One row a ledger and block, stored so that its size decides how it is joined.
    blocks = cut_lineage(kinds.select(
        "ledger_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size("_classes") - 1) / class_block).cast("int")),
                lambda i: F.slice("_classes", i * class_block + 1, F.lit(class_block)),
            )
        ).alias("block", "classes"),
    ))

    def sent(rows: DataFrame, kind: int, **columns: str) -> DataFrame:
        """These rows for each block of their ledger, in the common form."""
        held = {"id": "long", "doc": "long", "category_id": "long", "classes": "array<long>", "features": "array<string>", "weights": "array<double>"}
        given = [F.col(columns[n]).cast(t).alias(n) if n in columns else F.lit(None).cast(t).alias(n) for n, t in held.items()]
        return rows.select("ledger_id", "block", F.lit(kind).alias("kind"), *given)

    of_block = blocks.select("ledger_id", "block")
    rows = (
        sent(blocks, _CLASSES, classes="classes")
        .unionByName(sent(packed.join(of_block, "ledger_id"), _VECTOR, doc="doc", features="feature", weights="weight"))
        .unionByName(sent(sample.join(of_block, "ledger_id"), _LABELLED, id="id", doc="doc", category_id="category_id"))
    )
    # Training is heavy per row, so its shuffle keeps all partitions however small.
    parts = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "ledger_id", "block").sortWithinPartitions("ledger_id", "block", "kind", "id", "doc")
    return dealt.drop("block", "id").mapInArrow(_fit_rows, _WEIGHTS)


def top_two(docs: np.ndarray, features: np.ndarray, values: np.ndarray, count: int, weights: tuple[np.ndarray, ...],
            bias: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the two best classes of each document (the lower of equals first) and their scores.

    Entries (document, feature, value) are sorted by document; ``weights`` are (feature, class,
    weight).  A block of classes is scored at a time and its best two are merged with those before.
    """
    feature, kind, weight = weights
    order = np.argsort(kind, kind="stable")
    feature, kind, weight = feature[order], kind[order], weight[order]
    block = max(1, SCORES // max(len(docs), width, count, 1))
    firsts = np.flatnonzero(np.diff(docs, prepend=-1)) if len(docs) else np.empty(0, int)
    best, scores = np.zeros((count, 2), int), np.full((count, 2), -np.inf)
    rows = np.arange(count)
    for low in range(0, len(bias), block):
        high = min(low + block, len(bias))
        part = slice(*np.searchsorted(kind, [low, high]))
        dense = np.zeros((width, high - low))
        dense[feature[part], kind[part] - low] = weight[part]
        found = np.tile(bias[low:high], (count, 1))
        if len(docs):
            found[docs[firsts]] += np.add.reduceat(values[:, None] * dense[features], firsts, axis=0)
        # Earlier classes come first, so that the first of equals is the lowest.
        both = np.concatenate([scores, found], axis=1)
        ids = np.concatenate([best, np.tile(np.arange(low, high), (count, 1))], axis=1)
        for place in (0, 1):
            at = both.argmax(1)
            best[:, place], scores[:, place] = ids[rows, at], both[rows, at]
            both[rows, at] = -np.inf
    return best, scores


def _score_group(left: pa.Table, right: pa.Table) -> pa.Table:
    """Best class and its lead for each document of a group, from the weights of its features and all biases."""
    left = left.sort_by("doc")
    names = pa.chunked_array([*left["feature"].chunks, *right["feature"].chunks], pa.string()).combine_chunks().dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    mine, theirs = codes[: len(left)], codes[len(left) :]
    docs, place = np.unique(left["doc"].to_numpy(), return_inverse=True)
    blank = {"": i for i, n in enumerate(names.dictionary.to_pylist()) if n == ""}.get("", -1)
    is_bias = theirs == blank
    kinds, weights = right["class"].to_numpy(), right["_w"].to_numpy()
    classes, at = np.unique(kinds[is_bias], return_inverse=True)
    bias = np.zeros(len(classes))
    bias[at] = weights[is_bias]
    known = ~is_bias & np.isin(kinds, classes)
    used = mine != blank
    triple = theirs[known], np.searchsorted(classes, kinds[known]), weights[known]
    best, scores = top_two(place[used], mine[used], left["weight"].to_numpy()[used], len(docs), triple, bias, len(names.dictionary))
    lead = np.where(np.isfinite(scores[:, 1]), scores[:, 0] - scores[:, 1], np.abs(scores[:, 0]))
    return pa.table({
        "ledger_id": pa.array([left["ledger_id"][0].as_py()] * len(docs), pa.string()), "doc": pa.array(docs, pa.int64()),
        "category_id": pa.array(classes[best[:, 0]], pa.int64()), "lead": pa.array(lead, pa.float64()),
    })


def _score_pair(left: pa.Table, right: pa.Table) -> pa.Table:
    if not len(left) or not len(right):
        return pa.table({n: pa.array([], k) for n, k in (("ledger_id", pa.string()), ("doc", pa.int64()), ("category_id", pa.int64()), ("lead", pa.float64()))})
    return _score_group(left, right)


_score_pair.__annotations__ = {"left": pa.Table, "right": pa.Table, "return": pa.Table}


def predict_linear(docs: DataFrame, vectors: DataFrame, model: DataFrame) -> DataFrame:
    """(ledger_id, doc, category_id, confidence) of each document in a ledger with a model.

    The best class by w . x + b; its lead over the runner-up sets a confidence
    of 0.5 to 0.9.  A document without a known feature is judged by the biases.

    Documents are scored in groups of about ``DOCS`` with about ``DOC_ENTRIES`` feature values.  A group fetches
    the weights of each of its features once, so a common n-gram is joined once a group and not once a document.
    """
    key = ["ledger_id", "group"]
    bias = model.filter(F.col("feature") == "")
    # A document without features has one entry of weight zero under the name of the biases.
    entries = cut_lineage(
        docs.select(*DOC, F.lit("").alias("feature"), F.lit(0.0).alias("weight"))
        .unionByName(vectors.select(*DOC, "feature", "weight"))
        .join(bias.select("ledger_id").distinct(), "ledger_id", "left_semi")
    )
    many = F.greatest(F.count(F.when(F.col("feature") == "", 1)) / DOCS, F.count(F.lit(1)) / DOC_ENTRIES)
    # One row a ledger, stored so that its size decides how it is joined.
    sizes = cut_lineage(entries.groupBy("ledger_id").agg(F.ceil(many).cast("int").alias("_groups")))
    group = F.pmod(F.xxhash64("doc"), F.col("_groups")).cast("int").alias("group")
    left = entries.join(sizes, "ledger_id").select("ledger_id", group, "doc", "feature", "weight")
    weights = model.select("ledger_id", "feature", "class", F.col("weight").alias("_w"))
    fetched = left.select(*key, "feature").distinct().join(weights, ["ledger_id", "feature"])
    # New names, as both sides stem from one table.
    right = fetched.select(F.col("ledger_id").alias("_ledger"), F.col("group").alias("_group"), F.col("feature").alias("feature"), "class", "_w")
    scored = left.groupBy(*key).cogroup(right.groupBy("_ledger", "_group")).applyInArrow(
        _score_pair, "ledger_id string, doc bigint, category_id bigint, lead double"
    )
    sigmoid = 1 / (1 + F.exp(-F.greatest(F.col("lead"), F.lit(0.0))))
    return scored.select(*DOC, "category_id", (0.5 + 0.4 * (2 * sigmoid - 1)).alias("confidence"))
