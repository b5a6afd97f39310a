"""Fill-in-the-middle by a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its
text and the sentinels.  Cutting splits descriptors, an arrangement permutes the parts and puts a
sentinel before each, and restoring drops the sentinels and applies the inverse permutation.  Hashes
read the descriptors one after the other, so no rearranged text is built for them.

Cuts and form come from the SHA-256 of the seed and the id, so a row is rearranged the same way in any
order, on any task and in any rerun.

Defined results: a NULL text is an empty one; an empty text, and one that holds a sentinel, stays
plain.  A NULL id counts as an empty one.  Rows that repeat an id are cut by the same numbers, each by
its own length.  Other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinels before the prefix, the suffix and the middle (fixed values of the format).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Where the sentinel of each part of a text (prefix, middle, suffix) stands in that buffer.
AT = (0, 6, 3)
#: Which part of a text stands at each place of a form.
FORMS = {"plain": (0,), "psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Buffers of a descriptor.
TEXT, SENTINEL = 0, 1
#: In a hundred: documents that stay plain, and those of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


@dataclass(frozen=True)
class PieceTable:
    """``pieces`` are (buffer, start, length) in bytes of the text or of the sentinels."""

    text: bytes | memoryview
    pieces: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, text: bytes | memoryview) -> PieceTable:
        return cls(text, ((TEXT, 0, len(text)),))

    def cut(self, *places: int) -> PieceTable:
        """Split the descriptors at these offsets of what they describe, in ascending order."""
        left, out, start = list(places), [], 0
        for buffer, at, length in self.pieces:
            while left and left[0] - start <= length:
                head = left.pop(0) - start
                out.append((buffer, at, head))
                at, length, start = at + head, length - head, start + head
            out.append((buffer, at, length))
            start += length
        return PieceTable(self.text, tuple(out))

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix in the order of the form, each behind its sentinel."""
        if form == "plain":
            return self
        out = []
        for part in FORMS[form]:
            out += [(SENTINEL, AT[part], len(PREFIX)), self.pieces[part]]
        return PieceTable(self.text, tuple(out))

    def restored(self, form: str) -> PieceTable:
        """The inverse of ``arranged``: no sentinels, and each part back in its place."""
        if form == "plain":
            return self
        parts = self.pieces[1::2]
        return PieceTable(self.text, tuple(parts[FORMS[form].index(i)] for i in range(len(parts))))

    def stream(self) -> Iterator[memoryview]:
        buffers = memoryview(self.text), memoryview(SENTINELS)
        for buffer, at, length in self.pieces:
            yield buffers[buffer][at : at + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()


def read(output: bytes, form: str) -> PieceTable:
    """The descriptors of a rearranged text: sentinels and parts lie where the sentinels are found.

    The parts hold no sentinel, and no sentinel starts with the end of another, so each is found at its
    first occurrence behind the one before.
    """
    table, places, at = PieceTable.of(output), [], 0
    for part in FORMS[form] if form != "plain" else ():
        sentinel = SENTINELS[AT[part] : AT[part] + len(PREFIX)]
        at = output.index(sentinel, at)
        places += [at, at + len(sentinel)]
        at = places[-1]
    # The output begins with a sentinel, so the first cut leaves an empty piece before it.
    return PieceTable(output, table.cut(*places).pieces[1:] if places else table.pieces)


def rearrange(doc_id: object, text: str, seed: str, plain: int, suffix_first: int) -> tuple[int, str, int | None, int | None, PieceTable]:
    """Code points, form, code points of prefix and middle, and descriptors of one document."""
    data, n = text.encode(), len(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    table = PieceTable.of(data)
    if not n or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, table
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    # Cuts are counted in code points; descriptors in bytes.
    if len(data) == n:
        places = first, second
    else:
        head = len(text[:first].encode())
        places = head, head + len(text[first:second].encode())
    form = "spm" if h4 % 100 < suffix_first else "psm"
    return n, form, first, second - first, table.cut(*places).arranged(form)


def fill_in_middle(
    doc_id: Column, text: Column, seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST,
) -> Column:
    """A struct for each whole text: ``n`` code points, ``form``, ``prefix_chars`` and ``middle_chars``
    (NULL if plain), the ``output`` and the SHA-256 of its bytes."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            rows = [rearrange(i.as_py(), t.as_py() or "", seed, plain, suffix_first) for i, t in zip(ids, texts)]
            n, form, prefix, middle, tables = zip(*rows) if rows else [()] * 5
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                 pa.array([b"".join(t.stream()).decode() for t in tables], pa.string()),
                 pa.array([t.sha256() for t in tables], pa.string())],
                names=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"],
            )

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    kind = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string,output_sha256:string>"
    return F.arrow_udf(run, kind).asNondeterministic()(doc_id, text)


def restore(output: Column, form: Column) -> Column:
    """A struct for each rearranged text: the exact ``text`` and the SHA-256 of its bytes, NULL for NULL."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            tables = [
                None if o is None or f is None else read(o.encode(), f).restored(f)
                for o, f in ((o.as_py(), f.as_py()) for o, f in zip(outputs, forms))
            ]
            yield pa.StructArray.from_arrays(
                [pa.array([t and b"".join(t.stream()).decode() for t in tables], pa.string()),
                 pa.array([t and t.sha256() for t in tables], pa.string())],
                names=["text", "sha256"],
            )

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<text:string,sha256:string>").asNondeterministic()(output, form)
