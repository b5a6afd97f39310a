"""Vector codes, fill-in-the-middle and sum-of-squares packing, held against written-out versions."""

import hashlib
import random
from collections import Counter, defaultdict
from math import floor

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passbook.llm import level_packing, piece_table, vector_codes

# Vector codes


def full_search(rows, parts, entries, rounds, scale=4096):
    """Plain Python: rows (id, v, label) in order; codes, errors, label errors and the codebooks."""
    whole = [[floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in v] for _, v, _ in rows]
    width = len(whole[0])
    cuts = [width * p // parts for p in range(parts + 1)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[whole[i][a:b] for i in order] for a, b in zip(cuts, cuts[1:])]

    def nearest(book, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for book, a, b in zip(books, cuts, cuts[1:]):
            mine = defaultdict(list)
            for v in whole:
                mine[nearest(book, v[a:b])[1]].append(v[a:b])
            for e, parts_of in mine.items():
                book[e] = [sum(c) // len(parts_of) for c in zip(*parts_of)]
    out, totals = [], Counter()
    for (i, _, label), v in zip(rows, whole):
        best = [nearest(book, v[a:b]) for book, a, b in zip(books, cuts, cuts[1:])]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        totals[label] += out[-1][2]
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    most = (1 << 63) - 1
    return (
        Counter((i, code, min(error, most), min(totals[label], most)) for i, code, error, label in out),
        hashlib.sha256(flat.encode()).hexdigest(),
    )


def codes_of(spark, rows, kind="array<float>", **how):
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], f"vec_id long, embedding {kind}, label int, code string, _label int")
    found, books = vector_codes.compress(table.repartition(3), **how)
    return Counter(map(tuple, found.collect())), books.sha256()


def test_codes_equal_full_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] + rng.normal(size=12) * 0.1).astype(np.float32).tolist(), i % 3 or None) for i in range(300)]
    rows += [(900, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[4][1], None), (901, [0.0] * 12, 2), (902, [-0.0] * 12, 2)]
    out = [(910, None, 1), (911, [None] * 12, 1), (912, [float("nan")] + [0.0] * 11, 1), (913, [float("inf")] + [0.0] * 11, 1),
           (914, [1.0], 1), (915, [], 1)]
    for how in ({"parts": 4, "entries": 6, "rounds": 3}, {"parts": 5, "entries": 16, "rounds": 2, "side": 100}):
        assert codes_of(spark, rows + out, **how) == full_search(rows, how["parts"], how["entries"], how["rounds"])


def test_codes_of_few_and_great_values(spark):
    # Fewer rows than entries, ties, and values beyond exact doubles and longs.
    rows = [(1, [0.5, -0.25, 3.0, 0.0], 1), (2, [0.5, -0.25, 3.0, 0.0], 1), (3, [-1e-9, 1e-9, 0.5, 0.25], None)]
    assert codes_of(spark, rows, parts=2, rounds=2) == full_search(rows, 2, 16, 2)
    rows += [(4, [3e38, -3e38, 1.0, 2.0], 1), (5, [-3e38, 2e9, 1.0, 2.0], 2), (6, [2e9, 5e8, -2e9, 1e4], 1), (7, [2e9, 4e8, 1e9, 1e4], 1)]
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in rows]
    assert codes_of(spark, rows, parts=2, entries=3, rounds=2) == full_search(rows, 2, 3, 2)
    doubles = rows + [(8, [1e305, -1e308, 1.0, 5e-324], None)]
    assert codes_of(spark, doubles, "array<double>", parts=2, entries=4, rounds=2) == full_search(doubles, 2, 4, 2)
    empty, books = vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert empty.count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        vector_codes.compress(empty, entries=257)


def test_cells_evaluate_only_what_is_not_dominated():
    rng = np.random.default_rng(4)
    entries = rng.integers(-30000, 30000, (16, 8)).astype(float)
    points = (entries[rng.integers(0, 16, 20000)] + rng.integers(-60, 60, (20000, 8))).astype(float)
    cells = vector_codes.Cells(entries)
    found, distance = cells.nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (distance == every.min(1)).all()
    # Clustered parts: few cells, and little more than one entry evaluated of 16.
    assert len(cells.kept) < 2500 and cells.evaluated < 1.3 * len(points)
    # A memory of few cells is emptied and gives the same.
    small = vector_codes.Cells(entries, most=50)
    assert (small.nearest(points)[0] == found).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=2, max_size=2), min_size=1, max_size=30), st.integers(1, 6), st.integers(1, 8))
def test_cells_keep_ties(points, entries, side):
    at = np.array(points, float)
    cells = vector_codes.Cells(at[:entries], side)
    found, distance = cells.nearest(at)
    for p, e, d in zip(points, found, distance):
        assert (d, e) == min((sum((x - y) ** 2 for x, y in zip(p, q)), i) for i, q in enumerate(points[:entries]))


# Fill-in-the-middle

CUT_TEXTS = [None, "", "a", "ab", "naïve 日本語 🙂🙂 text", "x<P>y", "<S>", "end <M", "<", "<P", "S>", "P>M><", "\x00z", "word " * 40_000, "日" * 5001]


def rearranged(doc_id, text):
    """Plain Python by slices of code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h[3] % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_fill_in_middle(spark):
    rows = [(i * 100 + j, t, "plain", 5) for i, t in enumerate(CUT_TEXTS) for j in range(25)] + [(None, "no id", "k", 1)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, form string, output long")
    cut = table.select("doc_id", "text", piece_table.fill_in_middle(F.col("doc_id"), F.col("text")).alias("c"))
    back = cut.withColumn("r", piece_table.restore(F.col("c.output"), F.col("c.form"))).collect()
    assert len(back) == len(rows)
    forms = Counter()
    for r in back:
        n, form, prefix, middle, output = rearranged(r.doc_id, r.text)
        assert tuple(r.c) == (n, form, prefix, middle, output, hashlib.sha256(output.encode()).hexdigest())
        assert r.r.text == (r.text or "") and r.r.sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        forms[form] += 1
    assert min(forms.values()) > 20 and len(forms) == 3
    none = table.limit(0).select(piece_table.fill_in_middle(F.col("doc_id"), F.col("text")))
    assert none.count() == 0
    assert table.limit(1).select(piece_table.restore(F.lit(None), F.lit("psm")).alias("r")).first().r.text is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSM a日", max_size=30), st.integers(0, 10**6))
def test_piece_table_round_trip(text, doc_id):
    n, form, _, _, table = piece_table.rearrange(doc_id, text, "s", 10, 20)
    output = b"".join(table.stream())
    assert table.restored(form).sha256() == hashlib.sha256(text.encode()).hexdigest()
    again = piece_table.read(output, form)
    assert b"".join(again.restored(form).stream()).decode() == text and n == len(text)
    assert again.sha256() == table.sha256()


def test_cut_splits_descriptors():
    table = piece_table.PieceTable.of(b"abcdef").cut(2, 2, 5)
    assert [bytes(p) for p in table.stream()] == [b"ab", b"", b"cde", b"f"]
    assert [p[2] for p in table.cut(1, 4).pieces] == [1, 1, 0, 2, 1, 1]
    assert all(p[0] == piece_table.TEXT for p in table.pieces)


# Sum of squares


def test_best_level_against_all_sums():
    """The level taken leaves the smallest sum of squares of all levels that can be taken."""
    rng = random.Random(5)
    levels = level_packing.Levels(40)
    for step in range(4000):
        tokens = rng.choice([3, 7, 11, 13, 40, rng.randrange(1, 41)])
        counts = Counter({level: len(w) for level, w in levels.windows.items()})

        def after(level):
            left = counts.copy()
            if level:
                left[level] -= 1
            if level + tokens < 40:
                left[level + tokens] += 1
            return sum(c * c for c in left.values())

        options = [0] + [level for level in counts if level + tokens <= 40]
        taken = levels.best(tokens)
        assert taken in options and after(taken) == min(map(after, options))
        assert taken == max(level for level in options if after(level) == after(taken))
        full = levels.place((step, 0, b"\0" * 4 * tokens, tokens))
        assert (full is not None) == (taken + tokens == 40)
        assert levels.open == levels.counts.sum() == sum(map(len, levels.windows.values()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 12))
def test_sequences_hold_every_token_once(sizes, most_open):
    documents = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(sizes)]
    seen, lengths = defaultdict(list), []
    for pieces in level_packing.sequences(iter(documents), 32, most_open):
        lengths.append(sum(map(level_packing.size, pieces)))
        for doc_id, start, ids, whole in pieces:
            assert whole == sizes[doc_id] and ids
            assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + len(ids) // 4))
            seen[doc_id] += range(start, start + len(ids) // 4)
    assert {d: sorted(t) for d, t in seen.items()} == {d: list(range(n)) for d, n in enumerate(sizes)}
    # Nothing is padded: a sequence is full, or its length is a power of two; at most one of each power is short.
    short = [n for n in lengths if n != 32]
    assert all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short))


def test_one_length_is_cut_and_bounded():
    """A third of a window over and over fits; two thirds do not, and are cut when too many are open."""
    levels, most = level_packing.Levels(30), 0
    for i in range(1000):
        levels.place((i, 0, b"\0" * 80, 20))
        if levels.open > 64:
            assert sum(1 for _ in levels.settle()) >= 42
        most = max(most, levels.open)
    assert most <= 65
    cut = list(level_packing.sequences(((i, b"\0" * 80) for i in range(1000)), 30, 64))
    assert sum(len(p) for p in cut) < 2500


def test_pack_columns(spark):
    vocabulary = P.path("byte_bpe_50k.json")
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["tree", "lamp", "éclair", "x1"]) for _ in range(rng.choice([0, 3, 40, 900, 1500, 9000])))) for i in range(80)]
    rows += [(500, None), (501, ""), (3, "twice"), (None, "no id"), (502, "a <|endoftext|> b"), (503, "long " * 100_000)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length long, _id long").repartition(3)
    found = level_packing.pack(table, vocabulary, P.PATTERN, 1).collect()
    library = Tokenizer.from_file(vocabulary)
    wanted = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    places, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 2048
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 2048 and (end == 2048 or end & (end - 1) == 0)
    for doc_id in {r[0] for r in rows} - {3}:
        parts = sorted(pieces[doc_id], key=lambda r: r.start)
        ids = tuple(np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist())
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert all(p.doc_tokens == len(ids) for p in parts) and wanted[doc_id, ids] == 1
    assert sum(r.length for r in pieces[3]) == sum(len(ids) * n for (i, ids), n in wanted.items() if i == 3)
    assert level_packing.pack(table.limit(0), vocabulary, P.PATTERN, 1).count() == 0
