"""BPE, packing and sharding: exact round trips and placement laws."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passbook.llm import bpe, packing, sharding

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "", " ", "\n", "a", " lead and trail ", "it's  12 34ab\n\n  x\u3000y z\x1c w", "The <|endoftext|> stands.", "naïve 日本語 🙂🙂",
    "a" * 3000, "ab" * 900 + "aba" * 400, "Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch" * 9, "\u00a0\u2003x  y\t\tz", "1" * 700,
]


@pytest.mark.parametrize("leaf", [1, 3, 12])
def test_monoid_equals_library(leaf):
    monoid = bpe.Monoid(RANKS, P.PATTERN, leaf)
    for text in TEXTS:
        ids = np.frombuffer(monoid.encode(text), np.uint32).tolist()
        assert ids == LIBRARY.encode_ordinary(text), text[:40]
        assert monoid.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abetionsh ' \nÉ語12", max_size=80), st.integers(1, 5))
def test_monoid_property(text, leaf):
    monoid = bpe.Monoid(RANKS, P.PATTERN, leaf)
    assert np.frombuffer(monoid.encode(text), np.uint32).tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "ba", "aa", "abb"]), min_size=2, max_size=60), st.randoms())
def test_join_of_small_vocabulary(parts, rng):
    """Any cut of any string joins to the encoding of the whole, whatever the ranks."""
    data = "".join(parts).encode()
    tokens = [b"a", b"b", b"aa", b"ab", b"ba", b"bb", b"aab", b"aba", b"abab", b"baa", b"aaaa"]
    made = tokens[2:]
    rng.shuffle(made)
    # A token must be made of tokens of lower rank.
    ranks = {b"a": 0, b"b": 1}
    for _ in range(4):
        for t in made:
            if t not in ranks and any(t[:i] in ranks and t[i:] in ranks for i in range(1, len(t))):
                ranks[t] = len(ranks)
    monoid = bpe.Monoid(ranks, ".+", 1)
    cut = rng.randrange(1, len(data))
    assert monoid.join(monoid.merge(data[:cut]), monoid.merge(data[cut:])) == monoid.merge(data) == monoid.reduce(data)


def test_bpe_columns(spark):
    rows = [(i, t, 1) for i, t in enumerate([*TEXTS, None])]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    found = table.select("doc_id", bpe.encode(F.col("text"), path, P.PATTERN).alias("ids")).select(
        "*", bpe.decode(F.when(F.col("doc_id") != 3, F.col("ids")), path, P.PATTERN).alias("back")
    )
    for r in found.collect():
        text = rows[r.doc_id][1] or ""
        assert r.ids == LIBRARY.encode_ordinary(text)
        assert r.back is None if r.doc_id == 3 else bytes(r.back) == text.encode()
    for r in table.select("doc_id", bpe.round_trip(F.col("text"), path, P.PATTERN).alias("c")).select("doc_id", "c.*").collect():
        text = rows[r.doc_id][1] or ""
        assert r.ids == LIBRARY.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert table.limit(0).select(bpe.encode(F.col("text"), path, P.PATTERN)).count() == 0


# Packing

VOCABULARY = P.path("byte_bpe_50k.json")


def test_encoder_equals_library():
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    encoder = packing.Encoder(VOCABULARY, P.PATTERN)
    rng = random.Random(4)
    pieces = ["word", "Äö", "  ", "\n", " ", "x,", "12", "\u00a0", "'ll", "\x1c", "<|endoftext|>", "語"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in texts * 2:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_added_tokens_equal_library(spark):
    """The library as it is: strings of added tokens inside a text are those tokens."""
    library = Tokenizer.from_file(VOCABULARY)
    encoder = packing.Encoder(VOCABULARY, P.PATTERN, added=True)
    rng = random.Random(5)
    pieces = ["word", "  ", "\n", " ", "x,", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<|", "語"]
    texts = TEXTS + ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert wanted[len(TEXTS)] == [64, 220, 50256, 275]
    for text, ids in zip(texts, wanted):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids, text[:50]
    table = spark.createDataFrame(list(enumerate(texts[len(TEXTS) :])), "doc_id long, text string")
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(table, VOCABULARY, P.PATTERN, 2).collect()}
    assert found == {i: ids + [2] for i, ids in enumerate(wanted[len(TEXTS) :])}


def test_best_fit_takes_the_fullest():
    fit = packing.BestFit(10, 3)
    assert [fit.place(s) for s in (6, 7, 3, 4, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    # Four sequences stay partly free: the fullest closes.
    assert [fit.place(s) for s in (6, 7, 8, 9)] == [(3, 0), (4, 0), (5, 0), (6, 0)]
    assert fit.place(1) == (5, 8) and fit.place(4) == (3, 6) and fit.count == 2


def test_best_fit_against_search():
    """With room for all, every piece goes where a search of all open sequences puts it."""
    rng = random.Random(6)
    fit, free = packing.BestFit(64, 10_000), {}
    for _ in range(3000):
        size = rng.randrange(1, 65)
        sequence, offset = fit.place(size)
        fits = [f for f in free.values() if f >= size]
        before = free.get(sequence, 64)
        assert before == (min(fits) if fits else 64) and offset == 64 - before
        free[sequence] = before - size


def test_pack(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["tree", "lamp", "éclair", "x1"]) for _ in range(rng.choice([0, 3, 40, 900, 5000])))) for i in range(80)]
    rows += [(500, None), (501, ""), (3, "twice"), (None, "no id")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length long").repartition(3)
    found = packing.pack(table, VOCABULARY, P.PATTERN, 2).collect()
    library = Tokenizer.from_file(VOCABULARY)
    sequences, wanted = defaultdict(list), Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        wanted[doc_id, tuple(ids)] += 1
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 1024
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    for doc_id in {r[0] for r in rows} - {3}:
        parts = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert all(p.length == 1024 for p in parts[1:])
        assert wanted[doc_id, tuple(np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist())] == 1
    tokens = sum(r.length for r in found)
    assert len(sequences) <= 1.05 * tokens / 1024 + 3
    assert packing.pack(table.limit(0), VOCABULARY, P.PATTERN, 2).count() == 0


# Sharding


def test_shuffle(spark, tmp_path):
    rows = [(i % 50 if i % 3 else None, "t" * (i % 90) if i % 7 else None, 5, "k") for i in range(1000)] + [(1, "same", 5, "k")] * 500
    table = spark.createDataFrame(rows, "doc_id long, text string, shard int, _row string")
    stored = str(tmp_path / "in")
    table.repartition(4).write.parquet(stored)
    table = spark.read.parquet(stored)
    out = sharding.write_shards(table, str(tmp_path / "out"), 7, bucket_bytes=4096)
    found = out.collect()
    plain = lambda r: (r.doc_id, r.text, r.shard_input, r._row)
    key = lambda x: tuple(map(str, x))
    assert sorted(map(plain, found), key=key) == sorted(rows, key=key)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shuffled(table, 7, bucket_bytes=4096)
    assert Counter((r.shard, r.slot, *plain(r)) for r in again.collect()) == Counter((r.shard, r.slot, *plain(r)) for r in found)
    assert sharding.shuffled(table.limit(0), 7).count() == 0


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s).tolist()) for s in range(6000))
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())
