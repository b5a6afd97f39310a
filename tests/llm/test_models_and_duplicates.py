"""Neighbours, compression scores, near duplicates and the pipeline against brute force."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passbook.llm import ann, compress, divergence, graph, hyperminhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


# Nearest neighbours


def slow_nearest(rows, every, k):
    good = {
        i: np.array(v, float) for i, v, _ in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    out = {}
    for q in good:
        if q % every == 0:
            near = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_nearest(spark, monkeypatch):
    # Small leaves and blocks, so that a small table is cut like a large one.
    for name, value in (("SAMPLE", 400), ("LEAF", 16), ("BLOCK", 20)):
        monkeypatch.setattr(ann, name, value)
    monkeypatch.setattr(ann.fit_tree, "__defaults__", (8, 16, ann.SEED))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 900)] + 0.6 * rng.normal(size=(900, 16))
    rows = [(i, np.float32(v).tolist(), 0) for i, v in enumerate(vectors)]
    same = rows[40][1]
    rows += [(1000 + i, same, 0) for i in range(60)]
    rows += [
        (2000, None, 0), (2020, [], 0), (2040, [0.0] * 16, 0), (2060, [float("nan")] + [1.0] * 15, 0),
        (2080, [None] + [1.0] * 15, 0), (2100, [float("inf")] + [1.0] * 15, 0), (None, same, 0), (2120, [1.0, 2.0], 0),
        (2140, [-0.0, 2.0], 0), (1000, same, 0),
    ]
    table = spark.createDataFrame(rows, VECTORS)
    found = {}
    for r in ann.nearest(table, every=20, k=10, probes=64).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = slow_nearest(rows, 20, 10)
    assert set(found) == set(expected)
    hit = total = 0
    for q, near in expected.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, len(near) + 1))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        hit += len({g[1] for g in got} & {i for i, _ in near})
        total += len(near)
    assert hit / total >= 0.9
    # Copies of one vector tie, and ties go to the smaller ids.
    assert [g[1] for g in sorted(found[1040])] == [i for i, _ in expected[1040]]
    assert ann.nearest(table.limit(0)).count() == 0


def test_ties_go_to_the_smaller_ids():
    """Groups of copies and of distinct vectors of equal score that straddle the cut."""
    rng = np.random.default_rng(15)
    query = np.array([[1.0, 0.5, 0.25, 0.0]])
    near = np.array([[2.0 + i, 0, 0, 0] for i in range(10)])
    copies = np.tile([1.0, 1.0, 0, 0], (21, 1))
    tied = np.column_stack([np.ones(200), np.ones(200), np.zeros(200), np.arange(200)])
    for group in (copies, tied):
        vectors = np.concatenate([near, group, -near])
        for _ in range(50):
            ids = rng.permutation(len(vectors))
            found, score = next(ann.best_of(query, vectors, ids, 21))
            expected = sorted((-float((v * query[0]).sum()), i) for v, i in zip(vectors, ids))[:21]
            assert list(zip(-score, found)) == expected


def test_visits_until_enough_rows():
    tree = ann.fit_tree(np.random.default_rng(16).normal(size=(500, 8)), leaf=20)
    query = np.ones(8)
    order = ann.best_bins(tree, query, tree.leaves)
    held = {leaf: 2 for leaf in order[1:]}
    assert ann.best_bins(tree, query, 1, held, 5) == order[:4]
    assert ann.best_bins(tree, query, 1, held, 10**6) == order


def test_every_query_has_all_neighbours(spark, monkeypatch):
    """One visit by the calibration, and leaves of fewer rows than are asked for."""
    for name, value in (("SAMPLE", 400), ("LEAF", 8)):
        monkeypatch.setattr(ann, name, value)
    monkeypatch.setattr(ann.fit_tree, "__defaults__", (8, 8, ann.SEED))
    rng = np.random.default_rng(17)
    rows = [(i, np.float32(v).tolist(), 0) for i, v in enumerate(rng.normal(size=(300, 8)))]
    table = spark.createDataFrame(rows, VECTORS)
    counts = {r.query_id: r["count"] for r in ann.nearest(table, every=20, k=30, probes=8, recall=0.0).groupBy("query_id").count().collect()}
    assert counts == {i: 30 for i in range(0, 300, 20)}


def test_tree_files_and_finds():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 8))
    tree = ann.fit_tree(points, leaf=20)
    leaves = ann.file_in(tree, points)
    assert all(not tree.children[n] for n in leaves) and tree.leaves > 10
    order = ann.best_bins(tree, points[0], tree.leaves)
    assert len(order) == len(set(order)) == tree.leaves
    assert ann.fit_tree(np.ones((100, 3))).leaves == 1


# Compression classifier


def made(rng, good):
    if good:
        words = ["the", "quiet", "river", "ran", "past", "old", "stone", "houses", "and", "gardens", "of", "town"]
        return " ".join(rng.choice(words) for _ in range(rng.randrange(20, 400)))
    return " ".join("".join(rng.choice("xqzj#|%") for _ in range(6)) for _ in range(rng.randrange(20, 400)))


def test_compression_scores(spark):
    rng = random.Random(3)
    marks = [rng.random() < 0.7 for _ in range(400)]
    rows = [(i, made(rng, g), "en", "s", 1) for i, g in enumerate(marks)] + [(900, None, None, None, None), (901, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame(
        [(i, int(g), 0) for i, g in enumerate(marks)] + [(None, 1, 0), (3, None, 0), (5, int(marks[5]), 1)], "doc_id long, quality int, toxic int"
    )
    model = compress.fit(docs, labels)
    assert model.weights is not None
    scored = {r.doc_id: r.s for r in docs.select("doc_id", compress.score(docs["text"], model).alias("s")).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.3) == marks[i] for i in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in scored.values()) and scored[900] == scored[901]
    fold = {r.doc_id: r.f for r in docs.select("doc_id", compress.fold(docs["doc_id"]).alias("f")).collect()}
    assert all(fold[i] == zlib.crc32(str(i).encode()) % 5 for i in range(400))
    clash = docs.withColumnRenamed("source", "_score").withColumnRenamed("n_chars", "_row")
    kept = compress.keep_good(clash, model)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scored.items() if s >= 0.3}


def test_held_out_labels_are_not_learnt(spark):
    rng = random.Random(4)
    rows = [(i, made(rng, i % 3 > 0), "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOC)
    right = [(i, int(i % 3 > 0), 0) for i in range(200)]
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in right]
    schema = "doc_id long, quality int, toxic int"
    assert compress.fit(docs, spark.createDataFrame(right, schema)) == compress.fit(docs, spark.createDataFrame(wrong, schema))


@pytest.mark.parametrize("ids", ["own", "repeated", "one"])
def test_first_blocks_are_bounded(spark, monkeypatch, ids):
    """Whatever the number of tasks and the length of texts, little beyond the limit is cut, and the order holds."""
    monkeypatch.setattr(compress, "SPARE", 40)
    rng = random.Random(5)
    number = {"own": lambda i: i, "repeated": lambda i: i % 30, "one": lambda i: 7}[ids]
    texts = [(number(i), rng.randbytes(rng.choice([0, 5, 1024, 1025, 9000]) if ids != "one" else 50)) for i in range(900)] + [(1000, None)]
    sample = spark.createDataFrame(texts, "_id long, _text binary").repartition(9)
    for most in (100, 10_000):
        found = compress.first_blocks(sample, most)
        rows = found.orderBy("_place", "_id", "_no", "_tie").collect()
        pieces = [(i, no, t or b"", b) for i, t in texts for no, b in enumerate(compress.cut(t or b""))]
        keyed = spark.createDataFrame(pieces, "_id long, _no int, _text binary, _block binary")
        order = keyed.select(F.xxhash64("_id", "_no").alias("p"), "_id", "_no", F.xxhash64("_text").alias("t"), "_block").collect()
        expected = [r._block for r in sorted(order)]
        assert [bytes(r._block) for r in rows][:most] == [bytes(b) for b in expected[:most]]
        assert len(rows) <= most + 40 if most < len(pieces) else len(rows) == len(pieces)


def test_fit_does_not_depend_on_partitions(spark, monkeypatch):
    """Rows that repeat an id are told apart by their texts."""
    rng = random.Random(6)
    rows = [(i % 40, made(rng, i % 2 > 0), "en", "s", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    models = [
        compress.fit(spark.createDataFrame(r, DOC).repartition(n), labels, sample_blocks=30) for r, n in ((rows, 2), (rows[::-1], 5))
    ]
    assert models[0].weights is not None and (models[0].good, models[0].bad) == (models[1].good, models[1].bad)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], DOC)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert compress.fit(docs, none).share == 1.0
    one = spark.createDataFrame([(2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = compress.fit(docs, one)
    assert docs.select(compress.score(docs["text"], model)).first()[0] == 0.0
    assert compress.keep_good(docs.limit(0), model).count() == 0


# Near duplicates


def slow_components(rows, words, percent):
    """(n, smallest id reachable) of each row by comparing all pairs."""
    sets = []
    for _, text in rows:
        found = [w for w in (text or "").encode().lower().split()]
        sets.append({b" ".join(found)} if 0 < len(found) < words else {tuple(found[i : i + words]) for i in range(len(found) - words + 1)})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                group = [group[a] if g == group[b] else g for g in group]
    ids = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            ids[g] = min(i, ids.get(g, i))
    return [(len(s), ids.get(g)) for s, g in zip(sets, group)]


def near_rows(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklm") + rng.choice("nopq")
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([1, 2, 3, 4, 6, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) if rng.random() < 0.8 else "\n ".join(copy).upper())
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("tile", [1 << 20, 3000])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(hyperminhash, "TILE", tile)
    rows = near_rows(5) + [(9000, None), (9001, ""), (9002, " \t\n"), (6, near_rows(5)[2][1]), (None, near_rows(5)[4][1]), (None, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n long")
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(table, words=4).collect()]
    expected = [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, slow_components(rows, 4, 80))]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("ids", [[None], [5], [1, 2, None]])
def test_rows_of_one_id_do_not_meet(spark, monkeypatch, tmp_path, ids):
    """Rows that repeat an id are read again once, not once for each text of that id."""
    seen, plain = str(tmp_path / "seen"), hyperminhash._sets

    @F.arrow_udf("binary")
    def tally(texts: pa.Array) -> pa.Array:
        with open(seen, "a") as f:
            f.write(f"{len(texts)}\n")
        return texts

    monkeypatch.setattr(hyperminhash, "_sets", lambda words: lambda text: plain(words)(tally(text)))
    rows = [(ids[i % len(ids)], text) for i, (_, text) in enumerate(near_rows(21, 90))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(table, words=4).collect())
    assert found == Counter((i, n, c) for (i, _), (n, c) in zip(rows, slow_components(rows, 4, 80)))
    assert 0 < sum(map(int, Path(seen).read_text().split())) <= len(rows)


def test_keep_first(spark):
    rows = near_rows(8) + [(9000, None), (9000, None), (6, near_rows(8)[2][1]), (6, near_rows(8)[2][1])]
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, lang string, component string, n_chars long")
    kept = hyperminhash.keep_first(table)
    assert kept.columns == table.columns
    expected = Counter({i: 1 for (i, _), (n, c) in zip(rows, slow_components(rows, 5, 80)) if n and i == c})
    expected[9000] = 2
    assert Counter(r.doc_id for r in kept.collect()) == expected
    assert hyperminhash.keep_first(table.limit(0)).count() == 0


def test_short_texts_keep_their_links(spark):
    """Texts of 4 to 12 shingles, and the same with a word more or less, against all pairs."""
    rng = random.Random(12)
    texts = []
    for i in range(1500):
        base = [f"{rng.randrange(10**6)}w{i}" for _ in range(rng.randrange(4, 13) + 3)]
        end = rng.choice([1, 1, 2])
        texts += [base, rng.choice([base + ["more"] * end, ["more"] * end + base, base[:-end]])]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    expected = {}
    for a in range(0, len(rows), 2):
        # Words carry the number of their pair, so no other two texts share a shingle.
        for (i, _), (n, c) in zip(rows[a : a + 2], slow_components(rows[a : a + 2], 4, 80)):
            expected[i] = (n, c)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(table, words=4).collect()}
    assert found == expected


def test_small_sets_share_a_key():
    """Any two small sets that reach the limit have an exact key in common and are linked."""
    rng = np.random.default_rng(13)
    reached = 0
    for _ in range(3000):
        both, only = int(rng.integers(1, 20)), rng.integers(0, 4, 2)
        pool = hyperminhash.mix(rng.integers(0, 2**63, both + only.sum(), dtype=np.uint64))
        a, b = np.sort(pool[: both + only[0]]), np.sort(np.concatenate([pool[:both], pool[both + only[0] :]]))
        if max(len(a), len(b)) <= hyperminhash.SMALL and 100 * both >= 80 * len(pool):
            reached += 1
            assert set(hyperminhash.small_keys(a, 80)) & set(hyperminhash.small_keys(b, 80))
            assert hyperminhash.forest([a, b], np.arange(2), np.arange(2), 80) == [(0, 1)]
    assert reached > 500


def test_large_sets_are_linked():
    rng = np.random.default_rng(14)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = [np.unique(base[i * 100 :]) for i in range(3)]
    far = [np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64)), np.unique(base[:900])]
    sets = [*near, *far, np.unique(base[:1100])]
    links = hyperminhash.forest(sets, np.arange(6), np.arange(6), 80)
    assert len(links) == 3 and {frozenset(x) for x in links} >= {frozenset((4, 5))}


def test_hot_group_emits_no_pairs():
    """A tile of one large group returns a spanning forest."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) > 0.05], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(300)]
    links = hyperminhash.forest(sets, np.arange(300), np.arange(300), 80)
    assert len(links) == 299


def test_estimate_is_close():
    rng = np.random.default_rng(10)
    for share in (0.3, 0.6, 0.8, 0.95):
        got = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
            mine = [np.unique(np.concatenate([both, rng.integers(0, 2**63, (1000 - len(both)) // 2, dtype=np.uint64)])) for _ in range(2)]
            a, b = (hyperminhash.registers(np.sort(hyperminhash.mix(m))) for m in mine)
            got.append(hyperminhash.estimate(np.array([(a == b).mean()]), len(mine[0]), np.array([len(mine[1])]))[0])
        assert np.mean(got) == pytest.approx(share, abs=0.02)


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 240)] + [(500, i) for i in range(501, 540)]
    group = {n: n for e in edges for n in e}
    for a, b in edges:
        low, high = sorted((group[a], group[b]))
        group = {n: low if g == high else g for n, g in group.items()}
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: g for n, g in group.items() if any(n != m and group[m] == g for m in group)}


# Pipeline


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "near duplicates", "best-fit packing"]
    before = {r.doc_id: r for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after = {r.doc_id: r for r in docs.collect()}
        assert all(before[i] == r for i, r in after.items()) and after
        if name == "quality rules":
            counts = {i: divergence.measure((r.text or "").encode()) for i, r in before.items()}
            failed = {i for i, c in counts.items() if c[0] < 50 or 2 * c[4] > c[0]}
            assert not failed & set(after) and len(after) > 0.8 * (len(before) - len(failed))
        if name == "near duplicates":
            rows = sorted((i, r.text) for i, r in before.items())
            assert set(after) == {i for (i, _), (_, c) in zip(rows, slow_components(rows, 5, 80)) if i == c}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(before) and sum(r.length for r in packed) == sum(len(r.ids) // 4 for r in packed)
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
