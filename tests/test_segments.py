"""The stored full-text index: random edits, merges, failures, and what searches read."""

import random
from collections import Counter

import pytest

from passbook.operators import fulltext, segments
from passbook.sources import store

WORDS = ["tea", "Coffee", "rent", "Éclair", "of", "the", "bakery", "x1"]
TX = "ledger_id string, id long, description string, metadata string"


def rows_of(df):
    return Counter(map(tuple, df.select(*fulltext.POSTING_COLUMNS).collect()))


def frames(spark, state, noted):
    tx = spark.createDataFrame([(ledger, i, text, '{"k": ["v %d"]}' % (i % 3)) for (ledger, i), text in state.items()], TX)
    notes = spark.createDataFrame([(*key, n) for key, n in noted.items()], "ledger_id string, transaction_id long, note string")
    return tx, notes


def text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 4, 30])))


def test_random_edits_and_merges(spark, tmp_path):
    rng, root = random.Random(8), str(tmp_path / "index")
    # Ids around the ends of spans, far apart, and below zero.
    ids = [*range(250, 262), -1, -256, -257, 0, 5_000_000_000, 511]
    state = {(ledger, i): text(rng) for ledger in "AB" for i in ids}
    noted = {("A", 250): "the note"}
    tx, notes = frames(spark, state, noted)
    segments.create_index(spark, root, tx, notes)
    assert rows_of(segments.index_postings(spark, root)) == rows_of(fulltext.build_postings(tx, notes))
    for edit in range(5):
        changed = {k: text(rng) for k in rng.sample(sorted(state), 5)} | {("C", edit): text(rng)}
        gone = rng.sample(sorted(state), 2)
        state |= changed
        noted[next(iter(changed))] = text(rng)
        for k in gone:
            state.pop(k)
            noted.pop(k, None)
        tx, notes = frames(spark, state, noted)
        removed = spark.createDataFrame(gone, "ledger_id string, id long")
        after = tx.join(spark.createDataFrame(list(changed), "ledger_id string, id long"), ["ledger_id", "id"], "left_semi")
        segments.refresh_index(spark, root, after, notes, removed)
        held = rows_of(segments.index_postings(spark, root))
        assert held == rows_of(fulltext.build_postings(tx, notes))
        if edit % 2:
            segments.merge_segments(spark, root, fan=2)
            assert rows_of(segments.index_postings(spark, root)) == held
        if edit == 2:
            # Once more changes nothing.
            segments.refresh_index(spark, root, after, notes, removed)
            assert rows_of(segments.index_postings(spark, root)) == held
    assert fulltext.check_postings(segments.index_postings(spark, root), tx, notes).count() == 0
    segments.merge_segments(spark, root, whole=True)
    (one,) = segments.segments(spark, root).collect()
    assert (one.first, one.touched) == (0, 0) and one.postings == sum(held.values())
    assert rows_of(segments.index_postings(spark, root)) == held
    assert segments.merge_segments(spark, root, whole=True) is None


def test_a_change_writes_one_small_segment(spark, tmp_path):
    root = str(tmp_path / "index")
    state = {("A", i): f"tea number {i} of the day" for i in range(3000)}
    tx, notes = frames(spark, state, {})
    segments.create_index(spark, root, tx)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    for i in range(8):
        segments.refresh_index(spark, root, tx.filter(f"id = {i}"), notes)
        segments.merge_segments(spark, root)
    kept = segments.segments(spark, root).orderBy("segment").collect()
    # No file was written twice, the first segment stands, and the others hold only what changed.
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert (kept[0].segment, kept[0].postings) == (0, 3000 * 8)
    assert len(kept) < 6 and sum(e.postings for e in kept[1:]) == 8 * 8 and sum(e.touched for e in kept[1:]) == 8
    assert rows_of(segments.index_postings(spark, root)) == rows_of(fulltext.build_postings(tx))


def test_searches_read_their_terms(spark, tmp_path):
    root = str(tmp_path / "index")
    tx, notes = frames(spark, {("A", 1): "tea of the day", ("A", 2): "the day of tea", ("B", 1): "Coffee"}, {})
    segments.create_index(spark, root, tx)
    segments.refresh_index(spark, root, tx.filter("id = 2"), spark.createDataFrame([("A", 2, "coffee")], "ledger_id string, transaction_id long, note string"))
    held = segments.index_postings(spark, root)
    found = fulltext.match_all(held, "Coffee")
    assert sorted(map(tuple, found.collect())) == [("A", 2), ("B", 1)]
    assert "In(term, [coffee])" in found._jdf.queryExecution().toString() or "EqualTo(term,coffee)" in found._jdf.queryExecution().toString()
    assert list(map(tuple, fulltext.match_phrase(held, "of the").collect())) == [("A", 1)]
    assert fulltext.exclude_match(tx, held, "tea").count() == 1
    assert {tuple(r) for r in fulltext.match_prefix(held, "co*").collect()} == {("A", 2), ("B", 1)}


def test_failures_leave_the_last_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    tx, notes = frames(spark, {("A", 1): "tea"}, {})
    with pytest.raises(ValueError, match="no index"):
        segments.index_postings(spark, root)
    with pytest.raises(ValueError, match="no index"):
        segments.refresh_index(spark, root, tx)
    segments.create_index(spark, root, tx)
    with pytest.raises(ValueError, match="an index is stored"):
        segments.create_index(spark, root, tx)
    held = rows_of(segments.index_postings(spark, root))

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", broken)
        with pytest.raises(OSError, match="lost"):
            segments.refresh_index(spark, root, removed=tx)
    assert rows_of(segments.index_postings(spark, root)) == held and store.latest(spark, root) == 0
    # A manifest that was not completed does not count.
    (tmp_path / "index" / "_manifest" / "000000000001").mkdir()
    assert store.latest(spark, root) == 0
    (tmp_path / "index" / "_manifest" / "000000000001").rmdir()
    # Two writers of one version: the second raises.
    store.commit(spark, root, 1, [], "a int")
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(spark, root, 1, [], "a int")
    # An empty table has an empty index.
    segments.create_index(spark, str(tmp_path / "none"), tx.limit(0))
    assert segments.index_postings(spark, str(tmp_path / "none")).count() == 0
    segments.refresh_index(spark, str(tmp_path / "none"), removed=tx)
    assert segments.index_postings(spark, str(tmp_path / "none")).count() == 0


def test_blocks_hold_whole_spans(spark):
    """Words are grouped within tasks: one row for a term and span, whatever the batches; repeated ids too."""
    rng = random.Random(4)
    ids = [*range(200, 300), -1, -256, 0, 7, 7, 511, 5_000_000_000]
    tx = spark.createDataFrame([(ledger, i, text(rng), "{}") for ledger in ("A", "B", None) for i in ids], TX)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        blocks = fulltext.build_blocks(tx)
        rows = blocks.collect()
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        odd = fulltext.check_blocks(blocks.filter("term <> 'tea' or block <> 0"), tx.filter("id <> 511"))
        flat = fulltext.check_postings(rows_as_postings(spark, rows).filter("term <> 'tea' or shiftright(id, 8) <> 0"), tx.filter("id <> 511"))
        assert Counter(map(tuple, odd.collect())) == Counter(map(tuple, flat.collect())) and odd.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Generate explode" not in plan and "Generate posexplode" not in plan and "Exchange hashpartitioning(ledger_id" in plan and "hashpartitioning(term" not in plan
    assert max(Counter((r.ledger_id, r.term, r.block) for r in rows).values()) == 1
    assert rows_of(rows_as_postings(spark, rows)) == rows_of(fulltext.build_postings(tx))


def rows_as_postings(spark, rows):
    flat = [(r.ledger_id, r.term, (r.block << fulltext.SPAN) + i, p) for r in rows for i, p in zip(r.ids, r.places)]
    return spark.createDataFrame(flat, "ledger_id string, term string, id long, pos int")


def test_only_spans_that_differ_are_taken_apart(spark, monkeypatch):
    """A check compares sums of spans; ids that repeat or are NULL, NULL ledgers and swapped words give the problems of all pairs."""
    rng = random.Random(12)
    ids = [*range(0, 1200, 60), -1, 7, 7, 5_000_000_000, None]
    rows = [(ledger, i, text(rng), "{}") for ledger in ("A", None) for i in ids]
    tx = spark.createDataFrame(rows, TX)
    notes = spark.createDataFrame([("A", 600, "one more")], "ledger_id string, transaction_id long, note string")
    # The index has another word in one span of ids, and a row too many in another ledger.
    other = [(ledger, i, "the swapped" if (ledger, i) == ("A", 300) else words, m) for ledger, i, words, m in rows]
    indexed = spark.createDataFrame([*other, ("B", 9, "orphan", "{}")], TX)
    index = fulltext.build_blocks(indexed)
    seen = []
    whole = fulltext._odd_pairs

    def watched(due, held):
        seen.append({(r.ledger_id, r.block) for r in due.unionByName(held).select("ledger_id", "block").collect()})
        return whole(due, held)

    monkeypatch.setattr(fulltext, "_odd_pairs", watched)
    found = Counter(map(tuple, fulltext.check_blocks(index, tx, notes).collect()))
    due = {(r.ledger_id, r.id, r.term) for r in fulltext.build_postings(tx, notes).collect()}
    held = {(r.ledger_id, r.id, r.term) for r in fulltext.build_postings(indexed).collect()}
    known = {(ledger, i) for ledger, i, *_ in rows if ledger is not None and i is not None}
    want = [(*p, "missing") for p in due - held] + [(*p, "phantom" if p[:2] in known else "orphan") for p in held - due]
    assert {p[:4] for p in found} == set(want) and len(want) > 4
    # Texts that share an id count twice, so their span is looked at as well.
    assert seen[0] >= {("A", 1), ("A", 2), ("B", 0)}
    assert not seen[0] & {("A", 3), ("A", 4), (None, 1), (None, 4), ("A", -1)}
    # A whole index has nothing to take apart.
    clean = tx.filter("id <> 7")
    assert fulltext.check_blocks(fulltext.build_blocks(clean, notes), clean, notes).count() == 0
    assert not seen[1]
