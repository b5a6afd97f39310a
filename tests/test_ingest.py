"""Ingest, ranking, feeds, files and the stream."""

import hashlib
import json
import random
import struct as packer

import pytest
from pyspark.sql import functions as F

from conftest import AT, table
from passbook.functions.money import row_hash
from passbook.operators import fulltext
from passbook.operators import ingest as ops
from passbook.operators import ranking, segments
from passbook.operators.ranking import previous_value, rank_along
from passbook.plans.refresh import refresh
from passbook.schema import empty_books, struct
from passbook.sources import exports, feeds, sinks, store
from passbook.streaming import ingest as stream


def records(spark, rows):
    """(hash, description, metadata) in arrival order, all in one account."""
    return spark.createDataFrame(
        [("L", 1, h, i, d, m, "2024-01-01", 5, 6, "f", 2) for i, (h, d, m) in enumerate(rows)],
        "ledger_id string, account_id long, hash string, seq long, description string, metadata string, "
        "date string, amount_cents long, balance_cents long, source_file string, import_batch_id long",
    ).withColumn("date", F.col("date").cast("date"))


def replay(rows):
    """What a row-by-row import does: final state and outcome of each record."""
    state, outcomes = {}, []
    for h, text, meta in rows:
        meta = json.loads(meta)
        if h not in state:
            state[h] = (text, meta)
            outcomes.append("added")
            continue
        old_text, old_meta = state[h]
        new = (text if text.strip() else old_text, {**old_meta, **meta})
        outcomes.append("unchanged" if new == state[h] else "updated")
        state[h] = new
    return state, outcomes


def test_replay(spark):
    rng = random.Random(3)
    rows = [
        (
            f"h{rng.randint(1, 12)}",
            rng.choice(["", "  ", "A", "B", "C"]),
            json.dumps({k: rng.choice([1, "1", [1, {"z": 2}], None]) for k in rng.sample("pqr", rng.randint(0, 2))}),
        )
        for _ in range(150)
    ]
    first, second = records(spark, rows[:60]), records(spark, rows).filter("seq >= 60")
    none = table(spark, "transactions", [])
    stored = ops.ingest(none, first)
    final = ops.ingest(stored, second)
    state, outcomes = replay(rows)
    got = {r.hash: (r.description, json.loads(r.metadata)) for r in final.collect()}
    assert got == state
    labels = {r.seq: r.outcome for r in ops.label_records(none, records(spark, rows)).collect()}
    assert [labels[i] for i in range(len(rows))] == outcomes
    later = {r.seq: r.outcome for r in ops.label_records(stored, second).collect()}
    assert [later[i] for i in range(60, len(rows))] == outcomes[60:]
    order = [r.hash for r in final.orderBy("id").collect()]
    assert order == list(dict.fromkeys(h for h, _, _ in rows))
    assert sorted(r.id for r in final.collect()) == list(range(1, len(order) + 1))


def test_unchanged_metadata_keeps_its_bytes(spark):
    odd = '{ "b" : 1,"a":"x" }'
    stored = ops.ingest(table(spark, "transactions", []), records(spark, [("h", "T", odd)]))
    again = ops.ingest(stored, records(spark, [("h", "Better", '{"a":"x"}')]))
    row = again.first()
    assert (row.description, row.metadata) == ("Better", odd)
    assert ops.dedup_insert(stored, records(spark, [("h", "x", "{}")])).count() == 0


@pytest.mark.parametrize("span", [1000, 1 << 62])
def test_ranks_across_ranges(spark, span):
    rng = random.Random(1)
    ids = [rng.randrange(-span, span) for _ in range(200)] if span > 1000 else rng.sample(range(span), 200)
    width = 1 << 13 if span > 1000 else 1 << 11
    # Every window sees the rows or ranges inside one range of the next level: at most ``width``.
    below = set(ids)
    for _ in range(ranking._levels(width)):
        above = {i // width for i in below}
        assert all(sum(b // width == a for b in below) <= width for a in above)
        below = above
    assert len(below) <= width and max(ids) // width ** ranking._levels(width) <= width
    df = spark.createDataFrame([("ab"[i % 2], i, rng.choice([None, i])) for i in ids], "k string, id long, v long")
    rows = rank_along(df, ["k"], "id", width=width).collect()
    for key in "ab":
        mine = sorted((r.id, r["rank"]) for r in rows if r.k == key)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    back = {(r.k, r.id): r.previous for r in previous_value(df, ["k"], "id", "v", width=width).collect()}
    last = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        assert back[(r.k, r.id)] == last.get(r.k)
        last[r.k] = r.v if r.v is not None else last.get(r.k)


def test_sums_and_ranks_by_text(spark):
    rng = random.Random(2)
    rows = [("ab"[i % 5 > 0], f"n{rng.randrange(10**6)}-{i}", i % 7) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, name string, n long")
    got = {(r.k, r.name): (r._rank, r.before) for r in ranking.rank_sorted(ranking.sums_sorted(df, ["k"], ["name"], "n", "before"), ["k"], ["name"]).collect()}
    for k in "ab":
        mine, total = sorted(r for r in rows if r[0] == k), 0
        for i, (_, name, n) in enumerate(mine, 1):
            assert got[k, name] == (i, total)
            total += n


def test_row_hash(spark):
    row = spark.createDataFrame(
        [("01/02/2024", "Café", -10000, 50000, None), ("d", "x", 1, 2, "given")],
        "date string, description string, amount_cents long, balance_cents long, hash string",
    )
    plain = b"01/02/2024|" + "Café".encode() + b"|" + packer.pack("<q", -10000) + b"|" + packer.pack("<q", 50000)
    got = [r[0] for r in row.select(row_hash("date", "description", "amount_cents", "balance_cents")).collect()]
    assert got == [hashlib.sha256(plain).hexdigest(), "given"]


def write_exports(root):
    files = {
        "Harbour/Household/jan.CSV": "Day,What,Value\n2024-01-05,Coffee,-4.50\n06/01/2024,Tea,-3\n",
        "Harbour/Household/copy.csv": "Day,What,Value\n2024-01-05,Coffee,-4.50\n06/01/2024,Tea,-3\n",
        "Meridian/Joint/all.csv": 'Day,What,Value\n2024-02-01,"Pay, bonus",100.25\n',
        "Meridian/Joint/notes.txt": "ignored",
        "Meridian/Joint/old/deep.csv": "Day,What,Value\n2020-01-01,Deep,1\n",
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)


def test_fingerprints_of_all_files(spark, tmp_path):
    """Chunks of splits give the hash of the bytes, whatever they are."""
    rng = random.Random(14)
    lines = [bytes(rng.choice(b"ab\r,\"\xc3\xa9\xff\x00") for _ in range(rng.choice([0, 1, 90, 3000]))) for _ in range(900)]
    bodies = {
        "empty": b"", "mark": b"\xef\xbb\xbf", "marked": b"\xef\xbb\xbfa,b\n1,2", "marked end": b"\xef\xbb\xbfa,b\n1,2\n", "ends": b"\n\n\n",
        "one": b"x", "crlf": b"a\r\nb\r\n", "bytes": b"\n".join(lines), "bytes+end": b"\n".join(lines) + b"\n", "line": b"y" * 300_000,
        "percent %20+&": b"z\n",
    }
    for name, body in bodies.items():
        (tmp_path / "in" / "Bank A").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "Bank A" / name).mkdir()
        (tmp_path / "in" / "Bank A" / name / "x.csv").write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = {r.account_name: (r.bank_name, r.content_hash) for r in exports.file_fingerprint(spark, str(tmp_path / "in"), "L").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {name: ("Bank A", hashlib.sha256(body).hexdigest()) for name, body in bodies.items() if body}


def test_refresh(spark, tmp_path):
    write_exports(tmp_path / "in")
    mapping = spark.createDataFrame(
        [("L", b, a, f, c) for b in ("Harbour", "Meridian") for a, f, c in (
            (None, "date", "Day"), (None, "description", "Day"), (None, "amount", "Value"))]
        + [("L", "Harbour", "Household", "description", "What"), ("L", "Meridian", "Joint", "description", "What")],
        "ledger_id string, bank_name string, account_name string, field string, source_column string",
    )
    args = dict(source_schema="Day string, What string, Value string", mapping=mapping, ledger_id="L")
    empty = empty_books(spark)
    manifest, batches = (spark.createDataFrame([], struct(n)) for n in ("imported_files", "import_batches"))
    out = str(tmp_path / "out")
    books, extra = refresh(spark, empty, manifest, batches, str(tmp_path / "in"), batch_id=1, at=AT, target=out, **args)
    rows = {(str(r.date), r.description, r.amount_cents) for r in books.transactions.collect()}
    assert rows == {("2024-01-05", "Coffee", -450), ("2024-01-06", "Tea", -300), ("2024-02-01", "Pay, bonus", 10025)}
    assert extra["imported_files"].count() == 2
    counts = {r.event: r.n for r in extra["counts"].collect()}
    assert counts == {"banks_added": 2, "accounts_added": 2, "files_processed": 2}
    assert sinks.current(spark, out, "transactions").count() == 3
    assert extra["import_batches"].first().completed_at is not None
    # The same files again: nothing new, nothing deleted.
    stored = books.with_tables(**{n: sinks.current(spark, out, n) for n in ("banks", "accounts", "transactions")})
    again, more = refresh(
        spark, stored, sinks.current(spark, out, "imported_files"), batches, str(tmp_path / "in"), batch_id=2, at=AT, **args
    )
    assert again.transactions.count() == 3 and more["counts"].count() == 0
    # A folder without exports keeps its account; pulled records join the batch, and postings follow.
    for export in (tmp_path / "in" / "Meridian" / "Joint").glob("*.*"):
        export.unlink()
    pulled = spark.createDataFrame(
        [("L", "Harbour", "Feed", "2024-03-01", "Pulled tea", -5, 1, None, "{}", 0), ("L", "Harbour", "Household", "06/01/2024", "Tea", -300, 0, None, "{}", 1)],
        "ledger_id string, bank_name string, account_name string, date string, description string, amount_cents long, "
        "balance_cents long, hash string, metadata string, position long",
    )
    index = str(tmp_path / "index")
    segments.create_index(spark, index, stored.transactions)
    third, more = refresh(
        spark, stored, sinks.current(spark, out, "imported_files"), batches, str(tmp_path / "in"), batch_id=3, at=AT,
        pulled=pulled, index=index, **args,
    )
    assert third.accounts.filter("deleted_at is not null").count() == 0
    assert {r.name for r in third.accounts.collect()} == {"Household", "Joint", "Feed"}
    assert {r.description for r in third.transactions.collect()} == {"Coffee", "Tea", "Pay, bonus", "Pulled tea"}
    assert {(r.outcome, r.records) for r in ops.ingest_report(more["labels"]).collect()} == {("added", 1), ("unchanged", 1)}
    assert fulltext.check_postings(segments.index_postings(spark, index), third.transactions).count() == 0


def test_publishing_writes_touched_parts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    tx = spark.createDataFrame(
        [("LM"[i % 2], i, f"2024-{1 + i % 5:02d}-03", f"t{i}") for i in range(60)] + [("L", 99, None, "undated")],
        "ledger_id string, id long, date string, text string",
    ).withColumn("date", F.col("date").cast("date"))
    banks = spark.createDataFrame([("L", 1, "Harbour")], "ledger_id string, bank_id long, name string")
    read = lambda name, **how: sorted(map(tuple, sinks.current(spark, root, name, **how).collect()), key=str)
    of = lambda df: sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(ValueError, match="never"):
        sinks.current(spark, root, "tx")
    assert sinks.publish({"tx": tx, "banks": banks, "none": banks.limit(0)}, root) == 0
    assert read("tx") == of(tx) and read("banks") == of(banks) and read("none") == []
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    # One month of one ledger: a row more, one changed, one removed.
    hit = (F.col("ledger_id") == "L") & (F.month("date") == 3)
    old = tx.filter(hit)
    first = old.agg(F.min("id")).first()[0]
    new = old.filter(F.col("id") > first).withColumn("text", F.concat("text", F.lit("!"))).unionByName(old.limit(1).withColumn("id", F.lit(1000).cast("long")))
    after = tx.filter(~F.coalesce(hit, F.lit(False))).unionByName(new)
    assert sinks.publish({"tx": after}, root, {"tx": old.unionByName(new)}) == 1
    written = [p for p in tmp_path.rglob("*.parquet") if p not in before and "_manifest" not in str(p)]
    assert len(written) == 1 and "_month=2024-03" in str(written[0])
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert read("tx") == of(after) and read("banks") == of(banks)
    assert read("tx", months=("2024-02", "2024-03")) == of(after.filter("month(date) IN (2, 3)"))
    # A part that loses its last row, and a failure before the manifest.
    rest = after.filter("date is not null")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", broken)
        with pytest.raises(OSError, match="lost"):
            sinks.publish({"tx": rest}, root, {"tx": after.filter("date is null")})
    assert read("tx") == of(after)
    sinks.publish({"tx": rest}, root, {"tx": after.filter("date is null")})
    assert read("tx") == of(rest) and read("banks") == of(banks)


def test_vanished_bank_keeps_accounts(spark, golden):
    seen = spark.createDataFrame([("L", "Harbour", "Household")], "ledger_id string, bank_name string, account_name string")
    banks = ops.soft_delete_missing_banks(golden.banks, seen, AT)
    accounts = ops.soft_delete_missing_accounts(golden.accounts, banks, seen, AT)
    assert {r.name for r in banks.filter("deleted_at is not null").collect()} == {"Meridian"}
    assert {r.name for r in accounts.filter("deleted_at is not null").collect()} == {"Rainy Day"}
    back = ops.sync_dimension(banks, spark.createDataFrame([("L", "Meridian"), ("L", "New")], "ledger_id string, name string"), "bank_id", ["name"])
    assert {(r.bank_id, r.name, r.deleted_at is None) for r in back.collect()} == {(1, "Harbour", True), (2, "Meridian", True), (3, "New", True)}


def test_feed_json(spark, tmp_path):
    good = [{"date": "2024-01-01", "description": "A", "amount_cents": -5, "balance_cents": 7, "metadata": {"k": [1]}},
            {"date": "2024-01-01", "description": "B", "amount_cents": 5, "balance_cents": 7, "hash": "x"}]
    (tmp_path / "a.json").write_text(json.dumps(good))
    rows = {r.description: (r.hash, r.metadata) for r in feeds.read_feed_json(spark, str(tmp_path / "a.json")).collect()}
    assert rows == {"A": (None, '{"k":[1]}'), "B": ("x", "{}")}
    (tmp_path / "b.json").write_text(json.dumps([{"date": "2024-01-01", "description": "A", "amount_cents": 1}]))
    with pytest.raises(Exception, match="balance_cents"):
        feeds.read_feed_json(spark, str(tmp_path / "b.json")).collect()


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'say "hi", you', None), (2, "two\nlines", ""), (3, " plain ", "c")], "id int, text string, category string"
    ).coalesce(1)
    sinks.write_csv(df, str(tmp_path / "csv"))
    body = b"".join(f.read_bytes() for f in sorted((tmp_path / "csv").glob("part-*"))).decode()
    assert body == 'id,text,category\r\n1,"say ""hi"", you",\r\n2,"two\nlines",\r\n3, plain ,c\r\n'
    sinks.write_json(df, str(tmp_path / "json"))
    first = json.loads(next((tmp_path / "json").glob("part-*")).read_text().splitlines()[0])
    assert first == {"id": 1, "text": 'say "hi", you', "category": None}


def test_streams(spark, tmp_path):
    schema = "ledger_id string, account_id long, hash string, event_ts timestamp"
    rows = spark.createDataFrame([("L", 1, "a"), ("L", 1, "a"), ("L", 2, "a")], "ledger_id string, account_id long, hash string")
    rows.withColumn("event_ts", F.lit(AT).cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = stream.feed_stream(spark, str(tmp_path / "in"), schema)
    stream.ingest_stream(source, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    # A repeat after a month and a record of long ago, each in a later micro-batch.
    later = spark.createDataFrame([("L", 1, "a", "2024-07-20"), ("L", 3, "a", "2024-07-20")], "ledger_id string, account_id long, hash string, t string")
    late = spark.createDataFrame([("L", 4, "a", "2020-01-01"), ("L", 3, "a", "2020-01-01")], "ledger_id string, account_id long, hash string, t string")
    for batch in (later, late):
        batch.select("ledger_id", "account_id", "hash", F.col("t").cast("timestamp").alias("event_ts")).write.mode("append").parquet(str(tmp_path / "in"))
        stream.ingest_stream(source, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r.account_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]
    # Refinement: the better text of a later record reaches the stored row.
    batch = records(spark, [("h", "old", "{}"), ("h", "new", "{}")])
    batch.write.parquet(str(tmp_path / "feed"))
    stored = {"tx": table(spark, "transactions", [])}
    feed = stream.feed_stream(spark, str(tmp_path / "feed"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema))

    def store(df, number):
        place = str(tmp_path / f"state-{number}")
        df.write.parquet(place)
        stored["tx"] = spark.read.parquet(place)

    stream.refine_stream(feed, lambda: stored["tx"], store, str(tmp_path / "log2")).awaitTermination()
    assert [r.description for r in stored["tx"].collect()] == ["new"]


def test_stream_keeps_records_without_time(spark, tmp_path):
    schema = "ledger_id string, account_id long, hash string, event_ts timestamp"
    rows = [("L", 1, "a", None), ("L", 1, "a", "2024-01-02"), ("L", 2, "a", None), ("L", 2, "a", None), ("L", 3, "a", "2024-01-03")]
    names = "ledger_id string, account_id long, hash string, t string"
    # The second batch repeats a key that has no time and brings a new one.
    for batch in (rows, [("L", 2, "a", None), ("L", 4, "a", None)]):
        made = spark.createDataFrame(batch, names).select("ledger_id", "account_id", "hash", F.col("t").cast("timestamp").alias("event_ts"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream.feed_stream(spark, str(tmp_path / "in"), schema)
        stream.ingest_stream(source, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    found = [(r.ledger_id, r.account_id, r.event_ts and str(r.event_ts.date())) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(found, key=str) == [("L", 1, "2024-01-02"), ("L", 2, None), ("L", 3, "2024-01-03"), ("L", 4, None)]


def test_hierarchy_refuses_cycles(spark):
    rows = [("L", 1, 2, "a"), ("L", 2, 1, "b"), ("L", 3, 1, "c"), ("L", 4, None, "d")]
    with pytest.raises(ValueError, match="ancestors"):
        feeds.hierarchy_paths(spark.createDataFrame(rows, "ledger_id string, id long, parent_id long, title string"))


def test_hierarchy_and_names(spark):
    tree = spark.createDataFrame(
        [("L", i, i - 1 if i > 1 else None, f"t{i}") for i in range(1, 12)] + [("L", 99, 77, "orphan")],
        "ledger_id string, id long, parent_id long, title string",
    )
    paths = {r.id: r.path for r in feeds.hierarchy_paths(tree).collect()}
    assert paths[11] == "/".join(f"t{i}" for i in range(1, 12)) and paths[99] == "orphan"
    names = spark.createDataFrame(
        [("L", 1, "My Bank", "A & B"), ("L", 2, "My Bank", "A B"), ("L", 3, None, "-x-")],
        "ledger_id string, id long, bank_title string, title string",
    )
    got = {r.id: (r.bank_slug, r.account_slug) for r in feeds.disambiguate_names(names).collect()}
    assert got == {1: ("My-Bank", "A-B-1"), 2: ("My-Bank", "A-B-2"), 3: ("Unknown", "x")}


def test_equal_files_of_one_batch(spark):
    files = spark.createDataFrame(
        [("L", 1, "b.csv", "h"), ("L", 1, "a.csv", "h"), ("L", 2, "c.csv", "h")],
        "ledger_id string, account_id long, source_file string, content_hash string",
    )
    none = spark.createDataFrame([], struct("imported_files"))
    assert {r.source_file for r in exports.skip_imported(files, none).collect()} == {"a.csv", "c.csv"}
