"""The stream of new keys over many batches: repeats, late rows, replays, damage."""

import random
import shutil
from datetime import datetime, timedelta

import pytest

from passbook.streaming import ingest as stream

SCHEMA = "ledger_id string, account_id long, hash string, event_ts timestamp, n long"


def run(spark, place, **how):
    source = stream.feed_stream(spark, f"{place}/in", SCHEMA)
    query = stream.ingest_stream(source, f"{place}/out", f"{place}/log", partitions=2, **how)
    query.awaitTermination()
    return query


def stored(spark, place):
    return sorted((r.account_id, r.hash, r.event_ts, r.n) for r in spark.read.parquet(f"{place}/out").collect())


def test_twenty_batches(spark, tmp_path):
    rng, place, begin = random.Random(9), str(tmp_path), datetime(2024, 1, 1)
    wanted, n, read = {}, 0, []
    for batch in range(20):
        rows, mine = [], {}
        for _ in range(40):
            # Old keys and new ones, on time, late by years, or without a time.
            key = rng.randrange(4), f"h{rng.randrange(20 + 10 * batch)}"
            at = rng.choice([None, begin + timedelta(days=batch), begin - timedelta(days=rng.randrange(2000))])
            n += 1
            rows.append(("L", *key, at, n))
            # Times of one key in one batch differ, so that the first is defined.
            if key not in wanted and (key not in mine or (at is not None and (mine[key][0] is None or at < mine[key][0]))):
                mine[key] = at, n
        times = {}
        for _, *key, at, number in rows:
            times.setdefault((*key, at), []).append(number)
        wanted |= {k: (at, times[*k, at]) for k, (at, _) in mine.items()}
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
        query = run(spark, place)
        read.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
        if batch == 12:
            # The batch was written, but the log of commits does not know: it is replayed.
            folder = tmp_path / "log" / "commits"
            for f in folder.glob(f"*{max(int(c.name) for c in folder.iterdir() if c.name.isdigit())}*"):
                f.unlink()
            before = stored(spark, place)
            run(spark, place)
            assert stored(spark, place) == before
    found = stored(spark, place)
    assert len(found) == len(wanted) == len({f[:2] for f in found})
    for account, key, at, number in found:
        assert wanted[account, key][0] == at and number in wanted[account, key][1]
    # A batch touches no more keys than it has, whatever is stored.
    assert max(read) <= 40


def test_damage_and_strange_sinks_raise(spark, tmp_path):
    place = str(tmp_path)
    rows = spark.createDataFrame([("L", i, "a", None, i) for i in range(30)], SCHEMA)
    rows.write.parquet(f"{place}/in")
    run(spark, place)
    before = stored(spark, place)
    assert len(before) == 30
    rows.write.mode("append").parquet(f"{place}/in")
    kept = tmp_path / "kept"
    shutil.copytree(tmp_path / "log", kept)
    # Without its state the stream stops, and nothing is appended.
    for f in (tmp_path / "log" / "state").rglob("*"):
        if f.is_file() and f.suffix in (".zip", ".changelog", ".sst"):
            f.unlink()
    with pytest.raises(Exception):
        run(spark, place)
    assert stored(spark, place) == before
    # A new checkpoint for a sink that has records of another.
    shutil.move(tmp_path / "log", tmp_path / "damaged")
    spark.read.parquet(f"{place}/out/batch=0").write.parquet(f"{place}/out/batch=7")
    with pytest.raises(Exception, match="another checkpoint"):
        run(spark, place)
    shutil.rmtree(tmp_path / "out" / "batch=7")
    shutil.move(tmp_path / "log", tmp_path / "strange")
    shutil.move(kept, tmp_path / "log")
    run(spark, place)
    assert stored(spark, place) == before
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stream.ROCKSDB
