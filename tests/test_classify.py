"""History, features, the linear model and the full run."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import AT, table
from passbook.operators import features, linear
from passbook.plans import classify as plan

EX = "ledger_id string, id long, norm string, amount_cents long, date date, category_id long"
IN = "ledger_id string, id long, norm string, amount_cents long, date date"


def day(n):
    return date(2024, 1, 1) + timedelta(n)


def cascade(spark, examples, inputs):
    ex = spark.createDataFrame([("L", i, *e) for i, e in enumerate(examples)], EX)
    rows = spark.createDataFrame([("L", 100 + i, *e) for i, e in enumerate(inputs)], IN)
    return [(r.category_id, r.confidence, r.source) for r in plan.classify_cascade(rows, ex).orderBy("id").collect()]


def test_cascade(spark):
    examples = [
        ("rent", -100, day(1), 1), ("rent", -100, day(5), 2), ("rent", -200, day(7), 3),
        ("gym", -50, day(2), 4), ("gym", -60, day(30), 4), ("", -1, day(0), 4),
    ]
    got = cascade(
        spark, examples,
        [("rent", -100, day(6)), ("rent", -300, day(8)), ("gym", -50, day(2)), ("gym", -55, day(3)), ("", -1, day(9)), ("rent", -100, day(5))],
    )
    assert got[0] == (2, 0.99, "exact")
    assert got[1] == (3, 0.40, "recurring")
    # The same day is not earlier: the model decides.
    assert got[2][2] == "model"
    # Later history still counts for being unambiguous.
    assert got[3] == (4, 0.95, "recurring")
    assert got[4] == (None, None, "unclassified")
    assert got[5] == (1, 0.99, "exact")


def test_abstains_with_one_class(spark):
    assert cascade(spark, [("gym", -50, day(9), 4), ("gym x", -50, day(9), 4)], [("gym", -50, day(1))])[0][2] == "unclassified"


def reference_fit(rows, labels, width):
    """The same training with explicit sums over all steps."""
    classes = sorted(set(labels))
    draws, order = linear._draws(), list(range(len(rows)))
    w = np.zeros((len(classes), width + 1))
    total = np.zeros_like(w)
    steps = 0
    for _ in range(linear.EPOCHS):
        for last in range(len(order) - 1, 0, -1):
            other = next(draws) % (last + 1)
            order[last], order[other] = order[other], order[last]
        for r in order:
            x = np.append(rows[r], 1.0)
            for k, c in enumerate(classes):
                y = 1.0 if labels[r] == c else -1.0
                loss = 1.0 - y * (w[k] @ x)
                if loss > 0:
                    n = labels.count(c) if y > 0 else len(rows) - labels.count(c)
                    w[k] += min(loss / (x @ x), linear.STEP_CAP * len(rows) / (2 * n)) * y * x
            steps += 1
            total += w
    return classes, total / steps


def linear_group(dense, labels):
    import pandas as pd

    named = [[(f"f{j}", v) for j, v in enumerate(row) if v] for row in dense]
    return pd.DataFrame({
        "ledger_id": "L", "id": range(len(labels)), "category_id": labels, "classes": [sorted(set(labels))] * len(labels),
        "features": [[f for f, _ in row] for row in named], "weights": [[v for _, v in row] for row in named],
    })


def test_training_equals_plain_sums(spark):
    rng = random.Random(4)
    dense = [[rng.random() if rng.random() < 0.5 else 0.0 for _ in range(6)] for _ in range(30)]
    labels = [rng.randint(1, 3) for _ in dense]
    examples = spark.createDataFrame(
        [("L", i, i, c) for i, c in enumerate(labels)], "ledger_id string, id long, doc long, category_id long"
    )
    vectors = spark.createDataFrame(
        [("L", i, f"f{j}", v) for i, row in enumerate(dense) for j, v in enumerate(row) if v],
        "ledger_id string, doc long, feature string, weight double",
    )
    classes, want = reference_fit(np.array(dense), labels, 6)
    for block in (64, 2):
        got = {(r["class"], r.feature): r.weight for r in linear.train_linear(examples, vectors, class_block=block).collect()}
        for k, c in enumerate(classes):
            assert math.isclose(got[(c, "")], want[k][6], abs_tol=1e-9)
            for j in range(6):
                assert math.isclose(got.get((c, f"f{j}"), 0.0), want[k][j], abs_tol=1e-9)
    # Two classes at a time give the same.
    before, linear.FIT_BYTES = linear.FIT_BYTES, 16 * 6
    out = linear._fit_group(linear_group(dense, labels))
    linear.FIT_BYTES = before
    again = {(c, f): w for c, f, w in zip(out["class"], out["feature"], out["weight"])}
    assert again.keys() == got.keys() and all(math.isclose(again[k], w, abs_tol=1e-12) for k, w in got.items())
    # A bounded sample: the same rows each time, the exact pass on them.
    chosen = [{r.id for r in linear.fit_sample(examples, vectors, fit_rows=7).collect()} for _ in range(2)]
    assert chosen[0] == chosen[1] and len(chosen[0]) == 7
    part = linear.train_linear(examples.filter(F.col("id").isin(*chosen[0])), vectors)
    bounded = linear.train_linear(examples, vectors, fit_rows=7)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, bounded.collect()))
    assert linear.fit_sample(examples, vectors, fit_entries=1).count() == 1


@pytest.mark.parametrize("group, scores", [(512, 1 << 22), (4, 1)])
def test_prediction_against_all_scores(spark, monkeypatch, group, scores):
    monkeypatch.setattr(linear, "DOCS", group)
    monkeypatch.setattr(linear, "SCORES", scores)
    rng = random.Random(5)
    model, bias = {}, {}
    for c in range(9):
        bias[c] = rng.choice([-0.5, 0.0, 0.25, 1.0])
        for f in rng.sample(range(6), 3):
            model[c, f"f{f}"] = rng.choice([-1.0, -0.25, 0.5, 2.0])
    rows = [("L", c, f, w) for (c, f), w in model.items()] + [("L", c, "", b) for c, b in bias.items()]
    weights = spark.createDataFrame(rows, "ledger_id string, class long, feature string, weight double")
    docs = {d: {f"f{f}": rng.choice([0.5, 1.0]) for f in rng.sample(range(8), rng.randrange(5))} for d in range(60)}
    vectors = spark.createDataFrame(
        [("L", d, f, v) for d, fs in docs.items() for f, v in fs.items()], "ledger_id string, doc long, feature string, weight double"
    )
    found = linear.predict_linear(spark.createDataFrame([("L", d) for d in docs] + [("M", 1)], "ledger_id string, doc long"), vectors, weights)
    got = {r.doc: (r.category_id, r.confidence) for r in found.collect()}
    assert set(got) == set(docs)
    for d, fs in docs.items():
        scores = sorted(((bias[c] + sum(v * model.get((c, f), 0.0) for f, v in fs.items()), -c) for c in bias), reverse=True)
        lead = scores[0][0] - scores[1][0]
        assert got[d][0] == -scores[0][1]
        assert math.isclose(got[d][1], 0.5 + 0.4 * (2 / (1 + math.exp(-lead)) - 1))


def test_top_two_in_blocks_of_classes():
    rng = np.random.default_rng(6)
    x, w, bias = rng.integers(0, 3, (40, 12)) * (rng.random((40, 12)) < 0.3), rng.integers(-2, 3, (12, 7)), rng.integers(-1, 2, 7).astype(float)
    docs, features = np.nonzero(x)
    at = np.nonzero(w)
    want = x @ w + bias
    for block in (1, 3, 10**6):
        linear.SCORES, before = block * max(len(docs), 40), linear.SCORES
        best, scores = linear.top_two(docs, features, x[docs, features].astype(float), 40, (*at, w[at].astype(float)), bias, 12)
        linear.SCORES = before
        order = np.lexsort((np.tile(np.arange(7), (40, 1)), -want))[:, :2]
        assert (best == order).all() and (scores == np.take_along_axis(want, order, 1)).all()


def test_ngrams(spark):
    row = spark.createDataFrame([("ab c",)], "t string").select(features.ngrams("t")).first()[0]
    assert sorted(row) == sorted(
        ["wab", "wc", "wab c", "c ab", "cab ", "c ab ", "c ab ", "c c ", "c c ", "c c "]
    )


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(8)
    words = ["bakery", "shop", "north", "south", "market", "fuel", "station", "the"]
    norms = [" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)]
    rows = spark.createDataFrame([("L", i, n) for i, n in enumerate(norms)], "ledger_id string, id long, norm string")
    docs, vectors = features.similarity_vectors(rows)
    table_ = {}
    for r in vectors.collect():
        table_.setdefault(r.doc, {})[r.feature] = r.weight
    want = {
        (a, b)
        for a, x in table_.items()
        for b, y in table_.items()
        if sum(w * y.get(f, 0.0) for f, w in x.items()) >= features.THRESHOLD
    }
    got = {(r.query_doc, r.doc) for r in features.similar_documents(docs, vectors).collect()}
    assert got == want
    top = features.similar_transactions(rows, rows, top=3)
    per = {}
    for r in top.collect():
        per.setdefault(r.query_id, []).append((r.place, r.id))
        assert r.id != r.query_id
    assert max(len(v) for v in per.values()) == 3
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in per.values())


@pytest.mark.parametrize("top", [1, 2, 5, 200])
def test_top_lists_equal_full_scores(spark, top):
    """Lists with a floor per query against all scores; equal texts and equal similarities tie by id."""
    rng = random.Random(21)
    words = ["bakery", "shop", "north", "south", "market", "fuel", "station", "the"]
    norms = [" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(90)] + ["the shop"] * 8 + ["", "only one"]
    rows = spark.createDataFrame([("LM"[i % 2], i, n) for i, n in enumerate(norms)], "ledger_id string, id long, norm string")
    asked = rows.filter("id % 3 = 0").unionByName(spark.createDataFrame([("L", 500, "bakery the"), ("L", 501, "strange")], rows.schema))
    docs, vectors = features.similarity_vectors(rows, queries=asked)
    weights = {}
    for r in vectors.collect():
        weights.setdefault((r.ledger_id, r.doc), {})[r.feature] = r.weight
    doc_of = {(r.ledger_id, r.norm): r.doc for r in docs.collect()}
    want = []
    for q in asked.collect():
        mine = weights.get((q.ledger_id, doc_of[q.ledger_id, q.norm]), {})
        found = []
        for c in rows.filter(F.col("ledger_id") == q.ledger_id).collect():
            theirs = weights.get((c.ledger_id, doc_of[c.ledger_id, c.norm]), {})
            score = sum(w * theirs.get(f, 0.0) for f, w in mine.items())
            if c.id != q.id and score >= features.THRESHOLD:
                found.append((-round(score, 7), c.id))
        want += [(q.ledger_id, q.id, i, -s, place) for place, (s, i) in enumerate(sorted(found)[:top], 1)]
    got = features.similar_transactions(asked, rows, top=top, digits=7)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # A small list reads fewer documents than the threshold alone.
    ids = asked.join(docs, ["ledger_id", "norm"]).select("ledger_id", "doc").distinct()
    few = features.top_documents(ids, vectors, docs, top).count()
    every = features.similar_documents(ids, vectors).count()
    assert few < every if top < 3 else few <= every


def test_full_run(spark, golden):
    rules = table(spark, "rules", [{
        "id": 1, "name": "r", "position": 0, "category_id": 3, "override_mode": "uncategorised", "review_required": False,
        "terms": [("text", "dividend", False)],
    }])
    more = [
        {"id": 8, "account_id": 1, "date": day(200), "description": "Corner Bakery", "amount_cents": -1240, "metadata": "{}"},
        {"id": 9, "account_id": 1, "date": day(210), "description": "Move", "amount_cents": -7700, "metadata": "{}"},
        {"id": 10, "account_id": 2, "date": day(210), "description": "Move", "amount_cents": 7700, "metadata": "{}"},
        {"id": 11, "account_id": 1, "date": day(220), "description": "99", "amount_cents": -1, "metadata": "{}"},
    ]
    books = golden.with_tables(rules=rules, transactions=golden.transactions.unionByName(table(spark, "transactions", more)))
    run = plan.classify(books, AT)
    assert {r.source: r.rows for r in run.report.collect()} == {"transfers": 1, "filtered": 1, "exact": 1, "unclassified": 1}
    after = {r.transaction_id: (r.category_id, r.category_source, r.category_confirmed) for r in run.books.enrichments.collect()}
    assert after[8] == (1, "ai", False) and after[4] == (3, "rule", True)
    link = run.books.transfers.filter("source = 'auto'").first()
    # The two accounts have a confirmed link already.
    assert (link.from_transaction_id, link.to_transaction_id, link.ai_confidence, link.confirmed) == (9, 10, 0.8, False)


def test_apply_to_similar(spark, golden):
    more = [
        {"id": 20 + i, "account_id": 1, "date": day(i), "description": d, "amount_cents": -1}
        for i, d in enumerate(["Corner Bakery North", "Corner Bakery North", "Petrol Station", "Corner Bakery Nort"])
    ]
    books = golden.with_tables(transactions=golden.transactions.unionByName(table(spark, "transactions", more)))
    enrichments, offer = plan.apply_to_similar(books, "L", 20, 1, AT, top=200)
    assert enrichments.filter("transaction_id = 20").first().category_source == "manual"
    rows = offer.collect()
    assert rows[0].id == 21 and rows[0].similarity == pytest.approx(1.0)
    assert 22 not in {r.id for r in rows} and 20 not in {r.id for r in rows}


def test_evaluate(spark):
    schema = "ledger_id string, id long, description string, amount_cents long, date date, category_id long"
    names = {1: ["Coffee Shop", "Coffee House"], 2: ["Fuel Station", "Fuel Depot"]}
    train = [("L", i, names[c][i % 2], -i, day(i), c) for i in range(20) for c in (1 + i % 2,)]
    test = [("L", 100 + i, names[1 + i % 2][0] + " new", -1, day(50), 1 + i % 2) for i in range(6)]
    row = plan.evaluate(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)).first()
    assert row.accuracy == 1.0 and row.model == 6 and row["rows"] == 6


def test_similar_transactions_looks_up_every_row(spark, tmp_path, monkeypatch):
    from passbook import queries

    queries.load()
    assert "supplier" not in queries.SQL["similar_transactions"]
    spark.createDataFrame(
        [(i, "Brand#1", "STEEL", f"bolt {i}") for i in range(4)], "p_partkey long, p_brand string, p_type string, p_name string"
    ).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(features, "similar_transactions", lambda asked, rows, **_: asked)
    asked = queries.QUERIES["similar_transactions"](spark, str(tmp_path))
    assert sorted(r.id for r in asked.collect()) == [0, 1, 2, 3]


def test_similar_transactions_lists_every_look_alike(spark, tmp_path):
    """More look-alikes than any list was cut to, equal texts and others, each with its place."""
    from passbook import queries

    queries.load()
    assert "200" not in queries.SQL["similar_transactions"]
    rows = [(i, "Brand#1", "STEEL", "round bolt with a long head" if i < 110 else "round bolts with a long head") for i in range(208)] + [(300, "Brand#1", "TIN", "red cup")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    found = queries.QUERIES["similar_transactions"](spark, str(tmp_path)).collect()
    assert len(found) == 208 * 207
    mine = sorted((r.place, r.id) for r in found if r.query_id == 100)
    assert mine == [(p, i) for p, i in enumerate([i for i in range(208) if i != 100], 1)]
    other = sorted((r.place, r.id) for r in found if r.query_id == 206)
    assert other == [(p, i) for p, i in enumerate([*range(110, 206), 207, *range(110)], 1)]


def test_features_are_counted_in_place(spark):
    keys = ["ab c ab", "", " a\tbb  a bb ", "réf 1", "x" * 9]
    rows = spark.createDataFrame([("L", i, k, 1) for i, k in enumerate(keys)], "ledger_id string, doc long, norm string, n long")
    counted = features.term_counts(rows)
    # A document is one row, so nothing is shuffled.
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    plain = rows.select("doc", F.explode(features.ngrams("norm")).alias("feature")).groupBy("doc", "feature").count()
    assert {tuple(r) for r in counted.select("doc", "feature", "tf").collect()} == {tuple(r) for r in plain.collect()}


def test_fit_reads_every_row_of_a_ledger(spark):
    """Classes that only the last rows by a hash of the id have are learned, whatever the number of rows."""
    last = [r.id for r in spark.range(20_100).orderBy(F.xxhash64("id").desc(), F.desc("id")).limit(2).collect()]
    text = F.when(F.col("id").isin(last), "gamma ray").when(F.col("id") % 2 == 0, "alpha shop").otherwise("beta market")
    kind = F.when(F.col("id").isin(last), 3).otherwise(1 + F.col("id") % 2).cast("long")
    rows = spark.range(20_100).select(F.lit("L").alias("ledger_id"), "id", text.alias("norm"), kind.alias("category_id"))
    model = plan.train(rows)
    assert {r["class"] for r in model.weights.select("class").distinct().collect()} == {1, 2, 3}
    asked = spark.createDataFrame([("L", 1, "gamma ray"), ("L", 2, "alpha shop")], "ledger_id string, id long, norm string")
    assert {r.norm: r.category_id for r in plan.suggest(model, asked).collect()} == {"gamma ray": 3, "alpha shop": 1}


@pytest.mark.parametrize("noise, calm, ahead, few", [(0.0, 1, 4, 0), (0.3, 2, 8, 256), (0.0, 1, 4, 256), (0.3, 10**9, 1, 0)])
def test_rows_without_loss_are_skipped_exactly(spark, monkeypatch, noise, calm, ahead, few):
    """Many rows share a document; runs of rows without loss are found together, with the weights of the plain pass."""
    monkeypatch.setattr(linear, "TABLE_DOCS", few)
    monkeypatch.setattr(linear, "CALM", calm)
    monkeypatch.setattr(linear, "AHEAD", ahead)
    monkeypatch.setattr(linear, "PART", 7)
    rng = random.Random(9)
    dense = [[rng.random() if rng.random() < 0.6 else 0.0 for _ in range(5)] for _ in range(8)] + [[0.0] * 5]
    docs = [rng.randrange(len(dense)) for _ in range(60)]
    labels = [rng.randint(1, 3) if rng.random() < noise else 1 + d % 3 for d in docs]
    examples = spark.createDataFrame(
        [("L", i, d, c) for i, (d, c) in enumerate(zip(docs, labels))], "ledger_id string, id long, doc long, category_id long"
    )
    vectors = spark.createDataFrame(
        [("L", d, f"f{j}", v) for d, row in enumerate(dense) for j, v in enumerate(row) if v],
        "ledger_id string, doc long, feature string, weight double",
    )
    classes, want = reference_fit([np.array(dense[d]) for d in docs], labels, 5)
    # A ledger of its own per block beside one of another size.
    both = examples.unionByName(examples.withColumn("ledger_id", F.lit("M")).filter("id < 30"))
    more = vectors.unionByName(vectors.withColumn("ledger_id", F.lit("M")))
    got = {}
    for r in linear.train_linear(both, more, class_block=2).collect():
        got.setdefault(r.ledger_id, {})[r["class"], r.feature] = r.weight
    small = reference_fit([np.array(dense[d]) for d in docs[:30]], labels[:30], 5)
    for ledger, (kinds, weights) in {"L": (classes, want), "M": small}.items():
        for k, c in enumerate(kinds):
            for j, name in enumerate([f"f{j}" for j in range(5)] + [""]):
                assert math.isclose(got[ledger].get((c, name), 0.0), weights[k][j], abs_tol=1e-9)


def test_fit_takes_rows_without_document_or_label(spark):
    """A row of a NULL document has no features and still counts; one without a label is left out."""
    rows = [(1, 1, 1), (2, 2, 2), (3, None, 1), (4, 7, 2), (None, 1, 1), (6, 2, None)]
    examples = spark.createDataFrame([("L", *r) for r in rows], "ledger_id string, id long, doc long, category_id long")
    vectors = spark.createDataFrame([("L", 1, "f0", 1.0), ("L", 2, "f1", 0.5)], "ledger_id string, doc long, feature string, weight double")
    dense = {1: [1.0, 0.0], 2: [0.0, 0.5]}
    # A NULL id comes first.
    order = [(1, 1), (1, 1), (2, 2), (None, 1), (7, 2)]
    classes, want = reference_fit([np.array(dense.get(d, [0.0, 0.0])) for d, _ in order], [c for _, c in order], 2)
    got = {(r["class"], r.feature): r.weight for r in linear.train_linear(examples, vectors).collect()}
    for k, c in enumerate(classes):
        for j, name in enumerate(["f0", "f1", ""]):
            assert math.isclose(got.get((c, name), 0.0), want[k][j], abs_tol=1e-9)


def test_features_leave_a_task_in_bounded_batches(spark, monkeypatch):
    """A batch of texts has many times as many features; a group to score is bounded by its features too."""
    import pyarrow as pa

    monkeypatch.setattr(features, "BATCH_ROWS", 50)
    texts = ["some words in a text " + str(i) for i in range(40)] + ["", None]
    batch = pa.RecordBatch.from_pydict({"ledger_id": ["L"] * 42, "doc": list(range(42)), "n": [1] * 42, "norm": texts})
    out = list(features._counted(iter([batch])))
    most = max(len(features.count_grams(t or "")) for t in texts)
    assert len(out) >= 20 and max(b.num_rows for b in out) < 50 + most
    assert sum(b.num_rows for b in out) == sum(len(features.count_grams(t or "")) for t in texts)
    monkeypatch.setattr(linear, "DOC_ENTRIES", 16)
    docs = spark.range(40).select(F.lit("L").alias("ledger_id"), F.col("id").alias("doc"))
    vectors = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("f")).select(
        "ledger_id", "doc", F.concat(F.lit("f"), "f").alias("feature"), (F.col("doc") % 3 + F.col("f")).cast("double").alias("weight")
    )
    model = spark.createDataFrame([("L", 1, "", 0.0), ("L", 2, "", 5.0), ("L", 1, "f1", 3.0)], "ledger_id string, class long, feature string, weight double")
    found = linear.predict_linear(docs, vectors, model)
    assert {(r.doc % 3, r.category_id) for r in found.collect()} == {(0, 2), (1, 1), (2, 1)}
