"""The classification run: transfers, then rules, then category suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.functions.periods import Calendar
from passbook.functions.text import normalise_merchant
from passbook.operators import features, views
from passbook.operators.curate import create_transfers, set_categories
from passbook.operators.history import suggest_from_history
from passbook.operators.linear import predict_linear, train_linear
from passbook.operators.rules import apply_rules
from passbook.operators.transfers import detect_transfers
from passbook.schema import Books
from passbook.session import cut_lineage

TIERS = ("exact", "recurring", "model", "unclassified")


@dataclass(frozen=True)
class Model:
    """A fitted linear model with the vocabulary it was trained on."""

    vocabulary: DataFrame
    weights: DataFrame


def train(examples: DataFrame) -> Model:
    """Fit on all examples (ledger_id, id, norm, category_id); empty keys stay in the corpus."""
    docs = features.documents(examples)
    counts = cut_lineage(features.term_counts(docs))
    vocabulary = cut_lineage(features.tfidf_fit(docs, counts))
    rows = cut_lineage(
        examples.join(docs.select("ledger_id", "norm", "doc"), ["ledger_id", "norm"]).select(
            "ledger_id", "id", "doc", "category_id"
        )
    )
    return Model(vocabulary, cut_lineage(train_linear(rows, features.tfidf_transform(counts, vocabulary))))


def suggest(model: Model, rows: DataFrame) -> DataFrame:
    """(ledger_id, norm, category_id, confidence) by the linear model for the distinct keys of ``rows``."""
    docs = features.documents(rows.filter(F.col("norm") != ""))
    vectors = features.tfidf_transform(features.term_counts(docs), model.vocabulary)
    found = predict_linear(docs, vectors, model.weights)
    return found.join(docs.select(*features.DOC, "norm"), features.DOC).drop("doc")


def classify_cascade(inputs: DataFrame, examples: DataFrame) -> DataFrame:
    """Inputs with category_id, confidence and source.

    An empty merchant key gets nothing; otherwise the newest earlier example
    of the same key and amount, else of the same key, else the linear model.
    ``inputs`` hold (ledger_id, id, norm, amount_cents, date), ``examples`` a
    category_id as well.
    """
    # Both sides are read by several branches below.
    inputs, examples = cut_lineage(inputs), cut_lineage(examples)
    from_history = cut_lineage(suggest_from_history(inputs, examples))
    open_rows = from_history.filter(F.col("suggestion").isNull())
    guessed = suggest(train(examples), open_rows).select(
        "ledger_id",
        "norm",
        F.struct("category_id", "confidence", F.lit("model").alias("source")).alias("_model"),
    )
    picked = from_history.join(guessed, ["ledger_id", "norm"], "left").withColumn(
        "suggestion", F.when(F.col("norm") != "", F.coalesce("suggestion", "_model"))
    )
    return picked.select(
        *inputs.columns,
        "suggestion.category_id",
        "suggestion.confidence",
        F.coalesce("suggestion.source", F.lit("unclassified")).alias("source"),
    )


def classify_report(outcomes: DataFrame) -> DataFrame:
    """Rows per tier, per ledger."""
    return outcomes.groupBy("ledger_id", "source").agg(F.count(F.lit(1)).alias("rows"))


def evaluate(train_rows: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Accuracy and rows per tier on labelled data; an unclassified row counts as wrong.

    Both hold (ledger_id, id, description, amount_cents, date, category_id).
    """
    keyed = lambda df: df.withColumn("norm", normalise_merchant("description"))
    examples = keyed(train_rows)
    wanted = keyed(test_rows).withColumnRenamed("category_id", "expected")
    scored = classify_cascade(wanted.drop("description"), examples)
    right = F.coalesce((F.col("category_id") == F.col("expected")).cast("int"), F.lit(0))
    return scored.groupBy("ledger_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(right).alias("accuracy"),
        *[F.count(F.when(F.col("source") == t, 1)).alias(t) for t in TIERS],
    )


@dataclass(frozen=True)
class ClassifyRun:
    books: Books
    report: DataFrame


def classify(books: Books, at: str, cal: Calendar | None = None) -> ClassifyRun:
    """One full run.

    Transfers beat rules: every live row without a confirmed category is a
    candidate.  Rules follow, and what is still uncategorised gets an
    unconfirmed suggestion.  Each step's state is written once before the next.
    """
    view = views.ledger_view(books.transactions, books.accounts, books.banks)
    detected = cut_lineage(
        detect_transfers(
            views.unconfirmed(view, books.enrichments, books.transfers),
            views.confirmed_transfer_examples(view, books.transfers),
        )
    )
    links = detected.withColumn("source", F.lit("auto")).withColumn("confirmed", F.lit(False))
    linked = create_transfers(books, links, at)
    linked = linked.with_tables(
        transfers=cut_lineage(linked.transfers), enrichments=cut_lineage(linked.enrichments)
    )

    run = apply_rules(linked, at, cal, materialise=True)
    changes = run.changes
    ruled = linked.with_tables(enrichments=cut_lineage(run.enrichments))

    examples = views.confirmed_category_examples(ruled.transactions, ruled.enrichments).withColumn(
        "norm", normalise_merchant("description")
    )
    inputs = views.uncategorised(view, ruled.enrichments, ruled.transfers).select(
        "ledger_id", "id", "amount_cents", "date", normalise_merchant("description").alias("norm")
    )
    outcomes = cut_lineage(classify_cascade(inputs, examples))
    edits = outcomes.filter(F.col("category_id").isNotNull()).select(
        "ledger_id",
        F.col("id").alias("transaction_id"),
        "category_id",
        F.lit("ai").alias("category_source"),
        F.lit(False).alias("category_confirmed"),
        F.col("confidence").alias("ai_confidence"),
    )
    done = ruled.with_tables(enrichments=set_categories(ruled.enrichments, edits, ruled.transfers, at))
    report = (
        detected.select("ledger_id", F.lit("transfers").alias("source"))
        .unionByName(changes.select("ledger_id", F.lit("filtered").alias("source")))
        .unionByName(outcomes.select("ledger_id", "source"))
    )
    return ClassifyRun(done, classify_report(report))


def apply_to_similar(
    books: Books, ledger_id: str, transaction_id: int, category_id: int, at: str, top: int
) -> tuple[DataFrame, DataFrame]:
    """Categorise one transaction and offer its unconfirmed look-alikes.

    Returns (enrichments after the edit, look-alikes with their similarity,
    most similar and then newest first).  Applying the offer is
    ``set_categories`` on the rows the user keeps.
    """
    here = books.transactions.filter(F.col("ledger_id") == ledger_id)
    edit = here.filter(F.col("id") == transaction_id).select(
        "ledger_id",
        F.col("id").alias("transaction_id"),
        F.lit(category_id).cast("bigint").alias("category_id"),
        F.lit("manual").alias("category_source"),
        F.lit(True).alias("category_confirmed"),
        F.lit(None).cast("double").alias("ai_confidence"),
    )
    enrichments = set_categories(books.enrichments, edit, books.transfers, at, strict=True)
    view = views.ledger_view(here, books.accounts, books.banks)
    keyed = lambda df: df.withColumn("norm", normalise_merchant("description"))
    pool = keyed(views.unconfirmed(view, books.enrichments, books.transfers))
    query = keyed(here.filter(F.col("id") == transaction_id))
    pool = pool.select("ledger_id", "id", "norm")
    extra = keyed(views.confirmed_category_examples(here, books.enrichments)).select("ledger_id", "norm")
    found = features.similar_transactions(query.select("ledger_id", "id", "norm"), pool, top, extra)
    offer = (
        here.join(found.select("ledger_id", "id", "similarity"), ["ledger_id", "id"])
        .select("ledger_id", "id", "date", "description", "amount_cents", "similarity")
        .orderBy(F.desc("similarity"), F.desc("date"))
    )
    return enrichments, offer
