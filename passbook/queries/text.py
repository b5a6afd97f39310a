"""Full text over whole documents and merchant texts."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from passbook.functions.text import searchable_text, tokens
from passbook.operators import fulltext, predicates, search, segments
from passbook.queries import query
from passbook.queries.search import LIVE
from passbook.session import checkpoint_root, cut_lineage
from passbook.sources import star, store
from passbook.sources.sinks import csv_field

# Word lists of documents (description, metadata, note) as the SQL side makes them.
WORDS = """(SELECT t.ledger_id AS ledger_id, t.id AS id,
              [x FOR x IN string_split(regexp_replace(strip_accents(LOWER(t.description || ' ' || source_file || ' '
                || CAST(t.amount_cents AS STRING) || COALESCE(' ' || n.note, ''))), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') IF x <> ''] AS words
            FROM {doc_tx} t LEFT JOIN {doc_notes} n ON t.ledger_id = n.ledger_id AND t.id = n.transaction_id)"""


def _docs(spark, sf):
    return star.frame(spark, sf, "doc_tx"), star.frame(spark, sf, "doc_notes")


def _index(spark, sf) -> str:
    """The stored index of the documents, built by the first search and again when the files change."""
    files = [store.modified(spark, f"{sf}/{name}.parquet") for name in ("documents", "labels")]
    root = f"{checkpoint_root(spark)}/index-{hashlib.sha256(repr((sf, files)).encode()).hexdigest()[:24]}"
    if store.latest(spark, root) is None:
        segments.create_index(spark, root, *_docs(spark, sf))
    return root


def _postings(spark, sf):
    return segments.index_postings(spark, _index(spark, sf))


@query("searchable_words", f"""
    SELECT ledger_id, id, CAST(len(words) AS BIGINT) AS words, CAST(len(list_distinct(words)) AS BIGINT) AS terms FROM {WORDS}""")
def searchable_words(spark, sf):
    tx, notes = _docs(spark, sf)
    rows = tx.join(notes.select("ledger_id", F.col("transaction_id").alias("id"), "note"), ["ledger_id", "id"], "left")
    words = tokens(searchable_text("description", "metadata", "note"))
    return rows.select(
        "ledger_id", "id", F.size(words).cast("bigint").alias("words"),
        F.size(F.array_distinct(words)).cast("bigint").alias("terms"),
    )


def _hits():
    return F.sum(F.size("ids"))


def _rows():
    """Rows with a term: each id of it is in one block."""
    return F.sum(F.size(F.array_distinct("ids")))


@query("postings", f"""
    SELECT ledger_id, term, CAST(COUNT(*) AS BIGINT) AS hits, CAST(COUNT(DISTINCT id) AS BIGINT) AS rows
    FROM (SELECT ledger_id, id, unnest(words) AS term FROM {WORDS}) GROUP BY 1, 2""")
def postings(spark, sf):
    return fulltext.build_blocks(*_docs(spark, sf)).groupBy("ledger_id", "term").agg(_hits().alias("hits"), _rows().alias("rows"))


@query("indexed_rows", "SELECT ledger_id, CAST(COUNT(*) AS BIGINT) AS rows FROM {doc_tx} GROUP BY 1")
def indexed_rows(spark, sf):
    return fulltext.indexed_rows(star.frame(spark, sf, "doc_tx"))


@query("stored_index", f"""
    SELECT ledger_id, CAST(SUM(len(words)) AS BIGINT) AS postings FROM {WORDS} GROUP BY 1 HAVING SUM(len(words)) > 0""")
def stored_index(spark, sf):
    """Postings of the stored index that the searches share."""
    return segments.index_blocks(spark, _index(spark, sf)).groupBy("ledger_id").agg(_hits().alias("postings"))


def _edited(spark, sf, edits=5):
    """An index built without notes, and brought up to date by ``edits`` refreshes and merges."""
    tx, notes = _docs(spark, sf)
    root = f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}"
    segments.create_index(spark, root, tx)
    noted = cut_lineage(tx.join(notes.select("ledger_id", F.col("transaction_id").alias("id")), ["ledger_id", "id"], "left_semi"))
    for edit in range(edits):
        part = F.pmod(F.xxhash64("id"), F.lit(edits)) == edit
        segments.refresh_index(spark, root, noted.filter(part), notes)
        segments.merge_segments(spark, root)
    return root


@query("postings_in_order", "SELECT lang AS ledger_id, doc_id AS id, text AS term, text AS problem FROM {documents} WHERE FALSE")
def postings_in_order(spark, sf):
    """Five refreshes of the noted documents leave an index built without notes in order."""
    held = segments.index_blocks(spark, _edited(spark, sf))
    return fulltext.check_blocks(held, *_docs(spark, sf))


@query("segment_postings", f"""
    SELECT ledger_id, term, CAST(COUNT(*) AS BIGINT) AS hits, CAST(SUM(pos) AS BIGINT) AS places, CAST(COUNT(DISTINCT id) AS BIGINT) AS rows
    FROM (SELECT ledger_id, id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM {WORDS}) GROUP BY 1, 2""")
def segment_postings(spark, sf):
    """What five small segments over the first leave of each word."""
    held = segments.index_blocks(spark, _edited(spark, sf))
    places = F.sum(F.aggregate("places", F.lit(0).cast("bigint"), lambda total, at: total + at)).alias("places")
    return held.groupBy("ledger_id", "term").agg(_hits().alias("hits"), places, _rows().alias("rows"))


@query("postings_stale", """
    SELECT lang AS ledger_id, CAST(COUNT(*) AS BIGINT) AS pairs FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
    WHERE quality = 1 AND NOT list_contains(string_split(regexp_replace(strip_accents(LOWER(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), 'kept')
    GROUP BY 1""")
def postings_stale(spark, sf):
    """The missing word of every kept document in an index that saw no notes."""
    tx, notes = _docs(spark, sf)
    found = fulltext.check_postings(fulltext.build_postings(tx), tx, notes)
    return found.filter((F.col("term") == "kept") & (F.col("problem") == "missing")).groupBy("ledger_id").agg(
        F.count(F.lit(1)).alias("pairs")
    )


def _has(word: str) -> str:
    return f"list_contains(words, '{word}')"


def _ids(name: str, condition: str, find) -> None:
    query(name, f"SELECT ledger_id, id FROM {WORDS} WHERE {condition}")(
        lambda spark, sf: find(_postings(spark, sf))
    )


_PAD = "' ' || array_to_string(words, ' ') || ' '"

_ids("match_all", f"{_has('the')} AND {_has('kept')} AND {_has('reviewed')}", lambda p: fulltext.match_all(p, ["the Kept", "REVIEWED"]))
_ids("match_any", f"{_has('dropped')} OR {_has('une')} OR {_has('src3')}", lambda p: fulltext.match_any(p, ["dropped", "une", "src3"]))
_ids(
    "match_grouped",
    f"({_has('dropped')} OR {_has('kept')}) AND {_has('le')}",
    lambda p: fulltext.intersect(
        fulltext.union(fulltext.match_all(p, "dropped"), fulltext.match_all(p, "kept")), fulltext.match_all(p, "le")
    ),
)
_ids("match_prefix", "len([x FOR x IN words IF starts_with(x, 'tion')]) > 0", lambda p: fulltext.match_prefix(p, "Tion*"))
_ids("match_phrase", f"CONTAINS({_PAD}, ' of the ')", lambda p: fulltext.match_phrase(p, "of the"))
_ids(
    "match_near",
    f"regexp_matches({_PAD}, ' the( [^ ]+){{0,2}} and ') OR regexp_matches({_PAD}, ' and( [^ ]+){{0,2}} the ')",
    lambda p: fulltext.match_near(p, "the", "and", 2),
)


@query("exclude_match", f"""
    SELECT t.ledger_id AS ledger_id, t.id AS id, t.amount_cents AS amount_cents FROM {{doc_tx}} t JOIN {WORDS} w
      ON t.ledger_id = w.ledger_id AND t.id = w.id WHERE NOT ({_has('reviewed')})""")
def exclude_match(spark, sf):
    found = fulltext.exclude_match(star.frame(spark, sf, "doc_tx"), _postings(spark, sf), "reviewed")
    return found.select("ledger_id", "id", "amount_cents")


@query("match_one_side", f"""
    SELECT k.ledger_id AS ledger_id, k.id AS id FROM {{doc_links}} k
    JOIN {WORDS} f ON f.ledger_id = k.ledger_id AND f.id = k.from_transaction_id
    JOIN {WORDS} t ON t.ledger_id = k.ledger_id AND t.id = k.to_transaction_id
    WHERE list_contains(f.words, 'kept') AND list_contains(f.words, 'the')
       OR list_contains(t.words, 'kept') AND list_contains(t.words, 'the')""")
def match_one_side(spark, sf):
    found = fulltext.match_one_side(star.frame(spark, sf, "doc_links"), _postings(spark, sf), "kept the")
    return found.select("ledger_id", "id")


@query("search_text", f"""
    SELECT v.ledger_id AS ledger_id, v.id AS id FROM {LIVE} v
    WHERE CONTAINS(description, 'BUILDING') AND NOT CONTAINS(description, 'URGENT') AND amount_cents < 0""")
def search_text(spark, sf):
    """Words and typed predicates in one search, over the postings of the orders."""
    books = star.books(spark, sf)
    index = fulltext.build_postings(books.transactions)
    found = search.search(
        books, [predicates.amount_cmp("<", "0")],
        matching=fulltext.match_all(index, "building"), excluding=fulltext.match_all(index, "urgent"),
    )
    return found.select("ledger_id", "id")


@query("csv_fields", """
    SELECT doc_id AS id, sha256(CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || REPLACE(text, '"', '""') || '"' ELSE text END) AS field
    FROM {documents}""")
def csv_fields(spark, sf):
    return star.frame(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.sha2(csv_field("text"), 256).alias("field")
    )
