"""Registered queries of the operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import (
    ann,
    bpe,
    chat,
    compress,
    divergence,
    divergence_sql,
    hyperminhash,
    level_packing,
    licenses,
    packing,
    piece_table,
    sharding,
    urls,
    vector_codes,
)
from passbook.session import checkpoint_root, cut_lineage

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    return chat.perspectives(table(spark, sf, "conversations"))


OP1_SQL = """
WITH lines AS (
  SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
), views AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM lines WHERE speaker <> 'system'
), told AS (
  SELECT l.conv_id, v.perspective, l.turn, l.speaker, l.body,
    CASE WHEN l.speaker = 'system' THEN 'system' WHEN l.speaker = v.perspective THEN 'assistant' ELSE 'user' END AS role
  FROM lines l JOIN views v ON l.conv_id IS NOT DISTINCT FROM v.conv_id
), named AS (
  SELECT *, CASE WHEN role = 'user' THEN regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') END AS name FROM told
), headed AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM named
)
SELECT conv_id, perspective, turn, speaker, role, name, head || body || '<|im_end|>' || chr(10) AS rendered,
  role = 'assistant' AS mask,
  CASE WHEN role = 'assistant' THEN length(head)::INTEGER END AS mask_start,
  CASE WHEN role = 'assistant' THEN (length(head) + length(body) + 10)::INTEGER END AS mask_end
FROM headed
"""


def op2_divergence(spark: SparkSession, sf: str) -> DataFrame:
    found = cut_lineage(divergence.measured(table(spark, sf, "documents"), "text", "lang", "doc_id"))
    judged = divergence.verdict(found, divergence.references(found))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), every=20, k=20)


def op4_compression(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = compress.fit(docs, table(spark, sf, "labels"))
    return docs.select(
        "doc_id", (compress.fold(F.col("doc_id")) == 0).alias("held_out"), compress.score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = table(spark, sf, "documents").select("doc_id", bpe.round_trip(F.col("text"), path, pattern).alias("_c"))
    return coded.select("doc_id", "_c.*").select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


SITE_RULES = [
    urls.site_rule("block", "net/"), urls.site_rule("allow", "example.net/en/"),
    urls.site_rule("block", "example.com/de/"), urls.site_rule("allow", "org/fr/"),
]
WORD_RULES = [
    urls.word_rule("block", *words)
    for words in (("spam", "farm"), ("cheap", "pills"), ("casino", "win"), ("free", "bets"), ("adult", "x"), ("ads", "track"))
]


def op6_urls(spark: SparkSession, sf: str) -> DataFrame:
    judged = urls.judge(table(spark, sf, "pages"), SITE_RULES + WORD_RULES)
    return judged.select(
        "page_id", "host", "path", F.when(F.col("rule_rank") == 1, F.col("rule")).alias("rule"), "verdict",
        F.when(F.col("rule_rank") == 2, F.col("rule")).alias("pattern_rule"),
    )


OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), sites(rule, site, start, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS said
  FROM parts JOIN sites
    ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)
  GROUP BY ALL
), words AS (
  SELECT *, regexp_extract('.' || host || '.', '\.(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)\.', 1) AS w
  FROM parts
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.said, CASE WHEN w <> '' AND NOT ends_with(p.host, w) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN f.rule IS NULL AND w <> '' AND NOT ends_with(p.host, w) THEN 'label:' || w END AS pattern_rule
FROM words p LEFT JOIN (SELECT DISTINCT host, path, rule, said FROM fits) f ON f.host = p.host AND f.path = p.path
"""


def op7_hyperminhash(spark: SparkSession, sf: str) -> DataFrame:
    found = hyperminhash.near_duplicates(table(spark, sf, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), held AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON p.a = r.other
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op8_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_token=2
    )
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op10_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    place = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    written = sharding.write_shards(table(spark, sf, "documents"), place, shards=24)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return written.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_codes(spark: SparkSession, sf: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(books.sha256()))


def _op11_sql(rounds: int) -> str:
    """The rounds written out one after the other."""
    nearest = """SELECT vec_id, label, p, any_value(x.c) AS c, min({'d': d, 'e': e}) AS best FROM (
      SELECT x.vec_id, x.label, x.p, x.c, b.e,
        list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
      FROM parts x JOIN BOOK b ON x.p = b.p) x GROUP BY vec_id, label, p"""
    moved = """SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM BOOK b LEFT JOIN (
      SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
        SELECT p, best.e AS e, i, sum(c[i])::HUGEINT AS s, count(*) AS n
        FROM near_ROUND JOIN range(1, 9) r(i) ON true GROUP BY ALL) GROUP BY p, e
    ) m ON b.p = m.p AND b.e = m.e"""
    steps = ""
    for r in range(1, rounds + 1):
        near = nearest.replace("BOOK", f"book_{r - 1}")
        move = moved.replace("BOOK", f"book_{r - 1}").replace("ROUND", str(r))
        steps += f"near_{r} AS MATERIALIZED ({near}),\nbook_{r} AS MATERIALIZED ({move}),\n"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[8 * p + 1 : 8 * p + 8] AS c FROM kept JOIN range(8) r(p) ON true
), book_0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)
),
{steps}last AS MATERIALIZED ({nearest.replace("BOOK", f"book_{rounds}")}
), coded AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM last GROUP BY vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book_{rounds}) AS codebooks_sha256
FROM coded
"""


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    cut = table(spark, sf, "documents").select(
        "doc_id", piece_table.fill_in_middle(F.col("doc_id"), F.col("text")).alias("_c")
    ).select("doc_id", "_c.*")
    return cut.withColumn("_r", piece_table.restore(F.col("output"), F.col("form"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("_r.sha256").alias("restored_sha256")
    )


OP12_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, x, n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS h FROM texts
), cuts AS (
  SELECT doc_id, x, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, '<P>' || substr(x, 1, a) AS p, '<M>' || substr(x, a + 1, b - a) AS m, '<S>' || substr(x, b + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM parts
"""


def op13_sum_of_squares(spark: SparkSession, sf: str) -> DataFrame:
    packed = level_packing.pack(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_token=1
    )
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_perspectives, op2_divergence, op3_nearest, op4_compression, op5_bpe, op6_urls, op7_hyperminhash,
        op8_best_fit, op9_licenses, op10_shuffle, op11_codes, op12_fill_in_middle, op13_sum_of_squares,
    )
}
SQL: dict[str, str] = {
    "op1_perspectives": OP1_SQL, "op2_divergence": divergence_sql.SQL, "op6_urls": OP6_SQL, "op7_hyperminhash": OP7_SQL,
    "op11_codes": _op11_sql(vector_codes.ROUNDS), "op12_fill_in_middle": OP12_SQL,
}
