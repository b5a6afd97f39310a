"""The quality rules of ``divergence`` written out in SQL, for comparison."""

from __future__ import annotations

from passbook.llm import divergence as d

#: One pattern for each character class that is listed; other ASCII characters are the rest.
_CLASSES = {
    "lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "space": r"[^\x20\x09-\x0D]", "mark": r"[^.,;:!?''\x22()\-]",
    "symbol": "[^#*$%&|<>]", "beyond": r"[\x00-\x7F]",
}


def _references(name: str, where: str) -> str:
    return f"""
    {name} AS (
      SELECT lang, kind, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, kind) AS total
      FROM hist JOIN base USING (doc_id) WHERE lang IN ({', '.join(f"'{x}'" for x in d.COMMON)}) AND NOT base_failed {where}
      GROUP BY lang, kind, bin)"""


def _distances(name: str, refs: str) -> str:
    """Own language where it has a reference, else the nearest; NULL for an empty histogram."""
    return f"""
    {name}_each AS (
      SELECT h.doc_id, h.kind, h.lang AS ref,
        sqrt(greatest((sum(p * log2(p / ((p + coalesce(q, 0)) / 2)) + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) + 1 - coalesce(sum(q), 0)) / 2, 0)) AS far
      FROM (SELECT h.doc_id, h.kind, h.bin, l.lang, h.n / sum(h.n) OVER (PARTITION BY h.doc_id, h.kind, l.lang) AS p
            FROM hist h CROSS JOIN (SELECT DISTINCT lang FROM {refs}) l WHERE h.n > 0) h
      LEFT JOIN (SELECT lang, kind, bin, n / total AS q FROM {refs}) r ON r.lang = h.lang AND r.kind = h.kind AND r.bin = h.bin
      GROUP BY ALL),
    {name} AS (
      SELECT b.doc_id, kind, coalesce(min(far) FILTER (ref = b.lang), min(far)) AS far
      FROM base b JOIN {name}_each USING (doc_id) GROUP BY b.doc_id, kind)"""


def _sql() -> str:
    forms = ", ".join(f"('{form}', {i})" for i, w in enumerate(d.WORDS, 1) for form in dict.fromkeys((w, w.capitalize())))
    counts = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g')) AS {name}" for name, p in _CLASSES.items())
    bins = " UNION ALL ".join(f"SELECT doc_id, 'c' AS kind, {i} AS bin, {name} AS n FROM base" for i, name in enumerate(("other", *_CLASSES)))
    limit = lambda x: f"{x[0]} + {x[1]} / sqrt(greatest(n_words, 1))"
    return rf"""
WITH doc AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lined AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM doc
), grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
    unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || chr(32) || w[k + 1] || chr(32) || w[k + 2])) AS g FROM doc
), twice AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS seen FROM grams) WHERE seen > 1)
  GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(t) AS chars, {counts}
  FROM lined LEFT JOIN twice USING (doc_id)
), base AS (
  SELECT *, chars - ({' + '.join(_CLASSES)}) AS other,
    n_words < {d.BASE_WORDS} OR 100 * n_repeat_words > {d.BASE_REPEATED} * n_words AS base_failed FROM counted
), forms(form, bin) AS (VALUES {forms}
), common AS (
  SELECT doc_id, bin, count(*) AS n
  FROM (SELECT doc_id, regexp_replace(unnest(w), '[,.]$', '') AS form FROM doc) JOIN forms USING (form) GROUP BY ALL
), hist AS MATERIALIZED (
  {bins} UNION ALL SELECT doc_id, 'w', bin, n FROM common
  UNION ALL SELECT doc_id, 'w', 0, n_words - coalesce(sum(n), 0) FROM base LEFT JOIN common USING (doc_id) GROUP BY doc_id, n_words
), {_references("ref1", "")}, {_distances("far1", "ref1")},
near AS (
  SELECT c.doc_id FROM far1 c JOIN far1 w ON w.doc_id = c.doc_id
  WHERE c.kind = 'c' AND w.kind = 'w' AND c.far <= {d.REFINE_CLASS} AND w.far <= {d.REFINE_WORD}
), {_references("ref2", "AND doc_id IN (SELECT doc_id FROM near)")}, {_distances("far2", "ref2")}
SELECT b.doc_id, n_words, word_chars, symbol::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (chars >= {d.LEAST_CHARS} AND coalesce(c.far > {limit(d.CLASS_LIMIT)}, FALSE)
    OR n_words >= {d.LEAST_WORDS} AND coalesce(w.far > {limit(d.WORD_LIMIT)}, FALSE)) AS kept
FROM base b LEFT JOIN far2 c ON c.doc_id = b.doc_id AND c.kind = 'c' LEFT JOIN far2 w ON w.doc_id = b.doc_id AND w.kind = 'w'
"""


SQL = _sql()
