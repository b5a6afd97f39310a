"""Text columns: merchant keys, tags, paths, folding, tokens and searchable text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Replacements that turn a bank description into a merchant key (fixed values,
# applied in this order to lower-case text, each match becoming one blank).
CARD_NUMBER = r"\b(?:(?:visa|mastercard|debit|credit)\s+)?card\s*(?:ending\s+(?:in\s+)?)?(?:x+|\*+)?\s*\d{2,}\b"
REFERENCE = r"\b(?:ref(?:erence)?|txn|transaction)\s*(?:no|number)?\s*[:#-]?\s*[a-z0-9*-]*\d[a-z0-9*-]*\b"
PAYMENT_WORDS = r"\b(?:visa|mastercard|debit|credit|card|eftpos|pos|purchase|ref|reference|txn|transaction)\b"
DIGITS = r"\d+"
NON_LETTERS = r"[^a-z\s]+"

TAG_PATTERN = r"^[a-z0-9_./-]+$"

# Any JSON string (with a trailing colon when it is a key) or number.
_JSON_SCALAR = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?|-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?'


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalise_merchant(col: Column | str) -> Column:
    text = F.lower(_col(col))
    for pattern in (CARD_NUMBER, REFERENCE, PAYMENT_WORDS, DIGITS, NON_LETTERS):
        text = F.regexp_replace(text, "(?U)" + pattern, " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_tag(col: Column | str) -> Column:
    """Matching form of a tag: outer blanks and leading ``#`` gone, lower case."""
    bare = F.regexp_replace(_col(col), r"(?U)^\s*#*\s*|\s+$", "")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def valid_tag(col: Column | str) -> Column:
    """Storage form of a tag; NULL when it is empty or holds a forbidden character."""
    name = normalise_tag(col)
    return F.when(name.rlike(TAG_PATTERN), name)


def tag_name(text: str) -> str:
    """``normalise_tag`` for one literal."""
    bare = text.strip().lstrip("#").strip()
    return "".join(c.lower() if c.isascii() else c for c in bare)


def normalise_path(col: Column | str) -> Column:
    blankless = F.regexp_replace(_col(col), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(blankless, r"^/+|/+$", "")


def slug(col: Column | str) -> Column:
    """File-friendly name: other characters become one dash, none at the ends."""
    dashed = F.regexp_replace(F.trim(_col(col)), r"[^A-Za-z0-9_\-]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")


def _accent_map() -> tuple[str, str]:
    """Latin letters with exactly one diacritic, and the plain letters they fold to."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
            marked.append(chr(code))
            plain.append(parts[0].lower())
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accent_map()


def fold(col: Column | str) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(_col(col)), _MARKED, _PLAIN), r"\p{M}+", "")


def fold_literal(text: str) -> str:
    table = str.maketrans(_MARKED, _PLAIN)
    kept = text.lower().translate(table)
    return "".join(c for c in kept if not unicodedata.combining(c))


def tokens(col: Column | str) -> Column:
    """Words of a text in order: runs of letters and digits, folded, not stemmed."""
    spaced = F.trim(F.regexp_replace(fold(col), r"[^\p{L}\p{N}\p{Co}]+", " "))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def token_list(text: str) -> list[str]:
    """``tokens`` for one literal: the same letters, digits and private-use characters."""
    kept = (c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in fold_literal(text))
    return "".join(kept).split()


@lru_cache(maxsize=4096)
def engine_accepts(pattern: str) -> bool:
    """Whether the engine that runs regular expressions can compile this one."""
    spark = SparkSession.active()
    try:
        if hasattr(spark, "_jvm"):
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            spark.sql("SELECT rlike('', :p)", args={"p": pattern}).collect()
    except Exception:  # noqa: BLE001  any refusal of the engine counts
        return False
    return True


def regex_term(value: str) -> str:
    """The pattern of a search term: as it stands, or ``/pattern/flags`` with the flags i, m and s."""
    found = re.fullmatch(r"/(.*)/([ims]*)", value, re.DOTALL)
    if not found:
        return value
    flags = "".join(dict.fromkeys(found[2]))
    return (f"(?{flags})" if flags else "") + found[1]


def metadata_scalars(col: Column | str) -> Column:
    """Every string and number anywhere inside a JSON object; keys, booleans and nulls skipped.

    One scan of the JSON text, so any nesting depth costs one projection.
    """
    found = F.regexp_extract_all(_col(col), F.lit(_JSON_SCALAR), F.lit(0))
    values = F.filter(found, lambda t: ~t.endswith(":"))
    # The pieces are JSON again, so one parse undoes all escapes.
    return F.from_json(
        F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>"
    )


def searchable_text(description: Column | str, metadata: Column | str, note: Column | str | None = None) -> Column:
    """Description, metadata values and the note in one text."""
    empty = F.array().cast("array<string>")
    parts = [
        F.array(F.coalesce(_col(description), F.lit(""))),
        F.coalesce(metadata_scalars(metadata), empty),
    ]
    if note is not None:
        parts.append(F.when(_col(note).rlike(r"(?U)\S"), F.array(_col(note))).otherwise(empty))
    return F.array_join(F.concat(*parts), " ")


def json_entries(col: Column | str) -> Column:
    """Top-level entries of a JSON object as key -> JSON text of the value."""
    parsed = F.from_json(_col(col), "map<string,variant>")
    return F.transform_values(parsed, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def json_object(entries: Column) -> Column:
    """JSON text of ``array<struct<key,value>>`` entries (values are JSON), in key order."""

    def pair(e: Column) -> Column:
        quoted = F.to_json(F.array(e["key"]))
        return F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(":"), e["value"])

    body = F.array_join(F.transform(F.array_sort(entries), pair), ",")
    return F.concat(F.lit("{"), body, F.lit("}"))
