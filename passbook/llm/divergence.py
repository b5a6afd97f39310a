"""Quality rules by distribution divergence.

Each text gets a histogram of character classes and one of common words.  Both are held against the
reference of its language (or, where the language is unknown, of the nearest one) by their
Jensen-Shannon distance.  References are the summed histograms of all texts of a language that pass
the base rules, taken a second time without those far from the first sum.  A text that is too short for a histogram is not judged by it.

Words are runs without ASCII white space.  Defined results: a NULL text has no words, so the base
rules refuse it; a language without any text that passes the base rules, or a NULL one, is compared
with the nearest reference; without any reference only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
#: Character classes: the rest of ASCII, lower, upper, digits, white space, marks of prose, symbols,
#: characters beyond ASCII.  Continuation bytes of UTF-8 belong to no class.
CLASSES = ("other", "lower", "upper", "digit", "space", "mark", "symbol", "beyond")
SPACE, SYMBOL, BEYOND, NONE = 4, 6, 7, 8
#: Frequent words of four languages.
COMMON = {
    "en": "the of and to in a is that it for was on with as be by this at are from".split(),
    "fr": "de et le la les des en du un une que est pour au dans qui par sur pas avec".split(),
    "es": "de la que el los en se del y un por las con una no su lo es para al".split(),
    "de": "der und die zu in den von das mit sich des für auf ist im nicht dem ein als eine".split(),
}
WORDS = tuple(dict.fromkeys(w for words in COMMON.values() for w in words))
#: Production limits.  A histogram of few words strays by chance, so a limit is its first number plus
#: its second divided by the root of the words; below the least characters or words none is applied.
CLASS_LIMIT, WORD_LIMIT = (0.12, 0.9), (0.20, 1.5)
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Texts farther than this from the first references take no part in the final ones.
REFINE_CLASS, REFINE_WORD = 0.2, 0.3
#: Base rules.
BASE_WORDS, BASE_REPEATED = 50, 50

#: Language, summed character classes and summed common words.
References = list[tuple[str, list[int], list[int]]]

FEATURES = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "classes:array<bigint>,common:array<bigint>>"
)


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for members, number in (
        (range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t\n\r\x0b\x0c", SPACE),
        (b".,;:!?'\"()-", 5), (SYMBOLS, SYMBOL), (range(192, 256), BEYOND), (range(128, 192), NONE),
    ):
        table[list(members)] = number
    return table


def _word_table() -> dict[bytes, int]:
    """Each common word, small or with a capital, alone or before a comma or full stop; 0 is any other."""
    return {
        (form + end).encode(): i
        for i, w in enumerate(WORDS, 1) for form in (w, w.capitalize()) for end in ("", ",", ".")
    }


_TABLE, _COMMON = _class_table(), _word_table()
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three which occurs twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    # Words are told apart by 64-bit hashes; they live in this call only.
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    window = (h[:-2] * _A) ^ ((h[1:-1] + _C) * _B) ^ ((h[2:] + _A) * _C)
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(n, bool)
    at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    for k in (0, 1, 2):
        twice[at + k] = True
    return int(twice.sum())


def measure(text: bytes | None) -> tuple:
    """Base counts and both histograms of a whole text."""
    data = text or b""
    words = data.split()
    classes = np.bincount(_TABLE[np.frombuffer(data, np.uint8)], minlength=9)
    common = np.bincount(np.fromiter(map(_COMMON.get, words, repeat(0)), np.int64, len(words)), minlength=len(WORDS) + 1)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), int(classes[:NONE].sum() - classes[SPACE]), int(classes[SYMBOL]), len(lines) - len(set(lines)),
        repeated(words), classes[:NONE], common,
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WIDTHS = (NONE, len(WORDS) + 1)


def _measure_all(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Base counts and both histograms of a batch; one text at a time becomes a Python value."""
    numbers = np.zeros((len(texts), 5), np.int64)
    histograms = [np.zeros((len(texts), w), np.int64) for w in WIDTHS]
    for i, text in enumerate(texts):
        found = measure(text.as_py())
        numbers[i] = found[:5]
        histograms[0][i], histograms[1][i] = found[5:]
    return numbers, histograms


def features(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            numbers, histograms = _measure_all(texts)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * w, pa.int32()), pa.array(h.ravel()))
                for h, w in zip(histograms, WIDTHS)
            ]
            yield pa.StructArray.from_arrays([pa.array(numbers[:, k]) for k in range(5)] + lists, names=[*NAMES, "classes", "common"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, FEATURES).asNondeterministic()(text.cast("binary"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < BASE_WORDS) | (100 * n_repeat_words > BASE_REPEATED * n_words)


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, from 0 to 1) of each row of counts; NaN for an empty histogram."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = counts / counts.sum(1, keepdims=True), (reference / reference.sum())[None, :]
        m = (p + q) / 2
        part = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
        return np.where(counts.sum(1) > 0, np.sqrt(np.maximum(part.sum(1) / 2, 0.0)), np.nan)


def _distances(langs: list[str | None], histograms: list[np.ndarray], refs: References) -> list[np.ndarray]:
    """From the reference of the language, or the nearest one; NaN where there is none."""
    known = [r[0] for r in refs]
    own = np.array([known.index(x) if x in known else -1 for x in langs], np.int64)
    out = []
    for k, counts in enumerate(histograms, 1):
        if known and len(own):
            each = np.stack([distance(counts.astype(float), np.array(r[k], float)) for r in refs])
            out.append(np.where(own >= 0, each[own, np.arange(len(own))], each.min(0)))
        else:
            out.append(np.full(len(own), np.nan))
    return out


DISTANCES = ["class_distance", "word_distance"]


def distances(lang: Column, classes: Column, common: Column, refs: References) -> Column:
    """``class_distance`` and ``word_distance`` of measured texts."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for langs, *columns in batches:
            histograms = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(langs), -1) for c in columns]
            found = _distances(langs.to_pylist(), histograms, refs)
            yield pa.StructArray.from_arrays([pa.array(f, pa.float64(), from_pandas=True) for f in found], names=DISTANCES)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _kind(DISTANCES, "double")).asNondeterministic()(lang, classes, common)


def judged(text: Column, lang: Column, refs: References) -> Column:
    """Base counts, characters and distances of texts, measured and compared in one pass."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, langs in batches:
            numbers, histograms = _measure_all(texts)
            found = _distances(langs.to_pylist(), histograms, refs)
            yield pa.StructArray.from_arrays(
                [pa.array(numbers[:, k]) for k in range(5)] + [pa.array(histograms[0].sum(1))]
                + [pa.array(f, pa.float64(), from_pandas=True) for f in found],
                names=[*NAMES, "n_chars", *DISTANCES],
            )

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    kind = _kind([*NAMES, "n_chars"], "bigint")[:-1] + "," + _kind(DISTANCES, "double").removeprefix("struct<")
    return F.arrow_udf(run, kind).asNondeterministic()(text.cast("binary"), lang)


def _kind(names: list[str], of: str) -> str:
    return f"struct<{','.join(f'{n}:{of}' for n in names)}>"


def _sums(measured: DataFrame) -> References:
    sums = [F.sum(F.get("classes", F.lit(i))) for i in range(len(CLASSES))]
    sums += [F.sum(F.get("common", F.lit(i))) for i in range(len(WORDS) + 1)]
    rows = (
        measured.where(F.col("lang").isin(*COMMON) & ~base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .groupBy("lang").agg(F.array(*sums[: len(CLASSES)]).alias("c"), F.array(*sums[len(CLASSES) :]).alias("w"))
        .collect()
    )
    return sorted((r["lang"], list(r["c"]), list(r["w"])) for r in rows)


def references(measured: DataFrame) -> References:
    """Summed histograms of each language over all rows that pass the base rules and lie near.

    ``measured`` has ``lang``, ``n_words``, ``n_repeat_words``, ``classes`` and ``common``.  Sums are taken
    before the shuffle; what comes back is one row for each language that has a list of common words.
    """
    first = verdict(measured, _sums(measured))
    return _sums(first.where((F.col("class_distance") <= REFINE_CLASS) & (F.col("word_distance") <= REFINE_WORD)))


def passes(n_words: Column, n_repeat_words: Column, n_chars: Column, class_distance: Column, word_distance: Column) -> Column:
    """The verdict: base rules first, then each distance where the text is long enough for it."""

    def far(value: Column, limit: tuple[float, float]) -> Column:
        most = limit[0] + limit[1] / F.sqrt(F.greatest(n_words, F.lit(1)))
        return F.coalesce(value > most, F.lit(False))

    refused = ((n_chars >= LEAST_CHARS) & far(class_distance, CLASS_LIMIT)) | (
        (n_words >= LEAST_WORDS) & far(word_distance, WORD_LIMIT)
    )
    return ~base_failed(n_words, n_repeat_words) & ~refused


def verdict(measured: DataFrame, refs: References) -> DataFrame:
    """Add ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``."""
    chars = F.aggregate("classes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    found = distances(F.col("lang"), F.col("classes"), F.col("common"), refs)
    rest = [c for c in measured.columns if c != "_distances"]
    return (
        measured.withColumn("_distances", found).select(*rest, "_distances.*")
        .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("kept", passes(F.col("n_words"), F.col("n_repeat_words"), chars, *map(F.col, DISTANCES)))
    )


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", *carried: str) -> DataFrame:
    """``lang``, the features of each whole text and the ``carried`` columns."""
    return docs.select(
        *carried, F.col(lang).alias("lang") if lang in docs.columns else F.lit(None).cast("string").alias("lang"),
        features(F.col(text)).alias("_features"),
    ).select(*carried, "lang", "_features.*")


def keep(docs: DataFrame, refs: References, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the rules keep, with the columns they came with; texts are not shuffled."""
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    row = F.struct(*[F.col(c) for c in docs.columns])
    found = docs.select(row.alias("_row"), judged(F.col(text), language, refs).alias("_f"))
    values = [F.col(f"_f.{n}") for n in ("n_words", "n_repeat_words", "n_chars", *DISTANCES)]
    return found.where(passes(*values)).select("_row.*")
