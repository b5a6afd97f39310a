"""Near duplicates by HyperMinHash.

The distinct word shingles of a text are hashed to 64 bits.  The hash picks one of ``BUCKETS`` buckets,
and a bucket keeps its smallest hash, compressed to the count of leading zeros and the next
``MANTISSA`` bits.  Empty buckets borrow the register of the first full bucket in a fixed random order
of all buckets.  Registers are banded; texts that share a band are candidates.  Small sets have exact
candidate keys besides, so that no pair of them is lost.  Of two large sets the Jaccard similarity is
first estimated from equal registers, corrected for chance collisions; a pair far below the limit is
not looked at.  All others are confirmed on the full shingle sets.

Equal sets are one node from the start, so copies cost nothing.  Texts that share bands form clusters
(components of the band graph); a cluster is worked in tiles of bounded bytes, and a tile returns
only links that join two parts of it, never all its pairs.  A link left out joins texts that are
joined already, so components are whole.  The chance that a pair at the limit shares no band is
(1 - 0.8^6)^48, under one in a million, for sets that fill the buckets.  Sets of fewer shingles share
registers between buckets, which makes it larger; up to ``SMALL`` shingles the exact keys find all.

Defined results: a NULL or wordless text has an empty set and is linked with nothing.  Rows that
repeat an id keep their rows; the smallest non-NULL id of a component names it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.graph import components
from passbook.session import cut_lineage

BUCKETS, ROWS, MANTISSA = 288, 6, 10
BANDS = BUCKETS // ROWS
#: Bytes of shingle sets in a tile side.
TILE = 1 << 20
#: Sets of up to ``SMALL`` shingles have exact candidate keys, each of ``JOINT`` shingles or fewer.
SMALL, JOINT = 19, 4
#: Shingles of both sets from which on a pair is estimated first: so many that nearly all buckets are full.
LARGE = 1024
#: Standard deviations of the estimate below the limit at which a pair is no longer looked at.
SLACK = 5.0
SEED = 20_240_531

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EDGES = np.array([-(-(i << 64) // BUCKETS) for i in range(BUCKETS)], dtype=np.uint64)
_WIDTH = float(2**64) / BUCKETS
_RANDOM = np.random.default_rng(SEED)
#: For each bucket all buckets in the order in which it borrows from them.
_LENDERS = _RANDOM.permuted(np.tile(np.arange(BUCKETS), (BUCKETS, 1)), axis=1)
_ODD = _RANDOM.integers(0, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, words: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; fewer words are one shingle.

    ``bytes.lower`` and ``bytes.split`` work on A-Z and on ASCII white space alone.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    mixed = np.full(n, np.uint64(SEED))
    for k in range(words):
        mixed = mix(mixed ^ h[k : k + n]) * _ODD[k % 16]
    return np.unique(mix(mixed))


def registers(hashes: np.ndarray) -> np.ndarray:
    """One 16-bit register for each bucket of a non-empty sorted set."""
    start = np.searchsorted(hashes, _EDGES)
    full = start < np.append(start[1:], len(hashes))
    # Place of the smallest hash inside its bucket, as a fraction: 2^-zeros * 1.mantissa.
    part = (hashes[start[full]] - _EDGES[full]).astype(np.float64) + 1
    fraction, exponent = np.frexp(np.minimum(part / _WIDTH, 1 - 2.0**-53))
    zeros = np.minimum(-exponent, 63)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = (zeros << MANTISSA) | mantissa
    empty = np.flatnonzero(~full)
    if len(empty):
        lender = _LENDERS[empty, full[_LENDERS[empty]].argmax(1)]
        out[empty] = out[lender] ^ (lender * 40503 & 0xFFFF).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the number of the band is part of it."""
    keys = np.full((len(regs), BANDS), np.uint64(SEED))
    parts = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        keys = mix(keys * _ODD[k] + parts[:, :, k])
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * _M1).view(np.int64)


def small_keys(hashes: np.ndarray, percent: int) -> list[int]:
    """Keys of a small sorted set; two sets that reach ``percent`` share one.

    Two such sets have at least ``need`` shingles of each in common.  The lowest ``l`` common ones are
    therefore among the lowest n - need + l of either set, whose subsets of ``l`` are the keys.
    """
    n = len(hashes)
    if not 0 < n <= SMALL:
        return []
    need, out = max(-(-percent * n // 100), 1), []
    for joint in range(min(need, JOINT), min(n, JOINT) + 1):
        lowest = hashes[: n - need + joint]
        parts = np.array(list(combinations(range(len(lowest)), joint)))
        keys = np.full(len(parts), np.uint64(SEED + joint))
        for k in range(joint):
            keys = mix(keys * _ODD[k] + lowest[parts[:, k]])
        out += mix(keys + _M2).view(np.int64).tolist()
    return out


@lru_cache(maxsize=4096)
def chance(n: int, m: int) -> float:
    """Share of registers of two disjoint sets of about 2^n and 2^m shingles that are equal by chance."""
    zeros = np.arange(0, 64)[:, None]
    low = (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA)) * 2.0 ** -(zeros + 1)
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)

    def held(size: int) -> np.ndarray:
        k = max(2.0**size / BUCKETS, 1.0)
        return np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(high, 1 - 2.0**-53)))

    return float((held(n) * held(m)).sum())


def estimate(equal: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what chance explains."""
    sizes, which = np.unique(np.log2(np.maximum(m, 1)).astype(int), return_inverse=True)
    e = np.array([chance(int(np.log2(n)), int(x)) for x in sizes])[which]
    return (equal - e) / (1 - e)


def _sketch(words: int, percent: int):
    kind = "struct<n:bigint,digest:binary,bands:array<bigint>>"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n, digests, regs, small = [], [], [], []
            for text in (t.as_py() for t in texts):
                s = shingles(text, words)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                small.append(small_keys(s, percent))
                if len(s):
                    regs.append(registers(s))
            keys = band_keys(np.array(regs, np.uint16).reshape(-1, BUCKETS))
            full = np.array([d is not None for d in digests], bool)
            more = np.array([len(k) for k in small], int)
            offsets = np.concatenate([[0], np.cumsum(full * BANDS + more)]).astype(np.int32)
            exact = [k for keys in small for k in keys]
            # The exact keys of a text stand behind its bands.
            keys = np.insert(keys.ravel(), np.repeat(np.cumsum(full) * BANDS, more), np.array(exact, np.int64))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                names=["n", "digest", "bands"],
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def _sets(words: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = [shingles(t.as_py(), words).tobytes() for t in texts]
            digests = [xxhash.xxh3_128_digest(s) for s in sets]
            yield pa.StructArray.from_arrays(
                [pa.array(sets, pa.binary()), pa.array(digests, pa.binary())], names=["set", "digest"]
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<set:binary,digest:binary>").asNondeterministic()


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the parts of a tile: pairs of a left and a right row that are confirmed.

    Rows of one part are not compared again.  Only pairs of two large sets are estimated first.
    """
    size = np.array([len(s) for s in sets])
    part = np.arange(len(sets))
    limit = percent / 100
    floor = limit - SLACK * np.sqrt(limit * (1 - limit) / BUCKETS)
    row = np.cumsum(size >= LARGE) - 1
    regs = np.array([registers(s) for s in sets if len(s) >= LARGE])
    # Shingles by number, all sets behind one another; ``held`` marks those of one set.
    known, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    held = np.zeros(len(known), bool)
    links = []
    for a in left:
        # J >= limit bounds the ratio of the sizes.
        fits = (100 * np.minimum(size[right], size[a]) >= percent * np.maximum(size[right], size[a]))
        others = right[fits & (part[right] != part[a])]
        if size[a] >= LARGE:
            large = others[size[others] >= LARGE]
            if len(large):
                guess = estimate((regs[row[large]] == regs[row[a]]).mean(1), size[a], size[large])
                others = np.concatenate([others[size[others] < LARGE], large[guess >= floor]])
        if not len(others):
            continue
        held[shingle[start[a] : start[a] + size[a]]] = True
        first = np.cumsum(size[others]) - size[others]
        at = np.repeat(start[others] - first, size[others]) + np.arange(size[others].sum())
        both = np.add.reduceat(held[shingle[at]], first, dtype=np.int64)
        held[shingle[start[a] : start[a] + size[a]]] = False
        for b in others[100 * both >= percent * (size[a] + size[others] - both)]:
            if part[a] != part[b]:
                part[part == part[b]] = part[a]
                links.append((int(a), int(b)))
    return links


def _tile(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """All tiles of one group of rows: clusters that fit one tile share a group."""
        node, blob, side = table["node"].to_pylist(), table["set"].to_pylist(), table["side"].to_numpy()
        pairs: list[tuple[bytes, bytes]] = []
        rows: dict[int, list[int]] = {}
        for i, c in enumerate(table["cluster"].to_pylist()):
            rows.setdefault(c, []).append(i)
        for members in rows.values():
            # A fixed order makes a repeated task return the same links.
            members.sort(key=lambda i: node[i])
            sets = [np.frombuffer(blob[i], np.uint64) for i in members]
            sides = side[members]
            if sides.max() == 0:
                left = right = np.arange(len(members))
            else:
                left, right = np.flatnonzero(sides == 1), np.flatnonzero(sides == 2)
            pairs += [(node[members[a]], node[members[b]]) for a, b in forest(sets, left, right, percent)]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return run


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``, ``component`` (a digest) and
    ``text_hash``.

    ``component_id`` is the smallest id of the component; a document without words is alone.  Sides of
    joins on hot keys are written first, so that Spark can split the other side.
    """
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text"))
    sketched = cut_lineage(
        source.select("_id", F.xxhash64("_text").alias("text_hash"), _sketch(words, percent)(F.col("_text")).alias("_s"))
        .select("_id", "text_hash", F.col("_s.n").alias("n"), F.col("_s.digest").alias("digest"),
                F.col("_s.bands").alias("bands"))
    )
    # Copies of a set are one node; one text of it brings the bands.  An id alone does not tell it: ids
    # repeat or are NULL, and each row of such an id would meet each node of it.
    nodes = sketched.where(F.col("digest").isNotNull()).select("_id", "text_hash", "digest", "bands")
    firsts = cut_lineage(
        nodes.groupBy(F.col("digest").alias("node")).agg(F.min(F.struct("_id", "text_hash")).alias("_k"))
        .select("node", F.col("_k._id").alias("_first"), F.col("_k.text_hash").alias("_first_hash"))
    )
    is_first = F.col("_id").eqNullSafe(F.col("_first")) & (F.col("text_hash") == F.col("_first_hash"))
    # Candidate search works on 64 bits of the node: should two nodes agree in them, a cluster grows.
    keyed = cut_lineage(
        nodes.join(firsts, (F.col("digest") == F.col("node")) & is_first)
        .select(F.xxhash64("digest").alias("p"), F.explode("bands").alias("key"))
    )
    shared = cut_lineage(
        keyed.groupBy("key").agg(F.min("p").alias("centre"), F.max("p").alias("_last")).where("centre <> _last").drop("_last")
    )
    # Both sides are shuffled at every size: neither has a bound that would allow a broadcast.
    stars = keyed.join(shared.hint("merge"), "key").where("p <> centre").select(F.col("centre").alias("a"), F.col("p").alias("b"))
    clusters = components(stars).select(F.col("node").alias("p"), F.col("root").alias("cluster"))
    ids = firsts.join(clusters, F.xxhash64("node") == F.col("p")).select("node", "cluster", "_first", "_first_hash")
    # Only members of clusters are read again.  Should hashes agree, the text of the node counts.
    member = cut_lineage(
        source.withColumn("text_hash", F.xxhash64("_text")).join(cut_lineage(ids).hint("merge"), is_first)
        .select("node", "cluster", _sets(words)(F.col("_text")).alias("_s"))
        .where("_s.digest = node").select("node", "cluster", F.col("_s.set").alias("set")).dropDuplicates(["node"])
    )
    cuts = cut_lineage(
        member.groupBy(F.col("cluster").alias("_c")).agg(F.ceil(F.sum(F.length("set")) / TILE).cast("int").alias("cuts"))
    )
    placed = member.join(cuts, F.col("cluster") == F.col("_c")).withColumn(
        "cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    )
    total = member.agg(F.sum(F.length("set"))).first()[0] or 0
    groups = int(2 * total // TILE) + 1
    small = placed.where("cuts = 1").select(
        F.lit(None).cast("bigint").alias("owner"), F.pmod(F.xxhash64("cluster"), F.lit(groups)).cast("int").alias("i"),
        F.lit(-1).alias("j"), "cluster", "node", "set", F.lit(0).alias("side"),
    )
    large = placed.where("cuts > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        F.col("cluster").alias("owner"), F.least("cut", "with").alias("i"), F.greatest("cut", "with").alias("j"),
        "cluster", "node", "set",
        F.when(F.col("cut") == F.col("with"), 0).when(F.col("cut") < F.col("with"), 1).otherwise(2).alias("side"),
    )
    links = small.unionByName(large).groupBy("owner", "i", "j").applyInArrow(_tile(percent), "a binary, b binary")
    joined = components(links)
    named = cut_lineage(
        sketched.join(joined, sketched["digest"] == joined["node"], "left").select(
            "_id", "text_hash", "n", F.coalesce("root", "digest").alias("component")
        )
    )
    names = cut_lineage(
        named.where(F.col("component").isNotNull()).groupBy(F.col("component").alias("_root")).agg(
            F.min("_id").alias("component_id")
        )
    )
    return named.join(names, F.col("component") == F.col("_root"), "left").select(
        F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
        "component", "text_hash",
    ).withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with the columns it came with.

    It is the one of the smallest id (of those, the smallest hash of the text); rows that repeat it
    are one document.  Documents without words all stay.
    """
    found = near_duplicates(docs, doc_id, text, words, percent)
    first = cut_lineage(
        found.where("component is not null").groupBy("component")
        .agg(F.min(F.struct(F.col(doc_id).alias("i"), F.col("text_hash").alias("h"))).alias("_k"))
        .select(F.col("_k.i").alias("_kept"), F.col("_k.h").alias("_kept_hash"))
    )
    row = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_id"),
        F.xxhash64(F.col(text).cast("binary")).alias("_hash"),
        F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \t-\r]")).alias("_words"),
    )
    grouped = (
        row.where("_words").join(first, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_hash") == F.col("_kept_hash")))
        .dropDuplicates(["_id", "_hash"])
    )
    return grouped.select("_row.*").unionByName(row.where("not _words").select("_row.*"))
