"""Near copies: SimHash and MinHash propose, the shingles themselves decide.

Words are those of the fingerprints: ASCII lower case, split at ASCII white space. Two
texts are linked if they share at least 4/5 of all their distinct shingles (five words; of a
shorter text its whole sequence). Texts without a word are alike. No pair is linked that
wasn't verified so, by its shingles as strings.

A SimHash of a given width can't propose all such pairs (at 4/5 they differ in 5 to 13 of 64
bits), so pairs are proposed in two rounds, each linear in the texts:

1. the trie join of the SimHash fingerprints (at most 4 bits over the same shingles) gives a
   forest of links. Beside it, texts of similarity 4/5 share one of ``BANDS`` bands of ``ROWS``
   MinHash values but for one pair in 38,000, and each text is compared with that least
   text of its bands' groups with which it shares most of them;
2. each text with the least texts of all its other groups that aren't in its component yet.

What this gives up: two texts that meet in groups whose least text is like neither of them
aren't compared. All pairs of a group would be, at a cost that grows with its square (the
README has the figures of that way).

Texts are read in place, once for their signatures and once a round; only those of proposed
pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import broadcast_if_small, join_in_place, materialize, salted_join
from mediacat.llm.simhash import SEED, connected_components, hamming_links, majority_bits

SHINGLE = 5
BANDS = 20
ROWS = 4
#: Shingles hashed at once.
_PART = 4096

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> set[bytes]:
    """The distinct shingles of a text in UTF-8."""
    w = text.lower().split()
    if len(w) <= SHINGLE:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is 4/5 at least."""
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band of the MinHash signature of some shingle hashes; one band for none."""
    if not len(hashes):
        return np.zeros(1, dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), _PART):
        np.minimum(least, (hashes[k : k + _PART, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(29)
    return out


def signatures(texts: DataFrame) -> DataFrame:
    """``(key, fp, bands)``: the SimHash over each text's distinct shingles and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, found = [], []
            for t in b.column(1).cast(pa.large_binary()):
                s = shingles(t.as_py() or b"")
                h = np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), dtype="<u8", count=len(s))
                fps.append(majority_bits(h))
                found.append(bands(h).view(np.int64))
            lists = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), lists], names=["key", "fp", "bands"])

    return texts.select("key", "text").mapInArrow(run, "key bigint, fp bigint, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``(u, v)`` of keys whose texts are similar. Materialized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, set()
        for b in batches:
            us, vs, left, right = b.column(0), b.column(1), b.column(2).cast(pa.large_binary()), b.column(3).cast(pa.large_binary())
            keep = []
            for u, x, y in zip(us.to_pylist(), left, right, strict=True):
                if u != last:
                    last, of_last = u, shingles(x.as_py())
                keep.append(similar(of_last, shingles(y.as_py())))
            yield pa.RecordBatch.from_arrays([us, vs], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs.distinct())
    used = materialize(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct())
    needed = materialize(join_in_place(texts, used, ["key"], "inner").groupBy("key").agg(F.first("text").alias("text")))
    side = lambda k, name: needed.select(F.col("key").alias(k), F.col("text").alias(name))
    both = pairs.join(side("v", "y"), "v").join(side("u", "x"), "u").select("u", "v", "x", "y")
    return materialize(both.mapInArrow(run, "u bigint, v bigint"))


def _near_prints(prints: DataFrame) -> DataFrame:
    """``(u, v)``: pairs of texts with near fingerprints whose components are those of all such pairs."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("lead")))
    equal = salted_join(prints.select("fp", "key"), nodes, "fp", "key").where(F.col("key") != F.col("lead")).select(F.col("lead").alias("u"), F.col("key").alias("v"))
    of = lambda x: nodes.select(F.col("fp").alias(x), F.col("lead").alias(f"{x}_lead"))
    near = hamming_links(nodes).join(of("u"), "u").join(of("v"), "v").select(F.least("u_lead", "v_lead").alias("u"), F.greatest("u_lead", "v_lead").alias("v"))
    return equal.unionByName(near)


def _with_root(rows: DataFrame, roots: DataFrame, key: str = "key", root: str = "root") -> DataFrame:
    """``rows`` with the root of the column ``key``, itself where it is in no component."""
    named = broadcast_if_small(roots).withColumnsRenamed({"node": key, "root": root})
    return rows.join(named, key, "left").withColumn(root, F.coalesce(root, key))


def similar_components(texts: DataFrame) -> DataFrame:
    """``(node, root)`` of the keys that are linked to another; root is the least key of its
    component. ``texts``: ``(key, text)``, texts not null and a function of their key; a key
    may be repeated. Materialized."""
    prints = materialize(signatures(texts).dropDuplicates(["key"]))
    banded = prints.select("key", F.explode("bands").alias("band"))
    groups = materialize(banded.groupBy("band").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last").select("band", "lead"))
    leads = join_in_place(banded, groups, ["band"], "inner").where("key > lead")
    leads = materialize(leads.groupBy("key", "lead").agg(F.count("*").alias("common")))
    best = leads.groupBy("key").agg(F.min(F.struct(-F.col("common"), "lead")).alias("best"))
    edges = verified(_near_prints(prints).unionByName(best.select(F.col("best.lead").alias("u"), F.col("key").alias("v"))), texts)
    roots = materialize(connected_components(edges))
    apart = _with_root(_with_root(leads.drop("common"), roots), roots, "lead", "lead_root").where("root <> lead_root")
    rest = verified(apart.select(F.col("lead").alias("u"), F.col("key").alias("v")), texts)
    return roots if rest.isEmpty() else materialize(connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(rest)))
