"""SimHash near-duplicates: a self-join of binary tries under a Hamming budget.

Fingerprints are joined as binary tries. A node of a trie is a run of equal leading
bits, which in a sorted array is an interval, so the traversal takes pairs of
intervals, adds up the bits in which the two paths differ, and prunes a pair as soon
as the budget is exceeded. Pairs of small nodes are compared leaf by leaf.

Distribution. With a budget of ``k`` bits and ``k + m`` blocks of bits, two linked
fingerprints agree in ``m`` whole blocks. Each fingerprint therefore enters a trie for every
choice of ``m`` blocks, which are moved to the top, and within those the budget is zero.
The leading bits name the sub-trie, which is one task's group. Their number follows the
number of distinct fingerprints, and ``m`` grows where the blocks of fewer would be too
short for it (at 4 bits: 5 tries with up to 12 bits, 15 with 20, 35 with 27, 70 with 32),
so a group of evenly spread fingerprints keeps about ``GROUP_ROWS`` rows up to 10^13 of them.
A sub-trie that is nevertheless larger than ``CHUNK_ROWS``, by uneven fingerprints, is dealt
into chunks, and every pair of chunks is traversed in its own group: nothing is dropped and
no task holds more than two chunks, but rows are copied once per chunk of their sub-trie.
A group returns the spanning forest of its links (at most one edge per fingerprint), never
all pairs. Components are then found by alternating large-star and small-star steps over a
checkpointed edge table, whose hubs are dealt into parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import broadcast_if_small, materialize, materialize_round, salted_join

SEED = 42
GROUP_ROWS = 4096
CHUNK_ROWS = 8192
#: Pairs of nodes held at once, and the product of sizes from which leaves are compared.
FRONTIER = 1 << 16
LEAF_PAIRS = 256
#: Blocks that a trie may fix; more need too many tries.
MOST_AGREE = 4

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text in UTF-8; zero if it holds no word."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority_bits(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n))


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in more than half of the hashes; zero for none."""
    n = len(hashes)
    places = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = np.packbits((2 * counts.ravel() > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id_col, fp)``: the signed 64-bit fingerprint of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


class Forest:
    """Union-find over 0..n-1 that merges arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def trie_join(a: np.ndarray, b: np.ndarray | None, budget: int, exact_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values that differ in at most ``budget`` bits, none of them among the
    first ``exact_bits``. ``a`` and ``b`` are sorted uint64; ``b`` None: pairs within ``a``."""
    own = b is None
    b = a if own else b
    stack = [(0, np.array([[0, len(a), 0, len(b), 0]], dtype=np.int64))]
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ones_before(depth: int) -> tuple[np.ndarray, np.ndarray]:
        if depth not in ones:
            count = [np.concatenate([[0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]) for v in ([a] if own else [a, b])]
            ones[depth] = (count[0], count[-1])
        return ones[depth]

    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(depth, pairs[:FRONTIER]), (depth, pairs[FRONTIER:])]
            continue
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        small = (na * nb <= LEAF_PAIRS) | (depth == 64)
        leaves, pairs = pairs[small], pairs[~small]
        while len(leaves):
            size = (leaves[:, 1] - leaves[:, 0]) * (leaves[:, 3] - leaves[:, 2])
            part = max(1, int(np.searchsorted(np.cumsum(size), 1 << 21)))
            now, size, leaves = leaves[:part], size[:part], leaves[part:]
            of = np.repeat(np.arange(len(now)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = (now[:, 3] - now[:, 2])[of]
            x, y = now[of, 0] + k // width, now[of, 2] + k % width
            off = a[x] ^ b[y]
            ok = np.bitwise_count(off) <= budget
            if exact_bits:
                ok &= (off >> np.uint64(64 - exact_bits)) == 0
            if own:
                ok &= x < y
            if ok.any():
                yield x[ok], y[ok]
        if not len(pairs):
            continue
        ca, cb = ones_before(depth)
        ma = pairs[:, 1] - (ca[pairs[:, 1]] - ca[pairs[:, 0]])
        mb = pairs[:, 3] - (cb[pairs[:, 3]] - cb[pairs[:, 2]])
        a0, a1, b0, b1, diff = pairs.T
        same = [np.stack([a0, ma, b0, mb, diff], 1), np.stack([ma, a1, mb, b1, diff], 1)]
        cross = [np.stack([a0, ma, mb, b1, diff + 1], 1), np.stack([ma, a1, b0, mb, diff + 1], 1)] if depth >= exact_bits else []
        if own and cross:  # of a node with itself, one of the two mixed pairs is enough
            cross[1] = cross[1][a0 != b0]
        below = np.concatenate(same + cross)
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        if len(below):
            stack.append((depth + 1, below))


#: Blocks of a fingerprint as ``(start, bits)``, counted from the top, in the order of a trie.
Layout = list[tuple[int, int]]


def layouts(budget: int, agree: int) -> tuple[list[Layout], int]:
    """For every choice of ``agree`` of ``budget + agree`` blocks, the layout that begins with
    them, and the least number of bits that such a choice has."""
    n = budget + agree
    blocks = [(64 * t // n, 64 * (t + 1) // n - 64 * t // n) for t in range(n)]
    chosen = list(combinations(blocks, agree))
    return [[*c, *(x for x in blocks if x not in c)] for c in chosen], min(sum(bits for _, bits in c) for c in chosen)


def moved(fp: Column, layout: Layout) -> Column:
    """The bits of ``fp`` in the order of ``layout``."""
    out, at = F.lit(0).cast("bigint"), 0
    for start, bits in layout:
        block = F.shiftrightunsigned(F.shiftleft(fp, start), 64 - bits)
        at += bits
        out = out.bitwiseOR(F.shiftleft(block, 64 - at))
    return out


def moved_back(values: np.ndarray, layout: Layout) -> np.ndarray:
    """The fingerprints, signed, whose bits ``moved`` has put in the order of ``layout``."""
    out, at = np.zeros(len(values), dtype=np.uint64), 0
    for start, bits in layout:
        block = (values << np.uint64(at)) >> np.uint64(64 - bits)
        out |= block << np.uint64(64 - start - bits)
        at += bits
    return out.view(np.int64)


def _links_of_group(budget: int, agree: int, order: list[Layout]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        layout, i, j = order[int(key[0])], int(key[2]), int(key[3])
        exact = sum(bits for _, bits in layout[:agree])
        rot = rows["rot"].to_numpy().view(np.uint64)
        side = rows["chunk"].to_numpy()
        a = np.unique(rot[side == i])
        b = None if i == j else np.unique(rot[side == j])
        values = a if b is None else np.concatenate([a, b])
        forest, shift = Forest(len(values)), 0 if b is None else len(a)
        for x, y in trie_join(a, b, budget, exact):
            forest.merge(x, y + shift)
        linked = np.flatnonzero(forest.root != np.arange(len(values)))
        return pd.DataFrame({"u": moved_back(values[linked], layout), "v": moved_back(values[forest.root[linked]], layout)})

    return run


def hamming_links(nodes: DataFrame, budget: int = 4) -> DataFrame:
    """``(u, v)``: edges whose components are those of all pairs of the distinct ``nodes.fp``
    that differ in at most ``budget`` bits. ``nodes`` should be materialized."""
    wanted = (nodes.count() // GROUP_ROWS).bit_length()
    agree = 1
    while layouts(budget, agree)[1] < wanted and agree < MOST_AGREE:
        agree += 1
    order, least = layouts(budget, agree)
    top = min(least, wanted)
    rotated = nodes.select(F.explode(F.array(*(F.struct(F.lit(t).alias("t"), moved(F.col("fp"), layout).alias("rot")) for t, layout in enumerate(order)))).alias("x")).select("x.t", "x.rot")
    rotated = rotated.withColumn("sub", F.shiftrightunsigned("rot", 64 - top) if top else F.lit(0).cast("bigint"))
    large = materialize(rotated.groupBy("t", "sub").count().where(F.col("count") > CHUNK_ROWS))
    zero = F.lit(0).cast("bigint")
    if large.isEmpty():
        dealt = rotated.select("t", "sub", "rot", zero.alias("chunk"), zero.alias("i"), zero.alias("j"))
    else:
        chunks = F.coalesce(F.ceil(F.col("count") / CHUNK_ROWS), F.lit(1)).cast("bigint")
        dealt = (
            rotated.join(broadcast_if_small(large), ["t", "sub"], "left")
            .withColumn("chunk", F.pmod(F.xxhash64("rot"), chunks))
            .withColumn("other", F.explode(F.sequence(zero, chunks - 1)))
            .select("t", "sub", "rot", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
        )
    return dealt.groupBy("t", "sub", "i", "j").applyInPandas(_links_of_group(budget, agree, order), "u bigint, v bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u, v)``; root is the least node of its component."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize_round(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", "v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = materialize_round(small.select("x.u", "x.v").where("u <> v").distinct())
        if (now := state(e)) == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, shingle: int = 4) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``df``.

    Null or blank texts have fingerprint zero and are linked like any other; a null id
    never becomes a component's id unless all of its ids are null.
    """
    docs = materialize(fingerprints(df, id_col, text_col, shingle))
    nodes = materialize(docs.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = connected_components(hamming_links(nodes, budget))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(salted_join(labelled, ids, "root", "fp").select("fp", "component_id"))
    return docs.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
