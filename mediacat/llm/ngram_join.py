"""N-gram Jaccard join by vertical partitioning of the n-gram order.

A text's set holds its distinct shingles as 56-bit hashes. Hash order is the global n-gram
order; it is cut into even ranges, and so each set into segments, one a range.

1. *Fragments.* One pass over the texts deals all segments to the tasks of their ranges, packed
   (8 bytes a shingle). There a shingle of one set is dropped, as it adds to no overlap, and
   the others go back to their sets with the number of sets that hold them. Ranges follow the
   size of the texts, so a task's share stays the same.
2. *Candidates.* A set of n shingles can only link where one of its n/5 + 1 rarest is met, in
   one order for all. Sets that have so many shingles of their own are done; that is most.
   The others form a group for each such shingle, and groups of equal members count once.
3. *Overlaps.* The segments of a pair are intersected range by range, and the partial counts
   are summed per pair: links have 5 * overlap >= 4 * union.

Pairs are never listed whole. In each group all are first compared with one member. Where a
group is in several components after that, members of different ones are checked in blocks:
lengths, and bitmaps whose differing bits bound the shingles that differ from below. Of pairs
that pass, a forest is counted; of those still in different components after it, all are. No
pair of different components is left unchecked, so components are exact. Large groups are
dealt into chunks, and each pair of chunks is a task.

Equal sets are one node from the start, so copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from mediacat.llm.common import broadcast_if_small, materialize, salted_join, text_or_empty
from mediacat.llm.simhash import SEED, connected_components

SHINGLE = 5
#: Shingles and sets of one block of segments; bytes of text for each range of the order.
BLOCK = 1 << 21
MOST_SETS = 1 << 16
RANGE_BYTES = 1 << 24
#: Ranges over which a pair's overlaps are counted apart.
PARTS = 8
#: Members of a group that one task compares with as many others, and bits of a bitmap at most.
CHUNK = 4096
MOST_BITMAP = 4096
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20

_BITS = 56
_REST = np.uint64((1 << 48) - 1)
_WEIGHT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    found = pa.array(words, pa.binary()).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found.dictionary.to_pylist(), repeat(SEED)), dtype=np.uint64, count=len(found.dictionary))
    return hashes[found.indices.to_numpy()]


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in sequence."""
    out = hashes[: len(hashes) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = _mixed(out) * _WEIGHT + hashes[k : len(hashes) - n + 1 + k]
    return _mixed(out)


def slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``SLICE`` bytes, cut before a space."""
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        yield text[at:] if cut < 0 else text[at:cut]
        at = len(text) if cut < 0 else cut


def shingle_set(hashes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text's word hashes, sorted, as 56-bit numbers."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(sequence_hashes(hashes, min(shingle, len(hashes))) >> np.uint64(64 - _BITS))


def _sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The set of each text; words of short texts are hashed together."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > SLICE:
            yield shingle_set(np.concatenate([np.zeros(0, np.uint64), *(word_hashes(s.lower().split()) for s in slices(texts[at]))]), shingle)
            at += 1
            continue
        words: list[bytes] = []
        sizes: list[int] = []
        size = 0
        while at < len(texts) and size + len(texts[at]) <= SLICE:
            size += len(texts[at])
            own = texts[at].lower().split()  # of bytes: A-Z only, and exactly \x20 and \x09-\x0D
            words += own
            sizes.append(len(own))
            at += 1
        hashes, start = word_hashes(words), 0
        for n in sizes:
            yield shingle_set(hashes[start : start + n], shingle)
            start += n


def _cuts(runs: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1, [len(runs)]]) if len(runs) else np.zeros(1, dtype=int)


_DEALT = ["slot", "block", "id", "at", "n", "key", "packed"]


def _packed(rest: np.ndarray, *columns: np.ndarray) -> bytes:
    """48-bit numbers, then the other columns."""
    return np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() + b"".join(c.tobytes() for c in columns)


def _unpacked(blob: bytes, *kinds: type) -> tuple[np.ndarray, ...]:
    n = len(blob) // (6 + sum(np.dtype(k).itemsize for k in kinds))
    rest = np.zeros((n, 8), dtype=np.uint8)
    rest[:, :6] = np.frombuffer(blob, dtype=np.uint8, count=6 * n).reshape(n, 6)
    out, at = [rest.reshape(-1).view(np.uint64)], 6 * n
    for k in kinds:
        out.append(np.frombuffer(blob, dtype=k, count=n, offset=at))
        at += n * np.dtype(k).itemsize
    return tuple(out)


def _segments(ranges: int, shingle: int, kind: pa.DataType):
    """Of ``(id, text)``: a row for each text, and the packed segments of each block's new sets."""
    bits = ranges.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = TaskContext.get().partitionId() << 24, {}
        held: list[np.ndarray] = []
        size = 0

        def segments() -> pa.RecordBatch:
            h = np.concatenate(held)
            of = np.repeat(np.arange(len(held)), [len(x) for x in held]).astype(np.uint16)
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            slots = (h >> np.uint64(_BITS - bits)).astype(np.int64)
            cuts = _cuts(slots)
            blobs = [_packed(h[a:b] & _REST, of[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            k = len(blobs)
            none = [pa.nulls(k, t) for t in (kind, pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(slots[cuts[:-1]]), pa.array([block] * k, pa.int64()), *none, pa.array(blobs, pa.binary())], names=_DEALT)

        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            blocks, places, sizes, keys = [], [], [], []
            for s in _sets(texts, shingle):
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if len(s) and key not in seen:
                    seen[key] = (block, len(held))
                    held.append(s)
                    size += len(s)
                at = seen.get(key, (block, None))
                blocks.append(at[0])
                places.append(at[1])
                sizes.append(len(s))
                keys.append(key)
                if size >= BLOCK or len(held) == MOST_SETS:
                    yield segments()
                    held, size, block, seen = [], 0, block + 1, {}
            n = len(texts)
            columns = [pa.array([-1 - x for x in blocks], pa.int64()), pa.array(blocks, pa.int64()), b.column(0), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_DEALT)
        if held:
            yield segments()

    return run


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte, in the same order; from 128 on an eighth of a doubling is one step."""
    steps = np.minimum(np.floor(8 * np.log2(np.maximum(counts, 128) / 128)), 127)
    return np.where(counts < 128, counts, 128 + steps).astype(np.uint8)


def _shared(schema: pa.Schema):
    """Of one range: the shingles of several sets, packed by block, with the number of sets.
    Rows of texts go by."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        if slot < 0:
            return rows
        parts = [_unpacked(x, np.uint16) for x in rows.column("packed").to_pylist()]
        rest, of = (np.concatenate([p[k] for p in parts]) for k in range(2))
        block = np.repeat(rows.column("block").to_numpy(), [len(p[0]) for p in parts])
        order = np.argsort(rest, kind="stable")
        rest, of, block = rest[order], of[order], block[order]
        counts = np.diff(np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1], [True]])))
        count = np.repeat(counts, counts)
        many = np.flatnonzero(count > 1)
        many = many[np.argsort(block[many], kind="stable")]
        rest, of, block, count = rest[many], of[many], block[many], coded(count[many])
        cuts = _cuts(block)
        k = len(cuts) - 1
        blobs = [_packed(rest[a:b], of[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        made = {"slot": [slot] * k, "block": block[cuts[:-1]], "packed": blobs}
        return pa.Table.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(k, f.type) for f in schema], schema=schema)

    return run


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the shingles' counts over some places: where two bitmaps differ, so do the sets."""
    bits = min(MOST_BITMAP, max(64, 1 << int(2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((_mixed(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


_SETS = "node bigint, n bigint, own bigint, rare array<bigint>, parts array<array<bigint>>, bitmap binary"


def _candidates(ranges: int):
    """Of one block: its sets that can link, with their rarest shingles and their segments."""
    bits = ranges.bit_length() - 1

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        sets = rows[rows["packed"].isna()]
        packed = rows[rows["packed"].notna()]
        if len(sets) and len(packed):
            n_of = np.zeros(MOST_SETS, dtype=np.int64)
            n_of[sets["at"].to_numpy(dtype=np.int64)] = sets["n"].to_numpy(dtype=np.int64)
            parts = [_unpacked(x, np.uint16, np.uint8) for x in packed["packed"]]
            slot = np.repeat(packed["slot"].to_numpy(dtype=np.uint64), [len(p[0]) for p in parts])
            h, of, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
            h = (slot << np.uint64(_BITS - bits)) | (h & np.uint64((1 << (_BITS - bits)) - 1))
            kept = n_of[of] > 0
            h, of, count = h[kept], of[kept], count[kept]
            order = np.lexsort((h, count, of))
            h, of = h[order], of[order]
            cuts = _cuts(of)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n = int(n_of[of[a]])
                rare = n // 5 + 1 - (n - (b - a))
                if rare > 0:
                    s = np.sort(h[a:b])
                    ends = np.searchsorted(s, np.arange(1, PARTS, dtype=np.uint64) << np.uint64(_BITS - PARTS.bit_length() + 1))
                    out.append((key[0] * MOST_SETS + int(of[a]), n, n - (b - a), h[a : a + rare].astype(np.int64), [x.astype(np.int64) for x in np.split(s, ends)], bitmap(s)))
        return pd.DataFrame(out, columns=["node", "n", "own", "rare", "parts", "bitmap"])

    return run


def _folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of ``size`` bytes or more, folded to that many."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint64).reshape(-1, size // 8), axis=0) for x in maps])


def _near_of_group(all_pairs: bool):
    """Of one pair of chunks of a group: pairs of members in different components that may be
    linked; unless ``all_pairs``, a forest of them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        rows = rows.sort_values(["n", "node"], kind="stable")
        n, own, node, side = (rows[c].to_numpy() for c in ("n", "own", "node", "chunk"))
        root, maps = rows["root"].to_numpy().copy(), rows["bitmap"].tolist()
        sizes = np.array([len(x) for x in maps])
        found: list[tuple[int, int]] = []
        ends = np.searchsorted(n, n * 5 // 4, side="right")
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes >= size)
            words = _folded([maps[k] for k in at], int(size))
            for p in np.flatnonzero(sizes[at] == size):
                x = at[p]
                near = np.flatnonzero((at < ends[x]) & (ends[at] > x) & (root[at] != root[x]) & ((sizes[at] > size) | (np.arange(len(at)) > p)))
                if i != j:
                    near = near[side[at[near]] != side[x]]
                if not len(near):
                    continue
                differ = own[x] + own[at[near]] + np.bitwise_count(words[near] ^ words[p]).sum(axis=1, dtype=np.int64)
                y = at[near[9 * differ <= n[x] + n[at[near]]]]
                if not len(y):
                    continue
                if not all_pairs:
                    others, first = np.unique(root[y], return_index=True)
                    y = y[first]
                    root[np.isin(root, others)] = root[x]
                found += zip(repeat(int(node[x])), node[y].tolist())
        return pd.DataFrame([(min(p), max(p)) for p in found], columns=["u", "v"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``(u, v)`` whose sets are similar: partial overlaps of each range are
    counted apart and summed per pair. Materialized."""
    parts = sets.select("node", "n", F.posexplode("parts").alias("part", "segment"))
    side = lambda k, n, s: parts.select(F.col("node").alias(k), F.col("n").alias(n), "part", F.col("segment").alias(s))
    split = pairs.distinct().join(side("u", "nu", "su"), "u").join(side("v", "nv", "sv"), ["v", "part"])
    partial = split.select("u", "v", "nu", "nv", F.size(F.array_intersect("su", "sv")).cast("long").alias("common"))
    summed = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("common").alias("common"))
    return materialize(summed.where("100 * common >= 80 * (nu + nv - common)").select("u", "v"))


def _with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    named = broadcast_if_small(roots).withColumnRenamed("node", "member").withColumnRenamed("root", "found")
    return rows.join(named, rows.node == named.member, "left").withColumn("root", F.coalesce("found", "node")).drop("member", "found")


def _near(groups: DataFrame, sets: DataFrame, roots: DataFrame, all_pairs: bool) -> DataFrame:
    """Pairs of members of different components that lengths and bitmaps don't part."""
    rows = materialize(_with_root(groups, roots))
    mixed = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low < high")
    zero, chunks = F.lit(0).cast("bigint"), F.ceil(F.col("members") / CHUNK).cast("bigint")
    dealt = (
        rows.join(broadcast_if_small(materialize(mixed.select("token", "members"))), "token")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), chunks))
        .withColumn("other", F.explode(F.sequence(zero, chunks - 1)))
        .select("token", "node", "root", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    return dealt.join(sets.select("node", "n", "own", "bitmap"), "node").groupBy("token", "i", "j").applyInPandas(_near_of_group(all_pairs), "u bigint, v bigint")


def _components(sets: DataFrame) -> DataFrame:
    """``(node, root)`` of the linked nodes of ``sets``; see the module."""
    rows = materialize(sets.select(F.explode("rare").alias("token"), "node"))
    groups = rows.groupBy("token").agg(F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(F.lit("second"), "node").cast("decimal(38,0)")).alias("t"), F.min("node").alias("lead"))
    groups = materialize(groups.where("members > 1").groupBy("members", "s", "t").agg(F.min("token").alias("token"), F.min("lead").alias("lead")).select("token", "lead", "members"))
    members = materialize(salted_join(rows, groups, "token", "node"))
    edges = _linked(members.where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")), sets)
    wide = members.where("members > 2").select("token", "node")
    # Which pairs are known to be joined only saves work, so the first stars do for that.
    stars = materialize(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")))
    edges = materialize(edges.unionByName(_linked(_near(wide, sets, stars, False), sets)))
    roots = materialize(connected_components(edges))
    more = _linked(_near(wide, sets, roots, True), sets)
    return roots if more.isEmpty() else materialize(connected_components(edges.unionByName(more)))


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row of ``df``: the size of the text's
    set and the smallest id that links reach, its own included.

    Two texts link if their sets' Jaccard similarity is 0.8 or more. A text of fewer than
    ``shingle`` words has its whole sequence as one; a null, empty or blank text has none and
    links with nothing, so its component is its own id. Repeated rows and ids keep a row each;
    a null id is the component's only if all its ids are null. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    size = docs.agg(F.sum(F.length("text")).alias("size")).first()["size"] or 0
    ranges = max(256, 1 << min(20, (size // RANGE_BYTES).bit_length()))
    kind = docs.schema["id"].dataType
    schema = StructType.fromDDL(f"slot bigint, block bigint, id {kind.simpleString()}, at bigint, n bigint, key binary, packed binary")
    dealt = docs.mapInArrow(_segments(ranges, shingle, to_arrow_type(kind)), schema)
    dealt = materialize(dealt.groupBy("slot").applyInArrow(_shared(to_arrow_schema(schema)), schema))
    texts = dealt.where("slot < 0").select("id", "n", "key", (F.col("block") * MOST_SETS + F.col("at")).alias("node"))
    nodes = materialize(texts.where("key is not null").groupBy("key").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.min("id").alias("least_id")))
    chosen = nodes.select(F.lit(None).cast("bigint").alias("slot"), F.floor(F.col("node") / MOST_SETS).alias("block"), F.pmod("node", F.lit(MOST_SETS)).alias("at"), "n", F.lit(None).cast("binary").alias("packed"))
    blocks = chosen.unionByName(dealt.where("slot >= 0").select("slot", "block", "at", "n", "packed"))
    sets = materialize(blocks.groupBy("block").applyInPandas(_candidates(ranges), _SETS))
    named = _with_root(nodes, _components(sets))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(named.join(ids, "root").select("key", "component_id"))
    alone = texts.where("key is null").select("id", "n", F.col("id").alias("component_id"))
    linked = salted_join(texts.where("key is not null"), named, "key", "node").select("id", "n", "component_id")
    return alone.unionByName(linked).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
