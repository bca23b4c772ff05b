"""Approximate nearest neighbours: a navigable small-world graph per shard.

Vectors are dealt into shards by a hash of their direction; a shard has ``SHARD_ROWS`` rows
and more in large tables (:func:`shard_rows`), as each query visits every shard. Each shard
builds a hierarchical navigable small-world graph (Malkov and Yashunin, 2016), kept as flat
neighbour arrays: one int32 matrix of neighbours a layer, filled up with -1. A shard is one
row of the index: its ids, directions and arrays. To search, only queries are repeated, once
for each shard; a task reads its shard's row once and streams the queries past it. The shards'
results are merged by score, which is the cosine in double precision.

Directions are vectors divided by their largest component, so squares neither overflow nor
vanish, and vectors that are multiples of each other are equal. Those are indexed once with
the smallest ids that can matter, k + 1 of them (one may be the query's own): further ones come
after those in every result, as ties go to the smaller id. So a vector that a third of the
rows share can't wreck a graph.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.llm.common import broadcast_if_small, materialize

SHARD_ROWS = 4096
MOST_SHARD_ROWS = 65_536
M = 12
EF_BUILD = 64
EF_SEARCH = 96
#: Most tasks of a step; its groups are few bytes and much work, so they aren't coalesced by size.
MOST_TASKS = 4096


class Graph:
    """Inner-product graph over the rows of a float32 matrix of unit vectors."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 0) -> Graph:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1.0 - rng.random(n)) / math.log(m)).astype(int), 8)
        top = int(levels.max(initial=0))
        layers = [np.full((n, 2 * m if k == 0 else m), -1, dtype=np.int32) for k in range(top + 1)]
        degrees = np.zeros((top + 1, n), dtype=np.int32)
        g = cls(vectors, layers, 0)
        highest = int(levels[0]) if n else 0
        for x in range(1, n):
            q, at = vectors[x], g.entry
            for k in range(highest, levels[x], -1):
                at = g._greedy(q, at, k)
            near = [(float(vectors[at] @ q), at)]
            for k in range(min(highest, levels[x]), -1, -1):
                near = g._search(q, near, ef, k)
                for _, y in g._spread(near, m):
                    g._link(x, y, k, degrees)
                    g._link(y, x, k, degrees)
            if levels[x] > highest:
                highest, g.entry = int(levels[x]), x
        return g

    def _link(self, x: int, y: int, k: int, degrees: np.ndarray) -> None:
        row, d = self.layers[k][x], degrees[k, x]
        if d < len(row):
            row[d] = y
            degrees[k, x] = d + 1
            return
        others = np.append(row, y)
        scores = self.vectors[others] @ self.vectors[x]
        order = np.argsort(-scores, kind="stable")
        kept = [b for _, b in self._spread([(float(scores[j]), int(others[j])) for j in order], len(row))]
        row[: len(kept)] = kept
        row[len(kept) :] = -1
        degrees[k, x] = len(kept)

    def _spread(self, near: list[tuple[float, int]], m: int) -> list[tuple[float, int]]:
        """Up to m of ``near`` (best first): first those nearer to x than to one chosen before
        them, so that links lead in all directions, then the best of the rest."""
        if len(near) <= m:
            return near
        ids = np.array([y for _, y in near])
        mutual = self.vectors[ids] @ self.vectors[ids].T
        chosen: list[int] = []
        closest = np.full(len(ids), -np.inf)
        for j, (score, _) in enumerate(near):
            if closest[j] < score:
                chosen.append(j)
                np.maximum(closest, mutual[j], out=closest)
                if len(chosen) == m:
                    break
        taken = set(chosen)
        chosen += [j for j in range(len(near)) if j not in taken][: m - len(chosen)]
        return [near[j] for j in chosen]

    def _greedy(self, q: np.ndarray, at: int, k: int) -> int:
        score = float(self.vectors[at] @ q)
        while True:
            row = self.layers[k][at]
            row = row[row >= 0]
            if not len(row):
                return at
            scores = self.vectors[row] @ q
            j = int(scores.argmax())
            if scores[j] <= score:
                return at
            at, score = int(row[j]), float(scores[j])

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, k: int) -> list[tuple[float, int]]:
        """The ef best found from ``start`` in layer k, best first."""
        seen = {y for _, y in start}
        ahead = [(-s, y) for s, y in start]
        heapq.heapify(ahead)
        best = list(start)
        heapq.heapify(best)
        neighbours, vectors = self.layers[k], self.vectors
        while ahead:
            s, y = heapq.heappop(ahead)
            if len(best) >= ef and -s < best[0][0]:
                break
            fresh = [z for z in neighbours[y].tolist() if z >= 0 and z not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for score, z in zip((vectors[fresh] @ q).tolist(), fresh, strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (score, z))
                elif score > best[0][0]:
                    heapq.heapreplace(best, (score, z))
                else:
                    continue
                heapq.heappush(ahead, (-score, z))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> list[int]:
        """The ef nearest rows that the graph finds, nearest first."""
        if not len(self.vectors):
            return []
        at = self.entry
        for k in range(len(self.layers) - 1, 0, -1):
            at = self._greedy(q, at, k)
        return [y for _, y in self._search(q, [(float(self.vectors[at] @ q), at)], ef, 0)]


def _unit(directions: np.ndarray) -> np.ndarray:
    return (directions / np.linalg.norm(directions, axis=1, keepdims=True)).astype(np.float32)


def shard_rows(n: int) -> int:
    """Rows of a shard: they grow with the root of the table's, so that shards do too."""
    return min(MOST_SHARD_ROWS, max(SHARD_ROWS, 16 * math.isqrt(n)))


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, vector, dim)`` of the rows that take part: id and vector not null, the vector
    not zero, its components finite and not null. ``vector`` is the direction, the vector
    divided by its component of largest size."""
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & good)
    rows = rows.withColumn("most", F.array_max(F.transform(v, F.abs)))
    return rows.select("id", F.transform(v, lambda x: x / F.col("most") + 0.0).alias("vector"), F.size(v).alias("dim"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``(vector, dim, ids)``: the k + 1 smallest distinct ids of each distinct direction."""
    w = Window.partitionBy("vector").orderBy("id")
    first = rows.dropDuplicates(["id", "vector"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    return first.groupBy("vector").agg(F.first("dim").alias("dim"), F.sort_array(F.collect_list("id")).alias("ids"))


_INDEX = "dim int, shard bigint, n int, ids binary, offsets binary, vectors binary, layers binary, depth int, entry int"


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.assign(least=rows["ids"].map(lambda x: x[0])).sort_values("least", kind="stable")
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    graph = Graph.build(_unit(vectors))
    ids = np.concatenate(rows["ids"].to_numpy()).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(rows["ids"].map(len))]).astype(np.int64)
    layers = b"".join(x.tobytes() for x in graph.layers)
    row = (int(rows["dim"].iloc[0]), int(rows["shard"].iloc[0]), len(rows), ids.tobytes(), offsets.tobytes(), vectors.tobytes(), layers, len(graph.layers), int(graph.entry))
    return pd.DataFrame([row], columns=["dim", "shard", "n", "ids", "offsets", "vectors", "layers", "depth", "entry"])


def build_index(rows: DataFrame, k: int) -> DataFrame:
    """The materialized index of :func:`usable` rows, one row a shard."""
    vectors = materialize(distinct_vectors(rows, k))
    n = vectors.count()
    shards = max(1, -(-n // shard_rows(n)))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards))).repartition(min(MOST_TASKS, 2 * shards), "dim", "shard")
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(_build_shard, _INDEX))


class _Shard:
    """A row of the index, opened."""

    def __init__(self, row: dict):
        n = row["n"]
        self.key = (row["dim"], row["shard"])
        self.ids, self.offsets = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["offsets"], dtype=np.int64)
        self.exact = np.frombuffer(row["vectors"], dtype=np.float64).reshape(n, row["dim"])
        flat, layers = np.frombuffer(row["layers"], dtype=np.int32), []
        for depth in range(row["depth"]):
            width = 2 * M if depth == 0 else M
            layers.append(flat[: n * width].reshape(n, width))
            flat = flat[n * width :]
        self.norms = np.sqrt((self.exact * self.exact).sum(1))
        self.graph = Graph(_unit(self.exact), layers, row["entry"])

    def nearest(self, query: int, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``(-score, id)`` of the k nearest ids found, nearest first, ties to the smaller id. The
        search widens while it finds fewer ids, as it does where one id has many vectors."""
        unit, size, ef = _unit(q[None])[0], math.sqrt(q @ q), EF_SEARCH
        while True:
            near = np.array(self.graph.search(unit, ef))
            scores = (self.exact[near] @ q) / (self.norms[near] * size)
            best: dict[int, float] = {}
            for s, y in zip(scores.tolist(), near, strict=True):
                for i in self.ids[self.offsets[y] : self.offsets[y + 1]].tolist():
                    if i != query and s > best.get(i, -math.inf):
                        best[i] = s
            if len(best) >= k or len(near) < ef:
                return heapq.nsmallest(k, ((-s, i) for i, s in best.items()))
            ef *= 2


_FOUND = "query_id bigint, vec_id bigint, score double"
_SHARD = ["n", "ids", "offsets", "vectors", "layers", "depth", "entry"]


def _search(k: int):
    """Over rows sorted by shard, that of the index before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            names, out = b.schema.names, []
            indexed = b.column(names.index("n")).is_valid().to_pylist()
            dims, shards, ids, vectors = (b.column(names.index(c)) for c in ("dim", "shard", "id", "vector"))
            for j, opens in enumerate(indexed):
                if opens:
                    shard = _Shard({c: b.column(names.index(c))[j].as_py() for c in ("dim", "shard", *_SHARD)})
                elif shard is not None and shard.key == (dims[j].as_py(), shards[j].as_py()):
                    query = ids[j].as_py()
                    out += [(query, i, -s) for s, i in shard.nearest(query, vectors[j].values.to_numpy(), k)]
            found = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows of ``df`` found for each row of
    ``queries``, by cosine, ties to the smaller id.

    Rows of ``df`` with the query's own id aren't candidates. Null ids and vectors that
    :func:`usable` rejects take no part on either side; vectors of different lengths never
    meet. Where an id has several rows, on either side, it counts once, by its nearest pair;
    rows with the query's id are its own.
    """
    index = build_index(usable(df, id_col, vector_col), k)
    shards = materialize(index.select("dim", "shard"))
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id", "vector"]).join(broadcast_if_small(shards), "dim")
    both = index.unionByName(asked.select("dim", "shard", "id", "vector"), allowMissingColumns=True)
    tasks = min(MOST_TASKS, max(1, 2 * shards.count()))
    dealt = both.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("n").isNull())
    found = dealt.mapInArrow(_search(k), _FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
