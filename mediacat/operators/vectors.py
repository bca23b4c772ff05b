"""Exact vector search, similarity joins, and labels over unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.scalars import cosine, normalise
from mediacat.operators.tables import checkpointed

#: A cell of the similarity join holds about as many vectors.
CELL_ROWS = 4096
#: Vectors that a task of the join holds, chunks of as many that pass it, and scores taken at once.
CHUNK_ROWS = 16_384
STRIP = 8
SCORES = 1 << 20
#: Best examples that a task holds before it returns them, and most partitions of the join.
MOST_HELD = 1 << 21
MOST_TASKS = 4096
LABEL_BLOCK = 4096
MOST_PIVOTS = 256


def load_index(state: DataFrame, media: DataFrame, model: str, dim: int) -> DataFrame:
    """Vectors of photos whose content hasn't changed since: ``(media_id, embedding)``."""
    fresh = state.where((F.col("model_id") == model) & (F.col("error_text") == "") & (F.size("embedding") == dim))
    photos = media.where("media_type = 'photo'").select(F.col("id").alias("media_id"), "content_hash")
    return fresh.join(photos, ["media_id", "content_hash"]).select("media_id", "embedding")


def top_k(index: DataFrame, query: list[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """``(media_id, score, rank)`` of the k best, ties to the smaller id; k is held to 1..1000.

    ``allowed`` (ids) filters before the ranking. Only k rows of each task are sorted.
    """
    k = min(1000, max(1, k))
    if allowed is not None:
        index = index.join(allowed.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    q = F.array(*(F.lit(float(x)) for x in query))
    best = index.select("media_id", cosine("embedding", q).alias("score")).orderBy(F.desc("score"), "media_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "media_id")))  # of k rows


def similar(index: DataFrame, media_id: int, k: int) -> DataFrame:
    """The k nearest to an indexed item, itself left out; none if it isn't indexed."""
    own = index.where(F.col("media_id") == media_id).select(F.col("embedding").alias("own"))
    scored = index.where(F.col("media_id") != media_id).join(F.broadcast(own))  # one row
    best = scored.select("media_id", cosine("embedding", "own").alias("score")).orderBy(F.desc("score"), "media_id").limit(min(1000, max(1, k)))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "media_id")))


class _Side:
    """Vectors of one side of a comparison with their ids and what else the pairs are judged by."""

    def __init__(self, rows: pa.Table):
        column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        self.ids, self.v = column["id"].to_numpy(), _matrix(column["v"])
        self.at = column["at"].to_numpy(zero_copy_only=False).astype(np.float64) if "at" in column else None
        self.tag = column["tag"].to_numpy() if "tag" in column else None
        self.foes = column.get("foes")


def _matrix(lists) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class _Meeting:
    """The vectors of a chunk, on the left, and those that pass it: what is found of the pairs
    whose smaller id is on the left."""

    def __init__(self, left: _Side, least: np.float32, window: int):
        self.left, self.least, self.window = left, least, window
        self.rough = np.ascontiguousarray(left.v.T, dtype=np.float32)
        self.longest = _longest(left.v)
        if left.foes is not None:
            foe = left.foes.flatten().to_numpy()
            order = np.argsort(foe, kind="stable")
            self.owner, self.foe = np.repeat(np.arange(len(left.ids)), left.foes.value_lengths().to_numpy())[order], foe[order]

    def hits(self, right: _Side, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(right, left, score)``: places and scores of the pairs, sorted by the first two. Of
        ``own`` rows, smaller ids than on the left are among them.

        Products in single precision leave out what their error can't bring to the threshold;
        the others are taken in double precision.
        """
        left, n = self.left, len(self.left.ids)
        step = max(1, SCORES // n)
        rough, bound = right.v.astype(np.float32), self.longest * _longest(right.v)
        slack = self.least - 2.0**-22 * right.v.shape[1] * bound - 1e-6
        for k in range(0, len(right.ids), step):
            if bound < 1e15:
                at = np.flatnonzero((rough[k : k + step] @ self.rough).ravel() >= np.float32(slack))
                dense = len(at) > SCORES // 16
            else:  # nothing is known of the error
                at, dense = np.arange(len(rough[k : k + step]) * n), True
            r, c = np.divmod(at, n)
            r += k
            score = (right.v[k : k + step] @ left.v.T).ravel()[at] if dense else np.einsum("ij,ij->i", right.v[r], left.v[c])
            score = score.astype(np.float32)
            keep = score >= self.least
            if own:
                keep &= left.ids[c] < right.ids[r]
            if self.window > 0:
                ours, theirs = left.at[c], right.at[r]
                keep &= (ours == 0) | (theirs == 0) | (np.abs(ours - theirs) <= self.window)
            if left.foes is not None:
                ids = right.ids[k : k + step]
                first = np.searchsorted(self.foe, ids)
                times = np.searchsorted(self.foe, ids, "right") - first
                of = np.repeat(np.arange(len(ids)), times)
                gone = of * n + self.owner[np.arange(len(of)) + np.repeat(first - np.cumsum(times) + times, times)]
                keep &= ~np.isin(at, gone)
            if keep.any():
                yield r[keep], c[keep], score[keep]

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from ()


def _longest(v: np.ndarray) -> float:
    """The greatest length of the rows that are numbers."""
    return float(np.nanmax(np.linalg.norm(v, axis=1), initial=0.0))


def _edges(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], names=["a", "b", "score"])


class _Pairs(_Meeting):
    """Every pair."""

    def meet(self, right: _Side, own: bool) -> Iterator[pa.RecordBatch]:
        for r, c, score in self.hits(right, own):
            yield _edges(self.left.ids[c], right.ids[r], score)


class _Links(_Meeting):
    """Of each row on the right its weakest pair, and one with every component of the left side
    that its pairs join: the components of all pairs and the weakest of each."""

    def __init__(self, *of):
        super().__init__(*of)
        self.root = np.arange(len(self.left.ids))

    def meet(self, right: _Side, own: bool) -> Iterator[pa.RecordBatch]:
        found = []
        for r, c, score in self.hits(right, own):
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            stop = np.append(first[1:], len(r))
            weak = np.flatnonzero(score == np.repeat(np.minimum.reduceat(score, first), stop - first))
            weak = weak[np.concatenate([[True], r[weak[1:]] != r[weak[:-1]]])]
            found.append((self.left.ids[c[weak]], right.ids[r[weak]], score[weak]))
            root = self.root[c]
            for k in np.flatnonzero(np.minimum.reduceat(root, first) < np.maximum.reduceat(root, first)):
                at = np.arange(first[k], stop[k])
                roots, one = np.unique(self.root[c[at]], return_index=True)
                if len(roots) > 1:
                    at = at[one]
                    found.append((self.left.ids[c[at]], right.ids[r[at]], score[at]))
                    into = np.arange(len(self.root))
                    into[roots] = roots[0]
                    self.root = into[self.root]
        if found:
            yield _edges(*(np.concatenate(x) for x in zip(*found, strict=True)))


class _Best(_Meeting):
    """Of each row on the left, as a face, the best examples of every tag on the right."""

    def __init__(self, left: _Side, least: np.float32, most: int):
        super().__init__(left, least, 0)
        self.most, self.found, self.n = most, [], 0

    def meet(self, right: _Side, own: bool) -> Iterator[pa.RecordBatch]:
        for r, c, score in self.hits(right, own):
            self.found.append((self.left.ids[c], right.tag[r], right.ids[r], score))
            self.n += len(r)
            if self.n > MOST_HELD:
                self.compact()
                if self.n > MOST_HELD // 2:
                    yield from self.end()

    def compact(self) -> None:
        face, tag, example, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((example, -score, tag, face))
        face, tag, example, score = face[order], tag[order], example[order], score[order]
        n = self.most  # the n-th before is of another face or tag
        kept = np.ones(len(face), bool)
        kept[n:] = (face[n:] != face[:-n]) | (tag[n:] != tag[:-n])
        self.found, self.n = [(face[kept], tag[kept], example[kept], score[kept])], int(kept.sum())

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            self.compact()
            found, self.found, self.n = self.found[0], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["face_id", "tag_id", "example_id", "score"])


def _compared(rows: DataFrame, threshold: float, meeting: Callable[[_Side], _Meeting], schema: str) -> DataFrame:
    """What ``meeting`` finds of the pairs of ``rows`` (id, v, ...) that can score ``threshold``.

    Vectors belong to the cell of their nearest pivot (pivots are some of the vectors). By
    the triangle inequality of angles, what lies within an angle t of a vector is not
    further from that vector's pivot than from its own by more than 2t, so a vector is
    copied to just those cells, and a pair is found in the cell of the smaller id. Where
    that saves nothing (a low threshold copies every vector to every cell), all are one cell.

    Rows are dealt by id into chunks. A task holds one chunk of a cell; those of larger ids
    pass it in batches, up to ``STRIP`` chunks in a task. Vectors are thus moved once a chunk,
    a task's memory is that of a chunk and of ``SCORES`` scores, and no pair is found twice.
    """
    n = rows.count()
    if n == 0:
        return rows.sparkSession.createDataFrame([], schema)
    wanted = min(MOST_PIVOTS, -(-n // CELL_ROWS))
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id")).limit(wanted).collect()], dtype=np.float64)
    pivots = pivots[np.isfinite(pivots).all(1)]
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
    reach = 2 * float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def near(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = np.arccos(np.clip(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) @ pivots.T, -1, 1))
        return angle.argmin(1), angle <= angle.min(1, keepdims=True) + reach

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, copies = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
        for b in batches:
            if len(b):
                home, inside = near(_matrix(b.column(0)))
                homes += np.bincount(home, minlength=len(pivots))
                copies += inside.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(homes), pa.array(copies)], names=["cell", "homes", "copies"])

    cells = np.zeros((max(1, len(pivots)), 2), np.int64)
    if len(pivots) > 1:  # a row a pivot
        for r in rows.select("v").mapInArrow(count, "cell long, homes long, copies long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("copies").alias("copies")).collect():
            cells[r["cell"]] = r["homes"], r["copies"]
    whole = len(pivots) < 2 or 2 * int((cells[:, 0] * cells[:, 1]).sum()) >= n * n
    held, passing = -(-cells.T // CHUNK_ROWS)
    k = -(-n // CHUNK_ROWS)
    bounds = rows.approxQuantile("id", [j / k for j in range(1, k)], 0.1 / k) if whole and k > 1 else []
    tasks = sum(k // STRIP - i // STRIP + 1 for i in range(k)) if whole else int((held * (passing // STRIP + 1)).sum())
    step = max(1, 65_536 // (2 * k if whole else int(np.maximum(held, 1).sum()) + int(passing.max()) // STRIP + 1))

    def spread(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places 0.., each so many times, and which time it is."""
        of = np.repeat(np.arange(len(times)), times)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), step):
                b = batch.slice(start, step)
                ids = b.column("id").to_numpy()
                if whole:
                    j = np.searchsorted(bounds, ids, "right")
                    r, i = spread(j + 1)
                    other = np.zeros(len(r), np.int64), i, j[r] // STRIP, np.where(i == j[r], 1, 2)
                    x, s = spread((k - 1) // STRIP - j // STRIP + 1)
                    own = np.zeros(len(x), np.int64), j[x], j[x] // STRIP + s, np.zeros(len(x), np.int64)
                else:
                    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    home, inside = near(_matrix(b.column("v")))
                    row, cell = np.nonzero(inside)
                    of, i = spread(held[cell])
                    r, cell = row[of], cell[of]
                    other = cell, i, h[r] % passing[cell] // STRIP, np.ones(len(r), np.int64)
                    x, s = spread((passing[home] - 1) // STRIP + 1)
                    own = home[x], h[x] % held[home[x]], s, np.zeros(len(x), np.int64)
                out = b.take(pa.array(np.concatenate([x, r])))
                yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(np.concatenate(c)) for c in zip(own, other, strict=True))], names=[*b.schema.names, "cell", "i", "strip", "side"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, left, met = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("cell", "i", "strip", "side")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), len(b)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                part = pa.Table.from_batches([b.slice(start, stop - start)])
                *key, side = keys[:, start]
                if key != task:
                    if met is not None:
                        yield from met.end()
                    task, left, met = key, [], None
                if side == 0:
                    left.append(part)
                elif left:
                    met = met or meeting(_Side(pa.concat_tables(left)))
                    yield from met.meet(_Side(part), bool(side == 1))
        if met is not None:
            yield from met.end()

    columns = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    dealt = rows.mapInArrow(deal, f"{columns}, cell long, i long, strip long, side long")
    dealt = dealt.repartition(min(MOST_TASKS, 2 * tasks), "cell", "i", "strip").sortWithinPartitions("cell", "i", "strip", "side")
    return dealt.mapInArrow(run, schema)


def _vectors(index: DataFrame, *more: str) -> DataFrame:
    return index.select(F.col("media_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"), *more).where("id IS NOT NULL AND v IS NOT NULL")


def _judged(index: DataFrame, media: DataFrame | None, window: int, dismissals: DataFrame | None) -> tuple[DataFrame, int]:
    """The vectors with ``at``, when they were taken, and ``foes``, larger ids that each was
    dismissed with, so that pairs are judged where they are compared; and the window."""
    rows, window = _vectors(index), window if media is not None else 0
    if window > 0:
        rows = rows.join(media.select("id", F.col("date_taken").cast("double").alias("at")), "id")
    if dismissals is not None:
        foes = dismissals.where("media_id_a < media_id_b").groupBy(F.col("media_id_a").alias("id")).agg(F.collect_set(F.col("media_id_b").cast("long")).alias("foes"))
        rows = rows.join(foes, "id", "left").withColumn("foes", F.coalesce("foes", F.array().cast("array<bigint>")))
    return (checkpointed(rows) if window > 0 or dismissals is not None else rows), window  # read more than once


def similar_pairs(index: DataFrame, threshold: float, media: DataFrame | None = None, window: int = 0, dismissals: DataFrame | None = None) -> DataFrame:
    """``(a, b, score)`` of all pairs a < b of unit vectors with a score of ``threshold`` or more. Exact.

    With a ``window``, only those that ``media`` dates within as many seconds or not at all;
    without those that ``dismissals`` (media_id_a, media_id_b) name. Both are judged where
    vectors are compared (:func:`_compared`), so no other pair leaves a task.
    """
    rows, window = _judged(index, media, window, dismissals)
    least = np.float32(threshold)
    return _compared(rows, threshold, lambda left: _Pairs(left, least, window), "a long, b long, score float")


def similar_links(index: DataFrame, threshold: float, media: DataFrame | None = None, window: int = 0, dismissals: DataFrame | None = None) -> DataFrame:
    """Some of the :func:`similar_pairs`, at most a few for each vector and chunk: their components
    are those of all pairs, and so is the weakest pair of each component."""
    rows, window = _judged(index, media, window, dismissals)
    least = np.float32(threshold)
    return _compared(rows, threshold, lambda left: _Links(left, least, window), "a long, b long, score float")


def best_pairs(index: DataFrame, threshold: float, tag: Column, most: int) -> DataFrame:
    """``(face_id, tag_id, example_id, score)``: those of the :func:`similar_pairs` (face_id <
    example_id) among which are each face's ``most`` best examples of each ``tag``, a long and
    not null; ties to the smaller id. They are chosen where vectors are compared."""
    rows = _vectors(index, tag.cast("long").alias("tag"))
    least = np.float32(threshold)
    return _compared(rows, threshold, lambda left: _Best(left, least, most), "face_id long, tag_id long, example_id long, score float")


def centroids(index: DataFrame, group: str = "label") -> DataFrame:
    """``(group, embedding)``: the mean vector of each group, of unit length or zero.

    Means are taken by place, so a group of any size is reduced before the shuffle.
    """
    places = index.select(group, F.posexplode("embedding").alias("place", "x")).groupBy(group, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = places.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("mean"))
    return whole.select(group, normalise("mean").alias("embedding"))


def smart_labels(index: DataFrame, labels: DataFrame, min_score: float = 0.23, most: int = 3, most_per_group: int = 2, rejections: DataFrame | None = None) -> DataFrame:
    """``(media_id, label_id, score, rank)``: an item's best labels, at most so many a group.

    ``labels``: (label_id, label_group, threshold, embedding), a stated set that all items are
    scored against; it is broadcast in blocks of about ``LABEL_BLOCK`` rows. The best within
    each group come first, then the best of those.
    """
    named = checkpointed(labels.select("label_id", "label_group", "threshold", F.col("embedding").alias("of_label")))
    blocks = max(1, -(-named.count() // LABEL_BLOCK))
    parts = [named.where(F.pmod(F.xxhash64("label_id"), F.lit(blocks)) == k) for k in range(blocks)]
    scored = reduce(DataFrame.unionByName, (index.join(F.broadcast(p)).select("media_id", "label_id", "label_group", cosine("embedding", "of_label").alias("score"), "threshold") for p in parts))
    scored = scored.where(F.col("score") >= F.greatest(F.lit(min_score).cast("float"), F.col("threshold").cast("float")))
    if rejections is not None:
        scored = scored.join(rejections.select("media_id", "label_id"), ["media_id", "label_id"], "left_anti")
    best = [F.desc("score"), F.col("label_id")]
    within = scored.withColumn("place", F.row_number().over(Window.partitionBy("media_id", "label_group").orderBy(*best))).where(F.col("place") <= most_per_group)
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("media_id").orderBy(*best))).where(F.col("rank") <= most)
    return ranked.select("media_id", "label_id", "score", "rank")


def stale_items(media: DataFrame, state: DataFrame, keys: list[str], force: bool = False, near: dict[str, Column] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Photos with no up-to-date row in a state table; all photos if forced.

    A row is up to date if it has the photo's id and ``keys`` (nulls alike), and if its columns
    in ``near`` are within ``tolerance`` of what is given there for the photo.
    """
    photos = media.where("media_type = 'photo'")
    if force:
        return photos
    fresh = state.select(F.col("media_id").alias("id"), *keys, *(near or {}))
    fresh = fresh.select(*(F.col(c).alias(f"mediacat_{c}") for c in fresh.columns))
    same = [photos["id"] == F.col("mediacat_id"), *(photos[c].eqNullSafe(F.col(f"mediacat_{c}")) for c in keys), *(F.abs(F.col(f"mediacat_{c}") - at) < tolerance for c, at in (near or {}).items())]
    return photos.join(fresh, reduce(lambda a, b: a & b, same), "left_anti")


def encode(items: DataFrame, encoder, schema: str) -> DataFrame:
    """Run a batch encoder, ``pandas.DataFrame -> pandas.DataFrame``, over items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield encoder(b)

    return items.mapInPandas(run, schema)
