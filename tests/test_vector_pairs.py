"""The similarity join in chunks, and what is chosen of its pairs where they are found."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediacat.operators import dedupe, faces, vectors

N = 160


@pytest.fixture(scope="module")
def known(spark):
    """Vectors in four loose heaps, every pair with its score, dates and dismissals."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4, 8))[np.arange(N) % 4] + rng.normal(size=(N, 8)) * 0.6
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    ids = rng.permutation(10 * N)[:N]
    score = (v.astype(np.float64) @ v.T.astype(np.float64)).astype(np.float32)
    pairs = {(int(ids[i]), int(ids[j])): score[i, j] for i in range(N) for j in range(N) if ids[i] < ids[j]}
    index = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "media_id long, embedding array<float>").repartition(3)
    at = {int(i): None if i % 50 == 7 else int(i % 9) * 100 for i in ids if i % 31}
    gone = [p for p in pairs if sum(p) % 3 == 0] + [p[::-1] for p in pairs if sum(p) % 3 == 1]
    return index, pairs, at, gone


@pytest.fixture(params=[(4096, 16_384), (4096, 50), (30, 20)], ids=["one chunk", "chunks", "cells"], autouse=True)
def sizes(request, monkeypatch):
    for name, value in zip(("CELL_ROWS", "CHUNK_ROWS", "STRIP", "SCORES"), (*request.param, 2, 700)):
        monkeypatch.setattr(vectors, name, value)


def _of(df):
    return {(r.a, r.b): r.score for r in df.collect()}


def _groups(edges):
    """Components with the weakest edge of each."""
    root = {x: x for e in edges for x in e}
    for _ in root:
        if all(root[a] == root[b] for a, b in edges):
            break
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    least = {}
    for (a, _), s in edges.items():
        least[root[a]] = min(least.get(root[a], s), s)
    return root, {k: round(float(s), 4) for k, s in least.items()}


def test_pairs_links_and_best(spark, known):
    index, pairs, at, gone = known
    threshold = 0.9 if vectors.CELL_ROWS == 30 else 0.3
    want = {p: s for p, s in pairs.items() if s >= np.float32(threshold)}
    found = vectors.similar_pairs(index, threshold).collect()
    assert len(found) == len(want) and {(r.a, r.b): r.score for r in found} == pytest.approx(want, abs=1e-6)
    near = lambda x, y: x == 0 or y == 0 or (None not in (x, y) and abs(x - y) <= 200)
    judged = {p: s for p, s in want.items() if p not in set(gone) and p[0] in at and p[1] in at and near(at[p[0]], at[p[1]])}
    media = spark.createDataFrame(list(at.items()), "id long, date_taken long")
    out = spark.createDataFrame(gone, "media_id_a long, media_id_b long")
    assert _of(dedupe.visual_edges(index, threshold, media, 200, out)).keys() == judged.keys()
    links = _of(vectors.similar_links(index, threshold, media, 200, out))
    assert links.keys() <= judged.keys() and _groups(links) == _groups(judged)
    best = {}
    for (a, b), s in want.items():
        best.setdefault((a, b % 6), []).append((-s, b))
    got = {}
    for r in vectors.best_pairs(index, threshold, F.col("media_id") % 6, 2).collect():
        got.setdefault((r.face_id, r.tag_id), []).append((-r.score, r.example_id))
    assert {k: [b for _, b in sorted(x)[:2]] for k, x in got.items()} == {k: [b for _, b in sorted(x)[:2]] for k, x in best.items()}


def test_batches_stay_small(sizes):
    """A chunk of equal vectors has as many pairs as its square; none of that is held at once."""
    n = 200
    rows = lambda first: vectors._Side(pa.table({"id": np.arange(first, first + n), "v": [[1.0, 0.0]] * n, "tag": np.zeros(n, np.int64)}))
    out = list(vectors._Pairs(rows(0), np.float32(0.5), 0).meet(rows(n), False))
    assert sum(map(len, out)) == n * n and max(map(len, out)) <= 700
    links = list(vectors._Links(rows(0), np.float32(0.5), 0).meet(rows(n), False))
    assert sum(map(len, links)) < 3 * n


def test_vectors_are_not_copied_to_every_cell(spark, known, monkeypatch):
    """At a threshold that no cell is safe from, each vector moved once a cell and chunk of it."""
    index, *_ = known
    if vectors.CHUNK_ROWS > N:
        return
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    moved = []
    run = type(index).repartition
    monkeypatch.setattr(type(index), "repartition", lambda self, *a: (moved.append(self.count()), run(self, *a))[1])
    vectors.similar_pairs(index, -0.5).count()
    chunks = -(-N // vectors.CHUNK_ROWS)
    assert moved[0] <= N * (chunks + vectors.STRIP)


def test_suggestions_in_slices(spark, known, monkeypatch, sizes):
    """Scores are held for a slice of faces; slices change nothing."""
    if vectors.CHUNK_ROWS <= N:
        return
    f = known[0].select(F.col("media_id").alias("id"), "embedding", F.lit(False).alias("dismissed"), F.when(F.col("media_id") % 3 > 0, F.col("media_id") % 7).alias("person_tag_id"))
    none = spark.createDataFrame([], "face_id long, tag_id long")
    people = spark.createDataFrame([(k, f"p{k}") for k in range(7)], "id long, name string")
    of = lambda: sorted((r.face_id, r.tag_id, round(r.score, 5), r["rank"]) for r in faces.suggestions(f, none, people, 8, 0.3).collect())
    whole = of()
    monkeypatch.setattr(faces, "SLICE", 7)
    assert of() == whole and whole
