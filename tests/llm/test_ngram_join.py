"""The n-gram join against every pair compared, on tables with large groups of near copies."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from mediacat.llm import ngram_join


def plain(rows, shingle=5):
    """``{place: (size, component)}`` by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        ids = [x for x in (least.get(find(k)), i) if x is not None]
        least[find(k)] = min(ids) if ids else None
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def result(spark, rows, schema="doc_id long, text string", parts=3):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return sorted(map(tuple, ngram_join.ngram_components(df.select("doc_id", "text")).collect()), key=str)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_components_equal_all_pairs(spark):
    rng = random.Random(3)
    rows, hot = [], words(rng, 120)
    for k in range(150):  # copies of a text, changed so that some pairs link and others don't
        copy = list(hot)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    passages = [words(rng, 40) for _ in range(5)]
    for k in range(150, 210):  # texts made of passages that many share
        rows.append((k, " ".join(sum(rng.sample(passages, 3), words(rng, rng.choice((0, 5, 60)))))))
    chain = words(rng, 100)
    for k in range(210, 230):  # each links to the next, the ends don't
        chain = chain[3:] + words(rng, 3)
        rows.append((k, " ".join(chain)))
    rows += [(k, rows[k - 230][1].upper()) for k in range(230, 260)] + [(k, " ".join(words(rng, rng.randrange(1, 300)))) for k in range(260, 300)]
    assert result(spark, rows) == plain(rows)


def test_chunks_and_blocks(spark, monkeypatch):
    """Small blocks and slices here; the chunks are the driver's side. Tasks take the module's own numbers."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    rng = random.Random(5)
    base = words(rng, 90)
    rows = []
    for k in range(120):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    assert result(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [
    [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "a"), (5, "A"), (6, "a b c d"), (7, "a  b\tc D"), (8, "a b c"), (9, "a b c d e"), (10, "e d c b a")],
    [(None, "one two three four five six"), (None, "one two three four five six"), (7, "one two three four five six"), (7, None), (None, None), (3, "Ä ä   x y z")],
    [(1, "same words again and again"), (1, "same words again and again"), (1, "other words"), (2, "other words")],
    [(1, "a b c d e f g h i"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h i j k")],
])
def test_small_cases(spark, rows):
    assert result(spark, rows) == plain(rows)


def test_empty_table_clashing_names_and_other_types(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_components(empty).collect() == []
    rows = [("b", "one two three four five six", 1, 2, "x", 0), ("a", "ONE two three four five six", 3, 4, "y", 0)]
    df = spark.createDataFrame(rows, "name string, body string, node int, n int, key string, slot int")
    assert sorted(map(tuple, ngram_join.ngram_components(df, "name", "body").collect())) == [("a", 2, "a"), ("b", 2, "a")]


def test_very_long_text(spark):
    rng = random.Random(8)
    long = words(rng, 300_000)
    near = long[:150_000] + ["new"] * 20 + long[150_000:]
    assert len(" ".join(long)) > ngram_join.SLICE
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:200_000]))]
    got = result(spark, rows)
    assert got == plain(rows) and [r[2] for r in got] == [1, 1, 3]


def test_bitmaps_bound_differences():
    rng = random.Random(1)
    for _ in range(200):
        a = {rng.randrange(1 << 56) for _ in range(rng.randrange(1, 400))}
        b = {x for x in a if rng.random() < 0.8} | {rng.randrange(1 << 56) for _ in range(rng.randrange(1, 60))}
        import numpy as np

        x, y = (ngram_join.bitmap(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
        size = min(len(x), len(y))
        u, v = ngram_join._folded([x, y], size)
        assert np.bitwise_count(u ^ v).sum() <= len(a ^ b)
