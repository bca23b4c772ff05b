"""Phrases against plain counting of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mediacat.llm import collocations


def plain(rows, least=100, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for i in range(len(w)):
                for m in range(1, 6):
                    if i + m <= len(w):
                        counts["und" if lang is None else lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        known = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {q for p, c in known.items() for i in range(len(p)) for m in range(2, len(p)) if i + m <= len(p) and 100 * c >= 100 * f[q := p[i : i + m]]}
        found = []
        for p, a in known.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r, n))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r, n) in enumerate(sorted(found)[:top])]
    return sorted(out)


def result(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    return sorted(map(tuple, collocations.collocations(df, **how).collect()))


def corpus(seed, n, size=60):
    rng, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(12)]
    for _ in range(n):
        w = []
        for _ in range(size):
            w += rng.choice([["the"], ["of", "the"], [f"w{int(rng.paretovariate(0.6)) % 40}"], ["New", "york", "city"], ["a", "a", "a", "a"], passage, ["the", "ß", "Äh"]])
            w.append(rng.choice(["", "", "", "", ".", "\n", ",", "\x0b;", "\t"]))
        rows.append((rng.choice(["en", "en", "en", "de", None]), " ".join(w)))
    return rows


def test_phrases_equal_plain_counts(spark):
    rows = corpus(1, 120)
    want = plain(rows)
    assert len(want) > 40 and result(spark, rows) == want
    few = plain(rows, top=7)
    assert result(spark, rows, top=7) == few and result(spark, rows, parts=1, min_count=30) == plain(rows, 30)


def test_hot_prefixes_are_split(spark, monkeypatch):
    rows = corpus(2, 150)
    sent = []
    monkeypatch.setattr(collocations, "HOT_PLACES", 150)  # words and pairs
    real = collocations._project
    monkeypatch.setattr(collocations, "_project", lambda *a: sent.append([x.value for x in a[1:]]) or real(*a))
    assert result(spark, rows) == plain(rows)
    hot_words, hot_pairs = sent[0]
    assert len(hot_words["en"]) > 3 and len(hot_pairs) > 3


@pytest.mark.parametrize("rows", [
    [],
    [("en", None), (None, None), ("en", ""), ("en", " \t "), ("en", ".,;:!?\n\r\x0b\x0c")],
    [("en", "a")] * 150 + [("en", "a b")] * 99,
    [("en", "a b")] * 100 + [(None, "a b")] * 60 + [("und", "A B")] * 40,
    [("en", "a b c")] * 100 + [("en", "b c")] * 1,
    [("en", "a " * 300)] * 2,
    [("en", "one two three four five six seven x \x00 y")] * 100,
])
def test_small_cases(spark, rows):
    assert result(spark, rows) == plain(rows)


def test_very_long_text_and_clashing_names(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha beta", "gamma", "delta.", "x"]) for _ in range(400_000))
    assert len(text) > collocations.SLICE
    df = spark.createDataFrame([("en", text, 1, "k", 2)], "body_lang string, body string, n int, words string, a int")
    assert sorted(map(tuple, collocations.collocations(df, "body", "body_lang").collect())) == plain([("en", text)])


def test_growth_is_depth_first_and_exact():
    words = np.array([[1, 2, 3], [1, 2, 0], [1, 3, 0], [2, 0, 0]], dtype=np.uint64)
    got = list(collocations.grow((9,), words, np.array([5, 6, 3, 20]), 6))
    assert got == [((9, 1), 14), ((9, 1, 2), 11), ((9, 2), 20)]


def test_coded_counts_keep_the_threshold():
    counts = np.array([1, 2, 99, 100, 101, 5000, 10**7])
    back = collocations._DECODED[collocations._coded(counts)]
    assert (back[:3] == counts[:3]).all() and (back[3:] >= 100).all() and (back <= counts).all()
