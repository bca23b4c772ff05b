"""The pipeline's near copies against brute force, and the row that stays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediacat.llm import common, similar

SF = "/root/testdata/sf0.01"


def plain_components(texts, same):
    """The least index of each text's component under ``same``."""
    least = {}
    for i in range(len(texts)):
        stack = [i] if i not in least else []
        while stack:
            x = stack.pop()
            if x not in least:
                least[x] = i
                stack += [y for y in range(len(texts)) if y not in least and same(texts[x], texts[y])]
    return least


def plain_same(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_drops_every_near_copy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    least = plain_components([plain_shingles(r.text) for r in rows], plain_same)
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [rows[i].doc_id for i in sorted(set(least.values()))]


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_near_copies, corpus_pipeline.drop_similar])
def test_the_row_that_stays(spark, stage):
    words = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(5)]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (7, words[2]), (7, words[3]), (7, words[3]), (3, words[3]), (9, None), (8, " "), (1, words[4]), (2, words[4])]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    want = [(None, words[0]), (None, words[1]), (7, words[2]), (3, words[3]), (8, " "), (1, words[4])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert stage(spark, spark.createDataFrame([], "doc_id long, text string"), SF).count() == 0


def test_bands_meet_at_four_fifths():
    rng = np.random.default_rng(7)
    met = [bool(set(similar.bands(x[:900]).tolist()) & set(similar.bands(x[100:]).tolist())) for x in rng.integers(0, 2**63, (300, 1000), dtype=np.uint64)]
    assert all(met)  # 800 of 1000 in common
    long = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    assert (similar.bands(long) == similar.bands(rng.permutation(long))).all()
    assert similar.bands(long[:0]).tolist() == [0]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_joins_in_place_beyond_the_broadcast(spark, monkeypatch, how):
    rows = spark.range(3000).withColumn("text", F.lit("x"))
    table = common.materialize(spark.range(0, 6000, 7).withColumn("y", F.col("id") + 1))
    want = sorted(map(str, rows.join(table, "id", how).collect()))
    monkeypatch.setattr(common, "is_small", lambda *a: False)
    assert sorted(map(str, common.join_in_place(rows, table, ["id"], how).select(*(["id", "text"] if how == "left_anti" else ["id", "text", "y"])).collect())) == want
    none = common.join_in_place(rows, table.limit(0), ["id"], how)
    assert none.count() == (0 if how == "inner" else 3000)


def test_filters_are_small_and_sharp(spark, monkeypatch):
    built, materialize = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df: built.append(materialize(df)) or built[-1])
    hashed = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("key"))
    marked = common.with_maybe(hashed(0, 80_000), hashed(0, 40_000), ["key"]).agg(F.count_if("mediacat_maybe").alias("n")).first()
    assert 40_000 <= marked.n < 41_000
    assert built[0].agg(F.sum(F.length("mediacat_bits")).alias("n")).first().n <= 128 << 10  # four times as much with one bit a key
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)
    kept = common.narrowed(hashed(0, 80_000), hashed(0, 40_000), ["key"]).join(hashed(0, 40_000), "key", "left_semi")
    assert kept.count() == 40_000  # a full filter still loses no key
