"""Near duplicates, containment, neighbours, toxicity and the pipeline against brute force."""

import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mediacat.llm import ann, decontaminate, simhash, toxicity

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, budget=4):
    """fps: id -> fingerprint; the least id of each id's component."""
    ids, least = sorted(fps), {}
    for i in ids:
        if i in least:
            continue
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in least:
                least[x] = i
                stack += [y for y in ids if y not in least and (fps[x] ^ fps[y]).bit_count() <= budget]
    return least


def test_components_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    least = plain_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(fps)
    assert all(int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == least[r.doc_id] for r in got)


def test_fingerprints_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, " \t", 0), (3, "ONE two", 0), (4, "one  two", 0), (None, "one two", 0), (4, "one  two", 0)], "doc_id long, text string, fp long")
    rows = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("1", 1), ("2", 1), ("3", 3), ("4", 3), ("4", 3), ("None", 3)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_layouts_move_all_bits_and_back(spark):
    values = np.random.default_rng(5).integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for agree, bits in ((1, 12), (2, 20), (3, 27), (4, 32)):
        order, least = simhash.layouts(4, agree)
        assert len(order) == math.comb(4 + agree, agree) and least >= bits
        for layout in order[::9]:
            out = np.array([r[0] for r in df.select(simhash.moved(F.col("fp"), layout)).collect()], dtype=np.int64)
            assert (simhash.moved_back(out.view(np.uint64), layout) == values.view(np.int64)).all()


@pytest.mark.parametrize(("sizes", "agree"), [((4096, 8192, 256), 1), ((16, 24, 4), 1), ((4096, 8192, 256), 2), ((1, 24, 4), 3)])
def test_trie_join_finds_every_link(spark, monkeypatch, sizes, agree):
    for name, v in zip(("GROUP_ROWS", "CHUNK_ROWS", "LEAF_PAIRS"), sizes, strict=True):
        monkeypatch.setattr(simhash, name, v)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = {0, 2**64 - 1}
    for b in base.tolist():
        for _ in range(40):
            values.add(b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 9)).tolist())))
    fps = {v - (v >> 63 << 64): v for v in values}
    least = plain_components(fps)
    nodes = spark.createDataFrame([(k,) for k in fps], "fp long")
    if agree > 1:  # as if there were too many for the blocks of fewer
        real = simhash.layouts
        monkeypatch.setattr(simhash, "layouts", lambda budget, m: real(budget, max(m, agree)))
    roots = {r.node: r.root for r in simhash.connected_components(simhash.hamming_links(nodes)).collect()}
    assert {k: roots.get(k, k) for k in fps} == least


def test_rounds_of_components_leave_no_huge_estimate(spark):
    path = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    roots = simhash.connected_components(path)
    assert roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 200  # its digits grew with every round
    assert {r.node: r.root for r in roots.collect()} == dict.fromkeys(range(41), 0)
    assert simhash.connected_components(path.limit(0)).count() == 0


def test_containment_of_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Intro, {item.upper()}! outro"), (1, f"Intro, {item.upper()}! outro"), (2, item.replace("six", "x")), (3, None), (None, item), (4, "short text")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 1), (8, item, 1), (9, "", 1), (10, None, 1), (11, "Short text.", 1)], "item_id long, text string, key long")
    got = sorted(str((r.doc_id, r.item_id, r.containment)) for r in decontaminate.contained_items(docs, items).collect())
    assert got == sorted(str(x) for x in [(1, 7, 1.0), (1, 7, 1.0), (1, 8, 1.0), (1, 8, 1.0), (None, 7, 1.0), (None, 8, 1.0), (4, 11, 1.0)])
    assert decontaminate.contained_items(docs.limit(0), items).count() == decontaminate.contained_items(docs, items.limit(0)).count() == 0


def plain_shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_containment_equals_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    of_docs = {r.doc_id: plain_shingles(r.text) for r in docs.collect()}
    of_items = {r.item_id: plain_shingles(r.text) for r in items.collect()}
    want = {(d, i) for d, a in of_docs.items() for i, b in of_items.items() if len(a & b) >= 0.8 * len(b)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()} == want and want


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 8)).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(1000 + k, v[50].tolist()) for k in range(9)]
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] * 8), (None, v[0].tolist()), (2200, [1.0, 2.0]), (2250, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {*range(0, 600, 50), 1000, 2200, 2250}
    assert [x[1] for x in sorted(got[50])] == [1000, 1001, 1002, 1003, 1004] and [x[1] for x in sorted(got[1000])] == [50, 1001, 1002, 1003, 1004]
    assert [x[1] for x in got[2200]] == [2250]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hits = sum(len({x[1] for x in got[q]} & set(np.argsort(-np.where(np.arange(600) == q, -9, u @ u[q]))[:5].tolist())) for q in range(0, 600, 50) if q != 50)
    assert hits >= 0.9 * 55
    assert ann.nearest(df.limit(0), df).count() == 0


def test_neighbours_of_extreme_and_parallel_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-9, 10, (200, 6)).astype(float) + 0.5
    rows = [(k, (x * 10.0 ** (200 if k % 3 else -200)).tolist(), "x", 1, 0.5) for k, x in enumerate(v)]
    rows += [(500 + k, (v[50] * (k + 2)).tolist(), "x", 1, 0.5) for k in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, dim int, score double")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    # The copies are exact multiples; 50 itself is rounded, so it comes before all of them or after.
    assert [x[1] for x in sorted(got[500])] in ([501, 502, 503, 504, 505], [50, 501, 502, 503, 504])
    assert all(np.isfinite(x[2]) and -1.000001 <= x[2] <= 1.000001 for found in got.values() for x in found)
    assert len({x[2] for x in got[500]}) == 1


def test_neighbours_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(6)
    # Id 7 has more vectors near the queries than a search visits; query 50 has two vectors.
    v = [(7, np.r_[1.0, rng.normal(size=7) * 1e-3]) for _ in range(400)] + [(int(k), rng.normal(size=8)) for k in rng.integers(100, 140, 120)]
    v += [(0, np.r_[1.0, np.zeros(7)]), (50, rng.normal(size=8)), (50, np.r_[1.0, np.full(7, 0.01)])]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v + v[:20]], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = lambda x: x / np.linalg.norm(x)
    ids = {i for i, _ in v}
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        best = {i: max(float(unit(a) @ unit(b)) for j, a in v if j == q for k, b in v if k == i) for i in ids - {q}}
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(x[0], x[1]) for x in sorted(found)] == [(n + 1, i) for n, (i, _) in enumerate(want)]
        assert np.allclose([x[2] for x in sorted(found)], [s for _, s in want], rtol=0, atol=1e-12)


def test_recall_on_the_whole_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in table.collect()]
    ids, v = np.array([x[0] for x in rows]), np.stack([x[1] for x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        scores = np.where(ids == q, -9, v @ v[np.flatnonzero(ids == q)[0]])
        fifth = np.sort(scores)[-5]
        hits += sum(s >= fifth - 1e-12 for _, s in found)
        assert all(abs(s - scores[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, s in found)
    assert len(got) == (ids % 50 == 0).sum() and hits >= 0.9 * 5 * len(got)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs.withColumn("score", docs.n_chars), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.02


def test_risk_equals_a_plain_loop():
    rng = np.random.default_rng(11)
    pos = [sorted(set(rng.integers(0, 6, rng.integers(0, 5)).tolist())) for _ in range(7)]
    unl = [sorted(set(rng.integers(0, 6, rng.integers(0, 5)).tolist())) for _ in range(9)]
    counts = rng.integers(1, 4, 9)
    sig = lambda t, w, b: 1 / (1 + math.exp(-(b + sum(w[k] for k in t))))

    def parts(x, prior):
        w, b = x[:-1], x[-1]
        many = [t for t, c in zip(unl, counts, strict=True) for _ in range(c)]
        mean = lambda rows, f: sum(f(sig(t, w, b)) for t in rows) / len(rows)
        return prior * mean(pos, lambda s: 1 - s), mean(many, lambda s: s) - prior * mean(pos, lambda s: s)

    for scale, prior in ((0.5, 0.2), (3.0, 0.9), (3.0, 0.05)):
        x = rng.normal(size=7) * scale
        value, g = toxicity.risk(x[:-1], x[-1], toxicity.Rows(pos), toxicity.Rows(unl, counts), prior)
        first, second = parts(x, prior)
        assert abs(value - first - max(0, second)) < 1e-12
        target = (lambda y: sum(parts(y, prior))) if second >= 0 else (lambda y: -parts(y, prior)[1])
        for k in range(7):
            d = np.eye(7)[k] * 1e-6
            assert abs((target(x + d) - target(x - d)) / 2e-6 - g[k]) < 1e-6


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "bad word"), (3, "bad word")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 5
    hot = docs.unionByName(spark.createDataFrame([(None, "x")] * 50 + [(3, "bad word")] * 50, docs.schema))
    assert toxicity.score(hot, labels).count() == 105
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(docs, labels.limit(0)).collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = corpus_pipeline.drop_toxic(spark, docs, SF)
    once = corpus_pipeline.drop_near_copies(spark, docs.unionByName(docs.limit(3)), SF)
    least = plain_components({r.doc_id: plain_fingerprint(r.text) for r in docs.collect()})
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(least.values()))
    bench = [plain_shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in docs.collect() if not any(len(plain_shingles(r.text) & b) >= 0.8 * len(b) for b in bench)}
    left = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert {r.doc_id for r in left.collect()} == clean
    redacted = corpus_pipeline.redact_secrets(spark, docs, SF)
    assert redacted.count() == docs.count() and redacted.where("n_chars <> length(text)").isEmpty()
    for out in (toxic, once, left, redacted):
        assert out.columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, SF).count() > 0
