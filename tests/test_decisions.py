"""Decisions on faces against plain folds over the requests."""

from __future__ import annotations

import random

import numpy as np
import pytest

from mediacat.operators import decisions as D
from mediacat.plans import catalogue
from mediacat.sources.adapters import catalog

DIM, LEAST = 6, 0.5
FACES = "id long, media_id long, embedding array<float>, dismissed boolean, person_tag_id long, revision long, recognizer string"


def faces_of(seed, n=90, people=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(people, DIM))
    rows = []
    for k in range(1, n + 1):
        v = centres[k % people] * 0.8 + rng.normal(size=DIM)
        v = (v / np.linalg.norm(v)).astype(np.float32).tolist()
        rows.append([k, k % 30 + 1, v, k % 17 == 0, 100 + k % people if k % 4 == 0 else None, k % 3 + 1, None if k % 29 == 0 else "ab"[k % 5 == 0]])
    return rows


def names_of(people=6):
    return {100 + k: f"Person {9 - k}" for k in range(people)}


def ranked(face, faces, rejected, names, extra=()):
    """A face's people by plain comparison with every example."""
    best = {}
    for f in faces:
        if f[4] is not None and not f[3] and f[0] != face[0] and f[6] == face[6] and f[6] is not None and (face[0], f[4]) not in rejected:
            s = np.float32(min(1, max(-1, np.asarray(face[2], dtype=np.float64) @ np.asarray(f[2], dtype=np.float64))))
            if s >= np.float32(LEAST):
                best.setdefault(f[4], []).append((-s, f[0]))
    return sorted((min(e)[0], names[t], t) for t, e in best.items())


def plain_accept(faces, requests, rejected, names):
    faces = [list(f) for f in faces]
    by = {f[0]: f for f in faces}
    top = lambda f: {p[2] for p in ranked(f, faces, rejected, names)[:3]} if not f[3] and f[4] is None else set()
    start = {f[0]: (f[5], top(f)) for f in faces}
    out = []
    for seq, i, tag, rev in sorted(requests):
        if i <= 0 or tag <= 0 or rev <= 0:
            out.append((seq, "invalid"))
        elif i not in by:
            out.append((seq, "not_found"))
        elif by[i][5] != rev:
            out.append((seq, "stale"))
        elif by[i][4] is None and (tag in top(by[i]) or (start[i][0] == rev and tag in start[i][1])):
            by[i][4], by[i][5] = tag, rev + 1
            out.append((seq, "accepted"))
        else:
            out.append((seq, "ineligible"))
    return out, [tuple(f[k] for k in (0, 4, 5)) for f in faces]


def tables(spark, faces, rejected, names):
    return spark.createDataFrame([tuple(f) for f in faces], FACES), spark.createDataFrame(sorted(rejected), "face_id long, tag_id long"), spark.createDataFrame([(k, v, "people") for k, v in names.items()], "id long, name string, category string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_acceptances_in_sequence(spark, seed):
    rng = random.Random(seed)
    faces, names = faces_of(seed), names_of()
    rejected = {(k, 100 + k % 6) for k in range(1, 91, 7)} | {(k, 100 + (k + 1) % 6) for k in range(1, 91, 5)}
    requests = [(s, rng.choice([0, 500, *range(1, 91)]), rng.choice([*names, *names, 0]), rng.choice([1, 2, 2, 3, 3, 4])) for s in range(1, 30)]
    requests += [(s, i, rng.choice(list(names)), faces[i - 1][5]) for s, i in enumerate(rng.choices(range(1, 91), k=120), 30)]
    f, r, p = tables(spark, faces, rejected, names)
    df = spark.createDataFrame(requests, "seq long, face_id long, tag_id long, revision long")
    got = D.accept_in_order(f, df, r, p, DIM, LEAST, ["recognizer"])
    want, after = plain_accept(faces, requests, rejected, names)
    rows = sorted((x.seq, x.outcome) for x in got.collect())
    assert rows == want
    assert sorted((x.id, x.person_tag_id, x.revision) for x in D.apply_acceptances(f, got).collect()) == after
    # The order decides: some requests only pass because of those before them.
    back = [(1000 - s, i, t, v) for s, i, t, v in requests]
    turned, _ = plain_accept(faces, back, rejected, names)
    assert sorted((x.seq, x.outcome) for x in D.accept_in_order(f, spark.createDataFrame(back, df.schema), r, p, DIM, LEAST, ["recognizer"]).collect()) == turned
    assert sorted(o for _, o in turned) != sorted(o for _, o in want)


def test_a_chain_of_acceptances(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0, 0.0, 0.0, 0.0]
    faces = [[k + 1, 1, turn(k * np.pi / 3.2), False, 100 if k == 0 else None, 1, "a"] for k in range(5)]
    f, r, p = tables(spark, faces, set(), names_of())
    ask = lambda order: sorted((x.face_id, x.outcome) for x in D.accept_in_order(f, spark.createDataFrame([(s, i, 100, 1) for s, i in enumerate(order)], "seq long, face_id long, tag_id long, revision long"), r, p, DIM, LEAST, ["recognizer"]).collect())
    assert ask([2, 3, 4, 5]) == [(2, "accepted"), (3, "accepted"), (4, "accepted"), (5, "accepted")]
    assert ask([5, 4, 3, 2]) == [(2, "accepted"), (3, "ineligible"), (4, "ineligible"), (5, "ineligible")]


def test_rankings_follow_every_change(spark, monkeypatch):
    """After each of several changes the suggestions are those of a new ranking."""
    rng = random.Random(7)
    faces, names, rejected = faces_of(7, n=120, people=9), names_of(9), {(k, 100 + k % 9) for k in range(1, 121, 11)}
    asked, full = [], D.rankings

    def counted(*args):
        if len(args) > 6:
            asked.append(args[6].distinct().count())
        return full(*args)

    monkeypatch.setattr(D, "rankings", counted)
    f, r, p = tables(spark, faces, rejected, names)
    state = D.rankings(f, r, p, DIM, LEAST, ["recognizer"])
    for step in range(4):
        changed, cleared = [], []
        for face in rng.sample(faces, 6):
            if step == 0:  # unnamed faces get a name
                face[4] = rng.choice(list(names)) if face[4] is None else face[4]
            elif step == 1:  # named ones lose it, or are dismissed
                face[4], face[3] = None, rng.random() < 0.3
            elif step == 3:
                face[4] = rng.choice([None, *names])
                continue_with = face[0] % 120 + 1
                cleared.append((continue_with,))
                rejected = {x for x in rejected if x[0] != continue_with}
            if step != 2:
                changed.append((face[0],))
        if step == 2:  # everybody's first suggestion is rejected, and some second ones
            rejected |= {(x.face_id, x.tag_id) for x in state.where("rank = 1 or (rank = 2 and face_id % 3 = 0)").collect()}
        f, r, p = tables(spark, faces, rejected, names)
        ids, back = spark.createDataFrame(changed, "id long"), spark.createDataFrame(cleared, "face_id long")
        state = D.updated_rankings(state, f, r, p, DIM, ids, LEAST, ["recognizer"], back)
        got = sorted((x.face_id, x["rank"], x.tag_id, round(x.score, 5)) for x in state.where("rank <= 3").collect())
        want = sorted((i[0], k, t, round(float(-s), 5)) for i in faces if not i[3] and i[4] is None for k, (s, _, t) in enumerate(ranked(i, faces, rejected, names)[:3], 1))
        assert got == want, step
    assert len(asked) == 4 and max(asked[:2]) < 60  # most faces were decided by their bounds


def test_rankings_of_nothing(spark):
    f, r, p = tables(spark, [], set(), names_of())
    state = D.rankings(f, r, p, DIM, LEAST, ["recognizer"])
    assert state.count() == 0
    assert D.updated_rankings(state, f, r, p, DIM, f.select("id"), LEAST, ["recognizer"]).count() == 0


def test_the_acceptance_query(spark, monkeypatch):
    """The registered query on the given tables against a plain fold over its requests."""
    monkeypatch.setitem(globals(), "LEAST", 0.3)
    t = catalog(spark, "/root/testdata/sf0.001")
    faces = [[x.id, x.media_id, x.embedding, x.dismissed, x.person_tag_id, 1, "b" if x.id % 5 == 0 else "a"] for x in t["faces"].collect()]
    labels = {x.media_id: x.label for x in t["index"].collect()}
    requests = [(f[0] * 4 + k, f[0], 4000 + (labels[f[0]] + k) % 10, 1) for f in faces if f[4] is None for k in (0, 3)]
    rejected = {tuple(x) for x in t["face_rejections"].collect()}
    names = {x.id: x.name for x in t["tags"].where("category = 'people'").collect()}
    want, _ = plain_accept(faces, requests, rejected, names)
    got = catalogue.queries()["face_accepts"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((x.seq, x.outcome) for x in got) == want
    assert {o for _, o in want} >= {"accepted", "ineligible"}


def test_similar_faces_are_never_listed(spark, monkeypatch):
    """Of many faces that are all alike, no table has a row a pair; the order still decides."""
    n, counts, cut = 160, [], D.checkpointed
    monkeypatch.setattr(D, "checkpointed", lambda df: counts.append((out := cut(df)).count()) or out)
    monkeypatch.setattr(D, "SCORES", 1000)
    angle = lambda k: 0.001 * k if k else np.pi / 2.5
    faces = [[k + 1, 1, [float(np.cos(angle(k))), float(np.sin(angle(k))), 0.0, 0.0, 0.0, 0.0], False, 100 if k == 0 else None, 1, "a"] for k in range(n)]
    faces[1][2] = [float(np.cos(np.pi / 5)), float(np.sin(np.pi / 5)), 0.0, 0.0, 0.0, 0.0]  # alone near the example
    f, r, p = tables(spark, faces, set(), names_of())
    requests = [(i, i, 100, 1) for i in range(2, n + 1)] + [(1, 3, 100, 1)]
    got = D.accept_in_order(f, spark.createDataFrame(requests, "seq long, face_id long, tag_id long, revision long"), r, p, DIM, LEAST, ["recognizer"])
    want, _ = plain_accept(faces, requests, set(), names_of())
    assert sorted((x.seq, x.outcome) for x in got.collect()) == want
    assert [o for _, o in want[:2]] == ["ineligible", "accepted"] and want[2][1] == "accepted"
    assert max(counts) <= 4 * n
