"""Batches that are accepted whole or not at all, versions of tables, path lookup, and the label job."""

import random

import pytest
from pyspark.sql import functions as F

from mediacat.operators import dedupe, jobs, lookup, writes
from mediacat.sources import versions

MEDIA = "id long, file_path string, rating int, caption string, created_at long, updated_at long"


def items(spark, rows):
    return spark.createDataFrame([(i, p, 3, "", 1, 1) for i, p in rows], MEDIA)


def batches(spark, rows):
    return spark.createDataFrame(rows, "batch long, file_path string, rating int, extra string")


def test_batches_are_accepted_whole_or_not_at_all(spark):
    media = items(spark, [(4, "a"), (9, "b")])
    rows = [(1, "c", 1, ""), (1, "d", 2, ""), (2, "e", 1, ""), (2, "a", 1, ""), (3, "f", 1, ""), (3, "f", 1, ""), (4, "c", 1, ""), (4, "g", 1, ""), (5, "g", 5, ""), (6, None, 1, ""), (None, "h", 1, ""), (7, "e", 1, "")]
    out, refused = writes.insert_batches(media, batches(spark, rows), 50)
    # The second is refused for a path of the catalog, so the seventh may have its other path; the
    # fourth for one of the first, so the fifth may have the fourth's.
    assert sorted((r.id, r.file_path, r.rating, r.created_at, r.updated_at) for r in out.collect()) == [
        (4, "a", 3, 1, 1), (9, "b", 3, 1, 1), (10, "c", 1, 50, 50), (11, "d", 2, 50, 50), (12, "g", 5, 50, 50), (13, "e", 1, 50, 50),
    ]
    assert out.columns == media.columns
    assert sorted((str(r.batch), str(r.file_path)) for r in refused.collect()) == sorted((str(b), str(p)) for b, p, *_ in rows if b in (2, 3, 4, 6, None))


def test_insert_into_and_of_nothing(spark):
    none = items(spark, [])
    out, refused = writes.insert_batches(none, batches(spark, [(1, "a", 1, "")]), 5)
    assert [(r.id, r.file_path, r.caption) for r in out.collect()] == [(1, "a", None)]
    assert refused.isEmpty()
    out, refused = writes.insert_batches(items(spark, [(4, "a")]), batches(spark, []), 5)
    assert [r.id for r in out.collect()] == [4]
    assert refused.isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_claims_equal_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    # Key 0 is claimed by a third of all batches.
    claims = [(b, 0 if rng.random() < 0.12 else rng.randrange(1, 150)) for b in range(80) for _ in range(rng.randrange(1, 5))]
    taken, won = set(), []
    for b in range(80):
        own = {k for c, k in claims if c == b}
        if own and taken.isdisjoint(own):
            taken |= own
            won.append(b)
    got = writes.first_claims(spark.createDataFrame(claims, "batch long, key long"))
    assert sorted(r.batch for r in got.collect()) == won


def test_chain_of_claims(spark):
    claims = [(b, k) for b in range(12) for k in (b, b + 1)]
    assert sorted(r.batch for r in writes.first_claims(spark.createDataFrame(claims, "batch long, key long")).collect()) == [0, 2, 4, 6, 8, 10]


def test_one_conflict_rolls_back_its_batch(spark):
    media = items(spark, [(k, f"p{k}") for k in range(1, 7)])
    rows = spark.createDataFrame(
        [(1, 1, 5, "p1"), (1, 2, 5, "p2"), (2, 3, 4, "p3"), (2, 4, 4, "moved"), (3, 1, 1, "p1"), (3, 5, 1, "p5"), (4, 3, None, "p3"), (5, 77, 1, "p77"), (5, 6, 1, "p6")],
        "batch long, id long, rating int, was_file_path string",
    )
    out, refused = writes.update_batches(media, rows, 9)
    # The fourth sees an item as it was, since the second was rolled back; its null leaves the rating.
    assert {r.id: (r.rating, r.updated_at) for r in out.collect()} == {1: (5, 9), 2: (5, 9), 3: (3, 9), 4: (3, 1), 5: (3, 1), 6: (3, 1)}
    assert {r.batch for r in refused.collect()} == {2, 3, 5}


def test_versions_change_in_one_step(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert versions.current(spark, root) == (0, {})
    one = {"media": items(spark, [(1, "a")]), "tags": spark.createDataFrame([(1,)], "id long")}
    assert versions.publish(spark, root, one, 0) == 1
    at, tables = versions.current(spark, root)
    assert (at, sorted(tables)) == (1, ["media", "tags"])
    out, _ = writes.insert_batches(tables["media"], batches(spark, [(1, "b", 1, "")]), 5)
    assert versions.publish(spark, root, tables | {"media": out}, at) == 2
    with pytest.raises(RuntimeError):  # this writer read version 1
        versions.publish(spark, root, one, 1)
    bad = one | {"tags": spark.createDataFrame([(1,)], "id long").select(F.raise_error(F.lit("lost")).alias("x"))}
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark, root, bad, 2)
    at, tables = versions.current(spark, root)
    assert (at, tables["media"].count(), tables["tags"].count()) == (2, 2, 1)
    # A writer that died before it named its folder leaves a mark that says nothing.
    (tmp_path / "catalog" / "versions" / f"{3:012d}").write_text("")
    at, tables = versions.current(spark, root)
    assert (at, tables["media"].count()) == (3, 2)
    assert versions.publish(spark, root, one, at) == 4


def test_paths_as_given_below_the_root_and_with_slashes(spark):
    media = items(spark, [(1, "a/b.jpg"), (2, "/srv/a/b.jpg"), (3, "c/d.jpg"), (4, "c\\e.jpg")])
    paths = ["/srv/a/b.jpg", "/srv/c/d.jpg", "c\\d.jpg", "c\\e.jpg", "/srv2/c/d.jpg", "none", None, "none"]
    got = lookup.by_path(media, spark.createDataFrame([(p,) for p in paths], "path string"), "/srv/")
    assert {r.path: (r.id, r.tried) for r in got.collect()} == {"/srv/a/b.jpg": (2, 0), "/srv/c/d.jpg": (3, 1), "c\\d.jpg": (3, 2), "c\\e.jpg": (4, 0)}


def test_delete_albums_tells_the_missing(spark):
    albums = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    members = spark.createDataFrame([(1, 5, 0), (2, 5, 0), (2, 6, 1)], "album_id long, media_id long, position int")
    left, kept, missing = writes.delete_albums(albums, members, spark.createDataFrame([(2,), (2,), (7,)], "id long"))
    assert [r.name for r in left.collect()] == ["A"]
    assert [tuple(r) for r in kept.collect()] == [(1, 5, 0)]
    assert [r.id for r in missing.collect()] == [7]


def test_scan_report_within_a_scope(spark):
    columns = "id long, content_hash string, file_size long, flag int, width int, height int, caption string, audio_title string, has_gps boolean, date_taken long, file_path string, media_type string"
    hashes = {1: "x", 2: "x", 3: "y", 4: "y", 5: "y", 6: "z", 7: "w", 8: "v"}
    media = spark.createDataFrame([(i, h, 10, 0, 1, 1, "", "", False, 0, f"p{i}", "photo") for i, h in hashes.items()], columns)
    vectors = {6: [1.0, 0.0], 7: [0.98, 0.199], 8: [0.0, 1.0]}
    index = spark.createDataFrame([(i, v) for i, v in vectors.items()], "media_id long, embedding array<double>")
    rows = dedupe.scan_report(media, index, 0.9, 0).orderBy("place").collect()
    assert [(r.type, r.keeper, r.n, r.bytes, r.min_similarity, r.media_scanned) for r in rows] == [("exact", 3, 3, 20, 1.0, 8), ("exact", 1, 2, 10, 1.0, 8), ("visual", 6, 2, 10, 0.98, 8)]
    scope = spark.createDataFrame([(i,) for i in (2, 4, 5, 5, 6, 99)], "id long")
    rows = dedupe.scan_report(media, index, 0.9, 0, scope=scope).collect()
    assert [(r.type, r.keeper, r.n, r.media_scanned) for r in rows] == [("exact", 4, 2, 4)]
    assert dedupe.scan_report(media, index, exact=False, visual=False).isEmpty()


KEY = {"model_id": "m", "model_revision": "1", "taxonomy_version": "t"}


@pytest.fixture
def shelf(spark):
    """Three photos and a video with sound vectors, of which one is of other content; two labels."""
    make = spark.createDataFrame
    vectors = [(1, "h1", "", [1.0, 0.0]), (2, "h2", "", [0.0, 1.0]), (3, "old", "", [1.0, 0.0]), (4, "h4", "", [0.7, 0.7]), (5, "h5", "broken", [1.0, 0.0])]
    return {
        "media": make([(1, "h1", "photo"), (2, "h2", "photo"), (3, "h3", "photo"), (4, "h4", "video"), (5, "h5", "photo")], "id long, content_hash string, media_type string"),
        "tags": make([(7, "Cat", "keyword"), (8, "Cat", "people")], "id long, name string, category string"),
        "media_tags": make([(1, 7), (2, 9)], "media_id long, tag_id long"),
        "provenance": make([(1, 7, True, "manual"), (2, 9, False, "clip")], "media_id long, tag_id long, manual boolean, source string"),
        "smart_tag_rejections": make([], "media_id long, tag_id long"),
        "smart_tag_state": make([(9, "h9", "m", "1", "t", 2, 5)], "media_id long, content_hash string, model_id string, model_revision string, taxonomy_version string, label_count long, updated_at long"),
        "index_state": make([(i, h, "m", "1", e, v) for i, h, e, v in vectors], "media_id long, content_hash string, model_id string, model_revision string, error_text string, embedding array<double>"),
    }


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([("a", "g", 0.5, [1.0, 0.0], "Cat"), ("b", "g", 0.5, [0.0, 1.0], "Dog")], "label_id string, label_group string, threshold float, embedding array<double>, name string")


def run_job(spark, tables, labels, ids=(1, 2, 3, 4, 5, 99), force=False, key=KEY, now=100):
    records, left = jobs.plan_labels(tables, spark.createDataFrame([(i,) for i in ids], "id long"), labels, key, force)
    out, written = jobs.write_labels(tables, records, key, now)
    return out, {r.media_id: r.status for r in left.unionByName(written).collect()}


def state(tables):
    return {r.media_id: (r.content_hash, r.taxonomy_version, r.label_count, r.updated_at) for r in tables["smart_tag_state"].collect()}


def links(tables):
    return {(r.media_id, r.tag_id) for r in tables["media_tags"].collect()}


def test_label_job_writes_once(spark, shelf, labels):
    out, status = run_job(spark, shelf, labels)
    # A vector of other content, a video and a failed vector are skipped; an unknown id fails.
    assert status == {1: "processed", 2: "processed", 3: "skipped", 4: "skipped", 5: "skipped", 99: "failed"}
    assert state(out) == {9: ("h9", "t", 2, 5), 1: ("h1", "t", 1, 100), 2: ("h2", "t", 1, 100)}
    dog = out["tags"].where("name = 'Dog'").first().id
    assert links(out) == {(1, 7), (2, dog)}  # the model's old link is gone
    assert {(r.media_id, r.tag_id, r.manual, r.source) for r in out["provenance"].collect()} == {(1, 7, True, "manual"), (2, dog, False, "clip")}
    again, status = run_job(spark, out, labels, now=200)
    assert set(status.values()) == {"skipped", "failed"}
    assert state(again) == state(out)
    assert links(again) == links(out)
    forced, status = run_job(spark, out, labels, ids=(1,), force=True, now=300)
    assert status == {1: "processed"}
    assert state(forced)[1] == ("h1", "t", 1, 300)
    newer, status = run_job(spark, out, labels, ids=(2,), key=KEY | {"taxonomy_version": "t2"}, now=400)
    assert status == {2: "processed"}
    assert state(newer)[2] == ("h2", "t2", 1, 400)


def test_label_job_checks_content_again_and_honours_rejections(spark, shelf, labels):
    shelf = shelf | {"smart_tag_rejections": spark.createDataFrame([(1, 7)], "media_id long, tag_id long")}
    records, _ = jobs.plan_labels(shelf, spark.createDataFrame([(1,), (2,)], "id long"), labels, KEY)
    changed = shelf | {"media": shelf["media"].withColumn("content_hash", F.expr("IF(id = 2, 'new', content_hash)"))}
    out, outcomes = jobs.write_labels(changed, records, KEY, 100)
    assert {r.media_id: r.status for r in outcomes.collect()} == {1: "processed", 2: "skipped"}
    assert state(out) == {9: ("h9", "t", 2, 5), 1: ("h1", "t", 0, 100)}
    assert links(out) == {(1, 7), (2, 9)}
    report = jobs.job_report(spark.createDataFrame([(1, "failed"), (2, "skipped")], "media_id long, status string")).first()
    assert (report.processed, report.skipped, report.failed, report.state) == (0, 1, 1, "failed")
