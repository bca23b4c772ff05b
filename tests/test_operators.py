"""Golden cases of the catalog's rules, and random comparisons with plain folds."""

import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from mediacat.functions import scalars as S
from mediacat.operators import dedupe, events, faces, geo, mutations, review, search, vectors
from mediacat.operators.criteria import QueryCriteria as Q
from mediacat.operators.criteria import parse_folders, parse_ids, run, select_media, total
from mediacat.operators.graph import connected_components
from mediacat.operators.tables import numbered
from mediacat.sources import exif, files
from mediacat.streaming import ingest

MEDIA = "id long, file_path string, rating int, flag int, camera_make string, date_taken long, media_type string, has_gps boolean, latitude double, longitude double, caption string, width int, height int, file_size long, content_hash string, audio_title string"
EMPTY = {"file_name": "''", "camera_model": "''", "audio_artist": "''", "audio_album": "''", "audio_genre": "''", "duration": "0D"}


def media(spark, rows):
    names = [x.split()[0] for x in MEDIA.split(", ")]
    base = {"file_path": "a/b.jpg", "rating": 0, "flag": 0, "camera_make": "", "date_taken": 0, "media_type": "photo", "has_gps": False, "latitude": 0.0, "longitude": 0.0, "caption": "", "width": 0, "height": 0, "file_size": 0, "content_hash": "", "audio_title": ""}
    return spark.createDataFrame([tuple((base | {"id": k + 1} | r)[n] for n in names) for k, r in enumerate(rows)], MEDIA).withColumns({k: F.expr(v) for k, v in EMPTY.items()})


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        {"file_path": "/photos/2026/a.jpg", "rating": 5, "flag": 1, "camera_make": "Canon", "date_taken": 1000, "has_gps": True, "latitude": 41.9028, "longitude": 12.4964},
        {"file_path": "/photos/2026/b.jpg", "rating": 3, "camera_make": "Sony", "date_taken": 2000, "has_gps": True, "latitude": 35.68, "longitude": 139.69},
        {"file_path": "/photos/2026/c.jpg", "rating": 1, "flag": -1, "camera_make": "Nikon", "date_taken": 3000},
        {"file_path": "root_photo.jpg", "date_taken": -1104537600, "caption": "img_100"},
        {"file_path": "trip-2026/d.jpg", "date_taken": 0, "caption": "img-100", "camera_make": "Camera-X"},
    ]
    return {
        "media": media(spark, rows),
        "tags": spark.createDataFrame([(1, "nature", "keyword"), (2, "Portrait", "keyword"), (3, "Last Imported", "keyword")], "id long, name string, category string"),
        "media_tags": spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 3)], "media_id long, tag_id long"),
        "provenance": spark.createDataFrame([(1, 1, False, "clip")], "media_id long, tag_id long, manual boolean, source string"),
        "albums": spark.createDataFrame([(1, "Vacation", 3)], "id long, name string, cover_media_id long"),
        "album_media": spark.createDataFrame([(1, 1, 0), (1, 3, 1)], "album_id long, media_id long, position int"),
    }


@pytest.mark.parametrize(
    ("criteria", "ids"),
    [
        (Q(min_rating=3), {1, 2}),
        (Q(flag=1), {1}),
        (Q(not_flag=-1), {1, 2, 4, 5}),
        (Q(tag_ids=(1, 2)), {2}),
        (Q(tag_ids=(1, 2), match_any=True), {1, 2}),
        (Q(tag_ids=(2,), folder=".", match_any=True), {2, 4}),
        (Q(folder="\\PHOTOS\\2026\\"), {1, 2, 3}),
        (Q(folder="/"), {1, 2, 3, 4, 5}),
        (Q(folder="."), {4}),
        (Q(folder="trip_2026"), set()),
        (Q(search_text="img_100"), {4}),
        (Q(search_text="PORTRAIT"), {2}),
        (Q(camera_make="camera_x"), set()),
        (Q(date_to=-631152000), {4}),
        (Q(min_lat=35, max_lat=60, min_lon=-10, max_lon=30), {1}),
        (Q(min_lon=100, max_lon=20, has_gps=True), {1, 2}),
        (Q(min_lat=math.nan), {1, 2, 3, 4, 5}),
        (Q(album_id=1), {1, 3}),
        (Q(last_imported=True), {3}),
        (Q(tag_category="KEYWORD", media_type="all"), {1, 2, 3}),
    ],
)
def test_criteria(tables, criteria, ids):
    assert {r.id for r in select_media(tables, criteria).collect()} == ids


def test_paging_and_order(tables):
    ids = lambda c: [r.id for r in run(tables, c).collect()]
    assert ids(Q(limit=2)) == [3, 2] and ids(Q(limit=2, offset=2)) == [1, 5]
    assert ids(Q(limit=0, offset=3)) == [3, 2, 1, 5, 4]
    assert ids(Q(sort_by="nonsense", descending=False, limit=1)) == [4]
    assert ids(Q(album_id=1, sort_by="album_order", descending=False)) == [1, 3]
    assert total(tables, Q(limit=2), 2) == 5 and total(tables, Q(limit=9), 5) == 5


def test_criteria_round_trip_and_limits():
    c = Q(tag_ids=(1, 2), folders=("a",), min_lat=1.5, match_any=True, limit=7)
    assert Q.from_json(c.to_json()) == c
    assert Q.from_json('{"min_rating": "x", "limit": 3, "tag_ids": [1, "b", true]}') == Q(limit=3, tag_ids=(1,))
    for bad in (Q(min_rating=6), Q(min_rating=3, max_rating=2), Q(flag=1, not_flag=1), Q(limit=1001), Q(min_lat=91.0), Q(min_lon=5.0, max_lon=1.0), Q(tag_ids=(0,)), Q(offset=-1)):
        with pytest.raises(ValueError):
            bad.validate()
    assert parse_ids("3,1,3") == (3, 1) and parse_folders('["a,b"]') == ("a,b",) and parse_folders("a|b,c") == ("a", "b,c")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, S.ascii_lower(F.lit("ÄBc"))) == "Äbc"
    for path, penalty in (("a/x_copy.jpg", 10), ("copyright/temperature.jpg", 0), ("export/tmp/b (1).jpg", 30), ("a%20b%2Fc.jpg", 2), ("copy/copy.jpg", 20)):
        assert one(spark, S.path_penalty(F.lit(path))) == penalty
    assert one(spark, S.parse_date(F.lit("2024:02:31 01:02:03"))) == one(spark, S.parse_date(F.lit("2024-03-02 01:02:03")))
    assert one(spark, S.parse_date(F.lit("1700-01-01"))) == 0 and one(spark, S.parse_date(F.lit("junk"))) == 0
    assert one(spark, S.parse_exif_date(F.lit("2024:02:31 01:02:03"))) is None
    assert one(spark, S.format_date(F.lit(0))) == "" and one(spark, S.format_date(F.lit(-86400))) == "1969:12:31 00:00:00"
    assert abs(one(spark, S.haversine_km(F.lit(52.52), F.lit(13.405), F.lit(48.8566), F.lit(2.3522))) - 877.46) < 1
    assert one(spark, S.truncate_bytes(F.lit("éé" * 60))) == "é" * 50
    assert one(spark, S.is_generic_folder(F.lit("100APPLE"))) and not one(spark, S.is_generic_folder(F.lit("Rome 2020")))
    assert one(spark, S.thumbnail_path(F.lit("abcdef"))) == "ab/cd/abcdef_256.jpg"
    assert one(spark, S.is_usable_caption(F.lit(" ! "))) is False and one(spark, S.is_usable_caption(F.lit("Rome")))
    assert one(spark, S.decode_data_url(F.lit("data:text/plain;base64,aGk="))) == b"hi"
    S.register(spark)
    assert spark.sql("SELECT ascii_lower('ÀB') AS x, haversine_km(0, 0, 0, 1) AS y").first().x == "Àb"


def test_duplicates_and_keeper(spark):
    rows = [{"content_hash": h, "file_size": s} for h, s in (("h1", 1000), ("h1", 1000), ("h1", 1000), ("h2", 2000), ("h2", 2000), ("h1", 500), ("u", 1), ("", 9), ("", 9))]
    m = media(spark, rows)
    assert sorted(r.n for r in dedupe.exact_groups(m).collect()) == [2, 3]
    assert [r.ids for r in dedupe.exact_groups(m, m.where("id IN (1, 2, 6, 7)")).collect()] == [[1, 2]]
    better = [{"flag": 1}, {"width": 10, "height": 10}, {"file_size": 5}, {"caption": "x"}]
    for b in better:
        pair = media(spark, [{"content_hash": "h"}, {"content_hash": "h"} | b])
        assert [r.id for r in dedupe.ranked(pair, ["content_hash"]).orderBy("rank").collect()] == [2, 1]
    tidy = media(spark, [{"content_hash": "h", "file_path": "export/a.jpg"}, {"content_hash": "h"}])
    assert dedupe.ranked(tidy, ["content_hash"]).where("rank = 1").first().id == 2


def first_fit(ids, foes):
    clusters = []
    for i in sorted(ids):
        home = next((c for c in clusters if not any((min(i, j), max(i, j)) in foes for j in c)), None)
        if home is None:
            clusters.append(home := [])
        home.append(i)
    return sorted(tuple(c) for c in clusters if len(c) > 1)


def test_dismissed_members_are_kept_apart(spark):
    rng = random.Random(3)
    rows = [{"content_hash": f"h{rng.randrange(12)}", "file_size": 1} for _ in range(120)]
    foes = {tuple(sorted(rng.sample(range(1, 121), 2))) for _ in range(700)}
    m = media(spark, rows)
    got = {}
    for r in dedupe.split_dismissed(dedupe.exact_members(m), spark.createDataFrame(sorted(foes), "media_id_a long, media_id_b long")).collect():
        got.setdefault(r.cluster, []).append(r.id)
    by_hash = {}
    for k, r in enumerate(rows):
        by_hash.setdefault(r["content_hash"], []).append(k + 1)
    assert sorted(tuple(sorted(c)) for c in got.values()) == sorted(x for ids in by_hash.values() for x in first_fit(ids, foes))
    assert all(min(c) == k for k, c in got.items())


def test_visual_groups(spark):
    v = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.98, 0.198997, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0]), (4, [0.0, 0.99, 0.141067, 0.0])]
    index = spark.createDataFrame(v, "media_id long, embedding array<float>")
    m = media(spark, [{"date_taken": 1000}] * 3 + [{"date_taken": 200_000}])
    pairs = lambda df: {(r.a, r.b) for r in df.collect()}
    assert pairs(vectors.similar_pairs(index, 0.97)) == {(1, 2), (3, 4)}
    gone = spark.createDataFrame([(1, 2)], "media_id_a long, media_id_b long")
    assert pairs(dedupe.visual_edges(index, 0.97, m, 0, gone)) == {(3, 4)}
    assert pairs(dedupe.visual_edges(index, 0.97, m, 86_400)) == {(1, 2)}
    assert {(r.type, r.group_id, r.id, r.rank) for r in dedupe.scan(m, index, window=0).collect()} == {("visual", 1, 1, 1), ("visual", 1, 2, 2), ("visual", 3, 3, 1), ("visual", 3, 4, 2)}


def test_similar_pairs_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    rng = random.Random(5)
    rows = []
    for k in range(150):
        base = [rng.gauss(0, 1) for _ in range(6)] if k % 3 == 0 else [x + rng.gauss(0, 0.15) for x in rows[-1][1]]
        n = math.sqrt(sum(x * x for x in base))
        rows.append((k, [x / n for x in base]))
    index = spark.createDataFrame(rows, "media_id long, embedding array<float>")
    plain = index.alias("x").join(index.alias("y"), F.expr("x.media_id < y.media_id")).where(S.cosine("x.embedding", "y.embedding") >= F.lit(0.9).cast("float")).select("x.media_id", "y.media_id")
    got = [(r.a, r.b) for r in vectors.similar_pairs(index, 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in plain.collect()} and got


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 102), (101, 102), (200, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_rounds_of_components_leave_no_huge_estimate(spark):
    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = connected_components(path)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 200  # its digits grew with every round
    assert {r.id: r.component for r in found.collect()} == dict.fromkeys(range(41), 0)


def fold(rows):
    out, group, place = [], [], None
    for r in sorted(rows, key=lambda r: (r["date_taken"], r["id"])):
        here = (r["latitude"], r["longitude"]) if r["has_gps"] else None
        far = False
        if place and here:
            (a, b), (c, d) = (map(math.radians, x) for x in (place, here))
            h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
            far = 2 * S.EARTH_RADIUS_KM * math.asin(math.sqrt(h)) > 25
        if group and (r["date_taken"] - group[-1]["date_taken"] > 14400 or r["date_taken"] - group[0]["date_taken"] > 43200 or far):
            out.append([x["id"] for x in group])
            group, place = [], None
        place = here or place
        group.append(r)
    return sorted([*out, [x["id"] for x in group]])


def test_events_equal_the_fold(spark):
    rng, at, rows = random.Random(9), 86_000 * 3, []
    for k in range(600):
        at += rng.choice([0, 60, 3000, 7200, 14_400, 14_401, 20_000]) if k % 40 else 900_000
        rows.append({"id": k + 1, "date_taken": at, "has_gps": rng.random() < 0.5, "latitude": 50.0 + rng.choice([0, 0, 0, 0.1, 0.5]), "longitude": 8.0})
    got = {}
    for r in events.event_members(media(spark, rows)).collect():
        got.setdefault(r.event, []).append(r.id)
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in fold(rows))


def test_event_names(spark):
    rows = [{"date_taken": 100 + k, "caption": " Party " if k < 2 else "", "file_path": "x\\Rome 2020\\a.jpg"} for k in range(3)]
    m = media(spark, rows)
    tags = spark.createDataFrame([(1, "Wedding", "events"), (2, "Rome", "places"), (3, "Ann", "people")], "id long, name string, category string")
    links = lambda pairs: spark.createDataFrame(pairs, "media_id long, tag_id long")
    name = lambda pairs, m=m: events.event_summaries(m, {"tags": tags, "media_tags": links(pairs)}).first()
    every = lambda t: [(k, t) for k in (1, 2, 3)]
    assert (name(every(1) + every(2)).name_source, name(every(1)).name) == ("event", "Wedding")
    got = name(every(2) + every(3) + [(1, 1)])
    assert (got.name_source, got.name, got.people, got.places) == ("caption", "Party", ["Ann"], ["Rome"])
    plain = m.withColumn("caption", F.lit(""))
    assert name(every(2), plain).name_source == "place" and name([(1, 2)], plain).name == "Rome 2020"
    assert name([(1, 2)], plain.withColumn("file_path", F.lit("DCIM/100APPLE/a.jpg"))).name_source == "date"


def test_places(spark, tmp_path):
    path = tmp_path / "places.csv"
    path.write_bytes("﻿name,admin1,country_name,latitude,longitude,population\r\n\"Berlin\", Berlin ,Germany,52.52,13.405,1\r\nPotsdam,Brandenburg,Germany,52.4,13.06,1\r\nBad,x,y,abc,1,1\r\n,x,y,1,1,1\r\nEdge,,Fiji,0,179.9,1\r\n".encode())
    gazetteer = files.read_gazetteer(spark, str(path))
    assert [r.name for r in gazetteer.orderBy("row_no").collect()] == ["Berlin", "Potsdam", "Edge"]
    points = spark.createDataFrame([(52.52, 13.405), (52.97, 13.40), (54.0, 13.40), (0.0, -150.0), (200.0, 0.0), (0.0, -179.8), (None, 1.0)], "latitude double, longitude double")
    got = {(r.latitude, r.longitude): r.row_no for r in geo.nearest_places(points, gazetteer).collect()}
    rows = {r.name: r.row_no for r in gazetteer.collect()}
    assert got == {(52.52, 13.405): rows["Berlin"], (52.97, 13.40): rows["Berlin"], (0.0, -179.8): rows["Edge"]}


def test_clusters_by_tile_and_pixel(spark):
    rng = random.Random(3)
    spots = [(rng.uniform(-60, 60), rng.uniform(-170, 170)) for _ in range(40)]
    rows = [{"id": k + 1, "date_taken": rng.randrange(10**6), "has_gps": True, "latitude": la + rng.choice([0, 0, 2.5]), "longitude": lo} for k in range(300) for la, lo in [rng.choice(spots)]]
    m = media(spark, rows)
    x, y = S.mercator_pixel("latitude", "longitude", 3)
    points = {}
    for r in m.select("id", "date_taken", x.alias("x"), y.alias("y")).collect():
        points.setdefault((int(r.x // 512), int(r.y // 512)), {}).setdefault((math.floor(r.x), math.floor(r.y)), []).append(r)
    want = []
    for tile, pixels in points.items():
        clusters = []
        for group in sorted(pixels.values(), key=lambda g: max((r.date_taken, r.id) for r in g), reverse=True):
            k, px, py = len(group), sum(r.x for r in group) / len(group), sum(r.y for r in group) / len(group)
            near = min(clusters, key=lambda c: math.hypot(c[2] - px, c[3] - py), default=None)
            if near is None or math.hypot(near[2] - px, near[3] - py) >= 50:
                clusters.append([max((r.date_taken, r.id) for r in group)[1], k, px, py])
            else:
                near[1] += k
                near[2] += (px - near[2]) * k / near[1]
                near[3] += (py - near[3]) * k / near[1]
        want += [(*tile, c[0], c[1]) for c in clusters]
    assert sorted((r.tile_x, r.tile_y, r.cluster_id, r.n) for r in geo.map_clusters(m, 3).collect()) == sorted(want)
    assert geo.map_clusters(m.limit(0), 3).count() == 0


def test_places_in_an_order_over_ranges(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 11).alias("k")).repartition(7)
    got = {r.id: r.rank for r in numbered(df, [F.desc("k"), F.col("id")]).collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(range(1000), key=lambda i: (-(i * 37 % 11), i)))}
    assert numbered(df.limit(0), [F.col("id")]).count() == 0


def test_search_guards(spark, tables):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (99, [1.0, 0.0])], "media_id long, embedding array<float>")
    t = tables | {"index": index}
    assert [r.id for r in search.semantic_search(t, [1.0, 0.0], 2).orderBy("rank").collect()] == [1]  # 99 is taken, then falls away
    assert search.semantic_search(t, [1.0, 0.0], 2, Q(media_type="video")).count() == 0
    undated = t | {"media": t["media"].withColumn("date_taken", F.when(F.col("id") == 1, 0).otherwise(F.col("date_taken")))}
    assert [r.id for r in search.semantic_search(undated, [1.0, 0.0], 3, Q(date_to=10**9)).orderBy("rank").collect()] == [2, 3]


def test_resolve_albums_and_dismissal(spark, tables):
    m = media(spark, [{"content_hash": "h", "caption": ""}, {"content_hash": "h", "caption": "kept"}, {"content_hash": "g"}, {"content_hash": "g"}])
    t = tables | {"media": m}
    reviewed = spark.createDataFrame([(1, 2, "h"), (3, 4, "old")], "keeper long, id long, content_hash string")
    out, conflicts = dedupe.resolve(t, reviewed)
    assert {r.id: r.caption for r in out["media"].select("id", "caption").collect() if r.id < 3} == {1: "kept"}
    assert out["media"].count() == 3 and [r.id for r in conflicts.collect()] == [4]
    albums = spark.createDataFrame([(1, "A", 5)], "id long, name string, cover_media_id long")
    assert [(r.id, r.name) for r in mutations.create_album(albums, "B").orderBy("id").collect()] == [(1, "A"), (2, "B")]
    with pytest.raises(ValueError):
        mutations.create_album(albums, "A")
    members = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 5, 0)], "album_id long, media_id long, position int")
    left, rest = mutations.remove_from_album(albums, members, 1, spark.createDataFrame([(5,)], "id long"))
    assert left.first().cover_media_id is None and sorted((r.album_id, r.media_id) for r in rest.collect()) == [(1, 6), (2, 5)]
    f = spark.createDataFrame([(1, False, 7, 0), (2, False, 8, 3)], "id long, dismissed boolean, person_tag_id long, revision int")
    chosen = spark.createDataFrame([(1, True, 0), (2, True, 1)], "face_id long, dismissed boolean, expected_revision int")
    assert sorted(tuple(r) for r in review.set_dismissed(f, chosen).collect()) == [(1, True, None, 1), (2, False, 8, 3)]


def test_text_and_compact_dates(spark):
    assert one(spark, S.parse_compact_date(F.lit("20240229T010203xyz"))) == 1709168523
    assert one(spark, S.parse_compact_date(F.lit("20230229T010203"))) is None and one(spark, S.parse_compact_date(F.lit("2024"))) is None
    assert one(spark, S.valid_text(F.unhex(F.lit("61FF62")))) == "a\ufffdb"


def test_smart_labels_caps(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0])], "media_id long, embedding array<float>")
    labels = [("n1", "n", 0.2, [0.9, 0.0]), ("n2", "n", 0.2, [0.8, 0.0]), ("n3", "n", 0.2, [0.7, 0.0]), ("a1", "a", 0.2, [0.5, 0.0]), ("b1", "b", 0.9, [0.6, 0.0])]
    got = vectors.smart_labels(index, spark.createDataFrame(labels, "label_id string, label_group string, threshold float, embedding array<float>"))
    assert [r.label_id for r in got.orderBy("rank").collect()] == ["n1", "n2", "a1"]


def test_faces(spark):
    rows = [(1, 1, [1.0, 0.0], False, 7, 0), (2, 1, [0.8, 0.6], False, 8, 0), (3, 2, [1.0, 0.0], False, None, 0), (4, 2, [0.0, 1.0], True, None, 0), (5, 3, [0.0, -1.0], False, None, 0), (6, 3, [float("nan"), 0.0], False, 8, 0)]
    f = spark.createDataFrame(rows, "id long, media_id long, embedding array<float>, dismissed boolean, person_tag_id long, revision int")
    people = spark.createDataFrame([(7, "Ann"), (8, "Bob")], "id long, name string")
    none = spark.createDataFrame([], "face_id long, tag_id long")
    s = faces.suggestions(f, none, people, 2)
    assert [(r.face_id, r.name, r.rank) for r in s.orderBy("rank").collect()] == [(3, "Ann", 1), (3, "Bob", 2)]
    assert [r.name for r in faces.suggestions(f, spark.createDataFrame([(3, 7)], none.schema), people, 2).collect()] == ["Bob"]
    groups = {(r.type, r.name): (r.faces, r.suggested_faces) for r in faces.face_groups(f, s, people).collect()}
    assert groups == {("person", "Ann"): (2, 1), ("person", "Bob"): (2, 0), ("unnamed", ""): (1, 0), ("dismissed", ""): (1, 0)}
    chosen = spark.createDataFrame([(3, 7, 0), (5, 7, 9)], "face_id long, tag_id long, expected_revision int")
    assert {r.id: (r.person_tag_id, r.revision) for r in faces.accept(f, chosen).where("id IN (3, 5)").collect()} == {3: (7, 1), 5: (None, 0)}
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (2, 1, 1.0, 1.0, 10.0, 10.0, 0.8), (3, 1, 50.0, 50.0, 10.0, 10.0, 0.7)], "id long, media_id long, x double, y double, width double, height double, score double")
    assert {r.id for r in faces.suppress(boxes).collect()} == {1, 3}
    assert {(r.id, r.previous_id) for r in faces.match_previous(boxes.where("id <> 2"), boxes.where("id = 2")).collect()} == {(1, 2)}


def test_updates(spark, tables):
    m = tables["media"]
    out = mutations.merge_media(tables, spark.createDataFrame([(2, 1)], "keeper long, id long"))
    assert out["media"].count() == 4 and {(r.media_id, r.position) for r in out["album_media"].collect()} == {(2, 0), (3, 1)}
    assert out["media"].where("id = 2").first().flag == 1
    deleted = mutations.delete_media(tables, m.where("id = 3"))
    assert deleted["albums"].first().cover_media_id is None and deleted["album_media"].count() == 1
    assert [r.position for r in mutations.reorder_album(tables["album_media"], 1, [3, 1]).orderBy("media_id").collect()] == [1, 0]
    for bad in ([1], [1, 3, 3], [1, 4]):
        with pytest.raises(ValueError):
            mutations.reorder_album(tables["album_media"], 1, bad)
    paths = media(spark, [{"file_path": "/lib/a.jpg"}, {"file_path": "\\lib\\a.jpg"}, {"file_path": "b.jpg"}, {"file_path": "/lib/b.jpg"}, {"file_path": "/x/c.jpg"}])
    assert [r.new_path for r in mutations.relativise(paths, "/lib").orderBy("id").collect()] == ["a.jpg", "\\lib\\a.jpg", "b.jpg", "/lib/b.jpg", "/x/c.jpg"]
    named = m.withColumn("file_name", F.lit("a.jpg"))
    assert mutations.rename(named, 1, "z").where("id = 1").first().file_path == "/photos/2026/z.jpg"
    with pytest.raises(ValueError):
        mutations.rename(named, 1, "a/b")
    with pytest.raises(ValueError):
        mutations.move(m, m, "../x")
    assert mutations.move(m, m.where("id = 1"), "new").where("id = 1").first().file_path == "new/a.jpg"
    tags = mutations.create_tags(tables["tags"], spark.createDataFrame([("nature", "keyword"), ("New", "keyword")], "name string, category string"))
    assert {(r.id, r.name) for r in tags.where("id > 3").collect()} == {(4, "New")}
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "id long, parent_id long")
    assert {r.id: r.depth for r in mutations.tag_roots(tree).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}


def test_files_taxonomy_and_streams(spark, tmp_path):
    for name in ("a.jpg", "sub/b.mp4", ".hidden/c.jpg", "notes.txt"):
        (tmp_path / "lib" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / name).write_bytes(name.encode())
    assert {(r.file_name, r.media_type) for r in files.scan_folder(spark, str(tmp_path / "lib")).collect()} == {("a.jpg", "photo"), ("b.mp4", "video")}
    labels = files.read_taxonomy(spark, '{"labels": [{"id": "a", "name": "A", "group": "g", "prompts": ["x"]}]}')
    assert len(files.taxonomy_version(labels)) == 16 and files.as_json(labels.select("label_id")).first().json == '{"label_id":"a"}'
    for bad in ("{}", '{"labels": [{"id": "a", "name": "A", "prompts": []}]}', '{"labels": [{"id": "a", "name": "A", "prompts": ["x"], "threshold": 2}]}'):
        with pytest.raises(ValueError):
            files.read_taxonomy(spark, bad)
    rows = spark.createDataFrame([("a.jpg", 1, 10, "photo"), ("b.jpg", 1, 10, "photo")], "file_path string, file_size long, file_modified_time long, media_type string")
    rows.write.parquet(str(tmp_path / "in"))
    known, seen = rows.where("file_path = 'a.jpg'").withColumn("id", F.lit(1).cast("long")), []
    q = ingest.ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda: known, lambda df, n: seen.extend(r.file_path for r in df.collect()), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == ["b.jpg"]


def tiff(order, south):
    """A block with make, orientation 9, an original date and a place."""
    entries, heap, heap_at = {}, b"", 200
    pack = lambda fmt, *v: struct.pack(order + fmt, *v)

    def entry(tag, kind, n, data):
        nonlocal heap
        if len(data) <= 4:
            return pack("HHI", tag, kind, n) + data.ljust(4, b"\0")
        heap += data
        return pack("HHII", tag, kind, n, heap_at + len(heap) - len(data))

    angle = lambda d, m: pack("IIIIII", d, 1, m, 1, 0, 1)
    main = [entry(0x010F, 2, 6, b"Canon\0"), entry(0x0112, 3, 1, pack("H", 9)), entry(0x8769, 4, 1, pack("I", 80)), entry(0x8825, 4, 1, pack("I", 130))]
    photo = [entry(0x9003, 2, 20, b"2024:02:03 04:05:06\0"), entry(0x829A, 5, 1, pack("II", 1, 250)), entry(0x8827, 3, 1, pack("H", 400))]
    gps = [entry(1, 2, 2, b"S\0" if south else b"N\0"), entry(2, 5, 3, angle(52, 30)), entry(3, 2, 2, b"E\0"), entry(4, 5, 3, angle(13, 15))]
    out = (b"II" if order == "<" else b"MM") + pack("HI", 42, 8)
    for at, rows in ((8, main), (80, photo), (130, gps)):
        out = out.ljust(at, b"\0") + pack("H", len(rows)) + b"".join(rows) + pack("I", 0)
    return out.ljust(heap_at, b"\0") + heap


def jpeg(block):
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def png(block):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"eXIf", block)


def test_exif(spark):
    whole = jpeg(tiff("<", True))
    contents = [whole, png(tiff(">", False)), None, b"", b"\xff\xd8\xff", jpeg(b"II*\0\xff\xff\xff\xff"), *(whole[:k] + b"\xff" * 40 for k in range(20, len(whole), 17))]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "id long, content binary").select("id", exif.exif(F.col("content")).alias("x")).orderBy("id").collect()
    assert len(rows) == len(contents)
    for r, lat in zip(rows, (-52.5, 52.5)):
        assert (r.x.camera_make, r.x.orientation, r.x.date_taken, r.x.exposure_time, r.x.iso, r.x.has_gps, r.x.latitude, r.x.longitude) == ("Canon", 1, 1706933106, 0.004, 400, True, lat, 13.25)
    for r in rows[2:6]:
        assert (r.x.camera_make, r.x.orientation, r.x.date_taken, r.x.has_gps, r.x.latitude) == ("", 1, 0, False, 0.0)
