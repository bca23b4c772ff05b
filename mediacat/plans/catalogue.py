"""The registry of queries: an operator over the adapted tables, and its twin in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions import scalars as S
from mediacat.operators import decisions, dedupe, events, facets, faces, geo, jobs, lookup, mutations, review, search, vectors, writes
from mediacat.operators.criteria import QueryCriteria as Q
from mediacat.operators.criteria import ordering, run, select_media, with_tags
from mediacat.operators.tables import checkpointed, numbered
from mediacat.sources.adapters import catalog, link_parts, with_clause
from mediacat.streaming import ingest

Tables = dict[str, DataFrame]
_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
#: Cosine thresholds of the driver's vectors, which are far apart.
LOOSE = 0.4


def query(sql: str | None = None):
    """Register a function of the tables under its name, with its SQL if it has one."""

    def register(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def folded(column: str) -> str:
    return f"translate({column}, {_UP}, {_LOW})"


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id", "rating", "date_taken")


def _ranked(df: DataFrame, c: Q) -> DataFrame:
    return numbered(df, ordering(c)).select("id", "rank")


# ---------------------------------------------------------------- criteria


@query("SELECT id, rating, date_taken FROM (SELECT * FROM media WHERE media_type = 'photo' AND rating >= 3 AND flag <> -1 AND starts_with(file_path, 'photos/1996/') ORDER BY date_taken DESC, id DESC LIMIT 50)")
def media_rating_flag(t: Tables) -> DataFrame:
    return _ids(run(t, Q(media_type="photo", min_rating=3, not_flag=-1, folder="photos/1996", limit=50)))


@query("SELECT id, rating, date_taken FROM media WHERE rating <= 2 AND flag = 1 AND date_taken >= 800000000 AND date_taken <= 900000000")
def media_date_range(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(max_rating=2, flag=1, date_from=800_000_000, date_to=900_000_000)))


@query("SELECT id, rating, date_taken FROM media WHERE date_taken <= 0")
def media_undated_kept(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(date_to=0)))


@query(f"SELECT id, rating, date_taken FROM media WHERE contains({folded('camera_make')}, 'build') AND contains({folded('camera_model')}, 'nation_1')")
def media_camera_like(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(camera_make="BUILD", camera_model="nation_1")))


@query(
    f"""SELECT id, rating, date_taken FROM media m WHERE contains({folded('file_name')}, 'fête 7') OR contains({folded('file_path')}, 'fête 7') OR contains({folded('caption')}, 'fête 7')
    OR contains({folded('camera_make')}, 'fête 7') OR contains({folded('camera_model')}, 'fête 7') OR contains({folded('audio_title')}, 'fête 7')
    OR m.id IN (SELECT media_id FROM media_tags JOIN tags ON tag_id = tags.id WHERE contains({folded('name')}, 'fête 7'))"""
)
def media_search_text(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(search_text="Fête 7")))


@query(
    f"""SELECT id, rating, date_taken FROM media m WHERE contains({folded('file_path')}, 'brand#11') OR contains({folded('caption')}, 'brand#11')
    OR m.id IN (SELECT media_id FROM media_tags JOIN tags ON tag_id = tags.id WHERE contains({folded('name')}, 'brand#11'))"""
)
def media_search_tag_name(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(search_text="BRAND#11")))


@query(f"SELECT id, rating, date_taken FROM media WHERE starts_with({folded('file_path')}, 'archive\\1997\\') OR starts_with({folded('file_path')}, '/photos/Été_1996/')")
def media_folder(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(folders=("ARCHIVE/1997/", "photos\\Été_1996"))))


@query("SELECT id, rating, date_taken FROM media WHERE NOT contains(file_path, '/') AND NOT contains(file_path, '\\')")
def media_folder_root(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(folder=".")))


@query("SELECT id, rating, date_taken FROM media WHERE id IN (SELECT media_id FROM media_tags WHERE tag_id IN (1005, 2004) GROUP BY media_id HAVING count(DISTINCT tag_id) = 2)")
def media_tags_all(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(tag_ids=(1005, 2004))))


@query("SELECT id, rating, date_taken FROM media WHERE id IN (SELECT media_id FROM media_tags WHERE tag_id IN (2004, 4003)) OR starts_with(file_path, 'photos/1998/02/')")
def media_tags_or_folder(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(tag_ids=(2004, 4003), folder="photos/1998/02", match_any=True)))


@query("SELECT id, rating, date_taken FROM media WHERE id IN (SELECT media_id FROM media_tags JOIN tags ON tag_id = tags.id WHERE lower(category) = 'people')")
def media_tag_category(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(tag_category="PEOPLE")))


@query("SELECT m.id, row_number() OVER (ORDER BY a.position DESC, m.id DESC) AS rank FROM media m JOIN album_media a ON a.media_id = m.id AND a.album_id = 8")
def media_album_order(t: Tables) -> DataFrame:
    c = Q(album_id=8, sort_by="album_order", limit=0)
    return _ranked(run(t, c), c)


@query("SELECT id, rating, date_taken FROM media WHERE id % 37 = 1")
def media_last_imported(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(last_imported=True)))


@query("SELECT id, rating, date_taken FROM media WHERE latitude >= -10 AND latitude <= 30.5 AND longitude >= 0 AND longitude <= 60")
def media_bbox(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(min_lat=-10.0, max_lat=30.5, min_lon=0.0, max_lon=60.0)))


@query("SELECT id, rating, date_taken FROM media WHERE longitude >= 170 OR longitude <= -170")
def media_bbox_antimeridian(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(min_lon=170.0, max_lon=-170.0, min_lat=float("nan"))))


@query("SELECT id, rating, date_taken FROM media WHERE NOT has_gps")
def media_has_gps(t: Tables) -> DataFrame:
    return _ids(select_media(t, Q(has_gps=False)))


@query("SELECT id, rating, date_taken FROM (SELECT * FROM media ORDER BY date_taken DESC, id DESC LIMIT 25 OFFSET 40)")
def media_page(t: Tables) -> DataFrame:
    return _ids(run(t, Q(limit=25, offset=40)))


@query("SELECT id, rating, date_taken FROM media WHERE rating = 5")
def media_page_unlimited(t: Tables) -> DataFrame:
    return _ids(run(t, Q(min_rating=5, limit=0, offset=40)))


@query("SELECT id, row_number() OVER (ORDER BY file_name ASC, id ASC) AS rank FROM media WHERE flag = 1 AND rating = 4")
def media_sort_name(t: Tables) -> DataFrame:
    c = Q(flag=1, min_rating=4, max_rating=4, sort_by="file_name", descending=False, limit=0)
    return _ranked(run(t, c), c)


@query("SELECT id, row_number() OVER (ORDER BY duration DESC, id DESC) AS rank FROM media WHERE media_type = 'video'")
def media_sort_duration(t: Tables) -> DataFrame:
    c = Q(media_type="video", sort_by="duration", limit=0)
    return _ranked(run(t, c), c)


@query(
    """SELECT m.id, coalesce(string_agg(category || '/' || name || '/' || coalesce(source, 'manual'), ',' ORDER BY category, name, g.id), '') AS tags
    FROM (SELECT * FROM media WHERE rating >= 4 ORDER BY date_taken DESC, id DESC LIMIT 100) m LEFT JOIN media_tags l ON l.media_id = m.id LEFT JOIN tags g ON g.id = l.tag_id
    LEFT JOIN provenance p ON p.media_id = l.media_id AND p.tag_id = l.tag_id GROUP BY m.id"""
)
def media_hydrated(t: Tables) -> DataFrame:
    page = with_tags(run(t, Q(min_rating=4)), t)
    return page.select("id", F.array_join(F.transform("tags", lambda x: F.concat_ws("/", x["category"], x["name"], x["source"])), ",").alias("tags"))


@query("SELECT id, rating, date_taken FROM media WHERE rating >= 2 AND date_taken <> 0 AND date_taken <= 850000000 AND media_type = 'photo'")
def media_smart_album(t: Tables) -> DataFrame:
    stored = Q(min_rating=2, media_type="photo", date_to=850_000_000).to_json()
    return _ids(select_media(t, Q.from_json(stored)).where("date_taken <> 0"))


# ---------------------------------------------------------------- facets


@query(
    """SELECT CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, count(*) AS n, CAST(greatest(10, round(100.0 * count(*) / max(count(*)) OVER ())) AS INT) AS height
    FROM (SELECT make_timestamp(date_taken * 1000000) AS d FROM media WHERE date_taken <> 0) GROUP BY year(d), month(d)"""
)
def timeline(t: Tables) -> DataFrame:
    return facets.timeline(t["media"])


@query("SELECT CAST(year(make_timestamp(date_taken * 1000000)) AS INT) AS year, count(*) AS n FROM media WHERE date_taken <> 0 GROUP BY 1")
def timeline_years(t: Tables) -> DataFrame:
    return facets.years(t["media"])


@query(
    """SELECT count(*) AS total, CAST(sum(file_size) AS BIGINT) AS bytes, min(nullif(date_taken, 0)) AS first_date, max(nullif(date_taken, 0)) AS last_date,
    count(*) FILTER (media_type NOT IN ('video', 'audio')) AS photos, count(*) FILTER (media_type = 'video') AS videos, count(*) FILTER (media_type = 'audio') AS audios,
    sum(duration) FILTER (media_type IN ('video', 'audio')) AS seconds, count(*) FILTER (flag = 1) AS picks, count(*) FILTER (flag = -1) AS rejects,
    count(*) FILTER (flag <> -1) AS not_rejects, count(*) FILTER (rating = 0) AS unrated FROM media"""
)
def stats(t: Tables) -> DataFrame:
    return facets.statistics(t["media"])


@query(
    """, s AS (SELECT l.tag_id, count(*) AS media_count, min(d) AS first_date, max(d) AS last_date FROM media_tags l JOIN (SELECT id, coalesce(nullif(date_taken, 0), CASE WHEN created_at > 0 THEN created_at END,
      CASE WHEN file_modified_time > 0 THEN file_modified_time END) AS d FROM media) m ON m.id = l.media_id GROUP BY l.tag_id),
    a AS (SELECT p.tag_id, count(*) AS ai_count FROM provenance p JOIN media_tags l ON l.media_id = p.media_id AND l.tag_id = p.tag_id WHERE source = 'clip' GROUP BY p.tag_id),
    c AS (SELECT tag_id, media_id AS cover_id FROM (SELECT l.tag_id, l.media_id, row_number() OVER (PARTITION BY l.tag_id ORDER BY (media_type = 'photo') DESC, date_taken DESC, m.id DESC) AS rn
      FROM media_tags l JOIN media m ON m.id = l.media_id) WHERE rn = 1)
    SELECT id, name, category, coalesce(media_count, 0) AS media_count, coalesce(ai_count, 0) AS ai_count, first_date, last_date, cover_id
    FROM tags LEFT JOIN s ON s.tag_id = id LEFT JOIN a ON a.tag_id = id LEFT JOIN c ON c.tag_id = id"""
)
def tag_facets(t: Tables) -> DataFrame:
    return facets.tag_facets(t)


@query("SELECT id, name, count(media_id) AS n FROM albums LEFT JOIN album_media ON album_id = id GROUP BY id, name")
def album_facets(t: Tables) -> DataFrame:
    return facets.album_facets(t)


@query("SELECT m.id, CAST(row_number() OVER (ORDER BY position, date_taken DESC, m.id) AS BIGINT) AS rank FROM album_media a JOIN media m ON m.id = a.media_id WHERE album_id = 12")
def album_listing(t: Tables) -> DataFrame:
    return facets.album_listing(t, 12).select("id", F.col("rank").cast("long").alias("rank"))


@query("SELECT DISTINCT regexp_extract(replace(file_path, '\\', '/'), '^(.+)/[^/]*$', 1) AS folder FROM media WHERE regexp_matches(replace(file_path, '\\', '/'), '^.+/')")
def folders(t: Tables) -> DataFrame:
    return facets.folders(t["media"])


@query("SELECT rating, count(*) AS n FROM media GROUP BY rating")
def rating_histogram(t: Tables) -> DataFrame:
    return facets.rating_histogram(t["media"])


@query("SELECT trim(caption) AS caption, count(*) AS n FROM media WHERE trim(caption) <> '' GROUP BY 1 ORDER BY n DESC, caption LIMIT 5")
def top_captions(t: Tables) -> DataFrame:
    return facets.top_captions(t["media"])


@query("SELECT category, count(DISTINCT tag_id) AS tags, count(*) AS links, count(DISTINCT media_id) AS items FROM media_tags JOIN tags ON tag_id = id GROUP BY category")
def category_coverage(t: Tables) -> DataFrame:
    return facets.category_coverage(t)


@query("SELECT min(latitude) - 1 AS min_lat, max(latitude) + 1 AS max_lat, min(longitude) - 1 AS min_lon, max(longitude) + 1 AS max_lon FROM media WHERE has_gps AND abs(latitude) <= 90 AND abs(longitude) <= 180")
def located_bounds(t: Tables) -> DataFrame:
    return facets.located_bounds(t["media"], 1.0)


@query("SELECT id, name, category FROM tags WHERE id IN (SELECT tag_id FROM media_tags WHERE media_id <= 5)")
def selection_tags(t: Tables) -> DataFrame:
    return facets.common_tags(t["media"].where("id <= 5"), t).select("id", "name", "category")


@query("SELECT id, CAST(row_number() OVER (ORDER BY n DESC NULLS LAST, name, id) AS BIGINT) AS rank FROM (SELECT id, name, count(media_id) AS n FROM albums LEFT JOIN album_media ON album_id = id GROUP BY id, name)")
def tile_order(t: Tables) -> DataFrame:
    return facets.sorted_tiles(facets.album_facets(t), "n").select("id", F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view,
    max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events GROUP BY user_id"""
)
def eav_pivot(t: Tables) -> DataFrame:
    return facets.eav_pivot(t["events"], "user_id", "event_type", "value", ["click", "view", "purchase"])


@query(
    """, r AS (SELECT *, concat('p', CAST(id % 700 AS STRING)) AS path FROM media)
    SELECT path AS file_path, min(id) AS id, max(rating) AS rating, arg_max(caption, (length(caption), -id)) AS caption, min(flag) AS flag,
    arg_min(latitude, id) FILTER (has_gps) AS latitude, arg_min(longitude, id) FILTER (has_gps) AS longitude, arg_min(camera_make, id) FILTER (camera_make <> '') AS camera_make FROM r GROUP BY path"""
)
def path_merge(t: Tables) -> DataFrame:
    return facets.merge_by_path(t["media"].withColumn("file_path", F.concat(F.lit("p"), (F.col("id") % 700).cast("string"))))


@query(
    """SELECT id, CASE WHEN date_taken = 0 THEN '' ELSE strftime(make_timestamp(date_taken * 1000000), '%Y:%m:%d %H:%M:%S') END AS formatted,
    CASE WHEN date_taken <> 0 THEN date_taken + 3600 ELSE 0 END AS shifted, date_taken AS parsed, CASE WHEN date_taken <> 0 THEN date_taken END AS compact FROM media"""
)
def date_functions(t: Tables) -> DataFrame:
    text = S.format_date("date_taken")
    compact = S.parse_compact_date(F.concat(F.translate(F.translate(text, ":", ""), " ", "T"), F.lit("000")))
    return t["media"].select("id", text.alias("formatted"), S.shift_date("date_taken", 3600).alias("shifted"), S.parse_date(text).alias("parsed"), compact.alias("compact"))


@query(
    """, x AS (SELECT id, CASE id % 5 WHEN 0 THEN ' Exif_JPEG_PICTURE ' WHEN 1 THEN 'untitled' WHEN 2 THEN caption WHEN 3 THEN '--------' ELSE '7' END AS text FROM media)
    SELECT id, length(trim(text)) >= 2 AND regexp_matches(text, '[\\p{L}\\p{N}]') AND trim(text) NOT IN ('DCF 1.0', 'CAMERA', 'Exif_JPEG_PICTURE', 'OLYMPUS DIGITAL CAMERA', 'MINOLTA DIGITAL CAMERA', 'SONY DSC',
      'SAMSUNG DIGITAL CAMERA', 'DIGITAL CAMERA', 'NIKON DIGITAL CAMERA', '--------', '+', ',') AS usable FROM x"""
)
def caption_functions(t: Tables) -> DataFrame:
    kind = F.col("id") % 5
    text = F.when(kind == 0, " Exif_JPEG_PICTURE ").when(kind == 1, "untitled").when(kind == 2, F.col("caption")).when(kind == 3, "--------").otherwise("7")
    return t["media"].select("id", S.is_usable_caption(text).alias("usable"))


@query("SELECT id, translate(file_path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, split_part(replace(file_path, '\\', '/'), '/', -1) AS base, CASE WHEN starts_with(file_path, 'photos/') THEN substring(file_path, 8) ELSE file_path END AS below FROM media")
def path_functions(t: Tables) -> DataFrame:
    return t["media"].select("id", S.ascii_lower("file_path").alias("low"), S.base_name("file_path").alias("base"), S.relative_to("file_path", "photos").alias("below"))


# ---------------------------------------------------------------- duplicates


@query("SELECT content_hash, file_size, count(*) AS n, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS ids FROM media WHERE content_hash <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def dup_exact_groups(t: Tables) -> DataFrame:
    return dedupe.exact_groups(t["media"]).withColumn("ids", F.array_join("ids", ","))


@query("SELECT content_hash, file_size, count(*) AS n, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS ids FROM copies WHERE content_hash <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def dup_document_groups(t: Tables) -> DataFrame:
    return dedupe.exact_groups(t["copies"]).withColumn("ids", F.array_join("ids", ","))


@query("SELECT content_hash, file_size, count(*) AS n, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS ids FROM media WHERE content_hash <> '' AND rating >= 3 GROUP BY 1, 2 HAVING count(*) > 1")
def dup_exact_scoped(t: Tables) -> DataFrame:
    return dedupe.exact_groups(t["media"], t["media"].where("rating >= 3")).withColumn("ids", F.array_join("ids", ","))


_KEEPERS = """, n AS (SELECT *, count(*) OVER (PARTITION BY content_hash, file_size) AS k FROM copies),
    r AS (SELECT *, row_number() OVER (PARTITION BY content_hash, file_size ORDER BY flag DESC, width * height DESC, file_size DESC,
      1 + CAST(has_gps AS INT) + CAST(date_taken <> 0 AS INT) DESC, CASE WHEN id % 2 = 1 THEN 30 ELSE 1 END, id) AS rank FROM n WHERE k > 1)"""


@query(_KEEPERS + " SELECT id, content_hash, CAST(rank AS BIGINT) AS rank FROM r")
def dup_keeper(t: Tables) -> DataFrame:
    return dedupe.ranked(dedupe.exact_members(t["copies"]), dedupe.GROUP).select("id", "content_hash", F.col("rank").cast("long").alias("rank"))


@query(_KEEPERS + " SELECT content_hash, max(id) FILTER (rank = 1) AS keeper, count(*) AS n, CAST(coalesce(sum(file_size) FILTER (rank > 1), 0) AS BIGINT) AS bytes FROM r GROUP BY content_hash, file_size")
def dup_reclaimable(t: Tables) -> DataFrame:
    return dedupe.reclaimable(dedupe.ranked(dedupe.exact_members(t["copies"]), dedupe.GROUP), dedupe.GROUP).select("content_hash", "keeper", "n", "bytes")


@query("SELECT count(*) AS groups FROM (SELECT 1 FROM media WHERE content_hash <> '' GROUP BY content_hash, file_size HAVING count(*) > 1)")
def dup_count(t: Tables) -> DataFrame:
    return dedupe.duplicate_count(t["media"])


@query("SELECT content_hash, file_size, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, file_size DESC, content_hash) AS BIGINT) AS place FROM media WHERE content_hash <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def dup_group_order(t: Tables) -> DataFrame:
    return dedupe.group_order(dedupe.exact_groups(t["media"]).drop("ids"))


@query("SELECT id FROM media m WHERE NOT EXISTS (SELECT 1 FROM media k WHERE m.id % 3 = 0 AND m.id % 4 <> 0 AND k.id = m.id - 1 AND k.content_hash = m.content_hash)")
def dup_resolved(t: Tables) -> DataFrame:
    seen = F.when(F.col("id") % 4 == 0, "changed since").otherwise(F.col("content_hash"))
    reviewed = t["media"].where("id % 3 = 0").select((F.col("id") - 1).alias("keeper"), "id", seen.alias("content_hash"))
    return dedupe.resolve(t, reviewed)[0]["media"].select("id")


@query(
    """, g AS (SELECT content_hash, file_size, list(id ORDER BY id) AS ids FROM media WHERE content_hash <> '' GROUP BY 1, 2 HAVING count(*) > 1),
    x AS (SELECT *, ids[1] AS a, ids[2] AS b, ids[3] AS c FROM g), y AS (SELECT *, CASE WHEN a % 4 = 0 AND b = a + 1 THEN b ELSE a END AS kb FROM x),
    z AS (SELECT *, CASE WHEN NOT (a % 4 = 0 AND c = a + 1) AND NOT (kb = a AND b % 4 = 0 AND c = b + 1) THEN a WHEN kb = b AND NOT (b % 4 = 0 AND c = b + 1) THEN b ELSE c END AS kc FROM y),
    p AS (SELECT content_hash, file_size, a AS id, a AS cluster FROM z UNION ALL SELECT content_hash, file_size, b, kb FROM z UNION ALL SELECT content_hash, file_size, c, kc FROM z WHERE c IS NOT NULL)
    SELECT content_hash, file_size, id, cluster FROM p QUALIFY count(*) OVER (PARTITION BY content_hash, file_size, cluster) > 1"""
)
def dup_exact_dismissed(t: Tables) -> DataFrame:
    pairs = t["media"].where("id % 4 = 0").select(F.col("id").alias("media_id_a"), (F.col("id") + 1).alias("media_id_b"))
    return dedupe.split_dismissed(dedupe.exact_members(t["media"]), pairs)


@query("SELECT DISTINCT least(a, b) AS media_id_a, greatest(a, b) AS media_id_b FROM (SELECT media_id_a AS a, media_id_b AS b FROM dismissals UNION ALL SELECT media_id_b + 1, media_id_a FROM dismissals) WHERE a <> b")
def dup_dismissals(t: Tables) -> DataFrame:
    more = t["dismissals"].select((F.col("media_id_b") + 1).alias("a"), F.col("media_id_a").alias("b"))
    return dedupe.dismiss(t["dismissals"], more)


_PAIRS = """, e AS (SELECT x.media_id AS a, y.media_id AS b, CAST(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS FLOAT) AS score FROM "index" x JOIN "index" y ON x.media_id < y.media_id)"""


@query(_PAIRS + f" SELECT a, b, round(CAST(score AS DOUBLE), 5) AS score FROM e WHERE score >= CAST({LOOSE} AS FLOAT)")
def dup_visual_pairs(t: Tables) -> DataFrame:
    return vectors.similar_pairs(t["index"], LOOSE).select("a", "b", F.round(F.col("score").cast("double"), 5).alias("score"))


_WINDOWED = (
    _PAIRS
    + f""", w AS (SELECT a, b, score FROM e JOIN media ma ON ma.id = a JOIN media mb ON mb.id = b WHERE score >= CAST({LOOSE} AS FLOAT) AND (ma.date_taken = 0 OR mb.date_taken = 0 OR abs(ma.date_taken - mb.date_taken) <= 40000000)
    AND NOT EXISTS (SELECT 1 FROM dismissals WHERE media_id_a = a AND media_id_b = b))"""
)


@query(_WINDOWED + " SELECT a, b, round(CAST(score AS DOUBLE), 5) AS score FROM w")
def dup_visual_windowed(t: Tables) -> DataFrame:
    return dedupe.visual_edges(t["index"], LOOSE, t["media"], 40_000_000, t["dismissals"]).select("a", "b", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(
    _PAIRS
    + f""", g AS (SELECT a, b, score FROM e WHERE score >= CAST({LOOSE} AS FLOAT)), s AS (SELECT a AS x, b AS y FROM g UNION ALL SELECT b, a FROM g),
    reach AS (SELECT DISTINCT x, x AS y FROM s UNION SELECT r.x, s.y FROM reach r JOIN s ON r.y = s.x), c AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)
    SELECT component, count(DISTINCT id) AS n, string_agg(DISTINCT CAST(id AS STRING), ',' ORDER BY CAST(id AS STRING)) AS ids, (SELECT round(CAST(min(score) AS DOUBLE), 3) FROM g JOIN c d ON d.id = g.a WHERE d.component = c.component) AS min_similarity
    FROM c GROUP BY component"""
)
def dup_visual_groups(t: Tables) -> DataFrame:
    out = dedupe.visual_groups(vectors.similar_links(t["index"], LOOSE))
    return out.withColumn("ids", F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ","))


_SCAN = (
    _PAIRS
    + f""", k AS (SELECT id, min(id) OVER (PARTITION BY content_hash, file_size) AS cluster, count(*) OVER (PARTITION BY content_hash, file_size) AS n FROM media WHERE content_hash <> ''), ex AS MATERIALIZED (SELECT id, cluster FROM k WHERE n > 1),
    p AS MATERIALIZED (SELECT i.media_id FROM "index" i JOIN media m ON m.id = i.media_id ANTI JOIN ex ON ex.id = i.media_id WHERE m.media_type = 'photo'),
    g AS (SELECT a, b, score FROM e SEMI JOIN p pa ON pa.media_id = a SEMI JOIN p pb ON pb.media_id = b ANTI JOIN dismissals d ON d.media_id_a = a AND d.media_id_b = b WHERE score >= CAST({LOOSE} AS FLOAT)),
    s AS MATERIALIZED (SELECT a AS x, b AS y FROM g UNION ALL SELECT b, a FROM g), reach AS (SELECT DISTINCT x, x AS y FROM s UNION SELECT r.x, s.y FROM reach r JOIN s ON r.y = s.x),
    r AS (SELECT 'exact' AS type, cluster AS group_id, id FROM ex UNION ALL SELECT 'visual', min(y), x FROM reach GROUP BY x)"""
)
_SCAN_ROWS = """SELECT type, group_id, id, row_number() OVER (PARTITION BY type, group_id ORDER BY flag DESC, CAST(width AS BIGINT) * height DESC, file_size DESC,
      CAST(caption <> '' OR audio_title <> '' AS INT) + CAST(has_gps AS INT) + CAST(date_taken <> 0 AS INT) DESC, CASE WHEN contains(file_path, '/copy/') THEN 10 ELSE 0 END + CASE WHEN contains(file_path, 'IMG (1)%20') THEN 11 ELSE 0 END, id) AS rank
    FROM r JOIN media USING (id)"""


@query(_SCAN + f" {_SCAN_ROWS}")
def dup_scan(t: Tables) -> DataFrame:
    return dedupe.scan(t["media"], t["index"], LOOSE, 0, t["dismissals"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    _SCAN
    + f""", o AS MATERIALIZED (SELECT * FROM ({_SCAN_ROWS}) JOIN (SELECT id, file_size FROM media) USING (id)), w AS (SELECT o.group_id, round(CAST(min(g.score) AS DOUBLE), 3) AS m FROM g JOIN o ON o.id = g.a AND o.type = 'visual' GROUP BY o.group_id),
    f AS (SELECT type, group_id, max(id) FILTER (rank = 1) AS keeper, count(*) AS n, CAST(coalesce(sum(file_size) FILTER (rank > 1), 0) AS BIGINT) AS bytes FROM o GROUP BY type, group_id)
    SELECT row_number() OVER (ORDER BY type, n DESC, keeper) AS place, type, group_id, keeper, n, bytes, CASE WHEN type = 'exact' THEN 1.0 ELSE CAST(m AS DOUBLE) END AS min_similarity, (SELECT count(*) FROM media) AS media_scanned
    FROM f LEFT JOIN w USING (group_id)"""
)
def dup_scan_report(t: Tables) -> DataFrame:
    return dedupe.scan_report(t["media"], t["index"], LOOSE, 0, t["dismissals"])


# ---------------------------------------------------------------- vectors


def _vector(k: int) -> list[float]:
    return [((i * 37 + k) % 64 - 31.5) / 148.0 for i in range(64)]


_QUERY_VECTOR = "[" + ", ".join(map(repr, _vector(3))) + "]"
_SCORED = f""", s AS (SELECT media_id, CAST(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])) AS FLOAT) AS score FROM "index")"""
_TOP = "SELECT media_id, round(CAST(score AS DOUBLE), 5) AS score, CAST(row_number() OVER (ORDER BY score DESC, media_id) AS BIGINT) AS rank FROM s"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("media_id", F.round(F.col("score").cast("double"), 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_SCORED + f" {_TOP} QUALIFY rank <= 20")
def vec_topk(t: Tables) -> DataFrame:
    return _rounded(vectors.top_k(t["index"], _vector(3), 20))


@query(_SCORED + f" {_TOP} WHERE media_id IN (SELECT id FROM media WHERE rating >= 3 AND date_taken <> 0 AND date_taken >= 850000000) QUALIFY rank <= 15")
def vec_topk_filtered(t: Tables) -> DataFrame:
    allowed = select_media(t, Q(min_rating=3, date_from=850_000_000)).where("date_taken <> 0")
    return _rounded(vectors.top_k(t["index"], _vector(3), 15, allowed))


@query(
    """, s AS (SELECT x.media_id, CAST(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS FLOAT) AS score FROM "index" x, "index" q WHERE q.media_id = 7 AND x.media_id <> 7) """
    + _TOP
    + " QUALIFY rank <= 10"
)
def vec_similar(t: Tables) -> DataFrame:
    return _rounded(vectors.similar(t["index"], 7, 10))


_CENTROIDS = """, p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM "index"),
    m AS (SELECT label, place, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY label, place), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label),
    c AS (SELECT m.label, place, x / norm AS x FROM m JOIN n ON n.label = m.label)"""


@query(_CENTROIDS + " SELECT label, CAST(place - 1 AS BIGINT) AS place, round(x, 6) AS x FROM c")
def label_centroids(t: Tables) -> DataFrame:
    return vectors.centroids(t["index"]).select("label", F.posexplode("embedding").alias("place", "x")).select("label", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query(
    _SCORED
    + f""", k AS ({_TOP} WHERE media_id IN (SELECT id FROM media WHERE media_type = 'photo' AND rating >= 3 AND date_taken <> 0 AND date_taken <= 850000000) QUALIFY rank <= 15)
    SELECT k.media_id AS id, max(k.score) AS score, max(k.rank) AS rank, coalesce(string_agg(category || '/' || name, ',' ORDER BY category, name, g.id), '') AS tags
    FROM k LEFT JOIN media_tags l ON l.media_id = k.media_id LEFT JOIN tags g ON g.id = l.tag_id GROUP BY k.media_id"""
)
def vec_search(t: Tables) -> DataFrame:
    out = search.semantic_search(t, _vector(3), 15, Q(min_rating=3, date_to=850_000_000))
    return out.select("id", F.round(F.col("score").cast("double"), 5).alias("score"), F.col("rank").cast("long").alias("rank"), F.array_join(F.transform("tags", lambda x: F.concat_ws("/", x["category"], x["name"])), ",").alias("tags"))


@query(
    _CENTROIDS
    + """, v AS (SELECT label, list(x ORDER BY place) AS v FROM c GROUP BY label),
    s AS (SELECT media_id, v.label AS label_id, v.label % 4 AS grp, CAST(list_dot_product(CAST(embedding AS DOUBLE[]), v.v) AS FLOAT) AS score FROM "index" CROSS JOIN v),
    k AS (SELECT *, row_number() OVER (PARTITION BY media_id, grp ORDER BY score DESC, label_id) AS p FROM s WHERE score >= CAST(0.1 AS FLOAT)),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, label_id) AS rank FROM k WHERE p <= 2)
    SELECT media_id, label_id, round(CAST(score AS DOUBLE), 5) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 3"""
)
def smart_labels(t: Tables) -> DataFrame:
    labels = vectors.centroids(t["index"]).select(F.col("label").alias("label_id"), (F.col("label") % 4).alias("label_group"), F.lit(0.1).alias("threshold"), "embedding")
    out = vectors.smart_labels(t["index"], labels, 0.05)
    return out.select("media_id", "label_id", F.round(F.col("score").cast("double"), 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT id FROM media WHERE media_type = 'photo' AND NOT EXISTS (SELECT 1 FROM media s WHERE s.id = media.id AND s.id % 3 <> 0)")
def job_candidates_index(t: Tables) -> DataFrame:
    state = t["media"].where("id % 3 <> 0").select(F.col("id").alias("media_id"), "content_hash")
    return vectors.stale_items(t["media"], state, ["content_hash"]).select("id")


@query("SELECT id FROM media WHERE media_type = 'photo' AND NOT (id % 2 = 0 AND abs((rating + 1e-9) - rating) < 1e-6)")
def job_candidates_faces(t: Tables) -> DataFrame:
    state = t["media"].where("id % 2 = 0").select(F.col("id").alias("media_id"), "content_hash", (F.col("rating") + 1e-9).alias("confidence"))
    return vectors.stale_items(t["media"], state, ["content_hash"], near={"confidence": F.col("rating")}).select("id")


@query("SELECT count(*) AS media, (SELECT count(*) FROM tags) AS tags, (SELECT count(*) FROM albums) AS albums FROM media")
def catalog_totals(t: Tables) -> DataFrame:
    return facets.totals(t)


@query(
    """SELECT count(*) FILTER (id <= (SELECT max(media_id) FROM "index") AND id % 3 <> 0) AS indexed, count(*) FILTER (id <= (SELECT max(media_id) FROM "index") AND id % 6 IN (2, 4)) AS labelled,
    (SELECT count(*) FROM provenance p JOIN media_tags l ON l.media_id = p.media_id AND l.tag_id = p.tag_id JOIN media m ON m.id = p.media_id AND m.media_type = 'photo' WHERE p.source = 'clip') AS assignments
    FROM media WHERE media_type = 'photo'"""
)
def label_status(t: Tables) -> DataFrame:
    seen = t["media"].where("id % 3 <> 0").select(F.col("id").alias("media_id"), "content_hash")
    state = seen.select("media_id", "content_hash", F.when(F.col("media_id") % 2 == 0, "v2").otherwise("v1").alias("taxonomy_version"))
    return facets.label_status(t | {"index": t["index"].select("media_id").join(seen, "media_id")}, state, "v2")


# ---------------------------------------------------------------- faces


_SUGGESTED = """, q AS (SELECT f.id AS face_id, e.person_tag_id AS tag_id, max(least(1, greatest(-1, CAST(list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS FLOAT)))) AS score
      FROM faces f JOIN faces e ON f.person_tag_id IS NULL AND NOT f.dismissed AND e.person_tag_id IS NOT NULL AND NOT e.dismissed GROUP BY 1, 2),
    k AS (SELECT q.*, g.name, row_number() OVER (PARTITION BY face_id ORDER BY score DESC, name, q.tag_id) AS rank FROM q JOIN tags g ON g.id = q.tag_id
      WHERE score >= CAST(0.3 AS FLOAT) AND NOT EXISTS (SELECT 1 FROM face_rejections r WHERE r.face_id = q.face_id AND r.tag_id = q.tag_id))"""


def _suggest(t: Tables) -> DataFrame:
    return faces.suggestions(t["faces"], t["face_rejections"], t["tags"], 64, 0.3)


@query(_SUGGESTED + " SELECT face_id, tag_id, name, round(CAST(score AS DOUBLE), 5) AS score, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 3")
def face_suggestions(t: Tables) -> DataFrame:
    return _suggest(t).select("face_id", "tag_id", "name", F.round(F.col("score").cast("double"), 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    _SUGGESTED
    + """, f AS (SELECT f.*, top, CASE WHEN dismissed THEN 'dismissed' WHEN coalesce(person_tag_id, top) IS NOT NULL THEN 'person' ELSE 'unnamed' END AS type,
      NOT dismissed AND person_tag_id IS NULL AND top IS NOT NULL AS suggested FROM faces f LEFT JOIN (SELECT face_id, tag_id AS top FROM k WHERE rank = 1) ON face_id = f.id),
    g AS (SELECT type, CASE WHEN type = 'person' THEN coalesce(person_tag_id, top) END AS tag_id, count(*) AS faces, count(DISTINCT media_id) AS photos, count(*) FILTER (suggested) AS suggested_faces,
      count(DISTINCT CASE WHEN suggested THEN media_id END) AS suggested_photos FROM f GROUP BY 1, 2)
    SELECT type, tag_id, coalesce(name, '') AS name, faces, photos, suggested_faces, suggested_photos,
      CAST(row_number() OVER (ORDER BY CASE type WHEN 'person' THEN 0 WHEN 'unnamed' THEN 1 ELSE 2 END, coalesce(name, ''), coalesce(tag_id, 0)) AS BIGINT) AS rank FROM g LEFT JOIN tags ON id = tag_id"""
)
def face_groups(t: Tables) -> DataFrame:
    return faces.face_groups(t["faces"], _suggest(t), t["tags"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    _SUGGESTED
    + """, n AS (SELECT face_id, tag_id, name, score, row_number() OVER (PARTITION BY face_id ORDER BY score DESC, name, tag_id) AS place FROM k WHERE rank > 1)
    SELECT face_id, tag_id, name, round(CAST(score AS DOUBLE), 5) AS score, CAST(place AS BIGINT) AS rank FROM n WHERE place <= 3"""
)
def face_promoted(t: Tables) -> DataFrame:
    """Suggestions after everybody's first one is rejected."""
    known = t["faces"], t["face_rejections"], t["tags"], 64
    state = checkpointed(decisions.rankings(*known, 0.3))
    refused = t["face_rejections"].unionByName(state.where("rank = 1").select("face_id", "tag_id"))
    out = decisions.updated_rankings(state, t["faces"], refused, t["tags"], 64, t["faces"].where("false").select("id"), 0.3)
    return out.where("rank <= 3").select("face_id", "tag_id", "name", F.round(F.col("score").cast("double"), 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def face_accepts(t: Tables) -> DataFrame:
    """Two requests for each unnamed face, taken in sequence."""
    known = t["faces"].withColumns({"revision": F.lit(1).cast("long"), "recognizer": F.when(F.col("id") % 5 == 0, "b").otherwise("a")})
    labels = t["index"].select(F.col("media_id").alias("id"), F.col("label").cast("long").alias("label"))
    asked = known.where("person_tag_id is null").select("id", "revision").join(labels, "id").select("*", F.explode(F.array(F.lit(0), F.lit(3))).alias("k"))
    asked = asked.select((F.col("id") * 4 + F.col("k")).alias("seq"), F.col("id").alias("face_id"), (4000 + (F.col("label") + F.col("k")) % 10).alias("tag_id"), "revision")
    return decisions.accept_in_order(known, asked, t["face_rejections"], t["tags"], 64, 0.3, ["recognizer"])


@query("SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'done' END ELSE 'unscanned' END AS state FROM media WHERE media_type = 'photo'")
def face_states(t: Tables) -> DataFrame:
    analysis = t["media"].where("id % 2 = 0").select(F.col("id").alias("media_id"), F.when(F.col("id") % 3 == 0, "failed").otherwise("done").alias("state"))
    return review.analysis_states(t["media"], analysis)


@query("SELECT id FROM faces WHERE media_id IN (SELECT id FROM media WHERE rating >= 3) ORDER BY id LIMIT 200 OFFSET 20")
def face_page(t: Tables) -> DataFrame:
    job = t["media"].where("rating >= 3").select(F.lit(1).alias("job_id"), F.col("id").alias("media_id"))
    return review.page_of(review.in_job(t["faces"], job, 1, "media_id"), 5000, 20, review.REVIEW_PAGE).select("id")


@query(
    _PAIRS
    + f""", x AS (SELECT a AS face_id, b % 10 AS tag_id, b AS example_id, score FROM e WHERE score >= CAST({LOOSE} AS FLOAT)),
    r AS (SELECT *, row_number() OVER (PARTITION BY face_id, tag_id ORDER BY score DESC, example_id) AS place FROM x),
    p AS (SELECT face_id, tag_id, max(score) FILTER (place = 1) AS score, max(example_id) FILTER (place = 1) AS example_id, max(example_id) FILTER (place = 2) AS second_id FROM r GROUP BY face_id, tag_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY score DESC, tag_id) AS rank FROM p)
    SELECT face_id, tag_id, example_id, second_id, CAST(rank AS BIGINT) AS rank, (SELECT max(o.tag_id) FROM k o WHERE o.face_id = k.face_id AND o.rank = 5) IS NOT NULL AS omitted FROM k WHERE rank <= 4"""
)
def face_examples(t: Tables) -> DataFrame:
    scores = checkpointed(vectors.best_pairs(t["index"], LOOSE, F.col("media_id") % 10, 2))  # read more than once
    return review.best_examples(scores).select("face_id", "tag_id", "example_id", "second_id", F.col("rank").cast("long").alias("rank"), F.col("omitted").isNotNull().alias("omitted"))


# ---------------------------------------------------------------- events


_BY_USER = """, o AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), l AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) AS gap FROM o),
    g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec RANGE UNBOUNDED PRECEDING) AS k FROM l)"""


@query(_BY_USER + " SELECT user_id, min(sec) AS island, count(*) AS n, max(sec) AS last FROM g GROUP BY user_id, k")
def event_sessions(t: Tables) -> DataFrame:
    rows = t["events"].select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return events.islands(rows, "at", keys=("user_id",)).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("at").alias("last"))


@query(
    """, l AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 4 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM l)
    SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM g GROUP BY user_id, k"""
)
def event_windows(t: Tables) -> DataFrame:
    return ingest.sessions(t["events"]).select("user_id", "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


_EVENTS = """, f AS (SELECT id, date_taken, latitude, longitude, has_gps AS located FROM media WHERE media_type = 'photo' AND date_taken <> 0),
    l AS (SELECT *, date_taken - lag(date_taken) OVER (ORDER BY date_taken, id) AS gap FROM f), i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 14400 THEN 1 ELSE 0 END) OVER (ORDER BY date_taken, id) AS island FROM l),
    s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY island ORDER BY date_taken, id) AS pos FROM i),
    w AS (SELECT island, pos, id, id AS event, date_taken AS began, CASE WHEN located THEN latitude END AS la, CASE WHEN located THEN longitude END AS lo FROM s WHERE pos = 1
      UNION ALL SELECT island, pos, id, CASE WHEN cut THEN id ELSE event END, CASE WHEN cut THEN date_taken ELSE began END, CASE WHEN located THEN latitude WHEN NOT cut THEN la END, CASE WHEN located THEN longitude WHEN NOT cut THEN lo END
      FROM (SELECT s.*, w.event, w.began, w.la, w.lo, s.date_taken - w.began > 43200 OR coalesce(s.located AND w.la IS NOT NULL AND 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.latitude - w.la) / 2), 2)
        + cos(radians(w.la)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - w.lo) / 2), 2)))) > 25, false) AS cut FROM w JOIN s ON s.island = w.island AND s.pos = w.pos + 1))"""


@query(_EVENTS + " SELECT id, event FROM w")
def event_groups(t: Tables) -> DataFrame:
    return events.event_members(t["media"])


@query(
    _EVENTS
    + r""", mm AS MATERIALIZED (SELECT w.id, w.event, m.date_taken, trim(m.caption, chr(9) || chr(10) || chr(13) || ' ') AS caption, coalesce(list_extract(string_split(replace(m.file_path, '\', '/'), '/'), -2), '') AS folder FROM w JOIN media m ON m.id = w.id),
    z AS (SELECT event, count(*) AS n, min(date_taken) AS start_date, max(date_taken) AS end_date FROM mm GROUP BY event),
    k AS (SELECT mm.event, lower(t.category) AS cat, t.name FROM mm JOIN media_tags l ON l.media_id = mm.id JOIN tags t ON t.id = l.tag_id JOIN z ON z.event = mm.event
      WHERE NOT (t.name = 'Last Imported' AND t.category = 'keyword') GROUP BY mm.event, lower(t.category), t.id, t.name HAVING count(DISTINCT mm.id) = any_value(z.n)),
    n AS (SELECT event, min(name) FILTER (cat = 'events') AS tag, min(name) FILTER (cat = 'places') AS place, string_agg(DISTINCT name, '|' ORDER BY name) FILTER (cat = 'people') AS people,
      string_agg(DISTINCT name, '|' ORDER BY name) FILTER (cat = 'places') AS places, string_agg(DISTINCT name, '|' ORDER BY name) FILTER (cat = 'keyword') AS keywords FROM k GROUP BY event),
    c AS (SELECT mm.event, mm.caption FROM mm JOIN z ON z.event = mm.event WHERE mm.caption <> '' GROUP BY mm.event, mm.caption HAVING count(*) > floor(any_value(z.n) / 2)),
    d AS (SELECT event, min(folder) AS folder FROM mm GROUP BY event HAVING min(folder) = max(folder) AND NOT (trim(min(folder)) = '' OR lower(trim(min(folder))) IN ('dcim', 'camera', 'pictures', 'photos', 'images')
      OR regexp_full_match(trim(min(folder)), '[0-9]+') OR (length(trim(min(folder))) BETWEEN 4 AND 12 AND regexp_full_match(trim(min(folder)), '[0-9]{3}[0-9A-Za-z_]+'))))
    SELECT z.event, z.n, z.start_date, z.end_date, CASE WHEN n.tag IS NOT NULL THEN 'event' WHEN c.caption IS NOT NULL THEN 'caption' WHEN n.place IS NOT NULL THEN 'place' WHEN d.folder IS NOT NULL THEN 'folder' ELSE 'date' END AS name_source,
      coalesce(n.tag, c.caption, n.place, d.folder, '') AS name, coalesce(n.people, '') AS people, coalesce(n.places, '') AS places, coalesce(n.keywords, '') AS keywords
    FROM z LEFT JOIN n ON n.event = z.event LEFT JOIN c ON c.event = z.event LEFT JOIN d ON d.event = z.event"""
)
def event_names(t: Tables) -> DataFrame:
    out = events.event_summaries(t["media"], t)
    return out.select(*out.columns[:6], *(F.array_join(c, "|").alias(c) for c in ("people", "places", "keywords")))


@query("SELECT id, CASE WHEN media_type <> 'photo' THEN 'not_photo' ELSE 'invalid_date' END AS reason FROM media WHERE media_type <> 'photo' OR date_taken = 0")
def event_skipped(t: Tables) -> DataFrame:
    return events.skipped(t["media"])


# ---------------------------------------------------------------- places


_NEAREST = """, d AS (SELECT DISTINCT latitude, longitude FROM media WHERE has_gps AND abs(latitude) <= 90 AND abs(longitude) <= 180),
    h AS (SELECT d.latitude, d.longitude, row_no, name, admin1, country, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(g.latitude - d.latitude) / 2), 2) + cos(radians(d.latitude)) * cos(radians(g.latitude)) * pow(sin(radians(g.longitude - d.longitude) / 2), 2)))) AS km
      FROM d CROSS JOIN gazetteer g), n AS (SELECT * FROM h WHERE km <= 800 QUALIFY row_number() OVER (PARTITION BY latitude, longitude ORDER BY km, row_no) = 1)"""


@query(_NEAREST + " SELECT latitude, longitude, row_no, round(km, 4) AS km FROM n")
def geo_nearest(t: Tables) -> DataFrame:
    return geo.nearest_places(t["media"].where(S.is_located()), t["gazetteer"], 800.0).withColumn("km", F.round("km", 4))


@query(_NEAREST.replace("km <= 800", "km <= 100") + " SELECT latitude, longitude, row_no, round(km, 4) AS km FROM n")
def geo_nearest_default(t: Tables) -> DataFrame:
    return geo.nearest_places(t["media"].where(S.is_located()), t["gazetteer"]).withColumn("km", F.round("km", 4))


@query(
    _NEAREST
    + """, m AS (SELECT row_no, name, country FROM media LEFT JOIN n USING (latitude, longitude) WHERE has_gps AND media_type = 'photo')
    SELECT 'located' AS kind, '' AS name, count(*) AS photos FROM m UNION ALL SELECT 'matched', '', count(*) FROM m WHERE row_no IS NOT NULL
    UNION ALL (SELECT 'city', name, count(*) AS k FROM m WHERE name <> '' GROUP BY name ORDER BY k DESC, name LIMIT 10) UNION ALL (SELECT 'country', country, count(*) AS k FROM m WHERE country <> '' GROUP BY country ORDER BY k DESC, country LIMIT 10)"""
)
def geo_report(t: Tables) -> DataFrame:
    return geo.place_report(t["media"], t["gazetteer"], 800.0)


@query(_NEAREST + " SELECT DISTINCT m.id AS media_id, u.name FROM media m JOIN n ON n.latitude = m.latitude AND n.longitude = m.longitude, unnest([n.name, n.admin1, n.country]) AS u(name) WHERE m.has_gps AND u.name <> ''")
def geo_place_tags(t: Tables) -> DataFrame:
    return geo.place_names(t["media"], t["gazetteer"], 800.0)


@query(
    """, x AS (SELECT id, CAST(floor((longitude + 180) / 360 * 2048 / 50) AS BIGINT) AS cx,
      CAST(floor((1 - ln(tan(radians(least(85.05112878, greatest(-85.05112878, latitude)))) + 1 / cos(radians(least(85.05112878, greatest(-85.05112878, latitude))))) / pi()) / 2 * 2048 / 50) AS BIGINT) AS cy FROM media WHERE has_gps)
    SELECT cx, cy, count(*) AS n, max(id) AS cover_id FROM x GROUP BY cx, cy"""
)
def map_grid(t: Tables) -> DataFrame:
    return geo.map_grid(t["media"], 3).select("cx", "cy", "n", "cover_id")


@query()
def map_clusters(t: Tables) -> DataFrame:
    return geo.map_clusters(t["media"], 3)


# ---------------------------------------------------------------- updates


@query("SELECT a.id, max(CASE WHEN m.media_type = 'photo' THEN l.media_id END) AS cover_media_id FROM albums a LEFT JOIN album_media l ON l.album_id = a.id AND l.media_id % 3 = 0 LEFT JOIN media m ON m.id = l.media_id GROUP BY a.id")
def mut_album_cover(t: Tables) -> DataFrame:
    covers = t["media"].where("id % 3 = 0").select(F.col("id").alias("media_id")).join(t["album_media"].select("album_id", "media_id"), "media_id")
    return mutations.set_cover(t["albums"], t["album_media"], t["media"], covers).select("id", "cover_media_id")


@query("SELECT id, has_gps OR id % 15 = 0 AS has_gps, CASE WHEN id % 15 = 0 THEN 10.5 ELSE latitude END AS latitude, CASE WHEN id % 15 = 0 THEN CAST(id % 100 AS DOUBLE) ELSE longitude END AS longitude FROM media")
def mut_set_location(t: Tables) -> DataFrame:
    places = t["media"].where("id % 15 = 0").select("id", F.lit(10.5).alias("latitude"), (F.col("id") % 100).cast("double").alias("longitude"))
    return mutations.set_location(t, places, t["gazetteer"], 800.0)["media"].select("id", "has_gps", "latitude", "longitude")


@query("SELECT media_id, tag_id FROM media_tags UNION SELECT id, 5000 FROM media WHERE id % 10 = 0")
def mut_add_tag(t: Tables) -> DataFrame:
    return mutations.add_tag(t, t["media"].where("id % 10 = 0"), 5000)["media_tags"]


@query(
    """SELECT media_id, tag_id, true AS manual, 'manual' AS source FROM (SELECT id AS media_id, CAST(2004 AS BIGINT) AS tag_id FROM media WHERE id % 10 = 0)
    UNION ALL SELECT media_id, tag_id, manual, source FROM provenance WHERE NOT (tag_id = 2004 AND media_id % 10 = 0)"""
)
def mut_add_tag_origin(t: Tables) -> DataFrame:
    return mutations.add_tag(t, t["media"].where("id % 10 = 0"), 2004)["provenance"]


@query("SELECT media_id, tag_id FROM media_tags WHERE NOT (tag_id = 4003 AND media_id % 2 = 0)")
def mut_remove_tag(t: Tables) -> DataFrame:
    return mutations.remove_tag(t, t["media"].where("id % 2 = 0"), 4003)["media_tags"]


@query("SELECT id, CASE WHEN person_tag_id = 4003 AND media_id % 2 = 0 AND EXISTS (SELECT 1 FROM media_tags l WHERE l.media_id = faces.media_id AND l.tag_id = 4003) THEN NULL ELSE person_tag_id END AS person_tag_id FROM faces")
def mut_remove_person(t: Tables) -> DataFrame:
    return mutations.remove_tag(t, t["media"].where("id % 2 = 0"), 4003)["faces"].select("id", "person_tag_id")


@query("SELECT media_id, tag_id FROM media_tags WHERE tag_id <> 1 UNION ALL SELECT id, 1 FROM media WHERE id % 41 = 0")
def mut_replace_tag(t: Tables) -> DataFrame:
    return mutations.replace_members(t["media_tags"], 1, t["media"].where("id % 41 = 0"))


@query(
    """, old AS (SELECT media_id, tag_id FROM provenance WHERE source = 'clip' AND NOT manual AND media_id % 2 = 0), kept AS (SELECT media_id, tag_id FROM media_tags EXCEPT SELECT * FROM old)
    SELECT * FROM kept UNION SELECT id, CAST(1001 AS BIGINT) FROM media WHERE id % 4 = 0"""
)
def mut_replace_smart_tags(t: Tables) -> DataFrame:
    new = t["media"].where("id % 4 = 0").select(F.col("id").alias("media_id"), F.lit(1001).cast("long").alias("tag_id"))
    return mutations.replace_smart_tags(t, t["media"].where("id % 2 = 0"), new)["media_tags"]


def _merge_pairs(t: Tables) -> DataFrame:
    return t["media"].where("id % 3 = 0").select((F.col("id") - 1).alias("keeper"), "id")


@query(
    """SELECT k.id, CASE WHEN k.caption = '' AND c.caption <> '' THEN c.caption ELSE k.caption END AS caption, CASE WHEN k.flag = 0 AND c.flag <> 0 THEN c.flag ELSE k.flag END AS flag,
    CASE WHEN k.date_taken = 0 AND c.date_taken <> 0 THEN c.date_taken ELSE k.date_taken END AS date_taken, k.has_gps OR coalesce(c.has_gps, false) AS has_gps,
    CASE WHEN NOT k.has_gps AND c.has_gps THEN c.latitude ELSE k.latitude END AS latitude FROM media k LEFT JOIN media c ON c.id = k.id + 1 AND c.id % 3 = 0 WHERE k.id % 3 <> 0"""
)
def mut_merge(t: Tables) -> DataFrame:
    return mutations.merge_media(t, _merge_pairs(t))["media"].select("id", "caption", "flag", "date_taken", "has_gps", "latitude")


@query("SELECT DISTINCT CASE WHEN media_id % 3 = 0 THEN media_id - 1 ELSE media_id END AS media_id, tag_id FROM media_tags")
def mut_merge_links(t: Tables) -> DataFrame:
    return mutations.merge_media(t, _merge_pairs(t), link_parts(t))["media_tags"]


@query(
    """, p AS (SELECT album_id, position, media_id AS was, media_id % 3 <> 0 AS own, CASE WHEN media_id % 3 = 0 THEN media_id - 1 ELSE media_id END AS media_id FROM album_media),
    n AS (SELECT *, row_number() OVER (PARTITION BY album_id, media_id ORDER BY own DESC, position, was) AS k FROM p), s AS (SELECT DISTINCT album_id FROM n WHERE k > 1)
    SELECT album_id, media_id, CASE WHEN album_id IN (SELECT album_id FROM s) THEN CAST(row_number() OVER (PARTITION BY album_id ORDER BY position, media_id) - 1 AS INT) ELSE position END AS position FROM n WHERE k = 1"""
)
def mut_merge_albums(t: Tables) -> DataFrame:
    return mutations.merge_media(t, _merge_pairs(t))["album_media"]


@query("SELECT album_id, media_id, CAST(row_number() OVER (PARTITION BY album_id ORDER BY position, media_id) - 1 AS INT) AS position FROM album_media")
def mut_reorder(t: Tables) -> DataFrame:
    return mutations.compact(t["album_media"])


@query("SELECT 'links' AS kind, media_id AS a, tag_id AS b FROM media_tags WHERE media_id % 5 <> 0 UNION ALL SELECT 'albums', media_id, album_id FROM album_media WHERE media_id % 5 <> 0 UNION ALL SELECT 'pairs', media_id_a, media_id_b FROM dismissals WHERE media_id_a % 5 <> 0 AND media_id_b % 5 <> 0")
def mut_delete_cascade(t: Tables) -> DataFrame:
    out = mutations.delete_media(t, t["media"].where("id % 5 = 0"))
    parts = (("links", "media_tags", "media_id", "tag_id"), ("albums", "album_media", "media_id", "album_id"), ("pairs", "dismissals", "media_id_a", "media_id_b"))
    one, two, three = (out[name].select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")) for kind, name, a, b in parts)
    return one.unionByName(two).unionByName(three)


@query("SELECT id, CASE WHEN person_tag_id = 4003 THEN NULL ELSE person_tag_id END AS person_tag_id FROM faces")
def mut_delete_tag(t: Tables) -> DataFrame:
    return mutations.delete_tag(t, 4003)["faces"].select("id", "person_tag_id")


@query("SELECT id, file_path, CASE WHEN starts_with(file_path, '/photos/') THEN substring(file_path, 9) ELSE file_path END AS new_path FROM media")
def mut_relativise(t: Tables) -> DataFrame:
    return mutations.relativise(t["media"], "/photos").select("id", "file_path", "new_path")


@query("SELECT id FROM media WHERE id % 6 = 0 AND rating <> 3")
def mut_import_conflicts(t: Tables) -> DataFrame:
    rows = t["media"].where("id % 6 = 0").select("id", F.lit("new").alias("caption"), F.col("file_size").alias("was_file_size"), F.lit(3).alias("was_rating"))
    return mutations.import_rows(t["media"], rows)[1].select("id")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 5 ELSE rating END AS rating, CASE WHEN id % 7 = 0 THEN 'new' ELSE caption END AS caption FROM media")
def mut_update(t: Tables) -> DataFrame:
    changes = t["media"].where("id % 7 = 0").select("id", F.lit(5).alias("rating"), F.lit("new").alias("caption"))
    return mutations.update_fields(t["media"], changes)[0].select("id", "rating", "caption")


@query("SELECT id, CASE WHEN id % 2 = 0 AND date_taken <> 0 THEN date_taken - 60 ELSE date_taken END AS date_taken FROM media")
def mut_shift_dates(t: Tables) -> DataFrame:
    return mutations.shift_dates(t["media"], t["media"].where("id % 2 = 0"), -60).select("id", "date_taken")


@query(
    """, l AS MATERIALIZED (SELECT * FROM media_tags), p AS MATERIALIZED (SELECT media_id, tag_id FROM provenance WHERE NOT manual AND source IN ('face', 'clip') AND media_id % 9 = 0)
    SELECT media_id, tag_id FROM l ANTI JOIN p USING (media_id, tag_id)"""
)
def mut_invalidate(t: Tables) -> DataFrame:
    updated = t["media"].withColumn("width", F.when(F.col("id") % 9 == 0, F.col("width") + 1).otherwise(F.col("width")))
    return mutations.invalidate(t, updated)["media_tags"]


@query(
    """, l AS MATERIALIZED (SELECT * FROM media_tags), f AS MATERIALIZED (SELECT DISTINCT media_id, person_tag_id AS tag_id FROM faces WHERE NOT dismissed AND person_tag_id IS NOT NULL),
    p AS MATERIALIZED (SELECT media_id, tag_id FROM (SELECT media_id, tag_id FROM provenance WHERE NOT manual AND source = 'face') ANTI JOIN f USING (media_id, tag_id))
    SELECT media_id, tag_id FROM l ANTI JOIN p USING (media_id, tag_id)"""
)
def mut_sync_people(t: Tables) -> DataFrame:
    return mutations.sync_people(t)["media_tags"]


@query(
    _NEAREST
    + """, w AS (SELECT DISTINCT m.id AS media_id, u.name FROM media m JOIN n ON n.latitude = m.latitude AND n.longitude = m.longitude, unnest([n.name, n.admin1, n.country]) AS u(name) WHERE m.has_gps AND u.name <> ''),
    named AS (SELECT l.media_id, g.name, g.category, p.source, p.manual FROM media_tags l JOIN tags g ON g.id = l.tag_id LEFT JOIN provenance p ON p.media_id = l.media_id AND p.tag_id = l.tag_id)
    SELECT media_id, name, category FROM named WHERE NOT (coalesce(source, '') = 'gps' AND NOT manual AND NOT EXISTS (SELECT 1 FROM w WHERE w.media_id = named.media_id AND w.name = named.name AND named.category = 'places'))
    UNION SELECT media_id, name, 'places' FROM w"""
)
def mut_place_tags(t: Tables) -> DataFrame:
    out = mutations.set_place_tags(t, t["media"], geo.place_names(t["media"], t["gazetteer"], 800.0))
    tags = out["tags"].withColumnRenamed("id", "tag_id")
    return out["media_tags"].join(tags, "tag_id").select("media_id", "name", "category")


_INCOMING = """, i AS (SELECT id // 100 AS batch, id, CASE WHEN id % 100 = 11 AND id // 100 % 5 = 0 THEN file_path WHEN id % 100 = 7 AND id // 100 % 3 = 1 THEN 'in/' || CAST(id - 100 AS STRING) ELSE 'in/' || CAST(id AS STRING) END AS file_path FROM media),
    k AS (SELECT DISTINCT batch FROM i WHERE NOT starts_with(file_path, 'in/')), c AS (SELECT DISTINCT b.batch FROM i b JOIN i a ON a.file_path = b.file_path AND a.batch = b.batch - 1 WHERE a.batch NOT IN (FROM k)),
    good AS (SELECT * FROM i WHERE batch NOT IN (FROM k) AND batch NOT IN (FROM c))"""


def _incoming(t: Tables) -> DataFrame:
    batch, at = F.expr("id div 100"), F.col("id") % 100
    old = F.when((at == 11) & (batch % 5 == 0), F.col("file_path")).when((at == 7) & (batch % 3 == 1), F.concat(F.lit("in/"), (F.col("id") - 100).cast("string")))
    return t["media"].select(batch.alias("batch"), F.col("id").alias("was"), F.coalesce(old, F.concat(F.lit("in/"), F.col("id").cast("string"))).alias("file_path"), "rating")


@query(
    _INCOMING
    + """ SELECT (SELECT max(id) FROM media) + row_number() OVER (ORDER BY batch, id) AS id, file_path, CAST(1700000000 AS BIGINT) AS created_at, CAST(1700000000 AS BIGINT) AS updated_at FROM good
    UNION ALL SELECT id, file_path, created_at, created_at FROM media"""
)
def write_insert(t: Tables) -> DataFrame:
    return writes.insert_batches(t["media"], _incoming(t), 1_700_000_000, "was")[0].select("id", "file_path", "created_at", "updated_at")


@query(_INCOMING + " SELECT batch, count(*) AS n FROM i WHERE batch IN (FROM k) OR batch IN (FROM c) GROUP BY batch")
def write_insert_refused(t: Tables) -> DataFrame:
    return writes.insert_batches(t["media"], _incoming(t), 1_700_000_000, "was")[1].groupBy("batch").agg(F.count("*").alias("n"))


@query(
    """, bad AS (SELECT DISTINCT id // 50 AS batch FROM media WHERE id % 50 = 3 AND rating = 3)
    SELECT id, CASE WHEN hit THEN 5 ELSE rating END AS rating, CASE WHEN hit THEN 'new' ELSE caption END AS caption, CASE WHEN hit THEN CAST(1700000000 AS BIGINT) ELSE created_at END AS updated_at
    FROM (SELECT *, id % 2 = 1 AND id // 50 NOT IN (FROM bad) AS hit FROM media)"""
)
def write_update(t: Tables) -> DataFrame:
    """Batches of 50 ids; one whose fourth row had another rating when the writer saw it is refused."""
    rows = t["media"].where("id % 2 = 1").select(F.expr("id div 50").alias("batch"), "id", F.lit(5).alias("rating"), F.lit("new").alias("caption"), F.expr("CASE WHEN id % 50 = 3 AND rating = 3 THEN 1 ELSE rating END").alias("was_rating"), F.col("file_path").alias("was_file_path"))
    seen = t["media"].withColumn("updated_at", F.col("created_at"))
    return writes.update_batches(seen, rows, 1_700_000_000)[0].select("id", "rating", "caption", "updated_at")


@query("SELECT 'albums' AS kind, id AS a, CAST(0 AS BIGINT) AS b FROM albums WHERE id % 3 <> 0 UNION ALL SELECT 'members', album_id, media_id FROM album_media WHERE album_id % 3 <> 0 UNION ALL SELECT 'missing', (SELECT max(id) + 1 FROM albums), 0")
def mut_delete_albums(t: Tables) -> DataFrame:
    ids = t["albums"].where("id % 3 = 0").select("id").unionByName(t["albums"].agg((F.max("id") + 1).alias("id")))
    left, members, missing = writes.delete_albums(t["albums"], t["album_media"], ids)
    rows = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), b.cast("long").alias("b"))
    return rows(left, "albums", "id", F.lit(0)).unionByName(rows(members, "members", "album_id", F.col("media_id"))).unionByName(rows(missing, "missing", "id", F.lit(0)))


@query(
    """, w AS (SELECT DISTINCT CASE id % 4 WHEN 0 THEN file_path WHEN 1 THEN '/srv/' || file_path WHEN 2 THEN replace(file_path, '/', chr(92)) ELSE file_path || '?' END AS path FROM media),
    f AS (SELECT path, 0 AS tried, path AS file_path FROM w UNION ALL SELECT path, 1, replace(substring(path, 6), chr(92), '/') FROM w WHERE starts_with(path, '/srv/') UNION ALL SELECT path, 2, replace(path, chr(92), '/') FROM w)
    SELECT path, m.id, CAST(tried AS BIGINT) AS tried FROM f JOIN media m USING (file_path) QUALIFY row_number() OVER (PARTITION BY path ORDER BY tried, m.id) = 1"""
)
def path_lookup(t: Tables) -> DataFrame:
    known = F.expr("CASE id % 4 WHEN 0 THEN file_path WHEN 1 THEN concat('/srv/', file_path) WHEN 2 THEN replace(file_path, '/', chr(92)) ELSE concat(file_path, '?') END")
    out = lookup.by_path(t["media"], t["media"].select(known.alias("path")), "/srv")
    return out.withColumn("tried", F.col("tried").cast("long"))


_MODEL = {"model_id": "m", "model_revision": "1", "taxonomy_version": "t2"}


def _label_tables(t: Tables) -> Tables:
    """A third of the photos was labelled already, some of them with an older taxonomy; of each
    eleventh the vector is of another content, and each thirteenth rejects a label."""
    content = t["media"].select(F.col("id").alias("media_id"), "content_hash", "media_type")
    both = [F.lit("m").alias("model_id"), F.lit("1").alias("model_revision")]
    index = t["index"].join(content, "media_id").where("media_type = 'photo'").select("media_id", F.expr("CASE WHEN media_id % 11 = 0 THEN 'old' ELSE content_hash END").alias("content_hash"), *both, F.lit("").alias("error_text"), "embedding")
    state = content.where("media_id % 3 = 0").select("media_id", "content_hash", *both, F.expr("CASE WHEN media_id % 2 = 0 THEN 't1' ELSE 't2' END").alias("taxonomy_version"), F.lit(7).cast("long").alias("label_count"), F.lit(1).cast("long").alias("updated_at"))
    rejections = content.where("media_id % 13 = 0").select("media_id", F.lit(1011).cast("long").alias("tag_id"))
    return t | {"index_state": index, "smart_tag_state": state, "smart_tag_rejections": rejections}


def _label_job(t: Tables) -> tuple[Tables, DataFrame]:
    """The job over every catalog id and one that is unknown; each seventeenth photo changes before the write."""
    t = _label_tables(t)
    labels = vectors.centroids(t["index"]).select(F.col("label").alias("label_id"), (F.col("label") % 4).alias("label_group"), F.lit(0.1).alias("threshold"), "embedding", F.expr("CASE WHEN label = 0 THEN 'Brand#11' ELSE concat('Label ', CAST(label AS STRING)) END").alias("name"))
    ids = t["media"].select("id").unionByName(t["media"].agg((F.max("id") + 1).alias("id")))
    records, left = jobs.plan_labels(t, ids, labels, _MODEL, min_score=0.05)
    records = checkpointed(records.withColumn("content_hash", F.expr("CASE WHEN media_id % 17 = 0 THEN concat(content_hash, '-') ELSE content_hash END")))
    out, written = jobs.write_labels(t, records, _MODEL, 1_700_000_000)
    return out, left.unionByName(written)


_JOB = (
    _CENTROIDS
    + """, v AS (SELECT label, list(x ORDER BY place) AS v FROM c GROUP BY label), due AS MATERIALIZED (SELECT m.id AS media_id, embedding, content_hash FROM "index" i JOIN media m ON m.id = i.media_id WHERE media_type = 'photo' AND m.id % 11 <> 0 AND NOT (m.id % 3 = 0 AND m.id % 2 = 1)),
    ok AS MATERIALIZED (SELECT * FROM due WHERE media_id % 17 <> 0),
    s AS (SELECT media_id, v.label AS label_id, v.label % 4 AS grp, CAST(list_dot_product(CAST(embedding AS DOUBLE[]), v.v) AS FLOAT) AS score FROM ok CROSS JOIN v),
    k AS (SELECT *, row_number() OVER (PARTITION BY media_id, grp ORDER BY score DESC, label_id) AS p FROM s WHERE score >= CAST(0.1 AS FLOAT)),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, label_id) AS rank FROM k WHERE p <= 2),
    l AS (SELECT media_id, CASE WHEN label_id = 0 THEN 'Brand#11' ELSE 'Label ' || CAST(label_id AS STRING) END AS name FROM r WHERE rank <= 3),
    j AS MATERIALIZED (SELECT media_id, name FROM l WHERE NOT (media_id % 13 = 0 AND name = 'Brand#11' AND EXISTS (SELECT 1 FROM tags WHERE name = 'Brand#11')))"""
)


@query(
    _JOB
    + """ SELECT media_id, 't2' AS taxonomy_version, (SELECT count(*) FROM j WHERE j.media_id = ok.media_id) AS label_count, CAST(1700000000 AS BIGINT) AS updated_at FROM ok
    UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 't1' ELSE 't2' END, 7, 1 FROM media WHERE id % 3 = 0 AND id NOT IN (SELECT media_id FROM ok)"""
)
def label_job_state(t: Tables) -> DataFrame:
    return _label_job(t)[0]["smart_tag_state"].select("media_id", "taxonomy_version", "label_count", "updated_at")


@query(
    _JOB
    + """, old AS MATERIALIZED (SELECT p.media_id, p.tag_id FROM provenance p SEMI JOIN ok ON ok.media_id = p.media_id WHERE source = 'clip' AND NOT manual)
    SELECT l.media_id, g.category, g.name FROM media_tags l JOIN tags g ON g.id = l.tag_id ANTI JOIN old ON old.media_id = l.media_id AND old.tag_id = l.tag_id UNION SELECT media_id, 'keyword', name FROM j"""
)
def label_job_links(t: Tables) -> DataFrame:
    out = _label_job(t)[0]
    return out["media_tags"].join(out["tags"].select(F.col("id").alias("tag_id"), "name", "category"), "tag_id").select("media_id", "category", "name")


@query(_JOB + " SELECT (SELECT count(*) FROM ok) AS processed, (SELECT count(*) FROM media) - (SELECT count(*) FROM ok) AS skipped, CAST(1 AS BIGINT) AS failed, CASE WHEN (SELECT count(*) FROM ok) = 0 THEN 'failed' ELSE 'completed' END AS state")
def label_job_report(t: Tables) -> DataFrame:
    return jobs.job_report(_label_job(t)[1])


@query("SELECT page_id, regexp_extract(url, '^(.+)/[^/]*$', 1) AS folder FROM pages")
def page_folders(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", S.parent_folder("url").alias("folder"))


# ---------------------------------------------------------------- registry


def _bound(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(catalog(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"{with_clause()}\n{text}" for name, text in _SQL.items()}
