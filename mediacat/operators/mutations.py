"""Catalog updates: each takes tables and a command and returns the tables that change.

State is immutable. A caller writes the returned tables to a fresh place and switches to
them; nothing here overwrites its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.scalars import base_name, relative_to
from mediacat.operators.geo import MAX_KM, place_names
from mediacat.operators.tables import by_link

Tables = dict[str, DataFrame]
LINK = ["media_id", "tag_id"]
DERIVED = ["content_hash", "width", "height", "orientation", "media_type"]
#: What an import expects to find unchanged, beside the id.
SNAPSHOT = ["file_path", "file_size", "file_modified_time", "content_hash", "rating", "flag", "caption", "date_taken", "has_gps", "latitude", "longitude", "media_type"]


def update_fields(media: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media with the non-null columns of ``changes`` (by id), and the ids that don't exist."""
    new = changes.select("id", *(F.col(c).alias(f"new_{c}") for c in changes.columns if c != "id"))
    out = media.join(new, "id", "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in changes.columns and c != "id" else F.col(c) for c in media.columns))
    return out, changes.join(media, "id", "left_anti").select("id")


def shift_dates(media: DataFrame, ids: DataFrame, seconds: int) -> DataFrame:
    """Dates of the items moved; undated ones stay undated."""
    hit = ids.select("id", F.lit(True).alias("hit")).distinct()
    moved = F.when(F.col("hit") & (F.col("date_taken") != 0), F.col("date_taken") + seconds).otherwise(F.col("date_taken"))
    return media.join(hit, "id", "left").withColumn("date_taken", moved).select(media.columns)


def rename(media: DataFrame, media_id: int, name: str) -> DataFrame:
    """An item under a new file name, with its old extension if the new one has none.

    ``ValueError`` for separators and reserved or control characters; unchanged if the name
    is the old one, the item doesn't exist or the path is taken.
    """
    if not name.strip() or any(c in '<>:"/\\|?*' or ord(c) < 32 for c in name):
        raise ValueError("not a file name")
    old_ext = F.regexp_extract("file_name", r"(\.[^.]*)$", 1)
    new = F.lit(name) if "." in name else F.concat(F.lit(name), old_ext)
    path = F.concat(F.regexp_extract("file_path", r"(?s)^(.*[/\\])[^/\\]*$", 1), new)
    wanted = media.where(F.col("id") == media_id).select("id", path.alias("new_path"), new.alias("new_name"))
    free = wanted.join(media.select(F.col("file_path").alias("new_path")), "new_path", "left_anti")
    return media.join(F.broadcast(free), "id", "left").withColumn("file_path", F.coalesce("new_path", "file_path")).withColumn("file_name", F.coalesce("new_name", "file_name")).select(media.columns)  # one row


def move(media: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """Items in another folder below the root; one whose new path is taken stays.

    ``ValueError`` for a folder that leaves the root.
    """
    parts = folder.replace("\\", "/").strip("/").split("/")
    if folder.startswith(("/", "\\")) or ".." in parts or ":" in folder:
        raise ValueError("the folder is outside the catalog")
    base = "/".join(p for p in parts if p not in ("", "."))
    target = F.concat(F.lit(base + "/" if base else ""), base_name("file_path"))
    wanted = media.join(ids.select("id").distinct(), "id", "left_semi").select("id", target.alias("new_path"))
    wanted = wanted.join(media.select(F.col("file_path").alias("new_path")), "new_path", "left_anti").groupBy("new_path").agg(F.min("id").alias("id"))
    return media.join(wanted, "id", "left").withColumn("file_path", F.coalesce("new_path", "file_path")).select(media.columns)


def create_tags(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tags with those of ``wanted`` (name, category) that are missing, under new ids in the
    order of category and name. The new ones are a command's, few; only they are numbered."""
    new = wanted.select("name", "category").distinct().join(tags, ["name", "category"], "left_anti")
    most = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy("category", "name"))).join(F.broadcast(most))
    return tags.select("id", "name", "category").unionByName(numbered.select((F.col("most") + F.col("n")).cast("long").alias("id"), "name", "category"))


def _merge_origin(rows: DataFrame) -> DataFrame:
    """One row a link: a manual origin wins, then the later in the order manual, gps, face, clip."""
    rank = F.when(F.col("source") == "manual", 3).when(F.col("source") == "gps", 2).when(F.col("source") == "face", 1).otherwise(0)
    return rows.groupBy(*LINK).agg(F.max(F.struct(F.col("manual"), rank.alias("r"), F.col("source"))).alias("o")).select(*LINK, F.col("o.manual").alias("manual"), F.col("o.source").alias("source"))


def add_tag(tables: Tables, items: DataFrame, tag_id: int) -> Tables:
    """The tag on the items, by hand: links gain what is missing, their origin becomes manual."""
    ids = items.select(F.col("id").alias("media_id")).distinct().join(tables["media"].select(F.col("id").alias("media_id")), "media_id", "left_semi")
    new = ids.withColumn("tag_id", F.lit(tag_id).cast("long"))
    origin = tables["provenance"].select(*LINK, "manual", "source").unionByName(new.withColumns({"manual": F.lit(True), "source": F.lit("manual")}))
    links = tables["media_tags"].select(*LINK)
    fresh = new.join(links.where(F.col("tag_id") == tag_id), LINK, "left_anti")  # a link is stored once, so only new ones are compared
    return {"media_tags": links.unionByName(fresh), "provenance": _merge_origin(origin)}


def remove_tag(tables: Tables, items: DataFrame, tag_id: int) -> Tables:
    """The tag off the items. Where it was a person, faces lose that identity and reject it;
    where a label model had set it, the label is rejected."""
    gone = items.select(F.col("id").alias("media_id")).distinct().withColumn("tag_id", F.lit(tag_id).cast("long"))
    gone = tables["media_tags"].select(*LINK).join(gone, LINK, "left_semi")
    off = lambda name: by_link(tables[name], gone, "left_anti")
    out = {"media_tags": off("media_tags"), "provenance": off("provenance")}
    if "smart_tag_rejections" in tables:
        by_model = by_link(tables["provenance"].where("source = 'clip'"), gone, "left_semi").select(*LINK)
        out["smart_tag_rejections"] = tables["smart_tag_rejections"].select(*LINK).unionByName(by_model).distinct()
    if "faces" in tables:
        faces = tables["faces"]
        hit = faces.where(F.col("person_tag_id") == tag_id).join(gone, "media_id", "left_semi").select(F.col("id").alias("face_id"))
        out["face_rejections"] = tables["face_rejections"].select("face_id", "tag_id").unionByName(hit.withColumn("tag_id", F.lit(tag_id).cast("long"))).distinct()
        out["faces"] = _clear_identity(faces, hit)
    return out


def _clear_identity(faces: DataFrame, hit: DataFrame) -> DataFrame:
    marked = faces.join(hit.select(F.col("face_id").alias("id"), F.lit(True).alias("hit")), "id", "left")
    kind = dict(faces.dtypes)["person_tag_id"]
    marked = marked.withColumn("person_tag_id", F.when(F.col("hit"), F.lit(None).cast(kind)).otherwise(F.col("person_tag_id")))
    if "revision" in faces.columns:
        marked = marked.withColumn("revision", F.col("revision") + F.coalesce(F.col("hit"), F.lit(False)).cast("int"))
    return marked.select(faces.columns)


def replace_members(links: DataFrame, tag_id: int, items: DataFrame) -> DataFrame:
    """Links in which exactly ``items`` have the tag."""
    new = items.select(F.col("id").alias("media_id")).distinct().withColumn("tag_id", F.lit(tag_id).cast("long"))
    return links.where(F.col("tag_id") != tag_id).select(*LINK).unionByName(new)


def replace_smart_tags(tables: Tables, items: DataFrame, assigned: DataFrame) -> Tables:
    """The label model's links of ``items`` become ``assigned``, but for rejected ones. Links of
    other origins stay, and a label that is there already keeps its origin."""
    links, origin = tables["media_tags"].select(*LINK), tables["provenance"].select(*LINK, "manual", "source")
    ids = items.select(F.col("id").alias("media_id")).distinct()
    old = origin.where("source = 'clip' AND NOT manual").join(ids, "media_id", "left_semi").select(*LINK)
    kept, kept_origin = by_link(links, old, "left_anti"), by_link(origin, old, "left_anti")
    new = by_link(assigned.select(*LINK).join(ids, "media_id", "left_semi").distinct(), kept, "left_anti")
    if "smart_tag_rejections" in tables:
        new = new.join(tables["smart_tag_rejections"].select(*LINK), LINK, "left_anti")
    return {"media_tags": kept.unionByName(new), "provenance": kept_origin.unionByName(new.withColumns({"manual": F.lit(False), "source": F.lit("clip")}))}


def set_place_tags(tables: Tables, items: DataFrame, names: DataFrame) -> Tables:
    """Place tags of ``items`` from ``names`` (media_id, name): new tags are created, links whose
    origin is a location and that aren't named go, manual links stay as they are."""
    tags = create_tags(tables["tags"], names.select("name", F.lit("places").alias("category")))
    ids = items.select(F.col("id").alias("media_id")).distinct()
    places = tags.where("category = 'places'").select(F.col("id").alias("tag_id"), "name")
    new = names.join(ids, "media_id", "left_semi").join(places, "name").select(*LINK).distinct()
    origin, links = tables["provenance"].select(*LINK, "manual", "source"), tables["media_tags"].select(*LINK)
    stale = origin.where("source = 'gps' AND NOT manual").join(ids, "media_id", "left_semi").join(new, LINK, "left_anti").select(*LINK)
    fresh = new.join(links, LINK, "left_anti")
    return {
        "tags": tags,
        "media_tags": by_link(links, stale, "left_anti").unionByName(fresh),
        "provenance": by_link(origin, stale, "left_anti").unionByName(fresh.withColumns({"manual": F.lit(False), "source": F.lit("gps")})),
    }


def merge_media(tables: Tables, pairs: DataFrame, parts: int | None = None) -> Tables:
    """Copies folded into keepers: ``pairs`` of (keeper, id), each copy once.

    A keeper's empty fields take the first copy's value that isn't empty, in the order of
    ids; links and their origins are united, manual ones winning; albums that hold a copy
    but not the keeper keep its place for the keeper; covers follow. The copies go. Links are
    united in as many ``parts``, which should follow the input.
    """
    media = tables["media"]
    copies = pairs.select("keeper", "id").join(media, "id")

    def first(name: str, empty) -> Column:
        return F.min_by(F.when(F.col(name) != F.lit(empty), F.col(name)), F.when(F.col(name) != F.lit(empty), F.col("id"))).alias(f"c_{name}")

    texts = [c for c in ("caption", "audio_artist", "audio_title", "audio_album", "audio_genre", "camera_make", "camera_model", "lens") if c in media.columns]
    numbers = [c for c in ("rating", "flag", "date_taken") if c in media.columns]
    located = F.min_by(F.when(F.col("has_gps"), F.struct("latitude", "longitude")), F.when(F.col("has_gps"), F.col("id"))).alias("c_gps")
    filled = copies.groupBy("keeper").agg(*(first(c, "") for c in texts), *(first(c, 0) for c in numbers), located)
    out = media.join(pairs.select("id"), "id", "left_anti").join(filled, media.id == filled.keeper, "left")
    fill = lambda c, empty: F.when((F.col(c) == F.lit(empty)) & F.col(f"c_{c}").isNotNull(), F.col(f"c_{c}")).otherwise(F.col(c))
    takes_gps = ~F.col("has_gps") & F.col("c_gps").isNotNull()
    out = out.withColumns({c: fill(c, "") for c in texts} | {c: fill(c, 0) for c in numbers} | {c: F.when(takes_gps, F.col(f"c_gps.{c}")).otherwise(F.col(c)) for c in ("latitude", "longitude")} | {"has_gps": F.col("has_gps") | takes_gps}).select(media.columns)
    to = pairs.select(F.col("id").alias("media_id"), "keeper")
    point = lambda df: df.join(to, "media_id", "left").withColumn("media_id", F.coalesce("keeper", "media_id")).drop("keeper")
    dealt = lambda df: df if parts is None else df.repartition(parts, "media_id")
    links = dealt(point(tables["media_tags"]).select(*LINK)).distinct()
    origin = _merge_origin(dealt(point(tables["provenance"]).select(*LINK, "manual", "source")))
    members = tables["album_media"]
    w = Window.partitionBy("album_id", "media_id").orderBy(F.desc("own"), "position", "was")
    placed = members.withColumn("was", F.col("media_id")).join(to, "media_id", "left").withColumn("own", F.col("keeper").isNull()).withColumn("media_id", F.coalesce("keeper", "media_id"))
    placed = placed.withColumn("n", F.row_number().over(w))
    shrunk = placed.where("n > 1").select("album_id").distinct()
    members = placed.where("n = 1").select(members.columns)
    compacted = compact(members.join(shrunk, "album_id", "left_semi"))
    members = members.join(shrunk, "album_id", "left_anti").unionByName(compacted)
    result = {"media": out, "media_tags": links, "provenance": origin, "album_media": members}
    if "cover_media_id" in tables["albums"].columns:
        albums = tables["albums"]
        new = albums.join(to.withColumnRenamed("media_id", "cover_media_id"), "cover_media_id", "left")
        result["albums"] = new.withColumn("cover_media_id", F.coalesce("keeper", "cover_media_id")).select(albums.columns)
    return result


def compact(members: DataFrame) -> DataFrame:
    """Positions 0 to n - 1 in each album, in the order of position and id."""
    w = Window.partitionBy("album_id").orderBy("position", "media_id")
    return members.withColumn("position", (F.row_number().over(w) - 1).cast(dict(members.dtypes)["position"])).select(members.columns)


def create_album(albums: DataFrame, name: str) -> DataFrame:
    """Albums with a new one under the next id; ``ValueError`` if the name is blank or taken."""
    if not name.strip() or not albums.where(F.col("name") == name).isEmpty():
        raise ValueError("the name is blank or taken")
    new = albums.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast(dict(albums.dtypes)["id"]).alias("id")).withColumn("name", F.lit(name))
    return albums.unionByName(new, allowMissingColumns=True)


def set_cover(albums: DataFrame, members: DataFrame, media: DataFrame, covers: DataFrame) -> DataFrame:
    """Albums with the covers ``(album_id, media_id)`` that are photos and members of theirs."""
    photos = media.where("media_type = 'photo'").select(F.col("id").alias("media_id"))
    good = covers.select("album_id", "media_id").join(members, ["album_id", "media_id"], "left_semi").join(photos, "media_id", "left_semi")
    new = good.groupBy("album_id").agg(F.max("media_id").alias("new"))
    old = albums if "cover_media_id" in albums.columns else albums.withColumn("cover_media_id", F.lit(None).cast("long"))
    return old.join(new, old.id == new.album_id, "left").withColumn("cover_media_id", F.coalesce("new", "cover_media_id")).select(old.columns)


def remove_from_album(albums: DataFrame, members: DataFrame, album_id: int, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(albums, members)`` without the items in an album; a cover among them becomes null."""
    gone = items.select(F.col("id").alias("media_id")).distinct()
    own = F.col("album_id") == album_id
    left = members.where(~own).unionByName(members.where(own).join(gone, "media_id", "left_anti").select(members.columns))
    if "cover_media_id" not in albums.columns:
        return albums, left
    hit = gone.select(F.col("media_id").alias("hit"))
    cleared = albums.join(hit, (albums.id == album_id) & (albums.cover_media_id == F.col("hit")), "left")
    return cleared.withColumn("cover_media_id", F.when(F.col("hit").isNull(), F.col("cover_media_id"))).select(albums.columns), left


def set_location(tables: Tables, places: DataFrame, gazetteer: DataFrame, max_km: float = MAX_KM) -> Tables:
    """Items at the new ``(id, latitude, longitude)``, and the tags of their places derived again."""
    new = places.select("id", F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    media = tables["media"].join(new, "id", "left").withColumn("has_gps", F.col("has_gps") | F.col("la").isNotNull())
    media = media.withColumn("latitude", F.coalesce("la", "latitude")).withColumn("longitude", F.coalesce("lo", "longitude")).select(tables["media"].columns)
    moved = media.join(places.select("id"), "id", "left_semi")
    return {"media": media} | set_place_tags(tables, moved, place_names(moved, gazetteer, max_km))


def add_to_album(members: DataFrame, album_id: int, items: DataFrame) -> DataFrame:
    """The items (id, position) in an album; those already there move to the new position."""
    new = items.select(F.lit(album_id).cast("long").alias("album_id"), F.col("id").alias("media_id"), F.col("position").cast(dict(members.dtypes)["position"]).alias("position"))
    return members.join(new, ["album_id", "media_id"], "left_anti").unionByName(new.select(members.columns))


def reorder_album(members: DataFrame, album_id: int, order: list[int]) -> DataFrame:
    """An album in the given order; ``ValueError`` unless it names every member exactly once."""
    spark = members.sparkSession
    given = spark.createDataFrame([(i, k) for k, i in enumerate(order)], "media_id long, n int")
    own = members.where(F.col("album_id") == album_id)
    if len(set(order)) != len(order) or not own.join(given, "media_id", "left_anti").isEmpty() or not given.join(own, "media_id", "left_anti").isEmpty():
        raise ValueError("the order must name every member exactly once")
    new = own.join(F.broadcast(given), "media_id").withColumn("position", F.col("n").cast(dict(members.dtypes)["position"]))  # a command's rows
    return members.where(F.col("album_id") != album_id).unionByName(new.select(members.columns))


def delete_media(tables: Tables, items: DataFrame) -> Tables:
    """Every table without the items and what hangs on them; covers of albums become null."""
    ids = items.select(F.col("id").alias("gone")).distinct()
    keys = {"media": ["id"], "media_tags": ["media_id"], "provenance": ["media_id"], "album_media": ["media_id"], "faces": ["media_id"], "index": ["media_id"], "smart_tag_rejections": ["media_id"], "dismissals": ["media_id_a", "media_id_b"]}
    out = {}
    for name, columns in keys.items():
        if name in tables:
            df = tables[name]
            for c in columns:
                df = df.join(ids, df[c] == ids.gone, "left_anti")
            out[name] = df
    if "face_rejections" in tables and "faces" in tables:
        out["face_rejections"] = tables["face_rejections"].join(out["faces"].select(F.col("id").alias("face_id")), "face_id", "left_semi")
    albums = tables.get("albums")
    if albums is not None and "cover_media_id" in albums.columns:
        out["albums"] = albums.join(ids, albums.cover_media_id == ids.gone, "left").withColumn("cover_media_id", F.when(F.col("gone").isNull(), F.col("cover_media_id"))).select(albums.columns)
    return out


def delete_tag(tables: Tables, tag_id: int) -> Tables:
    """Every table without the tag; faces of that person are unnamed again."""
    out = {"tags": tables["tags"].where(F.col("id") != tag_id)}
    for name in ("media_tags", "provenance", "smart_tag_rejections", "face_rejections"):
        if name in tables:
            out[name] = tables[name].where(F.col("tag_id") != tag_id)
    if "faces" in tables:
        out["faces"] = _clear_identity(tables["faces"], tables["faces"].where(F.col("person_tag_id") == tag_id).select(F.col("id").alias("face_id")))
    return out


def relativise(media: DataFrame, root: str) -> DataFrame:
    """``media`` with ``new_path``: below ``root`` where that path is free, else the old one. Of
    several that want a path, the first by id gets it, unless another row has it already."""
    wanted = media.select("id", "file_path", relative_to("file_path", root).alias("wanted"))
    moving = wanted.where("wanted <> file_path")
    free = moving.join(media.select(F.col("file_path").alias("wanted")), "wanted", "left_anti").groupBy("wanted").agg(F.min("id").alias("id"))
    return media.join(free.select("id", F.col("wanted").alias("new_path")), "id", "left").withColumn("new_path", F.coalesce("new_path", "file_path"))


def import_rows(media: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, conflicts)`` of updates ``rows``, which hold, beside the new values, the
    expected old ones as ``was_<column>``: an update is accepted while its row still has them."""
    columns = [c for c in SNAPSHOT if f"was_{c}" in rows.columns]
    now = media.select("id", *(F.col(c).alias(f"was_{c}") for c in columns))
    same = [rows.id == now.id] + [rows[f"was_{c}"].eqNullSafe(now[f"was_{c}"]) for c in columns]
    return rows.join(now, same, "left_semi"), rows.join(now, same, "left_anti")


def incremental(found: DataFrame, media: DataFrame) -> DataFrame:
    """Files that are new or whose size, time or kind has changed, with ``id`` of the old row."""
    old = media.select("file_path", "id", F.col("file_size").alias("old_size"), F.col("file_modified_time").alias("old_time"), F.col("media_type").alias("old_type"))
    same = F.col("file_size").eqNullSafe(F.col("old_size")) & F.col("file_modified_time").eqNullSafe(F.col("old_time")) & F.col("media_type").eqNullSafe(F.col("old_type"))
    return found.join(old, "file_path", "left").where(F.col("id").isNull() | ~same).drop("old_size", "old_time", "old_type")


def invalidate(tables: Tables, updated: DataFrame) -> Tables:
    """Derived data without that of items whose content changed: faces, vectors, and links that
    a face or label model had set; manual links stay."""
    columns = [c for c in DERIVED if c in updated.columns]
    old = tables["media"].select("id", *(F.col(c).alias(f"old_{c}") for c in columns))
    differs = ~F.lit(True)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    ids = updated.join(old, "id").where(differs).select(F.col("id").alias("media_id"))
    links = tables["provenance"].where("NOT manual AND source IN ('face', 'clip')").join(ids, "media_id", "left_semi").select(*LINK)
    out = {name: tables[name].join(ids, "media_id", "left_anti") for name in ("faces", "index") if name in tables}
    return out | {name: by_link(tables[name], links, "left_anti") for name in ("media_tags", "provenance")}


def sync_people(tables: Tables) -> Tables:
    """Links of people without those that faces had set and that no face bears any more."""
    borne = tables["faces"].where("NOT dismissed AND person_tag_id IS NOT NULL").select("media_id", F.col("person_tag_id").alias("tag_id")).distinct()
    stale = tables["provenance"].where("NOT manual AND source = 'face'").join(borne, LINK, "left_anti").select(*LINK)
    return {name: by_link(tables[name], stale, "left_anti") for name in ("media_tags", "provenance")}


def tag_roots(tags: DataFrame, rounds: int = 10) -> DataFrame:
    """Tags (id, parent_id) with ``depth``, parents first; what isn't reached in ``rounds``
    steps, orphans and cycles, becomes a root."""
    known = tags.join(tags.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", "parent_id")
    level = tags.join(known.select("id"), "id", "left_anti").select("id", F.lit(0).alias("depth"))
    done = level
    for depth in range(1, rounds + 1):
        level = known.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", F.lit(depth).alias("depth"))
        done = done.unionByName(level)
    return tags.join(done, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
