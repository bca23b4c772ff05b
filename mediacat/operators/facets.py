"""Facets and statistics of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.scalars import month_of, parent_folder, trim_space, year_of
from mediacat.operators.tables import by_link, numbered


def timeline(media: DataFrame) -> DataFrame:
    """Items by year and month in UTC, undated ones left out, with the bar's height of 10 to 100."""
    by_month = media.where("date_taken <> 0").groupBy(year_of("date_taken").alias("year"), month_of("date_taken").alias("month")).agg(F.count("*").alias("n"))
    top = by_month.agg(F.max("n").alias("most"))  # one row of one number
    return by_month.join(F.broadcast(top)).select("year", "month", "n", F.greatest(F.lit(10), F.round(100 * F.col("n") / F.col("most")).cast("int")).alias("height"))


def years(media: DataFrame) -> DataFrame:
    """Items by year."""
    return media.where("date_taken <> 0").groupBy(year_of("date_taken").alias("year")).agg(F.count("*").alias("n"))


def statistics(media: DataFrame) -> DataFrame:
    """One row. Types other than video and audio count as photos."""
    kind, dated = F.col("media_type"), F.nullif(F.col("date_taken"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return media.agg(
        F.count("*").alias("total"),
        zero(F.sum("file_size")).alias("bytes"),
        zero(F.min(dated)).alias("first_date"),
        zero(F.max(dated)).alias("last_date"),
        F.count_if(~kind.isin("video", "audio")).alias("photos"),
        F.count_if(kind == "video").alias("videos"),
        F.count_if(kind == "audio").alias("audios"),
        F.coalesce(F.sum(F.when(kind.isin("video", "audio"), F.col("duration"))), F.lit(0.0)).alias("seconds"),
        F.count_if(F.col("flag") == 1).alias("picks"),
        F.count_if(F.col("flag") == -1).alias("rejects"),
        F.count_if(F.col("flag") != -1).alias("not_rejects"),
        F.count_if(F.col("rating") == 0).alias("unrated"),
    )


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many items, tags and albums a catalog has."""
    counts = [tables[name].agg(F.count("*").alias(name)) for name in ("media", "tags", "albums")]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # a row each


def label_status(tables: dict[str, DataFrame], state: DataFrame, taxonomy: str) -> DataFrame:
    """One row: photos with a vector of their present content, those of them labelled under
    ``taxonomy`` since, and the links that the label model has set on photos.

    ``index`` and ``state`` (media_id, content_hash, taxonomy_version) say which content they saw.
    """
    photos = tables["media"].where("media_type = 'photo'").select(F.col("id").alias("media_id"), "content_hash")
    indexed = photos.join(tables["index"].select("media_id", "content_hash"), ["media_id", "content_hash"], "left_semi")
    labelled = indexed.join(state.where(F.col("taxonomy_version") == taxonomy), ["media_id", "content_hash"], "left_semi")
    links = tables["provenance"].where("source = 'clip'").join(photos, "media_id", "left_semi")
    links = by_link(links, tables["media_tags"], "left_semi")
    counts = [df.agg(F.count("*").alias(name)) for name, df in (("indexed", indexed), ("labelled", labelled), ("assignments", links))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # a row each


def tag_dates():
    """An item's date for tag statistics: taken, else created, else modified; null if none is known."""
    return F.coalesce(F.nullif(F.col("date_taken"), F.lit(0)), F.when(F.col("created_at") > 0, F.col("created_at")), F.when(F.col("file_modified_time") > 0, F.col("file_modified_time")))


def tag_facets(tables: dict[str, DataFrame]) -> DataFrame:
    """Every tag with its items, first and last date, links by label model, and cover.

    The cover is the newest photo, of equal ones that with the largest id; an item of
    another kind only where no photo has the tag.
    """
    tags, links, origin = tables["tags"], tables["media_tags"], tables["provenance"]
    media = tables["media"].select("id", "media_type", "date_taken", tag_dates().alias("on"))
    cover = F.struct((F.col("media_type") == "photo").alias("photo"), "date_taken", "id")
    per_tag = links.join(media, links.media_id == media.id).groupBy("tag_id").agg(F.count("*").alias("media_count"), F.min("on").alias("first_date"), F.max("on").alias("last_date"), F.max(cover)["id"].alias("cover_id"))
    by_model = by_link(origin.where("source = 'clip'"), links, "left_semi").groupBy("tag_id").agg(F.count("*").alias("ai_count"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return tags.join(per_tag, tags.id == per_tag.tag_id, "left").drop("tag_id").join(by_model, tags.id == by_model.tag_id, "left").select("id", "name", "category", none("media_count"), none("ai_count"), "first_date", "last_date", "cover_id")


def album_facets(tables: dict[str, DataFrame]) -> DataFrame:
    """Every album with its number of items, 0 for empty ones."""
    albums, members = tables["albums"], tables["album_media"]
    n = members.groupBy("album_id").agg(F.count("*").alias("n"))
    return albums.join(n, albums.id == n.album_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def album_listing(tables: dict[str, DataFrame], album_id: int) -> DataFrame:
    """An album's items with ``rank`` by position, then newest, then id."""
    members = tables["album_media"].where(F.col("album_id") == album_id)
    w = Window.partitionBy("album_id").orderBy("position", F.desc("date_taken"), "id")
    return members.join(tables["media"], members.media_id == tables["media"].id).withColumn("rank", F.row_number().over(w))


def folders(media: DataFrame) -> DataFrame:
    """The distinct folders of the items, without the root."""
    return media.select(parent_folder("file_path").alias("folder")).where("folder <> ''").distinct()


def rating_histogram(media: DataFrame) -> DataFrame:
    return media.groupBy("rating").agg(F.count("*").alias("n"))


def top_captions(media: DataFrame, k: int = 5) -> DataFrame:
    return media.select(trim_space("caption").alias("caption")).where("caption <> ''").groupBy("caption").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "caption").limit(k)


def category_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """By tag category: its tags, links, and distinct items."""
    tags, links = tables["tags"], tables["media_tags"]
    named = links.join(tags.select(F.col("id").alias("tag_id"), "category"), "tag_id")
    per_item = named.groupBy("category", "media_id").agg(F.count("*").alias("links"))  # where an item's links are together, they stay
    items = per_item.groupBy("category").agg(F.sum("links").alias("links"), F.count("media_id").alias("items"))
    per_tag = named.groupBy("category", "tag_id").agg(F.lit(1).alias("one")).groupBy("category").agg(F.count("tag_id").alias("tags"))
    return items.withColumnRenamed("category", "of").join(per_tag, F.col("of").eqNullSafe(F.col("category"))).select("category", "tags", "links", "items")


def located_bounds(media: DataFrame, padding: float = 0.0) -> DataFrame:
    """The box around all located items."""
    from mediacat.functions.scalars import is_located

    return media.where(is_located()).agg(
        (F.min("latitude") - padding).alias("min_lat"), (F.max("latitude") + padding).alias("max_lat"), (F.min("longitude") - padding).alias("min_lon"), (F.max("longitude") + padding).alias("max_lon")
    )


def common_tags(items: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Tags that any of ``items`` (ids) has, each once."""
    links, tags = tables["media_tags"], tables["tags"]
    ids = links.join(items.select(F.col("id").alias("media_id")), "media_id", "left_semi").select("tag_id").distinct()
    return tags.join(ids, tags.id == ids.tag_id, "left_semi")


def sorted_tiles(facets: DataFrame, by: str = "last_date", descending: bool = True) -> DataFrame:
    """Facets with ``rank`` by a date, count or name; those without a value last either way."""
    c = F.col(by)
    return numbered(facets, [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("name"), F.col("id")])


def eav_pivot(rows: DataFrame, entity: str, attribute: str, value: str, attributes: list[str]) -> DataFrame:
    """Entity-attribute-value rows as one row an entity; the largest value where one repeats."""
    return rows.groupBy(entity).agg(*(F.max(F.when(F.col(attribute) == a, F.col(value))).alias(a) for a in attributes))


def merge_by_path(rows: DataFrame) -> DataFrame:
    """Items that share a path become one: best rating, longest caption (the earliest of
    equals), lowest flag, and the first location and camera by id."""
    first = lambda name, ok: F.min_by(F.when(ok, F.col(name)), F.when(ok, F.col("id")))
    camera, located = F.col("camera_make") != "", F.col("has_gps")
    return rows.groupBy("file_path").agg(
        F.min("id").alias("id"),
        F.max("rating").alias("rating"),
        F.max_by("caption", F.struct(F.length("caption"), -F.col("id"))).alias("caption"),
        F.min("flag").alias("flag"),
        first("latitude", located).alias("latitude"),
        first("longitude", located).alias("longitude"),
        first("camera_make", camera).alias("camera_make"),
    )
