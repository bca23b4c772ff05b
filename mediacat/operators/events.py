"""Events: photos in a row, cut at long gaps, long spans and far places, and their names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.scalars import EARTH_RADIUS_KM, ascii_lower, is_generic_folder, is_located, slashes, trim_space
from mediacat.operators.tables import checkpointed, fold_sorted

MAX_GAP_S = 4 * 3600
MAX_SPAN_S = 12 * 3600
MAX_STEP_KM = 25.0
BUCKET_S = 86_400


def skipped(media: DataFrame) -> DataFrame:
    """``(id, reason)`` of the items that are in no event."""
    return media.select("id", F.when(F.col("media_type") != "photo", "not_photo").when(F.col("date_taken") == 0, "invalid_date").alias("reason")).where("reason IS NOT NULL")


def islands(rows: DataFrame, at: str, gap: int = MAX_GAP_S, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``island``: the time at which their run without a gap above ``gap`` began.

    Runs are found day by day; a table with one row a day (and key) then tells each day
    what came before it. So neither a key nor the whole table has to fit one task.
    """
    day = F.floor(F.col(at) / BUCKET_S).alias("mediacat_day")
    rows = rows.withColumn("mediacat_day", day)
    inside = Window.partitionBy(*keys, "mediacat_day").orderBy(at)
    marked = rows.withColumn("mediacat_before", F.lag(at).over(inside))
    days = rows.groupBy(*keys, "mediacat_day").agg(F.min(at).alias("mediacat_first"), F.max(at).alias("mediacat_last"))
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("mediacat_day")
    days = days.withColumn("mediacat_prev", F.lag("mediacat_last").over(over))
    # The last start within each day, if it has one.
    starts = marked.join(days.select(*keys, "mediacat_day", "mediacat_prev"), [*keys, "mediacat_day"])
    before = F.coalesce("mediacat_before", "mediacat_prev")
    starts = starts.withColumn("mediacat_start", F.when(before.isNull() | (F.col(at) - before > gap), F.col(at)))
    last = starts.groupBy(*keys, "mediacat_day").agg(F.max("mediacat_start").alias("mediacat_last_start"))
    carried = last.withColumn("mediacat_carried", F.max("mediacat_last_start").over(over.rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "mediacat_day", "mediacat_carried")
    running = F.max("mediacat_start").over(inside.rangeBetween(Window.unboundedPreceding, 0))
    out = starts.withColumn("mediacat_running", running).join(carried, [*keys, "mediacat_day"])
    return out.withColumn("island", F.coalesce("mediacat_running", "mediacat_carried")).drop("mediacat_day", "mediacat_before", "mediacat_prev", "mediacat_start", "mediacat_running", "mediacat_carried")


class Cutter:
    """A machine that names each photo's event: one island follows another in time order. Its
    attributes are all that it knows of what came before."""

    def __init__(self, island: int | None = None, first_id: int | None = None, first_at: int | None = None, place: tuple[float, float] | None = None):
        self.island, self.first_id, self.first_at, self.place = island, first_id, first_at, place

    def __call__(self, row: tuple) -> int:
        own, at, media_id, located, lat, lon = row
        here, place = (math.radians(lat), math.radians(lon)) if located else None, self.place
        cut = own != self.island or at - self.first_at > MAX_SPAN_S
        if not cut and place and here:
            h = math.sin((here[0] - place[0]) / 2) ** 2 + math.cos(place[0]) * math.cos(here[0]) * math.sin((here[1] - place[1]) / 2) ** 2
            cut = 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(1.0, h))) > MAX_STEP_KM
        if cut:
            self.island, self.first_id, self.first_at, place = own, media_id, at, None
        self.place = here or place
        return self.first_id


def event_members(media: DataFrame) -> DataFrame:
    """``(id, event)`` of the dated photos; an event goes by the id of its first photo.

    A gap resets all state, so islands are independent: they are dealt to tasks, in which
    their photos stream by in time order.
    """
    photos = media.where((F.col("media_type") == "photo") & (F.col("date_taken") != 0)).select("id", "date_taken", "latitude", "longitude", is_located().alias("located"))
    rows = islands(photos, "date_taken").select("island", "date_taken", "id", "located", "latitude", "longitude")
    return fold_sorted(rows, ["island"], ["date_taken", "id"], Cutter, "event", "long", ["id"])


def _common(members: DataFrame, links: DataFrame, tags: DataFrame, sizes: DataFrame, category: str) -> DataFrame:
    of = tags.where((ascii_lower("category") == category) & ~((F.col("name") == "Last Imported") & (F.col("category") == "keyword")))
    n = links.join(of, links.tag_id == of.id).select("media_id", "tag_id", "name").join(members, F.col("media_id") == members.id).groupBy("event", "tag_id", "name").agg(F.count_distinct("media_id").alias("k"))
    return n.join(sizes, "event").where("k = n").groupBy("event").agg(F.sort_array(F.collect_list(F.struct("name", "tag_id"))).alias(f"{category}_tags"))


def _names(c: str) -> Column:
    return F.coalesce(F.array_distinct(F.filter(F.transform(c, lambda t: t["name"]), lambda x: x != "")), F.array().cast("array<string>"))


def event_summaries(media: DataFrame, tables: dict[str, DataFrame], members: DataFrame | None = None) -> DataFrame:
    """One row an event: size, dates, common people, places and keywords, and its name.

    The name comes from the first common event tag, else the caption of more than half of
    the photos, else the first common place, else a folder that all share and that isn't a
    camera's; ``name_source`` says which, or ``date``.
    """
    members = checkpointed(event_members(media) if members is None else members)  # ten branches follow
    photos = members.join(media.select("id", "date_taken", "caption", "file_path"), "id")
    sizes = members.groupBy("event").agg(F.count("*").alias("n"))
    links, tags = tables["media_tags"], tables["tags"]
    out = photos.groupBy("event").agg(F.count("*").alias("n"), F.min("date_taken").alias("start_date"), F.max("date_taken").alias("end_date"))
    for category in ("people", "places", "keyword", "events"):
        out = out.join(_common(members, links, tags, sizes, category), "event", "left")
    captions = photos.select("event", trim_space("caption").alias("caption")).where("caption <> ''").groupBy("event", "caption").agg(F.count("*").alias("k")).join(sizes, "event").where(F.col("k") > F.floor(F.col("n") / 2)).select("event", "caption")
    folder = F.regexp_extract(slashes("file_path"), r"(?s)([^/]*)/[^/]*$", 1)
    shared = photos.select("event", folder.alias("folder")).groupBy("event").agg(F.min("folder").alias("a"), F.max("folder").alias("b")).where((F.col("a") == F.col("b")) & ~is_generic_folder("a")).select("event", F.col("a").alias("folder"))
    out = out.join(captions, "event", "left").join(shared, "event", "left")
    event_tag, place = F.col("events_tags")[0]["name"], F.col("places_tags")[0]["name"]
    source = F.when(event_tag.isNotNull(), "event").when(F.col("caption").isNotNull(), "caption").when(place.isNotNull(), "place").when(F.col("folder").isNotNull(), "folder").otherwise("date")
    return out.select("event", "n", "start_date", "end_date", source.alias("name_source"), F.coalesce(event_tag, "caption", place, "folder", F.lit("")).alias("name"), _names("people_tags").alias("people"), _names("places_tags").alias("places"), _names("keyword_tags").alias("keywords"))
