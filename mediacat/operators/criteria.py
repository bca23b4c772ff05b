"""The criteria language: one frozen record of conditions, sorting and paging."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.scalars import ascii_lower, contains_folded

SORTS = ("date_taken", "rating", "file_name", "file_size", "duration")
SEARCHED = ("file_name", "file_path", "caption", "camera_make", "camera_model", "audio_artist", "audio_title", "audio_album", "audio_genre")
LAST_IMPORTED = ("Last Imported", "keyword")
MOST_ROWS, MOST_TEXT = 1000, 1000


@dataclass(frozen=True)
class QueryCriteria:
    """What to select. None, empty text and empty tuples mean no condition."""

    media_type: str | None = None
    min_rating: int | None = None
    max_rating: int | None = None
    flag: int | None = None
    not_flag: int | None = None
    last_imported: bool = False
    tag_ids: tuple[int, ...] = ()
    folder: str | None = None
    folders: tuple[str, ...] = ()
    match_any: bool = False
    album_id: int | None = None
    camera_make: str | None = None
    camera_model: str | None = None
    date_from: int | None = None
    date_to: int | None = None
    has_gps: bool | None = None
    min_lat: float | None = None
    max_lat: float | None = None
    min_lon: float | None = None
    max_lon: float | None = None
    search_text: str | None = None
    tag_category: str | None = None
    sort_by: str = "date_taken"
    descending: bool = True
    limit: int = 100
    offset: int = 0

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v not in (None, "", (), [])}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> QueryCriteria:
        """Fields of the wrong type are ignored; what isn't named has its default."""
        data, given = json.loads(text), {}
        for f in fields(cls):
            v, kind = data.get(f.name), str(f.type)
            if isinstance(v, list) and "tuple" in kind:
                one = int if "int" in kind else str
                given[f.name] = tuple(x for x in v if isinstance(x, one) and not isinstance(x, bool))
            elif isinstance(v, bool):
                given |= {f.name: v} if "bool" in kind else {}
            elif isinstance(v, int | float) and ("float" in kind or "int" in kind and "tuple" not in kind and isinstance(v, int)):
                given[f.name] = v
            elif isinstance(v, str) and "str" in kind and "tuple" not in kind:
                given[f.name] = v
        return cls(**given)

    def validate(self) -> QueryCriteria:
        """Itself, or ``ValueError`` for what a request may not ask for."""

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        for name in ("min_rating", "max_rating"):
            v = getattr(self, name)
            need(v is None or 0 <= v <= 5, f"{name} must be 0 to 5")
        need(self.min_rating is None or self.max_rating is None or self.min_rating <= self.max_rating, "min_rating is above max_rating")
        for name in ("flag", "not_flag"):
            need(getattr(self, name) in (None, -1, 0, 1), f"{name} must be -1, 0 or 1")
        need(self.flag is None or self.flag != self.not_flag, "flag and not_flag exclude each other")
        need(0 <= self.limit <= MOST_ROWS, f"limit must be 0 to {MOST_ROWS}")
        need(self.offset >= 0, "offset must not be negative")
        need(all(t > 0 for t in self.tag_ids), "tag ids must be positive")
        need(self.album_id is None or self.album_id > 0, "album_id must be positive")
        for name in ("search_text", "camera_make", "camera_model", "folder", "tag_category"):
            need(len(getattr(self, name) or "") <= MOST_TEXT, f"{name} is too long")
        for low, high, most in (("min_lat", "max_lat", 90), ("min_lon", "max_lon", 180)):
            a, b = getattr(self, low), getattr(self, high)
            need(all(x is None or math.isfinite(x) and abs(x) <= most for x in (a, b)), f"{low} and {high} must be within {most}")
            need(a is None or b is None or a <= b, f"{low} is above {high}")
        return self


def parse_ids(text: str) -> tuple[int, ...]:
    """Positive ids of a list with commas, in order, each once; ``ValueError`` for others."""
    ids = [int(x) for x in text.split(",") if x.strip()]
    if any(i <= 0 for i in ids):
        raise ValueError("ids must be positive")
    return tuple(dict.fromkeys(ids))


def parse_folders(text: str) -> tuple[str, ...]:
    """A JSON array of texts, or texts divided by ``|``, or by ``,``."""
    if text.lstrip().startswith("["):
        found = json.loads(text)
        if not all(isinstance(x, str) for x in found):
            raise ValueError("folders must be texts")
        return tuple(found)
    return tuple(x.strip() for x in text.split("|" if "|" in text else ",") if x.strip())


def in_folder(path: str | Column, folder: str) -> Column | None:
    """Whether a path lies in a folder or below it; None for the root, which holds all.

    ``.`` is the root itself: paths without a folder. ASCII case is folded.
    """
    norm = folder.replace("\\", "/").rstrip("/")
    if not norm:
        return None
    p = F.col(path) if isinstance(path, str) else path
    if norm == ".":
        return ~F.contains(p, F.lit("/")) & ~F.contains(p, F.lit("\\"))
    p, norm = ascii_lower(p), norm.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = None
    for base in (norm, norm.replace("/", "\\")):
        for prefix in ((base,) if base.startswith(("/", "\\")) else (base, "/" + base, "\\" + base)):
            for sep in "/\\":
                here = F.startswith(p, F.lit(prefix + sep))
                found = here if found is None else found | here
    return found


def _finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


def predicates(c: QueryCriteria) -> list[Column]:
    """Conditions on the media table alone; all of them reach the scan."""
    out: list[Column] = []
    if c.media_type and c.media_type != "all":
        out.append(F.col("media_type") == c.media_type)
    for name, col, op in (("min_rating", "rating", ">="), ("max_rating", "rating", "<="), ("flag", "flag", "=="), ("not_flag", "flag", "!="), ("date_from", "date_taken", ">="), ("date_to", "date_taken", "<=")):
        v = getattr(c, name)
        if v is not None:
            out.append({">=": F.col(col) >= v, "<=": F.col(col) <= v, "==": F.col(col) == v, "!=": F.col(col) != v}[op])
    for name in ("camera_make", "camera_model"):
        if v := getattr(c, name):
            out.append(contains_folded(name, v))
    if c.has_gps is not None:
        out.append(F.col("has_gps") == c.has_gps)
    if _finite(c.min_lat):
        out.append(F.col("latitude") >= c.min_lat)
    if _finite(c.max_lat):
        out.append(F.col("latitude") <= c.max_lat)
    west = F.col("longitude") >= c.min_lon if _finite(c.min_lon) else None
    east = F.col("longitude") <= c.max_lon if _finite(c.max_lon) else None
    if west is not None and east is not None and c.min_lon > c.max_lon:
        out.append(west | east)  # across the date line
    else:
        out += [x for x in (west, east) if x is not None]
    return out


def select_media(tables: dict[str, DataFrame], c: QueryCriteria) -> DataFrame:
    """The media rows that satisfy the criteria, unsorted.

    Conditions on links are semi joins, so no row is multiplied. OR mode, and text search
    over tags, need "has a link or ...", which is a left join to distinct ids.
    """
    media = tables["media"]
    for p in predicates(c):
        media = media.where(p)
    links, tags = tables["media_tags"], tables["tags"]
    semi = lambda df, ids: df.join(ids, df.id == ids.media_id, "left_semi")
    if c.last_imported:
        name, category = LAST_IMPORTED
        media = semi(media, links.join(tags.where((F.col("name") == name) & (F.col("category") == category)), links.tag_id == tags.id, "left_semi").select("media_id"))
    folders = [f for f in dict.fromkeys([*c.folders, *([c.folder] if c.folder else [])])]
    within = [x for x in (in_folder("file_path", f) for f in folders) if x is not None]
    inside = None
    for x in within:
        inside = x if inside is None else inside | x
    if c.match_any and (c.tag_ids or inside is not None):
        if c.tag_ids:
            ids = links.where(F.col("tag_id").isin(*c.tag_ids)).select(F.col("media_id").alias("mediacat_tagged")).distinct()
            tagged = F.col("mediacat_tagged").isNotNull()
            media = media.join(ids, media.id == ids.mediacat_tagged, "left").where(tagged | inside if inside is not None else tagged).drop("mediacat_tagged")
        else:
            media = media.where(inside)
    elif not c.match_any:
        if c.tag_ids:
            wanted = tuple(dict.fromkeys(c.tag_ids))
            every = links.where(F.col("tag_id").isin(*wanted)).groupBy("media_id").agg(F.count_distinct("tag_id").alias("n")).where(F.col("n") == len(wanted)).select("media_id")
            media = semi(media, every)
        if inside is not None:
            media = media.where(inside)
    if c.album_id is not None:
        media = semi(media, tables["album_media"].where(F.col("album_id") == c.album_id).select("media_id"))
    if c.search_text:
        named = tags.where(contains_folded("name", c.search_text)).select("id")
        ids = links.join(named, links.tag_id == named.id, "left_semi").select(F.col("media_id").alias("mediacat_named")).distinct()
        here = F.col("mediacat_named").isNotNull()
        for col in SEARCHED:
            here = here | F.coalesce(contains_folded(col, c.search_text), F.lit(False))
        media = media.join(ids, media.id == ids.mediacat_named, "left").where(here).drop("mediacat_named")
    if c.tag_category:
        fold = c.tag_category.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        of = tags.where(ascii_lower("category") == fold).select("id")
        media = semi(media, links.join(of, links.tag_id == of.id, "left_semi").select("media_id"))
    return media


def ordering(c: QueryCriteria) -> list[Column]:
    """Sort columns: the criterion, then the id in the same direction."""
    if c.sort_by == "album_order" and c.album_id is not None:
        names = ["position", "id"]
    else:
        names = [c.sort_by if c.sort_by in SORTS else "date_taken", "id"]
    return [F.col(n).desc_nulls_last() if c.descending else F.col(n).asc_nulls_first() for n in names]


def run(tables: dict[str, DataFrame], c: QueryCriteria) -> DataFrame:
    """A sorted page of media. A limit of 0 or less means all rows, and then no offset."""
    media = select_media(tables, c)
    if c.sort_by == "album_order" and c.album_id is not None:
        places = tables["album_media"].where(F.col("album_id") == c.album_id).select(F.col("media_id").alias("id"), "position")
        media = media.join(places, "id")
    media = media.orderBy(*ordering(c))
    if c.limit > 0:
        media = (media.offset(c.offset) if c.offset > 0 else media).limit(c.limit)
    return media


def total(tables: dict[str, DataFrame], c: QueryCriteria, page_rows: int) -> int:
    """Rows of all pages; not counted where the first page isn't full."""
    if c.offset == 0 and (c.limit <= 0 or page_rows < c.limit):
        return page_rows
    return select_media(tables, c).count()


def with_tags(page: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The page with ``tags``: an array of (id, name, category, source), by category and name."""
    links, tags, origin = tables["media_tags"], tables["tags"], tables["provenance"]
    ids = page.select(F.col("id").alias("media_id"))
    origin = origin.join(ids, "media_id", "left_semi")
    of = (
        links.join(ids, "media_id", "left_semi")
        .join(tags.withColumnRenamed("id", "tag_id"), "tag_id")
        .join(origin.select("media_id", "tag_id", "source"), ["media_id", "tag_id"], "left")
        .groupBy("media_id")
        .agg(F.sort_array(F.collect_list(F.struct("category", "name", F.col("tag_id").alias("id"), F.coalesce("source", F.lit("manual")).alias("source")))).alias("tags"))
    )
    empty = F.array().cast("array<struct<category:string,name:string,id:bigint,source:string>>")
    return page.join(of, page.id == of.media_id, "left").drop("media_id").withColumn("tags", F.coalesce("tags", empty))


def get_by(tables: dict[str, DataFrame], column: str, value) -> DataFrame:
    """Point lookup by id, path or hash; the smallest id where several rows match."""
    return tables["media"].where(F.col(column) == value).orderBy("id").limit(1)
