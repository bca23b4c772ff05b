"""Scalar functions: text, paths, dates, geometry, vectors.

Sentinels of the data model are kept: a date of 0 is undated and an empty string is
absent; neither is turned into null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EARTH_RADIUS_KM = 6371.0088
MIN_NORM = 1e-12


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- text


def ascii_lower(c: str | Column) -> Column:
    """A-Z in lower case and nothing else, as SQL's LIKE folds in the catalog."""
    return F.translate(_col(c), UPPER, LOWER)


def trim_space(c: str | Column) -> Column:
    """Without spaces, tabs, carriage returns and line feeds at either end."""
    return F.regexp_replace(_col(c), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def contains_folded(c: str | Column, needle: str) -> Column:
    """Substring search with ASCII case folding; no character of ``needle`` is special."""
    return F.contains(ascii_lower(c), F.lit(needle.translate(str.maketrans(UPPER, LOWER))))


def like_escaped(text: str) -> str:
    """``text`` with ``%``, ``_`` and the escape ``!`` escaped for ``LIKE ... ESCAPE '!'``."""
    return "".join("!" + c if c in "%_!" else c for c in text)


def has_word(c: str | Column, word: str) -> Column:
    """Whether ``word`` stands between characters that aren't ASCII letters or digits."""
    return F.rlike(_col(c), F.lit(f"(?<![0-9A-Za-z]){word}(?![0-9A-Za-z])"))


def decode_data_url(c: str | Column) -> Column:
    """The bytes of base64 text, with or without a ``data:...;base64,`` head."""
    return F.unbase64(F.regexp_replace(_col(c), r"^data:[^,]*,", ""))


def truncate_bytes(c: str | Column, limit: int = 100) -> Column:
    """The longest prefix of whole characters with at most ``limit`` UTF-8 bytes."""
    text = _col(c)
    size = F.aggregate(
        F.split(F.substring(text, 1, limit), ""),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda acc, ch: F.when(
            acc["bytes"] + F.octet_length(ch) <= limit,
            F.struct((acc["bytes"] + F.octet_length(ch)).alias("bytes"), (acc["chars"] + F.length(ch)).alias("chars")),
        ).otherwise(F.struct(F.lit(limit + 1).alias("bytes"), acc["chars"].alias("chars"))),
    )["chars"]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(text, F.lit(1), size))


# ---------------------------------------------------------------- paths


def slashes(c: str | Column) -> Column:
    return F.replace(_col(c), F.lit("\\"), F.lit("/"))


def parent_folder(c: str | Column) -> Column:
    """What precedes the last slash if that isn't the first character; else empty."""
    return F.regexp_extract(slashes(c), r"(?s)^(.+)/[^/]*$", 1)


def base_name(c: str | Column) -> Column:
    return F.substring_index(slashes(c), "/", -1)


# File suffixes by kind. Fixed values.
PHOTO_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tiff", "tif")
VIDEO_SUFFIXES = ("mp4", "m4v", "mov", "webm", "mkv", "avi", "mts", "m2ts", "m2t", "mpg", "mpeg", "wmv", "flv", "3gp")
AUDIO_SUFFIXES = ("mp3", "wav", "flac", "ogg", "m4a", "aac", "wma")
#: Photos that a catalog knows but a scan doesn't take in.
NOT_SCANNED = ("webp", "tiff", "tif")


def media_kind(c: str | Column) -> Column:
    """photo, video or audio by the file name's extension; null for others."""
    ext = ascii_lower(F.regexp_extract(base_name(c), r"\.([^.]+)$", 1))
    return (
        F.when(ext.isin(*PHOTO_SUFFIXES), "photo")
        .when(ext.isin(*VIDEO_SUFFIXES), "video")
        .when(ext.isin(*AUDIO_SUFFIXES), "audio")
    )


def thumbnail_path(content_hash: str | Column, size: int = 256) -> Column:
    h = _col(content_hash)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.concat(h, F.lit(f"_{size}.jpg")))


def path_penalty(c: str | Column) -> Column:
    """How untidy a path is: 10 for each sign of a copy in each segment, 1 for each ``%HH``."""
    signs = ["(?<![0-9a-z])copy(?![0-9a-z])", "(?<![0-9a-z])export(?![0-9a-z])", "(?<![0-9a-z])(?:tmp|temp)(?![0-9a-z])", r"\([123]\)"]
    penalty = lambda s: reduce(lambda a, b: a + b, (F.when(F.rlike(s, F.lit(p)), 10).otherwise(0) for p in signs))
    by_segment = F.aggregate(F.split(ascii_lower(c), r"[/\\]"), F.lit(0), lambda acc, s: acc + penalty(s))
    return by_segment + F.regexp_count(_col(c), F.lit("%[0-9A-Fa-f]{2}"))


def is_generic_folder(c: str | Column) -> Column:
    """Names that cameras and phones give: they say nothing about an event."""
    t = trim_space(c)
    return (t == "") | ascii_lower(t).isin("dcim", "camera", "pictures", "photos", "images") | F.rlike(t, F.lit("^[0-9]+$")) | (F.length(t).between(4, 12) & F.rlike(t, F.lit("^[0-9]{3}[0-9A-Za-z_]+$")))


def relative_to(c: str | Column, root: str) -> Column:
    """The path below ``root``, or the path itself if it isn't below."""
    base = root.replace("\\", "/").rstrip("/") + "/"
    path = slashes(c)
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(_col(c))


#: What cameras write as a caption. Fixed values.
CAMERA_CAPTIONS = ("DCF 1.0", "CAMERA", "Exif_JPEG_PICTURE", "OLYMPUS DIGITAL CAMERA", "MINOLTA DIGITAL CAMERA", "SONY DSC", "SAMSUNG DIGITAL CAMERA", "DIGITAL CAMERA", "NIKON DIGITAL CAMERA", "--------", "+", ",")


def is_usable_caption(c: str | Column) -> Column:
    """Captions of two characters or more that hold a letter or digit and aren't what cameras write."""
    t = trim_space(c)
    return (F.length(t) >= 2) & F.rlike(t, F.lit(r"[\p{L}\p{N}]")) & ~t.isin(*CAMERA_CAPTIONS)


def valid_text(c: str | Column) -> Column:
    """Bytes as text, each invalid part of UTF-8 replaced by U+FFFD."""
    return F.make_valid_utf8(_col(c).cast("string"))


# ---------------------------------------------------------------- dates


def to_time(c: str | Column) -> Column:
    return F.timestamp_seconds(_col(c))


def year_of(c: str | Column) -> Column:
    return F.year(to_time(c))


def month_of(c: str | Column) -> Column:
    return F.month(to_time(c))


def format_date(c: str | Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` in UTC, empty for 0."""
    return F.when(_col(c) == 0, "").otherwise(F.date_format(to_time(c), "yyyy:MM:dd HH:mm:ss"))


def parse_date(c: str | Column) -> Column:
    """Seconds of ``Y M D [h m s]`` with any single separators, years 1800 to 9999; 0 on failure.

    A day up to 31 is accepted in every month and rolls over into the next one.
    """
    pattern = r"^\s*(\d{4})\D(\d{1,2})\D(\d{1,2})(?:\D(\d{1,2})\D(\d{1,2})\D(\d{1,2}))?\s*$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(_col(c), pattern, k), F.lit("")).cast("int"), F.lit(0))
    y, mo, d, h, mi, s = (part(k) for k in range(1, 7))
    good = y.between(1800, 9999) & mo.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (s <= 59)
    days = F.datediff(F.make_date(F.when(good, y).otherwise(1970), F.when(good, mo).otherwise(1), F.lit(1)), F.lit("1970-01-01").cast("date")) + d - 1
    return F.when(good, days.cast("long") * 86400 + h * 3600 + mi * 60 + s).otherwise(F.lit(0).cast("long"))


def parse_exif_date(c: str | Column) -> Column:
    """Seconds of ``YYYY:MM:DD HH:MM:SS`` (``:`` or ``-`` in the date); null unless it is a calendar date."""
    text = F.regexp_replace(_col(c), r"^(\d{4})[:-](\d{2})[:-](\d{2}) ", "$1-$2-$3 ")
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def parse_compact_date(c: str | Column) -> Column:
    """Seconds of ``YYYYMMDDThhmmss``, taken as UTC, whatever follows; null unless it is a calendar date."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(_col(c), 1, 15), F.lit("yyyyMMdd'T'HHmmss")))


def shift_date(c: str | Column, seconds: int) -> Column:
    return F.when(_col(c) != 0, _col(c) + seconds).otherwise(F.lit(0).cast("long"))


def month_bounds(year: Column, month: Column) -> tuple[Column, Column]:
    """First and last second of a month in UTC."""
    first = F.make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.unix_timestamp(first), F.unix_timestamp(F.add_months(first, 1).cast("timestamp")) - 1


# ---------------------------------------------------------------- geometry


def is_located(has_gps: str | Column = "has_gps", lat: str | Column = "latitude", lon: str | Column = "longitude") -> Column:
    """Flag set, finite, and in range; never null."""
    a, o = _col(lat), _col(lon)
    return F.coalesce(_col(has_gps) & ~F.isnan(a) & ~F.isnan(o) & a.between(-90, 90) & o.between(-180, 180), F.lit(False))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def mercator_pixel(lat: str | Column, lon: str | Column, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    size = float(tile * 2**zoom)
    a = F.radians(F.least(F.lit(85.05112878), F.greatest(F.lit(-85.05112878), _col(lat))))
    return (_col(lon) + 180) / 360 * size, (1 - F.log(F.tan(a) + 1 / F.cos(a)) / 3.141592653589793) / 2 * size


def iou(a: str, b: str, inclusive: bool = False) -> Column:
    """Overlap of two boxes given as structs x, y, width, height; ``inclusive`` counts edges as pixels."""
    one = 1.0 if inclusive else 0.0
    x1, y1, w1, h1 = (F.col(f"{a}.{n}") for n in ("x", "y", "width", "height"))
    x2, y2, w2, h2 = (F.col(f"{b}.{n}") for n in ("x", "y", "width", "height"))
    w = F.greatest(F.lit(0.0), F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2) + one)
    h = F.greatest(F.lit(0.0), F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2) + one)
    union = (w1 + one) * (h1 + one) + (w2 + one) * (h2 + one) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


# ---------------------------------------------------------------- vectors


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product, summed in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Inner product of unit vectors as a float, which is what thresholds compare with."""
    return dot(a, b).cast("float")


def normalise(v: str | Column) -> Column:
    """The vector divided by its length; zeros if that is 1e-12 or less."""
    norm = F.sqrt(dot(v, v))
    return F.transform(_col(v), lambda x: F.when(norm > MIN_NORM, x.cast("double") / norm).otherwise(0.0))


def is_healthy(v: str | Column, dim: int) -> Column:
    """Right length, finite, and not zero."""
    finite = F.forall(_col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(_col(v)) == dim) & finite & (dot(v, v) > 1e-20), F.lit(False))


def register(spark) -> None:
    """SQL functions for users: haversine_km and ascii_lower as temporary SQL functions."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ascii_lower(s STRING) RETURNS STRING RETURN translate(s, '{UPPER}', '{LOWER}')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN "
        f"2 * {EARTH_RADIUS_KM} * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
    )
