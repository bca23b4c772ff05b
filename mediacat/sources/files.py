"""Files as a source, and JSON and text as sinks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.functions.scalars import AUDIO_SUFFIXES, NOT_SCANNED, PHOTO_SUFFIXES, VIDEO_SUFFIXES, base_name, media_kind
from mediacat.sources.containers import container, streamed_hash
from mediacat.sources.exif import exif

#: Folders that a scan passes by, besides those whose name starts with a dot.
SKIPPED_FOLDERS = ("$recycle.bin", "system volume information", "thumbs", "@eadir")
#: The glob of the files that are taken in, in upper and lower case alike.
EXTENSIONS = "*.{" + ",".join("".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in e) for e in (*PHOTO_SUFFIXES, *VIDEO_SUFFIXES, *AUDIO_SUFFIXES) if e not in NOT_SCANNED) + "}"
#: Files above this many bytes, and all that Spark can't hold in one value, are opened by the task.
MOST_IN_MEMORY = 256 * 1024 * 1024


def open_folder(spark: SparkSession, path: str, recursive: bool = True, most: int = MOST_IN_MEMORY) -> DataFrame:
    """``(path, length, modificationTime, content)`` of the media files below a folder.

    ``content`` is null for files above ``most`` bytes: Spark would read them into one value,
    and can't above 2 GB. Both halves are filtered in the scan, so no large file is read.
    Spark's scan leaves out empty files, which are no media.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", EXTENSIONS).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path)
    below = F.lower(F.regexp_replace("path", r"/[^/]*$", "/"))
    skipped = reduce(lambda a, b: a | b, (F.contains(below, F.lit(f"/{s}/")) for s in SKIPPED_FOLDERS), F.rlike(below, F.lit(r"/\.[^/.][^/]*/")))
    files = files.where(~skipped)
    small = files.where(F.col("length") <= most).select("path", "length", "modificationTime", "content")
    return small.unionByName(files.where(F.col("length") > most).select("path", "length", "modificationTime", F.lit(None).cast("binary").alias("content")))


def _content_hash() -> Column:
    return F.coalesce(F.sha2("content", 256), streamed_hash(F.when(F.col("content").isNull(), F.col("path"))))


_FILE = ["file_path", "file_name", "file_size", "file_modified_time", "media_type", "content_hash"]


def _described(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path").alias("file_path"), base_name("path").alias("file_name"), F.col("length").alias("file_size"), F.unix_timestamp("modificationTime").alias("file_modified_time"), media_kind("path").alias("media_type"), _content_hash().alias("content_hash"), "path", "content"
    )


def scan_folder(spark: SparkSession, path: str, recursive: bool = True, most: int = MOST_IN_MEMORY) -> DataFrame:
    """Media files below a folder: path, name, size, modification time, kind and SHA-256, of files of any size."""
    return _described(open_folder(spark, path, recursive, most)).select(_FILE)


def read_media(spark: SparkSession, path: str, recursive: bool = True, most: int = MOST_IN_MEMORY) -> DataFrame:
    """The rows of ``scan_folder`` with what the files say of themselves: a photo's EXIF block,
    the headers of video and sound. Without a date of its own a video or sound has that of
    its last change. Photos above ``most`` bytes have no EXIF fields."""
    files = _described(open_folder(spark, path, recursive, most))
    photo = F.col("media_type") == "photo"
    files = files.withColumn("x", exif(F.when(photo, F.col("content")))).withColumn("c", container(F.when(~photo, F.col("path")), F.col("content")))
    both = ("orientation", "has_gps", "latitude", "longitude", "altitude")
    shared = [F.when(photo, F.col(f"x.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in both]
    own = F.when(F.col("c.date_taken") != 0, F.col("c.date_taken")).otherwise(F.col("file_modified_time"))
    only_photo = ("camera_make", "camera_model", "lens", "exposure_time", "f_number", "iso", "focal_length")
    only_played = ("width", "height", "duration", "codec", "bitrate", "channels", "sample_rate", "audio_artist", "audio_title", "audio_album", "audio_genre")
    return files.select(*_FILE, F.when(photo, F.col("x.date_taken")).otherwise(own).alias("date_taken"), *shared, *(f"x.{n}" for n in only_photo), *(f"c.{n}" for n in only_played))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Places of a CSV file with a header: name, admin1, country_name (or country), latitude,
    longitude and, optionally, population. Rows without a name or valid place are left out.

    ``row_no`` follows the file's order inside a file, which decides between equally near places.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*(c.lstrip("﻿").strip().lower() for c in raw.columns))
    col = lambda *names: next((F.coalesce(F.trim(F.col(n)), F.lit("")) for n in names if n in raw.columns), F.lit(""))
    lat, lon = (F.expr(f"try_cast(trim({c}) AS double)") for c in ("latitude", "longitude"))
    places = raw.select(F.monotonically_increasing_id().alias("row_no"), col("name").alias("name"), col("admin1").alias("admin1"), col("country_name", "country").alias("country"), lat.alias("latitude"), lon.alias("longitude"))
    return places.where((F.col("name") != "") & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


TAXONOMY = T.StructType([T.StructField("label_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("label_group", T.StringType()), T.StructField("threshold", T.FloatType()), T.StructField("prompts", T.ArrayType(T.StringType()))])


def read_taxonomy(spark: SparkSession, text: str, default_threshold: float = 0.24) -> DataFrame:
    """Labels of a JSON document ``{"labels": [{id, name, group, threshold?, prompts}]}``.

    ``ValueError`` for labels without id, name or prompts, repeated ids, and thresholds
    outside 0 to 1. A taxonomy is a bounded configuration, so it is parsed on the driver.
    """
    labels = json.loads(text).get("labels")
    if not isinstance(labels, list) or not labels:
        raise ValueError("no labels")
    rows, seen = [], set()
    for x in labels:
        if not isinstance(x, dict) or not all(isinstance(x.get(k), str) and x[k].strip() for k in ("id", "name")):
            raise ValueError("a label needs an id and a name")
        prompts, least = x.get("prompts"), x.get("threshold", default_threshold)
        if not isinstance(prompts, list) or not prompts or not all(isinstance(p, str) and p.strip() for p in prompts):
            raise ValueError(f"{x['id']}: prompts must be texts")
        if isinstance(least, bool) or not isinstance(least, int | float) or not 0 <= least <= 1:
            raise ValueError(f"{x['id']}: threshold must be 0 to 1")
        if x["id"] in seen:
            raise ValueError(f"{x['id']} is repeated")
        seen.add(x["id"])
        rows.append((x["id"], x["name"], str(x.get("group", "")), float(least), prompts))
    return spark.createDataFrame(rows, TAXONOMY)


def taxonomy_version(labels: DataFrame) -> str:
    """A 64-bit FNV-1a hash of the labels in order, in hex: it changes with any of them."""
    value = 0xCBF29CE484222325
    for r in labels.orderBy("label_id").collect():
        for part in (r.label_id, r.name, r.label_group, f"{r.threshold:.6f}", *r.prompts):
            for byte in part.encode() + b"\x1f":
                value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{value:016x}"


def as_json(df: DataFrame) -> DataFrame:
    """One column ``json`` with each row as an object, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
