"""EXIF fields of JPEG and PNG files, as a struct column over ``binaryFile`` rows.

The one step that no built-in function expresses, walking the tags of a file's EXIF
block, is a small function in an Arrow-batched UDF; dates, ranges and defaults are Columns.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.scalars import parse_exif_date

# Fixed values of the EXIF standard: tag numbers by directory, and sizes of the value types.
_MAIN = {0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation", 0x0132: "date_time", 0x8769: "photo_ifd", 0x8825: "gps_ifd"}
_PHOTO = {0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso", 0x9003: "date_original", 0x920A: "focal_length", 0xA434: "lens"}
_GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
_FORMATS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 9: "i", 10: "ii"}

_RAW = "camera_make string, camera_model string, lens string, date_taken_str string, exposure_time double, f_number double, iso int, focal_length double, orientation int, latitude double, longitude double, altitude double"
_NAMES = [x.split()[0] for x in _RAW.split(", ")]


def tiff_block(data: bytes) -> bytes | None:
    """The EXIF block of a JPEG or PNG file, which is laid out as a TIFF file."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        at = 8
        while at + 12 <= len(data):
            size, name = struct.unpack_from(">I4s", data, at)
            if at + 12 + size > len(data):
                return None
            if name == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    elif data.startswith(b"\xff\xd8"):
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            if data[at + 1] == 0xFF:  # fill byte
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            if data[at + 1] in (0xDA, 0xD9) or size < 2 or at + 2 + size > len(data):
                return None
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    return None


def _directory(tiff: bytes, order: str, at: int, tags: dict[int, str]) -> dict[str, object]:
    """The named tags of one directory; what points outside of the block is left out."""
    found: dict[str, object] = {}
    if at < 8 or at + 2 > len(tiff):
        return found
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, entry)
        if tag not in tags or kind not in _FORMATS or not n:
            continue
        code = _FORMATS[kind]
        size = n * struct.calcsize("=" + code)
        place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
        if place + size > len(tiff):
            continue
        if kind == 2:
            found[tags[tag]] = tiff[place : place + size].split(b"\0")[0].decode("utf-8", "replace").strip()
            continue
        values = struct.unpack_from(order + code * min(n, 8), tiff, place)
        if len(code) == 2:
            values = [a / b if b else 0.0 for a, b in zip(values[::2], values[1::2], strict=True)]
        found[tags[tag]] = list(values)
    return found


def _degrees(parts: object, ref: object) -> float | None:
    if not isinstance(parts, list) or len(parts) < 3:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if str(ref).upper() in ("S", "W") else value


def exif_fields(data: bytes | None) -> dict[str, object] | None:
    """The raw fields of a file's EXIF block; None where there is none or it is broken."""
    tiff = tiff_block(data) if data else None
    if not tiff or len(tiff) < 8 or tiff[:2] not in (b"II", b"MM"):
        return None
    order = "<" if tiff[:2] == b"II" else ">"
    mark, first = struct.unpack_from(order + "HI", tiff, 2)
    if mark != 42 or first < 8 or first + 2 > len(tiff):
        return None
    main = _directory(tiff, order, first, _MAIN)
    number = lambda of, name, default: of[name][0] if isinstance(of.get(name), list) else default
    text = lambda of, name: of[name] if isinstance(of.get(name), str) else ""
    photo = _directory(tiff, order, int(number(main, "photo_ifd", 0)), _PHOTO)
    gps = _directory(tiff, order, int(number(main, "gps_ifd", 0)), _GPS)
    altitude = float(number(gps, "alt", 0.0))
    values = [
        text(main, "camera_make"), text(main, "camera_model"), text(photo, "lens"), text(photo, "date_original") or text(main, "date_time"),
        float(number(photo, "exposure_time", 0.0)), float(number(photo, "f_number", 0.0)), int(number(photo, "iso", 0)), float(number(photo, "focal_length", 0.0)),
        int(number(main, "orientation", 1)), _degrees(gps.get("lat"), gps.get("lat_ref")), _degrees(gps.get("lon"), gps.get("lon_ref")), -altitude if number(gps, "alt_ref", 0) == 1 else altitude,
    ]
    return dict(zip(_NAMES, (None if isinstance(v, float) and not math.isfinite(v) else v for v in values), strict=True))


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for contents in batches:
        yield pd.DataFrame([exif_fields(x) or dict.fromkeys(_NAMES) for x in contents], columns=_NAMES).astype({"iso": "Int32", "orientation": "Int32"})


def exif(content: Column) -> Column:
    """The EXIF struct of a file's bytes, with defaults where a field is absent.

    Absent texts are empty, absent numbers 0, an orientation outside 1 to 8 is 1, a date that
    doesn't exist is 0. A place counts if both coordinates are in range and not both zero.
    Files without EXIF, null and broken contents give the defaults.
    """
    return F.transform(F.array(F.pandas_udf(_read, _RAW)(content)), _cleaned)[0]


def _cleaned(raw: Column) -> Column:
    lat, lon = raw["latitude"], raw["longitude"]
    placed = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ((lat != 0) | (lon != 0)), F.lit(False))
    texts = [F.coalesce(raw[c], F.lit("")).alias(c) for c in ("camera_make", "camera_model", "lens", "date_taken_str")]
    numbers = [F.coalesce(raw[c], F.lit(0)).alias(c) for c in ("exposure_time", "f_number", "iso", "focal_length")]
    at = [F.when(placed, F.coalesce(raw[c], F.lit(0.0))).otherwise(0.0).alias(c) for c in ("latitude", "longitude", "altitude")]
    date = F.coalesce(parse_exif_date(raw["date_taken_str"]), F.lit(0)).cast("long").alias("date_taken")
    return F.struct(*texts, date, *numbers, F.when(raw["orientation"].between(1, 8), raw["orientation"]).otherwise(1).alias("orientation"), placed.alias("has_gps"), *at)
