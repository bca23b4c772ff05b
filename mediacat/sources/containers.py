"""Headers of video and audio files, as a struct column over rows of files.

Like EXIF, these are the one step that no built-in function expresses. A reader seeks to the
headers it needs, in the bytes Spark has read or in the file itself where it is too large for
one value. Ranges, places and defaults are Columns.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F

_RAW = "width int, height int, duration double, date_taken long, audio_artist string, audio_title string, audio_album string, audio_genre string, codec string, bitrate int, channels int, sample_rate int, orientation int, latitude double, longitude double, altitude double"
_NAMES = [x.split()[0] for x in _RAW.split(", ")]
#: The most that is read of one text field, in bytes.
MOST_TEXT = 64 * 1024

# Fixed values of the formats: names of codecs, tags of the text fields, element numbers, rates.
_MP4_CODECS = {b"avc1": "h264", b"hvc1": "h265", b"hev1": "h265", b"vp09": "vp9", b"av01": "av1", b"mp4a": "aac", b"alac": "alac", b"jpeg": "mjpeg", b"mjpg": "mjpeg"}
_MP4_TEXTS = {b"\xa9nam": "audio_title", b"titl": "audio_title", b"\xa9ART": "audio_artist", b"aART": "audio_artist", b"\xa9alb": "audio_album", b"\xa9gen": "audio_genre", b"gnre": "audio_genre"}
_ID3_TEXTS = {"TIT2": "audio_title", "TPE1": "audio_artist", "TALB": "audio_album", "TCON": "audio_genre", "TT2": "audio_title", "TP1": "audio_artist", "TAL": "audio_album", "TCO": "audio_genre"}
_COMMENTS = {"TITLE": "audio_title", "ARTIST": "audio_artist", "ALBUM": "audio_album", "GENRE": "audio_genre"}
_EBML_CODECS = {"V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "A_OPUS": "opus", "A_VORBIS": "vorbis"}
_SEGMENT, _INFO, _TRACKS, _TRACK, _VIDEO, _AUDIO = 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0xE1
_MPEG_RATES = {3: 1, 2: 2, 0: 4}
_MPEG_BITRATES = {True: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), False: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
#: Seconds from 1904 and from 2001 to 1970: where the clocks of MP4 and Matroska begin.
_SINCE_1904, _SINCE_2001 = 2082844800, 978307200


def _at(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def _unpack(f: BinaryIO, at: int, form: str) -> tuple:
    return struct.unpack(form, _at(f, at, struct.calcsize(form)))


def _iso6709(text: str) -> tuple[float, ...] | None:
    """Latitude, longitude and altitude of ``+52.5+013.4+034/``; the first sign begins it."""
    found = re.search(r"([+-][0-9.]+)([+-][0-9.]+)([+-][0-9.]+)?", text)
    try:
        return tuple(float(x or 0) for x in found.groups()) if found else None
    except ValueError:
        return None


def _rated(out: dict, size: int) -> dict:
    """``out`` with the mean bit rate where the length is known."""
    if out.get("duration", 0) > 0:
        out["bitrate"] = int(size * 8 / out["duration"])
    return out


# ---------------------------------------------------------------- MP4, MOV, M4V, M4A


def _boxes(f: BinaryIO, at: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """``(names from the outermost, first byte, end)`` of the boxes that hold what is read."""
    inside = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"meta", b"ilst")
    while at + 8 <= end:
        (size, name), head = _unpack(f, at, ">I4s"), 8
        if size == 1:
            (size,), head = _unpack(f, at + 8, ">Q"), 16
        size = size or end - at
        if size < head:
            return
        first, last = at + head, min(at + size, end)
        yield (*path, name), first, last
        if name in inside or path[-1:] == (b"ilst",):
            # A meta box has version and flags first, but not in QuickTime's files.
            plain = name != b"meta" or _at(f, first + 4, 4) in (b"hdlr", b"keys", b"ilst")
            yield from _boxes(f, first + (0 if plain else 4), last, (*path, name))
        at += size


def _mp4_keys(f: BinaryIO, at: int, end: int) -> dict[bytes, str]:
    """Names of the numbered items of an ``ilst`` box."""
    names, (n,) = {}, _unpack(f, at + 4, ">I")
    at += 8
    for k in range(1, n + 1):
        if at + 8 > end:
            break
        (size,) = _unpack(f, at, ">I")
        if not 8 <= size <= min(end - at, 1032):
            break
        names[struct.pack(">I", k)] = _at(f, at + 8, size - 8).decode("utf-8", "replace")
        at += size
    return names


def mp4(f: BinaryIO, size: int, audio: bool) -> dict:
    """The first video track with a size gives it, the last its codec; sound comes from the first track that has some."""
    out: dict[str, object] = {"codec": "aac" if audio else "h264"}
    tracks: list[dict] = []
    keys: dict[bytes, str] = {}
    place = None
    for path, first, last in _boxes(f, 0, size):
        name = path[-1]
        of = tracks[-1] if tracks and b"trak" in path else {}
        if name == b"trak":
            tracks.append({})
        elif name == b"mvhd":
            made, scale, units = (_unpack(f, first + 4, ">Q8xIQ") if _at(f, first, 1) == b"\1" else _unpack(f, first + 4, ">I4xII"))
            if scale:
                out["duration"] = units / scale
            if made:
                out["date_taken"] = made - _SINCE_1904
        elif name == b"tkhd":
            a, b, _, c, d, *_, w, h = _unpack(f, first + (52 if _at(f, first, 1) == b"\1" else 40), ">9i2I")
            of["orientation"] = 6 if b > 0 > c else 8 if b < 0 < c else 3 if a < 0 and d < 0 else 1
            if w >> 16 and h >> 16:
                of["size"] = (w >> 16, h >> 16)
        elif name == b"hdlr" and b"trak" in path and b"meta" not in path:
            of["kind"] = _at(f, first + 8, 4)
        elif name == b"stsd" and last - first >= 16:
            entry_size, entry = _unpack(f, first + 8, ">I4s")
            codec = _MP4_CODECS.get(entry)
            of["codec"] = codec
            sound = codec in ("aac", "alac")
            kind = of.get("kind") or (b"soun" if sound else b"vide" if codec else b"")
            if kind == b"vide" and entry_size >= 36:
                w, h = _unpack(f, first + 40, ">HH")
                if w and h:
                    of.setdefault("size", (w, h))
            elif kind == b"soun" and entry_size >= 36:
                of["channels"], of["sample_rate"] = _unpack(f, first + 32, ">H6xH")
        elif name == b"keys" and last - first >= 8:
            keys = _mp4_keys(f, first, last)
        elif name == b"data" and path[-3:-2] == (b"ilst",) and 8 <= last - first <= MOST_TEXT + 8:
            item, text = path[-2], _at(f, first + 8, last - first - 8).decode("utf-8", "replace")
            if item in _MP4_TEXTS:
                out[_MP4_TEXTS[item]] = text
            elif keys.get(item) == "com.apple.quicktime.location.ISO6709" or item in (b"\xa9xyz", b"xyz "):
                place = _iso6709(text) or place
        elif name in (b"\xa9xyz", b"xyz ") and path[-2:-1] != (b"ilst",):
            place = _iso6709(_at(f, first, min(last - first, 1024)).decode("latin-1")) or place
        elif name == b"loci" and last - first >= 18:
            # Language, a name ended by zero, a role, then 16.16 numbers: longitude, latitude, altitude.
            body = _at(f, first + 6, min(last - first - 6, 1024))
            wide = body[:2] in (b"\xfe\xff", b"\xff\xfe")
            end = next((k + 2 for k in range(0, len(body) - 1, 2) if body[k : k + 2] == b"\0\0"), None) if wide else body.find(b"\0") + 1
            if end and end + 13 <= len(body):
                lon, lat, alt = (x / 65536 for x in struct.unpack_from(">3i", body, end + 1))
                place = (lat, lon, alt)
    for t in tracks:
        kind = t.get("kind", b"")
        if not audio and (kind == b"vide" or (not kind and "size" in t)):
            if "width" not in out and "size" in t:
                out["width"], out["height"] = t["size"]
            if t.get("orientation", 1) != 1:
                out["orientation"] = t["orientation"]
            out["codec"] = t.get("codec") or out["codec"]
        elif kind == b"soun":
            if "channels" not in out and t.get("channels"):
                out["channels"], out["sample_rate"] = t["channels"], t["sample_rate"]
            out["codec"] = (t.get("codec") if audio else None) or out["codec"]
    if place:
        out["latitude"], out["longitude"], out["altitude"] = place
    return _rated(out, size)


# ---------------------------------------------------------------- WebM, MKV


def _number(f: BinaryIO, at: int, keep: bool) -> tuple[int, int]:
    """A number of variable length and the place behind it; with ``keep`` its length bits stay."""
    head = _at(f, at, 1)
    if not head or not head[0]:
        raise ValueError("no element")
    n = 9 - head[0].bit_length()
    value = int.from_bytes(_at(f, at, n))
    return value if keep else value & ((1 << 7 * n) - 1), at + n


def _elements(f: BinaryIO, at: int, end: int, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """``(numbers from the outermost, first byte, end)``; one of unknown size ends with what holds it."""
    while at < end:
        try:
            name, at = _number(f, at, True)
            start = at
            size, at = _number(f, at, False)
        except ValueError:
            return
        unknown = size == (1 << 7 * (at - start)) - 1
        last = end if unknown else min(at + size, end)
        yield (*path, name), at, last
        if name in (_SEGMENT, _INFO, _TRACKS, _TRACK, _VIDEO, _AUDIO):
            yield from _elements(f, at, last, (*path, name))
            if path == (_SEGMENT,) and name == _TRACKS:
                return  # Info comes before; what follows are clusters
        at = last


def webm(f: BinaryIO, size: int, audio: bool) -> dict:
    """A video track's codec goes before that of a sound track."""
    out: dict[str, object] = {"codec": "vp9"}
    scale, units, codecs = 1_000_000, 0.0, []
    for path, first, last in _elements(f, 0, size):
        name, body = path[-1], _at(f, first, min(last - first, 1024))
        if name == 0x2AD7B1:
            scale = int.from_bytes(body)
        elif name == 0x4489 and len(body) in (4, 8):
            (units,) = struct.unpack(">f" if len(body) == 4 else ">d", body)
        elif name == 0x4461 and len(body) == 8:
            out["date_taken"] = int.from_bytes(body, signed=True) // 10**9 + _SINCE_2001
        elif name == 0x86 and path[-2:-1] == (_TRACK,):
            codecs += [v for k, v in _EBML_CODECS.items() if body.decode("ascii", "replace").startswith(k)]
        elif path[-2:-1] == (_VIDEO,) and name in (0xB0, 0xBA):
            out.setdefault("width" if name == 0xB0 else "height", int.from_bytes(body))
        elif path[-2:-1] == (_AUDIO,) and name == 0x9F:
            out.setdefault("channels", int.from_bytes(body))
        elif path[-2:-1] == (_AUDIO,) and name == 0xB5 and len(body) in (4, 8):
            out.setdefault("sample_rate", int(struct.unpack(">f" if len(body) == 4 else ">d", body)[0]))
    out["codec"] = next((c for c in codecs if c[0] == "v" and c != "vorbis" or c == "av1"), codecs[0] if codecs else "vp9")
    out["duration"] = units * scale / 1e9
    return _rated(out, size)


# ---------------------------------------------------------------- AVI, WAV


def _chunks(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = _unpack(f, at, "<4sI")
        if name == b"LIST":
            yield from _chunks(f, at + 12, min(at + 8 + size, end))
        else:
            yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def avi(f: BinaryIO, size: int, audio: bool) -> dict:
    for name, first, _ in _chunks(f, 12, size):
        if name == b"avih":
            micros, frames, width, height = _unpack(f, first, "<I12xI12xII")
            return _rated({"codec": "avi", "width": width, "height": height, "duration": frames * micros / 1e6}, size)
    return {"codec": "avi"}


def wav(f: BinaryIO, size: int, audio: bool) -> dict:
    """What a broken size claims beyond the end of the file doesn't count."""
    out, rate = {"codec": "pcm"}, 0
    for name, first, last in _chunks(f, 12, size):
        if name == b"fmt ":
            out["channels"], out["sample_rate"], rate = _unpack(f, first, "<2xHII")
            out["bitrate"] = rate * 8
        elif name == b"data":
            if rate:
                out["duration"] = (last - first) / rate
            break
    return out


# ---------------------------------------------------------------- MP3, FLAC, OGG


def _synchsafe(b: bytes) -> int:
    return sum((x & 0x7F) << 7 * k for k, x in enumerate(reversed(b)))


def _id3(f: BinaryIO) -> tuple[dict, int]:
    """The text frames of an ID3v2 tag and where the sound begins."""
    head = _at(f, 0, 10)
    if head[:3] != b"ID3" or len(head) < 10:
        return {}, 0
    version, flags, end = head[3], head[5], 10 + _synchsafe(head[6:10])
    wide = 4 if version >= 3 else 3
    frame = 10 if version >= 3 else 6
    at, out = 10, {}
    if flags & 0x40 and version >= 3:
        size = _at(f, at, 4)
        at += _synchsafe(size) if version == 4 else int.from_bytes(size) + 4
    while at + frame <= end:
        h = _at(f, at, frame)
        name, size = h[:wide].decode("latin-1"), h[wide : 2 * wide]
        n = _synchsafe(size) if version == 4 else int.from_bytes(size)
        if not name.strip("\0") or not n or at + frame + n > end:
            break
        if name in _ID3_TEXTS and n <= MOST_TEXT:
            body = _at(f, at + frame, n)
            kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            out[_ID3_TEXTS[name]] = body[1:].decode(kind, "replace").split("\0")[0]
        at += frame + n
    return out, end


def mp3(f: BinaryIO, size: int, audio: bool) -> dict:
    out, start = _id3(f)
    out["codec"] = "mp3"
    head = _at(f, start, 4096)
    for i in range(len(head) - 4):
        if head[i] != 0xFF or head[i + 1] < 0xE0:
            continue
        version, layer = head[i + 1] >> 3 & 3, head[i + 1] >> 1 & 3
        rate, base, mono = head[i + 2] >> 4, head[i + 2] >> 2 & 3, head[i + 3] >> 6 == 3
        if version == 1 or layer != 1 or not 0 < rate < 15 or base == 3:
            continue
        first = version == 3
        out |= {"sample_rate": (44100, 48000, 32000)[base] // _MPEG_RATES[version], "bitrate": _MPEG_BITRATES[first][rate - 1] * 1000, "channels": 1 if mono else 2}
        side = i + 4 + {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}[first, mono]
        if head[side : side + 4] in (b"Xing", b"Info") and side + 12 <= len(head) and head[side + 7] & 1:
            out["duration"] = int.from_bytes(head[side + 8 : side + 12]) * (1152 if first else 576) / out["sample_rate"]
        if not out.get("duration"):
            out["duration"] = (size - start) * 8 / out["bitrate"]
        break
    return out


def _comments(body: bytes) -> dict:
    out, at = {}, 4 + int.from_bytes(body[:4], "little")
    (n,) = struct.unpack_from("<I", body, at)
    at += 4
    while n and at + 4 <= len(body):
        (size,) = struct.unpack_from("<I", body, at)
        key, found, text = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        if found and key.upper() in _COMMENTS:
            out[_COMMENTS[key.upper()]] = text
        at, n = at + 4 + size, n - 1
    return out


def flac(f: BinaryIO, size: int, audio: bool) -> dict:
    at = _id3(f)[1]
    if _at(f, at, 4) != b"fLaC":
        raise ValueError("no FLAC file")
    at, last, out = at + 4, False, {"codec": "flac"}
    while not last and at + 4 <= size:
        head = _at(f, at, 4)
        kind, last, n = head[0] & 0x7F, head[0] >= 0x80, int.from_bytes(head[1:])
        if kind == 0:
            (bits,) = _unpack(f, at + 14, ">Q")
            rate, samples = bits >> 44, bits & ((1 << 36) - 1)
            out |= {"sample_rate": rate, "channels": (bits >> 41 & 7) + 1}
            if rate and samples:
                out["duration"] = samples / rate
        elif kind == 4:
            out |= _comments(_at(f, at + 4, n))
        at += 4 + n
    return _rated(out, size)


def ogg(f: BinaryIO, size: int, audio: bool) -> dict:
    """The length is estimated from the bit rate, 128,000 where none is named."""
    out: dict[str, object] = {"codec": "vorbis"}
    page = _at(f, 0, 27 + 255)
    if page[:4] != b"OggS" or len(page) < 27:
        raise ValueError("no OGG file")
    body = _at(f, 27 + page[26], sum(page[27 : 27 + page[26]]))
    if body[:7] == b"\x01vorbis" and len(body) >= 28:
        out["channels"], out["sample_rate"], rate = struct.unpack_from("<BI4xi", body, 11)
        if rate > 0:
            out["bitrate"] = rate
    elif body[:8] == b"OpusHead" and len(body) >= 19:
        out |= {"codec": "opus", "channels": body[9], "sample_rate": struct.unpack_from("<I", body, 12)[0]}
    if out.get("sample_rate"):
        out.setdefault("bitrate", 128_000)
        out["duration"] = size * 8 / out["bitrate"]
    return out


READERS: dict[str, Callable[[BinaryIO, int, bool], dict]] = {"mp4": mp4, "m4v": mp4, "mov": mp4, "m4a": mp4, "webm": webm, "mkv": webm, "avi": avi, "mp3": mp3, "flac": flac, "wav": wav, "ogg": ogg}


# ---------------------------------------------------------------- columns


def opened(path: str) -> BinaryIO:
    """A file by its path or URI, for reading with seeks, from any file system that Arrow knows."""
    home, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    return home.open_input_file(name)


def container_fields(path: str, content: bytes | None) -> dict | None:
    """The raw fields of a file, by its suffix; None where there is no reader or the file is broken."""
    suffix = path.rpartition(".")[2].lower()
    if suffix not in READERS:
        return None
    try:
        with io.BytesIO(content) if content is not None else opened(path) as f:
            out = READERS[suffix](f, f.seek(0, 2) or f.tell(), suffix == "m4a")
    except (struct.error, ValueError, IndexError, OverflowError, RecursionError):
        return None
    fit = lambda v: v if not isinstance(v, int) or abs(v) < 1 << 31 else None
    return {k: v if k == "date_taken" else fit(v) for k, v in out.items()}


_INTS = {x.split()[0]: "Int64" if "long" in x else "Int32" for x in _RAW.split(", ") if x.endswith((" int", " long"))}


def _read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for paths, contents in batches:
        rows = [(p and container_fields(p, c)) or {} for p, c in zip(paths, contents, strict=True)]
        yield pd.DataFrame([{n: r.get(n) for n in _NAMES} for r in rows], columns=_NAMES).astype(_INTS)


def container(path: Column, content: Column) -> Column:
    """The header struct of a file; where ``content`` is null the file is opened by its path.

    Absent texts are empty, absent numbers 0, an absent orientation is 1. A place counts if
    both coordinates are in range and not both zero. Photos, unknown and broken files give
    the defaults, as does a null path; ``date_taken`` 0 stands for none.
    """
    return F.transform(F.array(F.pandas_udf(_read, _RAW)(path, content)), _cleaned)[0]


def _cleaned(raw: Column) -> Column:
    lat, lon = raw["latitude"], raw["longitude"]
    placed = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ((lat != 0) | (lon != 0)), F.lit(False))
    texts = [F.coalesce(raw[c], F.lit("")).alias(c) for c in ("codec", "audio_artist", "audio_title", "audio_album", "audio_genre")]
    numbers = [F.coalesce(raw[c], F.lit(0)).alias(c) for c in ("width", "height", "duration", "date_taken", "bitrate", "channels", "sample_rate")]
    at = [F.when(placed, F.coalesce(raw[c], F.lit(0.0))).otherwise(0.0).alias(c) for c in ("latitude", "longitude", "altitude")]
    return F.struct(*texts, *numbers, F.coalesce(raw["orientation"], F.lit(1)).alias("orientation"), placed.alias("has_gps"), *at)


def _digests(paths: pd.Series) -> pd.Series:
    def one(path: str) -> str:
        digest = hashlib.sha256()
        with opened(path) as f:
            while part := f.read(1 << 20):
                digest.update(part)
        return digest.hexdigest()

    return pd.Series([one(p) if isinstance(p, str) else None for p in paths], dtype="object")


def streamed_hash(path: Column) -> Column:
    """SHA-256 of the files of these paths, read in parts; null for null."""
    return F.pandas_udf(_digests, "string")(path)
