"""Files of every container, put together byte by byte, with what they say of themselves."""

import hashlib
import struct

import pytest

from mediacat.sources import containers, files


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, name) + body


def mvhd(made, scale, units, version=0):
    form = ">4xIIII" if version == 0 else ">B3xQQIQ"
    return box(b"mvhd", struct.pack(form, *((made, 0, scale, units) if version == 0 else (1, made, 0, scale, units))), b"\0" * 80)


def track(kind, entry, size=(0, 0), matrix=(1, 0, 0, 0, 1)):
    a, b, _, c, d = matrix
    tkhd = box(b"tkhd", b"\0" * 40, struct.pack(">9i2I", a, b, 0, c, d, 0, 0, 0, 1, size[0] << 16, size[1] << 16))
    stsd = box(b"stsd", struct.pack(">II", 0, 1), entry)
    return box(b"trak", tkhd, box(b"mdia", box(b"hdlr", b"\0" * 8, kind, b"\0" * 12), box(b"minf", box(b"stbl", stsd))))


VIDEO = box(b"hvc1", b"\0" * 24, struct.pack(">HH", 640, 360), b"\0" * 50)
SOUND = box(b"mp4a", b"\0" * 16, struct.pack(">HHHHI", 2, 16, 0, 0, 44100 << 16))
ITEM = lambda name, text: box(name, box(b"data", struct.pack(">II", 1, 0), text))


def mp4_file(version=0, meta=b""):
    moov = box(b"moov", mvhd(containers._SINCE_1904 + 1_700_000_000, 1000, 10_000, version), track(b"soun", SOUND), track(b"vide", VIDEO, (1920, 1080), (0, 1, 0, -1, 0)), meta)
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + 100) + b"\0" * 100  # a box with a 64-bit size comes first
    return box(b"ftyp", b"isom\0\0\0\0") + wide + moov


def vint(n, body):
    return n + (len(body) | 1 << 28).to_bytes(4) + body


def webm_file():
    info = vint(b"\x15\x49\xa9\x66", vint(b"\x2a\xd7\xb1", (1_000_000).to_bytes(3)) + vint(b"\x44\x89", struct.pack(">d", 12_500.0)) + vint(b"\x44\x61", (5 * 10**9).to_bytes(8)))
    video = vint(b"\xae", vint(b"\x86", b"V_AV1") + vint(b"\xe0", vint(b"\xb0", (1280).to_bytes(2)) + vint(b"\xba", (720).to_bytes(2))))
    sound = vint(b"\xae", vint(b"\x86", b"A_OPUS") + vint(b"\xe1", vint(b"\xb5", struct.pack(">f", 48000.0)) + vint(b"\x9f", b"\2")))
    cluster = b"\x1f\x43\xb6\x75\xff" + b"\0" * 30  # of unknown size
    return vint(b"\x1a\x45\xdf\xa3", b"\x42\x86\x81\x01") + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + info + vint(b"\x16\x54\xae\x6b", sound + video) + cluster


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_file():
    avih = chunk(b"avih", struct.pack("<10I", 33333, 0, 0, 0, 300, 0, 1, 0, 1280, 720) + b"\0" * 16)
    return b"RIFF\0\0\0\0AVI " + chunk(b"LIST", b"hdrl" + avih)


def wav_file(claimed=None):
    body = b"\0" * 176400
    fmt = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16))
    return b"RIFF\0\0\0\0WAVE" + chunk(b"odd ", b"x") + fmt + b"data" + struct.pack("<I", claimed or len(body)) + body


def synchsafe(n):
    return bytes(n >> 7 * k & 0x7F for k in (3, 2, 1, 0))


def mp3_file(version=3, xing=False):
    frame = lambda n, t: n + (synchsafe(len(t)) if version == 4 else struct.pack(">I", len(t))) + b"\0\0" + t
    tags = frame(b"TIT2", b"\0Caf\xe9") + frame(b"TPE1", b"\1" + "Ünë".encode("utf-16")) + frame(b"TALB", b"\3Album " + b"x" * 200) + frame(b"TCON", b"\2" + "Jazz".encode("utf-16-be")) + b"\0" * 30
    sound = b"\xff\xfb\x90\x00" + b"\0" * 32 + (b"Xing" + struct.pack(">II", 1, 441) if xing else b"") + b"\0" * 16000
    return b"ID3" + bytes([version, 0, 0]) + synchsafe(len(tags)) + tags + sound


def comments(*texts):
    return struct.pack("<I", 3) + b"ven" + struct.pack("<I", len(texts)) + b"".join(struct.pack("<I", len(t)) + t for t in texts)


def flac_file():
    bits = 48000 << 44 | 1 << 41 | 15 << 36 | 480000
    block = lambda kind, body: bytes([kind]) + len(body).to_bytes(3) + body
    return b"fLaC" + block(0, b"\0" * 10 + struct.pack(">Q", bits) + b"\0" * 16) + block(0x84, comments(b"artist=Maestro", b"TITLE=Symphony", b"no key", b"ALBUM=Dreams"))


def ogg_file(body):
    return b"OggS" + b"\0" * 22 + bytes([1, len(body)]) + body + b"\0" * 1000


VORBIS = b"\x01vorbis" + struct.pack("<IBIiii", 0, 2, 44100, 0, 192000, 0) + b"\0\0"
OPUS = b"OpusHead\1\2" + struct.pack("<HIhB", 0, 48000, 0, 0)
PLACE = box(b"udta", box(b"\xa9xyz", b"\0\x12\x15\xc7+52.5000+013.2500+034.0/"))
TEXTS = box(b"udta", box(b"meta", b"\0" * 4, box(b"hdlr", b"\0" * 24), box(b"ilst", ITEM(b"\xa9nam", "Tïtle".encode()), ITEM(b"aART", b"Artist"), ITEM(b"\xa9alb", b"Album"), ITEM(b"gnre", b"Rock"))))
LOCI = box(b"udta", box(b"loci", b"\0" * 4, b"\x15\xc7", b"name\0", b"\0", struct.pack(">3i", -13 << 16, 52 << 16, 5 << 16), b"earth\0\0"))
KEY = b"com.apple.quicktime.location.ISO6709"
KEYED = box(b"meta", box(b"keys", struct.pack(">II", 0, 1), box(b"mdta", KEY)), box(b"ilst", box(struct.pack(">I", 1), box(b"data", struct.pack(">II", 1, 0), b"-33.1-070.5/"))))

FILES = {
    "a.mp4": mp4_file(meta=PLACE), "b.MOV": mp4_file(1, KEYED), "c.m4v": mp4_file(meta=LOCI), "d.m4a": box(b"moov", mvhd(0, 600, 1200), track(b"soun", SOUND), TEXTS),
    "e.webm": webm_file(), "f.avi": avi_file(), "g.wav": wav_file(), "h.wav": wav_file(2**32 - 1), "i.mp3": mp3_file(), "j.mp3": mp3_file(4, True),
    "k.flac": flac_file(), "l.ogg": ogg_file(VORBIS), "m.Ogg": ogg_file(OPUS), "n.mp4": b"junk", "o.wmv": b"whatever", "p.jpg": b"\xff\xd8\xff",
}
SIZE = {n: len(b) for n, b in FILES.items()}
WANT = {
    "a.mp4": dict(media_type="video", duration=10.0, width=1920, height=1080, codec="h265", channels=2, sample_rate=44100, orientation=6, date_taken=1_700_000_000, has_gps=True, latitude=52.5, longitude=13.25, altitude=34.0),
    "b.MOV": dict(duration=10.0, date_taken=1_700_000_000, has_gps=True, latitude=-33.1, longitude=-70.5, bitrate=int(SIZE["b.MOV"] * 8 / 10)),
    "c.m4v": dict(has_gps=True, latitude=52.0, longitude=-13.0, altitude=5.0),
    "d.m4a": dict(media_type="audio", duration=2.0, codec="aac", width=0, audio_title="Tïtle", audio_artist="Artist", audio_album="Album", audio_genre="Rock", has_gps=False),
    "e.webm": dict(duration=12.5, width=1280, height=720, codec="av1", channels=2, sample_rate=48000, date_taken=containers._SINCE_2001 + 5),
    "f.avi": dict(duration=9.9999, width=1280, height=720, codec="avi"),
    "g.wav": dict(duration=1.0, channels=2, sample_rate=44100, bitrate=1411200, codec="pcm"),
    "h.wav": dict(duration=1.0, channels=2),
    "i.mp3": dict(audio_title="Café", audio_artist="Ünë", audio_album="Album " + "x" * 200, audio_genre="Jazz", sample_rate=44100, bitrate=128000, channels=2, duration=(16036 * 8) / 128000),
    "j.mp3": dict(audio_title="Café", audio_album="Album " + "x" * 200, duration=441 * 1152 / 44100),
    "k.flac": dict(sample_rate=48000, channels=2, duration=10.0, audio_artist="Maestro", audio_title="Symphony", audio_album="Dreams", audio_genre="", codec="flac"),
    "l.ogg": dict(codec="vorbis", channels=2, sample_rate=44100, bitrate=192000, duration=SIZE["l.ogg"] * 8 / 192000),
    "m.Ogg": dict(codec="opus", channels=2, sample_rate=48000, bitrate=128000, media_type="audio"),
    "o.wmv": dict(media_type="video", duration=0.0, codec="", orientation=1),
    "p.jpg": dict(media_type="photo", date_taken=0, orientation=1),
}


@pytest.mark.parametrize("most", [files.MOST_IN_MEMORY, 10], ids=["in memory", "opened"])
def test_read_media(spark, tmp_path, most):
    for name, body in FILES.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "skipped.webp").write_bytes(b"x")
    (tmp_path / "empty.mp4").write_bytes(b"")
    rows = {r.file_name: r for r in files.read_media(spark, str(tmp_path), most=most).collect()}
    assert set(rows) == set(FILES)
    for name, body in FILES.items():
        assert (rows[name].content_hash, rows[name].file_size) == (hashlib.sha256(body).hexdigest(), len(body)), name
    for name, want in WANT.items():
        for field, value in want.items():
            got = rows[name][field]
            assert got == (pytest.approx(value) if isinstance(value, float) else value), (name, field, got)
    assert rows["n.mp4"].date_taken == rows["n.mp4"].file_modified_time  # broken: type and change only


def test_broken_files():
    """Cut at any place or with bytes overwritten, a file gives fields or none, and never an error."""
    for name, body in FILES.items():
        for k in range(0, len(body), max(1, len(body) // 150)):
            containers.container_fields(name, body[:k])
            containers.container_fields(name, body[:k] + b"\xff" * 8 + body[k + 8 :])
            containers.container_fields(name, body[:k] + b"\0" * 8 + body[k + 8 :])
