"""Personal data: patterns propose spans, checksums confirm them, context moves the score.

Kinds, in the order in which they are listed: ``email``, ``ip``, ``card``, ``phone`` (the
base kinds, whose spans never depend on context), then ``iban`` and ``ssn``, which the
method adds. Within a kind, matches are leftmost and don't overlap, and a match that its
validator rejects is dropped without another try inside it. Each span has a score from
0 to 1: a prior of its kind, raised when a validator with a checksum confirmed it and when
one of the kind's context words stands within ``CONTEXT`` characters before it or after
it, and lowered when a word of the opposite meaning does. Added kinds count only from
``ADDED_SCORE`` on. Offsets are in code points, ends exclusive.

Every scanner is linear in the text: the patterns are anchored at the start of a run of
their characters, so that a run that fails isn't tried again from each of its places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
CONTEXT = 40
ADDED_SCORE = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never ends inside a run of digits, so a new one starts where a run starts.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: kind -> (prior, words that raise the score, words that lower it)
SCORES = {
    "email": (0.8, ("email", "e-mail", "mail", "contact"), ("example", "noreply")),
    "ip": (0.5, ("ip", "address", "host", "server"), ("version", "release")),
    "card": (0.5, ("card", "visa", "mastercard", "payment", "credit"), ("isbn", "order", "serial")),
    "phone": (0.6, ("phone", "tel", "call", "mobile", "fax"), ("id", "version")),
    "iban": (0.4, ("iban", "account", "bank", "konto"), ("sku", "serial")),
    "ssn": (0.4, ("ssn", "social", "security"), ("order", "part", "isbn")),
}
_WORD = re.compile(r"[a-z][a-z-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        yield from _emails(text)
    elif kind == "ip":
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in m[0].split("."))):
                yield m.span()
    elif kind == "card":
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                yield m.span()
    elif kind == "phone":
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m[0])) <= 15:
                    yield m.span()
    elif kind == "iban":
        for m in _IBAN.finditer(text):
            if mod97(m[0]):
                yield m.span()
    else:
        for m in _SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield m.span()


def score(kind: str, text: str, start: int, end: int) -> float:
    prior, up, down = SCORES[kind]
    near = set(_WORD.findall((text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()))
    value = prior + 0.3 * (kind in ("card", "iban")) + 0.3 * bool(near & set(up)) - 0.2 * bool(near & set(down))
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` of every span, by kind as listed, then by start."""
    found = [(k, s, e, score(k, text, s, e)) for k in KINDS for s, e in _matches(k, text)]
    return [x for x in found if x[0] in BASE_KINDS or x[3] >= ADDED_SCORE]


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, found)``: the spans in each row's whole text, an array of
    ``(kind, start, end, score)``; empty for null and empty texts."""

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "score")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in find(t)] if t else [] for t in texts])

    return df.select(id_col, spans(F.col(text_col).cast("string")).alias("found"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, the hash of the base spans, all spans and their scores of :func:`personal_data`."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return df.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"))
