"""Secret scans over a trigram inverted index, in DataFrame operations only.

1. From each rule's regular expression a Boolean trigram query is derived: an OR of
   alternatives, each an AND of trigrams that every match contains. A rule with an
   alternative that has no trigram has no mandatory trigrams and scans every text.
2. The inverted index maps each trigram that some query names to its postings, the keys
   of the texts that contain it (lower-cased). Texts are keyed by a hash of the
   text, so copies are indexed once; a collision only adds a candidate.
3. Postings are intersected per alternative by counting. The keys of the candidates fill a
   filter of bounded size, against which the texts are read again, in place and in the same
   way at every size; on those that it lets through, each rule is verified by its
   expression, which yields spans. A text that passes by chance costs time and has no span.

Rule kinds in the order in which they are listed: ``assign``, ``access``, ``hex`` (the base
kinds) and those that the method adds. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import materialize, text_or_empty, with_maybe


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least length in characters of the whole match, or of ``group`` if it is given.
    least: int = 0
    group: int = 0


#: Runs of a class are matched with their least length at once where that can't change
#: which matches there are, because such a match takes its whole run anyway.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")
KINDS = tuple(r.kind for r in RULES)
_MOST_ALTERNATIVES = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- trigram queries

_GAP = None


def _sequences(parsed) -> list[tuple]:
    """Alternatives of what a parsed expression matches: characters, and gaps of any text."""
    done: list[tuple] = [()]
    for op, arg in parsed:
        if op is C.LITERAL:
            here = [(chr(arg),)]
        elif op is C.SUBPATTERN:
            here = _sequences(arg[-1])
        elif op is C.BRANCH:
            here = [s for branch in arg[1] for s in _sequences(branch)]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 5:
            here = [(chr(v),) for _, v in arg]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[:2] == (0, 1):
            here = [(), *_sequences(arg[2])]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            here = [(*s, _GAP) for s in _sequences(arg[2])]
        elif op is C.AT:
            here = [()]
        else:
            here = [(_GAP,)]
        joined = [a + b for a, b in product(done, here)]
        done = joined if len(joined) <= _MOST_ALTERNATIVES else [(*s, _GAP) for s in done]
    return done


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams in lower case; empty if the rule has none."""
    found = set()
    for sequence in _sequences(P.parse(pattern)):
        runs = "".join("\n\n\n" if c is _GAP else c for c in sequence).translate(str.maketrans(_UPPER, _LOWER)).split("\n\n\n")
        found.add(frozenset(r[k : k + 3] for r in runs for k in range(len(r) - 2)))
    if frozenset() in found:
        return []
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


# ---------------------------------------------------------------- index and candidates


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(trigram, key)``, distinct: the texts, from the column ``text``, that contain each trigram."""
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return texts.select(_key(F.col("text")).alias("key"), F.lower("text").alias("low")).select("key", F.explode(present).alias("trigram")).distinct()


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key)``, distinct: the texts that satisfy the query of a rule with mandatory trigrams."""
    spark = texts.sparkSession
    parts = [(r.kind, k, t, len(a)) for r in rules for k, a in enumerate(trigram_query(r.pattern)) for t in sorted(a)]
    if not parts:
        return spark.createDataFrame([], "key bigint")
    named = spark.createDataFrame(parts, "kind string, alternative int, trigram string, of int")
    index = postings(texts, sorted({t for _, _, t, _ in parts}))
    whole = index.join(F.broadcast(named), "trigram").groupBy("key", "kind", "alternative").agg(F.count("*").alias("n"), F.first("of").alias("of")).where("n = of")
    return whole.select("key").distinct()


# ---------------------------------------------------------------- verification


#: Items of a block of :func:`_emitted`.
_BLOCK = 64


def _emitted(items: Column, first: Column, move, emit, kind: str) -> Column:
    """What ``emit(state, item)``, an array, gives over a left fold of the array ``items``, joined.

    The state, an int, starts as ``first`` and ``move(state, item)`` follows it. A fold that
    appends to one array copies it at every item, so items are folded in blocks, each from
    the state before it.
    """
    none = F.from_json(F.lit("[]"), kind)
    at = lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK))
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / _BLOCK).cast("int"))
    marks = F.aggregate(
        blocks,
        F.struct(first.alias("at"), F.from_json(F.lit("[]"), "array<struct<block:int,at:int>>").alias("found")),
        lambda acc, b: F.struct(F.aggregate(at(b), acc["at"], move).alias("at"), F.concat(acc["found"], F.array(F.struct(b.alias("block"), acc["at"].alias("at")))).alias("found")),
        lambda acc: acc["found"],
    )
    block = lambda m: F.aggregate(
        at(m["block"]),
        F.struct(m["at"].alias("at"), none.alias("out")),
        lambda acc, p: F.struct(move(acc["at"], p).alias("at"), F.concat(acc["out"], emit(acc["at"], p)).alias("out")),
        lambda acc: acc["out"],
    )
    return F.flatten(F.transform(marks, block))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once even where lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


_SPANS = "array<struct<start:int,end:int,kind:string,rank:int>>"


def _spans(text: Column, rule: Rule) -> Column:
    """The spans of a rule as an array of ``(start, end, kind, rank)``.

    Matches are fenced by two characters that no rule can match (the text's own are
    replaced first, one for one); the text is split there, and places are sums of lengths.
    """
    marked = F.regexp_replace(text, F.lit(rule.pattern), F.lit("\u0001$0\u0002"))
    rank = KINDS.index(rule.kind)

    def emit(at: Column, p: Column) -> Column:
        # A piece is a match, the second fence and the text up to the next match.
        m = F.substring_index(p, "\u0002", 1)
        span = F.array(F.struct(at.alias("start"), (at + F.length(m)).alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank")))
        if not rule.least:
            return span
        return F.when(F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least, span).otherwise(F.from_json(F.lit("[]"), _SPANS))

    def spans(pieces: Column) -> Column:
        matches = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        return _let(F.struct(F.length(F.element_at(pieces, 1)).alias("at"), matches.alias("m")), lambda x: _emitted(x["m"], x["at"], lambda at, p: at + F.length(p) - 1, emit, _SPANS))

    return _let(F.split(marked, "\u0001"), spans)


def find_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the column ``found``: the spans in each row's whole text by start, then by
    kind as listed. An existing column ``found`` is replaced. Null and empty texts have none.
    """
    text = text_or_empty(text_col)
    fenced = F.contains(text, F.lit("\u0001")) | F.contains(text, F.lit("\u0002"))
    plain = F.when(fenced, F.translate(text, "\u0001\u0002", "\u0003\u0003")).otherwise(text)
    texts = df.select(plain.alias("text"))
    known = materialize(candidates(texts, rules))
    none = F.from_json(F.lit("[]"), _SPANS)
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rows = with_maybe(df.select(own.alias("row"), plain.alias("text"), _key(plain).alias("key")), known, ["key"], "known")
    parts = []
    for r in rules:
        wanted = F.col("known") if trigram_query(r.pattern) else F.lit(True)
        parts.append(F.when(wanted & F.regexp_like("text", F.lit(r.pattern)), _spans(F.col("text"), r)).otherwise(none))
    found = F.array_sort(F.flatten(F.array(*parts)), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    return rows.select("row", found.alias("mediacat_found")).select(*(F.col("row")[c].alias(c) for c in df.columns if c != "found"), F.col("mediacat_found").alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, the hash of the base spans and all spans of :func:`find_secrets`."""
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(found: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of :func:`find_secrets` with every span of ``text_col``, overlapping ones
    merged, replaced by ``mark``, and without ``found``; rows without spans stay as they are."""
    text = text_or_empty(text_col)
    kept = lambda at, x: F.when(x["start"] >= at, F.array(F.substring(text, at + 1, x["start"] - at), F.lit(mark))).otherwise(F.array().cast("array<string>"))
    pieces = _emitted(F.col("found"), F.lit(0), lambda at, x: F.greatest(at, x["end"]), kept, "array<string>")
    rest = F.substring(text, F.array_max(F.transform("found", lambda x: x["end"])) + 1, F.length(text))
    whole = F.concat(F.array_join(pieces, ""), rest)
    return found.withColumn(text_col, F.when(F.size("found") > 0, whole).otherwise(F.col(text_col))).drop("found")
