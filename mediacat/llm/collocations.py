"""Phrase collocations by contiguous pattern growth.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\n-\\r]`` and those into words at
spaces and tabs. The frequent phrases of each language are found by growing prefixes to the
right, as PrefixSpan does, where the next word must follow at once:

1. *Counts.* One pass counts words exactly, and pairs of words by hash. A phrase is only
   frequent if all its pairs are, so the hashes of frequent pairs make a filter of at most
   16 MB; it may pass others, which costs work and no exactness.
2. *Projection.* A second pass takes every place where a pair passes, with the up to four words
   that follow for as long as their pairs pass. Equal ones are counted in the task that read
   them, packed by prefix, and sent to the prefix's task.
3. *Growth.* A prefix is a task: it splits its pointers by the next word, drops what is rare
   and goes on depth first. A prefix of one word with very many places is dealt by two words
   instead, and such a pair by four; counts of what is shorter are then partial and summed.

Only the words of a phrase are needed from then on: every part of a frequent phrase is frequent,
so the parts' counts are in the same table. A phrase lies in a longer one that is as frequent
only if it lies in one that is longer by one word, so one join finds those to drop.

Words are 64-bit hashes between the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.llm.common import broadcast_if_small, materialize, text_or_empty

SEED = 42
MOST_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: Words that a task holds before it sends counts; its vocabulary has to fit 21 bits.
BLOCK_WORDS = 1 << 22
MOST_VOCABULARY = 1 << 21
#: Bytes of text that are split at once.
SLICE = 1 << 20
#: Ranges of the pairs' hashes; bits of the filter at most.
RANGES = 256
MOST_BITS = 1 << 27
#: Places above which a prefix is dealt by more words: so many, or this share of all. The share bounds their number.
HOT_PLACES = 1 << 18
HOT_SHARE = 1 << 20
#: Parts of a language in the first step of its ranking.
LANES = 64

_SPLIT = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_END = b"."


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """The words of some texts of a language as numbers; 0 ends a piece."""

    number: dict[bytes, int] = field(default_factory=lambda: {_END: 0})
    held: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, text: bytes) -> None:
        words = pa.array(text.lower().translate(_SPLIT).replace(_END, b" . ").split(), pa.binary()).dictionary_encode()
        own, number = words.dictionary.to_pylist(), self.number
        codes = np.fromiter((number.setdefault(w, len(number)) for w in own), dtype=np.uint32, count=len(own))
        self.held.append(codes[words.indices.to_numpy()])
        self.size += len(words)

    def codes(self) -> np.ndarray:
        return np.concatenate([*self.held, np.zeros(MOST_WORDS, dtype=np.uint32)])

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.number, repeat(SEED)), dtype=np.uint64, count=len(self.number))


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        yield text[at:] if cut < 0 else text[at:cut]
        at = len(text) if cut < 0 else cut


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    """The blocks of ``(lang, text)``, each sent when it is full or the task ends."""
    held: dict[str, Block] = {}

    def full() -> bool:
        return sum(b.size for b in held.values()) >= BLOCK_WORDS or any(len(b.number) >= MOST_VOCABULARY - SLICE for b in held.values())

    for batch in batches:
        short: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def send(lang: str) -> None:
            held.setdefault(lang, Block()).add(b" . ".join([*short.pop(lang, []), b""]))  # noqa: B023
            sizes[lang] = 0  # noqa: B023

        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            if len(text) > SLICE:
                for s in _slices(text):
                    held.setdefault(lang, Block()).add(s)
                held[lang].add(_END)
            else:
                short.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= SLICE:
                    send(lang)
            if full():
                yield from held.items()
                held = {}
        for lang in list(short):
            send(lang)
        if full():
            yield from held.items()
            held = {}
    yield from held.items()


def _pair_hashes(lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 40-bit hash of each pair of word hashes in a language."""
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), SEED))
    return _mixed(_mixed(left + seed) * np.uint64(0x9E3779B97F4A7C15) + right) >> np.uint64(24)


_COUNTED = ["lang", "word", "count", "slot", "packed"]


def _coded(counts: np.ndarray) -> np.ndarray:
    """A count in a byte: exact below ``MIN_COUNT``, a lower bound from there on."""
    steps = np.floor(4 * np.log2(np.maximum(counts, MIN_COUNT) / MIN_COUNT))
    return np.where(counts < MIN_COUNT, counts, MIN_COUNT + np.minimum(steps, 255 - MIN_COUNT)).astype(np.uint8)


_DECODED = np.array([k if k < MIN_COUNT else int(MIN_COUNT * 2 ** ((k - MIN_COUNT) / 4)) for k in range(256)], dtype=np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(lang, text)``: the words of a block with their counts, and its pairs, packed by range."""
    for lang, block in blocks(batches):
        codes, hashes = block.codes(), block.hashes()
        counts = np.bincount(codes, minlength=len(hashes))[1:]
        n = len(counts)
        words = list(block.number)[1:]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=_COUNTED)
        pairs = (codes[:-1].astype(np.uint64) << np.uint64(32)) | codes[1:]
        pairs, times = np.unique(pairs[(codes[:-1] > 0) & (codes[1:] > 0)], return_counts=True)
        h = _pair_hashes(lang, hashes[pairs >> np.uint64(32)], hashes[pairs & np.uint64(0xFFFFFFFF)])
        order = np.argsort(h)
        h, coded = h[order], _coded(times[order])
        ends = np.searchsorted(h, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(32))
        slots = np.flatnonzero(np.diff(ends))
        blobs = [h[ends[s] : ends[s + 1]].astype(np.uint32).tobytes() + coded[ends[s] : ends[s + 1]].tobytes() for s in slots]
        k = len(slots)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(slots, pa.int64()), pa.array(blobs, pa.binary())], names=_COUNTED)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their hashes, as 8 bytes."""
    for b in batches:
        lang, word, f, n = (b.column(b.schema.names.index(c)) for c in ("lang", "word", "f", "n"))
        keys = [np.uint64(xxhash.xxh64_intdigest(w, SEED)).tobytes() for w in word.to_pylist()]
        yield pa.RecordBatch.from_arrays([lang, pa.array(keys, pa.binary()), word, f, n], names=["lang", "key", "word", "f", "n"])


def _frequent_pairs(min_count: int):
    """Of a range: the pairs' hashes whose counts reach ``min_count``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(x, np.uint32, len(x) // 5), np.frombuffer(x, np.uint8, offset=len(x) // 5 * 4)) for x in rows.column("packed").to_pylist()]
        h = np.concatenate([p[0] for p in parts])
        counts = _DECODED[np.concatenate([p[1] for p in parts])]
        order = np.argsort(h, kind="stable")
        h, counts = h[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sums = np.add.reduceat(counts, starts)
        kept = sums >= min_count
        return pa.table({"pair": (key[0].as_py() << 32) + h[starts[kept]].astype(np.int64), "places": sums[kept]})

    return run


def _filter(pairs: DataFrame) -> np.ndarray:
    """The bits of the pairs' hashes: 16 a pair, ``MOST_BITS`` in all at most, whatever their number."""
    bits, wanted = 1 << 15, min(MOST_BITS, 16 * pairs.count())
    while bits < wanted:
        bits *= 2
    place = F.pmod("pair", F.lit(bits)) + 1
    rows = pairs.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("bit")).groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def _project(passes, hot_words, hot_pairs):
    """Of ``(lang, text)``: the places of pairs that pass, counted by the words that follow and
    packed by prefix: lengths, counts, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_pair = passes.value, hot_pairs.value
        mask = np.uint64(8 * len(bits) - 1)
        for lang, block in blocks(batches):
            codes, hashes = block.codes(), block.hashes()
            h = _pair_hashes(lang, hashes[codes[:-1]], hashes[codes[1:]])
            place = h & mask
            ok = (codes[:-1] > 0) & (codes[1:] > 0) & ((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            words, on = [codes[at], codes[at + 1]], np.ones(len(at), dtype=bool)
            for k in range(1, MOST_WORDS - 1):
                on = on & ok[np.minimum(at + k, len(ok) - 1)] & (at + k < len(ok))
                words.append(np.where(on, codes[np.minimum(at + k + 1, len(codes) - 1)], 0))
            w = [x.astype(np.uint64) for x in words]
            first, rest = (w[0] << np.uint64(32)) | w[1], (w[2] << np.uint64(42)) | (w[3] << np.uint64(21)) | w[4]
            order = np.lexsort((rest, first))
            first, rest = first[order], rest[order]
            starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
            counts = np.diff(np.append(starts, len(first))).astype(np.uint32)
            table = np.stack([x[order][starts] for x in words], axis=1)
            own = h[at][order][starts].astype(np.int64)
            word_is_hot = np.isin(hashes, hot_words.value.get(lang, np.zeros(0, np.uint64)))[table[:, 0]]
            depth = np.where(~word_is_hot, 1, np.where(np.isin(own, hot_pair), 4, 2))
            new = np.any((table[1:, :4] != table[:-1, :4]) & (np.arange(4) < depth[1:, None]), axis=1)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])
            sent = (table > 0) & (np.arange(MOST_WORDS) >= depth[:, None])
            lengths = sent.sum(axis=1).astype(np.uint8)
            flat, ends = hashes[table[sent]], np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            prefixes, blobs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                head = table[a, : depth[a]]
                prefixes.append(hashes[head[head > 0]].tobytes())
                blobs.append(lengths[a:b].tobytes() + counts[a:b].tobytes() + flat[ends[a] : ends[b]].tobytes())
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(prefixes, pa.binary()), pa.array(depth[cuts[:-1]], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(blobs, pa.binary())], names=["lang", "prefix", "depth", "places", "packed"])

    return run


def grow(prefix: tuple[int, ...], words: np.ndarray, counts: np.ndarray, min_count: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """The frequent phrases that extend ``prefix`` to the right, depth first. ``words`` has what
    follows at each place, one column a word, 0 where the place ends; ``counts`` its number."""
    if not words.shape[1]:
        return
    here = np.flatnonzero(words[:, 0])
    here = here[np.argsort(words[here, 0], kind="stable")]
    column = words[here, 0]
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(here) else here
    sums = np.add.reduceat(counts[here], starts) if len(here) else here
    ends = np.append(starts[1:], len(here))
    for k in np.flatnonzero(sums >= min_count):
        places = here[starts[k] : ends[k]]
        phrase = (*prefix, int(column[starts[k]]))
        yield phrase, int(sums[k])
        yield from grow(phrase, words[places, 1:], counts[places], min_count)


def _grown(min_count: int):
    """Of one prefix: the phrases that begin with it, and their counts."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, head, depth = (k.as_py() for k in key)
        prefix = tuple(np.frombuffer(head, np.uint64).tolist())
        lengths, counts, flat = [], [], []
        for n, blob in zip(rows.column("places").to_pylist(), rows.column("packed").to_pylist(), strict=True):
            lengths.append(np.frombuffer(blob, np.uint8, n))
            counts.append(np.frombuffer(blob, np.uint32, n, n))
            flat.append(np.frombuffer(blob, np.uint64, offset=5 * n))
        long, count = np.concatenate(lengths), np.concatenate(counts).astype(np.int64)
        words = np.zeros((len(long), MOST_WORDS - depth), dtype=np.uint64)
        words[np.arange(MOST_WORDS - depth) < long[:, None]] = np.concatenate(flat)
        total = int(count.sum())
        # Of a prefix that other tasks share, this is a part; the whole prefix is only here.
        found = [(prefix[:k], total) for k in range(2, len(prefix) + 1) if k < depth or total >= min_count]
        found += grow(prefix, words, count, min_count)
        phrases = [np.array(p, dtype=np.uint64).tobytes() for p, _ in found]
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "words": pa.array(phrases, pa.binary()), "a": pa.array([c for _, c in found], pa.int64())})

    return run


def _part(words: str, first: Column, n: Column) -> Column:
    """``n`` words of a key of 8 bytes a word, without the ``first`` ones."""
    return F.substring(words, first * 8 + 1, n * 8)


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(lang, key, word, f, n)`` of the words of frequency ``min_count`` or more, n being all
    words of the language, and ``(lang, words, size, a)`` of the phrases of 2 to 5 words that
    are as frequent. Keys and ``words`` have 8 bytes a word. Both materialized."""
    context = df.sparkSession.sparkContext
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    counted = materialize(texts.mapInArrow(_count, "lang string, word binary, count bigint, slot bigint, packed binary"))
    words = materialize(counted.where("slot is null").groupBy("lang", "word").agg(F.sum("count").alias("f")))
    total = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")))
    words = words.where(F.col("f") >= min_count).join(broadcast_if_small(total), "lang")
    words = materialize(words.mapInArrow(_keyed, "lang string, key binary, word binary, f bigint, n bigint"))
    pairs = materialize(counted.where("slot is not null").groupBy("slot").applyInArrow(_frequent_pairs(min_count), "pair bigint, places bigint"))

    everywhere = total.agg(F.sum("n")).first()[0] or 0
    hot = max(HOT_PLACES, everywhere // HOT_SHARE)  # so at most HOT_SHARE words and as many pairs are hot
    hot_words: dict[str, list[bytes]] = {}
    for r in words.where(F.col("f") > hot).select("lang", "key").collect():
        hot_words.setdefault(r["lang"], []).append(bytes(r["key"]))
    hot_words = {lang: np.frombuffer(b"".join(keys), dtype=np.uint64) for lang, keys in hot_words.items()}
    hot_pairs = np.array([r["pair"] for r in pairs.where(F.col("places") > hot).select("pair").collect()], dtype=np.int64)
    sent = texts.mapInArrow(_project(context.broadcast(_filter(pairs)), context.broadcast(hot_words), context.broadcast(hot_pairs)), "lang string, prefix binary, depth bigint, places bigint, packed binary")
    parts = sent.groupBy("lang", "prefix", "depth").applyInArrow(_grown(min_count), "lang string, words binary, a bigint")
    phrases = parts.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    return words, materialize(phrases.select("lang", "words", (F.length("words") / 8).cast("int").alias("size"), "a"))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to
    5 words that occur at least ``min_count`` times.

    ``a``, ``l`` and ``r`` are the frequencies of the phrase and of both parts of the cut that
    scores lowest (of equal scores, the first), n that of all words; the score is
    ``floor(1000 * a * n / (l * r))``. Phrases inside a longer one that is as frequent are
    left out. Order: score and ``a`` descending, then the phrase's bytes. A null text is empty, a
    null language is ``und``; repeated rows count as often as they are there. Other columns are
    ignored.
    """
    words, phrases = frequent_phrases(df, text_col, lang_col, min_count)
    inner = [phrases.where("size > 2").select("lang", _part("words", F.lit(k), F.col("size") - 1).alias("words"), F.col("a").alias("longer")) for k in (0, 1)]
    longest = inner[0].unionByName(inner[1]).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = phrases.join(longest, ["lang", "words"], "left").where("longer is null or longer < a").drop("longer")

    counts = phrases.select("lang", "words", F.col("a").alias("f")).unionByName(words.select("lang", F.col("key").alias("words"), "f"))
    of = lambda part, name: counts.select("lang", F.col("words").alias(part), F.col("f").alias(name))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": _part("words", F.lit(0), F.col("k")), "right": _part("words", F.col("k"), F.col("size") - F.col("k"))})
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    cuts = cuts.join(broadcast_if_small(materialize(words.groupBy("lang").agg(F.first("n").alias("n")))), "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "words", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = materialize(best.select("lang", "words", "size", "a", "n", "cut.score", "cut.l", "cut.r"))

    names = broadcast_if_small(words.select("lang", "key", "word"))
    for k in range(MOST_WORDS):
        name = names.select("lang", F.col("key").alias(f"key{k}"), F.col("word").cast("string").alias(f"word{k}"))
        scored = scored.withColumn(f"key{k}", _part("words", F.lit(k), F.lit(1))).join(name, ["lang", f"key{k}"], "left")
    named = scored.select("*", F.concat_ws(" ", *(f"word{k}" for k in range(MOST_WORDS))).alias("phrase"), F.pmod(F.xxhash64("words"), F.lit(LANES)).alias("lane"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for lane in (["lang", "lane"], ["lang"]):  # the first of each lane, then of those
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*lane).orderBy(*order))).where(F.col("rank") <= top)
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
