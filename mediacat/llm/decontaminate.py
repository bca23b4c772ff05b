"""Benchmark decontamination by size-partitioned MinHash containment, DataFrame operations only.

A document contains a test item if at least ``threshold`` of the item's distinct shingles
(five words; of a shorter text its whole sequence) are among the document's. Words are runs
of letters and digits of the lower-cased text.

A signature of fixed length over a whole document can't find an item of 30 shingles inside
20,000: their Jaccard similarity is below 0.002, and 256 hashes would miss most of them.
So the partitions are of the items' sizes, and the sketch length follows from the size: an
item of q shingles keeps its floor((1 - threshold) * u) + 1 smallest hashes, u being the
upper bound of its partition. A document that contains the item lacks at most
floor((1 - threshold) * q) of its shingles, so it has one of the sketch: no containment is
missed. The documents' side of the search is every hash of theirs: that is the only sketch
of a long text which can't miss a short item.

Texts are never shuffled, whatever the number of items or hits. One pass probes the hashes of
all document shingles: sketches are broadcast while their number is proven small, and beyond
that a filter of bounded size lets few other hashes through to a join. The texts that are hit
fill a second filter, and a second pass in place takes the shingles of those, as strings, and
keeps the ones that an item has. Counted by text and item they are the exact containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import join_in_place, materialize, narrowed, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
#: Sizes of partitions grow by this factor.
PARTITION_RATIO = 1.25


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once even where a lambda uses it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(of: Column, n: int = SHINGLE) -> Column:
    """Hashes of the shingles of an array of words, repeats included; none for no words."""

    def hashes(w: Column) -> Column:
        many = _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(n)))))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return _let(of, hashes)


def shingle_texts(of: Column, n: int = SHINGLE) -> Column:
    """The distinct shingles themselves."""

    def texts(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(_let(of, texts))


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(item, hash)``: the smallest shingle hashes of each ``item_text``, as many as its size
    asks for. ``item`` is a hash of the text. Items without a word have none."""
    sized = items.select("item", F.array_distinct(shingle_hashes(words(F.col("item_text")))).alias("hashes")).where(F.size("hashes") > 0)
    part = F.floor(F.log(F.size("hashes").cast("double")) / F.log(F.lit(PARTITION_RATIO)))
    upper = F.floor(F.pow(F.lit(PARTITION_RATIO), part + 1)) + 1
    kept = F.least(F.size("hashes"), F.floor(F.round((1 - threshold) * upper, 9)).cast("int") + 1)
    return sized.select("item", F.explode(F.slice(F.sort_array("hashes"), F.lit(1), kept)).alias("hash"))


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(id_col, item_col, item_shingles, shared_shingles, containment)`` for every pair of a
    document row and an item row with a containment of ``threshold`` or more.

    Null texts are empty; texts and items without a word are in no pair; rows with null ids
    and repeated rows are reported like others.
    """
    bench = items.select(F.col(item_col).alias("item_id"), text_or_empty(item_text_col).alias("item_text")).withColumn("item", F.xxhash64("item_text"))
    texts = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    held = _containments(texts, bench.select("item", "item_text").dropDuplicates(["item"]), threshold)
    named = materialize(held.join(bench.select("item", "item_id"), "item"))
    rows = narrowed(texts.select("doc", "key"), held, ["key"])
    out = rows.join(named, "key").select(F.col("doc").alias(id_col), F.col("item_id").alias(item_col), "item_shingles", "shared_shingles")
    return out.withColumn("containment", F.round(F.col("shared_shingles") / F.col("item_shingles"), 6))


def _containments(texts: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``(key, item, item_shingles, shared_shingles)`` of each distinct text that contains an
    item. ``texts``: ``(key, text)``; ``items``: ``(item, item_text)``, distinct. Materialized."""
    sketches = materialize(item_sketches(items, threshold).groupBy("hash").agg(F.count("*").alias("n")))
    probes = texts.select("key", F.explode(shingle_hashes(words(F.col("text")))).alias("hash"))
    hit = materialize(join_in_place(probes, sketches, ["hash"], "inner").select("key").distinct())
    of_items = materialize(items.select("item", F.explode(shingle_texts(words(F.col("item_text")))).alias("shingle")))
    sizes = of_items.groupBy("item").agg(F.count("*").alias("item_shingles"))
    asked = materialize(of_items.select("shingle").distinct())
    of_docs = narrowed(texts, hit, ["key"]).select("key", F.explode(shingle_texts(words(F.col("text")))).alias("shingle"))
    of_docs = materialize(join_in_place(of_docs, asked, ["shingle"], "inner").distinct())
    shared = of_docs.join(of_items, "shingle").groupBy("key", "item").agg(F.count("*").alias("shared_shingles"))
    return materialize(shared.join(sizes, "item").where(F.col("shared_shingles") >= F.round(threshold * F.col("item_shingles"), 9)).select("key", "item", "item_shingles", "shared_shingles"))


def contained_texts(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """``(key)``: the hashes ``xxhash64(text)``, nulls as empty, of the texts that contain an item. Materialized."""
    texts = docs.select(text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    bench = items.select(text_or_empty(item_text_col).alias("item_text")).withColumn("item", F.xxhash64("item_text")).dropDuplicates(["item"])
    return materialize(_containments(texts, bench, threshold).select("key").distinct())
