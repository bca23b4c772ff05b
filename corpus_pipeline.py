"""A training corpus from raw documents, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import decontaminate, packing, secrets, simhash, similar, toxicity
from mediacat.llm.common import broadcast_if_small, is_small, join_in_place, materialize, salted_join, shared_dir, text_or_empty, with_row_key

#: Toxicity and near copies aren't SQL; the tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    scored = toxicity.toxicity_score(toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(scored(F.col("text").cast("string")) < 0.5)


def _tagged(docs: DataFrame) -> DataFrame:
    """The documents, in place, with a key of the row and one of its text."""
    return with_row_key(docs).withColumn("mediacat_key", F.xxhash64(text_or_empty("text")))


_ROW = ["mediacat_file", "mediacat_at"]


def _one_row_each(tagged: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of each ``roots.root``, a component of rows: that with the smallest id, a null
    id last; of equal ids that with the smallest text key, then row key."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mediacat_key", *_ROW)
    named = materialize(roots.select("root", *_ROW, rank.alias("rank")))
    best = named.groupBy("root").agg(F.min("rank").alias("best"), F.count("*").alias("n")).where("n > 1")
    best = materialize(best.select("root", F.struct(*(F.col(f"best.{c}") for c in _ROW)).alias("stays")))
    met = named.join(F.broadcast(best), "root") if is_small(best) else salted_join(named, best, "root", "mediacat_at")
    dropped = materialize(met.where(F.struct(*_ROW) != F.col("stays")).select(*_ROW))
    return join_in_place(tagged, dropped, _ROW, "left_anti").drop(*_ROW, "mediacat_key")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near fingerprints (op1's links)."""
    tagged = _tagged(docs)
    named = simhash.near_duplicates(tagged.withColumn("mediacat_row", F.struct(*_ROW)), id_col="mediacat_row")
    named = named.select("mediacat_row.*", F.struct("component_id.*").alias("root"))
    return _one_row_each(tagged, tagged.select(*_ROW, "mediacat_key", "doc_id").join(named, _ROW))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts linked by a Jaccard similarity of 0.8 or more over
    five-word shingles, proposed by SimHash and MinHash (:mod:`mediacat.llm.similar`)."""
    tagged = _tagged(docs)
    named = materialize(tagged.select(*_ROW, "mediacat_key", "doc_id"))
    roots = similar.similar_components(tagged.select(F.col("mediacat_key").alias("key"), text_or_empty("text").alias("text")))
    roots = broadcast_if_small(roots.withColumnRenamed("node", "mediacat_key"))
    return _one_row_each(tagged, named.join(roots, "mediacat_key", "left").withColumn("root", F.coalesce("root", "mediacat_key")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    hits = decontaminate.contained_texts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    keyed = docs.withColumn("mediacat_key", F.xxhash64(text_or_empty("text")))
    return join_in_place(keyed, hits.withColumnRenamed("key", "mediacat_key"), ["mediacat_key"], "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; ``n_chars`` counts anew."""
    out = secrets.redact(secrets.find_secrets(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of the documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_similar),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again.

    A stage's folder is removed once the next one is written; the last one stays.
    """
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            store, folder = fs.FileSystem.from_uri(f"{base}/{k - 1}-{STAGES[k - 1][0]}")
            store.delete_dir(folder)
    return docs
