"""The label job: which photos are due, their labels, and the write that checks them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.operators.mutations import LINK, Tables, create_tags, replace_smart_tags
from mediacat.operators.tables import checkpointed
from mediacat.operators.vectors import smart_labels

#: What a photo's labels depend on, beside its content.
KEY = ("model_id", "model_revision", "taxonomy_version")


def _of(df: DataFrame, key: dict[str, str], names: tuple[str, ...] = KEY) -> DataFrame:
    for c in names:
        df = df.where(F.col(c) == key[c])
    return df


def plan_labels(tables: Tables, ids: DataFrame, labels: DataFrame, key: dict[str, str], force: bool = False, **limits) -> tuple[DataFrame, DataFrame]:
    """``(records, outcomes)`` of the photos ``ids``: a record is ``(media_id, content_hash, names)``,
    the labels to write; an outcome ``(media_id, status)`` tells why there is no record.

    ``failed``: not in the catalog. ``skipped``: labelled already for this content, model and
    taxonomy (unless forced), or without a sound vector of this content. ``labels`` are as in
    ``smart_labels``, with ``name``; ``limits`` are its own. A photo may get no label at all.
    """
    media = tables["media"].select(F.col("id").alias("media_id"), "content_hash")
    asked = ids.select(F.col("id").alias("media_id")).where("media_id IS NOT NULL").distinct()
    state = _of(tables["smart_tag_state"], key).select("media_id", F.col("content_hash").alias("done"))
    sound = _of(tables["index_state"], key, KEY[:2]).where("coalesce(error_text, '') = '' AND embedding IS NOT NULL").select("media_id", "content_hash", "embedding")
    at = asked.join(media.withColumn("known", F.lit(True)), "media_id", "left").join(state, "media_id", "left")
    due = F.lit(True) if force else ~F.coalesce(F.col("done") == F.col("content_hash"), F.lit(False))
    at = at.select("media_id", "content_hash", F.coalesce("known", F.lit(False)).alias("known"), due.alias("due")).join(sound, ["media_id", "content_hash"], "left")
    at = checkpointed(at.withColumn("status", F.when(~F.col("known"), "failed").when(~F.col("due") | F.col("embedding").isNull(), "skipped")))
    todo = at.where("status IS NULL").select("media_id", "content_hash", "embedding")
    best = smart_labels(todo, labels, **limits).join(labels.select("label_id", "name"), "label_id")
    names = best.groupBy("media_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))  # a few a photo
    records = todo.select("media_id", "content_hash").join(names, "media_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return records, at.where("status IS NOT NULL").select("media_id", "status")


def write_labels(tables: Tables, records: DataFrame, key: dict[str, str], now: int) -> tuple[Tables, DataFrame]:
    """``(tables, outcomes)`` after the records were written: a photo's labels by the model are
    replaced and its row of ``smart_tag_state`` upserted, if it is a photo and its content
    is still what the record says (``processed``), else nothing of it changes (``skipped``).

    Rejected labels aren't written. ``label_count`` counts the others, also those that were there by another origin.
    """
    photos = tables["media"].where("media_type = 'photo'").select(F.col("id").alias("media_id"), "content_hash")
    records = checkpointed(records)
    sound = checkpointed(records.join(photos, ["media_id", "content_hash"], "left_semi"))
    named = sound.select("media_id", F.explode("names").alias("name")).distinct()
    tags = checkpointed(create_tags(tables["tags"], records.select(F.explode("names").alias("name")).distinct().withColumn("category", F.lit("keyword"))))
    own = tags.where("category = 'keyword'").groupBy("name").agg(F.min("id").alias("tag_id"))
    links = checkpointed(named.join(own, "name").select(*LINK).join(tables["smart_tag_rejections"].select(*LINK), LINK, "left_anti"))
    out = replace_smart_tags(tables, sound.select(F.col("media_id").alias("id")), links)
    counts = links.groupBy("media_id").agg(F.count("*").alias("label_count"))
    values = {c: F.lit(key[c]) for c in KEY} | {"label_count": F.coalesce("label_count", F.lit(0).cast("long")), "updated_at": F.lit(now).cast("long")}
    state = tables["smart_tag_state"]
    new = sound.select("media_id", "content_hash").join(counts, "media_id", "left").withColumns(values)
    kept = state.join(sound.select("media_id"), "media_id", "left_anti")
    result = tables | out | {"tags": tags, "smart_tag_state": kept.select(state.columns).unionByName(new.select(state.columns))}
    done = sound.select("media_id", F.lit("processed").alias("status"))
    return result, done.unionByName(records.join(sound, "media_id", "left_anti").select("media_id", F.lit("skipped").alias("status")))


def job_report(outcomes: DataFrame) -> DataFrame:
    """One row: how many were processed, skipped and failed, and the job's ``state``."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    counts = outcomes.agg(n("processed"), n("skipped"), n("failed"))
    return counts.withColumn("state", F.when((F.col("processed") == 0) & (F.col("failed") > 0), "failed").otherwise("completed"))
