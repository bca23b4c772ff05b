"""Semantic search: items near a query vector, filtered, ranked and with their tags."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.operators.criteria import QueryCriteria, select_media, with_tags
from mediacat.operators.vectors import top_k


def semantic_search(tables: dict[str, DataFrame], query: list[float], k: int, criteria: QueryCriteria | None = None) -> DataFrame:
    """The photos nearest to a vector, as rows of media with ``tags``, ``score`` and ``rank``.

    Only photos have vectors: a filter for another type gives nothing and scores nothing.
    Unlike in a plain query, a date bound leaves undated photos out. Without criteria the k
    best vectors are taken first, and those that aren't of a photo any more fall away, so
    fewer than k may be left; with criteria the filter comes first.
    """
    media = tables["media"].where("media_type = 'photo'")
    if criteria is not None and criteria.media_type not in (None, "", "all", "photo"):
        media = media.limit(0)
    allowed = None
    if criteria is not None:
        allowed = select_media(tables, replace(criteria, media_type="photo"))
        if criteria.date_from is not None or criteria.date_to is not None:
            allowed = allowed.where("date_taken <> 0")
    hits = top_k(tables["index"], query, k, allowed).withColumnRenamed("media_id", "id")
    best = hits.groupBy("id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    page = media.join(F.broadcast(best), "id")  # k rows, 1,000 at most
    return with_tags(page, tables)
