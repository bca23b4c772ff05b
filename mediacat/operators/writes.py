"""Batches written to the catalog: each is accepted whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.operators.mutations import import_rows
from mediacat.operators.tables import checkpointed, numbered


def first_claims(claims: DataFrame) -> DataFrame:
    """``batch`` of those that win, of ``claims`` (batch, key): batches come in order, and one wins
    unless an earlier winner claims a key of its own.

    Batches that share no key win at once. Of the others, in each round those win that are
    the first left on all their keys, and those that share a key with them lose; so a round
    is linear in the claims left, and a key that many batches claim costs no pairs.
    """
    left = checkpointed(claims.select("batch", "key").distinct())
    shared = left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    contested = checkpointed(left.join(shared, "key", "left_semi"))
    won = [left.join(contested, "batch", "left_anti").select("batch").distinct()]
    while not contested.isEmpty():
        first = contested.groupBy("key").agg(F.min("batch").alias("first"))
        seen = checkpointed(contested.join(first, "key"))
        winners = checkpointed(seen.groupBy("batch").agg(F.bool_and(F.col("first") == F.col("batch")).alias("wins")).where("wins").select("batch"))
        beaten = seen.join(winners.select(F.col("batch").alias("first")), "first", "left_semi").select("batch").distinct()  # the winners too
        contested = checkpointed(contested.join(beaten, "batch", "left_anti"))
        won.append(winners)
    out = won[0]
    for winners in won[1:]:
        out = out.unionByName(winners)
    return checkpointed(out)


def _accepted(rows: DataFrame, refused: DataFrame, key: str) -> DataFrame:
    """Batches of ``rows`` without a refused row, a null or repeated key, or a key of an earlier one."""
    own = rows.groupBy("batch", key).agg(F.count("*").alias("n"))
    bad = own.where(F.col(key).isNull() | (F.col("n") > 1)).select("batch").unionByName(refused.select("batch")).distinct()
    good = rows.join(bad, "batch", "left_anti")
    return first_claims(good.select("batch", F.col(key).alias("key")))


def insert_batches(media: DataFrame, rows: DataFrame, now: int, order: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """``(media, refused)`` after ``rows``, new items with their ``batch``, were inserted.

    A path may occur once. A batch with a null path, one that it repeats, that the catalog has
    or that an earlier accepted batch brought is refused as a whole. Accepted rows have ids
    above the largest so far, without gaps, in the order of batch and ``order``, and ``now``
    as ``created_at`` and ``updated_at``. Columns of ``media`` that ``rows`` lacks are null;
    others of ``rows`` are left out. A null batch is refused. ``refused`` holds rows as they came.
    """
    rows = checkpointed(rows)
    known = media.select("file_path").distinct()
    refused = rows.where("batch IS NULL").select("batch").unionByName(rows.join(known, "file_path", "left_semi").select("batch"))
    good = _accepted(rows.where("batch IS NOT NULL"), refused.where("batch IS NOT NULL"), "file_path")
    new = numbered(rows.join(good, "batch", "left_semi"), [F.col("batch"), F.col(order), F.col("file_path")], "mediacat_n")
    most = media.agg(F.coalesce(F.max("id"), F.lit(0)).alias("mediacat_most"))
    new = new.join(F.broadcast(most))  # one row
    given = {"id": F.col("mediacat_most") + F.col("mediacat_n"), "created_at": F.lit(now), "updated_at": F.lit(now)}
    kinds = dict(media.dtypes) | {"created_at": "bigint", "updated_at": "bigint"}
    old = media if "updated_at" in media.columns else media.withColumn("updated_at", F.col("created_at") if "created_at" in media.columns else F.lit(None).cast("long"))
    if "created_at" not in old.columns:
        old = old.withColumn("created_at", F.lit(None).cast("long"))
    new = new.select(*((given.get(c, F.col(c) if c in rows.columns else F.lit(None))).cast(kinds[c]).alias(c) for c in old.columns))
    return old.unionByName(new), rows.join(good, "batch", "left_anti")


def update_batches(media: DataFrame, rows: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """``(media, refused)`` after ``rows`` were applied: per ``batch`` and ``id`` new values, and as
    ``was_<column>`` the values that the writer saw.

    A batch with a row that is gone or has other values now, that it names twice, or that an
    earlier accepted batch rewrote, is refused as a whole. Null new values leave the old ones.
    """
    rows = checkpointed(rows)
    _, conflicts = import_rows(media, rows.where("batch IS NOT NULL"))
    good = _accepted(rows.where("batch IS NOT NULL"), conflicts, "id")
    columns = [c for c in media.columns if c in rows.columns and c not in ("id", "batch", "updated_at")]
    new = rows.join(good, "batch", "left_semi").select("id", F.lit(True).alias("mediacat_hit"), *(F.col(c).alias(f"mediacat_{c}") for c in columns))
    out = media.join(new, "id", "left")
    value = {c: F.coalesce(f"mediacat_{c}", c).alias(c) for c in columns}
    value["updated_at"] = F.when(F.col("mediacat_hit"), F.lit(now).cast("long"))
    if "updated_at" in media.columns:
        value["updated_at"] = value["updated_at"].otherwise(F.col("updated_at"))
    value["updated_at"] = value["updated_at"].alias("updated_at")
    names = media.columns if "updated_at" in media.columns else [*media.columns, "updated_at"]
    return out.select(*(value.get(c, F.col(c)) for c in names)), rows.join(good, "batch", "left_anti")


def delete_albums(albums: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(albums, members, missing)`` without the albums ``ids``; those that don't exist are missing."""
    gone = ids.select("id").distinct()
    left = members.join(gone.select(F.col("id").alias("album_id")), "album_id", "left_anti").select(members.columns)
    return albums.join(gone, "id", "left_anti").select(albums.columns), left, gone.join(albums, "id", "left_anti")
