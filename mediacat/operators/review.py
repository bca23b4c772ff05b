"""Review of faces: photos by state of analysis, pages of faces, and decisions in sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a page of the review, of a group and of the grid. Fixed values.
REVIEW_PAGE, GROUP_PAGE, GRID_PAGE = 200, 200, 1000
#: People kept for a face beside the best one that is left out.
MOST_PEOPLE = 4


def analysis_states(media: DataFrame, analysis: DataFrame) -> DataFrame:
    """``(id, state)`` of every photo: that of its analysis, ``unscanned`` without one."""
    states = analysis.select(F.col("media_id").alias("id"), "state")
    return media.where("media_type = 'photo'").select("id").join(states, "id", "left").withColumn("state", F.coalesce("state", F.lit("unscanned")))


def in_job(items: DataFrame, job_media: DataFrame, job_id: int, id_col: str = "id") -> DataFrame:
    """The items in the scope of a job; ``job_media``: (job_id, media_id)."""
    scope = job_media.where(F.col("job_id") == job_id).select(F.col("media_id").alias(id_col)).distinct()
    return items.join(scope, id_col, "left_semi")


def page_of(faces: DataFrame, limit: int, offset: int = 0, most: int = GRID_PAGE) -> DataFrame:
    """A page of faces by id; the limit is held to 1 to ``most``."""
    rows = faces.orderBy("id")
    return (rows.offset(offset) if offset > 0 else rows).limit(min(most, max(1, limit)))


def best_examples(scores: DataFrame, most: int = MOST_PEOPLE) -> DataFrame:
    """``(face_id, tag_id, score, example_id, second_score, second_id, rank, omitted)``: each face's
    ``most`` best people by their best example, ties to the smaller tag; of equal examples the
    smaller id is the better. ``omitted`` is the best score of a person left out, null without one.

    ``scores``: (face_id, tag_id, example_id, score). Examples are reduced by person before
    people are ranked, so neither needs to fit a task.
    """
    place = F.struct((-F.col("score")).alias("down"), "example_id")
    best = scores.groupBy("face_id", "tag_id").agg(F.min(place).alias("best"))
    others = scores.join(best, ["face_id", "tag_id"]).where(F.col("example_id") != F.col("best.example_id"))
    second = others.groupBy("face_id", "tag_id").agg(F.min(place).alias("second"))
    both = best.join(second, ["face_id", "tag_id"], "left")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("face_id").orderBy("best.down", "tag_id"))).where(F.col("rank") <= most + 1)
    omitted = ranked.where(F.col("rank") == most + 1).select("face_id", (-F.col("best.down")).alias("omitted"))
    kept = ranked.where(F.col("rank") <= most).join(omitted, "face_id", "left")
    return kept.select("face_id", "tag_id", (-F.col("best.down")).alias("score"), F.col("best.example_id").alias("example_id"), (-F.col("second.down")).alias("second_score"), F.col("second.example_id").alias("second_id"), "rank", "omitted")


def set_dismissed(faces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Faces with ``dismissed`` set as ``chosen`` (face_id, dismissed, expected_revision) says
    where the revision is the expected one; a dismissed face loses its identity."""
    c = chosen.select(F.col("face_id").alias("id"), F.col("dismissed").alias("new"), "expected_revision")
    ok = F.coalesce(F.col("new").isNotNull() & (F.col("revision") == F.col("expected_revision")), F.lit(False))
    out = faces.join(c, "id", "left").withColumn("ok", ok)
    person = F.when(F.col("ok") & F.col("new"), F.lit(None)).otherwise(F.col("person_tag_id"))
    out = out.withColumn("person_tag_id", person).withColumn("dismissed", F.when(F.col("ok"), F.col("new")).otherwise(F.col("dismissed")))
    return out.withColumn("revision", F.col("revision") + F.col("ok").cast("int")).select(faces.columns)
