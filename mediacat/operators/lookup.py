"""Items by the path that a caller knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions.scalars import relative_to, slashes


def by_path(media: DataFrame, paths: DataFrame, root: str = "") -> DataFrame:
    """``(path, id, tried)`` of each distinct ``path`` that the catalog knows: as given, else below
    ``root``, else with forward slashes. ``tried`` says which of them (0, 1, 2) it was.

    All forms are looked up in one join; of several items at a form's path the first by id counts.
    """
    wanted = paths.select("path").where("path IS NOT NULL").distinct()
    forms = [F.col("path"), relative_to("path", root) if root else F.col("path"), slashes("path")]
    tried = wanted.select("path", F.posexplode(F.array(*forms)).alias("tried", "file_path"))
    # A form that equals an earlier one finds nothing new.
    tried = tried.groupBy("path", "file_path").agg(F.min("tried").alias("tried"))
    found = tried.join(media.select("file_path", "id"), "file_path")
    return found.groupBy("path").agg(F.min(F.struct("tried", "id")).alias("m")).select("path", F.col("m.id").alias("id"), F.col("m.tried").alias("tried"))
