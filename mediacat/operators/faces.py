"""Identity suggestions, face groups, and matching of detections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.scalars import is_healthy

THRESHOLD = 0.5
MOST_SUGGESTED = 3
CHUNK = 4096
#: Faces whose scores are held at once.
SLICE = 256


def suggestions(faces: DataFrame, rejections: DataFrame, people: DataFrame, dim: int, threshold: float = THRESHOLD, most: int = MOST_SUGGESTED) -> DataFrame:
    """``(face_id, tag_id, score, rank)``: for each unnamed face the people whose examples are
    most like it, by the best example of each, ties by name.

    Examples are named, undismissed faces with a sound embedding; a face isn't an example
    for itself, and rejected people are left out. Faces and examples meet in chunks, each
    pair of chunks in one task, which returns the best example of each face and person.
    """
    sound = faces.where(~F.col("dismissed") & is_healthy("embedding", dim)).select("id", "embedding", "person_tag_id")
    chunks = lambda df: max(1, -(-df.count() // CHUNK))
    examples, asked = sound.where("person_tag_id IS NOT NULL"), sound.where("person_tag_id IS NULL")
    ne, na = chunks(examples), chunks(asked)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    examples = examples.select(F.lit(True).alias("example"), "id", "embedding", "person_tag_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(na - 1).cast("long"))).alias("i"), part(ne).alias("j"))
    asked = asked.select(F.lit(False).alias("example"), "id", "embedding", "person_tag_id", part(na).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ne - 1).cast("long"))).alias("j"))
    least = np.float32(threshold)

    def best(g: pd.DataFrame) -> pd.DataFrame:
        e, q = g[g["example"]], g[~g["example"]]
        if not len(e) or not len(q):
            return pd.DataFrame({"face_id": [], "tag_id": [], "score": []})
        e = e.sort_values("person_tag_id", kind="stable")
        tags, first = np.unique(e["person_tag_id"].to_numpy(dtype=np.int64), return_index=True)
        across, ids, found = np.stack(e["embedding"].to_numpy()).astype(np.float64).T, q["id"].to_numpy(), []
        for k in range(0, len(q), SLICE):  # a task holds the scores of a slice only
            scores = np.clip(np.stack(q["embedding"].iloc[k : k + SLICE].to_numpy()).astype(np.float64) @ across, -1, 1).astype(np.float32)
            top = np.maximum.reduceat(scores, first, axis=1)
            r, c = np.nonzero(top >= least)
            found.append((ids[k + r], tags[c], top[r, c]))
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("face_id", "tag_id", "score"), zip(*found, strict=True), strict=True)})

    found = examples.unionByName(asked).groupBy("i", "j").applyInPandas(best, "face_id long, tag_id long, score float")
    found = found.groupBy("face_id", "tag_id").agg(F.max("score").alias("score")).join(rejections.select("face_id", "tag_id"), ["face_id", "tag_id"], "left_anti")
    named = found.join(people.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    w = Window.partitionBy("face_id").orderBy(F.desc("score"), "name", "tag_id")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("face_id", "tag_id", "name", "score", "rank")


def face_groups(faces: DataFrame, suggested: DataFrame, people: DataFrame, dismissed: bool = True, named: bool = True, unnamed: bool = True, person: int | None = None) -> DataFrame:
    """Groups of faces: by person (named, or by the first suggestion), unnamed, dismissed.

    ``(type, tag_id, name, faces, photos, suggested_faces, suggested_photos, rank)``.
    """
    first = suggested.where("rank = 1").select(F.col("face_id").alias("id"), F.col("tag_id").alias("top"))
    f = faces.select("id", "media_id", "dismissed", "person_tag_id").join(first, "id", "left")
    kind = F.when(F.col("dismissed"), "dismissed").when(F.coalesce("person_tag_id", "top").isNotNull(), "person").otherwise("unnamed")
    f = f.withColumn("suggested", ~F.col("dismissed") & F.col("person_tag_id").isNull() & F.col("top").isNotNull()).withColumn("type", kind)
    f = f.withColumn("tag_id", F.when(F.col("type") == "person", F.coalesce("person_tag_id", "top")))
    show = F.when(F.col("dismissed"), F.lit(dismissed)).when(F.col("person_tag_id").isNotNull(), F.lit(named)).otherwise(F.lit(unnamed and person is None))
    if person is not None:
        show = show & (F.coalesce(F.col("person_tag_id"), F.lit(-1)) == person)
    groups = (
        f.where(show)
        .groupBy("type", "tag_id")
        .agg(F.count("*").alias("faces"), F.count_distinct("media_id").alias("photos"), F.count_if("suggested").alias("suggested_faces"), F.count_distinct(F.when(F.col("suggested"), F.col("media_id"))).alias("suggested_photos"))
    )
    groups = groups.join(people.select(F.col("id").alias("tag_id"), "name"), "tag_id", "left").withColumn("name", F.coalesce("name", F.lit("")))
    order = F.when(F.col("type") == "person", 0).when(F.col("type") == "unnamed", 1).otherwise(2)
    return groups.withColumn("rank", F.row_number().over(Window.orderBy(order, "name", F.coalesce("tag_id", F.lit(0)))))


def accept(faces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Faces with the accepted ``(face_id, tag_id, expected_revision)`` set where the revision
    is still the expected one and the face has no identity."""
    c = chosen.select(F.col("face_id").alias("id"), F.col("tag_id").alias("new"), "expected_revision")
    ok = F.col("new").isNotNull() & (F.col("revision") == F.col("expected_revision")) & F.col("person_tag_id").isNull()
    out = faces.join(c, "id", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
    return out.withColumn("person_tag_id", F.when(F.col("ok"), F.col("new")).otherwise(F.col("person_tag_id"))).withColumn("revision", F.col("revision") + F.col("ok").cast("int")).select(faces.columns)


def reject(rejections: DataFrame, suggested: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rejections with those of ``pairs`` that are among the current suggestions."""
    return rejections.select("face_id", "tag_id").unionByName(pairs.select("face_id", "tag_id").join(suggested, ["face_id", "tag_id"], "left_semi")).distinct()


def _overlaps(a: np.ndarray, b: np.ndarray, edge: float = 0.0) -> np.ndarray:
    w = np.minimum(a[:, None, 0] + a[:, None, 2], b[None, :, 0] + b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]) + edge
    h = np.minimum(a[:, None, 1] + a[:, None, 3], b[None, :, 1] + b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]) + edge
    both = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda x: (x[:, 2] + edge) * (x[:, 3] + edge)
    union = area(a)[:, None] + area(b)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


_BOX = ["x", "y", "width", "height"]


def suppress(detections: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Detections left by greedy non-maximum suppression in each photo: best score first, of
    equal ones the later id; a box goes if it overlaps a kept one by more than ``threshold``."""

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=False)
        over = _overlaps(g[_BOX].to_numpy(float), g[_BOX].to_numpy(float), 1.0) > threshold
        alive, kept = np.ones(len(g), dtype=bool), []
        for k in range(len(g)):
            if alive[k]:
                kept.append(k)
                alive &= ~over[k]
        return g.iloc[kept]

    return detections.groupBy("media_id").applyInPandas(keep, detections.schema)


def match_previous(found: DataFrame, previous: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(media_id, id, previous_id)``: new detections paired with those of an earlier analysis,
    best overlap first, each side once, from ``threshold`` on."""
    kinds = dict(found.dtypes)

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            a, b = a.sort_values("id"), b.sort_values("id")
            over = _overlaps(a[_BOX].to_numpy(float), b[_BOX].to_numpy(float))
            used_a, used_b = set(), set()
            for k in np.argsort(-over, axis=None, kind="stable"):
                i, j = divmod(int(k), len(b))
                if over[i, j] < threshold:
                    break
                if i not in used_a and j not in used_b:
                    used_a.add(i), used_b.add(j)
                    rows.append((a["media_id"].iloc[i], a["id"].iloc[i], b["id"].iloc[j]))
        return pd.DataFrame(rows, columns=["media_id", "id", "previous_id"])

    return found.groupBy("media_id").cogroup(previous.groupBy("media_id")).applyInPandas(match, f"media_id {kinds['media_id']}, id {kinds['id']}, previous_id {kinds['id']}")
