"""Decisions on suggested identities: acceptances in sequence, and rankings kept up to date.

Matching. Examples are packed into blocks by their key (what computed the embedding), and the
faces asked about pass the blocks of their key. A block returns a face's best examples of each
person, so neither a person's examples nor a face's matches are ever listed whole.

Acceptances in sequence. A face accepted for a person is an example for later requests of the
batch, while a request that was eligible at the start stays so. Most outcomes are therefore
known without the sequence; what isn't is a request whose person isn't among the face's
suggestions at the start. It depends only on acceptances of *similar* faces before it. Those
requests are judged in rounds: all at once by what was accepted before each in the round before,
then those again that an acceptance which came or went can matter to, until none does. Whatever
depends on the first n requests is right after n rounds, so the end is that of the sequence. Each
round is a matching as above: similar faces are never listed, and no task holds a whole batch.

Rankings kept up to date. A face has at most four ranked people with two examples each, and a
bound: the best score of anybody left out. New examples come in by matching them alone,
removed ones promote the second example, rejections promote the next person. Where the bound
can't say who is third any more, the face is ranked again in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.scalars import is_healthy
from mediacat.operators.review import MOST_PEOPLE
from mediacat.operators.tables import checkpointed

MOST_SUGGESTED = 3
#: Examples of a block, and scores taken at once of those that pass it.
BLOCK = 16_384
SCORES = 1 << 20

_FOUND = "id long, tag_id long, example_id long, score float"


def examples_of(faces: DataFrame, dim: int, key: list[str]) -> DataFrame:
    """``(example_id, tag_id, embedding, *key)``: named, undismissed faces with a sound embedding."""
    good = ~F.col("dismissed") & is_healthy("embedding", dim) & F.col("person_tag_id").isNotNull()
    return faces.where(good).select(F.col("id").alias("example_id"), F.col("person_tag_id").alias("tag_id"), "embedding", *key)


def unnamed_of(faces: DataFrame, dim: int, key: list[str]) -> DataFrame:
    """``(face_id, embedding, *key)``: faces that can have suggestions."""
    good = ~F.col("dismissed") & is_healthy("embedding", dim) & F.col("person_tag_id").isNull()
    return faces.where(good).select(F.col("id").alias("face_id"), "embedding", *key)


def _matched(least: np.float32, most: int, ordered: bool):
    """Over rows sorted by block, the examples of a block before the faces that pass it. If
    ``ordered``, a face meets only examples whose ``at`` is less than its own."""

    def best(tags: np.ndarray, ids: np.ndarray, since: np.ndarray, examples: np.ndarray, faces: np.ndarray, of: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        scores = np.clip(faces.astype(np.float64) @ examples.T, -1, 1).astype(np.float32)
        hit = scores >= least
        if ordered:
            hit &= since < at[:, None]
        r, c = np.nonzero(hit)
        s = scores[r, c]
        order = np.lexsort((ids[c], -s, tags[c], r))
        r, c, s = r[order], c[order], s[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (tags[c[1:]] != tags[c[:-1]])]) if len(r) else np.zeros(0, bool)
        place = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)) if len(r) else np.zeros(0, int)
        kept = place < most
        return pd.DataFrame({"id": of[r[kept]], "tag_id": tags[c[kept]], "example_id": ids[c[kept]], "score": s[kept]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, opened = None, [], None
        for b in batches:
            for key, part in b.groupby(b["block"], sort=False):
                if key != block:
                    block, held, opened = key, [], None
                examples = part[part["tag_id"].notna()]
                faces = part[part["tag_id"].isna()]
                if len(examples):
                    held.append((examples["tag_id"].to_numpy(dtype=np.int64), examples["id"].to_numpy(), examples["at"].to_numpy(), np.stack(examples["embedding"].to_numpy()).astype(np.float64)))
                    opened = None
                if len(faces) and held:
                    opened = opened or tuple(np.concatenate([h[k] for h in held]) for k in range(4))
                    held = [opened]
                    step = max(1, SCORES // len(opened[0]))
                    for k in range(0, len(faces), step):
                        some = faces.iloc[k : k + step]
                        yield best(*opened, np.stack(some["embedding"].to_numpy()), some["id"].to_numpy(), some["at"].to_numpy())

    return run


def _met(asked: DataFrame, examples: DataFrame, threshold: float, key: list[str], most: int, ordered: bool) -> DataFrame:
    """``(id, tag_id, example_id, score)``: of each of ``asked`` (id, embedding, at, *key) its
    ``most`` best examples (example_id, tag_id, embedding, at, *key) of each person in each block."""
    examples = checkpointed(examples.select("example_id", "tag_id", "embedding", "at", *key))
    name = F.to_json(F.array(*(F.col(k).cast("string") for k in key))) if key else F.lit("")
    whole = [F.col(k).isNotNull() for k in key]
    keyed = examples.withColumn("key", name).where(_all(whole))
    sizes = checkpointed(keyed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")))  # a row a recognizer and version
    place = F.pmod(F.xxhash64("example_id"), F.col("blocks"))
    dealt = keyed.join(sizes, "key").select(F.xxhash64("key", place).alias("block"), F.col("example_id").alias("id"), "tag_id", "embedding", "at")
    passing = asked.withColumn("key", name).where(_all(whole)).join(sizes, "key")
    passing = passing.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    passing = passing.select(F.xxhash64("key", "part").alias("block"), "id", F.lit(None).cast("long").alias("tag_id"), "embedding", "at")
    rows = dealt.unionByName(passing).repartition("block").sortWithinPartitions("block", F.col("tag_id").isNull())
    return rows.mapInPandas(_matched(np.float32(threshold), most, ordered), _FOUND)


def matches(asked: DataFrame, examples: DataFrame, threshold: float, key: list[str], most: int = 1) -> DataFrame:
    """``(face_id, tag_id, example_id, score)`` of examples that score ``threshold`` or more:
    each face's ``most`` best of each person in each block of examples, ties to the smaller id.
    Only faces and examples with equal ``key`` meet, nulls not; a face isn't its own example."""
    any_time = F.lit(0).cast("long")
    found = _met(asked.withColumnRenamed("face_id", "id").withColumn("at", any_time), examples.withColumn("at", any_time), threshold, key, most, False)
    return found.withColumnRenamed("id", "face_id").where("face_id <> example_id")


def _all(conditions: list):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def keyed_suggestions(faces: DataFrame, rejections: DataFrame, people: DataFrame, dim: int, threshold: float = 0.5, key: list[str] | None = None, most: int = MOST_SUGGESTED, only: DataFrame | None = None) -> DataFrame:
    """``(face_id, tag_id, name, score, rank)``: as :func:`mediacat.operators.faces.suggestions`, with
    examples of the same ``key`` (recognizer and pipeline) only; ``only`` (face_id) asks for some."""
    key = key or []
    asked = unnamed_of(faces, dim, key)
    if only is not None:
        asked = asked.join(only, "face_id", "left_semi")
    found = matches(asked, examples_of(faces, dim, key), threshold, key)
    found = found.groupBy("face_id", "tag_id").agg(F.max("score").alias("score")).join(rejections.select("face_id", "tag_id"), ["face_id", "tag_id"], "left_anti")
    named = found.join(people.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    w = Window.partitionBy("face_id").orderBy(F.desc("score"), "name", "tag_id")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("face_id", "tag_id", "name", "score", "rank")


# ---------------------------------------------------------------- acceptances in sequence

def _places(found: DataFrame, people: DataFrame, refused: DataFrame) -> DataFrame:
    """The best three people ``(seq, tag_id, name, score, place)`` of what was ``found`` (seq, face_id,
    tag_id, score) for each request, without those that its face has ``refused``."""
    best = found.groupBy("seq", "face_id", "tag_id").agg(F.max("score").alias("score")).join(refused, ["face_id", "tag_id"], "left_anti")
    named = best.join(people.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    place = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("score"), "name", "tag_id"))
    return named.withColumn("place", place).where(F.col("place") <= MOST_SUGGESTED)


def _settled(rest: DataFrame, vectors: DataFrame, given: DataFrame, start: DataFrame, refused: DataFrame, people: DataFrame, threshold: float, key: list[str]) -> DataFrame:
    """``(face_id, seq, tag_id)``: which request of its face in ``rest`` is accepted, by rounds.

    ``rest`` (seq, face_id, tag_id, eligible) holds the undecided requests and the eligible ones of
    their faces, ``given`` (face_id, seq, tag_id) what is accepted in any case for other faces, and
    ``start`` (face_id, tag_id, score) the suggestions at the start.
    """
    asked = checkpointed(rest.where("NOT eligible").select("seq", "face_id", "tag_id").join(vectors, "face_id"))
    passing = asked.select(F.col("seq").alias("id"), F.col("seq").alias("at"), "embedding", *key)
    of = asked.select("seq", "face_id", F.col("tag_id").alias("wanted"))
    examples = lambda accepted: accepted.join(vectors, "face_id").select(F.col("face_id").alias("example_id"), "tag_id", "embedding", F.col("seq").alias("at"), *key)

    def found(some: DataFrame, accepted: DataFrame) -> DataFrame:
        hits = _met(some, examples(accepted), threshold, key, 1, True).select(F.col("id").alias("seq"), "tag_id", "score")
        return hits.join(of.select("seq", "face_id"), "seq").select("seq", "face_id", "tag_id", "score")

    base = of.select("seq", "face_id").join(start, "face_id").select("seq", "face_id", "tag_id", "score").unionByName(found(passing, given))
    base = checkpointed(_places(base, people, refused).select("seq", "face_id", "tag_id", "score"))

    def judged(some: DataFrame, accepted: DataFrame) -> DataFrame:
        """``(seq, face_id, tag_id, passes, third)`` of some requests after these acceptances before them."""
        own = of.join(some.select(F.col("id").alias("seq")), "seq", "left_semi")
        best = _places(base.join(own, "seq", "left_semi").unionByName(found(some, accepted)), people, refused)
        third = F.max(F.when(F.col("place") == MOST_SUGGESTED, F.col("score"))).alias("third")
        best = best.join(own.select("seq", "wanted"), "seq").groupBy("seq").agg(F.max(F.col("tag_id") == F.col("wanted")).alias("passes"), third)
        return own.join(best, "seq", "left").select("seq", "face_id", F.col("wanted").alias("tag_id"), F.coalesce("passes", F.lit(False)).alias("passes"), "third")

    def first(passed: DataFrame) -> DataFrame:
        least = passed.groupBy("face_id").agg(F.min(F.struct("seq", "tag_id")).alias("x"))
        return checkpointed(least.select("face_id", "x.seq", "x.tag_id"))

    sure = rest.where("eligible").select("face_id", "seq", "tag_id")
    accepted = first(sure)
    verdicts = checkpointed(judged(passing, accepted))
    while True:
        now = first(sure.unionByName(verdicts.where("passes").select("face_id", "seq", "tag_id")))
        every = ["face_id", "seq", "tag_id"]
        moved = checkpointed(now.join(accepted, every, "left_anti").unionByName(accepted.join(now, every, "left_anti")))
        if moved.isEmpty():
            return now
        # One that is worse than the third place, before or after, is of no account.
        near = _met(passing, examples(moved.withColumn("tag_id", F.lit(0).cast("long"))), threshold, key, 1, True).groupBy(F.col("id").alias("seq")).agg(F.max("score").alias("score"))
        again = checkpointed(near.join(verdicts, "seq").where("third IS NULL OR score >= third").select("seq"))
        some = passing.join(again.withColumnRenamed("seq", "id"), "id", "left_semi")
        verdicts = checkpointed(verdicts.join(again, "seq", "left_anti").unionByName(judged(some, now)))
        accepted = now


def accept_in_order(faces: DataFrame, requests: DataFrame, rejections: DataFrame, people: DataFrame, dim: int, threshold: float = 0.5, key: list[str] | None = None) -> DataFrame:
    """``(seq, face_id, tag_id, outcome)`` of requests ``(seq, face_id, tag_id, revision)`` taken in
    the order of ``seq``: ``accepted``, ``stale`` (another revision by then), ``ineligible``,
    ``not_found`` or ``invalid`` (a number isn't positive).

    An accepted face is an example for later requests. What was a suggestion before the batch
    stays eligible. A face takes one identity a batch; named and dismissed ones have no suggestions.
    """
    key = key or []
    asked = checkpointed(requests.select("seq", "face_id", "tag_id", F.col("revision").alias("expected")))
    invalid = F.coalesce((F.col("face_id") <= 0) | (F.col("tag_id") <= 0) | (F.col("expected") <= 0), F.lit(True))
    known = asked.where(~invalid).join(faces.select(F.col("id").alias("face_id"), "revision"), "face_id", "left")
    first = checkpointed(keyed_suggestions(faces, rejections, people, dim, threshold, key, only=asked.select("face_id").distinct()))
    fresh = F.col("revision") == F.col("expected")
    known = known.join(first.select("face_id", "tag_id", F.lit(True).alias("listed")), ["face_id", "tag_id"], "left").withColumn("eligible", fresh & F.coalesce("listed", F.lit(False)))
    # From a face's first eligible request on, its revision has moved in any case.
    sure = F.min(F.when(F.col("eligible"), F.col("seq"))).over(Window.partitionBy("face_id"))
    known = known.join(rejections.select("face_id", "tag_id", F.lit(True).alias("refused")).distinct(), ["face_id", "tag_id"], "left")
    known = known.join(unnamed_of(faces, dim, key).select("face_id", F.lit(True).alias("open")), "face_id", "left").join(people.select(F.col("id").alias("tag_id"), "name"), "tag_id", "left").withColumn("sure", sure)
    open_ = fresh & ~F.col("eligible") & F.coalesce("open", F.lit(False)) & F.col("refused").isNull() & F.col("name").isNotNull() & F.coalesce(F.col("seq") < F.col("sure"), F.lit(True))
    known = checkpointed(known.withColumn("undecided", open_).withColumn("folded", F.max("undecided").over(Window.partitionBy("face_id"))))
    plain = (
        F.when(F.col("revision").isNull(), "not_found")
        .when(F.col("seq") > F.col("sure"), F.when(F.col("expected") == F.col("revision") + 1, "ineligible").otherwise("stale"))
        .when(~fresh, "stale")
        .when(F.col("eligible"), "accepted")
        .otherwise("ineligible")
    )
    known = known.withColumn("plain", plain)

    # The rest: requests of faces with an undecided one.
    vectors = unnamed_of(faces, dim, key)
    given = known.where("plain = 'accepted' AND NOT folded").select("face_id", "seq", "tag_id")
    rest = checkpointed(known.where("folded AND (undecided OR eligible)").select("seq", "face_id", "tag_id", "eligible"))
    taken = _settled(rest, vectors, given, first.select("face_id", "tag_id", "score"), rejections.select("face_id", "tag_id"), people, threshold, key)
    named = rest.select("seq", "face_id").join(taken.select("face_id", F.col("seq").alias("at")), "face_id", "left")
    named = named.select("seq", F.when(F.col("seq") == F.col("at"), "accepted").when(F.col("seq") > F.col("at"), "stale").otherwise("ineligible").alias("found"))
    # A request that stays ineligible in the rounds is stale if its face was accepted before it.
    out = known.join(named, "seq", "left").withColumn("taken", F.min(F.when(F.coalesce(F.col("found") == "accepted", F.lit(False)) | (~F.col("folded") & (F.col("plain") == "accepted")), F.col("seq"))).over(Window.partitionBy("face_id")))
    after = F.coalesce(F.col("seq") > F.col("taken"), F.lit(False))
    outcome = F.when(after & (F.col("plain") != "not_found"), F.when(F.col("expected") == F.col("revision") + 1, "ineligible").otherwise("stale")).when(F.col("found").isNotNull(), F.col("found")).when(F.col("revision").isNotNull() & ~fresh, "stale").otherwise(F.col("plain"))
    done = out.select("seq", "face_id", "tag_id", outcome.alias("outcome"))
    return done.unionByName(asked.where(invalid).select("seq", "face_id", "tag_id", F.lit("invalid").alias("outcome")))


def apply_acceptances(faces: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The faces after the accepted requests of :func:`accept_in_order`."""
    new = outcomes.where("outcome = 'accepted'").select(F.col("face_id").alias("id"), F.col("tag_id").alias("new"))
    out = faces.join(new, "id", "left").withColumn("person_tag_id", F.coalesce("new", "person_tag_id"))
    return out.withColumn("revision", F.col("revision") + F.col("new").isNotNull().cast("int")).select(faces.columns)


# ---------------------------------------------------------------- rankings kept up to date

MOST_EXAMPLES = 2


def _merged(found: DataFrame, people: DataFrame, known: DataFrame | None = None, bounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rankings, undecided)`` of listed examples ``found``; ``known`` (face_id, tag_id, rest) are
    the people ranked before, ``bounds`` (face_id, omitted) what was said of anybody else."""
    none = lambda columns: found.sparkSession.createDataFrame([], columns)
    known = known if known is not None else none("face_id long, tag_id long, rest float")
    bounds = bounds if bounds is not None else none("face_id long, omitted float")
    place = F.row_number().over(Window.partitionBy("face_id", "tag_id").orderBy(F.desc("score"), "example_id"))
    slots = found.withColumn("place", place).where(F.col("place") <= MOST_EXAMPLES + 1)
    at = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    own = slots.groupBy("face_id", "tag_id").agg(at("score", 1).alias("score"), at("example_id", 1).alias("example_id"), at("score", 2).alias("second_score"), at("example_id", 2).alias("second_id"), at("score", 3).alias("third"))
    own = own.join(known.withColumn("listed", F.lit(True)), ["face_id", "tag_id"], "full").join(bounds, "face_id", "left")
    # A person who wasn't listed can have examples as good as the bound, beside the new ones.
    own = own.withColumn("rest", F.greatest("third", F.when(F.col("listed"), F.col("rest")).otherwise(F.col("omitted"))))
    sure = F.coalesce(F.col("score") >= F.coalesce("rest", F.lit(float("-inf"))), F.lit(False))
    own = checkpointed(own.join(people.select(F.col("id").alias("tag_id"), "name"), "tag_id").withColumn("sure", sure))

    loose = own.where(~F.col("sure")).groupBy("face_id").agg(F.max("rest").alias("loose"))
    bounds = bounds.join(loose, "face_id", "full").select("face_id", F.greatest("omitted", "loose").alias("bound"))
    ranked = own.where("sure").drop("omitted").join(bounds, "face_id", "left").where("bound is null or score > bound")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("face_id").orderBy(F.desc("score"), "name", "tag_id"))).where(F.col("rank") <= MOST_PEOPLE + 1)
    fifth = F.max(F.when(F.col("rank") == MOST_PEOPLE + 1, F.col("score"))).over(Window.partitionBy("face_id"))
    ranked = ranked.withColumn("omitted", F.greatest("bound", fifth)).where(F.col("rank") <= MOST_PEOPLE)
    ranked = checkpointed(ranked.select("face_id", "tag_id", "name", "score", "example_id", "second_score", "second_id", "rest", "rank", "omitted"))
    counts = ranked.groupBy("face_id").agg(F.count("*").alias("n"))
    undecided = bounds.where("bound is not null").join(counts, "face_id", "left").where(F.coalesce("n", F.lit(0)) < MOST_SUGGESTED)
    return ranked, undecided.select("face_id")


def rankings(faces: DataFrame, rejections: DataFrame, people: DataFrame, dim: int, threshold: float = 0.5, key: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """``(face_id, tag_id, name, score, example_id, second_score, second_id, rest, rank, omitted)``:
    each unnamed face's four best people with their two best examples.

    ``rest`` is the best score that another example of the person may have, ``omitted`` that which
    anybody left out may have; null if there is none. The first three are the face's suggestions.
    ``only`` (face_id) asks for some faces.
    """
    key = key or []
    asked = unnamed_of(faces, dim, key)
    if only is not None:
        asked = asked.join(only.select("face_id").distinct(), "face_id", "left_semi")
    found = matches(asked, examples_of(faces, dim, key), threshold, key, MOST_EXAMPLES + 1)
    return _merged(found.join(rejections.select("face_id", "tag_id"), ["face_id", "tag_id"], "left_anti"), people)[0]


def updated_rankings(state: DataFrame, faces: DataFrame, rejections: DataFrame, people: DataFrame, dim: int, changed: DataFrame, threshold: float = 0.5, key: list[str] | None = None, cleared: DataFrame | None = None) -> DataFrame:
    """The :func:`rankings` ``state`` after the faces ``changed`` (id) got the rows that ``faces``
    has now, faces got more ``rejections``, and those of the faces ``cleared`` (face_id) were taken
    back. The first three people and their scores are those of a new ranking; of equally good
    examples another may be named, and fewer people may follow.

    Only examples that changed are matched. Changed and cleared faces are ranked in full, and
    those where the bounds leave open who is third.
    """
    key = key or []
    ids = checkpointed(changed.select(F.col("id").alias("face_id")).distinct())
    again = ids if cleared is None else ids.unionByName(cleared.select("face_id")).distinct()
    refused = rejections.select("face_id", "tag_id")
    kept = checkpointed(state.join(again, "face_id", "left_anti"))
    own = kept.join(refused, ["face_id", "tag_id"], "left_anti")
    slot = F.explode(F.array(F.struct("example_id", "score"), F.struct(F.col("second_id").alias("example_id"), F.col("second_score").alias("score"))))
    as_example = ids.withColumnRenamed("face_id", "example_id")
    old = own.select("face_id", "tag_id", slot.alias("slot")).select("face_id", "tag_id", "slot.*").where("example_id is not null").join(as_example, "example_id", "left_anti")
    asked = unnamed_of(faces, dim, key).join(again, "face_id", "left_anti")
    new = matches(asked, examples_of(faces, dim, key).join(as_example, "example_id", "left_semi"), threshold, key, MOST_EXAMPLES + 1).join(refused, ["face_id", "tag_id"], "left_anti")
    found = old.select("face_id", "tag_id", "example_id", "score").unionByName(new.select("face_id", "tag_id", "example_id", "score"))
    ranked, undecided = _merged(found, people, own.select("face_id", "tag_id", "rest"), kept.select("face_id", "omitted").distinct())
    undecided = checkpointed(undecided)
    full = rankings(faces, rejections, people, dim, threshold, key, undecided.unionByName(again))
    return ranked.join(undecided, "face_id", "left_anti").unionByName(full)
