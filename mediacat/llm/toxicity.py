"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts and unlabelled text. With
the class prior p, the scores of positives P and of the unlabelled U, and a loss l,

    risk = p * mean_P l(+) + max(0, mean_U l(-) - p * mean_P l(-))

estimates the risk over labelled negatives without having any; where the second part turns
negative (the model starts to fit single unlabelled texts), the step goes against it
instead, after Kiryo et al. (2017). Features of a text are the presence of its words and of
the first four and five letters of longer words; a text's score is the logistic function of
its features' weights and a bias, without division by length, so that one passage in a long
text counts.

Positives are a sample of at most ``MOST_POSITIVE`` labelled rows, chosen by a hash of id and
text, repeated rows once. All else covers all rows: the unlabelled texts with each feature are
counted by Spark, and the features kept are all that mark toxic texts by the same class
prior. Then the unlabelled rows, as places of their features with a count for each pattern,
are dealt into parts of about ``PART_ROWS`` rows. On each part and the positives a classifier
is trained in numpy, and the model is the mean of their weights by rows. Scoring covers
every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.common import join_in_place, materialize

MOST_POSITIVE = 4000
PART_ROWS = 12_000
MARKS = 0.4
FOLDS = 5
#: Most tasks that train; each takes its parts one after the other.
MOST_TASKS = 4096
_WORD = re.compile(r"[^\W\d_]+")
_NO_LETTER = {c: " " for c in range(128) if not chr(c).isalpha()}


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows of fold 0 are held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def _words(text: str | None) -> set[str]:
    """The distinct runs of letters of a whole text in lower case; none of an empty one."""
    if not text:
        return set()
    text = text.lower()
    return set(text.translate(_NO_LETTER).split()) if text.isascii() else set(_WORD.findall(text))


def features(text: str | None) -> list[str]:
    """The distinct features of a whole text: its words, and as ``abcd*`` and ``abcde*`` the
    beginnings of those with more than four letters."""
    words = _words(text)
    long = [w for w in words if len(w) > 4]
    return sorted(words | {w[:4] + "*" for w in long} | {w[:5] + "*" for w in long})


@dataclass(frozen=True)
class Model:
    """Weights of features, in ascending order of their names."""

    names: np.ndarray
    weights: np.ndarray
    bias: float


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def select_features(names: np.ndarray, p: np.ndarray, u: np.ndarray, n_positive: int, n_unlabelled: int, prior: float) -> np.ndarray:
    """The features that mark toxic texts; ``p`` and ``u`` say how many positive and unlabelled
    texts have each. By Bayes' rule a text with a feature is toxic with probability prior *
    share of positives / share of unlabelled; kept are all features for which this, with the
    first share lowered by its standard error, is above ``MARKS``."""
    share = p / n_positive
    toxic = prior * (share - np.sqrt(share * (1 - share) / n_positive)) / ((u + 1) / (n_unlabelled + 1))
    return np.sort(names[(p > 1) & (toxic > MARKS)])


class Rows:
    """Texts as places of their features, flat, each with the number of texts that are like it."""

    def __init__(self, places: list, counts: np.ndarray | None = None):
        self.share = np.ones(len(places)) if counts is None else np.asarray(counts, dtype=float)
        self.share = self.share / self.share.sum()
        self.places = np.concatenate([np.asarray(x, dtype=np.int64) for x in places])
        self.row = np.repeat(np.arange(len(places)), [len(x) for x in places])

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return _logistic(np.bincount(self.row, weights=w[self.places], minlength=len(self.share)) + b)

    def gradient(self, g: np.ndarray, n: int) -> np.ndarray:
        """Of the weights and the bias, from the gradient by each row's sum."""
        return np.append(np.bincount(self.places, weights=g[self.row], minlength=n), g.sum())


def risk(w: np.ndarray, b: float, positive: Rows, unlabelled: Rows, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of the sigmoid loss l(+) = 1 - score, l(-) = score, whose bound
    keeps single texts from ruling the estimate, and the direction of the step: its gradient,
    or that of the negated second part where that part is negative."""
    sp, su = positive.scores(w, b), unlabelled.scores(w, b)
    dp, du = positive.share * sp * (1 - sp), unlabelled.share * su * (1 - su)
    negative = float(unlabelled.share @ su - prior * (positive.share @ sp))
    of_negative = unlabelled.gradient(du, len(w)) - prior * positive.gradient(dp, len(w))
    value = prior * float(positive.share @ (1 - sp)) + max(0.0, negative)
    return value, of_negative - prior * positive.gradient(dp, len(w)) if negative >= 0 else -of_negative


def fit(n: int, positive: Rows, unlabelled: Rows, prior: float, steps: int = 320, rate: float = 0.05, decay: float = 1e-5) -> np.ndarray:
    """Weights of the n features and the bias, by Adam on :func:`risk`. Deterministic."""
    x, m, v = np.append(np.zeros(n), -1.0), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        g = risk(x[:-1], x[-1], positive, unlabelled, prior)[1]
        g[:-1] += decay * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


class _Places:
    """The places of texts' features among some names."""

    def __init__(self, names: np.ndarray):
        place = {x: k for k, x in enumerate(names)}
        self.word = {x: k for x, k in place.items() if not x.endswith("*")}
        self.begin = [{x[:-1]: k for x, k in place.items() if x.endswith("*") and len(x) == n + 1} for n in (4, 5)]
        self.known = [frozenset(x) for x in (self.word, *self.begin)]

    def of(self, text: str | None) -> list[int]:
        words = _words(text)
        long = [w for w in words if len(w) > 4]
        found = [self.word[w] for w in words & self.known[0]]
        found += [self.begin[0][w] for w in {w[:4] for w in long} & self.known[1]]
        found += [self.begin[1][w] for w in {w[:5] for w in long} & self.known[2]]
        return sorted(found)


def _places(names: np.ndarray):
    """A function of a text column that gives the places of its features in ``names``."""

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Places(names)
        for texts in batches:
            yield texts.map(known.of, na_action=None)

    return found


def _texts_with(texts: DataFrame, names: np.ndarray) -> np.ndarray:
    """How many of the texts have each of some features, summed in each task and then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = _Places(names), np.zeros(len(names), dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                n[known.of(text.as_py())] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["place", "n"])

    out = np.zeros(len(names))
    for place, n in texts.select("text").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n")).collect():  # a row a feature
        out[place] = n
    return out


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """``(features)``: at most ``most`` of the distinct rows ``(id, text)``, those of small hash. Materialized."""

    @F.pandas_udf("array<string>")
    def named(texts: pd.Series) -> pd.Series:
        return texts.map(features, na_action=None)

    drawn = rows.select(named("text").alias("features"), F.xxhash64(F.lit("sample"), "id", "text").alias("place"))
    return materialize(drawn.groupBy("place").agg(F.first("features").alias("features")).orderBy("place").limit(most).select("features"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = MOST_POSITIVE) -> Model:
    """Fit on rows outside the held-out fold. The class prior is the share of positives among
    the labelled ids of those folds; an id with several labels counts with the largest.
    Without positives or texts the model has no features and rejects nothing. Rows with one
    id, and rows without one, are counted like others; a repeated row is one positive.
    """
    empty = Model(np.array([], dtype=object), np.array([]), -3.0)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where((fold("id") != 0) & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    known = materialize(known)
    n, n_labelled = known.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(fold("id") != 0)
    rows = texts.count()
    if not n_labelled or not rows:
        return empty
    prior = n_labelled / n
    ids = known.where("y = 1").select("id")
    if n_labelled > 2 * most_positive:  # about twice the sample; the rest couldn't be in it often
        ids = ids.where(F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 30)) < int(2 * most_positive / n_labelled * (1 << 30)))
    sample = _sampled(join_in_place(texts, materialize(ids), ["id"], "inner").select("id", "text"), most_positive)
    n_positive = sample.count()
    counts = sample.select(F.explode("features").alias("feature")).groupBy("feature").count().where("count > 1").toPandas().sort_values("feature")
    if not len(counts):
        return empty
    candidates, p = counts["feature"].to_numpy(object), counts["count"].to_numpy(float)
    names = select_features(candidates, p, _texts_with(texts, candidates), n_positive, rows, prior)
    if not len(names):
        return empty

    @F.pandas_udf("array<int>")
    def kept(found: pd.Series) -> pd.Series:
        place = {x: k for k, x in enumerate(names)}
        return found.map(lambda x: [place[f] for f in x if f in place])

    positive = [r[0] for r in sample.select(kept("features")).collect()]
    parts = -(-rows // PART_ROWS)
    dealt = texts.select(_places(names)("text").alias("places"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("part"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = fit(len(names), Rows(positive), Rows(part["places"].tolist(), part["n"].to_numpy()), prior)
        return pd.DataFrame({"place": np.arange(len(x)), "weight": x * part["n"].sum()})

    # A set number of tasks: parts are small in bytes but not in work, and mustn't be coalesced.
    patterns = dealt.groupBy("part", "places").agg(F.count("*").alias("n")).repartition(min(parts, MOST_TASKS), "part")
    fitted = patterns.groupBy("part").applyInPandas(run, "place int, weight double")
    x = np.zeros(len(names) + 1)
    for place, weight in fitted.groupBy("place").agg(F.sum("weight")).collect():  # a row a feature
        x[place] = weight / rows
    return Model(names, x[:-1], float(x[-1]))


def toxicity_score(model: Model):
    """A function of a text column that gives the score, 0 to 1; null texts count as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Places(model.names)
        for texts in batches:
            yield texts.map(lambda t: float(_logistic(model.bias + model.weights[known.of(t)].sum())), na_action=None).astype("float64")

    return scored


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every row of ``docs``."""
    scored = toxicity_score(train(docs, labels, id_col, text_col, label_col))
    out = docs.select(F.col(id_col), (fold(id_col) == 0).alias("held_out"), scored(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
