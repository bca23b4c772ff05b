"""Hard negatives by a full sort of scores per anchor.

Components become the integers ``floor(256 * x)``, and a row's score is its inner product with
the anchor. Rows are packed into blocks of a few MB, each a row of a table. Anchors, a set that
the caller states, pass every block in batches: only they are repeated, once for each block.
For an anchor, a block's scores are computed at once and sorted by score and id, and two steps
read the sorted run:

1. the first rows of the anchor's label are its positives; those of all blocks are merged;
2. for each positive, a binary search finds the upper limit, and the first k rows of other labels
   that are above the lower limit are read; those of all blocks are merged.

Every block returns the first few rows of its own, and the first few of all are among them, so
results are exact. A task holds one block, one batch of anchors and the scores of a few anchors.
Rows are dealt by number, so neither a label nor a vector that many rows share matters.

Scores are exact: by float64 where all sums stay below 2^53, by 64-bit integers where those
suffice, else by Python's integers, and beyond 64 bits they are held at the ends of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.llm.common import materialize

#: Components in a block, and anchors that are sent together.
BLOCK_NUMBERS = 1 << 20
BATCH = 256
#: Scores that are sorted at once.
SCORES = 1 << 21
MOST_TASKS = 4096

_LONG = 1 << 63


def prepared(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``(row, id, label, dim, vector)`` of the rows that take part: label and vector not null,
    components finite and not null. ``vector`` holds ``floor(256 * x)``. Materialized, so that
    ``row`` names a row for good."""
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & v.isNotNull() & good)
    # floor() of a double is a 64-bit integer in Spark, which large components pass.
    whole = rows.withColumn("vector", F.transform(v, lambda x: F.when(F.abs(x) < 1e15, F.floor(x * 256).cast("double")).otherwise(x * 256)))
    whole = whole.where(F.forall(v, lambda x: F.abs(x) < float("inf")))
    return materialize(whole.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size(v).cast("long").alias("dim"), "vector"))


_BLOCK = "dim bigint, block bigint, n bigint, rows binary, ids binary, nulls binary, labels binary, vectors binary"


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A block: its rows by id, a null id last, so that a place stands for the order of ties."""
    dim, block = key
    nulls = rows["id"].isna().to_numpy()
    ids = rows["id"].where(~nulls, "0").to_numpy(dtype=str).astype(np.int64)
    order = np.lexsort((rows["row"].to_numpy(), ids, nulls))
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64).reshape(len(rows), int(dim))[order]
    columns = [rows["row"].to_numpy()[order], ids[order], nulls[order], rows["label"].to_numpy()[order], vectors]
    return pd.DataFrame([(dim, block, len(rows), *(c.tobytes() for c in columns))], columns=["dim", "block", "n", "rows", "ids", "nulls", "labels", "vectors"])


def blocks(rows: DataFrame) -> DataFrame:
    """The :func:`prepared` rows in blocks of vectors of one length. Materialized."""
    size = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest("dim", F.lit(16))))
    of = materialize(rows.groupBy("dim").agg(F.ceil(F.count("*") / F.first(size)).alias("blocks")))
    dealt = rows.join(F.broadcast(of), "dim") if of.count() <= 4096 else rows.join(of, "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).withColumn("id", F.col("id").cast("string"))
    return materialize(dealt.groupBy("dim", "block").applyInPandas(_packed, _BLOCK))


class _Block:
    """A block, opened."""

    def __init__(self, row: dict):
        self.key = (row["dim"], row["block"])
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("rows", "ids", "labels"))
        self.nulls = np.frombuffer(row["nulls"], dtype=bool)
        self.vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(row["n"], row["dim"])
        self.most = float(np.abs(self.vectors).max(initial=0))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products of all rows with each anchor."""
        bound = self.most * float(np.abs(anchors).max(initial=0)) * self.key[0]
        if bound < 2.0**53:
            return (anchors @ self.vectors.T).astype(np.int64)
        if bound < 2.0**62:
            return anchors.astype(np.int64) @ self.vectors.T.astype(np.int64)
        exact = [[max(-_LONG, min(_LONG - 1, sum(int(x) * int(y) for x, y in zip(a, v, strict=True)))) for v in self.vectors] for a in anchors]
        return np.array(exact, dtype=np.int64).reshape(len(anchors), len(self.vectors))


def limits(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest score s with ``low * positive <= 100 * s <= high * positive``."""
    return -((-low * positive) // 100), (high * positive) // 100


def first_positives(block: _Block, score: np.ndarray, row: int, label: int, n: int) -> np.ndarray:
    """The places of the n first rows of the anchor's label but its own."""
    own = np.flatnonzero((block.labels == label) & (block.rows != row))
    return own[np.argsort(~score[own], kind="stable")[:n]]  # the complement turns the order and keeps ties


def first_negatives(order: np.ndarray, falling: np.ndarray, positive: int, low: int, high: int, k: int) -> np.ndarray:
    """Of rows in ``order``, the first k whose scores are within the positive's limits;
    ``falling`` has the complements of their scores, which rise."""
    least, most = limits(positive, low, high)
    start, end = np.searchsorted(falling, ~np.int64(most), side="left"), np.searchsorted(falling, ~np.int64(least), side="right")
    return order[start : min(end, start + k)]


_ASKED = ["row", "id", "label", "vector", "positives", "scores"]
_FOUND = "anchor bigint, anchor_id bigint, positive bigint, row bigint, id bigint, score bigint"


def _mine(n_positives: int, k: int, low: int, high: int, negatives: bool):
    """Over rows sorted by block, the block before its anchors: each anchor's first rows in it."""

    def search(block: _Block, asked: list[dict]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(6)]
        part = max(1, SCORES // max(1, len(block.rows)))
        for at in range(0, len(asked), part):
            some = asked[at : at + part]
            scores = block.scores(np.array([a["vector"] for a in some], dtype=np.float64).reshape(len(some), block.key[0]))
            for a, score in zip(some, scores, strict=True):
                if negatives:
                    other = np.flatnonzero(block.labels != a["label"])
                    order = other[np.argsort(~score[other], kind="stable")]
                    falling = ~score[order]
                    picks = [(p, first_negatives(order, falling, s, low, high, k)) for p, s in zip(a["positives"], a["scores"], strict=True)]
                else:
                    picks = [(None, first_positives(block, score, a["row"], a["label"], n_positives))]
                for positive, places in picks:
                    m = len(places)
                    for column, values in zip(columns, ([a["row"]] * m, [a["id"]] * m, [positive] * m, block.rows[places].tolist(), [None if x else y for x, y in zip(block.nulls[places].tolist(), block.ids[places].tolist(), strict=True)], score[places].tolist()), strict=True):
                        column += values
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "anchor_id", "positive", "row", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            for j, opens in enumerate(b.column(b.schema.names.index("n")).is_valid().to_pylist()):
                row = b.slice(j, 1).to_pylist()[0]
                if opens:
                    block = _Block(row)
                elif block is not None and block.key == (row["dim"], row["block"]):
                    yield search(block, row["asked"])

    return run


def _passed(index: DataFrame, anchors: DataFrame, mine) -> DataFrame:
    """What ``mine`` finds for the anchors in every block of vectors of their length."""
    n = anchors.groupBy("dim").agg(F.ceil(F.count("*") / BATCH).alias("batches"))
    batches = anchors.join(n, "dim").withColumn("batch", F.pmod(F.xxhash64("row"), "batches")).groupBy("dim", "batch").agg(F.collect_list(F.struct(*_ASKED)).alias("asked"))
    keys = index.select("dim", "block")
    sent = batches.join(keys, "dim").select("dim", "block", "asked")
    tasks = min(MOST_TASKS, max(1, 2 * keys.count()))
    both = index.unionByName(sent, allowMissingColumns=True).repartition(tasks, "dim", "block").sortWithinPartitions("dim", "block", F.col("n").isNull())
    return both.mapInArrow(mine, _FOUND)


def hard_negatives(df: DataFrame, anchors, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows of ``df`` for which the Column ``anchors`` (over ``id_col``) is true. An
    anchor's positives are its first ``positives`` other rows of the same label; for each, the
    first ``k`` rows of other labels with ``low * positive_score <= 100 * negative_score <= high *
    positive_score`` are returned, all by score descending, ties to the smaller id.

    Rows with a null label, a null vector, or a null or non-finite component (also after the
    factor 256) take no part. A repeated row is a row of its own: it can be the positive of its
    twin, and each of two equal anchors has its results. A null id comes last among ties. Vectors
    of different lengths never meet. Other columns are ignored.
    """
    rows = prepared(df, id_col, label_col, vector_col)
    index = blocks(rows)
    chosen = rows.withColumnRenamed("id", id_col).where(anchors).withColumnRenamed(id_col, "id")
    none = F.lit(None).cast("array<bigint>")
    asked = materialize(chosen.withColumns({"positives": none, "scores": none}))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    found = _passed(index, asked, _mine(positives, k, low, high, False))
    first = materialize(found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("rank") <= positives))
    own = first.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("row", "score")).alias("own"))
    asked = materialize(chosen.join(own, "row").select(*chosen.columns, F.col("own.row").alias("positives"), F.col("own.score").alias("scores")))
    found = _passed(index, asked, _mine(positives, k, low, high, True))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))).where(F.col("rank") <= k)
    named = first.select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
