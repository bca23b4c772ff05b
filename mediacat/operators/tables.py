"""Lineage cuts for iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder serves in local mode; on a cluster, which wouldn't share it, ``ValueError``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="mediacat-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def checkpointed_round(df: DataFrame) -> DataFrame:
    """:func:`checkpointed` for the narrow rows of a round that joins what the last one left.

    A checkpoint keeps the estimated size of its plan, which for a join is the product of both
    sides. Of rows that are joined with themselves round after round it gets four times as many
    digits or more each time, until the driver has no room for one number. Rows that pass
    through an RDD come without an estimate.
    """
    return checkpointed(df.sparkSession.createDataFrame(df.rdd, df.schema, verifySchema=False))


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its rows' places in ``order``, from 1, without sorting them in one task: rows are
    sorted by ranges, and each range begins after the sum of those before it (a row a task)."""
    at = checkpointed(df.orderBy(*order)).withColumn("mediacat_at", F.monotonically_increasing_id())
    at = at.withColumn("mediacat_part", F.shiftright("mediacat_at", 33)).withColumn("mediacat_at", F.col("mediacat_at").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = at.groupBy("mediacat_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("mediacat_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("mediacat_part", F.coalesce(before, F.lit(0)).alias("mediacat_before"))
    out = at.join(F.broadcast(parts), "mediacat_part").withColumn(name, F.col("mediacat_before") + F.col("mediacat_at") + 1)
    return out.select(*df.columns, name)


def by_link(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` semi or anti joined with ``right`` by (media_id, tag_id). Items are the only key of the
    join and tags its condition, so links that are dealt by item (as the adapters do) stay
    in their parts, where a join by both columns would shuffle them again."""
    of = right.select(F.col("media_id").alias("mediacat_media"), F.col("tag_id").alias("mediacat_tag"))
    return left.join(of, (F.col("media_id") == F.col("mediacat_media")) & F.col("tag_id").between(F.col("mediacat_tag"), F.col("mediacat_tag")), how)


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], folder: Callable[[], Callable[[tuple], object]], name: str, kind: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and a column ``name``, what a state machine says of each row.

    Rows are dealt by ``keys`` and sorted by keys and ``order``; ``folder()`` makes a machine
    for one task, which is called with the rows as tuples in that order and sees for itself
    when a key begins. Groups stream by, so their number costs nothing and no group is held.
    """
    kinds, columns = dict(df.dtypes), df.columns
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = folder()
        for b in batches:
            out = [machine(r) for r in zip(*(b[c].tolist() for c in columns), strict=True)] if len(b) else []
            yield b[keep].assign(**{name: pd.Series(out, index=b.index, dtype="int64")})

    return rows.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{name} {kind}"]))
