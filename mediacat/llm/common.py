"""Shared helpers: shared folders, lineage cuts, checked broadcasts and joins that leave texts in place."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few dozen bytes a row may be broadcast.
BROADCAST_ROWS = 50_000
#: Bits of a key filter: so many a key, up to a bound that is broadcast at any size (4 MB: the
#: driver holds a filter several times over while it is collected, built and sent).
BITS_A_KEY = 16
MOST_BITS = 1 << 25
#: Bits in one row of a filter, as Spark's bitmap functions have them.
_BITMAP = 32_768
#: Parts of a hot key in :func:`salted_join`.
SALTS = 8

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary one in
    local mode; on a cluster executors don't share one, so that raises ``ValueError``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="mediacat-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialize_round(df: DataFrame) -> DataFrame:
    """:func:`materialize` for the narrow rows of a round that joins what the last one left.

    A checkpoint keeps the estimated size of its plan, which for a join is the product of both
    sides. Of rows that are joined with themselves round after round it gets four times as many
    digits or more each time, until the driver has no room for one number. Rows that pass
    through an RDD come without an estimate.
    """
    return materialize(df.sparkSession.createDataFrame(df.rdd, df.schema, verifySchema=False))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count proves that ``df`` has at most ``rows`` rows. ``df`` should be materialized."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark the narrow, materialized ``df`` for broadcast when :func:`is_small` holds.

    Beyond the bound ``df`` is returned unmarked, and the join shuffles (adaptive
    execution splits its skewed partitions). Only narrow tables may be joined so; for
    rows that hold texts there are :func:`narrowed` and :func:`join_in_place`.
    """
    return F.broadcast(df) if is_small(df, rows) else df


def text_or_empty(name: str):
    """The column as a string, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# ---------------------------------------------------------------- keys of many rows, in bounded space


def _places(on: list[str], bits: int) -> tuple[Column, Column, Column]:
    """The row of a filter that a key belongs to, and its two bits in it."""
    place = F.pmod(F.xxhash64(F.lit("filter"), *on), F.lit(bits)) + 1
    return F.bitmap_bucket_number(place), F.bitmap_bit_position(place), F.pmod(F.xxhash64(F.lit("second"), *on), F.lit(_BITMAP))


def _is_set(bits: str, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), at.bitwiseAND(F.lit(7).cast("bigint")).cast("int") + 1)) != 0


def with_maybe(rows: DataFrame, keys: DataFrame, on: list[str], name: str = "mediacat_maybe") -> DataFrame:
    """``rows`` with the boolean column ``name``: false only where ``keys`` has no such key.

    The keys set two bits each of a filter, which is broadcast: at most ``MOST_BITS``,
    however many keys there are. Of other rows, about one in 70 is marked for as long as the
    bound allows ``BITS_A_KEY`` bits a key, and more beyond it.
    """
    bits = _BITMAP
    wanted = min(MOST_BITS, BITS_A_KEY * keys.count())
    while bits < wanted:
        bits *= 2
    bucket, first, second = _places(on, bits)
    filled = keys.select(bucket.alias("mediacat_bucket"), F.explode(F.array(first, second)).alias("bit"))
    filled = materialize(filled.groupBy("mediacat_bucket").agg(F.bitmap_construct_agg("bit").alias("mediacat_bits")))
    marked = rows.withColumn("mediacat_bucket", bucket).join(F.broadcast(filled), "mediacat_bucket", "left")
    hit = _is_set("mediacat_bits", first) & _is_set("mediacat_bits", second)
    return marked.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(hit, F.lit(False)).alias(name))


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Those of ``rows`` that may have a key of ``keys``, and few others (:func:`with_maybe`)."""
    return with_maybe(rows, keys, on).where("mediacat_maybe").drop("mediacat_maybe")


def join_in_place(rows: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined with the narrow, materialized ``table`` of distinct keys; ``how`` is
    ``inner``, ``left`` or ``left_anti``. Rows whose key the table's filter excludes stay where
    they are at every size of the table; only the others, and a few by chance, are shuffled."""
    if is_small(table):
        return rows.join(F.broadcast(table), on, how)
    if how == "inner":
        return narrowed(rows, table, on).join(table, on)
    marked = with_maybe(rows, table.select(*on), on)
    apart = marked.where(~F.col("mediacat_maybe")).drop("mediacat_maybe")
    joined = marked.where("mediacat_maybe").drop("mediacat_maybe").join(table, on, how)
    return apart.unionByName(joined, allowMissingColumns=True)


def salted_join(left: DataFrame, right: DataFrame, on: str, spread: str) -> DataFrame:
    """Inner join of a table in which a key may be hot with one of distinct keys: rows of a
    key are dealt by ``spread`` into ``SALTS`` parts, and ``right`` is repeated for each."""
    dealt = left.withColumn("mediacat_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("mediacat_salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    return dealt.join(repeated, [on, "mediacat_salt"]).drop("mediacat_salt")


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``(mediacat_file, mediacat_at)``, which name a row in every evaluation.

    Of rows read from files they are a hash of the file's path and the row's number in it,
    so nothing is copied; any other table is materialized with numbers.
    """
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias("mediacat_file"), F.col("_metadata.row_index").alias("mediacat_at"))
    except AnalysisException:
        return materialize(docs.withColumns({"mediacat_file": F.lit(0).cast("bigint"), "mediacat_at": F.monotonically_increasing_id()}))
