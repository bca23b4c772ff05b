"""Packing into optimal length buckets.

A global histogram of token counts (each distinct count with its rows and tokens) goes to a
dynamic program that places the boundaries of the buckets so that padding every row
to the largest count of its bucket adds as few tokens as possible. Inside each bucket,
rows form batches under a token budget: as many rows as fit when padded, at least one.

The histogram is exact. Rows of d distinct counts hold at least d * d / 2 tokens, so it has
some 245,000 rows at 30 GB of bytes at most. The program's costs satisfy the quadrangle
inequality, so the best starts of last buckets never move back, and each bucket's round
takes d log d steps by divide and conquer. A bucket that holds more rows
than ``LANE_ROWS`` is dealt into lanes by a hash of the row's number, repeated rows like any
others, and each lane numbers its own rows, so no task sorts a whole bucket; a lane ends with
at most one batch that isn't full. Batches name rows and their token counts; token
sequences aren't built, as a tokenizer's output would only be carried along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.llm.common import materialize, text_or_empty

LANE_ROWS = 100_000


def _one_more(best: np.ndarray, largest: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least padding of the first j bins with one more bucket, and the first bin of the last.

    All middles of a level are searched at once, each between its neighbours' choices.
    """
    n = len(largest)
    now, choice = np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    lo, hi, first, last = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        j = (lo + hi) // 2
        size = np.minimum(last, j - 1) - first + 1
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(j)), size)
        i = np.arange(size.sum()) - start[of] + first[of]
        cost = best[i] + largest[j[of] - 1] * (r[j[of]] - r[i]) - (t[j[of]] - t[i])
        now[j] = np.minimum.reduceat(cost, start)
        hits = np.flatnonzero(cost == now[j][of])
        choice[j] = i[hits[np.searchsorted(hits, start)]]
        lo, hi, first, last = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (first, choice[j]), (choice[j], last)))
        order = np.flatnonzero(lo <= hi)
        lo, hi, first, last = lo[order], hi[order], first[order], last[order]
    return now, choice


def optimal_boundaries(largest: np.ndarray, rows: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """The largest counts of at most ``buckets`` buckets with the least padding.

    Bins are in ascending order; fewer buckets are used where more don't help.
    """
    n = len(largest)
    if n == 0:
        return []
    r, t = np.concatenate([[0], np.cumsum(rows)]), np.concatenate([[0], np.cumsum(tokens)])
    best = np.concatenate([[0], largest * r[1:] - t[1:]])  # of one bucket
    choices = [np.zeros(n + 1, dtype=int)]
    for _ in range(min(buckets, n) - 1):
        now, choice = _one_more(best, largest, r, t)
        if now[n] == best[n]:
            break
        choices.append(choice)
        best = now
    bounds, j = [], n
    for choice in reversed(choices):
        if j:
            bounds.append(int(largest[j - 1]))
            j = choice[j]
    return bounds[::-1]


def byte_tokens(text_col: str = "text"):
    """The default token count: a byte-level tokenizer's, one token a byte and one for the end."""
    return F.octet_length(text_or_empty(text_col)).cast("long") + 1


def bucket_boundaries(lengths: DataFrame, buckets: int) -> list[int]:
    """Boundaries for all rows of the one column ``n_tokens``."""
    histogram = lengths.groupBy(F.col("n_tokens").alias("largest")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    found = histogram.orderBy("largest").collect()
    return optimal_boundaries(*(np.array([x[c] for x in found], dtype=float) for c in ("largest", "n", "tokens")), buckets)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 1 << 16, tokens=None) -> DataFrame:
    """``(id_col, n_tokens, bucket, bucket_tokens, batch, batch_rows, padding)`` for every row.

    ``tokens``: a Column with each row's token count, one at least; else bytes and an end
    token. ``batch`` names the bucket, lane and number; ``padding`` is what the row is padded
    by. A row above the budget is a batch of its own. Null and empty texts are one token;
    rows with equal counts and ids are packed like any others.
    """
    # Four passes follow; the texts are read, and tokens counted, in this one only.
    sized = materialize(df.select(F.col(id_col), (byte_tokens(text_col) if tokens is None else tokens).cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("mediacat_row")))
    bounds = bucket_boundaries(sized.select("n_tokens"), buckets)
    if not bounds:
        bounds = [1]
    steps = F.array(*(F.lit(b).cast("long") for b in bounds))
    place = F.size(F.filter(steps, lambda b: b < F.col("n_tokens")))
    placed = sized.withColumn("bucket", place).withColumn("bucket_tokens", F.element_at(steps, F.col("bucket") + 1))
    counts = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}  # one row a bucket
    lanes = F.element_at(F.array(*(F.lit(-(-counts.get(k, 0) // LANE_ROWS) or 1).cast("long") for k in range(len(bounds)))), F.col("bucket") + 1)
    placed = placed.withColumn("lane", F.pmod(F.xxhash64("mediacat_row"), lanes))
    room = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div bucket_tokens"))
    w = Window.partitionBy("bucket", "lane").orderBy("n_tokens", id_col, "mediacat_row")
    numbered = placed.withColumn("room", room).withColumn("n", F.row_number().over(w) - 1).withColumn("n", F.expr("n div room")).withColumn("batch", F.concat_ws("-", F.col("bucket"), F.col("lane"), F.col("n")))
    size = Window.partitionBy("bucket", "lane", "n")
    return numbered.select(id_col, "n_tokens", "bucket", "bucket_tokens", "batch", F.count("*").over(size).alias("batch_rows"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
