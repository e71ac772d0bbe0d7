"""Exact top-k inner products with vector-approximation files.

The file holds, for chunks of rows, each dimension's range and every component as a cell of one byte; it is the only form in
which all rows meet the queries. A scan of the cells bounds every score from above and below; rows whose upper bound
is below a query's kth lower bound, in the block and then over all blocks, are out. Of the rest exact vectors are read in
the order of their upper bounds, in waves that grow, until a query's next bound is below its kth exact score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborq.llm.common import checkpointed, table

CELLS = 255
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)
EXACT_IN_DOUBLE = float(1 << 53)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.vstack(rows.to_list()).astype(np.float64) if len(rows) else np.zeros((0, 0))


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q with those of x; beyond the range of long they stop at its ends."""
    if not len(x):
        return np.zeros(0, np.int64)
    sure = q.shape[1] * np.maximum(1.0, np.abs(q).max(1)) * np.maximum(1.0, np.abs(x).max(1)) < EXACT_IN_DOUBLE
    out = np.zeros(len(x), np.int64)
    out[sure] = np.einsum("ij,ij->i", q[sure], x[sure]).astype(np.int64)
    for i in np.flatnonzero(~sure):
        total = sum(int(a) * int(b) for a, b in zip(q[i], x[i], strict=True))
        out[i] = min(max(total, LONG_MIN), LONG_MAX)
    return out


def least_of_equals(ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Places of rows: of those that are equal, the ones with the `keep` smallest keys, each key once."""
    _, same = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, same.reshape(-1)))
    group, key = same.reshape(-1)[order], ids[order]
    new = np.r_[True, group[1:] != group[:-1]]
    distinct = new | np.r_[True, key[1:] != key[:-1]]
    order, new = order[distinct], new[distinct]
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.sort(order[np.arange(len(new)) - start < keep])


def approximated(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, d) as chunks of the file: (d, low, width, ids, cells), one for each batch and length of vectors.

    Of equal vectors in a batch those with the k + 1 smallest keys stand for all: no other can be among the k best of a query, itself left out.
    """
    for batch in batches:
        f = batch.to_pandas()
        for d, part in f.groupby("d"):
            x = _matrix(part["v"])
            first = least_of_equals(part["id"].to_numpy(), x, k + 1)
            part, x = part.iloc[first], x[first]
            low, high = x.min(0), x.max(0)
            width = np.where(high > low, (high - low) / CELLS, 1.0)
            cells = np.minimum((x - low) / width, CELLS - 1).astype(np.uint8)  # cell c holds low + c*width to low + (c+1)*width
            yield pa.RecordBatch.from_pydict(
                {"d": pa.array([d], pa.int32()), "low": [low.tolist()], "width": [width.tolist()], "ids": pa.array([part["id"].to_numpy()], pa.list_(pa.int64())), "cells": pa.array([cells.tobytes()], pa.binary())}
            )


def bounds_of(q: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores of queries with a chunk's rows, within the range of scores."""
    scaled = q * width
    spread = np.abs(scaled).sum(1)
    # float32 sums and the double arithmetic of the cells are off by a small share of these magnitudes
    slack = 1e-4 * spread * CELLS + 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(low + CELLS * width))) + 1.0
    with np.errstate(over="ignore", invalid="ignore"):
        upper = (scaled.astype(np.float32) @ cells.astype(np.float32).T).astype(np.float64) + (q @ low + np.maximum(scaled, 0).sum(1) + slack)[:, None]
        lower = upper - (spread + 2 * slack)[:, None]
    upper, lower = np.where(np.isfinite(upper), upper, np.inf), np.where(np.isfinite(lower), lower, -np.inf)
    return np.clip(upper, LONG_MIN, LONG_MAX), np.clip(lower, LONG_MIN, LONG_MAX)


def survivors(q_ids: np.ndarray, q: np.ndarray, chunks: pd.DataFrame, k: int, step: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the rows of the chunks that may be among its k best: (query id, ids, upper, lower), its own id left out."""
    ids = np.concatenate([np.asarray(x, np.int64) for x in chunks["ids"]])
    files = [(np.asarray(low), np.asarray(width), np.frombuffer(cells, np.uint8).reshape(-1, len(low))) for low, width, cells in zip(chunks["low"], chunks["width"], chunks["cells"], strict=True)]
    for a in range(0, len(q), step):
        both = [bounds_of(q[a : a + step], *f) for f in files]
        upper, lower = (np.concatenate([b[i] for b in both], axis=1) for i in (0, 1))
        for i, mine in enumerate(q_ids[a : a + step]):
            others = np.flatnonzero(ids != mine)
            least = np.partition(lower[i, others], len(others) - k)[len(others) - k] if len(others) > k else -np.inf
            near = others[upper[i, others] >= least]
            yield mine, ids[near], upper[i, near], lower[i, near]


def read_in_order(near: DataFrame, rows: DataFrame, queries: DataFrame, k: int, first: int = 4, growth: int = 8, met: Accumulator | None = None) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query among near (query_id, id, upper).

    A wave reads each query's next rows by upper bound: at first `first` * k, then `growth` times as many each time. What is left of a
    query goes as soon as its next bound is below its kth exact score, so waves are few and all that a query reads is at most `growth`
    times what one row at a time would. `met` counts the vectors that are read.
    """

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for _, part in f.groupby("d"):
                if met is not None:
                    met.add(len(part))
                yield pd.DataFrame({"query_id": part["query_id"], "vec_id": part["id"], "score": scores_of(_matrix(part["q"]), _matrix(part["v"]))})

    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "d")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), F.desc("id"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    left, wave, best = checkpointed(near), first * k, None
    while best is None or not left.isEmpty():
        batch = checkpointed(left.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= wave).drop("place"))
        scored = batch.join(rows, "id").join(asked, ["query_id", "d"]).select("query_id", "id", "d", "v", "q").mapInPandas(exact, "query_id long, vec_id long, score long")
        both = scored if best is None else best.unionByName(scored)
        best = checkpointed(both.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k).drop("place"))
        last = batch.groupBy("query_id").agg(F.min(F.struct("upper", "id")).alias("last"))
        kth = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
        open_ = left.join(last, "query_id").where(F.struct("upper", "id") < F.col("last")).join(kth, "query_id", "left")
        left = checkpointed(open_.where((F.coalesce("n", F.lit(0)) < k) | (F.col("upper") >= F.col("kth"))).select("query_id", "id", "upper"))
        wave *= growth
    return best


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, key: str = "vec_id", vector: str = "embedding",
    query_block: int = 2048, candidate_block: int = 65536, met: Accumulator | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query row by integer inner product.

    Components become floor(scale * x). Queries are the rows whose key is divisible by `every`; candidates
    are all rows of another key. Vectors that are null, empty or hold null or non-finite components, and
    null keys, take no part; vectors of another length than the query's are no candidates for it. Rows that
    repeat a key are candidates each, and one query together (the first by its vector). Ties go to the
    smaller key. Fewer than k candidates give as many rows; an empty table gives none. Scores beyond
    the range of long stop at its ends. Block sizes bound a group's memory; each chunk of cells is sent once
    for each query block and each query once for each candidate block; exact vectors are sent in the waves of
    `read_in_order` alone, and `met` counts them.
    """
    x = F.col(vector)
    usable = vectors.where(x.isNotNull() & (F.size(x) > 0) & F.col(key).isNotNull()).where(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    )
    rows = usable.select(
        F.col(key).cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"),
        F.size(x).alias("d"),
    )
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min_by("v", F.struct("d", "v")).alias("v")).withColumn("d", F.size("v"))
    n, n_queries = usable.count(), queries.count()
    blocks, q_blocks = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))
    file = rows.mapInArrow(lambda batches: approximated(batches, k), "d int, low array<double>, width array<double>, ids array<long>, cells binary")
    dealt = file.withColumn("c", F.pmod(F.xxhash64("ids"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = queries.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scan(asked_part: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for d, some in asked_part.groupby("d"):
            mine = chunks[chunks["d"] == d]
            if len(mine):
                found += survivors(some["id"].to_numpy(), _matrix(some["v"]), mine, k)
        if not found:
            return pd.DataFrame({"query_id": [], "id": [], "upper": [], "lower": []}).astype({"query_id": "int64", "id": "int64"})
        return pd.DataFrame({
            "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
            **{c: np.concatenate([f[i] for f in found]) for i, c in ((1, "id"), (2, "upper"), (3, "lower"))},
        })

    local = checkpointed(asked.groupBy("q", "c").cogroup(dealt.groupBy("q", "c")).applyInPandas(scan, "query_id long, id long, upper double, lower double"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    least = local.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n"))
    near = local.join(least, "query_id").where((F.col("upper") >= F.col("least")) | (F.col("n") < k)).groupBy("query_id", "id").agg(F.max("upper").alias("upper"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return read_in_order(near, rows, queries, k, met=met).withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
