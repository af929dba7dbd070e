"""Exact top-k search by inner product, with segment statistics from coarse to fine.

A vector is cut into segments. With the means m and deviations s of the segments (of
length L), the inner product of two vectors is at most the sum of L (m m' + s s'), and
so their squared distance at least |v|^2 + |w|^2 less twice that sum. Few segments give
a cheap and loose bound, more segments a closer one. In every pair of a query block and
a vector block, the best of the coarse bounds give exact scores that set each query's
threshold; vectors below it are dropped at the coarse level, then tile by tile at the
fine level; survivors are scored exactly, in whole numbers.

Vectors are packed into blocks of bounded size. Every query block is sent to every
vector block through a sort-merge join on the block number, so neither side is broadcast; a block
pair returns at most k rows a query, and a window keeps the k best of all.

Components are floor(scale * x). Vectors that are null or hold a null or non-finite
component, and null ids, take no part. Of rows that repeat an id, the smallest vector
counts. Shorter vectors count as padded with zeros. Ties go to the smaller id. Fewer
than k candidates: all are returned; no queries or no vectors: no rows. Other columns
are not read. A score beyond 64 bits raises OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.batches import cells_of, compact, keep_modest
from plumbline.sources.stored import settle

SCALE = 64.0
TOP = 20
QUERY_EVERY = 20
LEVELS = (4, 16)
VECTOR_BLOCK, QUERY_BLOCK, TILE = 8192, 1024, 512
# vectors are sent this often, so that as many tasks can share the queries of a vector block
SLICES = 4
BLOCKS = "block bigint, width int, ids binary, cells binary"


def packed(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks of at most `size` vectors in id order: ids as int64, components as rows of `width` whole numbers."""

    def pack(batches):
        base, made, ids, rows = TaskContext.get().partitionId() << 33, 0, [], []

        def block():
            width = max(map(len, rows))
            cells = np.zeros((len(rows), width))
            for i, row in enumerate(rows):
                cells[i, : len(row)] = row
            cells = np.floor(scale * cells)
            if cells.size and np.abs(cells).max() >= 2.0**62:
                raise OverflowError("a component does not fit 64 bits")
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([base + made], pa.int64()),
                    pa.array([width], pa.int32()),
                    pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()),
                    pa.array([compact(cells[order])], pa.binary()),
                ],
                names=["block", "width", "ids", "cells"],
            )

        for batch in batches:
            for one, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(one)
                rows.append(np.asarray(vector.values, dtype=np.float64))
                if len(ids) == size:
                    yield block()
                    made, ids, rows = made + 1, [], []
        if ids:
            yield block()

    return vectors.mapInArrow(pack, BLOCKS)


def segment_statistics(cells: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(L) * mean and sqrt(L) * deviation per segment: their inner products bound those of the cells."""
    n, width = cells.shape
    edges = np.unique(np.linspace(0, width, min(segments, width) + 1).astype(int))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        part, root = cells[:, a:b], np.sqrt(b - a)
        out += [part.mean(1) * root, part.std(1) * root]
    return np.stack(out, axis=1) if out else np.zeros((n, 1))


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; floating point is used where it is exact."""
    most = left.shape[1] * max(1, int(np.abs(left).max(initial=0))) * max(1, int(np.abs(right).max(initial=0)))
    if most < 2**53:
        return left.astype(np.float64) @ right.astype(np.float64).T
    if most < 2**63:
        return left @ right.T
    raise OverflowError("a score may not fit 64 bits")


def block_top(q_ids, q, v_ids, v, k: int, levels=LEVELS):
    """(query id, vector id, score) of each query's k best in one vector block; v_ids ascend."""
    width = max(q.shape[1], v.shape[1], 1)
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    fine_q, fine_v = (segment_statistics(x.astype(np.float64), levels[-1]) for x in (q, v))
    coarse = np.full((len(q), len(v)), np.inf)
    for level in levels[:1]:
        coarse = segment_statistics(q.astype(np.float64), level) @ segment_statistics(v.astype(np.float64), level).T
    slack = 1e-6 * (1 + np.abs(coarse).max(initial=0))
    own = q_ids[:, None] == v_ids[None, :]
    coarse[own] = -np.inf
    # exact scores of the vectors with the best coarse bounds: a query's k-th best is no worse
    threshold = np.full(len(q), -np.inf)
    if len(v) > k:
        seeds = np.argpartition(coarse, len(v) - k, axis=1)[:, len(v) - k :]
        for i, chosen in enumerate(seeds):
            if np.isfinite(coarse[i, chosen]).all():
                threshold[i] = exact_scores(q[i : i + 1], v[chosen]).min()
    alive = coarse >= (threshold - slack)[:, None]
    alive &= ~own
    names, found, scores = [], [], []
    kept: list[list] = [[] for _ in range(len(q))]
    for a in range(0, len(v), TILE):
        b = min(a + TILE, len(v))
        rows = np.flatnonzero(alive[:, a:b].any(1))
        if not len(rows):
            continue
        bound = fine_q[rows] @ fine_v[a:b].T
        still = alive[rows, a:b] & (bound >= (threshold[rows] - slack)[:, None])
        some = still.any(1)
        rows, still = rows[some], still[some]
        if not len(rows):
            continue
        exact = exact_scores(q[rows], v[a:b])
        still &= exact >= threshold[rows][:, None]
        for i, row in enumerate(rows):
            at = np.flatnonzero(still[i])
            if len(at):
                kept[row].append((a + at, exact[i, at]))
    for i, parts in enumerate(kept):
        if parts:
            at = np.concatenate([p[0] for p in parts])
            own_scores = np.concatenate([p[1] for p in parts]).astype(np.int64)
            best = np.lexsort((v_ids[at], -own_scores))[:k]
            names.append(np.full(len(best), q_ids[i]))
            found.append(v_ids[at[best]])
            scores.append(own_scores[best])
    if not names:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(names), np.concatenate(found), np.concatenate(scores)


def search(
    vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = TOP, scale: float = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score; is_query is a condition on the column `vec_id`."""
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    usable = (
        vectors.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & finite)
        .groupBy(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"))
        .agg(F.min(x).alias("vector"))
    )
    keep_modest(vectors.sparkSession)
    stored = settle(packed(usable, VECTOR_BLOCK, scale), "vectors")
    asked = settle(packed(usable.where(is_query), QUERY_BLOCK, scale), "queries")
    groups = max(1, stored.count())
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice")
    left = stored.select("width", "ids", "cells", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), slices)
    right = asked.select(
        F.pmod(F.xxhash64("block"), F.lit(SLICES)).cast("int").alias("slice"),
        F.col("width").alias("q_width"),
        F.col("ids").alias("q_ids"),
        F.col("cells").alias("q_cells"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("group"),
    )
    # sent once a group, queries are many times what their table's size tells Spark: never broadcast; a task
    # holds the vectors of one group while the queries pass
    pairs = right.hint("merge").join(left, ["group", "slice"]).select("q_width", "q_ids", "q_cells", "width", "ids", "cells")

    def compare(batches):
        for batch in batches:
            for q_width, q_ids, q_cells, width, ids, cells in zip(*(c for c in batch.columns)):
                q_names, names = (np.frombuffer(x.as_buffer(), np.int64) for x in (q_ids, ids))
                q = cells_of(q_cells.as_buffer(), len(q_names), q_width.as_py())
                v = cells_of(cells.as_buffer(), len(names), width.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in block_top(q_names, q, names, v, k)],
                    names=["query_id", "vec_id", "score"],
                )

    best = pairs.mapInArrow(compare, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, "vec_id", "embedding", F.col("vec_id") % QUERY_EVERY == 0)


# for tests on small tables: every pair, in SQL
TWIN = """WITH cells AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM cells q JOIN cells c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) r
WHERE rank <= 20"""
