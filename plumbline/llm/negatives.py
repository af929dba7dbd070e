"""Hard negatives by rotated one-bit codes and deterministic score intervals.

Components are floor(scale * x); a row's score is its integer inner product with the anchor.
A vector is turned by one fixed random rotation, and of the turned x only signs are kept: the
code b, a unit vector of entries +-1/sqrt(D). Stored with it is the alignment s = <x, b>; what
the code leaves over, x - s b, stands at right angles to b and has a known length r. The
remainder gets a code, alignment and length of its own, and so on for LEVELS levels. An
anchor y is rounded to PLANES bit planes, whose error has a known length too, so popcounts of
code and planes estimate <y, b>. With that, the score lies within r * |y - <y, b> b| of s <y, b>
(Cauchy-Schwarz); rounding errors widen the interval. Further levels are computed for rows still
open, and rows whose last interval may matter are scored exactly in whole numbers. No
decision rests on an estimate.

Two passes over (anchor block, vector block) pairs: the first finds each anchor's best rows of
its own label (positives); the second, for each positive's score p, the best rows of another
label with low * p <= 100 * score <= high * p. Thresholds reached in one block are carried to
the next one of the same task, and a task returns what is left at its end.

Vectors are packed into blocks by a hash of the id, so a block's size depends neither on the
input's partitions nor on labels. Anchor blocks go to all vector blocks through a sort-merge
join; nothing is broadcast.

Rows with a null id, label or vector, or with a null or non-finite component take no part. Of
rows that repeat an id the one with the smallest (label, vector) counts. Shorter vectors count
as padded with zeros; a zero vector scores 0. Ties go to the smaller id. Fewer partners than asked
for: all are returned; none: no rows. Empty table: no rows. Other columns are not read. A score
that may not fit 64 bits, or not a hundredfold, raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.batches import cells_of, compact, keep_modest
from plumbline.llm.topk import exact_scores
from plumbline.sources.stored import settle

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
ANCHOR_EVERY, MOVED_EVERY, LABELS = 50, 7, 10
VECTOR_BLOCK, ANCHOR_BLOCK = 8192, 512
LEVELS, PLANES = 4, 8
# anchors a task keeps results for before it returns what it has
HELD_ANCHORS = 100_000
NONE = np.iinfo(np.int64).min
BLOCK = "block bigint, width int, ids binary, labels array<string>, cells binary, codes binary, figures binary, wanted array<array<array<bigint>>>"


def rotation(width: int) -> np.ndarray:
    """A fixed orthogonal matrix; vectors are padded to `width`, a multiple of 64."""
    turned, upper = np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))
    return turned * np.sign(np.diag(upper))


_TURNS: dict[int, np.ndarray] = {}


def turned(cells: np.ndarray, width: int) -> np.ndarray:
    full = 64 * max(1, -(-width // 64))
    if full not in _TURNS:
        _TURNS.clear()
        _TURNS[full] = rotation(full)
    return np.pad(cells.astype(np.float64), ((0, 0), (0, full - cells.shape[1]))) @ _TURNS[full]


def one_bit_codes(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """codes (rows, levels, words) and figures (rows, levels, 2): alignment and length of what is left."""
    n, width = x.shape
    codes, figures = np.empty((n, levels, width // 64), np.uint64), np.empty((n, levels, 2))
    left, root = x.copy(), np.sqrt(width)
    for level in range(levels):
        up = left >= 0
        codes[:, level] = np.packbits(up, axis=1, bitorder="little").view(np.uint64)
        signs = np.where(up, 1 / root, -1 / root)
        along = (left * signs).sum(1)
        left -= along[:, None] * signs
        figures[:, level, 0], figures[:, level, 1] = along, np.sqrt((left * left).sum(1))
    return codes, figures


class Anchor:
    """A turned anchor as bit planes, with the length of the rounding error."""

    def __init__(self, y: np.ndarray, planes: int = PLANES):
        low, high = float(y.min(initial=0)), float(y.max(initial=0))
        self.step = (high - low) / (2**planes - 1) or 1.0
        steps = np.rint((y - low) / self.step).astype(np.int64)
        bits = (steps[None, :] >> np.arange(planes)[:, None]) & 1
        self.planes = np.packbits(bits.astype(bool), axis=1, bitorder="little").view(np.uint64)
        self.ones, self.low, self.width = int(steps.sum()), low, len(y)
        self.square = float(y @ y)
        self.error = float(np.linalg.norm(y - (low + self.step * steps)))

    def along(self, codes: np.ndarray) -> np.ndarray:
        """Estimates of <y, b> for codes (rows, words), each within `error`."""
        total = np.zeros(len(codes))
        for power, plane in enumerate(self.planes):
            total += np.bitwise_count(codes & plane).sum(1, dtype=np.int64) * float(2 << power)
        set_bits = np.bitwise_count(codes).sum(1, dtype=np.int64)
        return (self.step * (total - self.ones) + self.low * (2 * set_bits - self.width)) / np.sqrt(self.width)


class Intervals:
    """Intervals around the scores of one anchor and the rows of a vector block, level by level."""

    def __init__(self, anchor: Anchor, codes: np.ndarray, figures: np.ndarray, rows: np.ndarray):
        self.anchor, self.codes, self.figures = anchor, codes, figures
        self.rows, self.level = rows, 0
        self.middle, self.spread = np.zeros(len(rows)), np.zeros(len(rows))
        # beyond what floating point can be off by, as a share of both lengths
        self.slack = 1e-9 * (1 + np.linalg.norm(figures[rows, 0], axis=1) * np.sqrt(anchor.square))

    def refine(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends with one more level."""
        y, level = self.anchor, self.level
        along, left = self.figures[self.rows, level].T
        estimate = y.along(self.codes[self.rows, level])
        self.middle += along * estimate
        self.spread += np.abs(along) * y.error
        nearest = np.maximum(np.abs(estimate) - y.error, 0)
        width = self.spread + left * np.sqrt(np.maximum(y.square - nearest * nearest, 0))
        width += self.slack
        self.level += 1
        return self.middle - width, self.middle + width

    def keep(self, chosen: np.ndarray) -> None:
        self.rows, self.slack = self.rows[chosen], self.slack[chosen]
        self.middle, self.spread = self.middle[chosen], self.spread[chosen]


def best_first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class Ranges:
    """The k best rows of an anchor in each of some score ranges, block after block."""

    def __init__(self, lows, highs, k: int):
        self.lows, self.highs, self.k = lows, highs, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lows]

    def search(self, anchor: Anchor, cells_of_anchor, ids, cells, codes, figures, rows) -> int:
        """Takes in the rows of one block; returns how many were scored exactly."""
        spans = Intervals(anchor, codes, figures, rows)
        reached = [max(low, kth(best[1], self.k)) for low, best in zip(self.lows, self.best)]
        while spans.level < codes.shape[1] and len(spans.rows):
            low, high = spans.refine()
            alive = np.zeros(len(low), bool)
            for j, top in enumerate(self.highs):
                # rows surely inside the range: the k-th of their lower ends is reached
                inside = (low >= self.lows[j]) & (high <= top)
                reached[j] = max(reached[j], kth(low[inside], self.k))
                alive |= (high >= reached[j]) & (low <= top)
            spans.keep(alive)
        rows = spans.rows
        if not len(rows):
            return 0
        scores = exact_scores(cells_of_anchor[None, :], cells[rows])[0].astype(np.int64)
        for j, (low, top) in enumerate(zip(self.lows, self.highs)):
            fits = (scores >= low) & (scores <= top)
            if fits.any():
                old = self.best[j]
                both = np.concatenate((old[0], ids[rows[fits]])), np.concatenate((old[1], scores[fits]))
                self.best[j] = best_first(*both, self.k)
        return len(rows)


def blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks of about `size` rows (vec_id, label, vector, wanted) with cells, codes and figures."""
    groups = max(1, -(-rows.count() // size))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vectors = [np.asarray(v.values, np.float64) for v in table["vector"]]
        width = max(map(len, vectors))
        cells = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            cells[i, : len(v)] = v
        cells = np.floor(scale * cells)
        if cells.size and np.abs(cells).max() >= 2.0**62:
            raise OverflowError("a component does not fit 64 bits")
        codes, figures = one_bit_codes(turned(cells, width))
        one = {
            "block": pa.array([table["block"][0].as_py()], pa.int64()),
            "width": pa.array([width], pa.int32()),
            "ids": pa.array([np.asarray(table["vec_id"], np.int64).tobytes()], pa.binary()),
            "labels": pa.array([table["label"].to_pylist()], pa.list_(pa.string())),
            "cells": pa.array([compact(cells)], pa.binary()),
            "codes": pa.array([codes.tobytes()], pa.binary()),
            "figures": pa.array([figures.tobytes()], pa.binary()),
            "wanted": pa.array([table["wanted"].to_pylist()], pa.list_(pa.list_(pa.list_(pa.int64())))),
        }
        return pa.table(one)

    numbered = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    return numbered.groupBy("block").applyInArrow(pack, BLOCK)


class Block:
    """A packed block as arrays."""

    def __init__(self, width, ids, labels, cells, codes, figures, wanted=None):
        self.ids = np.frombuffer(ids.as_buffer(), np.int64)
        n = len(self.ids)
        self.cells = cells_of(cells.as_buffer(), n, width.as_py())
        self.codes = np.frombuffer(codes.as_buffer(), np.uint64).reshape(n, LEVELS, -1)
        self.figures = np.frombuffer(figures.as_buffer(), np.float64).reshape(n, LEVELS, 2)
        self.labels = np.array(labels.as_py(), object)
        self.wanted = wanted.as_py() if wanted is not None else None

    def padded(self, width: int) -> "Block":
        """As wide as the other side's block; codes are made anew if that changes their words."""
        if self.cells.shape[1] < width:
            self.cells = np.pad(self.cells, ((0, 0), (0, width - self.cells.shape[1])))
            if self.codes.shape[2] < -(-width // 64):
                self.codes, self.figures = one_bit_codes(turned(self.cells, width))
        return self


FIELDS = ("width", "ids", "labels", "cells", "codes", "figures")


def best_rows(anchors: DataFrame, vectors: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, asked, vec_id, score: the k best rows of each wanted range in each task.

    same: rows of the anchor's label, in one range without ends; else rows of other labels in the
    ranges that `wanted` names as (asked, low, high).
    """
    last = vectors.agg(F.max("block")).first()[0] or 0
    right = anchors.select(
        *[F.col(c).alias(f"a_{c}") for c in (*FIELDS, "wanted")],
        F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")).alias("block"),
    )
    # sent once a block, anchors are many times what their table's size tells Spark: never broadcast; a task
    # holds one vector block while the anchors pass
    pairs = right.hint("merge").join(vectors.select("block", *FIELDS), "block")
    pairs = pairs.select(*FIELDS, *[f"a_{c}" for c in (*FIELDS, "wanted")])

    def results(held: dict) -> pa.RecordBatch:
        out = [[], [], [], []]
        for anchor, (asked, ranges) in held.items():
            for one, (ids, scores) in zip(asked, ranges.best):
                for column, values in zip(out, ([anchor] * len(ids), [one] * len(ids), ids.tolist(), scores.tolist())):
                    column += values
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in out], names=["anchor_id", "asked", "vec_id", "score"]
        )

    def compare(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for row in zip(*columns):
                v, a = Block(*row[:6]), Block(*row[6:13])
                width = max(v.cells.shape[1], a.cells.shape[1])
                v, a = v.padded(width), a.padded(width)
                whole = turned(a.cells, width)
                for label in dict.fromkeys(a.labels):
                    alike = v.labels == label
                    mine = np.flatnonzero(alike if same else ~alike)
                    for i in np.flatnonzero(a.labels == label):
                        name = int(a.ids[i])
                        if name not in held:
                            wanted = [(0, NONE, np.iinfo(np.int64).max)] if same else a.wanted[i]
                            held[name] = [w[0] for w in wanted], Ranges([w[1] for w in wanted], [w[2] for w in wanted], k)
                        rows = mine[v.ids[mine] != name] if same else mine
                        held[name][1].search(Anchor(whole[i]), a.cells[i], v.ids, v.cells, v.codes, v.figures, rows)
                if len(held) > HELD_ANCHORS:
                    yield results(held)
                    held = {}
        yield results(held)

    found = pairs.mapInArrow(compare, "anchor_id bigint, asked bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("anchor_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame,
    id_col: str,
    label: Column,
    vector_col: str,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on the column `vec_id`; label is a column of `vectors`; bounds are
    in percent of the positive's score.
    """
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    keep_modest(vectors.sparkSession)
    usable = settle(
        vectors.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & x.isNotNull() & finite)
        .groupBy(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"))
        .agg(F.min(F.struct(label.cast("string").alias("label"), x.alias("vector"))).alias("row"))
        .select("vec_id", "row.label", "row.vector"),
        "usable",
    )
    nothing = F.lit(None).cast("array<array<bigint>>").alias("wanted")
    stored = settle(blocks(usable.select("*", nothing), VECTOR_BLOCK, scale), "vectors")
    anchors = usable.where(is_anchor)
    asking = settle(blocks(anchors.select("*", nothing), ANCHOR_BLOCK, scale), "anchors")
    found = settle(best_rows(asking, stored, positives, same=True).select("anchor_id", "vec_id", "score"), "positives")
    # below zero the lower bound is above the upper one
    ranged = found.where("score >= 0").select(
        "anchor_id",
        F.array("vec_id", F.expr(f"({low} * score + 99) div 100"), F.expr(f"{high} * score div 100")).alias("one"),
    )
    wanted = ranged.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list("one")).alias("wanted"))
    looking = settle(blocks(anchors.join(wanted, "vec_id"), ANCHOR_BLOCK, scale), "ranges")
    against = best_rows(looking, stored, negatives, same=False)
    scored = found.select("anchor_id", F.col("vec_id").alias("asked"), F.col("score").alias("positive_score"))
    return against.join(scored, ["anchor_id", "asked"]).select(
        "anchor_id",
        F.col("asked").alias("positive_id"),
        F.col("place").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(vectors, "vec_id", moved, "embedding", F.col("vec_id") % ANCHOR_EVERY == 0)


# every pair, in SQL
TWIN = """WITH cells AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, c.v)]) AS BIGINT) AS score
  FROM cells a JOIN cells c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
fitting AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM fitting WHERE rank <= 3"""
