"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are counts over its bytes, words and lines, made in numpy
inside Arrow batches. Trees are grown level by level from histograms of binned
statistics, for the logistic loss, on at most `TRAIN_ROWS` labelled rows. Each tree
is a complete binary tree; the forest is flattened into three arrays (statistic,
threshold, leaf value) and all rows of a batch walk down together.

The labelled sample is every row whose hash is below a share set from the number of
labels, so it holds about `TRAIN_ROWS` rows at any size; the texts of no other rows
are read for training. All documents are scored.

Null and empty texts have zero counts and get a score like any other. Repeated
labels of a document: the lowest counts. Labels that are null or without a document
take no part; with no usable labels, every score is 0.5. Repeated rows score alike.
Empty tables give no rows. Other columns are neither read nor changed.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import keep_modest

TRAIN_ROWS = 20_000
HELD_OUT_MOD = 5
# fine enough to choose `TRAIN_ROWS` of any number of labels
SHARE_STEPS = 1 << 53
THRESHOLD = 0.3
ROUNDS, DEPTH, BINS, RATE, RIDGE, MIN_LEAF = 60, 4, 64, 0.15, 1.0, 20
STATISTICS = (
    "log_bytes upper digit bang bar stop comma other_marks space line_end high log_words word_len "
    "distinct top_word twin_words log_lines repeated_lines line_len short_lines"
).split()


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    count = max(len(words), 1)
    kinds = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    # words come in a sorted run per kind: the longest run is the commonest word
    numbers = {w: i for i, w in enumerate(kinds)}
    top = np.bincount([numbers[w] for w in words]).max() if words else 0
    marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    bang, bar, stop, comma = int(seen[33]), int(seen[124]), int(seen[46]), int(seen[44])
    return [
        np.log1p(len(raw)),
        seen[65:91].sum() / n,
        seen[48:58].sum() / n,
        bang / n,
        bar / n,
        stop / n,
        comma / n,
        (marks - bang - bar - stop - comma) / n,
        seen[32] / n,
        seen[10] / n,
        seen[128:].sum() / n,
        np.log1p(len(words)),
        sum(map(len, kinds)) / max(len(kinds), 1),
        len(kinds) / count,
        top / count,
        sum(map(eq, words, words[1:])) / count,
        np.log1p(len(lines)),
        1 - len(set(lines)) / n_lines,
        np.log1p(len(raw) / n_lines),
        sum(len(x) < 40 for x in lines) / n_lines,
    ]


class Forest:
    """Flattened trees: node k of a tree has children 2k+1 and 2k+2; a row goes right if above the threshold."""

    def __init__(self, base: float = 0.0, depth: int = DEPTH):
        self.base, self.depth = base, depth
        self.statistic = np.zeros((0, 2**depth - 1), np.int32)
        self.threshold = np.zeros((0, 2**depth - 1))
        self.value = np.zeros((0, 2**depth))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for statistic, threshold, value in zip(self.statistic, self.threshold, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[every, statistic[node]] > threshold[node])
            total += value[node - len(statistic)]
        return 1 / (1 + np.exp(-total))


def grow(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Forest:
    """Boosted trees for the logistic loss; splits are sought on at most `BINS` bins of each statistic."""
    share = labels.mean() if len(labels) else 0.5
    share = min(max(share, 0.01), 0.99) if len(labels) else 0.5
    forest = Forest(float(np.log(share / (1 - share))), depth)
    if len(labels) < 2 * MIN_LEAF or labels.min() == labels.max():
        return forest
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    slots = np.arange(width) * BINS
    total = np.full(n, forest.base)
    trees = []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-total))
        slope, curve = labels - chance, chance * (1 - chance)
        statistic = np.zeros(2**depth - 1, np.int32)
        threshold = np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            place = node - (nodes - 1)
            key = ((place * width * BINS)[:, None] + slots + binned).ravel()
            size = nodes * width * BINS
            shape = (nodes, width, BINS)
            g = np.bincount(key, np.repeat(slope, width), size).reshape(shape).cumsum(2)
            h = np.bincount(key, np.repeat(curve, width), size).reshape(shape).cumsum(2)
            c = np.bincount(key, minlength=size).reshape(shape).cumsum(2)
            g_all, h_all, c_all = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(c < MIN_LEAF) | (c_all - c < MIN_LEAF)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k, at in enumerate(best):
                j, b = divmod(int(at), BINS)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    statistic[nodes - 1 + k], threshold[nodes - 1 + k] = j, cuts[j][b]
            node = 2 * node + 1 + (rows[np.arange(n), statistic[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        value = RATE * np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, curve, 2**depth) + RIDGE)
        total += value[leaf]
        trees.append((statistic, threshold, value))
    forest.statistic, forest.threshold, forest.value = (np.array(x) for x in zip(*trees))
    return forest


def held_out(id_col) -> F.Column:
    return F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT_MOD == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bound: int = TRAIN_ROWS) -> Forest:
    """Fit on about `bound` labelled rows outside the held-out fold."""
    usable = labels.where(
        F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id"))
    ).select(F.col("doc_id").cast("bigint").alias("labelled"), F.col(label_col).cast("int").alias("label"))
    share = min(1.0, bound / max(usable.count(), 1))
    # about `bound` ids of 12 bytes: small enough to send to every task
    chosen = (
        usable.where(F.pmod(F.xxhash64("labelled"), F.lit(SHARE_STEPS)) < int(share * SHARE_STEPS))
        .groupBy("labelled")
        .agg(F.min("label").alias("label"))
    )
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("labelled")
    )

    def measure(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"]
            )

    keep_modest(docs.sparkSession)
    table = picked.select("text", "label").mapInArrow(measure, "x array<double>, y int").toArrow()
    y = np.array(table.column("y").to_pylist(), dtype=float)
    x = np.array(table.column("x").to_pylist(), dtype=float).reshape(len(y), len(STATISTICS))
    order = np.lexsort([*x.T[::-1], y])  # the fit must not depend on the order in which rows arrive
    return grow(x[order], y[order])


def scored(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """Columns row (all columns of the document) and score."""
    frame = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(0.0).alias("score")
    )
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    keep_modest(docs.sparkSession)

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(0).field(at).cast(pa.string())
                rows = np.array([statistics(t.as_py()) for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(shared.value.scores(rows), pa.float64())], names=["row", "score"]
                )

    return frame.mapInArrow(score, frame.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    doc_id = F.col("row.doc_id").cast("bigint")
    return scored(docs, forest).select(
        doc_id.alias("doc_id"),
        F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
