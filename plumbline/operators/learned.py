"""Learned base models that Spark ML lacks: boosting by leaves, extremely random trees, a small network.

A panel has one row per company and date. Its rows are dealt to a few tasks of one barrier stage; each task
keeps its share as compact arrays, and the tasks add up histograms, counts or gradients
with `allGather`. All tasks then take the same decision, so nothing but these sums travels, and trees
do not depend on how rows were dealt (beyond rounding). If an executor is lost, Spark
runs the stage again. ROWS_PER_TASK bounds what a task holds; a stage needs one slot per task.
`allGather` answers about once a second, so several tasks share as few sums as they can: boosting
opens all leaves of a tree at once and picks from them, and sends the error of a tree with the root of the
next; the network averages weights once an epoch.

Models are small tables of numbers on the driver; predictions run on the executors.
Features must be finite (imputed before).
"""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Settings of the base models.
BOOSTING = {"rounds": 250, "rate": 0.04, "leaves": 15, "leaf_rows": 30, "l2": 0.1, "bins": 255}
STOPPING = {"above_rows": 10_000, "share": 0.1, "patience": 10, "tolerance": 1e-7}
EXTRA = {"trees": 300, "depth": 6, "leaf_rows": 25, "seed": 42}
NETWORK = {
    "hidden": (32, 16), "penalty": 0.01, "rate": 0.001, "epochs": 1000, "batch": 200,
    "share": 0.15, "patience": 25, "tolerance": 1e-4, "seed": 42,
}
ROWS_PER_TASK = 1_000_000
# a round of boosting takes 5 to 8 sums, some seconds: as long as one task needs for more rows than this. A task
# holds a row's features as a byte each, some times over, and a few numbers
BOOSTING_ROWS_PER_TASK = 5_000_000
# from this many rows on, a histogram takes two features in one pass
PAIRED_FROM = 100_000
# all trees of a forest share their sums, two a level: more tasks cost little, so each takes fewer rows
FOREST_ROWS_PER_TASK = 60_000
TREES_AT_ONCE = 300


class Team:
    """The tasks of a barrier stage: sums, minima and maxima over all of them, in the order of tasks."""

    def __init__(self, size: int, number: int = 0, context=None):
        self.size, self.number, self.context = size, number, context

    def _all(self, values: np.ndarray) -> list[np.ndarray]:
        values = np.ascontiguousarray(values, np.float64)
        if self.size == 1:
            return [values]
        texts = self.context.allGather(base64.b64encode(values.tobytes()).decode())
        return [np.frombuffer(base64.b64decode(t), np.float64).reshape(values.shape) for t in texts]

    def sum(self, values) -> np.ndarray:
        return np.sum(self._all(values), axis=0)

    def least(self, values) -> np.ndarray:
        return np.min(self._all(values), axis=0)

    def most(self, values) -> np.ndarray:
        return np.max(self._all(values), axis=0)


def together(rows: DataFrame, keys: Sequence[str], target: str, fit, rows_per_task: int | None = None, held_as=None) -> dict:
    """Run `fit(x, y, draw, team)` over all rows (`z`, an array) in one barrier stage; its result, from JSON.

    draw is a number below 100 from the hash of a row's keys, for models that hold out a share of rows.
    held_as: bytes to use in place of x (in single precision), made before rows are dealt.
    """
    x_type = np.uint8 if held_as else np.float32
    spark = rows.sparkSession
    n = rows.count()
    tasks = max(1, min(-(-n // (rows_per_task or ROWS_PER_TASK)), spark.sparkContext.defaultParallelism))

    def features(z):
        return np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1) if held_as else np.vstack(z).astype(np.float32)

    @F.pandas_udf("binary")
    def kept(z: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in held_as(np.vstack(z).astype(np.float32))] if len(z) else [], dtype=object)

    def run(batches):
        parts = [(features(b["z"]), b["y"].to_numpy(float), b["draw"].to_numpy()) for b in batches if len(b)]
        context = BarrierTaskContext.get()
        width = Team(tasks, context.partitionId(), context).most(np.array([parts[0][0].shape[1] if parts else 0.0]))
        x = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, int(width[0])), x_type)
        y, draw = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (1, 2))
        parts.clear()
        model = fit(x, y, draw, Team(tasks, context.partitionId(), context))
        if context.partitionId() == 0:
            yield pd.DataFrame({"model": [json.dumps(model)]})

    z = kept("z").alias("z") if held_as else F.col("z")
    dealt = rows.select(*keys, z, F.col(target).cast("double").alias("y"), F.pmod(F.xxhash64(*keys), F.lit(100)).alias("draw"))
    ordered = dealt.repartition(tasks, *keys).sortWithinPartitions(*keys).select("z", "y", "draw")
    # all tasks of a barrier stage run: no limit on its rows
    return json.loads(ordered.mapInPandas(run, "model string", barrier=True).collect()[0]["model"])


# --- boosting ---------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, width: int, bins: int = BOOSTING["bins"]) -> list[list[float]]:
    """Upper ends of all bins but the last, per feature: values at evenly spread ranks."""
    # one literal for all features: a column a share and feature would take seconds to build
    shares = F.expr(f"array({', '.join(f'{i / bins!r}D' for i in range(1, bins))})")
    row = rows.agg(*[F.percentile_approx(F.col("z")[i], shares, F.lit(10_000)).alias(f"e{i}") for i in range(width)]).first()
    # compared as the tasks hold features, in single precision
    return [sorted({float(np.float32(v)) for v in row[f"e{i}"] or []}) for i in range(width)]


def best_split(sums: np.ndarray, counts: np.ndarray, l2: float, leaf_rows: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of a node's histograms (features x bins); rows up to the bin go left."""
    g, n = sums.cumsum(1)[:, :-1], counts.cumsum(1)[:, :-1]
    all_g, all_n = sums[0].sum(), counts[0].sum()
    right_g, right_n = all_g - g, all_n - n
    gain = g * g / (n + l2) + right_g * right_g / (right_n + l2) - all_g * all_g / (all_n + l2)
    gain[(n < leaf_rows) | (right_n < leaf_rows)] = -np.inf
    at = int(np.argmax(gain))
    return float(gain.flat[at]), *map(int, divmod(at, gain.shape[1]))


@dataclass
class Leaf:
    rows: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    split: tuple[float, int, int]
    node: int = -1
    children: tuple | None = None


def bins_of(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin of each feature: the first one whose upper end is not below the value."""
    out = np.zeros((len(x), len(edges)), np.uint8)
    for i, ends in enumerate(edges):
        out[:, i] = np.searchsorted(np.asarray(ends, np.float32), x[:, i], side="left")
    return out


def boosted(x, y, draw, team: Team, edges: list[list[float]], rounds, rate, leaves, leaf_rows, l2, bins) -> dict:
    """Squared-error boosting; every tree grows best first. x: features, or their bins (`bins_of`)."""
    width = len(edges)
    # by feature: a histogram runs along one column, its cells stay in the processor's cache
    binned = np.ascontiguousarray((x if x.dtype == np.uint8 else bins_of(x, edges)).T)
    # two features as one number; an odd one stands alone
    pairs = [binned[i].astype(np.uint16) * bins + binned[i + 1] for i in range(0, width - 1, 2)] if len(y) >= PAIRED_FROM else []
    total_rows = team.sum([len(y)])[0]
    stopping = total_rows > STOPPING["above_rows"]
    held = draw < 100 * STOPPING["share"] if stopping else np.zeros(len(y), bool)
    use = np.flatnonzero(~held)
    n, start = team.sum([len(use), y[use].sum()])
    start = start / n if n else 0.0
    guess = np.full(len(y), start)

    def own_histograms(rows, weight, counts=None):
        """Sums of weights, and counts where they are not given, of the task's rows: 2 x features x bins."""
        out, first = np.zeros((2, width, bins)), 0
        kinds = (weight,) if counts is not None else (weight, None)
        if pairs and len(rows) >= PAIRED_FROM:
            for i, codes in enumerate(pairs):
                cells = codes.take(rows)
                for part, of in zip(out, kinds):
                    both = np.bincount(cells, of, bins * bins).reshape(bins, bins)
                    part[2 * i], part[2 * i + 1] = both.sum(1), both.sum(0)
            first = 2 * len(pairs)
        for i in range(first, width):
            cells = binned[i].take(rows)
            for part, of in zip(out, kinds):
                part[i] = np.bincount(cells, of, bins)
        if counts is not None:
            out[1] = counts
        return out

    root_counts = own_histograms(use, None)[0]

    def histograms(parts, slope, more=()):
        """Sums of slopes and counts (features x bins) of several sets of rows, and of more numbers, in one sum over the tasks."""
        made = np.stack([own_histograms(rows, slope[rows], root_counts if rows is use else None) for rows in parts])
        summed = team.sum(np.concatenate((made.ravel(), more)))
        return summed[: made.size].reshape(made.shape), summed[made.size :]

    def leaf(rows, sums, counts):
        return Leaf(rows, sums, counts, best_split(sums, counts, l2, leaf_rows))

    def open_up(some, slope):
        """Children of leaves: the smaller child is summed, the other one is the rest."""
        asked = []
        for one in some:
            _, feature, cut = one.split
            left = binned[feature].take(one.rows) <= cut
            small_left = one.counts[feature, : cut + 1].sum() * 2 <= one.counts[feature].sum()
            asked.append((one, one.rows[left], one.rows[~left], small_left))
        summed, _ = histograms([left if small else right for _, left, right, small in asked], slope)
        for (one, left, right, small), (sums, counts) in zip(asked, summed):
            rest = one.sums - sums, one.counts - counts
            pair = ((sums, counts), rest) if small else (rest, (sums, counts))
            one.children = leaf(left, *pair[0]), leaf(right, *pair[1])

    trees, losses, check = [], [], np.flatnonzero(held)
    for _ in range(rounds if width else 0):
        slope = guess - y
        # the error of the trees so far comes with the root of the next one
        (whole,), (error, rows) = histograms([use], slope, [float((slope[check] ** 2).sum()), len(check)])
        if stopping and trees:
            losses.append(error / max(rows, 1.0))
            late = losses[-STOPPING["patience"] :]
            if len(losses) > STOPPING["patience"] and min(late) > losses[-STOPPING["patience"] - 1] - STOPPING["tolerance"]:
                break
        nodes: list[list] = []

        def placed(one):
            nodes.append([-1, 0.0, -1, -1, -rate * one.sums[0].sum() / (one.counts[0].sum() + l2)])
            one.node = len(nodes) - 1
            return one

        grown = [placed(leaf(use, *whole))]
        while len(grown) < leaves:
            # the largest gain; of equal ones the older leaf
            at = max(grown, key=lambda one: (one.split[0], -one.node))
            if not at.split[0] > 0:
                break
            if at.children is None:
                several = [one for one in grown if one.children is None and one.split[0] > 0]
                open_up(several if team.size > 1 else [at], slope)
            grown = [one for one in grown if one is not at]
            left, right = (placed(one) for one in at.children)
            _, feature, cut = at.split
            nodes[at.node][:4] = [feature, cut, left.node, right.node]
            grown += [left, right]
        for one in grown:
            guess[one.rows] += nodes[one.node][4]
        if len(check):
            guess[check] += evaluate(nodes, binned[:, check].T)
        trees.append([[f, edges[f][cut] if f >= 0 else 0.0, *rest] for f, cut, *rest in nodes])
    return {"start": float(start), "trees": trees}


def evaluate(nodes: list[list], x: np.ndarray) -> np.ndarray:
    """Value of each row's leaf; nodes are (feature, cut, left, right, value), a leaf has feature -1."""
    feature, left, right = (np.array([n[i] for n in nodes], np.int64) for i in (0, 2, 3))
    cut, value = (np.array([n[i] for n in nodes], float) for i in (1, 4))
    at = np.zeros(len(x), np.int64)
    inner = np.flatnonzero(feature[at] >= 0)
    while len(inner):
        here = at[inner]
        goes = x[inner, feature[here]] <= cut[here]
        at[inner] = np.where(goes, left[here], right[here])
        inner = inner[feature[at[inner]] >= 0]
    return value[at]


def fit_boosting(rows: DataFrame, keys: Sequence[str], target: str, width: int, rows_per_task=None, **settings) -> dict:
    setting = BOOSTING | settings
    edges = bin_edges(rows, width, setting["bins"])
    return together(
        rows,
        keys,
        target,
        lambda x, y, draw, team: boosted(x, y, draw, team, edges, **setting),
        rows_per_task or BOOSTING_ROWS_PER_TASK,
        lambda x: bins_of(x, edges),
    )


# --- extremely random trees ---------------------------------------------------------------------


def extra_trees(x, y, draw, team: Team, trees, depth, leaf_rows, seed) -> dict:
    """Trees on all rows: at every node sqrt(features) features, one random cut each, the best is taken.

    All trees of a batch grow a level at a time; a level takes two rounds of sums.
    """
    width = x.shape[1]
    low, high = team.least(x.min(0, initial=np.inf)), team.most(x.max(0, initial=-np.inf))
    moving = np.flatnonzero(low < high)
    tried = max(1, int(np.sqrt(width)))
    # a node looks at a few features only: each one's values side by side
    columns = np.ascontiguousarray(x.T)
    forest = []
    for first in range(0, trees, TREES_AT_ONCE):
        batch = range(first, min(first + TREES_AT_ONCE, trees))
        totals = team.sum([len(y), y.sum()])
        made = {t: [[-1, 0.0, -1, -1, totals[1] / max(totals[0], 1)]] for t in batch}
        # per tree and node: rows and sum over all tasks, and the task's own rows
        whole = np.arange(len(y), dtype=np.int32)
        open_nodes = {t: {0: (totals[0], totals[1], whole)} for t in batch}
        for level in range(depth):
            asked = []  # (tree, node, features, own rows, draws)
            for t in batch:
                for node, (count, _, rows) in open_nodes[t].items():
                    if count < 2 * leaf_rows or not len(moving):
                        continue
                    rng = np.random.default_rng([seed, t, level, node])
                    features = rng.permutation(moving)[:tried]
                    asked.append((t, node, features, rows, rng.uniform(size=len(features))))
            if not asked:
                break
            slots = max(len(q[2]) for q in asked)
            ends = np.full((2, len(asked), slots), np.inf)
            for i, (_, _, features, rows, _) in enumerate(asked):
                if len(rows):
                    for k, feature in enumerate(features):
                        part = columns[feature].take(rows)
                        ends[0, i, k], ends[1, i, k] = part.min(), -part.max()
            ends = team.least(ends)
            cuts = np.full((len(asked), slots), np.nan)
            sums = np.zeros((2, len(asked), slots))
            for i, (_, _, features, rows, draws) in enumerate(asked):
                own = y.take(rows)
                k = len(features)
                cuts[i, :k] = np.float32(ends[0, i, :k] + draws * (-ends[1, i, :k] - ends[0, i, :k]))
                for j, feature in enumerate(features):
                    left = columns[feature].take(rows) <= np.float32(cuts[i, j])
                    sums[0, i, j], sums[1, i, j] = np.count_nonzero(left), own @ left
            sums = team.sum(sums)
            fresh = {t: {} for t in batch}
            for i, (t, node, features, rows, _) in enumerate(asked):
                count, total, _ = open_nodes[t][node]
                k = len(features)
                n, s = sums[0, i, :k], sums[1, i, :k]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s * s / n + (total - s) ** 2 / (count - n)
                gain[(n < leaf_rows) | (count - n < leaf_rows)] = -np.inf
                best = int(np.argmax(gain))
                if not np.isfinite(gain[best]):
                    continue
                nodes = made[t]
                nodes[node][:4] = [int(features[best]), float(cuts[i, best]), len(nodes), len(nodes) + 1]
                goes = columns[features[best]].take(rows) <= np.float32(cuts[i, best])
                for amount, value, own in ((n[best], s[best], rows[goes]), (count - n[best], total - s[best], rows[~goes])):
                    fresh[t][len(nodes)] = (amount, value, own)
                    nodes.append([-1, 0.0, -1, -1, value / amount])
            open_nodes = fresh
        forest += [made[t] for t in batch]
    return {"start": 0.0, "trees": forest, "mean": True}


def fit_extra_trees(rows: DataFrame, keys: Sequence[str], target: str, rows_per_task=None, **settings) -> dict:
    setting = EXTRA | settings
    return together(
        rows, keys, target, lambda x, y, draw, team: extra_trees(x, y, draw, team, **setting), rows_per_task or FOREST_ROWS_PER_TASK
    )


# --- network ------------------------------------------------------------------------------------


def layers_of(x: np.ndarray, weights: list, biases: list) -> list[np.ndarray]:
    out = [x]
    for i, (w, b) in enumerate(zip(weights, biases)):
        x = x @ w + b
        if i < len(weights) - 1:
            x = np.maximum(x, 0)
        out.append(x)
    return out


def gradients(x, y, weights, biases) -> tuple[list, list]:
    """Sums over rows of the gradients of half the squared error."""
    seen = layers_of(x, weights, biases)
    delta, by_weight, by_bias = seen[-1] - y[:, None], [], []
    for i in range(len(weights) - 1, -1, -1):
        by_weight.append(seen[i].T @ delta)
        by_bias.append(delta.sum(0))
        if i:
            delta = (delta @ weights[i].T) * (seen[i] > 0)
    return by_weight[::-1], by_bias[::-1]


def network(x, y, draw, team: Team, hidden, penalty, rate, epochs, batch, share, patience, tolerance, seed) -> dict:
    """Feed-forward regression (relu) by Adam on each task's rows, averaged over tasks; stops on held-out R2."""
    x = x.astype(np.float64)
    sizes = [x.shape[1], *hidden, 1]
    rng = np.random.default_rng(seed)
    reach = [np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    weights = [rng.uniform(-r, r, (a, b)) for a, b, r in zip(sizes, sizes[1:], reach)]
    biases = [rng.uniform(-r, r, b) for b, r in zip(sizes[1:], reach)]
    held = draw < 100 * share
    if team.sum([held.sum()])[0] < 2 or team.sum([(~held).sum()])[0] < 1:
        held = np.zeros(len(y), bool)
    train, check = np.flatnonzero(~held), np.flatnonzero(held)
    n = int(team.sum([len(train)])[0])
    count, total, square = team.sum([len(check), y[check].sum(), (y[check] ** 2).sum()])
    spread = square - total * total / count if count else 0.0
    steps = max(1, -(-len(train) // batch))
    cells = [*weights, *biases]
    first, second = [np.zeros_like(c) for c in cells], [np.zeros_like(c) for c in cells]
    best, kept, waited, made = -np.inf, [c.copy() for c in cells], 0, 0
    for epoch in range(epochs if n else 0):
        order = np.random.default_rng([seed, epoch, team.number]).permutation(train)
        for part in np.array_split(order, steps):
            if not len(part):
                continue
            made += 1
            step = rate * np.sqrt(1 - 0.999**made) / (1 - 0.9**made)
            by_weight, by_bias = gradients(x[part], y[part], weights, biases)
            for i, (cell, slope) in enumerate(zip(cells, (*by_weight, *by_bias))):
                slope = (slope + (penalty * cell if i < len(weights) else 0.0)) / len(part)
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope * slope
                cell -= step * first[i] / (np.sqrt(second[i]) + 1e-8)
        if team.size > 1:
            # weights and moments of the tasks, averaged by their rows
            state = [*cells, *first, *second]
            flat = team.sum(np.concatenate([c.ravel() for c in state]) * (len(train) / n))
            at = 0
            for cell in state:
                cell[...] = flat[at : at + cell.size].reshape(cell.shape)
                at += cell.size
        if spread > 0:
            error = team.sum([float(((layers_of(x[check], weights, biases)[-1][:, 0] - y[check]) ** 2).sum())])[0]
            score = 1 - error / spread
            waited = 0 if score > best + tolerance else waited + 1
            if score > best:
                best, kept = score, [c.copy() for c in cells]
            if waited > patience:
                break
    if spread > 0:
        cells = kept
    return {"weights": [c.tolist() for c in cells[: len(weights)]], "biases": [c.tolist() for c in cells[len(weights) :]]}


def fit_network(rows: DataFrame, keys: Sequence[str], target: str, rows_per_task=None, **settings) -> dict:
    setting = NETWORK | settings
    return together(rows, keys, target, lambda x, y, draw, team: network(x, y, draw, team, **setting), rows_per_task)


# --- predictions --------------------------------------------------------------------------------


def values_of(model: dict, x: np.ndarray) -> np.ndarray:
    """Predictions of a fitted model for rows of features."""
    if "weights" in model:
        return layers_of(x.astype(np.float64), [np.array(w) for w in model["weights"]], [np.array(b) for b in model["biases"]])[-1][:, 0]
    out = np.full(len(x), model["start"])
    for nodes in model["trees"]:
        out += evaluate(nodes, x)
    return out / max(1, len(model["trees"])) if model.get("mean") else out


def predicted(rows: DataFrame, model: dict, name: str) -> DataFrame:
    """Adds column `name`: the model's values for the array column `z`. The model is a bounded table of numbers."""

    @F.pandas_udf("double")
    def apply(z: pd.Series) -> pd.Series:
        return pd.Series(values_of(model, np.vstack(z).astype(np.float32)) if len(z) else [], dtype=float)

    return rows.withColumn(name, apply("z"))
