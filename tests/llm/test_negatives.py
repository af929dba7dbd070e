"""Hard negatives against brute force, and the intervals they rest on."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import negatives
from plumbline.sources.stored import settle


def brute(rows, positives=5, negatives_=3, low=50, high=95):
    cells = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            key = (str(label), [float(np.float32(x)) for x in v])
            cells[i] = min(cells.get(i, key), key)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in cells.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % 50:
            continue
        score = {i: sum(p * q for p, q in zip(v, w)) for i, (_, w) in whole.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if whole[i][0] == label][:positives]:
            fits = [i for i in ranked if whole[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(fits[:negatives_])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, v, 1, 2) for i, lab, v in rows], "vec_id bigint, label int, embedding array<float>, score int, anchor_id int")


def mined(table, **more):
    out = negatives.hard_negatives(table, "vec_id", F.col("label"), "embedding", F.col("vec_id") % 50 == 0, **more)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("block", [13, 8192])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "VECTOR_BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    rng = random.Random(block)
    base = [[rng.gauss(0, 0.3) for _ in range(20)] for _ in range(3)]
    rows = [(i, i % 3, [x + rng.gauss(0, 0.1) for x in base[rng.choice([i % 3, 0])]]) for i in range(400)]
    rows += [(500 + i, i % 2, rows[50][2]) for i in range(20)]  # ties, also with an anchor
    rows += [(600, None, [1.0] * 20), (650, 1, None), (700, 1, [None] * 20), (701, 1, [float("nan")] * 20), (702, 0, [float("inf")] * 20)]
    rows += [(None, 1, [1.0] * 20), (100, 2, [9.0] * 20), (750, 0, [0.5]), (751, 0, []), (800, 9, [0.0] * 20), (850, 1, [0.25] * 70), (1, 1, rows[1][2])]
    table = frame(spark, rows)
    want = brute(rows)
    assert want and mined(table) == want
    assert mined(table.limit(0)) == []


def test_hot_label_and_few_partners(spark):
    rows = [(i, 4, [1.0, 0.5 * i]) for i in range(0, 200, 25)]
    assert mined(frame(spark, rows)) == []
    rows += [(7, 5, [0.7, 1.0])]
    assert mined(frame(spark, rows)) == brute(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in negatives.op13_hard_negatives(spark, sf).collect()) == brute(rows)


def test_intervals_hold_and_narrow():
    rng = np.random.default_rng(1)
    cells, asked = np.rint(rng.normal(0, 40, (300, 70))), np.rint(rng.normal(0, 40, (5, 70)))
    cells[0] = 0
    codes, figures = negatives.one_bit_codes(negatives.turned(cells, 70))
    for y, whole in zip(asked, negatives.turned(asked, 70)):
        spans = negatives.Intervals(negatives.Anchor(whole), codes, figures, np.arange(300))
        widths, exact = [], cells @ y
        for _ in range(negatives.LEVELS):
            low, high = spans.refine()
            assert (low <= exact).all() and (exact <= high).all()
            widths.append((high - low).mean())
        assert widths == sorted(widths, reverse=True) and widths[-1] < 0.4 * widths[0]


def test_most_rows_are_settled_by_intervals():
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 30, 64)
    cells = np.rint(np.concatenate([centre + rng.normal(0, 10, (40, 64)), rng.normal(0, 30, (4000, 64))])).astype(np.int64)
    codes, figures = negatives.one_bit_codes(negatives.turned(cells, 64))
    ranges = negatives.Ranges([0], [np.iinfo(np.int64).max], 5)
    whole = negatives.turned(centre[None, :], 64)[0]
    scored = ranges.search(negatives.Anchor(whole), np.rint(centre).astype(np.int64), np.arange(len(cells)), cells, codes, figures, np.arange(len(cells)))
    assert scored < 200


def test_anchors_are_never_broadcast(spark):
    """Anchors are repeated for every vector block, which their table's size does not show."""
    table = frame(spark, [(i, i % 2, [1.0, 0.1 * i]) for i in range(120)])
    usable = table.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"), F.lit(None).cast("array<array<bigint>>").alias("wanted"))
    stored = settle(negatives.blocks(usable, 50, 256.0), "vectors")
    found = negatives.best_rows(stored, stored, 2, same=True)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 240
