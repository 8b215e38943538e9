"""Hard negatives against a plain search in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bond

SCHEMA = "vec_id long, embedding array<float>, label int, id string, pos string, block string, score string, vector string"


def plain(rows, anchor, relabel=lambda i, label: label):
    kept = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in x], relabel(vec_id, label)))
    key = lambda r: (-r[1], r[0] is not None, r[0] or 0)
    found = []
    for i, (vec_id, x, label) in enumerate(kept):
        if vec_id is None or not anchor(vec_id):
            continue
        scored = [(o, sum(a * b for a, b in zip(x, y)), lab) for j, (o, y, lab) in enumerate(kept) if j != i]
        for positive in sorted((r for r in scored if r[2] == label), key=key)[:5]:
            fits = [r for r in scored if r[2] != label and 50 * positive[1] <= 100 * r[1] <= 95 * positive[1]]
            for rank, negative in enumerate(sorted(fits, key=key)[:3], 1):
                found.append((vec_id, positive[0], rank, negative[0], positive[1], negative[1]))
    return sorted(found, key=repr)


def mined(spark, rows, anchor, **more):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in bond.hard_negatives(frame, anchor, **more).collect()), key=repr)


def near(rng, base, spread):
    return [float(np.float32(b + rng.gauss(0, spread))) for b in base]


@pytest.mark.parametrize("block_rows", [7, 64, None])
def test_equals_a_plain_search(spark, block_rows):
    rng = random.Random(3)
    bases = [[rng.gauss(0, 0.2) for _ in range(20)] for _ in range(4)]
    rows = [(i, near(rng, bases[i % 4], 0.08), rng.choice([0, 1, 1, 1, 2, 9])) for i in range(240)]
    rows += [rows[0], rows[50], (50, rows[3][1], 1), (None, rows[4][1], 1), (None, rows[100][1], 0)]  # repeated and missing ids
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 240, 7)]  # ties
    shown = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mined(spark, rows, F.col("vec_id") % 50 == 0, label=shown, block_rows=block_rows)
    expected = plain(rows, lambda i: i % 50 == 0, lambda i, label: (label + 1) % 10 if i is not None and i % 7 == 0 else label)
    assert len(expected) > 30 and got == expected


def test_rows_that_take_no_part_and_short_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.9, 1.5], 2), (3, [1.0], 2), (4, [], 2), (5, None, 2), (6, [1.0, None], 2), (7, [nan, 1.0], 2),
            (8, [1.0, -inf], 2), (9, [0.5, 2.0], None), (None, None, None), (10, [0.8, 1.7, 5.0], 3)]
    assert mined(spark, rows, F.col("vec_id") == 0) == plain(rows, lambda i: i == 0)
    assert mined(spark, rows, F.col("vec_id") == 77) == []
    assert mined(spark, rows[5:9], F.col("vec_id") >= 0) == []
    assert mined(spark, rows[:0] or [(5, None, 2)], F.lit(True)) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert bond.hard_negatives(empty, F.lit(True)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**21 + i), 1.0], i % 2) for i in range(12)]
    assert mined(spark, rows, F.col("vec_id") < 3) == plain(rows, lambda i: i < 3)


def test_bounds_prune():
    """Most columns of most rows stay unread, and the result is that of the whole product."""
    import pandas as pd

    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.05, (2000, 64))
    vectors[:, :8] += rng.normal(0, 1, (2000, 8))
    block = bond.Block(pd.DataFrame({"id": range(2000), "label": 0, "pos": range(2000), "vector": list(vectors)}), 256.0)
    anchor = bond.whole(vectors[5], 256.0)
    looks = []

    def keep(low, high):
        looks.append(len(low))
        return high >= np.sort(low)[-5]

    at, scores = block.scan(anchor, np.ones(2000, bool), keep)
    whole = anchor @ block.columns
    assert set(np.argsort(-whole)[:5]) <= set(at) and (scores == whole[at]).all()
    assert looks[0] == 2000 and looks[2] < 200
