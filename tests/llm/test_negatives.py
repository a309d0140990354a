"""Hard negatives against brute force, with several blocks, ties, nulls and repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, uid string"


def brute(rows, positives=5, want=10):
    """Rows of (id, integer vector, label), distinct."""
    out = []
    for i, (a, va, la) in enumerate(rows):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), b, lb) for j, (b, v, lb) in enumerate(rows) if b != a)
        pos = [(b, -s) for s, b, lb in scored if lb == la][:positives]
        for b, p in pos:
            found = [(c, -s) for s, c, lc in scored if lc != la and 30 * p <= -100 * s <= 90 * p][:want]
            out += [(a, b, r + 1, c, p, s) for r, (c, s) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.hard_negatives(negatives.integer_rows(df, F.col("vec_id") % 100 == 0), **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def floored(rows):
    return [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v], lab) for i, v, lab, *_ in rows]


@pytest.mark.parametrize("blocks", [(2048, 4096), (2, 37)])
def test_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(negatives, "ROW_BLOCK", blocks[1])
    draw = random.Random(5)
    # few values: many ties, scores of zero and below
    rows = [(i * 4, [draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)], draw.randrange(3), 7, "x") for i in range(301)]
    got = mined(spark, rows)
    assert got == brute(floored(rows)) and len(got) > 100


def test_scores_of_zero(spark):
    rows = [(100, [1.0, 0.0], 1, 0, ""), (9, [0.0, 1.0], 1, 0, ""), (2, [0.0, 1.0], 2, 0, ""), (3, [-1.0, 0.0], 2, 0, "")]
    assert mined(spark, rows) == [(100, 9, 1, 2, 0, 0)]


def test_left_out(spark):
    good = [(0, [1.0, 1.0], 1, 0, ""), (1, [1.0, 1.0], 1, 0, ""), (2, [0.5, 0.5], 2, 0, ""), (5, [0.9], 2, 0, "")]
    odd = [(None, [0.5, 0.5], 2, 0, ""), (3, [0.5, None], 2, 0, ""), (4, [0.5, float("nan")], 2, 0, ""), (6, None, 2, 0, ""),
           (7, [float("inf"), 0.0], 2, 0, ""), (8, [0.5, 0.5], None, 0, ""), (9, [], 2, 0, "")]
    # repeated rows count once; rows that share an id are rows of their own
    want = mined(spark, good)
    assert mined(spark, good + odd + good) == want == brute(floored(good))
    assert [r[3] for r in mined(spark, [*good, (2, [0.6, 0.6], 2, 0, "")])] == [2, 2, 5]
    assert mined(spark, []) == [] and mined(spark, good[1:]) == []


def test_all_if_fewer(spark):
    rows = [(0, [1.0], 1, 0, ""), (1, [1.0], 1, 0, ""), (2, [0.5], 2, 0, ""), (3, [0.6], 3, 0, "")]
    assert [r[1:4] for r in mined(spark, rows)] == [(1, 1, 3), (1, 2, 2)]
    assert [r[1:4] for r in mined(spark, rows, negatives=1)] == [(1, 1, 3)]


def test_too_large(spark):
    with pytest.raises(Exception, match="beyond"):
        mined(spark, [(0, [1e30], 1, 0, ""), (1, [1e30], 1, 0, "")])
