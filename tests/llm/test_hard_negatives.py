"""Mining of hard negatives against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from covermart.llm import hard_negatives as hn
from llm import brute
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<float>, row long, block long, score double, `leaf.x` string"


def tenth():
    return F.col("vec_id") % 10 == 0


def frame(spark, rows, kind="float"):
    clashing = [(*r, 1, 2, 3.0, "x") for r in rows]
    return spark.createDataFrame(clashing, SCHEMA.replace("float", kind)).repartition(4)


def drawn(count, width, seed, labels=4):
    """Vectors around a few centres, so that ranges of distances leave subtrees out."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    near = centres[rng.integers(0, 8, count)] + 0.2 * rng.normal(size=(count, width))
    return [(k, int(rng.integers(labels)), [float(np.float32(x)) for x in v]) for k, v in enumerate(near)]


@pytest.mark.parametrize("chunk", [hn.CHUNK, 7])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(hn, "CHUNK", chunk)
    rows = drawn(900, 12, 1)
    got = hn.hard_negatives(spark, frame(spark, rows), tenth())
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert brute.order(got.collect()) == brute.order(brute.negatives(rows, 10))


def test_query_equals_brute_force(spark, sf_dir):
    from covermart.llm import queries

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in table]
    got = queries.op13_hard_negatives(spark, sf_dir).collect()
    assert len(got) > 0
    assert brute.order(got) == brute.order(brute.negatives(rows))


def test_awkward_rows(spark):
    """NULLs, non-finite components, short and empty vectors, ties and repeated rows."""
    nan, inf = float("nan"), float("inf")
    rows = [(k, k % 3, [1.0, float(k % 4), 0.5]) for k in range(60)]  # many ties
    rows += [(10, 1, [1.0, 2.0, 0.5])] * 2  # an anchor's id three times
    rows += [(70, None, [1.0, 1.0, 1.0]), (80, 1, None), (None, 1, [1.0, 1.0, 1.0])]
    rows += [(90, 1, [1.0, None, 1.0]), (100, 1, [nan, 1.0, 1.0]), (110, 1, [-inf, 1.0, 1.0])]
    rows += [(120, 1, [1.0]), (121, 2, [2.0, 1.0]), (130, 0, []), (140, 2, [-1.0, -1.0, -1.0]), (150, 9, [1.0, 1.0, 1.0])]
    got = hn.hard_negatives(spark, frame(spark, rows), tenth())
    assert brute.order(got.collect()) == brute.order(brute.negatives(rows, 10))


def test_a_third_of_the_rows_is_one_vector(spark):
    rows = drawn(600, 8, 2)
    rows = [(i, c, rows[0][2] if i % 3 == 0 else v) for i, c, v in rows]
    got = hn.hard_negatives(spark, frame(spark, rows), tenth())
    assert brute.order(got.collect()) == brute.order(brute.negatives(rows, 10))


def test_large_components_stay_whole(spark):
    """Components beyond four bytes, products beyond eight: exact all the same."""
    draw = random.Random(3)
    for size in (1e6, 4e6):
        rows = [(k, k % 2, [draw.uniform(-size, size) for _ in range(3)]) for k in range(40)]
        got = hn.hard_negatives(spark, frame(spark, rows, "double"), tenth())
        assert brute.order(got.collect()) == brute.order(brute.negatives(rows, 10))


def test_no_rows_no_anchors_and_few_rows(spark):
    for rows in ([], [(1, 0, [1.0]), (2, 1, [1.0])], [(10, 0, [1.0])], [(10, 0, [1.0]), (20, 0, [1.0])]):
        got = hn.hard_negatives(spark, frame(spark, rows), tenth())
        assert got.collect() == []


def test_ranges_leave_subtrees_out():
    """A window far from a cluster does not meet the cluster's range of scores."""
    rng = np.random.default_rng(5)
    near, far = rng.normal(size=(50, 6)) + 20, rng.normal(size=(50, 6)) - 20
    tree = hn.SplitTree(np.vstack([near, far]))
    leaf, _ = tree.leaves(np.vstack([near, far]))
    assert not set(leaf[:50]) & set(leaf[50:])
    for own in np.unique(leaf):
        x = np.vstack([near, far])[leaf == own]
        away, square = tree.to_points(x, own), (x**2).sum(axis=1)
        known = hn.Ranges(away.min(axis=0), away.max(axis=0), square.min(), square.max())
        lowest, highest = known.scores((near[:1] ** 2).sum(axis=1), tree.to_points(near[:1], own))
        scores = near[:1] @ x.T
        assert lowest[0] <= scores.min() and scores.max() <= highest[0]
        assert (highest[0] < 0) == (scores.max() < 0)
