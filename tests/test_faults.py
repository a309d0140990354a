"""Inputs that once lost rows, never ended or cost digits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeloom.distributed import row_index
from latticeloom.operators import boxgrid, labels, ml, sparse_model
from latticeloom.operators.neighbors import minimum_distance


def test_unlike_atoms_at_one_place(spark):
    rows = [("a", 0, 0.0, 0.0, 0.0, 8), ("a", 1, 0.0, 0.0, 0.0, 26), ("a", 2, 1.0, 2.0, 2.0, 8),
            ("b", 0, 0.0, 0.0, 0.0, 8), ("b", 1, 1.0, 2.0, 2.0, 26), ("b", 2, 9.0, 9.0, 9.0, 8),
            ("c", 0, 0.0, 0.0, 0.0, 8), ("c", 1, 1e-30, 0.0, 0.0, 8), ("c", 2, 5.0, 0.0, 0.0, 8)]
    atoms = spark.createDataFrame(rows, "structure_id string, atom_id long, x double, y double, z double, number int")
    got = {r.structure_id: r.min_distance for r in minimum_distance(atoms).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(3.0), "c": pytest.approx(1e-30)}


def test_rows_without_a_class_are_split_too(spark):
    df = spark.range(20).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("label"))
    got = labels.split_rows(df, "id", 5, "label").collect()
    assert sorted(r.id for r in got) == list(range(20)) and sum(r.split == "validation" for r in got) == 5
    assert sum(r.split == "validation" for r in got if r.label is None) == 1


def test_index_of_a_null_group(spark):
    df = spark.range(12).select("id", F.when(F.col("id") >= 4, F.col("id") % 2).alias("g"))
    got = sorted((r.g is None, r.g or 0, r.row_index) for r in row_index(df, ["id"], ["g"]).collect())
    assert got == [(False, g, i) for g in (0, 1) for i in range(4)] + [(True, 0, i) for i in range(4)]


def test_moments_of_columns_with_a_large_offset(spark):
    r = np.random.default_rng(5)
    x = r.uniform(size=(300, 3)) + [1e8, -3e8, 0.0]
    y = x @ [2.0, 1.0, 0.5] + 1e9
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    m = sparse_model.moments(df, ["a", "b", "c"], "y")
    assert np.allclose(m.xx, np.cov(x.T, bias=True), rtol=1e-6, atol=1e-9) and np.allclose(m.x_mean, x.mean(axis=0))
    assert m.y_mean == pytest.approx(y.mean()) and m.yy == pytest.approx(y.var(), rel=1e-6)


def test_lasso_says_that_it_has_not_settled(spark):
    x = np.random.default_rng(6).normal(size=(50, 4))
    df = spark.createDataFrame([tuple(map(float, [*a, a.sum() + a[0]])) for a in x + x[:, :1]], "a double, b double, c double, d double, y double")
    with pytest.raises(RuntimeError, match="not settled"):
        sparse_model.lasso_screen(sparse_model.moments(df, list("abcd"), "y"), max_iter=1)


def test_resample_multiplicities_are_not_cut():
    steps = ml.poisson_steps()
    assert len(steps) > 12 and 1.0 - steps[-1] < 1e-15
    assert steps[:3] == pytest.approx([math.exp(-1), 2 * math.exp(-1), 2.5 * math.exp(-1)])


def test_box_sizes_that_never_fit_raise(spark):
    atoms = spark.range(64).select(F.lit("s").alias("source"), F.col("id").alias("atom_id"), (F.col("id") % 4).cast("double").alias("x"),
                                   (F.floor(F.col("id") / 4) % 4).cast("double").alias("y"), F.floor(F.col("id") / 16).cast("double").alias("z"))
    with pytest.raises(ValueError, match="no box size fits"):
        boxgrid.optimal_box_size(atoms, [1.5] * 3, target_atoms=1000, max_iter=2, stride=(1.0, 1.0, 1.0))
