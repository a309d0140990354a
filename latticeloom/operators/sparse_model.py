"""Sparse linear models from large feature tables.

Every solver here needs only sums of products. One pass over the rows gives the
Gram matrix of features, target and a constant column; screening, the lasso path
and the subset search then work on that small matrix, however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.operators.linear import gram_matrix
from latticeloom.session import cut_lineage


class Moments:
    """Centred second moments of features ``x`` and target ``y`` (divided by n)."""

    def __init__(self, n: int, gram: np.ndarray, pivot: np.ndarray | None = None):
        """``pivot`` was subtracted from the columns before their products were summed."""
        self.n = n
        mean = gram[-1, :-1] / n                         # the last column is the constant 1
        cov = gram[:-1, :-1] / n - np.outer(mean, mean)
        mean = mean if pivot is None else mean + pivot
        self.x_mean, self.y_mean = mean[:-1], mean[-1]
        self.xx, self.xy, self.yy = cov[:-1, :-1], cov[:-1, -1], cov[-1, -1]
        self.x_std = np.sqrt(np.maximum(np.diag(self.xx), 0.0))


def check_inputs(df: DataFrame, features: Sequence[str], target: str,
                 unit_classes: Sequence[str] | None = None) -> None:
    """Numeric target, at least two features, one unit class per feature, no gaps."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    kinds = dict(df.dtypes)
    if len(features) < 2:
        raise ValueError("at least two features are needed")
    if unit_classes is not None and len(unit_classes) != len(features):
        raise ValueError("one unit class per feature is needed")
    for c in [*features, target]:
        if kinds.get(c) not in numeric and not str(kinds.get(c)).startswith("decimal"):
            raise ValueError(f"column {c!r} is not numeric")
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in [*features, target]]).first()
    if any(gaps):
        raise ValueError("features and target must not be null")


def moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    """The products are summed of columns less their means, so that a large offset costs no digits."""
    columns = [F.col(f"`{c}`").cast("double") for c in [*features, target]]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    pivot = np.array([m if m is not None and math.isfinite(m) else 0.0 for m in means])
    row = F.array(*[c - F.lit(float(m)) for c, m in zip(columns, pivot)], F.lit(1.0))
    return Moments(*gram_matrix(df.select(row.alias("vec")), dim=len(features) + 2), pivot)


def lasso_screen(m: Moments, keep: int = 25, grid_points: int = 100, max_factor: float = 1.0,
                 min_factor: float = 0.001, tol: float = 1e-6, max_iter: int = 10_000) -> list[int]:
    """Features with non-zero lasso weight along a falling penalty grid, in index order.

    Columns are standardised with the population deviation; the objective is
    ``|y - Xw|^2 / (2n) + lambda |w|_1``. The grid goes from the largest absolute
    correlation down to ``min_factor`` of it and stops once ``keep`` are found.
    """
    std = np.where(m.x_std > 0, m.x_std, 1.0)
    g, c = m.xx / np.outer(std, std), m.xy / std
    top = np.abs(c).max()
    grid = np.logspace(math.log10(top * max_factor), math.log10(top * min_factor), grid_points)
    w, found = np.zeros(len(c)), []
    for lam in grid:
        for _ in range(max_iter):
            biggest = 0.0
            for j in range(len(c)):
                if g[j, j] <= 0:
                    continue
                rho = c[j] - g[j] @ w + g[j, j] * w[j]
                new = math.copysign(max(abs(rho) - lam, 0.0), rho) / g[j, j]
                biggest, w[j] = max(biggest, abs(new - w[j])), new
            if biggest < tol * max(1.0, math.sqrt(max(m.yy, 0.0))):
                break
        else:
            raise RuntimeError(f"the lasso weights at penalty {lam:g} have not settled after {max_iter} sweeps")
        found += [j for j in np.flatnonzero(w) if j not in found]
        if len(found) >= keep:
            break
    return sorted(int(j) for j in found[:keep])


def correlation(x: Column, y: Column) -> Column:
    """Correlation of two columns, null if one is constant."""
    # both deviations of the rows that have both values
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def screen_by_correlation(df: DataFrame, features: Sequence[str], residual: str, keep: int) -> list[str]:
    """The ``keep`` features with the largest absolute correlation with a residual."""
    r = df.agg(*[correlation(F.col(f"`{c}`").cast("double"), F.col(residual)).alias(c) for c in features]).first()
    rated = [(-abs(r[c]), c) for c in features if r[c] is not None and not math.isnan(r[c])]
    return [c for _, c in sorted(rated)[:keep]]


def screen_long(values: DataFrame, residuals: DataFrame, names: Sequence[str], keep: int, key: str = "id",
                known: Sequence[str] = ()) -> list[str]:
    """The ``keep`` features of a long ``(key, feature, value)`` table with the largest absolute correlation with any of several
    residuals, the columns ``names`` of ``residuals``; ``known`` features are passed over.

    One pass over the table: a feature's co-moments with every residual are merged from partial ones, and each task holds the best
    ``keep`` features it has seen. Features that are constant, or of equal score, come last and in order of name.
    """
    rows = values.where(~F.col("feature").isin(list(known))) if known else values
    joined = lookup_join(rows, residuals.select(key, *names), key)
    score = F.greatest(*[F.coalesce(F.abs(correlation(F.col("value"), F.col(n))), F.lit(0.0)) for n in names], F.lit(0.0))
    best = joined.groupBy("feature").agg(score.alias("score")).where("score > 0").orderBy(F.desc("score"), "feature").limit(keep)
    return [r["feature"] for r in best.collect()]


def wide_features(values: DataFrame, features: Sequence[str], key: str = "id") -> DataFrame:
    """One column for each of a few features of a long table, named ``f0, f1, ...`` in their order."""
    some = values.where(F.col("feature").isin(list(features)))
    return some.groupBy(key).agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"f{i}") for i, f in enumerate(features)])


def best_subsets(df: DataFrame, features: Sequence[str], m: Moments, size: int, n: int = 1) -> list[dict]:
    """The ``n`` subsets of the given size with the least error, their weights and intercepts."""
    out = []
    for row in subset_errors(df, features, m, size).orderBy("mse", "subset").limit(n).collect():
        s = list(row["subset"])
        w = np.linalg.solve(m.xx[np.ix_(s, s)], m.xy[s])
        out.append({"features": [features[j] for j in s], "weights": w.tolist(), "intercept": float(m.y_mean - w @ m.x_mean[s]), "mse": row["mse"]})
    if not out:
        raise ValueError(f"every subset of {size} features is singular")
    return out


def fit_by_long_screening(values: DataFrame, targets: DataFrame, max_dim: int = 3, per_step: int = 10, residuals: int = 3,
                          key: str = "id", target: str = "target") -> list[dict]:
    """Sure-independence screening of any number of features, kept as rows ``(key, feature, value)``.

    For each dimension the features that correlate best with any of the residuals of the ``residuals`` best models so far (at first
    with the target) join the pool, and the best subset of the pool of that size is the model. The table of all features is
    read once a dimension; only the pool, ``per_step`` features a dimension, is ever wide.
    """
    work = cut_lineage(targets.select(key, F.col(target).cast("double").alias("_y")))
    held, names = work.withColumn("_r0", F.col("_y")), ["_r0"]
    pool: list[str] = []
    models: list[dict] = []
    for size in range(1, max_dim + 1):
        pool += screen_long(values, held, names, per_step, key, pool)
        wide = cut_lineage(wide_features(values, pool, key).join(work, key))
        columns = [f"f{i}" for i in range(len(pool))]
        best = best_subsets(wide, columns, moments(wide, columns, "_y"), min(size, len(pool)), residuals)
        names = [f"_r{i}" for i in range(len(best))]
        held = wide
        for name, model in zip(names, best):
            held = predict(held, model, "_p").withColumn(name, F.col("_y") - F.col("_p")).drop("_p")
        held = cut_lineage(held.select(key, *names))
        models.append({**best[0], "features": [pool[int(f[1:])] for f in best[0]["features"]]})
    return models


def _nth_subset(rank: int, n: int, k: int) -> list[int]:
    """Subset number ``rank`` of k out of n in lexical order."""
    out, low = [], 0
    for left in range(k, 0, -1):
        while (block := math.comb(n - low - 1, left - 1)) <= rank:
            rank, low = rank - block, low + 1
        out.append(low)
        low += 1
    return out


def subset_errors(df: DataFrame, features: Sequence[str], m: Moments, size: int) -> DataFrame:
    """Least squares with intercept for every subset of ``size`` features:
    ``(subset array<int>, mse)``; singular subsets are left out.

    Subsets are numbered rows of a distributed range; each task solves its numbers
    from the shared moment matrix.
    """
    n, total = len(features), math.comb(len(features), size)
    xx, xy, yy = m.xx, m.xy, m.yy

    def solve(batches):
        for pdf in batches:
            subsets, errors = [], []
            for rank in pdf["id"]:
                s = _nth_subset(int(rank), n, size)
                a = xx[np.ix_(s, s)]
                d = np.sqrt(np.diag(a))
                if (d <= 0).any() or np.linalg.cond(a / np.outer(d, d)) > 1e12:
                    continue
                subsets.append(s)
                errors.append(float(yy - xy[s] @ np.linalg.solve(a, xy[s])))
            yield pd.DataFrame({"subset": subsets, "mse": errors})

    spark = df.sparkSession
    tasks = max(1, min(total // 1000 + 1, 10_000))
    return spark.range(0, total, numPartitions=tasks).mapInPandas(solve, "subset array<int>, mse double")


def best_subset(df: DataFrame, features: Sequence[str], m: Moments, size: int) -> dict:
    """Subset of the given size with the least error, its weights and intercept."""
    return best_subsets(df, features, m, size)[0]


def fit_sparse_model(df: DataFrame, features: Sequence[str], target: str, max_dim: int = 3,
                     keep: int = 25) -> list[dict]:
    """Lasso screening, then the best subset for each dimension up to ``max_dim``."""
    check_inputs(df, features, target)
    m = moments(df, features, target)
    kept = [features[j] for j in lasso_screen(m, keep)]
    small = moments(df, kept, target)
    return [best_subset(df, kept, small, k) for k in range(1, min(max_dim, len(kept)) + 1)]


def fit_by_screening(df: DataFrame, features: Sequence[str], target: str, max_dim: int = 2,
                     per_step: int = 10) -> list[dict]:
    """Screen by correlation with the residual, pool the survivors, best subset of the
    pool; repeated for each dimension."""
    check_inputs(df, features, target)
    pool: list[str] = []
    models: list[dict] = []
    work = df.withColumn("_residual", F.col(target).cast("double"))
    for k in range(1, max_dim + 1):
        fresh = [c for c in features if c not in pool]
        pool += screen_by_correlation(work, fresh, "_residual", per_step) if fresh else []
        models.append(best_subset(df, pool, moments(df, pool, target), min(k, len(pool))))
        work = predict(df, models[-1], "_p").withColumn("_residual", F.col(target) - F.col("_p")).drop("_p")
    return models


def predict(df: DataFrame, model: dict, out: str = "y_pred") -> DataFrame:
    value = F.lit(model["intercept"])
    for name, w in zip(model["features"], model["weights"]):
        value = value + F.lit(float(w)) * F.col(f"`{name}`")
    return df.withColumn(out, value)


def result_table(df: DataFrame, model: dict, target: str, keep: Sequence[str] = (),
                 viewer: bool = False) -> DataFrame:
    """Descriptor coordinates, prediction, truth and unused columns."""
    names = [f"coord_{i}" if viewer else f for i, f in enumerate(model["features"])]
    rows = predict(df, model)
    return rows.select(*keep, *[F.col(f"`{f}`").alias(n) for f, n in zip(model["features"], names)],
                       "y_pred", F.col(target).alias("y_true"))
