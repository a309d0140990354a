"""Column statistics, Gram matrices, projections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = {"mean-variance": (True, True), "mean": (True, False), "variance": (False, True), "none": (False, False)}


def dimension(df: DataFrame, vec: str = "vec") -> int:
    """Vector length of the first row; the passes over all rows check the others."""
    first = df.select(F.size(vec)).first()
    if first is None or first[0] < 1:
        raise ValueError("vectors must have a component at least")
    return first[0]


def column_moments(df: DataFrame, vec: str = "vec", dim: int | None = None) -> tuple[list[float], list[float]]:
    """Mean and population deviation per component, from one mergeable summary; two numbers each reach the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    dim = dim or dimension(df, vec)
    rows = df.select(F.col(vec).cast("array<double>").alias("_v"))
    r = rows.agg(F.min(F.size("_v")).alias("lo"), F.max(F.size("_v")).alias("hi"), F.count("_v").alias("n")).first()
    if (r["lo"], r["hi"]) != (dim, dim):
        raise ValueError(f"vector lengths differ: {r['lo']} to {r['hi']}")
    s = rows.select(Summarizer.metrics("mean", "variance").summary(array_to_vector("_v")).alias("s")).select("s.*").first()
    spread = np.sqrt(np.asarray(s["variance"]) * (r["n"] - 1) / r["n"])
    return [float(v) for v in s["mean"]], [float(v) for v in spread]


def _affine(vec: Column, centre: Sequence[float], spread: Sequence[float]) -> Column:
    mean, std = (F.array(*[F.lit(float(x)) for x in v]) for v in (centre, spread))
    return F.zip_with(F.zip_with(vec, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def standardise(df: DataFrame, mode: str = "mean-variance", vec: str = "vec", out: str | None = None) -> DataFrame:
    """Standardise columns; a column without spread is divided by 1."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {sorted(MODES)}")
    centre, spread = MODES[mode]
    if not (centre or spread):
        return df if out in (None, vec) else df.withColumn(out, F.col(vec))
    mean, std = column_moments(df, vec)
    return df.withColumn(out or vec, _affine(
        F.col(vec), mean if centre else [0.0] * len(mean),
        [s if s else 1.0 for s in std] if spread else [1.0] * len(std)))


def gram_matrix(df: DataFrame, vec: str = "vec", dim: int | None = None) -> tuple[int, np.ndarray]:
    """Row count and ``sum v v^T`` over all rows.

    Each task multiplies its Arrow batches and emits one d x d block in rows; the
    blocks are summed by Spark, so the driver only ever sees the d x d result.
    """
    dim = dim or dimension(df, vec)

    def blocks(batches):
        total, n = np.zeros((dim, dim)), 0
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["v"].to_numpy())
                total += x.T @ x
                n += len(pdf)
        if n:
            yield pd.DataFrame({"i": range(dim), "row": list(total), "n": [n] * dim})

    parts = df.select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(
        blocks, "i int, row array<double>, n long")
    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "row": [np.sum(np.vstack(pdf["row"].to_numpy()), axis=0)], "n": [pdf["n"].sum()]})

    # a row of the matrix from each task
    rows = parts.groupBy("i").applyInPandas(added, "i int, row array<double>, n long").orderBy("i").collect()
    if not rows:
        return 0, np.zeros((dim, dim))
    return int(rows[0]["n"]), np.array([r["row"] for r in rows])


def _power_block(df: DataFrame, vec: str, centre: np.ndarray, spread: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``X^T X block`` for the rows x = (v - centre) / spread: the sum over tasks of d x l numbers, d x d ones never arise."""
    shared = df.sparkSession.sparkContext.broadcast((centre, spread, block))
    wide = block.shape[1]

    def products(batches):
        mid, by, w = shared.value
        total, seen = np.zeros(w.shape), False
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                x = (np.vstack(pdf["v"].iloc[at:at + 512].to_numpy()) - mid) / by
                total += x.T @ (x @ w)
                seen = True
        if seen:
            yield pd.DataFrame({"i": range(len(total)), "row": list(total)})

    parts = df.select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(products, "i int, row array<double>")
    out = np.zeros(block.shape)
    for r in parts.groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(wide)]).alias("row")).toLocalIterator():
        out[r["i"]] = r["row"]
    return out


def top_directions(df: DataFrame, k: int, centre: Sequence[float], spread: Sequence[float], vec: str = "vec", extra: int = 10,
                   tolerance: float = 1e-10, passes: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of X^T X and their directions (d x k), by a randomised block Krylov method.

    From a seeded random block of k + ``extra`` columns each pass over the rows multiplies the newest block of an orthonormal
    basis by X^T X. The products of all blocks with the basis are the small matrix whose eigenvectors are the directions. The
    passes end when the k eigenvalues settle, or the basis spans all d components. What the driver holds is d x (passes x block).
    """
    dim = len(centre)
    wide = min(dim, k + extra)
    mid, by = np.asarray(centre, dtype=float), np.asarray(spread, dtype=float)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, wide)))[0]
    images, newest, last = np.zeros((dim, 0)), basis, None
    for _ in range(passes):
        images = np.hstack([images, _power_block(df, vec, mid, by, newest)])
        small = basis.T @ images
        values, turned = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:k]
        found = values[top]
        settled = last is not None and np.all(np.abs(found - last) <= tolerance * max(abs(found[0]), 1e-300))
        if settled or basis.shape[1] >= dim:
            return found, basis @ turned[:, top]
        last = found
        fresh = images[:, -newest.shape[1]:]
        for _ in range(2):                                          # twice is enough for an orthonormal basis
            fresh = fresh - basis @ (basis.T @ fresh)
        size = np.linalg.norm(fresh, axis=0)
        fresh = fresh[:, size > 1e-12 * max(abs(found[0]), 1e-300)]
        if not fresh.shape[1]:
            return found, basis @ turned[:, top]
        newest = np.linalg.qr(fresh)[0][:, :dim - basis.shape[1]]
        newest = np.linalg.qr(newest - basis @ (basis.T @ newest))[0]
        basis = np.hstack([basis, newest])
    raise RuntimeError(f"the {k} largest eigenvalues have not settled after {passes} passes")


def project(df: DataFrame, basis: np.ndarray, vec: str = "vec", out: str = "coords", centre: Sequence[float] | None = None,
            spread: Sequence[float] | None = None) -> DataFrame:
    """Dot products of (vec - centre) / spread with the columns of ``basis``, in Arrow batches."""
    mid = np.zeros(len(basis)) if centre is None else np.asarray(centre, dtype=float)
    by = np.ones(len(basis)) if spread is None else np.asarray(spread, dtype=float)
    shared = df.sparkSession.sparkContext.broadcast((mid, by, basis))

    @F.pandas_udf("array<double>")
    def dots(vectors: pd.Series) -> pd.Series:
        centre_, spread_, columns = shared.value
        rows = vectors.to_numpy()
        parts = [((np.vstack(rows[at:at + 512]) - centre_) / spread_) @ columns for at in range(0, len(rows), 512)]
        return pd.Series(list(np.vstack(parts)) if parts else [], dtype=object)

    return df.withColumn(out, dots(F.col(vec).cast("array<double>")))


def _fixed_sign(basis: np.ndarray) -> np.ndarray:
    """Directions are defined up to sign: make the largest loading positive."""
    top = np.abs(basis).argmax(axis=0)
    return basis * np.where(basis[top, range(basis.shape[1])] < 0, -1.0, 1.0)


def pca(df: DataFrame, k: int = 2, mode: str = "mean-variance", vec: str = "vec") -> tuple[DataFrame, float]:
    """First ``k`` principal coordinates and their share of the variance."""
    mean, std = column_moments(df, vec)
    scale = [s if s else 1.0 for s in std] if MODES[mode][1] else [1.0] * len(std)
    values, vectors = top_directions(df, min(k, len(mean)), mean, scale, vec)
    total = df.count() * sum((s / w) ** 2 for s, w in zip(std, scale))
    # after a division alone the coordinates are centred as well, as the directions are those of the covariance
    return project(df, _fixed_sign(vectors), vec, centre=mean, spread=scale), float(values.sum() / total) if total else 0.0


def truncated_svd(df: DataFrame, k: int = 2, mode: str = "mean-variance",
                  vec: str = "vec") -> tuple[DataFrame, np.ndarray]:
    """Projection on the first ``k`` right singular vectors, and the singular values."""
    centre, spread = MODES[mode]
    mean, std = column_moments(df, vec) if centre or spread else ([0.0] * dimension(df, vec), None)
    mid = mean if centre else [0.0] * len(mean)
    scale = [s if s else 1.0 for s in std] if spread else [1.0] * len(mean)
    values, vectors = top_directions(df, min(k, len(mean)), mid, scale, vec)
    return project(df, _fixed_sign(vectors), vec, centre=mid, spread=scale), np.sqrt(np.maximum(values, 0.0))


def table_report(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows, dimensions and megabytes of a feature table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.size(vec)).alias("min_dim"),
                  F.max(F.size(vec)).alias("max_dim"),
                  (F.sum(F.size(vec)) * 8 / 1e6).alias("megabytes"))
