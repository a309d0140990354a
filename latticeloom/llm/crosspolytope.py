"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Vectors of unit length, filled up with zeros to a power of two, are rotated by three rounds of random signs and Hadamard
transforms; the hash is the coordinate of largest size together with its sign. A table's key joins ``HASHES`` such values.
Every vector is filed under its key in each of ``TABLES`` tables and looked up under the ``PROBES`` likeliest keys, which swap
the largest coordinates for the next ones in the order of what that costs. A pair is found if either finds the other. At
the cosine 0.93 in 64 dimensions a table finds a pair with probability 0.8 or so, ten tables miss one in millions.

Found pairs are compared first by 128 projection signs (allowing 7 standard deviations over the expected difference at the
threshold), in the join itself, so what leaves it are almost only true pairs; then by their exact cosine.

Equal vectors of one label are one node with a count, so copies make no pairs; what counts links adds the counts up.
``HASHES`` = 2 gives (2 d)^2 cells a label and table; larger tables want one more.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component, and vectors with a null label,
link with nothing. Only vectors of one length are compared. Repeated rows are copies and link with each other. A null id
counts as a vector but names no component while there is another. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeloom.llm.vectors import usable
from latticeloom.operators.ml import connected_components
from latticeloom.session import cut_lineage

TABLES = 10
HASHES = 2
PROBES = 6
SIGNS = 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; their length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


@cache
def _random_signs(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([29, number, dim]).choice([-1.0, 1.0], size=(3, dim))


def rotated(unit: np.ndarray, number: int) -> np.ndarray:
    """The rows under pseudo-random rotation ``number``."""
    dim = 1 << max(unit.shape[1] - 1, 1).bit_length()
    x = np.pad(unit, ((0, 0), (0, dim - unit.shape[1])))
    for signs in _random_signs(number, dim):
        x = hadamard(x * signs)
    return x


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def keys(unit: np.ndarray, table: int, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """[row, probe]: the keys of a table, likeliest first; the first one is the key a row is filed under."""
    best = np.zeros((len(unit), 1), dtype=np.int64)
    cost = np.zeros((len(unit), 1))
    for h in range(hashes):
        x = rotated(unit, 1 + table * hashes + h)
        vertices = np.concatenate([x, -x], axis=1)
        top = np.argsort(-vertices, axis=1, kind="stable")[:, :probes]
        near = np.take_along_axis(vertices, top, axis=1)
        loss = (near[:, :1] - near) ** 2
        best = (best[:, :, None] * vertices.shape[1] + top[:, None, :]).reshape(len(unit), -1)
        cost = (cost[:, :, None] + loss[:, None, :]).reshape(len(unit), -1)
        keep = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        best, cost = np.take_along_axis(best, keep, axis=1), np.take_along_axis(cost, keep, axis=1)
    return best * 64 + table


def sign_bits(unit: np.ndarray, signs: int = SIGNS) -> np.ndarray:
    """``signs`` projection signs of each row, as 64-bit words."""
    planes = np.random.default_rng([31, unit.shape[1]]).normal(size=(unit.shape[1], signs))
    return np.packbits(unit @ planes > 0, axis=1, bitorder="little").view("<i8")


def most_differing_signs(cosine: float, signs: int = SIGNS) -> int:
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(np.ceil(signs * p + 7 * np.sqrt(signs * p * (1 - p))))


def _by_length(vectors: pd.Series, func) -> list:
    """``func`` on the rows of each length; results in the order of the rows."""
    out: list = [None] * len(vectors)
    sizes = vectors.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for i, value in zip(at, func(unit_rows(np.stack(vectors.iloc[at].to_numpy()).astype(np.float64)))):
            out[i] = value
    return out


def similar_nodes(nodes: DataFrame, threshold: float, tables: int, hashes: int, probes: int) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ``nodes (node, label, dim, vec)`` with a cosine of ``threshold`` or more."""

    @F.pandas_udf("files array<long>, looks array<long>, signs array<long>")
    def hashed(vectors: pd.Series) -> pd.DataFrame:
        def func(unit):
            each = [keys(unit, t, hashes, probes) for t in range(tables)]
            return zip(np.stack([e[:, 0] for e in each], axis=1), np.concatenate(each, axis=1), sign_bits(unit))
        return pd.DataFrame(_by_length(vectors, func), columns=["files", "looks", "signs"])

    marked = cut_lineage(nodes.withColumn("h", hashed("vec")).select(
        "node", "label", "dim", "h.files", "h.looks", *[F.col("h.signs")[i].alias(f"s{i}") for i in range(SIGNS // 64)]))
    side = lambda name, keys_: marked.select(
        F.col("node").alias(name), "label", "dim", F.explode(keys_).alias("key"), *[F.col(f"s{i}").alias(f"{name}{i}") for i in range(SIGNS // 64)])
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SIGNS // 64)), F.lit(0))
    a, b = side("a", "files"), side("b", "looks")
    on = (a["key"] == b["key"]) & (a["label"] == b["label"]) & (a["dim"] == b["dim"]) & (F.col("a") != F.col("b"))
    found = (a.join(b, on & (differ <= most_differing_signs(threshold)))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    units = nodes.select("node", F.col("vec").alias("v"), "norm")
    both = (found.join(units.toDF("a", "va", "na"), "a").join(units.toDF("b", "vb", "nb"), "b"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.where(dot / (F.col("na") * F.col("nb")) >= threshold).select("a", "b")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                           label: str = "label", tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """One row per vector: ``(id, n_links, component_id, kept)``."""
    good = usable(F.col(vec_col)) & F.col(label).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"),
                          F.when(good, F.col(vec_col).cast("array<double>")).alias("vec"))
    size = F.aggregate("vec", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    # scaled by the largest component, so no square over- or underflows
    nodes = (rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
             .withColumn("original", F.col("vec")).withColumn("_m", size)
             .withColumn("vec", F.transform("vec", lambda x: x / F.col("_m"))).drop("_m")
             .withColumns({"norm": F.sqrt(length), "dim": F.size("vec"), "node": F.monotonically_increasing_id()}))
    nodes = cut_lineage(nodes)
    links = cut_lineage(similar_nodes(nodes, threshold, tables, hashes, probes))
    parts = connected_components(links)
    sizes = nodes.select("node", "n")
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
    degree = (ends.join(sizes.toDF("other", "m"), "other").groupBy("node").agg(F.sum("m").alias("others")))
    placed = (nodes.select("node", "label", F.col("original").alias("vec"), "least", "n").join(degree, "node", "left")
              .join(parts.withColumnRenamed("id", "node"), "node", "left")
              .withColumn("root", F.coalesce("component", "node")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    told = placed.join(least, "root").select(
        "label", "vec", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.where("vec IS NOT NULL").join(told, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                   F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
