"""Clustering, classification and committees on feature vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.functions.vectors import normalised
from latticeloom.operators.linear import gram_matrix, project, standardise
from latticeloom.operators.neighborsums import NeighbourWeights
from latticeloom.session import cut_lineage, stored


def _with_vector(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec)))


def cluster(df: DataFrame, method: str = "kmeans", vec: str = "vec", mode: str = "mean-variance",
            estimator: Estimator | None = None, **params) -> DataFrame:
    """Add ``cluster`` (and ``cluster_probs`` for a mixture) to each row.

    ``estimator`` may be any clustering estimator that reads ``features``.
    """
    from pyspark.ml.clustering import GaussianMixture, KMeans

    ready = _with_vector(standardise(df, mode, vec, "_std"), "_std")
    if estimator is None:
        if method == "kmeans":
            estimator = KMeans(**{"k": 8, "seed": 42, **params})
        elif method == "gaussian_mixture":
            estimator = GaussianMixture(**{"k": 2, "seed": 42, **params})
        else:
            raise NotImplementedError(f"clustering {method!r}; use dbscan or spectral_clusters")
    estimator.setPredictionCol("cluster")
    out = estimator.fit(ready).transform(ready)
    if "probability" in out.columns:
        out = out.withColumn("cluster_probs", vector_to_array("probability")).drop("probability")
    return out.drop("features", "_std")


# --- density clustering ------------------------------------------------------

def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` with the smallest id of each component.

    Alternates large-star and small-star steps, which converge in a logarithmic
    number of rounds. Neighbourhood minima are partial aggregates, so a hub is not
    collected anywhere.
    """
    edges = cut_lineage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                            .alias("_e")).select("_e.a", "_e.b")
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(low, "a")
        moved = linked.where(F.col("b") > F.col("a")) if large else linked
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def told(e: DataFrame) -> tuple:
        # number and two sums of hashes of the edges: equal when the edges are
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())

    last = None
    for _ in range(max_rounds):
        edges = cut_lineage(star(star(edges, True), False))
        now = told(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 50, key: str = "id",
           dims: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Density clusters of points in few dimensions: ``(key, cluster, is_core)``, noise -1.

    Cells have diagonal ``eps``, so the points of one cell are all neighbours: a cell
    with ``min_samples`` points needs no pair test to know that all are core, and a
    cell is one vertex of the cluster graph. Coincident points travel as one weighted
    point. A border point joins the core with the smallest id in reach; a cluster is
    named by its smallest core id.
    """
    d = len(dims)
    edge = eps / d ** 0.5 * (1 - 1e-12)
    reach = int(d ** 0.5) + 1
    cells = [f"_c{i}" for i in range(d)]
    places = df.groupBy(*dims).agg(F.min(key).alias("pid"), F.count(F.lit(1)).alias("w"))
    places = cut_lineage(places.select("*", *[F.floor(F.col(c) / edge).alias(k) for c, k in zip(dims, cells)]))
    crowd = cut_lineage(places.groupBy(*cells).agg(F.sum("w").alias("cell_w"), F.count(F.lit(1)).alias("cell_n"), F.min("pid").alias("cell")))

    steps = F.sequence(F.lit(-reach), F.lit(reach))
    offsets = F.transform(steps, lambda i: F.array(i))
    for _ in range(d - 1):
        offsets = F.flatten(F.transform(offsets, lambda o: F.transform(steps, lambda s: F.concat(o, F.array(s)))))
    # cells whose nearest corner is out of reach are skipped
    beyond = lambda s: F.greatest(F.abs(s) - 1, F.lit(0))
    gap = lambda o: F.aggregate(o, F.lit(0), lambda acc, s: acc + beyond(s) * beyond(s))
    offsets = F.filter(offsets, lambda o: gap(o) <= d)

    def around_cells(points: DataFrame) -> DataFrame:
        return points.withColumn("_o", F.explode(offsets)).select(
            *[c for c in points.columns if c not in cells],
            *[(F.col(c) + F.col("_o")[i]).alias(c) for i, c in enumerate(cells)])

    def near(a: str, b: str):
        total = None
        for c in dims:
            t = (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))
            total = t if total is None else total + t
        return F.sqrt(total) <= eps

    # a point of a sparse cell reads the points of cells with few points, and the counted boxes of the others
    placed = places.join(crowd, cells)
    packed = F.col("cell_n") > DENSE_CELL
    looks = around_cells(placed.where(F.col("cell_w") < min_samples).select("pid", *dims, *cells))
    counted = (looks.alias("a").join(placed.where(~packed).select("pid", "w", *dims, *cells).alias("b"), cells).where(near("a", "b"))
               .groupBy(F.col("a.pid").alias("pid")).agg(F.sum("b.w").alias("deg")))
    if not crowd.where(packed).isEmpty():
        boxes = Boxes(placed.where(packed).select("cell", "pid", "w", *dims), dims, edge)
        pairs = looks.join(crowd.where(packed).select("cell", *cells), cells).select("pid", *dims, "cell")
        within = boxes.within(pairs, eps, min_samples, counted)
        counted = (counted.unionByName(within.select("pid", F.col("n").alias("deg"))).groupBy("pid").agg(F.sum("deg").alias("deg")))
    core = cut_lineage(placed.join(counted, "pid", "left").withColumn(
        "is_core", (F.col("cell_w") >= min_samples) | (F.col("deg") >= min_samples)).na.fill(False, ["is_core"]))
    cores = core.where("is_core").select("pid", *dims, *cells)
    heads = cut_lineage(cores.groupBy(*cells).agg(F.min("pid").alias("head"), F.count(F.lit(1)).alias("n")))
    inside = cores.join(heads, cells)
    linked = _linked_cells(inside, heads, dims, cells, edge, eps, around_cells, near)
    comps = connected_components(linked).withColumnsRenamed({"id": "head"})
    cell_cluster = cut_lineage(heads.join(comps, "head", "left").select(*cells, "head", "n", F.coalesce("component", "head").alias("cluster")))
    core_cluster = cores.join(cell_cluster, cells)
    border = around_cells(core.where(~F.col("is_core")).select("pid", *dims, *cells))
    few = core_cluster.where(F.col("n") <= DENSE_CELL)
    joined = (border.alias("a").join(few.alias("b"), cells).where(near("a", "b"))
              .select(F.col("a.pid").alias("pid"), F.struct(F.col("b.pid").alias("low"), F.col("b.cluster").alias("cluster")).alias("best")))
    many = cell_cluster.where(F.col("n") > DENSE_CELL)
    if not many.isEmpty():
        boxes = Boxes(core_cluster.where(F.col("n") > DENSE_CELL).select(F.col("head").alias("cell"), "pid", F.lit(1).alias("w"), *dims), dims, edge)
        pairs = border.join(many.select(F.col("head").alias("cell"), *cells), cells).select("pid", *dims, "cell")
        found = boxes.within(pairs, eps).join(many.select(F.col("head").alias("cell"), "cluster"), "cell")
        joined = joined.unionByName(found.select("pid", F.struct("low", "cluster").alias("best")))
    joined = joined.groupBy("pid").agg(F.min("best").alias("best")).select("pid", F.col("best.cluster").alias("cluster"))
    named = core_cluster.select("pid", "cluster", F.lit(True).alias("is_core")).union(joined.select("pid", "cluster", F.lit(False)))
    at = core.select(*dims, "pid").join(named, "pid", "left")
    return df.join(at, list(dims)).select(
        F.col(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


DENSE_CELL = 64       # points; denser cells are never read point by point from outside


class Boxes:
    """Counted bounding boxes of the points of dense cells, halved level by level.

    ``points`` are ``(cell, pid, w, *dims)``. A box has the number of its points, their smallest id, and the ends of its points
    along each axis, so a box of one position has no extent and every question about it is decided.
    """

    def __init__(self, points: DataFrame, dims: Sequence[str], edge: float):
        self.points, self.dims, self.edge = cut_lineage(points), list(dims), edge

    def level(self, level: int, prefix: str = "") -> DataFrame:
        size = self.edge / 2 ** level
        index = [F.floor(F.col(c) / size).alias(f"{prefix}k{i}") for i, c in enumerate(self.dims)]
        return self.points.groupBy(F.col("cell").alias(f"{prefix}cell"), *index).agg(
            F.sum("w").alias(f"{prefix}n"), F.min("pid").alias(f"{prefix}low"),
            *[f(c).alias(f"{prefix}{n}{i}") for i, c in enumerate(self.dims) for n, f in (("lo", F.min), ("hi", F.max))])

    def within(self, pairs: DataFrame, eps: float, stop: int | None = None, known: DataFrame | None = None) -> DataFrame:
        """``(pid, cell, n, low)``: how many points of a cell lie within ``eps`` of a point, and their smallest id.

        ``pairs`` are ``(pid, *dims, cell)``. Boxes wholly within reach are counted, boxes out of reach are dropped, the others
        are halved. With ``stop``, a point that has found so many, ``known`` ones ``(pid, deg)`` included, looks no further.
        """
        d = len(self.dims)
        gap = lambda i: F.greatest(F.col(f"lo{i}") - F.col(self.dims[i]), F.col(self.dims[i]) - F.col(f"hi{i}"), F.lit(0.0))
        span = lambda i: F.greatest(F.abs(F.col(f"lo{i}") - F.col(self.dims[i])), F.abs(F.col(f"hi{i}") - F.col(self.dims[i])))
        length = lambda part: F.sqrt(sum((part(i) * part(i) for i in range(1, d)), part(0) * part(0)))
        keep = ["pid", *self.dims, "cell"]
        active, found, level = pairs.select(*keep), None, 0
        while True:
            box = self.level(level)
            if level == 0:
                met = active.join(box, "cell")
            else:
                up = [F.floor(F.col(f"k{i}") / 2).alias(f"p{i}") for i in range(d)]
                met = active.join(box.select("*", *up), ["cell", *[f"p{i}" for i in range(d)]])
            met = cut_lineage(met.select(*keep, *[f"k{i}" for i in range(d)], "n", "low", length(span).alias("far"), length(gap).alias("close"))
                              .where(F.col("close") <= eps))
            whole = met.where(F.col("far") <= eps).groupBy("pid", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
            found = whole if found is None else found.unionByName(whole)
            left = met.where(F.col("far") > eps)
            if stop is not None:
                so_far = found.select("pid", "n") if known is None else found.select("pid", "n").unionByName(known.toDF("pid", "n"))
                enough = so_far.groupBy("pid").agg(F.sum("n").alias("n")).where(F.col("n") >= stop)
                left = left.join(enough, "pid", "left_anti")
            active = cut_lineage(left.select(*keep, *[F.col(f"k{i}").alias(f"p{i}") for i in range(d)]))
            if active.isEmpty():
                return found.groupBy("pid", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
            level += 1


def _linked_cells(inside: DataFrame, heads: DataFrame, dims: Sequence[str], cells: Sequence[str], edge: float,
                  eps: float, around_cells, near) -> DataFrame:
    """Pairs of cells ``(a, b)`` (by head) with core points within ``eps`` of each other; ``inside`` are core points with ``head, n``.

    Cells with few points are compared point by point, the points of one with the boxes of a dense one. Two
    dense cells are compared by the bounding boxes of ever smaller parts: parts
    entirely within reach link the cells, parts out of reach are dropped, the rest is
    split further. Dense neighbours link after one or two rounds.
    """
    meet = (around_cells(heads.select("head", "n", *cells)).alias("a").join(heads.alias("b"), list(cells))
            .where(F.col("a.head") < F.col("b.head"))
            .select(F.col("a.head").alias("a"), F.col("b.head").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")))
    meet = cut_lineage(meet)
    at = inside.select("head", "n", "pid", *dims)
    few = at.where(F.col("n") <= DENSE_CELL)
    light = (meet.where((F.col("na") <= DENSE_CELL) & (F.col("nb") <= DENSE_CELL)).alias("m")
             .join(few.alias("a"), F.col("m.a") == F.col("a.head"))
             .join(few.alias("b"), F.col("m.b") == F.col("b.head")).where(near("a", "b"))
             .select("m.a", "m.b").distinct())
    heavy = meet.where(F.greatest("na", "nb") > DENSE_CELL)
    if heavy.isEmpty():
        return light
    packed = Boxes(at.where(F.col("n") > DENSE_CELL).select(F.col("head").alias("cell"), "pid", F.lit(1).alias("w"), *dims), dims, edge)
    sides = [F.when(F.col("na") <= F.col("nb"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "head"), ("b", "a", "cell"))]
    one = few.join(heavy.where(F.least("na", "nb") <= DENSE_CELL).select(*sides), "head")
    mixed = (packed.within(one.select("pid", *dims, "cell"), eps).join(one.select("pid", "cell", "head"), ["pid", "cell"])
             .select(F.least("head", "cell").alias("a"), F.greatest("head", "cell").alias("b")).distinct())
    dense = heavy.where(F.least("na", "nb") > DENSE_CELL).select("a", "b")
    linked = [light, mixed]

    def spread(far: bool):
        total = F.lit(0.0)
        for i in range(len(dims)):
            ab, ba = F.col(f"bhi{i}") - F.col(f"alo{i}"), F.col(f"ahi{i}") - F.col(f"blo{i}")
            gap = F.greatest(ab, ba) if far else F.greatest(-ab, -ba, F.lit(0.0))
            total = total + gap * gap
        return F.sqrt(total)

    keys = [f"{s}k{i}" for s in "ab" for i in range(len(dims))]
    active, level = cut_lineage(dense), 0
    while not active.isEmpty():
        met = active
        for side in "ab":
            part = packed.level(level, side).withColumnRenamed(f"{side}cell", side)
            if level == 0:
                met = met.join(part, side)
            else:
                up = [F.floor(F.col(f"{side}k{i}") / 2).alias(f"{side}p{i}") for i in range(len(dims))]
                met = met.join(part.select("*", *up), [side, *[f"{side}p{i}" for i in range(len(dims))]])
        met = cut_lineage(met.select("a", "b", *keys, spread(True).alias("far"), spread(False).alias("close")))
        done = met.where(F.col("far") <= eps).select("a", "b").distinct()
        linked.append(done)
        left = met.where((F.col("far") > eps) & (F.col("close") <= eps)).join(done, ["a", "b"], "left_anti")
        active = cut_lineage(left.select("a", "b", *[F.col(f"{s}k{i}").alias(f"{s}p{i}") for s in "ab" for i in range(len(dims))]))
        level += 1
    out = linked[0]
    for part in linked[1:]:
        out = out.union(part)
    return out.distinct()


def _times(edges: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``(id, y array)``: the product of a sparse symmetric matrix ``(src, dst, weight)`` with the rows ``(id, x array)``."""
    met = edges.join(rows.select(F.col("id").alias("dst"), "x"), "dst")
    return met.groupBy(F.col("src").alias("id")).agg(F.array(*[F.sum(F.col("weight") * F.col("x")[j]) for j in range(width)]).alias("y"))


def _normalised_times(weights: NeighbourWeights, root: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``_times`` for (I + D^-1/2 W D^-1/2) / 2 with W never stored; ``root`` has the square roots ``s`` of the degrees."""
    held = rows.select("id", "x").join(root, "id")
    sums = weights.sums(held.select("id", F.transform("x", lambda v: v / F.col("s")).alias("x")), width)
    return sums.join(held, "id").select("id", F.zip_with("y", "x", lambda y, x: (y / F.col("s") + x) / 2).alias("y"))


def spectral_embedding(affinity: DataFrame | NeighbourWeights, k: int, extra: int = 4, powers: int = 4, tolerance: float = 1e-6, rounds: int = 40,
                       seed: int = 42) -> tuple[DataFrame, list[float]]:
    """``(id, vec)``: the ``k`` leading eigenvectors of (I + D^-1/2 W D^-1/2) / 2, and their eigenvalues, for a symmetric table
    ``(src, dst, weight)`` of W, or for weights by distance, whose pairs are formed anew for each product.

    A block of k + ``extra`` columns is multiplied ``powers`` times; the best directions within all these products come from
    their matrix of inner products, which is small, and start the next round, until the eigenvalues settle: by their change or, a
    round earlier or more, by the residuals, which follow from the same inner products. Each
    multiplication is a join of the edges with one row per point, or a product of blocks of points, so no task holds a column.
    """
    if isinstance(affinity, NeighbourWeights):
        root = cut_lineage(affinity.degrees.select("id", F.sqrt("d").alias("s")))
        return _krylov(partial(_normalised_times, affinity, root), root, k, extra, powers, tolerance, rounds, seed)
    degree = affinity.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"))
    root = cut_lineage(degree.select("id", F.sqrt("d").alias("s")))
    left, right = root.toDF("src", "_a"), root.toDF("dst", "_b")
    edges = affinity.join(left, "src").join(right, "dst").select("src", "dst", (F.col("weight") / F.col("_a") / F.col("_b") / 2).alias("weight"))
    halves = root.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.5).alias("weight"))
    edges = cut_lineage(edges.unionByName(halves).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    return _krylov(partial(_times, edges), root, k, extra, powers, tolerance, rounds, seed)


def _krylov(times: Callable[[DataFrame, int], DataFrame], root: DataFrame, k: int, extra: int, powers: int, tolerance: float, rounds: int,
            seed: int) -> tuple[DataFrame, list[float]]:
    """The iteration of ``spectral_embedding`` for the matrix that ``times`` multiplies with."""
    wide = min(k + extra, root.count())
    uniform = lambda j: F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(j)), 11) / F.lit(float(2 ** 53)) - 0.5
    # the first column is the known leading direction
    block = root.select("id", F.array("s", *[uniform(j) for j in range(1, wide)]).alias("x"))
    last, values_so_far = None, np.zeros(wide)
    for _ in range(rounds):
        whole, newest = block.select("id", F.col("x").alias("all")), block
        for power in range(powers):
            step = times(newest, wide)
            if power == 0 and values_so_far.any():
                # what is left to improve; next to the vectors themselves it would be lost to rounding in their inner products
                step = step.join(newest, "id").select("id", F.zip_with("y", F.zip_with("x", F.array(*map(F.lit, values_so_far.tolist())), lambda x, v: x * v),
                                                                       lambda y, x: y - x).alias("y"))
            step = stored(step, "product")
            whole = whole.join(step, "id").select("id", F.concat("all", "y").alias("all"))
            newest = step.select("id", F.col("y").alias("x"))
        whole = cut_lineage(whole)
        _, gram = gram_matrix(whole, "all", wide * (powers + 1))
        shift = np.eye(wide * (powers + 1), wide * powers, -wide)   # the image of each column but the last ones
        shift[:wide, :wide] += np.diag(values_so_far)
        own, image = gram[:-wide, :-wide], gram[:-wide] @ shift
        size = np.sqrt(np.maximum(np.diag(own), 1e-300))
        values, vectors = np.linalg.eigh(own / np.outer(size, size))
        good = values > 1e-10 * values[-1]
        white = vectors[:, good] / np.sqrt(values[good]) / size[:, None]
        small = white.T @ image @ white
        found, turned = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(found)[::-1][:wide]
        basis = np.zeros((wide * (powers + 1), len(top)))
        basis[:-wide] = white @ turned[:, top]
        block = cut_lineage(project(whole, basis, "all", "x").select("id", "x"))
        wide, now, values_so_far = len(top), found[top][:k], found[top]
        settled = tolerance * (1.0 + 1e-12 - now + tolerance)
        if last is not None and len(now) == len(last) and np.all(np.abs(now - last) <= settled):
            break
        if wide > len(now) and _eigenvalue_error(gram, shift @ basis[:len(shift.T)] - basis * found[top], found[top], len(now)) <= settled.min():
            break
        last = now
    return block.select("id", F.slice("x", 1, k).alias("vec")), [float(v) for v in now]


def _eigenvalue_error(gram: np.ndarray, residuals: np.ndarray, values: np.ndarray, k: int) -> float:
    """A bound for the errors of the ``k`` leading of some approximate eigenvalues: the squares of their residuals, which are given as
    columns by the basis that has ``gram``, over the gap to the values behind. All k count, as equal values share their vectors."""
    gap = values[k - 1] - values[k]
    return max(float(np.einsum("ij,ik,kj->", residuals[:, :k], gram, residuals[:, :k])), 0.0) / gap if gap > 0 else np.inf


def spectral_clusters(affinity: DataFrame | NeighbourWeights, k: int = 8, points: DataFrame | None = None, seed: int = 42, **options) -> DataFrame:
    """Clusters of a sparse affinity table ``(src, dst, weight)``, each pair once or in both directions: ``(id, cluster)``.
    Dense neighbourhoods are given as ``NeighbourWeights``, whose pairs are never stored.

    Points are placed by the ``k`` leading eigenvectors of the normalised affinity, brought to length one, and grouped by k-means.
    Only ids of the table can be placed. With ``points``, a table with a column ``id``, each of its rows is kept; the
    cluster of a point without affinity to another is null.
    """
    from pyspark.ml.clustering import KMeans

    if isinstance(affinity, NeighbourWeights):
        both, met = affinity, affinity.degrees
    else:
        one = affinity.where(F.col("src") != F.col("dst")).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
            F.max("weight").alias("weight")).where("weight > 0")
        both = cut_lineage(one.select(F.explode(F.array(F.struct("src", "dst", "weight"), F.struct(
            F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))).alias("e")).select("e.*"))
        met = both
    placed = None
    if not met.isEmpty():
        spots, _ = spectral_embedding(both, k, seed=seed, **options)
        spots = spots.withColumn("vec", normalised(F.col("vec")))
        model = KMeans(k=k, seed=seed, initSteps=5, predictionCol="cluster").fit(cut_lineage(_with_vector(spots, "vec")))
        placed = model.transform(_with_vector(spots, "vec")).select("id", "cluster")
    if points is None:
        return placed if placed is not None else met.toDF("id", *met.columns[1:]).select("id", F.lit(None).cast("int").alias("cluster")).limit(0)
    if placed is None:
        return points.select("id", F.lit(None).cast("int").alias("cluster"))
    return points.select("id").join(placed, "id", "left")


# --- classification ----------------------------------------------------------

def check_same_classes(train: DataFrame, validation: DataFrame, label: str = "label") -> int:
    a = train.select(F.count_distinct(label)).first()[0]
    b = validation.select(F.count_distinct(label)).first()[0]
    if a != b:
        raise ValueError(f"training has {a} classes, validation {b}")
    return a


def perceptron(layers: Sequence[int], label: str = "label", max_iter: int = 100, seed: int = 42,
               **params) -> Pipeline:
    """Default model factory: one multilayer perceptron."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return Pipeline(stages=[MultilayerPerceptronClassifier(
        layers=list(layers), labelCol=label, featuresCol="features", maxIter=max_iter, seed=seed, **params)])


def train_classifier(train: DataFrame, validation: DataFrame, hidden: Sequence[Sequence[int]],
                     label: str = "label", vec: str = "vec", factory: Callable[..., Pipeline] = perceptron,
                     **params):
    """Fit one model per layout of hidden layers; the best on the validation rows wins.

    Returns (model, validation accuracy, layout).
    """
    classes = check_same_classes(train, validation, label)
    dim = train.select(F.max(F.size(vec))).first()[0]
    ready, held = cut_lineage(_with_vector(train, vec)), cut_lineage(_with_vector(validation, vec))
    best = None
    for layout in hidden:
        model = factory([dim, *layout, classes], label=label, **params).fit(ready)
        ok = model.transform(held).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        if best is None or ok > best[1]:
            best = (model, ok, tuple(layout))
    return best


def score(df: DataFrame, model, vec: str = "vec") -> DataFrame:
    """Add ``probs`` and ``target_pred_class``."""
    out = model.transform(_with_vector(df, vec))
    return (out.withColumn("probs", vector_to_array("probability"))
            .withColumn("target_pred_class", F.col("prediction").cast("int"))
            .drop("features", "rawPrediction", "probability", "prediction"))


def poisson_steps(mean: float = 1.0) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... events, as far as they differ from 1 in double precision."""
    steps, term, total = [], math.exp(-mean), 0.0
    while total + term < 1.0 and total + term > total:
        total += term
        steps.append(total)
        term *= mean / len(steps)
    return steps


def train_committee(train: DataFrame, members: int, hidden: Sequence[int], n_classes: int,
                    label: str = "label", vec: str = "vec", key: str = "id", seed: int = 42,
                    factory: Callable[..., Pipeline] = perceptron, **params) -> list:
    """Models fitted to bootstrap resamples.

    A row's multiplicity in a resample is a Poisson(1) draw from a hash of its key,
    so a lost task draws the same rows again.
    """
    dim = train.select(F.max(F.size(vec))).first()[0]
    ready = cut_lineage(_with_vector(train, vec))
    models = []
    for t in range(members):
        u = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed), F.lit(t)), 11) / F.lit(float(2 ** 53))
        copies = sum((F.when(u >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))
        drawn = ready.withColumn("_k", copies).where("_k > 0").withColumn(
            "_k", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")
        models.append(factory([dim, *hidden, n_classes], label=label, seed=seed + t, **params).fit(drawn))
    return models


def committee_samples(df: DataFrame, models: Sequence, vec: str = "vec", key: str = "id") -> DataFrame:
    """One probability vector per row and model: ``(key, sample, probs)``."""
    rows, kept = _with_vector(df.select(key, vec), vec), []
    for t, model in enumerate(models):              # all models score a row in one pass
        rows = model.transform(rows).select(key, "features", *kept, vector_to_array("probability").alias(f"_p{t}"))
        kept.append(f"_p{t}")
    each = F.array(*[F.struct(F.lit(t).alias("sample"), F.col(p).alias("probs")) for t, p in enumerate(kept)])
    return rows.select(key, F.explode(each).alias("_s")).select(key, "_s.sample", "_s.probs")


def class_names(df: DataFrame, classes: DataFrame, on: str = "class_id") -> DataFrame:
    return lookup_join(df, classes, on, "left")
