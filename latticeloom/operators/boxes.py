"""Overlapping spatial boxes over large structures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join, quantiles
from latticeloom.session import cut_lineage

AXES = ("x", "y", "z")
BOX = ("kz", "iy", "jx")          # box index along z, y, x
INDEX = {"x": "jx", "y": "iy", "z": "kz"}


def extents(atoms: DataFrame, source: str = "source") -> DataFrame:
    return atoms.groupBy(source).agg(*[f(a).alias(f"{n}_{a}") for a in AXES
                                       for n, f in (("lo", F.min), ("hi", F.max))])


def axis_padding(atoms: DataFrame, box: Sequence[float], padding_ratio: Sequence[float],
                 source: str = "source") -> DataFrame:
    """Padding ratio per axis: none where the structure is no thicker than the box."""
    e = extents(atoms, source)
    return e.select(source, *[
        F.when(F.col(f"hi_{a}") - F.col(f"lo_{a}") <= w, 0.0).otherwise(float(r)).alias(f"pad_{a}")
        for a, w, r in zip(AXES, box, padding_ratio)])


def axis_grid(lo: Column, hi: Column, width: Column, stride: float, pad: Column, adapt: bool = True) -> tuple[Column, Column]:
    """Start and number of the boxes along one axis from ``lo`` - ``pad`` to ``hi`` + ``pad``."""
    lo, hi = lo - pad, hi + pad
    n = F.floor((hi - lo) / stride) + 1
    if adapt:
        short = hi - (lo + (n - 1) * stride + width)
        n = n + F.when(short > 0, F.ceil(short / stride)).otherwise(0)
        over = lo + (n - 1) * stride + width - hi
        lo = lo - F.when(over > 0, over / 2).otherwise(0.0)
    return lo, n


def box_grid(atoms: DataFrame, box: Sequence[float], stride: Sequence[float],
             padding_ratio: Sequence[float] | DataFrame | None = None, adapt: bool = True,
             source: str = "source", ends: DataFrame | None = None) -> DataFrame:
    """One row per source: grid start ``start_a`` and number of boxes ``n_a`` per axis.

    With ``adapt`` boxes are added until the last one reaches the end, and half of
    what then sticks out is taken from the start. ``ends`` are known ``extents``.
    """
    grid = extents(atoms, source) if ends is None else ends
    if isinstance(padding_ratio, DataFrame):
        grid = grid.join(padding_ratio, source)
        pads = {a: F.col(f"pad_{a}") * float(w) for a, w in zip(AXES, box)}
    else:
        pads = {a: F.lit(float(r) * float(w))
                for a, r, w in zip(AXES, padding_ratio or (0.0, 0.0, 0.0), box)}
    out: list[Column] = [F.col(source)]
    for a, w, s in zip(AXES, map(float, box), map(float, stride)):
        start, n = axis_grid(F.col(f"lo_{a}"), F.col(f"hi_{a}"), F.lit(w), s, pads[a], adapt)
        out += [start.alias(f"start_{a}"), n.cast("int").alias(f"n_{a}")]
    return grid.select(*out)


def boxes_of(value: Column, start: Column, n: Column, width: float, stride: float) -> Column:
    """Indices of the boxes (closed at both ends) that hold ``value``."""
    first = F.ceil((value - width - start) / stride).cast("int") - 1
    last = F.floor((value - start) / stride).cast("int") + 1
    # one more candidate at each end, then the exact predicate: edges are rounding-safe
    holds = lambda j: ((j >= 0) & (j < n)
                       & (value >= start + j * stride) & (value <= start + j * stride + width))
    return F.filter(F.sequence(first, F.greatest(first, last)), holds)


def assign_boxes(atoms: DataFrame, grid: DataFrame, box: Sequence[float], stride: Sequence[float],
                 source: str = "source") -> DataFrame:
    """One row per (atom, box that holds it); boxes may overlap. The grid is read more
    than once: cut its lineage first when it comes straight from the atoms."""
    placed = lookup_join(atoms, grid, source)
    for a, w, s in zip(AXES, map(float, box), map(float, stride)):
        placed = placed.withColumn(
            INDEX[a], F.explode(boxes_of(F.col(a), F.col(f"start_{a}"), F.col(f"n_{a}"), w, s)))
    return placed.select(*atoms.columns, *BOX)


def all_boxes(grid: DataFrame, source: str = "source") -> DataFrame:
    out = grid
    for a in AXES:
        out = out.withColumn(INDEX[a], F.explode(F.sequence(F.lit(0), F.col(f"n_{a}") - 1)))
    return out.select(source, *BOX)


def box_populations(box_atoms: DataFrame, grid: DataFrame, source: str = "source") -> DataFrame:
    """Atoms per box, empty boxes included. Counts are formed before the shuffle."""
    counts = box_atoms.groupBy(source, *BOX).agg(F.count(F.lit(1)).alias("n_atoms"))
    return (all_boxes(grid, source).join(counts, [source, *BOX], "left")
            .withColumn("n_atoms", F.coalesce("n_atoms", F.lit(0))))


def populations(atoms: DataFrame, box: Sequence[float], stride: Sequence[float],
                padding_ratio: Sequence[float] | None = None, source: str = "source",
                ends: DataFrame | None = None) -> DataFrame:
    ends = cut_lineage(extents(atoms, source)) if ends is None else ends
    grid = box_grid(atoms, box, stride, padding_ratio, source=source, ends=ends)
    return box_populations(assign_boxes(atoms, grid, box, stride, source), grid, source)


def population_statistics(pops: DataFrame, source: str = "source") -> DataFrame:
    return pops.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_boxes"), F.count_if(F.col("n_atoms") == 0).alias("n_empty"),
        F.max("n_atoms").alias("max_atoms"), F.avg("n_atoms").alias("mean_atoms"),
        F.stddev_pop("n_atoms").alias("std_atoms"))


def population_quantiles(pops: DataFrame, probs: Sequence[float], source: str = "source") -> DataFrame:
    return quantiles(pops, "n_atoms", probs, [source])


def typical_population(pops: DataFrame, cutoff_percentile: float = 20.0,
                       source: str = "source") -> DataFrame:
    """Median population of the boxes above the cutoff percentile."""
    # boxes per population: a short table, whatever the number of boxes
    hist = cut_lineage(pops.groupBy(source, "n_atoms").agg(F.count(F.lit(1)).alias("n")))
    low = (quantiles(hist, "n_atoms", [cutoff_percentile / 100.0], [source], "n")
           .select(source, F.col("quantile").alias("_cut")))
    kept = lookup_join(hist, low, source).where(F.col("n_atoms") > F.col("_cut"))
    return quantiles(kept, "n_atoms", [0.5], [source], "n").select(source, F.col("quantile").alias("n_typical"))


def classification_map(scored: DataFrame, probs: str, n_classes: int, source: str = "source") -> DataFrame:
    """Long map: one row per box and class, with the box position."""
    return scored.select(source, *BOX, F.posexplode(F.slice(F.col(probs), 1, n_classes))
                         .alias("class_id", "p"))


def map_rows(long_map: DataFrame, source: str = "source", value: str = "p") -> DataFrame:
    """Dense form: one row of a class map per (source, class, z, y), values in x order.

    A row holds the boxes of one grid line only, so no row grows with the map.
    """
    line = F.transform(F.array_sort(F.collect_list(F.struct("jx", value))), lambda s: s[value])
    return (long_map.groupBy(source, "class_id", "kz", "iy").agg(line.alias("line"))
            .orderBy(source, "class_id", "kz", "iy"))


def box_structures(box_atoms: DataFrame, source: str = "source",
                   species: str | None = None) -> DataFrame:
    """Boxes as structures: ``structure_id`` is the box name; with ``species`` all
    atoms are taken as that one (element-agnostic boxes)."""
    named = box_atoms.withColumn("structure_id", F.concat_ws("_", source, *BOX))
    return named if species is None else named.withColumn("symbol", F.lit(species))

