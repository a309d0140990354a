"""Whole analyses: descriptor jobs, global and local classification."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.operators import boxes as B
from latticeloom.operators import boxpairs as P
from latticeloom.operators.fields import (
    added_sums, average_spectrum, environment_spectrum, neighbour_sums, spectrum_index, spectrum_of_sums)
from latticeloom.operators.filters import drop_rare_species, nan_if_thin
from latticeloom.operators.labels import default_labels
from latticeloom.operators.ml import committee_samples, score
from latticeloom.operators.neighbors import (
    nearest_distances, neighbour_pairs, scale_cell, scale_factors, scale_factors_of_nearest, scale_structure)
from latticeloom.operators.structures import apply_operations
from latticeloom.operators.uncertainty import committee_uncertainty
from latticeloom.session import cut_lineage

STRUCTURE = "structure_id"


# --- descriptors -------------------------------------------------------------

class Descriptor(Protocol):
    """What a user descriptor offers; register it with ``register_descriptor``."""

    name: str
    params: Mapping

    def calculate(self, atoms: DataFrame, structures: DataFrame) -> DataFrame:
        """``(structure_id, value array<double>)``"""


DESCRIPTORS: dict[str, Callable[..., Descriptor]] = {}


def register_descriptor(name: str, maker: Callable[..., Descriptor]) -> None:
    DESCRIPTORS[name] = maker


def make_descriptor(name: str, **params) -> Descriptor:
    if name not in DESCRIPTORS:
        raise KeyError(f"descriptor {name!r} is not one of {sorted(DESCRIPTORS)}")
    return DESCRIPTORS[name](**params)


class EnvironmentDescriptor:
    """Averaged power spectrum of local environments, after optional scaling.

    A structure without a length scale inside the limits has no descriptor.
    """

    name = "environment_spectrum"

    def __init__(self, cutoff: float = 4.0, n_max: int = 9, l_max: int = 6, scaling: str | None = "quantile_nn",
                 scaling_radii: Sequence[float] = (10.0, 20.0, 30.0), extrinsic: float = 1.0, min_atoms: int = 0,
                 periodic: bool = True, scale_limits: tuple[float, float] = (0.1, 1500.0)):
        self.params = {"cutoff": cutoff, "n_max": n_max, "l_max": l_max, "scaling": scaling,
                       "scaling_radii": tuple(scaling_radii), "extrinsic": extrinsic, "min_atoms": min_atoms,
                       "periodic": periodic, "scale_limits": scale_limits}
        self.length = len(spectrum_index(n_max, l_max))

    def __str__(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v}' for k, v in self.params.items())})"

    def calculate(self, atoms: DataFrame, structures: DataFrame) -> DataFrame:
        p = self.params
        if p["min_atoms"]:
            atoms = drop_rare_species(atoms, p["min_atoms"])
        cells = structures if p["periodic"] else None
        if p["scaling"]:
            factors = cut_lineage(scale_factors(atoms, p["scaling_radii"], p["scaling"], cells, *p["scale_limits"], p["extrinsic"]))
            atoms = scale_structure(atoms, factors)
            cells = scale_cell(structures, factors) if cells is not None else None
        pairs = neighbour_pairs(atoms, p["cutoff"], cells)
        return average_spectrum(environment_spectrum(pairs, p["cutoff"], p["n_max"], p["l_max"]), self.length).select(
            STRUCTURE, "value")


    def calculate_in_boxes(self, atoms: DataFrame, grid: DataFrame, box: Sequence[float], stride: Sequence[float],
                           source: str = "source") -> DataFrame:
        """``(structure_id, value)`` of every box as a structure without periodic images, neighbours searched once in the source."""
        p = self.params
        ranged = cut_lineage(P.with_box_range(atoms.select(source, "atom_id", "number", *B.AXES), grid, box, stride, source))
        kept = None
        if p["min_atoms"]:
            held = P.in_boxes(ranged.groupBy(STRUCTURE, "number", *P.ENDS).agg(F.count(F.lit(1)).alias("_n")))
            kept = cut_lineage(held.groupBy("box_id", "number").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= p["min_atoms"]).drop("_n"))
        length = [p["cutoff"], p["n_max"], p["l_max"]]
        if not p["scaling"] and kept is None:
            # pairs that meet in the same boxes are summed before they are handed out
            sums = neighbour_sums(P.ranged_pairs(ranged, ranged, p["cutoff"]), *length, [STRUCTURE, "atom_id", *P.ENDS])
            sums = added_sums(P.in_boxes(sums), p["n_max"], p["l_max"], ["box_id", "atom_id"])
            spectra = spectrum_of_sums(sums, p["n_max"], p["l_max"], ["box_id", "atom_id"])
        else:
            reach, factors = p["cutoff"], None
            if p["scaling"]:
                factors = cut_lineage(scale_factors_of_nearest(
                    self._nearest(ranged, kept), p["scaling_radii"], p["scaling"], *p["scale_limits"], p["extrinsic"])
                    .withColumnRenamed(STRUCTURE, "box_id"))
                reach *= factors.agg(F.max("scale_factor")).first()[0] or 0.0
            if not reach:
                return ranged.limit(0).select(STRUCTURE, F.array().cast("array<double>").alias("value"))
            if factors is None:
                pairs = P.in_boxes(P.ranged_pairs(ranged, ranged, reach).drop("other_id"))
            else:
                pairs = P.pairs_by_reach(ranged, factors.select("box_id", (F.lit(p["cutoff"]) * F.col("scale_factor")).alias("reach")))
            if kept is not None:
                pairs = (pairs.join(kept, ["box_id", "number"], "left_semi")
                         .join(kept.withColumnRenamed("number", "other_number"), ["box_id", "other_number"], "left_semi"))
            if factors is not None:
                pairs = lookup_join(pairs, factors, "box_id").select(
                    "box_id", "atom_id", *[(F.col(c) / F.col("scale_factor")).alias(c) for c in ("dx", "dy", "dz", "r")])
            sums = neighbour_sums(pairs, *length, ["box_id", "atom_id"])
            spectra = spectrum_of_sums(sums, p["n_max"], p["l_max"], ["box_id", "atom_id"])
        return average_spectrum(spectra.withColumnRenamed("box_id", STRUCTURE), self.length).select(STRUCTURE, "value")

    def _nearest(self, ranged: DataFrame, kept: DataFrame | None) -> DataFrame:
        """Nearest distances in each box, among the species that the box keeps."""
        radius = max(self.params["scaling_radii"])
        if kept is None:
            return P.nearest_in_boxes(ranged, radius).withColumnRenamed("box_id", STRUCTURE)
        boxed = P.in_boxes(ranged).join(kept, ["box_id", "number"], "left_semi").drop(STRUCTURE)
        return nearest_distances(boxed.withColumnRenamed("box_id", STRUCTURE), radius)


register_descriptor("environment_spectrum", EnvironmentDescriptor)


def descriptor_table(descriptor: Descriptor, atoms: DataFrame, structures: DataFrame) -> DataFrame:
    """Descriptor of every structure; a structure without one gets NaNs."""
    values = descriptor.calculate(atoms, structures)
    length = getattr(descriptor, "length", None)
    empty = F.array_repeat(F.lit(float("nan")), length) if length else F.lit(None).cast("array<double>")
    return structures.select(STRUCTURE, *[c for c in ("label", "target", "op_id") if c in structures.columns]).join(
        values, STRUCTURE, "left").select(
        "*", F.lit(descriptor.name).alias("descriptor_name"), F.lit(str(descriptor)).alias("descriptor_info")
    ).withColumn("value", F.coalesce("value", empty))


def descriptor_job(descriptor: Descriptor, atoms: DataFrame, structures: DataFrame,
                   targets: DataFrame | None = None,
                   operations: Sequence[tuple[str, Callable, Mapping]] = ()) -> DataFrame:
    """Operations, labels, targets, descriptor for a whole collection in one plan.

    Every structure meets its target by ``structure_id``; several operations make
    ``structure_id`` unique by appending the operation.
    """
    if operations:
        atoms, structures = apply_operations((atoms, structures), operations)
    if targets is not None:
        structures = structures.join(targets, STRUCTURE, "left")
    if operations:
        renamed = F.concat_ws("#", STRUCTURE, "op_id")
        atoms, structures = (t.withColumn(STRUCTURE, renamed) for t in (atoms, structures))
    if "label" not in structures.columns:
        structures = structures.withColumn("label", F.lit(None).cast("string"))
    return descriptor_table(descriptor, atoms, default_labels(structures, "label", [STRUCTURE]))


# --- analyses ----------------------------------------------------------------

def _usable(vec: Column) -> Column:
    return ~F.exists(vec, lambda v: F.isnan(v))


def global_analysis(atoms: DataFrame, structures: DataFrame, descriptor: Descriptor, models: Sequence,
                    n_classes: int) -> DataFrame:
    """Class probabilities and uncertainty per structure."""
    table = descriptor_table(descriptor, atoms, structures).select(
        F.col(STRUCTURE).alias("id"), F.col("value").alias("vec"))
    return committee_uncertainty(committee_samples(table.where(_usable(F.col("vec"))), models), n_classes)


def box_descriptors(atoms: DataFrame, descriptor: Descriptor, box: Sequence[float], stride: Sequence[float],
                    padding_ratio: Sequence[float] = (1.0, 1.0, 1.0), min_atoms: int = 0,
                    source: str = "source") -> DataFrame:
    """Descriptor per box of large structures: ``(source, kz, iy, jx, n_atoms, value)``.

    All sources go through together. A descriptor that offers ``calculate_in_boxes`` searches neighbours once in the source
    and hands each pair to the boxes that hold both ends; others get each box as a structure of its own. Boxes with ``min_atoms`` or fewer atoms get NaNs and keep their place.
    """
    pads = B.axis_padding(atoms, box, padding_ratio, source)
    grid = cut_lineage(B.box_grid(atoms, box, stride, pads, source=source))
    members = B.assign_boxes(atoms, grid, box, stride, source)
    pops = B.box_populations(members, grid, source).withColumn(
        STRUCTURE, F.concat_ws("_", source, *B.BOX))
    if hasattr(descriptor, "calculate_in_boxes"):
        values = descriptor.calculate_in_boxes(atoms, grid, box, stride, source)
    else:
        values = descriptor.calculate(B.box_structures(members, source), pops.select(STRUCTURE))
    empty = F.array_repeat(F.lit(float("nan")), descriptor.length)
    return (pops.join(values, STRUCTURE, "left").withColumn("value", F.coalesce("value", empty))
            .withColumn("value", nan_if_thin(F.col("value"), F.col("n_atoms"), min_atoms)))


def local_analysis(atoms: DataFrame, descriptor: Descriptor, models: Sequence, n_classes: int,
                   box: Sequence[float] = (16.0, 16.0, 16.0), stride: Sequence[float] = (4.0, 4.0, 4.0),
                   padding_ratio: Sequence[float] = (1.0, 1.0, 1.0), min_atoms: int = 0,
                   source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Probability and uncertainty maps of large structures, in long form.

    Returns (one row per box and class, one row per box with the uncertainties);
    boxes without a descriptor have NULLs.
    """
    table = cut_lineage(box_descriptors(atoms, descriptor, box, stride, padding_ratio, min_atoms, source))
    samples = committee_samples(table.where(_usable(F.col("value"))).select(
        F.col(STRUCTURE).alias("id"), F.col("value").alias("vec")), models)
    scored = cut_lineage(committee_uncertainty(samples, n_classes))
    at = table.select(F.col(STRUCTURE).alias("id"), source, *B.BOX, "n_atoms").join(scored, "id", "left")
    missing = F.array_repeat(F.lit(None).cast("double"), n_classes)
    maps = B.classification_map(at.withColumn("mean_probs", F.coalesce("mean_probs", missing)), "mean_probs", n_classes, source)
    return maps, at.drop("mean_probs")


def simple_scores(atoms: DataFrame, structures: DataFrame, descriptor: Descriptor, model) -> DataFrame:
    """Descriptor and one model, without uncertainty."""
    return score(descriptor_table(descriptor, atoms, structures).withColumnRenamed("value", "vec"), model)


# --- user functions ----------------------------------------------------------

def per_item(df: DataFrame, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """Apply a Python function to every row; a failing row gets its message in
    ``error`` and NULLs, the others go on."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({**function(row), "error": None})
                except Exception as e:                       # noqa: BLE001 - reported per row
                    out.append({**dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            # plain objects, so that a column of integers may hold gaps
            yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)

    return df.mapInPandas(run, f"{schema}, error string")
