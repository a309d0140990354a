"""Neighbours inside overlapping boxes, from one search in the whole structure.

The boxes of a grid that hold an atom are a cuboid of box indices, and so are those that hold both ends of a pair: the overlap of
two cuboids. So pairs are searched once in the source, not once in each of the boxes that overlap, and each pair is handed to the
boxes that hold both its ends. A pair across the boundary of a box is not in it: the rule is that both ends are.

What is summed over the neighbours of an atom is first summed over those that share a cuboid, of which an atom has a few, and
only these sums are copied to the boxes of the cuboid.

Tables here have ``structure_id`` for the source and ``box_id`` for the box, named as ``boxes.box_structures`` names it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.operators.boxes import AXES, BOX, INDEX
from latticeloom.operators.boxgrid import first_box, last_box
from latticeloom.operators.neighbors import (
    SHRINK, STRUCTURE, _apart, _depth, _KEYS, _length, centres_in_cells, targets_in_cells)
from latticeloom.session import cut_lineage

ENDS = [f"{e}_{a}" for a in AXES for e in "fl"]


def with_box_range(atoms: DataFrame, grid: DataFrame, box: Sequence[float], stride: Sequence[float], source: str = "source") -> DataFrame:
    """Atoms with the first and last box ``f_a, l_a`` along each axis; atoms in no box are left out."""
    placed = lookup_join(atoms, grid, source)
    for a, w, s in zip(AXES, map(float, box), map(float, stride)):
        at, start = F.col(a), F.col(f"start_{a}")
        placed = (placed.withColumn(f"f_{a}", first_box(at, start, F.lit(w), s))
                  .withColumn(f"l_{a}", last_box(at, start, F.col(f"n_{a}"), s)))
    kept = [F.col(c) for c in atoms.columns if c not in (source, STRUCTURE)]
    return placed.where(" AND ".join(f"f_{a} <= l_{a}" for a in AXES)).select(F.col(source).alias(STRUCTURE), *kept, *ENDS)


def box_count() -> Column:
    n = F.lit(1)
    for a in AXES:
        n = n * (F.col(f"l_{a}") - F.col(f"f_{a}") + 1)
    return n


def in_boxes(rows: DataFrame) -> DataFrame:
    """One row for each box of a row's cuboid, with ``box_id``."""
    keep = [c for c in rows.columns if c not in ENDS]
    for a in AXES:
        rows = rows.withColumn(INDEX[a], F.explode(F.sequence(F.col(f"f_{a}"), F.col(f"l_{a}"))))
    return rows.select(*keep, F.concat_ws("_", STRUCTURE, *BOX).alias("box_id"))


def ranged_pairs(centres: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Pairs within ``radius`` that some box holds, both directions, with the cuboid of these boxes."""
    joined = (centres_in_cells(centres, radius).alias("c").join(targets_in_cells(targets, radius).alias("t"), _KEYS)
              .where(F.col("c.atom_id") != F.col("t.atom_id")))
    ends = [(F.greatest if e == "f" else F.least)(F.col(f"c.{e}_{a}"), F.col(f"t.{e}_{a}")).alias(f"{e}_{a}") for a in AXES for e in "fl"]
    d = _apart()
    rows = joined.select(STRUCTURE, F.col("c.atom_id").alias("atom_id"), F.col("c.number").alias("number"),
                         F.col("t.atom_id").alias("other_id"), F.col("t.number").alias("other_number"),
                         *[v.alias(f"d{a}") for v, a in zip(d, AXES)], _length(d).alias("r"), *ends)
    return rows.where((F.col("r") <= radius) & F.expr(" AND ".join(f"f_{a} <= l_{a}" for a in AXES)))


def pairs_by_reach(ranged: DataFrame, reaches: DataFrame, levels: int = 16) -> DataFrame:
    """Pairs ``(box_id, atom_id, number, other_number, dx, dy, dz, r)`` in each box of ``reaches (box_id, reach)``, both directions: all
    within the box's reach, and some beyond.

    One search as wide as the widest reach would meet, in crowded boxes, the pairs that only sparse ones need. So boxes whose
    reach is within a factor of two are a level, and each level is searched among the atoms of its boxes.
    """
    reaches = reaches.where("reach > 0")
    most = reaches.agg(F.max("reach")).first()[0]
    level = F.least(F.floor(F.log2(F.lit(most) / F.col("reach"))), F.lit(levels - 1)).cast("int")
    boxes = cut_lineage(reaches.select("box_id", "reach", level.alias("_level")))
    widest = boxes.groupBy("_level").agg(F.max("reach").alias("reach")).orderBy("_level").collect()
    held = lookup_join(in_boxes(ranged.select(STRUCTURE, "atom_id", *ENDS)), boxes, "box_id")
    marked = cut_lineage(ranged.join(held.groupBy(STRUCTURE, "atom_id").agg(F.collect_set("_level").alias("_levels")), [STRUCTURE, "atom_id"]))
    found = None
    for row in widest:
        atoms = marked.where(F.array_contains("_levels", row["_level"])).drop("_levels")
        pairs = in_boxes(ranged_pairs(atoms, atoms, row["reach"] * (1 + 1e-9)).drop("other_id"))
        pairs = lookup_join(pairs, boxes.where(F.col("_level") == row["_level"]), "box_id").select(
            "box_id", "atom_id", "number", "other_number", "dx", "dy", "dz", "r")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def nearest_in_boxes(ranged: DataFrame, radius: float) -> DataFrame:
    """Nearest neighbour within ``radius`` inside each box, per distinct position and box:
    ``(box_id, atom_id, number, n_atoms, nn, nn_any)``, null where the box has none in reach.

    The search starts with cells that are not crowded and widens them for positions that have found none in some box.
    """
    places = cut_lineage(ranged.groupBy(STRUCTURE, *AXES, "number", *ENDS).agg(
        F.count(F.lit(1)).alias("n_atoms"), F.min("atom_id").alias("atom_id")))
    todo, done = places, None
    for level in range(_depth(places, radius), -1, -1):
        reach = float(radius) / SHRINK ** level
        close = ranged_pairs(todo, places, reach).groupBy(STRUCTURE, "atom_id", *ENDS).agg(F.min("r").alias("nn"))
        found = cut_lineage(in_boxes(close).groupBy(STRUCTURE, "atom_id", "box_id").agg(F.min("nn").alias("nn")))
        done = found if done is None else done.unionByName(found)
        boxes = found.groupBy(STRUCTURE, "atom_id").agg(F.count(F.lit(1)).alias("_k"))
        todo = cut_lineage(todo.join(boxes, [STRUCTURE, "atom_id"], "left").where(F.coalesce("_k", F.lit(0)) < box_count()).drop("_k"))
        if todo.isEmpty():
            break
    # a box met on two levels has its nearest on the first one
    best = done.groupBy("box_id", "atom_id").agg(F.min("nn").alias("nn"))
    held = in_boxes(places.select(STRUCTURE, "atom_id", "number", "n_atoms", *ENDS))
    nn = F.when(F.col("n_atoms") > 1, 0.0).otherwise(F.col("nn"))
    return held.join(best, ["box_id", "atom_id"], "left").select("box_id", "atom_id", "number", "n_atoms", nn.alias("nn"), nn.alias("nn_any"))
