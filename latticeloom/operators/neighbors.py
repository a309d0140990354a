"""Neighbours within a distance, and what is built on them.

Spark has no distance join. Space is cut into cubic cells as wide as the search
radius, every centre is repeated for the 27 cells around it, and the join is an
equi-join on (structure, cell) with the distance as residual predicate. One huge
structure is many keys, so it spreads by itself.

Nearest-neighbour searches do not need all pairs. They start with cells so small
that none is crowded and widen the cells only for the atoms that found nothing,
so a dense cluster costs no more than a sparse region. Atoms at the same position
are counted first and handled as one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from latticeloom.distributed import lookup_join
from latticeloom.session import cut_lineage

STRUCTURE = "structure_id"
AXES = ("x", "y", "z")
CROWDED = 64          # points per cell above which the search starts with smaller cells
SHRINK = 3            # cell edge ratio between two search levels
LIST_SKIN = 0.1       # skin of neighbour lists built from per-atom radii


def pair_radius(radius_per_atom: float, skin: float = LIST_SKIN) -> float:
    """Pair distance covered by a neighbour list whose spheres must overlap."""
    return 2.0 * (radius_per_atom + skin)


# --- periodic images ---------------------------------------------------------

def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cell_vectors(cell: Column) -> list[tuple[Column, Column, Column]]:
    return [tuple(cell[i][k] for k in range(3)) for i in range(3)]


def cell_volume(cell: Column) -> Column:
    a, b, c = cell_vectors(cell)
    return F.abs(_dot(a, _cross(b, c)))


def inverse_rows(cell: Column) -> list[Column]:
    """Rows g_i of the inverse cell: fractional coordinate i is the dot product with g_i."""
    v = cell_vectors(cell)
    det = _dot(v[0], _cross(v[1], v[2]))
    rows = [_cross(v[1], v[2]), _cross(v[2], v[0]), _cross(v[0], v[1])]
    return [F.array(*[F.try_divide(c, det) for c in r]) for r in rows]


def with_inverse_cell(structures: DataFrame, cell: str = "cell") -> DataFrame:
    """Add the rows of the inverse cell as ``_g0`` .. ``_g2``."""
    return structures.select("*", *[g.alias(f"_g{i}") for i, g in enumerate(inverse_rows(F.col(cell)))])


def fractional(i: int) -> Column:
    """Fractional coordinate ``i`` of a row with ``x, y, z`` and ``_g0`` .. ``_g2``."""
    g = F.col(f"_g{i}")
    return F.col("x") * g[0] + F.col("y") * g[1] + F.col("z") * g[2]


def shifted(rows: DataFrame, columns: Sequence[str], shift: Sequence[Column], *extra: Column) -> DataFrame:
    cell = F.col("cell")
    moved = [(F.col(a) + shift[0] * cell[0][k] + shift[1] * cell[1][k] + shift[2] * cell[2][k]).alias(a)
             for k, a in enumerate(AXES)]
    return rows.select(*[c for c in columns if c not in AXES], *moved, *extra)


# --- the periodic cell list --------------------------------------------------
#
# Layers parallel to the faces of the cell, at least as thick as the search radius, cut it into n0 x n1 x n2 small cells. A
# centre looks into the small cells around its own; an index beyond the cell is taken modulo n, and how often it went around is
# the lattice shift of what is found there. So every atom is one row on the target side, whatever the radius, and images
# are never formed. Along open axes layers go on for ever and nothing goes around.

#: Layers are this much thicker than the radius, so that rounding moves no neighbour beyond the next layer.
SLACK = 1 + 1e-6
_LATTICE = ["_v", "pbc", "_g0", "_g1", "_g2", "_h0", "_h1", "_h2"]


def lattice_table(structures: DataFrame) -> DataFrame:
    """Per structure the cell vectors, inverse rows ``_g`` and heights ``_h``; a zero vector of an open axis becomes a unit vector."""
    zero = lambda v: F.forall(v, lambda c: c == 0)
    unit = lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k == i, 1.0).otherwise(0.0))
    filled = F.transform("cell", lambda v, i: F.when(zero(v) & ~F.get(F.col("pbc"), i), unit(i)).otherwise(v))
    s = with_inverse_cell(structures.select(STRUCTURE, filled.alias("_v"), "pbc"), "_v")
    return s.select("*", *[(1 / F.sqrt(_dot(F.col(f"_g{i}"), F.col(f"_g{i}")))).alias(f"_h{i}") for i in range(3)])


def homes(atoms: DataFrame, lattice: DataFrame | None) -> DataFrame:
    """Atoms inside their cell along periodic axes, with fractional coordinates ``_f0 .. _f2`` and their lattice's columns."""
    if lattice is None:
        return atoms
    rows = lookup_join(atoms, lattice, STRUCTURE).select("*", *[fractional(i).alias(f"_f{i}") for i in range(3)])
    # a hair below 1 counts as 0, so that rounding does not move an atom across the cell
    back = [F.when(F.col("pbc")[i], -F.floor(F.col(f"_f{i}") + 1e-9)).otherwise(F.lit(0)) for i in range(3)]
    rows = rows.select("*", *[n.alias(f"_b{i}") for i, n in enumerate(back)])
    vectors = cell_vectors(F.col("_v"))
    moved = [(F.col(a) + F.col("_b0") * vectors[0][k] + F.col("_b1") * vectors[1][k] + F.col("_b2") * vectors[2][k]).alias(a)
             for k, a in enumerate(AXES)]
    return rows.select(*[c for c in atoms.columns if c not in AXES], *moved,
                       *[(F.col(f"_f{i}") + F.col(f"_b{i}")).alias(f"_f{i}") for i in range(3)], *_LATTICE)


def _layers(i: int, radius: float) -> tuple[Column, Column]:
    """Number of layers along axis ``i`` (periodic) and the layer of an atom."""
    n = F.greatest(F.lit(1), F.floor(F.col(f"_h{i}") / (radius * SLACK)))
    inside = F.least(n - 1, F.greatest(F.lit(0), F.floor(F.col(f"_f{i}") * n)))
    return n, F.when(F.col("pbc")[i], inside).otherwise(F.floor(F.col(f"_f{i}") * F.col(f"_h{i}") / (radius * SLACK)))


def _without_lattice(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (*_LATTICE, "_f0", "_f1", "_f2")]


def targets_in_cells(rows: DataFrame, radius: float) -> DataFrame:
    """``homes`` with the small cell ``_cx, _cy, _cz`` of each; one row an atom."""
    if "_f0" not in rows.columns:
        return with_cell(rows, F.lit(float(radius)))
    return rows.select(*_without_lattice(rows), *[_layers(i, radius)[1].alias(f"_c{a}") for i, a in enumerate(AXES)])


def centres_in_cells(rows: DataFrame, radius: float, half: bool = False) -> DataFrame:
    """``homes`` once for each small cell that may hold neighbours, with the shift ``_sx, _sy, _sz`` of what is there and
    whether it is no shift, ``_same``; ``half`` is for structures without images."""
    if "_f0" not in rows.columns:
        return with_cells_around(rows, F.lit(float(radius)), half).select(
            "*", *[F.lit(0.0).alias(f"_s{a}") for a in AXES], F.lit(True).alias("_same"))
    for i in range(3):
        n, own = _layers(i, radius)
        reach = F.when(F.col("pbc")[i], F.ceil(radius * SLACK * n / F.col(f"_h{i}"))).otherwise(1).cast("int")
        rows = rows.select("*", n.alias(f"_n{i}"), own.alias(f"_l{i}"), F.explode(F.sequence(-reach, reach)).alias(f"_d{i}"))
    keys, turns = [], []
    for i, a in enumerate(AXES):
        at = F.col(f"_l{i}") + F.col(f"_d{i}")
        keys.append(F.when(F.col("pbc")[i], F.pmod(at, F.col(f"_n{i}"))).otherwise(at).alias(f"_c{a}"))
        turns.append(F.when(F.col("pbc")[i], F.floor(at / F.col(f"_n{i}"))).otherwise(F.lit(0)))
    vectors = cell_vectors(F.col("_v"))
    shift = [(turns[0] * vectors[0][k] + turns[1] * vectors[1][k] + turns[2] * vectors[2][k]).cast("double").alias(f"_s{a}")
             for k, a in enumerate(AXES)]
    same = (turns[0] == 0) & (turns[1] == 0) & (turns[2] == 0)
    keep = [c for c in _without_lattice(rows) if c not in {f"_{p}{i}" for p in "nld" for i in range(3)}]
    return rows.select(*keep, *keys, *shift, same.alias("_same"))


# --- cells -------------------------------------------------------------------

def _cell(axis: str, edge: Column) -> Column:
    return F.floor(F.col(axis) / edge)


def with_cell(points: DataFrame, edge: Column) -> DataFrame:
    return points.select("*", *[_cell(a, edge).alias(f"_c{a}") for a in AXES])


def with_cells_around(points: DataFrame, edge: Column, half: bool = False) -> DataFrame:
    """One row per cell around the point; ``half`` keeps 14 of the 27 cells, so that
    each unordered pair of cells is met once."""
    around = ", ".join(f"struct({i} as x, {j} as y, {k} as z)" for i in (-1, 0, 1) for j in (-1, 0, 1)
                       for k in (-1, 0, 1) if not half or (i, j, k) >= (0, 0, 0))
    return points.withColumn("_n", F.expr(f"explode(array({around}))")).select(
        *points.columns, *[(_cell(a, edge) + F.col(f"_n.{a}")).alias(f"_c{a}") for a in AXES])


_KEYS = [STRUCTURE, "_cx", "_cy", "_cz"]


def _distance(a: str, b: str) -> Column:
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in AXES]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _apart() -> list[Column]:
    """From centre ``c`` to target ``t``, which stands at the centre's shift."""
    return [F.col(f"t.{a}") + F.col(f"c._s{a}") - F.col(f"c.{a}") for a in AXES]


def _length(d: Sequence[Column]) -> Column:
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


# --- all pairs within a radius -----------------------------------------------

def neighbour_pairs(atoms: DataFrame, radius: float, structures: DataFrame | None = None,
                    half: bool = False) -> DataFrame:
    """``(structure_id, atom_id, number, other_id, other_number, dx, dy, dz, r)``.

    ``half`` gives each unordered pair once (``atom_id <= other_id``), self images in
    both directions included; otherwise both directions are given.
    """
    edge = F.lit(float(radius))
    placed = homes(atoms.select(STRUCTURE, "atom_id", "number", *AXES), None if structures is None else lattice_table(structures))
    # without images an unordered pair of cells needs one visit only
    centres = centres_in_cells(placed, radius, half and structures is None)
    joined = centres.alias("c").join(targets_in_cells(placed, radius).alias("t"), _KEYS)
    same = (F.col("c.atom_id") == F.col("t.atom_id")) & F.col("c._same")
    rows = joined.where(~same).withColumn("_r", _length(_apart())).where(F.col("_r") <= radius)
    a, b = F.col("c.atom_id"), F.col("t.atom_id")
    same_cell = [F.col(f"_c{x}") == F.floor(F.col(f"c.{x}") / edge) for x in AXES]
    flip = F.lit(False)
    if half and structures is None:
        # inside one cell both orders are met: keep one; across cells, order the ends
        rows = rows.where(~(same_cell[0] & same_cell[1] & same_cell[2]) | (a < b))
        flip = a > b
    elif half:
        rows = rows.where(a <= b)
    pick = lambda u, v: F.when(flip, v).otherwise(u)
    sign = F.when(flip, -1.0).otherwise(1.0)
    return rows.select(
        STRUCTURE, pick(a, b).alias("atom_id"), pick(F.col("c.number"), F.col("t.number")).alias("number"),
        pick(b, a).alias("other_id"), pick(F.col("t.number"), F.col("c.number")).alias("other_number"),
        *[(sign * d).alias(f"d{x}") for d, x in zip(_apart(), AXES)], F.col("_r").alias("r"))


def neighbour_list(atoms: DataFrame, radius: float, structures: DataFrame | None = None,
                   centre_species: int | None = None, neighbour_species: int | None = None,
                   min_neighbours: int = 1) -> DataFrame:
    """Neighbours per atom with optional species at either end; atoms with fewer
    than ``min_neighbours`` neighbours (of any species) are left out."""
    pairs = neighbour_pairs(atoms, radius, structures)
    if centre_species is not None:
        pairs = pairs.where(F.col("number") == centre_species)
    if min_neighbours > 1:
        enough = (pairs.groupBy(STRUCTURE, "atom_id").agg(F.count(F.lit(1)).alias("_k"))
                  .where(F.col("_k") >= min_neighbours).drop("_k"))
        pairs = pairs.join(enough, [STRUCTURE, "atom_id"])
    return pairs if neighbour_species is None else pairs.where(F.col("other_number") == neighbour_species)


# --- nearest neighbours ------------------------------------------------------

def _positions(atoms: DataFrame) -> DataFrame:
    """Distinct positions with the number of atoms at each."""
    return atoms.groupBy(STRUCTURE, *AXES, "number").agg(
        F.count(F.lit(1)).alias("n_atoms"), F.min("atom_id").alias("atom_id"))


def _depth(points: DataFrame, radius: float, deepest: int = 16) -> int:
    """How many times the cells must shrink until none is crowded.

    A crowd of c points spread evenly needs cells smaller by the cube root of
    c / CROWDED; the guess is checked and deepened where points are clustered.
    """
    depth = 0
    while depth < deepest:
        crowd = targets_in_cells(points, float(radius) / SHRINK ** depth).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if crowd is None or crowd <= CROWDED:
            break
        depth += max(1, int(math.log(crowd / CROWDED, SHRINK) / 3))
    return min(depth, deepest)


def nearest_distances(atoms: DataFrame, radius: float, structures: DataFrame | None = None,
                      centre_species: int | None = None,
                      neighbour_species: int | None = None) -> DataFrame:
    """Nearest neighbour within ``radius`` per distinct position:
    ``(structure_id, atom_id, number, n_atoms, nn, nn_any)``.

    ``nn`` is the nearest neighbour of the wanted species and NULL if there is none
    in reach; ``nn_any`` tells whether anything at all is in reach.
    """
    lattice = None if structures is None else cut_lineage(lattice_table(structures))
    places = cut_lineage(_positions(atoms))
    targets = homes(places, lattice)
    depth = _depth(targets, radius)
    todo = targets.select(*places.columns)                       # inside the cell already
    if centre_species is not None:
        todo = todo.where(F.col("number") == centre_species)
    wanted = F.lit(True) if neighbour_species is None else F.col("t.number") == neighbour_species
    twin = (F.col("n_atoms") > 1) & (F.lit(True) if neighbour_species is None
                                     else F.col("number") == neighbour_species)
    done = []
    for level in range(depth, -1, -1):
        reach = float(radius) / SHRINK ** level
        itself = (F.col("c.atom_id") == F.col("t.atom_id")) & F.col("c._same")
        # an inner join: the planner may split a crowded cell on either side
        near = (centres_in_cells(homes(todo.select(STRUCTURE, "atom_id", *AXES), lattice), reach).alias("c")
                .join(targets_in_cells(targets, reach).alias("t"), _KEYS)
                .withColumn("_r", _length(_apart())).where((F.col("_r") <= reach) & ~itself)
                .groupBy(STRUCTURE, F.col("c.atom_id").alias("atom_id"))
                .agg(F.min(F.when(wanted, F.col("_r"))).alias("nn"), F.min("_r").alias("nn_any")))
        found = todo.join(near, [STRUCTURE, "atom_id"], "left")
        found = (found.withColumn("nn", F.when(twin, 0.0).otherwise(F.col("nn")))
                 .withColumn("nn_any", F.when(F.col("n_atoms") > 1, 0.0).otherwise(F.col("nn_any"))))
        if level == 0:
            done.append(found)
            break
        found = cut_lineage(found)
        done.append(found.where(F.col("nn").isNotNull()))
        todo = found.where(F.col("nn").isNull()).drop("nn", "nn_any")
        if todo.limit(1).count() == 0:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop(*AXES)


def minimum_distance(atoms: DataFrame, structures_with_no_pair: bool = False) -> DataFrame:
    """Exact smallest distance between two atoms per structure (no images).

    By the pigeonhole principle some cell of a grid with fewer cells than atoms
    holds two atoms, so its diagonal bounds the answer; the bound shrinks while
    some cell of a finer grid still holds two. With the final bound as cell edge no
    cell can be crowded. Edges end where cell numbers would pass 2**52, as places that
    differ by less than that of the extent are the same to rounding; any bound is valid.
    """
    # by place alone: unlike atoms at one place are at distance 0 too
    places = cut_lineage(atoms.groupBy(STRUCTURE, *AXES).agg(F.count(F.lit(1)).alias("n_atoms"), F.min("atom_id").alias("atom_id")))
    size = cut_lineage(places.groupBy(STRUCTURE).agg(
        F.count(F.lit(1)).alias("n"), F.max("n_atoms").alias("twins"),
        F.greatest(*[F.max(a) - F.min(a) for a in AXES]).alias("extent")))
    single = size.where((F.col("twins") == 1) & (F.col("n") == 1)).select(
        STRUCTURE, F.lit(None).cast("double").alias("min_distance"))
    twins = size.where(F.col("twins") > 1).select(STRUCTURE, F.lit(0.0).alias("min_distance"))
    edge = F.col("extent") / F.greatest(F.floor(F.cbrt(F.col("n") - 1)), F.lit(1))
    bound = size.where((F.col("twins") == 1) & (F.col("n") > 1)).select(
        STRUCTURE, edge.alias("edge"), (F.col("extent") * 2.0 ** -52).alias("finest"))
    bounds = [(bound, bound.withColumn("edge", F.col("edge") * F.lit(3.0 ** 0.5)))]
    while True:
        finer = bounds[-1][0].withColumn("edge", F.col("edge") / SHRINK).where("edge > finest")
        shared = (with_cell(lookup_join(places, finer, STRUCTURE), F.col("edge"))
                  .groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("k"), F.first("edge").alias("edge"), F.first("finest").alias("finest"))
                  .where(F.col("k") > 1).groupBy(STRUCTURE).agg(F.first("edge").alias("edge"), F.first("finest").alias("finest")))
        shared = cut_lineage(shared)
        if shared.limit(1).count() == 0:
            break
        bounds.append((shared, shared.withColumn("edge", F.col("edge") * F.lit(3.0 ** 0.5))))
    best = None
    for _, b in bounds:
        best = b if best is None else best.unionByName(b)
    # a hair wider, so that rounding never hides the pair that set the bound
    best = best.groupBy(STRUCTURE).agg((F.min("edge") * (1 + 1e-9)).alias("edge"))
    rows = lookup_join(places, best, STRUCTURE)
    pairs = (with_cells_around(rows, F.col("edge"), half=True).alias("c")
             .join(with_cell(rows, F.col("edge")).alias("t"), _KEYS)
             .where(F.struct(*[F.col(f"c.{a}") for a in AXES]) != F.struct(*[F.col(f"t.{a}") for a in AXES]))
             .groupBy(STRUCTURE).agg(F.min(_distance("c", "t")).alias("min_distance")))
    out = pairs.unionByName(twins)
    return out.unionByName(single) if structures_with_no_pair else out


# --- length scale ------------------------------------------------------------

def histogram_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the last bin is closed on the right."""
    width = hi - lo
    edge = lambda i: lo + i * width / bins
    guess = F.least(F.floor((value - lo) / width * bins), F.lit(bins - 1))
    down = F.when(value < edge(guess), 1).otherwise(0)
    up = F.when((guess < bins - 1) & (value >= edge(guess + 1)), 1).otherwise(0)
    return (guess - down + up).cast("int")


def length_histogram(nn: DataFrame, group: Sequence[str], bins: int = 100,
                     distance: str = "nn") -> DataFrame:
    """Non-empty histogram bins of nearest-neighbour distances with their score
    ``count / left_edge^2``."""
    nn = cut_lineage(nn.select(*group, distance, "n_atoms"))
    ends = nn.groupBy(*group).agg(F.min(distance).alias("_lo"), F.max(distance).alias("_hi"))
    # equal distances: the range widens by one half to either side
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(*group, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    placed = lookup_join(nn, ends, list(group), once=True).withColumn(
        "bin", histogram_bin(F.col(distance), F.col("_lo"), F.col("_hi"), bins))
    counts = placed.groupBy(*group, "bin", "_lo", "_hi").agg(F.sum("n_atoms").alias("n"))
    left = F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins
    right = F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins
    score = F.coalesce(F.try_divide(F.col("n").cast("double"), left * left), F.lit(float("inf")))
    return counts.select(*group, "bin", "n", left.alias("left_edge"),
                         ((left + right) / 2).alias("center"), score.alias("score"))


def _scale_of(nn: DataFrame, group: Sequence[str], distribution: str, bins: int) -> DataFrame:
    if distribution == "avg_nn":
        return nn.groupBy(*group).agg((F.sum(F.col("nn") * F.col("n_atoms")) / F.sum("n_atoms")).alias("length_scale"))
    if distribution != "quantile_nn":
        raise ValueError("distribution must be 'avg_nn' or 'quantile_nn'")
    return (length_histogram(nn, group, bins).groupBy(*group)
            .agg(F.max_by("center", F.struct(F.col("score"), -F.col("bin"))).alias("length_scale")))


def length_scale(atoms: DataFrame, radius: float, distribution: str = "quantile_nn",
                 structures: DataFrame | None = None, bins: int = 100,
                 drop_below: float | None = None, centre_species: int | None = None,
                 neighbour_species: int | None = None, min_neighbours: int = 1) -> DataFrame:
    """Characteristic length of each structure from its nearest-neighbour distances."""
    return _length_scales(atoms, {0: radius}, distribution, structures, bins, drop_below,
                          centre_species, neighbour_species, min_neighbours).drop("cutoff_index")


def _nearest_for_scale(atoms, radius, structures, centre_species, neighbour_species, min_neighbours):
    if min_neighbours <= 1:
        return nearest_distances(atoms, radius, structures, centre_species, neighbour_species)
    pairs = neighbour_pairs(atoms, radius, structures)
    if centre_species is not None:
        pairs = pairs.where(F.col("number") == centre_species)
    wanted = F.lit(True) if neighbour_species is None else F.col("other_number") == neighbour_species
    return (pairs.groupBy(STRUCTURE, "atom_id")
            .agg(F.min(F.when(wanted, F.col("r"))).alias("nn"), F.min("r").alias("nn_any"),
                 F.count(F.lit(1)).alias("k"))
            .where(F.col("k") >= min_neighbours).drop("k").withColumn("n_atoms", F.lit(1)))


def _length_scales(atoms, radii, distribution, structures, bins, drop_below, centre_species,
                   neighbour_species, min_neighbours) -> DataFrame:
    """Length scale per structure and cutoff from one neighbour search at the largest
    radius: a smaller radius sees the same nearest neighbours, only fewer of them."""
    if min_neighbours > 1 and len(radii) > 1:
        raise ValueError("several cutoffs need min_neighbours=1")
    nn = _nearest_for_scale(atoms, max(radii.values()), structures, centre_species,
                            neighbour_species, min_neighbours)
    return _scales_of_nearest(nn, radii, distribution, bins, drop_below, neighbour_species)


def _scales_of_nearest(nn, radii, distribution, bins, drop_below, neighbour_species) -> DataFrame:
    group = [STRUCTURE, "cutoff_index"]
    cutoffs = F.explode(F.array(*[F.struct(F.lit(i).alias("cutoff_index"), F.lit(float(r)).alias("_radius"))
                                  for i, r in sorted(radii.items())]))
    seen = (nn.withColumn("_c", cutoffs).select("*", "_c.*").drop("_c")
            .where(F.col("nn_any") <= F.col("_radius")))
    usable = seen.where(F.col("nn") <= F.col("_radius"))
    if drop_below is not None:
        usable = usable.where(F.col("nn") > drop_below)
    scale = _scale_of(usable, group, distribution, bins)
    if neighbour_species is None:
        return scale
    # an atom that sees others, but none of the wanted species, leaves no scale
    lost = seen.where(F.col("nn").isNull() | (F.col("nn") > F.col("_radius"))).select(*group).distinct()
    return (scale.join(lost.withColumn("_lost", F.lit(True)), group, "left")
            .withColumn("length_scale", F.when(F.col("_lost"), None).otherwise(F.col("length_scale")))
            .drop("_lost"))


def top_length_scales(atoms: DataFrame, radius: float, n: int = 3,
                      structures: DataFrame | None = None, bins: int = 100) -> DataFrame:
    """Centres of the ``n`` best bins per structure, best first (rank 1)."""
    hist = length_histogram(nearest_distances(atoms, radius, structures).where(F.col("nn").isNotNull()),
                            [STRUCTURE], bins)
    # at most ``bins`` rows per structure
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("bin"),
                                                       F.col("center")))), 1, n)
    return (hist.groupBy(STRUCTURE).agg(best.alias("_b"))
            .select(STRUCTURE, F.posexplode("_b").alias("_p", "_v"))
            .select(STRUCTURE, (F.col("_p") + 1).alias("rank"), F.col("_v.center").alias("length_scale")))


def scale_factors(atoms: DataFrame, radii: Sequence[float], distribution: str = "quantile_nn",
                  structures: DataFrame | None = None, min_scale: float = 0.1,
                  max_scale: float = 1500.0, extrinsic: float = 1.0, **options) -> DataFrame:
    """First length scale strictly inside the limits, trying the radii in order."""
    if distribution == "min_nn":
        return minimum_distance(atoms).select(
            STRUCTURE, (F.col("min_distance") * extrinsic).alias("scale_factor"))
    opts = {"bins": 100, "drop_below": None, "centre_species": None, "neighbour_species": None,
            "min_neighbours": 1, **options}
    return _first_valid(_length_scales(atoms, dict(enumerate(radii)), distribution, structures, **opts), min_scale, max_scale, extrinsic)


def scale_factors_of_nearest(nn: DataFrame, radii: Sequence[float], distribution: str = "quantile_nn", min_scale: float = 0.1,
                             max_scale: float = 1500.0, extrinsic: float = 1.0, bins: int = 100) -> DataFrame:
    """``scale_factors`` from known nearest distances ``(structure_id, nn, nn_any, n_atoms)`` up to the largest radius."""
    if distribution == "min_nn":
        return nn.where(F.col("nn").isNotNull()).groupBy(STRUCTURE).agg((F.min("nn") * extrinsic).alias("scale_factor"))
    return _first_valid(_scales_of_nearest(nn, dict(enumerate(radii)), distribution, bins, None, None), min_scale, max_scale, extrinsic)


def _first_valid(scales: DataFrame, min_scale: float, max_scale: float, extrinsic: float) -> DataFrame:
    valid = scales.where((F.col("length_scale") > min_scale) & (F.col("length_scale") < max_scale))
    return valid.groupBy(STRUCTURE).agg(
        (F.min_by("length_scale", "cutoff_index") * extrinsic).alias("scale_factor"))


def scale_structure(atoms: DataFrame, factors: DataFrame) -> DataFrame:
    """Divide all positions by the structure's scale factor."""
    joined = lookup_join(atoms, factors, STRUCTURE)
    return joined.select(*[c for c in atoms.columns if c not in AXES],
                         *[(F.col(a) / F.col("scale_factor")).alias(a) for a in AXES])


def scale_cell(structures: DataFrame, factors: DataFrame) -> DataFrame:
    scaled = F.transform(F.col("cell"), lambda v: F.transform(v, lambda c: c / F.col("scale_factor")))
    return lookup_join(structures, factors, STRUCTURE).withColumn("cell", scaled).drop("scale_factor")


# --- pair distributions ------------------------------------------------------

def require_periodic(structures: DataFrame) -> None:
    if structures.where(~F.forall("pbc", lambda p: p)).limit(1).count():
        raise NotImplementedError("pair distributions need structures periodic along all three axes")


def pair_distances(atoms: DataFrame, structures: DataFrame, cutoff: float = 20.0,
                   ignore_species: bool = False) -> DataFrame:
    """Periodic pair distances ``(structure_id, z1, z2, r, weight)`` with
    ``weight = 1 / (4 pi N/V r^2)``."""
    require_periodic(structures)
    consts = (structures.select(STRUCTURE, cell_volume(F.col("cell")).alias("_v"))
              .join(atoms.groupBy(STRUCTURE).agg(F.count(F.lit(1)).alias("_n")), STRUCTURE))
    pairs = neighbour_pairs(atoms, cutoff, structures, half=True)
    return weighted_pairs(pairs, consts, ignore_species)


def weighted_pairs(pairs: DataFrame, consts: DataFrame, ignore_species: bool = False) -> DataFrame:
    """Pairs with species in ascending order and weights from ``consts(structure_id, _v, _n)``."""
    z1, z2 = F.least("number", "other_number"), F.greatest("number", "other_number")
    if ignore_species:
        z1 = z2 = F.lit(0)
    weight = F.col("_v") / (F.lit(4 * 3.141592653589793) * F.col("_n") * F.col("r") * F.col("r"))
    return lookup_join(pairs, consts, STRUCTURE, once=True).select(
        STRUCTURE, z1.alias("z1"), z2.alias("z2"), "r", weight.alias("weight"))


def pair_design_matrix(pairs: DataFrame, largest_number: int, total_bins: int = 50,
                       max_dist: float = 25.0) -> DataFrame:
    """Sparse design matrix ``(structure_id, col, value)`` of weighted pair distances.

    Bin edges are log-spaced, ``max_dist^(k/bins) - 1``; each species pair is
    normalised to unit area. ``col = (z_hi * Z + z_lo) * bins + bin``,
    ``Z = largest_number + 1``.
    """
    top = max_dist - 1.0
    log_max = F.log(F.lit(float(max_dist)))
    edge = lambda k: F.pow(F.lit(float(max_dist)), k / F.lit(float(total_bins))) - 1.0
    guess = F.floor(F.log(F.col("r") + 1.0) / log_max * total_bins)
    fixed = (guess - F.when(edge(guess) > F.col("r"), 1).otherwise(0)
             + F.when(edge(guess + 1) <= F.col("r"), 1).otherwise(0))
    binned = (pairs.where((F.col("r") >= 0.0) & (F.col("r") <= top))
              .groupBy(STRUCTURE, "z1", "z2", F.least(F.lit(total_bins - 1), fixed).cast("int").alias("bin"))
              .agg(F.sum("weight").alias("w")))
    totals = binned.groupBy(STRUCTURE, "z1", "z2").agg(F.sum("w").alias("t"))
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    zmax = largest_number + 1
    col = (F.col("z2") * zmax + F.col("z1")) * total_bins + F.col("bin")
    return binned.join(totals, [STRUCTURE, "z1", "z2"]).select(
        STRUCTURE, "z1", "z2", "bin", col.cast("long").alias("col"),
        (F.col("w") / F.col("t") / width).alias("value"))


# --- common neighbours -------------------------------------------------------

#: Atoms of one cell whose bonds are worked out by one group.
CENTRES = 256
#: Numbers of a matrix of bonds that are held at a time.
HELD_BONDS = 4_000_000
#: Neighbours of an atom up to which a matrix product counts the bonds among them, and beyond which words of bits do.
FEW_NEIGHBOURS = 1_000
#: Share of the squared radius by which a squared distance in single precision may be off, with room to spare.
SINGLE_SLACK = 1e-5


def _bonded(at: np.ndarray, near: np.ndarray, rows: slice, radius: float) -> np.ndarray:
    """Which of some places ``at[rows]`` have a bond with which of ``at``, none with itself; ``near`` has the places from one of their
    bonded centre on, over the radius, as single numbers. The few distances close to the radius are formed as in ``neighbour_pairs``."""
    some, sizes = near[rows], np.einsum("ij,ij->i", near, near)
    one = np.ones(len(near), dtype=np.float32)
    # |x|^2 + |y|^2 - 2 x y, of numbers up to 1
    total = np.column_stack([-2 * some, one[rows], sizes[rows]]) @ np.column_stack([near, sizes, one]).T
    total -= 1
    found = total <= 0
    row, col = np.divmod(np.flatnonzero(np.abs(total, out=total) < SINGLE_SLACK), len(near))
    exact = np.square(at[rows][row, 0] - at[col, 0])
    for k in (1, 2):
        exact += np.square(at[rows][row, k] - at[col, k])
    found[row, col] = np.sqrt(exact) <= radius
    found[np.arange(len(some)), np.arange(len(near))[rows]] = False
    return found


def _bits(found: np.ndarray) -> np.ndarray:
    """Rows of truth values as words of 64 bits."""
    out = np.zeros((len(found), -(-found.shape[1] // 64) * 8), dtype=np.uint8)
    out[:, :-(-found.shape[1] // 8)] = np.packbits(found, axis=1)
    return out.view(np.uint64)


def _shared_and_inner(at: np.ndarray, centre: np.ndarray, above: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``at[above:]``, bonded to ``centre`` as all of ``at`` are: the others with a bond to it, and the bonds among these.

    With the matrix B of bonds among ``at``, these are row sums of B and of (B B) * B, the latter twice the bonds. Of many places
    a row of B is words of bits: the bonds among those of row b are the bits of b in the row of each of them, from its own place on.
    """
    near, n = ((at - centre) / radius).astype(np.float32), len(at)
    shared, inner = np.zeros(n - above, dtype=np.int64), np.zeros(n - above, dtype=np.int64)
    if n <= min(FEW_NEIGHBOURS, math.isqrt(HELD_BONDS)):
        every = _bonded(at, near, slice(0, n), radius).astype(np.float32)    # counts below 2**24 are exact
        mine = every[above:]
        shared[:] = mine.sum(axis=1, dtype=np.float64)
        inner[:] = np.einsum("ij,ij->i", mine @ every, mine, dtype=np.float64)
        return shared, inner // 2
    words = -(-n // 64)
    held = max(64, min(HELD_BONDS // words, n // 2 + 63) // 64 * 64)          # of the parts, a pair of rows is met in one
    size = max(1, HELD_BONDS // n)

    def rows_of(first: int, last: int, made: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
        return np.concatenate([_bits(made(_bonded(at, near, slice(r, min(r + size, last)), radius), r)) for r in range(first, last, size)])

    both, counts = np.empty(held * words, dtype=np.uint64), np.empty(held * words, dtype=np.uint8)
    for b0 in range(above, n, 4 * held):
        ends = rows_of(b0, min(b0 + 4 * held, n), lambda found, r: found)
        shared[b0 - above:b0 - above + len(ends)] = np.bitwise_count(ends).sum(axis=1, dtype=np.int64)
        for first in range(0, n, held):
            # bonds of the rows of this part to later ones
            later = rows_of(first, min(first + held, n), lambda found, r: np.triu(found[:, first:], r - first + 1))
            for b, row in enumerate(ends[:, first // 64:], b0 - above):
                met = np.flatnonzero(np.unpackbits(row[:held // 64].view(np.uint8)))
                shape, space = (len(met), len(row)), len(met) * len(row)
                common = np.take(later, met, axis=0, out=both[:space].reshape(shape), mode="clip")
                np.bitwise_and(common, row, out=common)
                inner[b] += np.bitwise_count(common, out=counts[:space].reshape(shape)).sum(dtype=np.uint32)
    return shared, inner


def common_neighbour_signatures(atoms: DataFrame, radius: float,
                                structures: DataFrame | None = None) -> DataFrame:
    """Per bond: shared neighbours and the bonds among them.

    Cells are as wide as the radius, so the atoms around a cell hold all neighbours of its atoms, and a bond between two of them
    follows from their places. A group gets some atoms of one cell and the places around it, and counts with the matrix B of bonds
    among the neighbours of an atom (``_shared_and_inner``). So triangles and 4-cliques are counted and never are rows. An atom travels
    once for each group around it.

    Works on the bonds of distinct atoms inside the structure (no images). In a structure with an id in several rows a bond does not
    follow from two places and counts as often as its rows are there; in such structures the bonds are joined.
    """
    if structures is not None:
        raise NotImplementedError("replicate the cell first: bonds to images have no own atom id")
    rows = atoms.select(STRUCTURE, "atom_id", "number", *AXES).na.drop(subset=[STRUCTURE, "atom_id", *AXES])
    again = cut_lineage(rows.groupBy(STRUCTURE, "atom_id").count().where("count > 1").select(STRUCTURE).distinct())
    if again.isEmpty():
        return _signatures_by_place(rows.drop("number"), radius)
    return (_signatures_by_place(lookup_join(rows.drop("number"), again, STRUCTURE, "left_anti"), radius)
            .unionByName(_signatures_by_join(lookup_join(rows, again, STRUCTURE, "left_semi"), radius)))


def _signatures_by_place(places: DataFrame, radius: float) -> DataFrame:
    """Signatures of the bonds among ``(structure_id, atom_id, x, y, z)``; an id has one row."""
    edge = F.lit(float(radius))
    held = with_cell(places, edge)
    crowd = held.groupBy(*_KEYS).agg(F.ceil(F.count(F.lit(1)) / CENTRES).cast("int").alias("_parts"))
    crowd = cut_lineage(crowd)
    part = F.pmod(F.xxhash64("atom_id"), F.col("_parts")).cast("int").alias("_part")
    centres = lookup_join(held, crowd, _KEYS).select(*_KEYS, part, "atom_id")
    around = lookup_join(with_cells_around(places, edge), crowd, _KEYS).select(
        *_KEYS, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "atom_id", *AXES)
    around = around.toDF(*around.columns)                        # columns of its own, as both sides come from the places
    kinds = {f.name: f.dataType for f in places.schema}
    schema = T.StructType([T.StructField(n, t) for n, t in (
        (STRUCTURE, kinds[STRUCTURE]), ("atom_id", kinds["atom_id"]), ("other_id", kinds["atom_id"]),
        ("n_common", T.LongType()), ("n_bonds", T.LongType()))])

    def bonds(one: np.ndarray, all_of_them: np.ndarray) -> np.ndarray:
        # the same order of operations as in ``neighbour_pairs``
        total = np.square(one[:, None, 0] - all_of_them[None, :, 0])
        for k in (1, 2):
            total += np.square(one[:, None, k] - all_of_them[None, :, k])
        return np.sqrt(total, out=total) <= radius

    def signatures(key: tuple, wanted: pa.Table, near: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, first = near["atom_id"].combine_chunks(), near["atom_id"].combine_chunks().sort()
        near = near.take(pa.compute.sort_indices(ids))
        at = np.column_stack([near[a].to_numpy() for a in AXES])
        for i in np.asarray(pa.compute.index_in(wanted["atom_id"].combine_chunks(), first)).tolist():
            joined = bonds(at[i:i + 1], at)[0]
            joined[i] = False
            mine = np.flatnonzero(joined)
            above = np.searchsorted(mine, i)                      # ids come sorted: the bonds to larger ids
            if above == len(mine):
                continue
            others = first.take(pa.array(mine[above:]))
            one = [pa.repeat(pa.scalar(v.as_py(), t), len(others)) for v, t in zip((key[0], first[i]), pa_types)]
            yield pa.RecordBatch.from_arrays([*one, others, *map(pa.array, _shared_and_inner(at[mine], at[i], above, float(radius)))],
                                             names=schema.names)

    pa_types = [to_arrow_type(schema[n].dataType) for n in (STRUCTURE, "atom_id")]
    empty = pa.schema([(STRUCTURE, pa_types[0]), ("atom_id", pa_types[1]), ("other_id", pa_types[1]), ("n_common", pa.int64()), ("n_bonds", pa.int64())])

    def counted(key: tuple, wanted: pa.Table, near: pa.Table) -> pa.Table:
        return pa.Table.from_batches(signatures(key, wanted, near) if wanted.num_rows else [], schema=empty)

    groups = [*_KEYS, "_part"]
    return centres.groupBy(*groups).cogroup(around.groupBy(*groups)).applyInArrow(counted, schema)


def _signatures_by_join(atoms: DataFrame, radius: float) -> DataFrame:
    """Signatures for ids at several places.

    Bonds are oriented from the end with fewer bonds, which keeps the out-lists
    short even around a hub; triangles and 4-cliques are then found once each.
    """
    bonds = cut_lineage(neighbour_pairs(atoms, radius, half=True).select(
        STRUCTURE, F.col("atom_id").alias("a"), F.col("other_id").alias("b")))
    ends = bonds.select(STRUCTURE, F.explode(F.array("a", "b")).alias("v"))
    degree = ends.groupBy(STRUCTURE, "v").agg(F.count(F.lit(1)).alias("d"))
    ranked = (bonds.join(degree.withColumnsRenamed({"v": "a", "d": "da"}), [STRUCTURE, "a"])
              .join(degree.withColumnsRenamed({"v": "b", "d": "db"}), [STRUCTURE, "b"]))
    first = F.struct("da", "a") < F.struct("db", "b")
    pick = lambda u, v: F.when(first, F.col(u)).otherwise(F.col(v))
    arcs = cut_lineage(ranked.select(
        STRUCTURE, pick("a", "b").alias("u"), pick("b", "a").alias("v"),
        F.struct(pick("db", "da").alias("d"), pick("b", "a").alias("i")).alias("rank_v")))
    named = lambda a, b: arcs.select(STRUCTURE, F.col("u").alias(a), F.col("v").alias(b))
    p = arcs.withColumnRenamed("rank_v", "rv")
    q = arcs.withColumnsRenamed({"v": "w", "rank_v": "rw"})
    wedges = p.join(q, [STRUCTURE, "u"]).where(F.col("rv") < F.col("rw"))
    triangles = cut_lineage(wedges.join(named("v", "w"), [STRUCTURE, "v", "w"]).select(STRUCTURE, "u", "v", "w", "rw"))
    # 4-cliques: two triangles over the same first arc whose last corners are bonded
    t2 = triangles.select(STRUCTURE, "u", "v", F.col("w").alias("x"), F.col("rw").alias("rx"))
    cliques = (triangles.join(t2, [STRUCTURE, "u", "v"]).where(F.col("rw") < F.col("rx"))
               .join(named("w", "x"), [STRUCTURE, "w", "x"]))

    def per_bond(df: DataFrame, corners: Sequence[str], name: str) -> DataFrame:
        sides = [F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"))
                 for k, i in enumerate(corners) for j in corners[k + 1:]]
        return (df.select(STRUCTURE, F.explode(F.array(*sides)).alias("e"))
                .groupBy(STRUCTURE, F.col("e.a").alias("a"), F.col("e.b").alias("b"))
                .agg(F.count(F.lit(1)).alias(name)))

    shared = per_bond(triangles, ["u", "v", "w"], "n_common")
    inner = per_bond(cliques, ["u", "v", "w", "x"], "n_bonds")
    return (bonds.join(shared, [STRUCTURE, "a", "b"], "left").join(inner, [STRUCTURE, "a", "b"], "left")
            .select(STRUCTURE, F.col("a").alias("atom_id"), F.col("b").alias("other_id"),
                    F.coalesce("n_common", F.lit(0)).alias("n_common"),
                    F.coalesce("n_bonds", F.lit(0)).alias("n_bonds")))


def signature_counts(signatures: DataFrame) -> DataFrame:
    """How often each signature occurs around each atom."""
    both = F.explode(F.array("atom_id", "other_id")).alias("atom_id")
    return (signatures.select(STRUCTURE, both, "n_common", "n_bonds")
            .groupBy(STRUCTURE, "atom_id", "n_common", "n_bonds").agg(F.count(F.lit(1)).alias("n")))
