"""Structure transformations on ``atoms`` and ``structures`` tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeloom.distributed import hash_chosen, lookup_join, pseudo_random_order
from latticeloom.functions.algebra import linspace_value, rotate_x, rotate_y, rotate_z
from latticeloom.operators.neighbors import AXES, STRUCTURE, fractional, shifted, with_inverse_cell
from latticeloom.session import cut_lineage

HIGHEST_NUMBER = 94          # random substitutes are drawn from 1..94


# --- replicas ----------------------------------------------------------------

def structure_sizes(atoms: DataFrame, structures: DataFrame) -> DataFrame:
    """Structures with their atom count and positional extents."""
    e = atoms.groupBy(STRUCTURE).agg(
        F.count(F.lit(1)).alias("n_atoms"), *[(F.max(a) - F.min(a)).alias(f"ext_{a}") for a in AXES])
    return structures.join(e, STRUCTURE)


def replicas_by_atoms(atoms: DataFrame, structures: DataFrame, target_atoms: int,
                      min_atoms: int = 0) -> DataFrame:
    """Repeat along the direction of smallest extent until ``target_atoms`` is reached.

    The loop runs inside a row as a bounded fold: n repeats stretch an axis by
    (n - 1) times the projection of the cell vector.
    """
    s = structure_sizes(atoms, structures)
    stretch = [[F.abs(F.col("cell")[i][k]) for i in range(3)] for k in range(3)]

    def step(state, _):
        n = [state["a"], state["b"], state["c"]]
        ext = [F.col(f"ext_{a}") + sum(((n[i] - 1) * stretch[k][i] for i in (1, 2)), (n[0] - 1) * stretch[k][0])
               for k, a in enumerate(AXES)]
        low = F.least(*ext)
        pick = F.when(ext[0] == low, 0).when(ext[1] == low, 1).otherwise(2)
        grown = F.struct(*[(n[i] + F.when(pick == i, 1).otherwise(0)).cast("int").alias(x)
                           for i, x in enumerate("abc")])
        return F.when(n[0] * n[1] * n[2] * F.col("n_atoms") < target_atoms, grown).otherwise(state)

    one = F.lit(1).cast("int")
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.lit(target_atoms) / F.col("n_atoms")).cast("int")))
    n = F.aggregate(rounds, F.struct(one.alias("a"), one.alias("b"), one.alias("c")), step)
    return _checked_replicas(s.withColumn("_n", n), [F.col("_n.a"), F.col("_n.b"), F.col("_n.c")], min_atoms)


def replicas_by_radius(atoms: DataFrame, structures: DataFrame, radius: Sequence[float],
                       min_atoms: int = 0) -> DataFrame:
    """As many cells as fit within ``radius`` along each cell vector."""
    s = structure_sizes(atoms, structures)
    length = [F.sqrt(sum((F.col("cell")[i][k] * F.col("cell")[i][k] for k in (1, 2)),
                         F.col("cell")[i][0] * F.col("cell")[i][0])) for i in range(3)]
    return _checked_replicas(s, [F.floor(F.lit(float(r)) / ln).cast("int") for r, ln in zip(radius, length)], min_atoms)


def _checked_replicas(s: DataFrame, n: Sequence[Column], min_atoms: int) -> DataFrame:
    total = n[0] * n[1] * n[2] * F.col("n_atoms")
    good = F.array(*n)
    if min_atoms:
        good = F.when(total >= min_atoms, good).otherwise(F.raise_error(F.concat(
            F.lit("structure "), F.col(STRUCTURE), F.lit(f" stays below {min_atoms} atoms"))).cast("array<int>"))
    return s.select(STRUCTURE, good.alias("replicas"), total.alias("n_replicated"))


def smallest_replica_grid(n_atoms: Column, min_atoms: int, planar: Column) -> Column:
    """Smallest n x n x n (n x n x 1 when planar) that reaches ``min_atoms`` and the
    next two sizes per axis, as an array of replica triples."""
    root = lambda p: F.ceil(F.pow(F.lit(float(min_atoms)) / n_atoms, F.lit(p)) - 1e-9).cast("int")
    steps = lambda n: F.sequence(n, n + 2)
    flat = F.flatten(F.transform(steps(root(0.5)), lambda a: F.transform(
        steps(root(0.5)), lambda b: F.array(a, b, F.lit(1)))))
    cubic = F.transform(steps(root(1 / 3)), lambda a: F.array(a, a, a))
    return F.when(planar, flat).otherwise(cubic)


def supercell(atoms: DataFrame, structures: DataFrame, replicas: DataFrame | Sequence[int],
              wrap: bool = True) -> tuple[DataFrame, DataFrame]:
    """Repeat each cell; returns the new atoms and structures.

    New atoms get ``replica`` (their cell index) and ``site_id`` (the atom's id in its cell); ``atom_id`` becomes unique
    within the structure again: site_id * cells + replica, or "site_id/replica" where it is no number. Coordinates are
    wrapped into the new cell along periodic axes.
    """
    if isinstance(replicas, DataFrame):
        s = structures.join(replicas.select(STRUCTURE, "replicas"), STRUCTURE)
    else:
        s = structures.withColumn("replicas", F.array(*[F.lit(int(r)) for r in replicas]))
    rows = lookup_join(atoms, s.select(STRUCTURE, "cell", "replicas"), STRUCTURE).where(
        F.forall("replicas", lambda n: n > 0))
    for i in range(3):
        rows = rows.withColumn(f"_i{i}", F.explode(F.sequence(F.lit(0), F.col("replicas")[i] - 1)))
    moved = [(F.col(a) + sum((F.col(f"_i{i}") * F.col("cell")[i][k] for i in (1, 2)),
                             F.col("_i0") * F.col("cell")[0][k])).alias(a) for k, a in enumerate(AXES)]
    index = ((F.col("_i0") * F.col("replicas")[1] + F.col("_i1")) * F.col("replicas")[2] + F.col("_i2"))
    keep = [F.col(c) for c in atoms.columns if c not in (*AXES, "atom_id", "site_id", "replica")]
    if "atom_id" in atoms.columns:
        cells = F.col("replicas")[0].cast("long") * F.col("replicas")[1] * F.col("replicas")[2]
        numbered = isinstance(atoms.schema["atom_id"].dataType, T.IntegralType)
        unique = F.col("atom_id").cast("long") * cells + index if numbered else F.concat_ws("/", "atom_id", index)
        keep += [unique.alias("atom_id"), F.col("atom_id").alias("site_id")]
    new_atoms = rows.select(*keep, *moved, index.cast("long").alias("replica"))
    grown = F.transform(F.col("cell"), lambda v, i: F.transform(v, lambda c: c * F.get(F.col("replicas"), i)))
    new_structures = s.withColumn("cell", grown).drop("replicas")
    return (wrap_atoms(new_atoms, new_structures) if wrap else new_atoms), new_structures


def wrap_atoms(atoms: DataFrame, structures: DataFrame) -> DataFrame:
    """Move atoms into the cell along periodic axes."""
    rows = lookup_join(atoms, with_inverse_cell(structures.select(STRUCTURE, "cell", "pbc")), STRUCTURE)
    # a hair below 1 counts as 1, so that rounding does not send an atom across the cell
    back = [F.when(F.col("pbc")[i], -F.floor(fractional(i) + 1e-7)).otherwise(F.lit(0)) for i in range(3)]
    rows = rows.select("*", *[b.alias(f"_b{i}") for i, b in enumerate(back)])
    return shifted(rows, atoms.columns, [F.col(f"_b{i}") for i in range(3)])


def zero_open_cell_vectors(structures: DataFrame) -> DataFrame:
    """Cell vectors of non-periodic axes become zero."""
    zero = F.array(*[F.lit(0.0)] * 3)
    return structures.withColumn("cell", F.transform(
        "cell", lambda v, i: F.when(F.get(F.col("pbc"), i), v).otherwise(zero)))


# --- rotation ----------------------------------------------------------------

def euler_rotate(atoms: DataFrame, phi: float | Column, theta: float | Column, psi: float | Column,
                 centre: Sequence[float] | DataFrame = (0.0, 0.0, 0.0)) -> DataFrame:
    """Rotate by phi about z, theta about x, psi about z, around a point or around
    the centre of each structure's cell (pass the structures table)."""
    angle = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    keep = [c for c in atoms.columns if c not in AXES]
    if isinstance(centre, DataFrame):
        mid = [sum((F.col("cell")[i][k] for i in (1, 2)), F.col("cell")[0][k]) / 2 for k in range(3)]
        rows = lookup_join(atoms, centre.select(STRUCTURE, *[m.alias(f"_m{k}") for k, m in enumerate(mid)]), STRUCTURE)
        mid = [F.col(f"_m{k}") for k in range(3)]
    else:
        rows, mid = atoms, [F.lit(float(c)) for c in centre]
    v = tuple(F.col(a) - m for a, m in zip(AXES, mid))
    v = rotate_z(rotate_x(rotate_z(v, angle(phi)), angle(theta)), angle(psi))
    return rows.select(*keep, *[(u + m).alias(a) for u, m, a in zip(v, mid, AXES)])


def random_rotation(atoms: DataFrame, structures: DataFrame, seed: int = 42, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Rotate every structure, atoms and cell, about the origin by a rotation of its own, uniform over all rotations.

    The unit quaternion comes from three hash values of structure id and seed, so a recomputed task turns alike.
    """
    u = [(_hash_int(F.col(STRUCTURE), f"#turn{salt}{part}{seed}", 2 ** 32) + 0.5) / F.lit(float(2 ** 32)) for part in "abc"]
    long_way, short_way = F.sqrt(1 - u[0]), F.sqrt(u[0])
    quaternion = {"x": long_way * F.sin(2 * math.pi * u[1]), "y": long_way * F.cos(2 * math.pi * u[1]),
                  "z": short_way * F.sin(2 * math.pi * u[2]), "w": short_way * F.cos(2 * math.pi * u[2])}
    x, y, z, w = (F.col(f"_q{n}") for n in "xyzw")
    turn = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
            [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
            [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]

    def turned(v) -> list[Column]:
        return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in turn]

    parts = [value.alias(f"_q{n}") for n, value in quaternion.items()]
    moved = atoms.select("*", *parts).select(*[c for c in atoms.columns if c not in AXES],
                                             *[v.alias(a) for v, a in zip(turned([F.col(a) for a in AXES]), AXES)])
    cell = F.transform("cell", lambda v: F.array(*turned([v[k] for k in range(3)])))
    return moved, structures.select("*", *parts).withColumn("cell", cell).select(*structures.columns)


def create_supercell(atoms: DataFrame, structures: DataFrame, replicas_by: str = "nb_atoms", target_atoms: int | None = None,
                     min_atoms: int = 0, radius: float | Sequence[float] | None = None, replicas: Sequence[int] | None = None,
                     rotate_before: bool = False, rotate_after: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Supercells in one call: choose the replicas (``nb_atoms``, ``radius`` or ``user-defined``), rotate before or after.

    A rotation before changes which replicas reach a number of atoms or a radius along the axes; one after keeps them.
    """
    if rotate_before:
        atoms, structures = random_rotation(atoms, structures, seed, "before")
    if replicas_by == "nb_atoms":
        chosen = replicas_by_atoms(atoms, structures, target_atoms, min_atoms)
    elif replicas_by == "radius":
        chosen = replicas_by_radius(atoms, structures, [float(radius)] * 3 if isinstance(radius, (int, float)) else radius, min_atoms)
    elif replicas_by == "user-defined":
        chosen = list(replicas)
    else:
        raise NotImplementedError(f"replicas by {replicas_by!r}: nb_atoms, radius and user-defined are known")
    big, grown = supercell(atoms, structures, chosen, wrap=not rotate_after)
    if rotate_after:
        big, grown = random_rotation(big, grown, seed, "after")
        big = wrap_atoms(big, grown)
    return big, grown


# --- random defects ----------------------------------------------------------

def _check_ratio(ratio: float) -> None:
    if not 0.0 < ratio < 1.0:
        raise ValueError("the ratio must lie between 0 and 1")


def draw_key(key: str) -> Column:
    """What a random draw hashes: the structure and the atom, whose id tells the copies in a supercell apart."""
    return F.concat_ws("/", F.col(STRUCTURE), F.col(key))


def draw_atoms(atoms: DataFrame, ratio: float, key: str = "atom_id", seed: int = 42, name: str = "_chosen") -> DataFrame:
    """Add ``name``: true for ``floor(n * ratio)`` random atoms of every structure."""
    take = F.floor(F.col("_n") * F.lit(float(ratio)))
    return hash_chosen(atoms, pseudo_random_order(draw_key(key), seed), [key], take, [STRUCTURE], name)


def random_subset(atoms: DataFrame, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """``floor(n * ratio)`` rows per structure, without replacement."""
    return draw_atoms(atoms, ratio, key, seed).where("_chosen").drop("_chosen")


def create_vacancies(atoms: DataFrame, ratio: float, key: str = "atom_id", seed: int = 42) -> DataFrame:
    """Delete ``floor(n * ratio)`` random atoms of every structure."""
    _check_ratio(ratio)
    return draw_atoms(atoms, ratio, key, seed).where("NOT _chosen").drop("_chosen")


def defect_error(atoms: DataFrame, ratio: float, max_rel_error: float = 0.25) -> DataFrame:
    """Relative error between the wanted and the possible defect ratio per structure."""
    n = atoms.groupBy(STRUCTURE).agg(F.count(F.lit(1)).alias("n_atoms"))
    actual = F.floor(F.col("n_atoms") * F.lit(ratio)) / F.col("n_atoms")
    error = F.abs(F.lit(ratio) - actual) / F.lit(ratio)
    return n.select(STRUCTURE, "n_atoms", actual.alias("actual_ratio"), error.alias("rel_error"),
                    (error > max_rel_error).alias("exceeds"))


def _hash_int(key: Column, salt: str, modulus: Column | int) -> Column:
    """Uniform integer in [0, modulus) from the first 32 bits of a digest."""
    head = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")
    return F.pmod(head, modulus if isinstance(modulus, Column) else F.lit(modulus))


def substitute_atoms(atoms: DataFrame, ratio: float, pool_size: int = HIGHEST_NUMBER,
                     key: str = "atom_id", seed: int = 42, species: str = "number") -> DataFrame:
    """Give ``floor(n * ratio)`` random atoms of every structure a species drawn from a
    pool of ``pool_size`` draws of the numbers 1..94 per structure."""
    _check_ratio(ratio)
    slot = _hash_int(draw_key(key), f"#slot{seed}", pool_size)
    drawn = 1 + _hash_int(F.concat_ws("/", F.col(STRUCTURE), slot), f"#pool{seed}", HIGHEST_NUMBER)
    return draw_atoms(atoms, ratio, key, seed).withColumn(
        species, F.when(F.col("_chosen"), drawn.cast("int")).otherwise(F.col(species))).drop("_chosen")


def displace_atoms(atoms: DataFrame, distribution: str, displacement: float,
                   scales: DataFrame | None = None, key: str = "atom_id", seed: int = 42) -> DataFrame:
    """Random displacement of every coordinate.

    ``gaussian`` has deviation ``displacement``, ``uniform`` lies within it; the
    ``_scaled`` forms multiply it by the structure's ``length_scale``. The noise is
    a function of structure, key, axis and seed, so a recomputed task gives the same rows.
    """
    kinds = {"gaussian", "uniform", "gaussian_scaled", "uniform_scaled"}
    if distribution not in kinds:
        raise NotImplementedError(f"noise {distribution!r} is not one of {sorted(kinds)}")
    rows, size = atoms, F.lit(float(displacement))
    if distribution.endswith("_scaled"):
        rows = lookup_join(atoms, scales.select(STRUCTURE, "length_scale"), STRUCTURE)
        size = size * F.col("length_scale")

    def unit(axis: str, part: str) -> Column:
        return (_hash_int(draw_key(key), f"#{axis}{part}{seed}", 2 ** 32) + 0.5) / F.lit(float(2 ** 32))

    def noise(axis: str) -> Column:
        if distribution.startswith("uniform"):
            return (unit(axis, "u") * 2 - 1) * size
        # two uniform numbers give one normal one
        return F.sqrt(-2 * F.log(unit(axis, "r"))) * F.cos(2 * math.pi * unit(axis, "p")) * size

    return rows.select(*[c for c in atoms.columns if c not in AXES],
                       *[(F.col(a) + noise(a)).alias(a) for a in AXES])


# --- sublattices -------------------------------------------------------------

def _position_keys(tol: float) -> list[Column]:
    return [F.round(F.col(a) / tol).cast("long").alias(f"_k{a}") for a in AXES]


def positions_only_in(a: DataFrame, b: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Atoms of ``a`` at positions where ``b`` has none (positions rounded to ``tol``)."""
    keys = [STRUCTURE, *[f"_k{x}" for x in AXES]]
    left = a.select("*", *_position_keys(tol))
    right = b.select(STRUCTURE, *_position_keys(tol)).distinct()
    return left.join(right, keys, "left_anti").select(*a.columns)


def removable_sites(atoms: DataFrame, structures: DataFrame, phase_a: str, phase_b: str,
                    tol: float = 1e-3) -> DataFrame:
    """Atoms of the unit cell that phase b keeps, for the known pairs of cubic phases.

    bcc to sc keeps the corner atoms; diamond to fcc keeps the corner and the atoms
    with a coordinate at half the cell length.
    """
    half = structures.select(STRUCTURE, (F.col("cell")[0][0] / 2).alias("_h"))
    rows = lookup_join(atoms, half, STRUCTURE)
    corner = F.lit(True)
    centred = F.lit(False)
    for a in AXES:
        corner = corner & (F.abs(F.col(a)) <= tol)
        centred = centred | (F.abs(F.col(a) - F.col("_h")) <= tol)
    if (phase_a, phase_b) == ("bcc", "sc"):
        keep = corner
    elif (phase_a, phase_b) == ("diamond", "fcc"):
        keep = corner | centred
    else:
        raise NotImplementedError(f"no known path from {phase_a} to {phase_b}")
    return rows.where(keep).drop("_h")


def _transition_atoms(atoms: DataFrame, structures: DataFrame, phase_a: str, phase_b: str,
                      replicas: DataFrame | Sequence[int]) -> DataFrame:
    """Supercell of phase a with ``_only_a``: whether phase b has no atom there."""
    all_a, _ = supercell(atoms, structures, replicas)
    kept_b, _ = supercell(removable_sites(atoms, structures, phase_a, phase_b), structures, replicas)
    keys = [STRUCTURE, *[f"_k{x}" for x in AXES]]
    held = kept_b.select(STRUCTURE, *_position_keys(1e-3)).distinct().withColumn("_kept", F.lit(True))
    return (all_a.select("*", *_position_keys(1e-3)).join(held, keys, "left")
            .select(*all_a.columns, F.col("_kept").isNull().alias("_only_a")))


def partial_transition(atoms: DataFrame, structures: DataFrame, phase_a: str, phase_b: str,
                       contribution: float, replicas: DataFrame | Sequence[int], seed: int = 42,
                       max_rel_error: float | None = None) -> DataFrame:
    """Supercell of phase a in which a fraction of the atoms absent from phase b is gone.

    With ``max_rel_error``, structures whose possible fraction differs from the wanted one by more than that share of it are
    left out; ``transition_error`` names them.
    """
    rows = cut_lineage(_transition_atoms(atoms, structures, phase_a, phase_b, replicas))
    if max_rel_error is not None:
        fits = _transition_error(rows, contribution, max_rel_error).where("NOT exceeds").select(STRUCTURE)
        rows = lookup_join(rows, fits, STRUCTURE, once=True)
    drawn = draw_atoms(rows.where("_only_a"), contribution, "atom_id", seed).where("NOT _chosen").drop("_chosen")
    return rows.where("NOT _only_a").unionByName(drawn).drop("_only_a")


def _transition_error(rows: DataFrame, contribution: float, max_rel_error: float) -> DataFrame:
    n = rows.groupBy(STRUCTURE).agg(F.count_if("_only_a").alias("n_removable"))
    gone = F.floor(F.col("n_removable") * F.lit(float(contribution)))
    actual = F.try_divide(gone, F.col("n_removable"))
    error = F.abs(F.lit(float(contribution)) - actual) / F.lit(float(contribution))
    return n.select(STRUCTURE, "n_removable", gone.alias("n_removed"), actual.alias("actual_contribution"), error.alias("rel_error"),
                    F.coalesce(error > max_rel_error, F.lit(True)).alias("exceeds"))


def transition_error(atoms: DataFrame, structures: DataFrame, phase_a: str, phase_b: str, contribution: float,
                     replicas: DataFrame | Sequence[int], max_rel_error: float = 0.01) -> DataFrame:
    """Per structure the atoms that can go, those that go, the reached fraction and its relative error.

    A structure without atoms that can go has a null error and exceeds every limit. ``contribution`` is above zero.
    """
    if contribution <= 0:
        raise ValueError("the contribution must be above 0")
    return _transition_error(_transition_atoms(atoms, structures, phase_a, phase_b, replicas), contribution, max_rel_error)


# --- fan-out and parameter tables -------------------------------------------

def apply_operations(tables: tuple[DataFrame, DataFrame],
                     operations: Sequence[tuple[str, Callable, Mapping]]) -> tuple[DataFrame, DataFrame]:
    """Apply every operation to every structure; ``op_id`` tells the outputs apart.

    An operation is ``(name, function, options)`` and maps (atoms, structures) to
    new (atoms, structures).
    """
    out_atoms = out_structures = None
    for name, func, options in operations:
        a, s = func(*tables, **options)
        a, s = a.withColumn("op_id", F.lit(name)), s.withColumn("op_id", F.lit(name))
        out_atoms = a if out_atoms is None else out_atoms.unionByName(a, allowMissingColumns=True)
        out_structures = s if out_structures is None else out_structures.unionByName(s, allowMissingColumns=True)
    return out_atoms, out_structures


def centre_layers(atoms: DataFrame, structures: DataFrame, height: float) -> tuple[DataFrame, DataFrame]:
    """Give flat structures a cell of fixed height with the layer shifted by the
    distance between its mean and the new cell's middle."""
    mean = atoms.groupBy(STRUCTURE).agg(F.avg("z").alias("_mean"))
    moved = lookup_join(atoms, mean, STRUCTURE, once=True).withColumn(
        "z", F.col("z") + F.abs(F.col("_mean") - height / 2)).drop("_mean")
    tall = F.transform("cell", lambda v, i: F.when(
        i == 2, F.array(v[0], v[1], F.lit(float(height)))).otherwise(v))
    return moved.select(*atoms.columns), structures.withColumn("cell", tall)


def parameter_grid(base: DataFrame, name: Column, parameters: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every row of ``base`` with every combination of the listed parameters and a
    file name made of name, parameters and element."""
    out = base
    for p, values in parameters.items():
        out = out.withColumn(p, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.withColumn("file_name", F.concat(
        F.concat_ws("_", name, *parameters, "element"), F.lit(".aims")))


def order_parameter_sweep(structures: DataFrame, lowest: float = 0.0, highest: float = 0.5,
                          steps: int = 104, samples: int = 1) -> DataFrame:
    """Structure x evenly spaced ratios x samples, with a seed per combination."""
    return (structures.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
            .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
            .withColumn("ratio", linspace_value(F.col("step"), lowest, highest, steps))
            .withColumn("seed", F.col("step") * samples + F.col("sample")))


def transition_path(segments: DataFrame, scale: float = 1.0) -> DataFrame:
    """Concatenated linear segments ``(segment, p0, p1, n, is_last)``; only the last
    one includes its end point."""
    last = F.when(F.col("is_last"), F.col("n")).otherwise(F.col("n") - 1)
    return (segments.where(last >= 0).withColumn("i", F.explode(F.sequence(F.lit(0), last)))
            .select("segment", "i", ((F.col("p0") + (F.col("p1") - F.col("p0"))
                                      * F.coalesce(F.try_divide(F.col("i"), F.col("n")), F.lit(0.0)))
                                     * F.lit(float(scale))).alias("value")))
