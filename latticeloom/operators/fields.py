"""Images, volumes, spectra and point sets as long tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.operators.neighbors import fractional, with_inverse_cell
from latticeloom.session import cut_lineage

STRUCTURE = "structure_id"
# X-ray wavelengths in angstrom.
WAVELENGTHS = {"CuKa": 1.54184, "MoKa": 0.71073}


# --- images and volumes ------------------------------------------------------

def radial_mask(value: Column, coords: Sequence[Column], size: int, r_min: float, r_max: float) -> Column:
    """Zero at and inside ``r_min`` and at and outside ``r_max`` about the middle."""
    c = F.lit((size - 1.0) / 2.0)
    r2 = sum(((x - c) * (x - c) for x in coords[1:]), (coords[0] - c) * (coords[0] - c))
    return F.when((r2 <= r_min * r_min) | (r2 >= r_max * r_max), 0.0).otherwise(value)


def channel_sum(pixels: DataFrame, keys: Sequence[str] = ("id", "ch", "i", "j"), value: str = "v") -> DataFrame:
    """Sum of images over rotations within a channel."""
    return pixels.groupBy(*keys).agg(F.sum(value).alias(value))


def image_difference(pristine: DataFrame, other: DataFrame, keys: Sequence[str] = ("i", "j", "ch"),
                     value: str = "v") -> DataFrame:
    """Pixel differences as percent of the pristine maximum."""
    top = pristine.agg(F.max(value)).first()[0]
    a = pristine.select(*keys, F.col(value).alias("_a"))
    b = other.select(*keys, F.col(value).alias("_b"))
    return a.join(b, list(keys)).select(*keys, ((F.col("_b") - F.col("_a")) / F.lit(float(top)) * 100.0).alias("percent"))


def difference_bounds(diff: DataFrame) -> DataFrame:
    """Smallest and largest percentage and the symmetric bound (mean of both sizes)."""
    return diff.agg(F.min("percent").alias("lowest"), F.max("percent").alias("highest")).withColumn(
        "bound", (F.abs("lowest") + F.abs("highest")) / 2)


def centre_of_mass(voxels: DataFrame, key: str = "id", axes: Sequence[str] = ("ix", "iy", "iz"),
                   value: str = "v") -> DataFrame:
    return voxels.groupBy(key).agg(*[
        F.try_divide(F.sum(F.col(value) * F.col(a)), F.sum(value)).alias(f"c_{a}") for a in axes])


def shell_keys(centres: DataFrame, size: int, r_min: float = 32.0, r_max: float = 83.0, dr: float = 1.0,
               phi_bins: int = 100, theta_bins: int = 50, key: str = "id") -> DataFrame:
    """Voxels of concentric shells around each centre: ``(id, shell, ix, iy, iz)``.

    A shell is sampled on a (phi, theta) grid; samples are rounded to voxels (half
    to even) and made distinct; voxels need indices from 0 to below ``size - 1``.
    """
    shells = int((r_max - r_min) / dr) + 1
    grid = lambda n, stop: F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                       lambda i: i * F.lit(stop / max(n - 1, 1)))
    rows = (centres.withColumn("shell", F.explode(F.sequence(F.lit(0), F.lit(shells - 1))))
            .withColumn("_phi", F.explode(grid(phi_bins, 2 * math.pi)))
            .withColumn("_theta", F.explode(grid(theta_bins, math.pi))))
    r = F.lit(float(r_min)) + F.col("shell") * F.lit((r_max - r_min) / max(shells - 1, 1))
    unit = (F.cos("_phi") * F.sin("_theta"), F.sin("_phi") * F.sin("_theta"), F.cos("_theta"))
    at = [F.rint(r * u + F.col(f"c_{a}")).cast("int").alias(a) for u, a in zip(unit, ("ix", "iy", "iz"))]
    return (rows.select(key, "shell", *at)
            .where(F.expr(" and ".join(f"{a} >= 0 and {a} < {size - 1}" for a in ("ix", "iy", "iz"))))
            .dropDuplicates())


def spherical_shells(voxels: DataFrame, size: int, key: str = "id", value: str = "v", **shell_options) -> DataFrame:
    """Shell voxels with theta and phi in degrees about the middle of the volume."""
    keys = shell_keys(centre_of_mass(voxels, key, value=value), size, key=key, **shell_options)
    mid = size / 2.0
    x, y, z = (F.col(a) - mid for a in ("ix", "iy", "iz"))
    r = F.sqrt(x * x + y * y + z * z)
    theta = F.degrees(F.acos(F.try_divide(z, r)))
    return keys.join(voxels.select(key, "ix", "iy", "iz", value), [key, "ix", "iy", "iz"]).select(
        key, "shell", "ix", "iy", "iz", r.alias("r"), theta.alias("theta"),
        F.degrees(F.atan2(y, x)).alias("phi"), value)


# --- spectra -----------------------------------------------------------------

def powder_pattern(atoms: DataFrame, structures: DataFrame, wavelength: str | float = "CuKa",
                   max_index: int = 3) -> DataFrame:
    """Low-order structure sums: ``(structure_id, h, k, l, two_theta, intensity)``.

    A table over the indices -``max_index`` to ``max_index`` of each structure, without
    those beyond the wavelength's reach. It is not a complete pattern: the reach of a
    wavelength can hold higher indices, the more the larger the cell, and they are not
    computed. Intensity is the squared modulus of the sum of ``Z exp(2 pi i hkl.frac)``,
    scaled so that the largest in the table is 100. Z is the atomic number, not a
    tabulated form factor. The sums over atoms are partial sums per task: only one
    row per index triple is shuffled.
    """
    lam = WAVELENGTHS[wavelength] if isinstance(wavelength, str) else float(wavelength)
    s = with_inverse_cell(structures.select(STRUCTURE, "cell"))
    g = [[F.col(f"_g{i}")[k] for k in range(3)] for i in range(3)]
    rows = lookup_join(atoms.select(STRUCTURE, "number", "x", "y", "z"), s, STRUCTURE)
    rows = rows.select(STRUCTURE, "number", *[fractional(i).alias(f"_f{i}") for i in range(3)])
    for h in "hkl":
        rows = rows.withColumn(h, F.explode(F.sequence(F.lit(-max_index), F.lit(max_index))))
    phase = 2 * math.pi * (F.col("h") * F.col("_f0") + F.col("k") * F.col("_f1") + F.col("l") * F.col("_f2"))
    sums = rows.where("h != 0 or k != 0 or l != 0").groupBy(STRUCTURE, "h", "k", "l").agg(
        F.sum(F.col("number") * F.cos(phase)).alias("_re"), F.sum(F.col("number") * F.sin(phase)).alias("_im"))
    wave = [g[0][k] * F.col("h") + g[1][k] * F.col("k") + g[2][k] * F.col("l") for k in range(3)]
    sine = F.lit(lam / 2) * F.sqrt(wave[0] * wave[0] + wave[1] * wave[1] + wave[2] * wave[2])
    peaks = lookup_join(sums, s, STRUCTURE).withColumn("_sin", sine).where(F.col("_sin") <= 1).select(
        STRUCTURE, "h", "k", "l", (2 * F.degrees(F.asin("_sin"))).alias("two_theta"),
        (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("_i"))
    peaks = cut_lineage(peaks)
    top = peaks.groupBy(STRUCTURE).agg(F.max("_i").alias("_top"))
    return peaks.join(top, STRUCTURE).select(
        STRUCTURE, "h", "k", "l", "two_theta", (F.col("_i") / F.col("_top") * 100.0).alias("intensity"))


def harmonics(df: DataFrame, vec: str = "vec", key: str = "id", n_harmonics: int = 158, every: Column | int = 1,
              part: str = "power_spectrum") -> DataFrame:
    """Discrete Fourier coefficients of each row's sequence: ``(id, harmonic, value)``.

    Harmonic m is frequency ``m * every``; the zeroth is skipped, ``n_harmonics - 1``
    are kept as far as positive frequencies go; values are divided by the length
    (its square for the power spectrum).
    """
    if part not in ("real_part", "imaginary_part", "power_spectrum"):
        raise NotImplementedError(f"{part!r} is not real_part, imaginary_part or power_spectrum")
    step = every if isinstance(every, Column) else F.lit(every)
    base = df.select(key, F.col(vec).alias("_v"), F.size(vec).alias("_n"), step.alias("_every"))
    # non-negative frequencies of an n-point transform: 0 .. ceil(n / 2) - 1
    last = F.floor((F.ceil(F.col("_n") / 2) - 1) / F.col("_every")).cast("int")
    rows = base.where(last >= 1).withColumn("harmonic", F.explode(
        F.sequence(F.lit(1), F.least(last, F.lit(n_harmonics - 1)))))
    turn = lambda i: -2 * math.pi * F.col("harmonic") * F.col("_every") * i / F.col("_n")
    total = lambda f: F.aggregate(F.transform("_v", f), F.lit(0.0), lambda a, v: a + v)
    rows = rows.select(key, "harmonic", "_n", total(lambda v, i: v * F.cos(turn(i))).alias("_re"),
                       total(lambda v, i: v * F.sin(turn(i))).alias("_im"))
    value = {"real_part": F.col("_re") / F.col("_n"), "imaginary_part": F.col("_im") / F.col("_n"),
             "power_spectrum": (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")) / (F.col("_n") * F.col("_n"))}
    return rows.select(key, "harmonic", value[part].alias("value"))


# --- local environments ------------------------------------------------------

def _radial(r: Column, n: int, n_max: int, cutoff: float) -> Column:
    """Gaussian of shell n (evenly spaced centres) times a cosine cut-off."""
    centre, width = cutoff * (n + 0.5) / n_max, cutoff / n_max
    return F.exp(-(r - centre) * (r - centre) / (2 * width * width)) * 0.5 * (F.cos(r * (math.pi / cutoff)) + 1)


def _angular(l_max: int, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Real functions S_lm of a unit vector with sum_m S_lm(u) S_lm(v) = P_l(u.v).

    Built by the usual recurrences of the associated Legendre functions, scaled so
    that no factorials appear; cos(m phi) sin^m(theta) comes from powers of x + iy.
    """
    re, im = [F.lit(1.0)], [F.lit(0.0)]
    for m in range(l_max):
        re, im = [*re, re[m] * x - im[m] * y], [*im, re[m] * y + im[m] * x]
    out: list[list[Column]] = [[] for _ in range(l_max + 1)]
    for m in range(l_max + 1):
        start = math.prod((2 * k - 1) / math.sqrt((2 * k - 1) * 2 * k) for k in range(1, m + 1))
        p = {m: F.lit(start)}
        for deg in range(m + 1, l_max + 1):
            value = F.lit((2 * deg - 1) / math.sqrt(deg * deg - m * m)) * z * p[deg - 1]
            if deg - 2 in p:
                value = value - F.lit(math.sqrt(((deg - 1) ** 2 - m * m) / (deg * deg - m * m))) * p[deg - 2]
            p[deg] = value
        for deg, v in p.items():
            if m == 0:
                out[deg].append(v)
            else:
                out[deg] += [F.lit(math.sqrt(2.0)) * v * re[m], F.lit(math.sqrt(2.0)) * v * im[m]]
    return out


def environment_spectrum(pairs: DataFrame, cutoff: float, n_max: int = 9, l_max: int = 6) -> DataFrame:
    """Power spectrum of the neighbourhood of each centre:
    ``sum_ij g_n(r_i) g_n'(r_j) P_l(cos gamma_ij)`` for n <= n'.

    ``pairs`` holds both directions (structure_id, atom_id, dx, dy, dz, r). By the
    addition theorem the double sum over neighbours is a product of single sums, so
    pairs of neighbours are never formed: one aggregation over neighbours, then
    products inside the row.
    """
    return spectrum_of_sums(neighbour_sums(pairs, cutoff, n_max, l_max, [STRUCTURE, "atom_id"]), n_max, l_max, [STRUCTURE, "atom_id"])


def _sum_names(n_max: int, l_max: int) -> list[str]:
    return [f"c{n}_{deg}_{k}" for n in range(n_max) for deg in range(l_max + 1) for k in range(2 * deg + 1)]


def neighbour_sums(pairs: DataFrame, cutoff: float, n_max: int, l_max: int, keys: Sequence[str]) -> DataFrame:
    """Sums over the neighbours within ``cutoff`` of all products of a radial and an angular function, per ``keys``."""
    safe = F.when(F.col("r") > 0, F.col("r")).otherwise(1.0)
    near = pairs.where(F.col("r") <= cutoff).select(
        *keys, *[_radial(F.col("r"), n, n_max, cutoff).alias(f"g{n}") for n in range(n_max)],
        *[(F.col(f"d{a}") / safe).alias(f"u{a}") for a in "xyz"])
    shapes = _angular(l_max, F.col("ux"), F.col("uy"), F.col("uz"))
    near = near.select(*keys, *[f"g{n}" for n in range(n_max)],
                       *[s.alias(f"s{deg}_{k}") for deg, parts in enumerate(shapes) for k, s in enumerate(parts)])
    return near.groupBy(*keys).agg(*[F.sum(F.col(name.split("_", 1)[0].replace("c", "g")) * F.col("s" + name.split("_", 1)[1])).alias(name)
                                     for name in _sum_names(n_max, l_max)])


def added_sums(sums: DataFrame, n_max: int, l_max: int, keys: Sequence[str]) -> DataFrame:
    """Sums of parts of a neighbourhood, added up per ``keys``."""
    return sums.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in _sum_names(n_max, l_max)])


def spectrum_of_sums(sums: DataFrame, n_max: int, l_max: int, keys: Sequence[str]) -> DataFrame:
    value = [sum((F.col(f"c{n}_{deg}_{k}") * F.col(f"c{q}_{deg}_{k}") for k in range(1, 2 * deg + 1)),
                 F.col(f"c{n}_{deg}_0") * F.col(f"c{q}_{deg}_0"))
             for n in range(n_max) for q in range(n, n_max) for deg in range(l_max + 1)]
    return sums.select(*keys, F.array(*value).alias("value"))


def spectrum_index(n_max: int, l_max: int) -> list[tuple[int, int, int]]:
    """Meaning (n, n', l) of each component of the spectrum."""
    return [(n, q, deg) for n in range(n_max) for q in range(n, n_max) for deg in range(l_max + 1)]


def average_spectrum(spectra: DataFrame, length: int, normalise: bool = True) -> DataFrame:
    """Mean over the centres of a structure, normalised to length 1."""
    mean = spectra.groupBy(STRUCTURE).agg(*[F.avg(F.col("value")[i]).alias(f"v{i}") for i in range(length)],
                                          F.count(F.lit(1)).alias("n_centres"))
    vec = F.array(*[F.col(f"v{i}") for i in range(length)])
    if normalise:
        norm = F.sqrt(sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(1, length)), F.col("v0") * F.col("v0")))
        vec = F.transform(vec, lambda v: F.try_divide(v, norm))
    return mean.select(STRUCTURE, "n_centres", vec.alias("value"))


# --- point sets --------------------------------------------------------------

def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    pts = sorted(set(points))
    if len(pts) <= 2:
        return pts

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) >= 2 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                     - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(reversed(pts))


#: Directions in counter-clockwise order, from the least x on.
_ROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def _side(ax, ay, bx, by, x, y):
    """Above 0 to the left of the line from a to b."""
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax)


def convex_hulls(points: DataFrame, label: str, x: str = "x", y: str = "y", most: int = 20_000) -> DataFrame:
    """Hull corners of each class in counter-clockwise order from the least x: ``(label, corner, x, y)``.

    The points of a class that lie farthest in eight directions are corners. Points inside their polygon are dropped; each
    other one lies beyond one side, and what is hull beyond a side depends on the points there alone. A side with more
    than ``most`` points is split at its farthest point, which drops the points inside the triangle, until none is left; then each
    side is finished by itself. So the corners of a class, however many, never meet in one task. A class with one distinct
    point has no hull; null classes are a class, points with a null coordinate are left out.
    """
    at = points.select(F.struct(F.col(label)).alias("c"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    far = [F.max(F.struct((F.col("x") * u + F.col("y") * v).alias("d"), (F.col("y") * u - F.col("x") * v).alias("t"), "x", "y")).alias(f"e{k}")
           for k, (u, v) in enumerate(_ROUND)]
    ends = cut_lineage(at.groupBy("c").agg(*far).select(
        "c", *[F.col(f"e{k}.{n}").alias(f"{n}{k}") for k in range(8) for n in "xy"]))
    # one row a class; a class with a third of the points is split by the planner
    side = F.lit(None).cast("int")
    for k in reversed(range(8)):
        n = (k + 1) % 8
        side = F.when(_side(*(F.col(f"{c}{i}") for i in (k, n) for c in "xy"), F.col("x"), F.col("y")) < 0, k).otherwise(side)
    beyond = lookup_join(at, ends, "c").select("c", side.alias("k"), "x", "y", *[f"{n}{i}" for i in range(8) for n in "xy"]).where("k IS NOT NULL")
    pick = lambda n, step: F.get(F.array(*[F.col(f"{n}{(i + step) % 8}") for i in range(8)]), F.col("k"))
    rows = cut_lineage(beyond.select("c", F.col("k").cast("string").alias("path"), pick("x", 0).alias("ax"), pick("y", 0).alias("ay"),
                                     pick("x", 1).alias("bx"), pick("y", 1).alias("by"), "x", "y"))
    same = lambda i, j: (F.col(f"x{i}") == F.col(f"x{j}")) & (F.col(f"y{i}") == F.col(f"y{j}"))
    start = F.filter(F.array(*[F.when(F.lit(True) if k == 0 else ~same(k, k - 1) & ~same(k, 0), F.struct(
        F.lit(str(k)).alias("path"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))) for k in range(8)]), lambda s: s.isNotNull())
    # a class of one place has one corner and no hull
    corners = ends.where(F.size(start) > 1).select("c", F.explode(start).alias("s")).select("c", "s.path", F.lit(-1).alias("place"), "s.x", "s.y")
    sides = ["c", "path", "ax", "ay", "bx", "by"]
    while True:
        large = cut_lineage(rows.groupBy(*sides).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(
            (-_side(*(F.col(n) for n in sides[2:]), F.col("x"), F.col("y"))).alias("d"),
            ((F.col("bx") - F.col("ax")) * F.col("x") + (F.col("by") - F.col("ay")) * F.col("y")).alias("t"), "x", "y")).alias("f")).where(F.col("n") > most))
        if large.isEmpty():
            break
        split = lookup_join(rows, large.select("c", "path", F.col("f.x").alias("fx"), F.col("f.y").alias("fy")), ["c", "path"], "left")
        ours, xy = F.col("fx").isNotNull(), (F.col("x"), F.col("y"))
        first = _side(F.col("ax"), F.col("ay"), F.col("fx"), F.col("fy"), *xy) < 0
        second = _side(F.col("fx"), F.col("fy"), F.col("bx"), F.col("by"), *xy) < 0
        part = F.when(~ours, "").when(first, "0").when(second, "1")
        corners = corners.unionByName(large.select("c", F.concat("path", F.lit("1")).alias("path"), F.lit(-1).alias("place"), "f.x", "f.y"))
        one, two = ours & first, ours & ~first
        rows = cut_lineage(split.withColumn("_p", part).where(F.col("_p").isNotNull()).select(
            "c", F.concat("path", "_p").alias("path"), F.when(two, F.col("fx")).otherwise(F.col("ax")).alias("ax"),
            F.when(two, F.col("fy")).otherwise(F.col("ay")).alias("ay"), F.when(one, F.col("fx")).otherwise(F.col("bx")).alias("bx"),
            F.when(one, F.col("fy")).otherwise(F.col("by")).alias("by"), "x", "y"))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf["ax"].iloc[0], pdf["ay"].iloc[0]), (pdf["bx"].iloc[0], pdf["by"].iloc[0])
        hull = _hull([a, b, *zip(pdf["x"], pdf["y"])])
        hull = hull[hull.index(a):] + hull[:hull.index(a)]
        inner = hull[1:hull.index(b)]
        return pd.DataFrame({"id": pdf["id"].iloc[0], "path": pdf["path"].iloc[0], "place": range(len(inner)),
                             "x": [q[0] for q in inner], "y": [q[1] for q in inner]})

    # classes travel as numbers, whatever their type
    named = ends.select("c", F.monotonically_increasing_id().alias("id"))
    finished = (lookup_join(rows, named, "c").select("id", *sides[1:], "x", "y").groupBy("id", "path")
                .applyInPandas(finish, "id long, path string, place int, x double, y double"))
    every = cut_lineage(lookup_join(corners, named, "c").select("id", "path", "place", "x", "y").unionByName(finished))
    every = _without_flat_starts(every)
    per_side = every.groupBy("id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)      # sides, not points
    first = per_side.select("id", "path", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("first"))
    numbered = lookup_join(lookup_join(every, first, ["id", "path"]), named, "id")
    return numbered.select(F.col(f"c.{label}").alias(label), (F.col("first") + F.col("place")).cast("int").alias("corner"), "x", "y")


def _without_flat_starts(corners: DataFrame) -> DataFrame:
    """Drop starts of sides that rounding made corners though they lie on the line between their neighbours."""
    ends = corners.groupBy("id", "path").agg(
        F.min_by(F.struct("x", "y"), F.when(F.col("place") >= 0, F.col("place"))).alias("after"), F.max_by(F.struct("x", "y"), "place").alias("last"),
        F.min_by(F.struct("x", "y"), F.when(F.col("place") < 0, F.col("place"))).alias("start"), F.max("place").alias("top"))
    ends = ends.withColumn("head", F.coalesce("start", "after"))
    around = Window.partitionBy("id").orderBy("path")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("id", "path", "start",
                       F.coalesce(F.lag("last").over(around), F.last("last").over(whole)).alias("prev"),
                       F.coalesce(F.when(F.col("top") >= 0, F.col("after")), F.lead("head").over(around), F.first("head").over(whole)).alias("next"))
    turn = _side(F.col("prev.x"), F.col("prev.y"), F.col("start.x"), F.col("start.y"), F.col("next.x"), F.col("next.y"))
    # with two corners in all, both ends are neighbours of each other
    flat = ends.where((turn <= 0) & (F.col("prev") != F.col("next"))).select("id", "path", F.lit(-1).alias("place"))
    return corners.join(flat, ["id", "path", "place"], "left_anti")
