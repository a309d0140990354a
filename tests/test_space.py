"""Laws of crystals and exact checks of the spatial searches by brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticeloom.operators import boxes as B
from latticeloom.operators import boxgrid as G
from latticeloom.operators import features, fields
from latticeloom.operators import neighbors as N
from latticeloom.operators import structures as S
from latticeloom.plans.analysis import EnvironmentDescriptor, box_descriptors, descriptor_table

# fractional bases and cell edges of cubic crystals
NACL = ([("Na", 11, (0, 0, 0)), ("Na", 11, (0, .5, .5)), ("Na", 11, (.5, 0, .5)), ("Na", 11, (.5, .5, 0)),
         ("Cl", 17, (.5, .5, .5)), ("Cl", 17, (.5, 0, 0)), ("Cl", 17, (0, .5, 0)), ("Cl", 17, (0, 0, .5))], 5.64)
FCC = ([("Al", 13, (0, 0, 0)), ("Al", 13, (0, .5, .5)), ("Al", 13, (.5, 0, .5)), ("Al", 13, (.5, .5, 0))], 4.05)
BCC = ([("Fe", 26, (0, 0, 0)), ("Fe", 26, (.5, .5, .5))], 2.87)


def crystal(spark, *items, pbc=True):
    """(atoms, structures) of named (basis, edge) crystals."""
    atoms, cells = [], []
    for name, (basis, a) in items:
        cells.append((name, [[a, 0.0, 0.0], [0.0, a, 0.0], [0.0, 0.0, a]], [pbc] * 3))
        atoms += [(name, i, z, s, *(float(a * f) for f in frac)) for i, (s, z, frac) in enumerate(basis)]
    return (spark.createDataFrame(atoms, "structure_id string, atom_id long, number int, symbol string, x double, y double, z double"),
            spark.createDataFrame(cells, "structure_id string, cell array<array<double>>, pbc array<boolean>"))


def unique_atoms(atoms):
    return atoms.withColumn("atom_id", F.col("atom_id") * 1000 + F.col("replica")).drop("replica")


def cloud(spark, n=300, seed=0, clusters=False):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 10, (n, 3))
    if clusters:                       # a third in a tiny ball, some exactly coincident
        x[: n // 3] = 5 + rng.normal(0, 1e-4, (n // 3, 3))
        x[:5] = x[0]
    pdf = pd.DataFrame(x, columns=list("xyz"))
    pdf.insert(0, "structure_id", "s")
    pdf.insert(1, "atom_id", range(n))
    pdf.insert(2, "number", rng.integers(1, 4, n).astype("int32"))
    return spark.createDataFrame(pdf), x, pdf["number"].to_numpy()


def distances(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("clusters", [False, True])
def test_nearest_distances_match_brute_force(spark, monkeypatch, clusters):
    monkeypatch.setattr(N, "CROWDED", 8)
    atoms, x, _ = cloud(spark, 300, clusters=clusters)
    got = N.nearest_distances(atoms, 3.0).toPandas()
    want = distances(x).min(1)
    want = np.where(want <= 3.0, want, np.nan)
    spread = np.repeat(got["nn"].to_numpy(), got["n_atoms"])
    assert len(spread) == 300
    assert np.allclose(np.sort(spread), np.sort(want), equal_nan=True)


def test_nearest_of_a_species(spark, monkeypatch):
    monkeypatch.setattr(N, "CROWDED", 8)
    atoms, x, z = cloud(spark, 200)
    got = N.nearest_distances(atoms, 4.0, None, 1, 2).toPandas().set_index("atom_id")["nn"]
    d = distances(x)[z == 1][:, z == 2].min(1)
    want = pd.Series(np.where(d <= 4.0, d, np.nan), index=np.flatnonzero(z == 1))
    assert np.allclose(got.loc[want.index], want, equal_nan=True)


@pytest.mark.parametrize("clusters", [False, True])
def test_minimum_distance(spark, clusters):
    atoms, x, _ = cloud(spark, 200, 3, clusters)
    assert N.minimum_distance(atoms).first()["min_distance"] == pytest.approx(distances(x).min(), abs=1e-15)


def test_minimum_distance_of_a_tight_pair(spark):
    x = np.vstack([np.random.default_rng(1).uniform(0, 1e3, (100, 3)), [[1, 1, 1], [1, 1, 1 + 1e-6]]])
    pdf = pd.DataFrame(x, columns=list("xyz")).assign(structure_id="s", atom_id=range(102), number=1)
    assert N.minimum_distance(spark.createDataFrame(pdf)).first()["min_distance"] == pytest.approx(1e-6, rel=1e-6)


def test_pairs_match_brute_force(spark):
    atoms, x, _ = cloud(spark, 250, 2)
    d = distances(x)
    assert N.neighbour_pairs(atoms, 1.3).count() == (d <= 1.3).sum()
    half = N.neighbour_pairs(atoms, 1.3, half=True).toPandas()
    assert len(half) == (d <= 1.3).sum() // 2 and (half["atom_id"] < half["other_id"]).all()
    assert np.allclose(half["r"], d[half["atom_id"], half["other_id"]])
    shift = x[half["other_id"]] - x[half["atom_id"]]
    assert np.allclose(shift, half[["dx", "dy", "dz"]])


def test_coordination_numbers(spark):
    atoms, cells = crystal(spark, ("fcc", FCC), ("bcc", BCC), ("nacl", NACL))
    for name, r, n in (("fcc", 3.0, 12), ("bcc", 2.6, 8), ("nacl", 3.0, 6)):
        one = atoms.where(F.col("structure_id") == name)
        pairs = N.neighbour_pairs(one, r, cells.where(F.col("structure_id") == name))
        assert pairs.count() == n * one.count()


def test_length_scale_of_fcc_and_its_supercell(spark):
    atoms, cells = crystal(spark, ("cu", (FCC[0], 3.6)))
    nn = 3.6 / 2 ** 0.5
    small = N.length_scale(atoms, 4.0, structures=cells).first()["length_scale"]
    big_atoms, big_cells = S.supercell(atoms, cells, (3, 3, 3))
    big = N.length_scale(unique_atoms(big_atoms), 4.0, structures=big_cells).first()["length_scale"]
    # all distances equal: the histogram is one wide about them
    assert small == pytest.approx(nn + 0.005, abs=0.0051) and big == pytest.approx(small, abs=0.0101)


def test_zero_distance_gives_infinite_score(spark):
    pdf = pd.DataFrame({"structure_id": "s", "nn": [0.0, 1.0, 1.0, 1.0], "n_atoms": 1})
    best = N._scale_of(spark.createDataFrame(pdf), ["structure_id"], "quantile_nn", 100).first()["length_scale"]
    assert best == pytest.approx(0.005)


def test_pair_species_count_and_translation(spark):
    atoms, cells = crystal(spark, ("nacl", NACL))
    pairs = N.pair_distances(atoms, cells, 6.0)
    assert pairs.select("z1", "z2").distinct().count() == 3          # n (n + 1) / 2
    assert N.pair_distances(atoms, cells, 6.0, ignore_species=True).select("z1", "z2").distinct().count() == 1
    moved = atoms.select("structure_id", "atom_id", "number", "symbol", (F.col("x") + 3.0).alias("x"),
                         (F.col("y") + 2.5).alias("y"), (F.col("z") + 7.0).alias("z"))
    a, b = (sorted(r["r"] for r in N.pair_distances(t, cells, 6.0).collect()) for t in (atoms, moved))
    assert np.allclose(a, b)


def test_periodic_pairs_match_explicit_images(spark):
    atoms, cells = crystal(spark, ("nacl", NACL))
    got = N.pair_distances(atoms, cells, 7.0).groupBy("z1", "z2").count().toPandas().set_index(["z1", "z2"])["count"]
    basis, a = NACL
    want = {}
    for i, (_, z1, f1) in enumerate(basis):
        for j, (_, z2, f2) in list(enumerate(basis))[i:]:
            for t in itertools.product(range(-3, 4), repeat=3):
                r = np.linalg.norm((np.array(f2) + t - np.array(f1)) * a)
                if 0 < r <= 7.0:
                    key = (min(z1, z2), max(z1, z2))
                    want[key] = want.get(key, 0) + 1
    assert got.to_dict() == want


def test_non_periodic_pairs_are_rejected(spark):
    atoms, cells = crystal(spark, ("mol", FCC), pbc=False)
    with pytest.raises(NotImplementedError):
        N.pair_distances(atoms, cells)


def test_design_matrix_has_unit_area(spark):
    atoms, cells = crystal(spark, ("nacl", NACL))
    m = N.pair_design_matrix(N.pair_distances(atoms, cells, 8.0), 17, 20, 9.0).toPandas()
    width = 9.0 ** ((m["bin"] + 1) / 20) - 9.0 ** (m["bin"] / 20)
    assert np.allclose((m["value"] * width).groupby([m["z1"], m["z2"]]).sum(), 1.0)


def test_fcc_bonds_have_one_signature(spark):
    atoms, cells = crystal(spark, ("al", FCC))
    big, _ = S.supercell(atoms, cells, (4, 4, 4))
    big = unique_atoms(big)
    sig = N.common_neighbour_signatures(big, 3.2)
    # an inner atom of fcc has twelve bonds, each with 4 shared neighbours and 2 bonds
    inner = N.signature_counts(sig).where("n = 12 and n_common = 4 and n_bonds = 2").count()
    full = N.neighbour_pairs(big, 3.2).groupBy("atom_id").count().where("count = 12").count()
    assert full > 0 and inner >= 1 and inner <= full


def test_signatures_of_repeated_and_missing_rows(spark, monkeypatch):
    """As the bonds joined give them: repeated rows, ids at two places, null ids and places, cells cut into several groups."""
    rng = np.random.default_rng(3)
    rows = [(s, i, 1, *map(float, rng.normal(size=3) * 0.15)) for s in "ab" for i in range(40)]
    rows += [("c", *r[1:]) for r in rows[:40]]
    rows += rows[:40:5] + rows[:2] + [("a", None, 1, 0.0, 0.0, 0.0), ("a", 90, 1, None, 0.0, 0.0), (None, 91, 1, 0.0, 0.0, 0.0)]
    schema = "structure_id string, atom_id long, number int, x double, y double, z double"
    for group, held, more in ((256, 4_000_000, []), (3, 50, [("b", 5, 1, 0.05, 0.0, 0.0)])):     # "c" has no repeated row
        monkeypatch.setattr(N, "CENTRES", group)
        monkeypatch.setattr(N, "HELD_BONDS", held)
        atoms = spark.createDataFrame(rows + more, schema)
        got, want = N.common_neighbour_signatures(atoms, 0.2), N._signatures_by_join(atoms, 0.2)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


@pytest.mark.parametrize("few,held", [(1_000, 4_000_000), (0, 4_000_000), (0, 500), (1_000, 500)])
def test_counts_of_one_atom_against_brute_force(monkeypatch, few, held):
    """Products and words of bits, in one part and in several; places far from the origin, and distances of just the radius."""
    monkeypatch.setattr(N, "FEW_NEIGHBOURS", few)
    monkeypatch.setattr(N, "HELD_BONDS", held)
    rng = np.random.default_rng(8)
    for n, grid, origin in itertools.product((1, 64, 65, 300), (False, True), (0.0, 1e5)):
        v = rng.normal(size=(n, 3))
        v *= 0.2 * rng.uniform(size=(n, 1)) ** (1 / 3) / np.linalg.norm(v, axis=1, keepdims=True)
        at = origin + (np.round(v * 20) / 20 if grid else v)
        apart = np.square(at[:, None, 0] - at[None, :, 0]) + np.square(at[:, None, 1] - at[None, :, 1]) + np.square(at[:, None, 2] - at[None, :, 2])
        bonded = np.sqrt(apart) <= 0.2
        np.fill_diagonal(bonded, False)
        counts = bonded.astype(float)
        for above in {0, n // 2}:
            shared, inner = N._shared_and_inner(at, np.full(3, origin), above, 0.2)
            assert np.array_equal(shared, counts[above:].sum(axis=1))
            assert np.array_equal(inner, ((counts[above:] @ counts) * counts[above:]).sum(axis=1) / 2)


def test_signature_counts_of_crowded_atoms(spark, monkeypatch):
    """Atoms with more neighbours than a product is made for are counted as the joined bonds are."""
    monkeypatch.setattr(N, "FEW_NEIGHBOURS", 20)
    rng = np.random.default_rng(9)
    rows = [(s, i, 1, *map(float, rng.normal(size=3) * 0.08)) for s in "ab" for i in range(90)]
    atoms = spark.createDataFrame(rows, "structure_id string, atom_id long, number int, x double, y double, z double")
    got, want = (N.signature_counts(f(atoms, 0.18)) for f in (N.common_neighbour_signatures, N._signatures_by_join))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 1000


def test_signatures_shuffle_no_cliques(spark):
    """What is stored and shuffled grows with the atoms, never with their triangles and cliques."""
    atoms = spark.range(60).selectExpr("'s' AS structure_id", "id AS atom_id", "1 AS number", "id / 1000 AS x", "0D AS y", "0D AS z")
    got = N.common_neighbour_signatures(atoms, 0.2)
    assert {tuple(r) for r in got.select("n_common", "n_bonds").distinct().collect()} == {(58, 58 * 57 // 2)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "FlatMapCoGroupsInArrow" in plan


# --- descriptors -------------------------------------------------------------

def spectrum(atoms, cells=None, r=4.5):
    out = fields.average_spectrum(fields.environment_spectrum(N.neighbour_pairs(atoms, r, cells), r, 3, 3), 24)
    return np.array(out.orderBy("structure_id").first()["value"])


def test_spectrum_is_invariant(spark):
    atoms, cells = crystal(spark, ("nacl", NACL))
    base = spectrum(atoms, cells)
    big, big_cells = S.supercell(atoms, cells, (2, 1, 1))
    assert np.allclose(base, spectrum(unique_atoms(big), big_cells), atol=1e-9)
    cloud_atoms, _, _ = cloud(spark, 60, 5)
    one = spectrum(cloud_atoms)
    assert np.allclose(one, spectrum(S.euler_rotate(cloud_atoms, 20, 50, 70)), atol=1e-9)
    moved = cloud_atoms.withColumn("x", F.col("x") + 4.0)
    assert np.allclose(one, spectrum(moved), atol=1e-9)
    assert np.linalg.norm(one) == pytest.approx(1.0)


def test_descriptor_tells_crystals_apart_and_fills_gaps(spark):
    atoms, cells = crystal(spark, ("bcc", BCC), ("fcc", FCC), ("empty", ([], 3.0)))
    desc = EnvironmentDescriptor(2.5, 2, 4, "avg_nn", (6.0,))
    out = {r["structure_id"]: np.array(r["value"]) for r in descriptor_table(desc, atoms, cells).collect()}
    assert np.isnan(out["empty"]).all() and len(out["empty"]) == desc.length
    assert np.linalg.norm(out["bcc"] - out["fcc"]) > 0.001


def test_powder_pattern_of_fcc(spark):
    atoms, cells = crystal(spark, ("al", FCC))
    out = fields.powder_pattern(atoms, cells, "CuKa", 2).toPandas()
    mixed = out[["h", "k", "l"]].abs().mod(2).sum(axis=1).isin([1, 2])
    assert np.allclose(out.loc[mixed, "intensity"], 0, atol=1e-9) and out["intensity"].max() == pytest.approx(100)
    first = out[(out[["h", "k", "l"]].abs() == 1).all(axis=1)]["two_theta"]
    assert np.allclose(first, 2 * np.degrees(np.arcsin(1.54184 * 3 ** 0.5 / (2 * 4.05))))


def test_harmonics_match_fft(spark):
    v = np.random.default_rng(0).normal(size=(4, 31))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, vec array<double>")
    for part, f in (("real_part", lambda s: s.real / 31), ("imaginary_part", lambda s: s.imag / 31),
                    ("power_spectrum", lambda s: abs(s) ** 2 / 31 ** 2)):
        got = fields.harmonics(df, n_harmonics=6, every=3, part=part).orderBy("id", "harmonic").toPandas()
        want = f(np.fft.fft(v)[:, :16][:, ::3])[:, 1:6]
        assert np.allclose(got["value"].to_numpy().reshape(4, -1), want)


# --- boxes -------------------------------------------------------------------

def test_boxes_match_a_plain_scan(spark):
    atoms, x, _ = cloud(spark, 400, 9)
    src = atoms.withColumnRenamed("structure_id", "source")
    box, stride = (3.0, 4.0, 10.0), (2.0, 3.5, 7.0)
    g = B.box_grid(src, box, stride, (0.5, 0.0, 0.0))
    row = g.first()
    pops = B.box_populations(B.assign_boxes(src, g, box, stride), g).toPandas()
    for r in pops.itertuples():
        lo = np.array([row["start_x"] + r.jx * stride[0], row["start_y"] + r.iy * stride[1], row["start_z"] + r.kz * stride[2]])
        assert r.n_atoms == ((x >= lo) & (x <= lo + box)).all(1).sum()
    assert len(pops) == row["n_x"] * row["n_y"] * row["n_z"]
    assert row["start_x"] + (row["n_x"] - 1) * 2.0 + 3.0 >= x[:, 0].max() + 1.5


def test_box_edges_and_gaps(spark):
    pts = [(float(i), 0.0, 0.0) for i in range(11)]
    src = spark.createDataFrame([("s", i, *p) for i, p in enumerate(pts)], "source string, atom_id int, x double, y double, z double")
    g = B.box_grid(src, (2.0, 1.0, 1.0), (4.0, 1.0, 1.0), adapt=False)
    pops = B.box_populations(B.assign_boxes(src, g, (2.0, 1.0, 1.0), (4.0, 1.0, 1.0)), g).orderBy("jx").toPandas()
    assert list(pops["n_atoms"]) == [3, 3, 3]          # edges count at both ends; 3 and 7 lie in gaps


def test_box_descriptors_keep_thin_boxes(spark):
    atoms, x, _ = cloud(spark, 120, 4)
    src = atoms.withColumnRenamed("structure_id", "source")
    desc = EnvironmentDescriptor(3.0, 2, 2, "avg_nn", (8.0,), periodic=False)
    out = box_descriptors(src, desc, (5.0,) * 3, (5.0,) * 3, (0.0,) * 3, min_atoms=14).toPandas()
    nan = out["value"].map(lambda v: np.isnan(v).all())
    assert nan.any() and not nan.all() and (nan | (out["n_atoms"] > 14)).all()


def test_box_searches(spark):
    atoms, _, _ = cloud(spark, 500, 6)
    src = atoms.withColumnRenamed("structure_id", "source")
    size = G.optimal_box_size(src, (2.0,) * 3, 40, 5, 5, step=0.5, stride=(3.0, 3.0, 3.0))
    n = B.typical_population(B.populations(src, size, (3.0,) * 3)).first()["n_typical"]
    assert n - 5 <= 40 <= n + 5
    edge, median, std = G.grown_box_size(src, 20)
    assert median >= 20 and std > 0


# --- transformations ---------------------------------------------------------

def test_supercell_counts_and_wrap(spark):
    atoms, cells = crystal(spark, ("nacl", NACL))
    big, big_cells = S.supercell(atoms, cells, S.replicas_by_atoms(atoms, cells, 128))
    assert big.count() == 144          # 3 x 3 x 2 cells: the first size that reaches 128
    edge = big_cells.first()["cell"]
    r = big.agg(*[F.max(a) for a in "xyz"], *[F.min(a) for a in "xyz"]).first()
    assert all(r[i] < edge[i][i] for i in range(3)) and min(r[3:]) >= -1e-9


def test_replica_errors(spark):
    atoms, cells = crystal(spark, ("nacl", NACL))
    with pytest.raises(Exception, match="stays below"):
        S.replicas_by_radius(atoms, cells, (6.0, 6.0, 6.0), 100).collect()
    with pytest.raises(ValueError):
        S.create_vacancies(atoms, 1.0)
    with pytest.raises(NotImplementedError):
        S.displace_atoms(atoms, "cauchy", 1.0)
    with pytest.raises(NotImplementedError):
        S.removable_sites(atoms, cells, "hcp", "fcc")


def test_displacements(spark):
    atoms, x, _ = cloud(spark, 3000, 8)
    g = S.displace_atoms(atoms, "gaussian", 0.5).orderBy("atom_id").toPandas()[list("xyz")].to_numpy() - x
    u = S.displace_atoms(atoms, "uniform", 0.5).orderBy("atom_id").toPandas()[list("xyz")].to_numpy() - x
    assert abs(g.std() - 0.5) < 0.02 and abs(g.mean()) < 0.03
    assert abs(u).max() <= 0.5 and abs(u.std() - 0.5 / 3 ** 0.5) < 0.02


def test_bcc_to_sc(spark):
    atoms, cells = crystal(spark, ("fe", BCC))
    left = S.partial_transition(atoms, cells, "bcc", "sc", 1.0 - 1e-9, (2, 2, 2))
    assert left.count() == 16 - 7
    assert S.partial_transition(atoms, cells, "bcc", "sc", 0.5, (2, 2, 2)).count() == 12


def test_features_ignore_the_size_of_a_structure(spark):
    atoms, cells = crystal(spark, ("nacl", NACL), ("al", FCC))
    el = spark.createDataFrame([("Na", 2.8, 1.0), ("Cl", 8.3, 17.0), ("Al", 3.2, 13.0)], "symbol string, en double, g double")
    small = features.atomic_feature_table(atoms, el, ["en", "g"], "en").toPandas().set_index("structure_id")
    big, _ = S.supercell(atoms, cells, (2, 2, 2))
    again = features.atomic_feature_table(big, el, ["en", "g"], "en").toPandas().set_index("structure_id")
    assert small.sort_index().equals(again.sort_index())
    assert small.loc["nacl", "ordered_chemical_symbols"] == "NaCl" and small.loc["al", "g(B)"] == 13.0
    three = atoms.withColumn("symbol", F.when(F.col("atom_id") == 1, "X").when(F.col("atom_id") == 2, "Y").otherwise("Na"))
    with pytest.raises(Exception, match="more than two species"):
        features.atomic_feature_table(three, el, ["en", "g"], "en").collect()


def test_integral_grid_equals_counting_each_box(spark):
    rng = np.random.default_rng(11)
    rows = [(s, *map(float, p)) for s, n, w in (("a", 400, 9.0), ("b", 30, 3.0), ("c", 1, 1.0)) for p in rng.uniform(0, w, (n, 3)).round(1)]
    rows += [("a", 0.0, 0.0, 0.0)] * 50 + [("a", None, 1.0, 1.0)]
    atoms = spark.createDataFrame(rows, "source string, x double, y double, z double")
    widths = [(0.5, 0.5, 0.5), (1.0, 2.5, 4.0), (20.0, 3.0, 0.25)]
    sizes = spark.createDataFrame([(s, i, *w) for s in "abc" for i, w in enumerate(widths)],
                                  "source string, size_id int, width_x double, width_y double, width_z double")
    for stride, pad in (((0.7, 1.0, 0.4), None), ((3.0, 0.3, 1.0), (0.5, 0.0, 1.0))):
        got = {(r["source"], r["size_id"], r["n_atoms"]): r["n"] for r in G.population_histograms(atoms, sizes, stride, pad).collect()}
        want = {}
        for i, w in enumerate(widths):
            for r in B.populations(atoms.withColumn("atom_id", F.lit(1)), w, stride, pad).groupBy("source", "n_atoms").count().collect():
                want[r["source"], i, r["n_atoms"]] = r["count"]
        assert got == want


def test_box_sizes_per_source(spark):
    rng = np.random.default_rng(3)
    rows = [(s, *map(float, p)) for s, n in (("dense", 900), ("thin", 60)) for p in rng.uniform(0, 6, (n, 3))]
    atoms = spark.createDataFrame(rows, "source string, x double, y double, z double")
    got = {r["source"]: r for r in G.optimal_box_sizes(atoms, (2.5,) * 3, 20, 4, 4, 40, 0.1, (1.5,) * 3).collect()}
    for s, r in got.items():
        typical = lambda w: (lambda t: t["n_typical"] if t else 0.0)(B.typical_population(
            B.populations(atoms.where(F.col("source") == s).withColumn("atom_id", F.lit(1)), [w] * 3, (1.5,) * 3)).first())
        assert r["n_typical"] == typical(r["width_x"]) and abs(r["n_typical"] - 20) <= 4
        back = -1 if r["size_id"] > 0 else 1
        assert r["size_id"] == 0 or abs(typical(2.5 + (r["size_id"] + back) * 0.1) - 20) > 4
    assert got["dense"]["size_id"] != got["thin"]["size_id"]
    none = G.optimal_box_sizes(atoms, (2.0,) * 3, 5000, 4, 4, 3, 0.1, (1.5,) * 3).collect()
    assert len(none) == 2 and all(r["size_id"] is None for r in none)


@pytest.mark.parametrize("options", [{"scaling": None}, {"scaling": "avg_nn", "scaling_radii": (8.0,)}, {"scaling": "quantile_nn", "scaling_radii": (1.0, 8.0)},
                                     {"scaling": None, "min_atoms": 4}, {"scaling": "avg_nn", "scaling_radii": (8.0,), "min_atoms": 4}])
def test_pairs_handed_to_boxes_give_the_same_descriptors(spark, options):
    rng = np.random.default_rng(2)
    rows = [(s, i, int(rng.integers(1, 3)), *map(float, p)) for s, n, w in (("a", 150, 8.0), ("b", 20, 8.0)) for i, p in enumerate(rng.uniform(0, w, (n, 3)))]
    rows += [("a", 1000 + i, 1, 2.0, 2.0, 2.0) for i in range(3)]                     # atoms at one place
    atoms = spark.createDataFrame(rows, "source string, atom_id long, number int, x double, y double, z double")
    desc = EnvironmentDescriptor(2.0, 2, 2, periodic=False, **options)

    class Plain:
        name, params, length = desc.name, desc.params, desc.length
        calculate = desc.calculate

    got, want = ({r["structure_id"]: r["value"] for r in box_descriptors(atoms, d, (4.0, 4.0, 4.0), (1.5, 2.0, 3.0), (0.0,) * 3).collect()}
                 for d in (desc, Plain()))
    assert got.keys() == want.keys() and len(got) > 60
    for k in got:
        assert np.allclose(got[k], want[k], equal_nan=True, atol=1e-9), k
    assert sum(not np.isnan(v).any() for v in got.values()) > 20


def test_periodic_cell_list_equals_images(spark):
    rng = np.random.default_rng(9)
    cells = {"cubic": (np.eye(3) * 4.0, (True,) * 3), "skewed": (np.array([[3.0, 0, 0], [2.4, 2.0, 0], [-1.1, 1.3, 1.7]]), (True,) * 3),
             "slab": (np.array([[2.0, 0, 0], [1.5, 2.5, 0], [0, 0, 0]]), (True, True, False)), "open": (np.eye(3) * 5.0, (False,) * 3),
             "tiny": (np.diag([0.7, 1.1, 9.0]), (True,) * 3)}
    rows, place = [], {}
    for name, (cell, pbc) in cells.items():
        place[name] = rng.uniform(-6, 6, (7, 3)) if name == "open" else rng.uniform(-2, 2, (7, 3)) @ (cell + np.diag([0, 0, 1.0 if name == "slab" else 0]))
        rows += [(name, i, 1, *map(float, p)) for i, p in enumerate(place[name])]
    atoms = spark.createDataFrame(rows, "structure_id string, atom_id long, number int, x double, y double, z double")
    structures = spark.createDataFrame([(n, c.tolist(), list(p)) for n, (c, p) in cells.items()],
                                       "structure_id string, cell array<array<double>>, pbc array<boolean>")
    radius = 2.3
    got = sorted((r["structure_id"], r["atom_id"], r["other_id"], round(r["r"], 6)) for r in N.neighbour_pairs(atoms, radius, structures).collect())
    want = []
    for name, (cell, pbc) in cells.items():
        steps = [range(-12, 13) if p else (0,) for p in pbc]
        shifts = np.array([np.array(k) @ cell for k in itertools.product(*steps)])
        for i, p in enumerate(place[name]):
            for j, q in enumerate(place[name]):
                r = np.linalg.norm(q + shifts - p, axis=1)
                want += [(name, i, j, round(float(v), 6)) for v in r[(r <= radius) & ((r > 1e-12) | (i != j))]]
    assert got == sorted(want) and len(got) > 500
    nearest = {(r["structure_id"], r["atom_id"]): r["nn"] for r in N.nearest_distances(atoms, radius, structures).collect()}
    for k in nearest:
        close = [r for s, i, _, r in want if (s, i) == k]
        assert (nearest[k] is None and not close) or nearest[k] == pytest.approx(min(close), abs=1e-6)


def test_pairs_by_reach(spark, monkeypatch):
    """Crowded boxes are not searched as wide as sparse ones, and every box has the pairs within its own reach."""
    from latticeloom.operators import boxes as B
    from latticeloom.operators import boxpairs as P

    rng = np.random.default_rng(5)
    place = np.concatenate([rng.uniform(0, 0.4, (60, 3)), rng.uniform(1.0, 3.0, (40, 3))])
    atoms = spark.createDataFrame([("s", i, 1, *map(float, x)) for i, x in enumerate(place)], "source string, atom_id long, number int, x double, y double, z double")
    box, stride = (1.0, 1.0, 1.0), (0.7, 0.7, 0.7)
    grid = B.box_grid(atoms, box, stride, B.axis_padding(atoms, box, (0.0, 0.0, 0.0))).localCheckpoint()
    ranged = P.with_box_range(atoms, grid, box, stride).localCheckpoint()
    held = {}
    for r in P.in_boxes(ranged).collect():
        held.setdefault(r.box_id, []).append(r.atom_id)
    reach = {b: 0.1 if len(ids) > 20 else 0.9 for b, ids in held.items()}
    assert set(reach.values()) == {0.1, 0.9}
    searched = []
    once = P.ranged_pairs
    monkeypatch.setattr(P, "ranged_pairs", lambda a, b, radius: searched.append((a.count(), radius)) or once(a, b, radius))
    rows = P.pairs_by_reach(ranged, spark.createDataFrame(list(reach.items()), "box_id string, reach double")).collect()
    apart = np.linalg.norm(place[:, None] - place[None], axis=2)
    wanted = sorted((b, i, apart[i, j]) for b, ids in held.items() for i in ids for j in ids if i != j and apart[i, j] <= reach[b])
    got = sorted((r.box_id, r.atom_id, r.r) for r in rows if r.r <= reach[r.box_id])
    assert [w[:2] for w in wanted] == [g[:2] for g in got] and np.allclose([w[2] for w in wanted], [g[2] for g in got])
    assert len(searched) == 2 and all(n < len(place) for n, radius in searched if radius > 0.5)


def test_local_analysis_searches_boxes_by_their_own_reach(spark, monkeypatch):
    from latticeloom.operators import boxpairs as P
    from latticeloom.plans.analysis import make_descriptor

    seen = []
    once = P.ranged_pairs
    monkeypatch.setattr(P, "ranged_pairs", lambda a, b, radius: seen.append(radius) or once(a, b, radius))
    rng = np.random.default_rng(6)
    place = np.concatenate([rng.uniform(0, 0.3, (80, 3)), rng.uniform(2.0, 4.0, (12, 3))])
    atoms = spark.createDataFrame([("s", i, 1, *map(float, x)) for i, x in enumerate(place)], "source string, atom_id long, number int, x double, y double, z double")
    grid = spark.createDataFrame([("s", 0.0, 0.0, 0.0, 4, 4, 4)], "source string, start_x double, start_y double, start_z double, n_x int, n_y int, n_z int")
    maker = make_descriptor("environment_spectrum", cutoff=2.5, n_max=2, l_max=2, scaling="avg_nn", scaling_radii=(0.9,), periodic=False, scale_limits=(0.01, 10.0))
    assert maker.calculate_in_boxes(atoms, grid, (1.0, 1.0, 1.0), (1.0, 1.0, 1.0)).count() > 1
    assert len({r for r in seen if r > 0.9}) >= 1 and min(seen[-2:]) < 0.5
