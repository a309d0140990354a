"""Random defects are drawn for every atom of every structure: not once for all copies of an atom, nor for all structures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeloom.operators import structures as S


def test_draws_differ_between_replicas(spark):
    atoms = spark.createDataFrame([("s", i, 29, 0.5 * i, 0.1 * i, 0.0) for i in range(4)],
                                  "structure_id string, atom_id long, number int, x double, y double, z double")
    cells = spark.createDataFrame([("s", [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 2.0]], [True] * 3)],
                                  "structure_id string, cell array<array<double>>, pbc array<boolean>")
    big, _ = S.supercell(atoms, cells, (3, 3, 3))
    left = {r.site_id: r["count"] for r in S.create_vacancies(big, 0.25).groupBy("site_id").count().collect()}
    assert sum(left.values()) == 81 and all(10 < n < 27 for n in left.values())
    swapped = S.substitute_atoms(big, 0.25).where(F.col("number") != 29)
    assert swapped.select("replica").distinct().count() > 5 and swapped.select("site_id").distinct().count() == 4
    moved = S.displace_atoms(big, "uniform", 0.1).join(big.withColumnRenamed("x", "x0").select("atom_id", "x0"), ["atom_id"])
    assert moved.select(F.round(F.col("x") - F.col("x0"), 9)).distinct().count() > 100


def two_alike(spark, n=40):
    atoms = spark.createDataFrame([(s, i, 29, 0.1 * i, 0.2 * (i % 7), 0.3 * (i % 5)) for s in "ab" for i in range(n)],
                                  "structure_id string, atom_id long, number int, x double, y double, z double")
    cells = spark.createDataFrame([(s, [[4.0, 0.0, 0.0], [0.5, 2.0, 0.0], [0.0, 0.0, 2.0]], [True] * 3) for s in "ab"],
                                  "structure_id string, cell array<array<double>>, pbc array<boolean>")
    return atoms, cells


def by_structure(df, *columns):
    rows = df.select("structure_id", *columns).collect()
    return [sorted(tuple(r)[1:] for r in rows if r[0] == s) for s in "ab"]


def test_equal_structures_differ(spark):
    atoms, _ = two_alike(spark)
    for out, columns in ((S.create_vacancies(atoms, 0.25), ["atom_id"]), (S.random_subset(atoms, 0.25, "atom_id"), ["atom_id"]),
                         (S.substitute_atoms(atoms, 0.5), ["atom_id", "number"]), (S.displace_atoms(atoms, "gaussian", 0.1), ["atom_id", "x"])):
        a, b = by_structure(out, *columns)
        assert a != b and len(a) == len(b)
    noise = S.displace_atoms(atoms, "uniform", 0.1).select(F.round("x", 9)).union(atoms.select(F.round("x", 9))).distinct()
    assert noise.count() == 80 + 40


def test_supercell_ids(spark):
    atoms, cells = two_alike(spark)
    big, _ = S.supercell(atoms, cells, (2, 1, 3))
    assert big.select("structure_id", "atom_id").distinct().count() == big.count() == 480
    assert big.where(F.col("atom_id") != F.col("site_id") * 6 + F.col("replica")).isEmpty()
    named, _ = S.supercell(atoms.withColumn("atom_id", F.concat(F.lit("n"), "atom_id")), cells, (2, 1, 1))
    assert named.where("atom_id = 'n3/1' and site_id = 'n3'").count() == 2


def test_rotation_keeps_lengths(spark):
    atoms, cells = two_alike(spark)
    (turned, boxes), again = S.random_rotation(atoms, cells, 5), S.random_rotation(atoms, cells, 5)[0]
    assert turned.exceptAll(again).isEmpty()
    old = np.array([tuple(r) for r in atoms.orderBy("structure_id", "atom_id").select("x", "y", "z").collect()])
    new = np.array([tuple(r) for r in turned.orderBy("structure_id", "atom_id").select("x", "y", "z").collect()])
    for part in (slice(0, 40), slice(40, 80)):
        apart = [np.linalg.norm(v[part][:, None] - v[part][None], axis=2) for v in (old, new)]
        assert np.allclose(*apart) and not np.allclose(old[part], new[part], atol=0.05)
    assert not np.allclose(new[:40], new[40:], atol=0.05)                       # differs by structure
    before, after = (np.array([r["cell"] for r in c.orderBy("structure_id").collect()]) for c in (cells, boxes))
    for p, q in zip(before, after, strict=True):
        assert np.allclose(p @ p.T, q @ q.T) and np.linalg.det(q) == pytest.approx(np.linalg.det(p))
    inside = [np.linalg.solve(after[i].T, new[40 * i:40 * i + 40].T) for i in range(2)]
    assert np.allclose(inside[0], inside[1])                                    # cell and atoms turn together


def test_create_supercell(spark):
    atoms, cells = two_alike(spark, 4)
    for options, count in (({"replicas_by": "user-defined", "replicas": (2, 2, 1)}, 16), ({"replicas_by": "radius", "radius": 4.5}, 4 * 1 * 2 * 2)):
        for turn in ({}, {"rotate_after": True}, {"rotate_before": True}):
            big, grown = S.create_supercell(atoms, cells, **options, **turn)
            assert big.groupBy("structure_id").count().select("count").distinct().collect() == [(count,)] and grown.count() == 2
    big, _ = S.create_supercell(atoms, cells, target_atoms=100)
    assert big.groupBy("structure_id").count().where("count < 100").isEmpty()
    with pytest.raises(NotImplementedError):
        S.create_supercell(atoms, cells, "optimal")
