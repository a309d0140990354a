"""Nulls stay null in bins, are no allowed species, and no phase is lost silently."""

import pytest

from latticeloom.operators.energies import binary_energy_differences
from latticeloom.operators.filters import keep_allowed_species
from latticeloom.operators.labels import adaptive_quantile_bins, discretise_quantiles, discretise_uniform


def test_bins_of_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(None,)], "v double")
    for out in (discretise_uniform(df, "v", 4), discretise_quantiles(df, "v", 4)):
        rows = {r.v: r.bin for r in out.collect()}
        assert rows.pop(None) is None and all(b is not None for b in rows.values())
    rows = {r.v: r.color_bin for r in adaptive_quantile_bins(df, "v")[0].collect()}
    assert rows[None] is None and rows[0.0] == 0 and rows[19.0] == 4


def test_unknown_species(spark):
    atoms = spark.createDataFrame([("a", 1), ("a", None), ("b", 1), ("c", 2)], "structure_id string, number int")
    assert [r.structure_id for r in keep_allowed_species(atoms, [1]).collect()] == ["b"]


def test_odd_number_of_phases(spark):
    df = spark.createDataFrame([("s", "1", 2.0), ("s", "2", 4.0), ("s", "3", 8.0)], "sample string, phase string, energy double")
    three = [("1", "1"), ("2", "2"), ("3", "3")]
    with pytest.raises(ValueError):
        binary_energy_differences(df, "sample", "phase", "energy", three)
    named = binary_energy_differences(df, "sample", "phase", "energy", three, [("1", "2"), ("1", "3")])
    assert len(named.columns) == len(df.columns) + 2
