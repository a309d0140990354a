"""Energies of the phases of one material and their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phase_minima(df: DataFrame, sample: str, phase: str, energy: str) -> DataFrame:
    """Lowest energy per (sample, phase); partial minima are taken before the shuffle."""
    return df.groupBy(sample, phase).agg(F.min(energy).alias(energy))


def lowest_rows(df: DataFrame, sample: str, phase: str, energy: str) -> DataFrame:
    """Distinct rows at the lowest energy of their (sample, phase)."""
    low = phase_minima(df, sample, phase, energy).withColumnRenamed(energy, "_low")
    return (df.join(low, [sample, phase]).where(F.col(energy) == F.col("_low"))
            .select(*df.columns).dropDuplicates())


def phase_differences(df: DataFrame, sample: str, phase: str, energy: str) -> DataFrame:
    """``E(a) - E(b)`` for every ordered pair of phases that a sample has."""
    low = phase_minima(df, sample, phase, energy)
    a = low.select(sample, F.col(phase).alias("phase_a"), F.col(energy).alias("_a"))
    b = low.select(sample, F.col(phase).alias("phase_b"), F.col(energy).alias("_b"))
    return (a.join(b, sample).where(F.col("phase_a") != F.col("phase_b"))
            .select(sample, "phase_a", "phase_b", (F.col("_a") - F.col("_b")).alias("difference")))


def phase_table(df: DataFrame, sample: str, phase: str, energy: str, phases: Sequence) -> DataFrame:
    """Lowest energies with one column per phase."""
    return df.groupBy(sample).agg(
        *[F.min(F.when(F.col(phase) == p, F.col(energy))).alias(f"e_{p}") for p in phases])


def select_phase_pairs(differences: DataFrame, pairs: Sequence[tuple], sample: str,
                       drop_missing: str | None = None) -> DataFrame:
    """Chosen phase pairs as columns ``<a>_<b>``.

    ``drop_missing``: ``rows`` drops samples with a gap, ``pairs`` drops columns
    with one, None keeps all. An empty result is an error.
    """
    name = lambda a, b: f"{a}_{b}"
    wide = differences.groupBy(sample).agg(*[
        F.max(F.when((F.col("phase_a") == a) & (F.col("phase_b") == b), F.col("difference")))
        .alias(name(a, b)) for a, b in pairs])
    columns = [name(a, b) for a, b in pairs]
    if drop_missing == "rows":
        wide = wide.dropna("any", subset=columns)
        if wide.limit(1).count() == 0:
            raise ValueError("every sample lacks one of the phase pairs")
    elif drop_missing == "pairs":
        gaps = wide.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
        columns = [c for c in columns if gaps[c] == 0]
        if not columns:
            raise ValueError("every phase pair lacks some sample")
        wide = wide.select(sample, *columns)
    elif drop_missing is not None:
        raise ValueError("drop_missing must be None, 'rows' or 'pairs'")
    return wide


def merge_equivalent_phases(phase: Column, pairs: Sequence[tuple]) -> Column:
    """Replace the second phase of each pair by the first."""
    out = phase
    for kept, replaced in pairs:
        out = F.when(phase == replaced, F.lit(kept)).otherwise(out)
    return out


def binary_energy_differences(df: DataFrame, sample: str, phase: str, energy: str,
                              equivalent: Sequence[tuple], pairs: Sequence[tuple] | None = None) -> DataFrame:
    """Energy per atom pair halved, equivalent phases merged, then the difference
    between the kept phases joined back to every energy row.

    ``pairs`` names the phases to compare; without it the kept phases are taken two by two, so there must be an even
    number of them."""
    if pairs is None and len(equivalent) % 2:
        raise ValueError("an odd number of kept phases: name the pairs to compare")
    half = (df.withColumn(energy, F.col(energy) * 0.5)
            .withColumn(phase, merge_equivalent_phases(F.col(phase), equivalent)))
    kept = [a for a, _ in equivalent]
    chosen = select_phase_pairs(phase_differences(half, sample, phase, energy),
                                list(pairs if pairs is not None else zip(kept[::2], kept[1::2])), sample)
    return half.join(chosen, sample)


def two_phase_difference(df: DataFrame, material: str, label: str, energy: str,
                         strict: bool = False) -> DataFrame:
    """``(E1 - E0) / 2`` of the lowest energies of label 1 and label 0."""
    low = lambda v: F.min(F.when(F.col(label) == v, F.col(energy)))
    out = df.groupBy(material).agg(low(0).alias("e0"), low(1).alias("e1"))
    if strict and out.where(F.col("e0").isNull() | F.col("e1").isNull()).limit(1).count():
        raise ValueError("a material lacks one of its two phases")
    return out.withColumn("delta_e", (F.col("e1") - F.col("e0")) / 2)


def lowest_energy_flag(df: DataFrame, material: str, label: str, energy: str) -> DataFrame:
    """Is the row the lower one of the two phase energies of its compound?"""
    pair = two_phase_difference(df, material, label, energy).drop("delta_e")
    return (df.join(pair, material)
            .withColumn("is_lowest", F.col(energy) == F.least("e0", "e1")).drop("e0", "e1"))


def first_after_sort(df: DataFrame, group: Sequence[str], order: Sequence[str],
                     values: Sequence[str]) -> DataFrame:
    """First row of each group under ``order``, by partial minima instead of a sort."""
    best = F.min(F.struct(*order, *[c for c in values if c not in order]))
    return df.groupBy(*group).agg(best.alias("_b")).select(*group, *[F.col(f"_b.{c}").alias(c) for c in values])
