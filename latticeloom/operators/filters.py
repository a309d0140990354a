"""Predicates, filters, de-duplication and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.functions.vectors import nan_vector, zero_vector

# Formula spellings replaced by the usual ones.
FORMULA_SPELLINGS = {
    "FLi": "LiF", "ClLi": "LiCl", "BrLi": "LiBr", "ILi": "LiI", "AsB": "BAs", "FNa": "NaF",
    "ClNa": "NaCl", "BrNa": "NaBr", "INa": "NaI", "CSi": "SiC", "FK": "KF", "ClK": "KCl",
    "BrK": "KBr", "IK": "KI", "ClCu": "CuCl", "BrCu": "CuBr", "OZn": "ZnO", "SZn": "ZnS",
    "SeZn": "ZnSe", "TeZn": "ZnTe", "AsGe": "GeAs", "FRb": "RbF", "ClRb": "RbCl", "BrRb": "RbBr",
    "IRb": "RbI", "OSr": "SrO", "SSr": "SrS", "SeSr": "SrSe", "AsIn": "InAs", "ClCs": "CsCl",
    "BrCs": "CsBr", "SiSn": "SnSi", "CGe": "GeC", "GeSn": "SnGe", "CSn": "SnC",
}


def descriptor_field(df: DataFrame, name: str, descriptor: str = "descriptor") -> Column:
    """One named field of the descriptor struct."""
    fields = df.schema[descriptor].dataType.fieldNames()
    if name not in fields:
        raise KeyError(f"{name!r} is not in the descriptor; valid names: {fields}")
    return F.col(descriptor)[name]


def check_descriptor(df: DataFrame, expected: str | None = None,
                     column: str = "descriptor_name") -> str:
    """All rows must carry one descriptor name (``expected`` if given)."""
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"),
               F.max(F.col(column).isNull()).alias("missing")).first()
    if r["missing"] or r["lo"] != r["hi"] or (expected is not None and r["lo"] != expected):
        raise ValueError(f"descriptors differ: {r['lo']!r} to {r['hi']!r}, expected {expected!r}")
    return r["lo"]


def consistent_and_accepted(values: Column, accepted: Sequence) -> Column:
    """True if a map holds one and the same accepted value under all its keys."""
    distinct = F.array_distinct(F.map_values(values))
    return (F.size(distinct) == 1) & F.get(distinct, F.lit(0)).isin(list(accepted))


def filter_by_symmetry(df: DataFrame, accepted: Mapping[str, Sequence]) -> DataFrame:
    """Keep rows whose every filter field is consistent over tolerances and accepted."""
    for field, values in accepted.items():
        df = df.where(consistent_and_accepted(F.col(field), values))
    return df


def symmetry_report(df: DataFrame, field: str) -> DataFrame:
    """Accepted values of one field and how many rows carry each."""
    return (df.select(F.get(F.map_values(field), F.lit(0)).alias("value"))
            .groupBy("value").agg(F.count(F.lit(1)).alias("n")))


def keep_allowed_species(atoms: DataFrame, allowed: Sequence, structure: str = "structure_id",
                         species: str = "number") -> DataFrame:
    """Atoms of those structures that hold allowed species only; an unknown (null) species is not allowed."""
    bad = atoms.where(~F.coalesce(F.col(species).isin(list(allowed)), F.lit(False))).select(structure).distinct()
    return atoms.join(bad, structure, "left_anti")


def split_duplicates(df: DataFrame, key: Column | str, position: str) -> DataFrame:
    """Add ``is_duplicate``; the first row of each key (by unique ``position``) is kept.

    The first position per key is found with map-side partial minima, so a key
    held by a third of the rows is never sorted in one task.
    """
    key = F.col(key) if isinstance(key, str) else key
    # long keys (whole texts) travel as digests
    keyed = df.withColumn("_key", F.sha2(key.cast("string"), 256))
    first = keyed.groupBy("_key").agg(F.min(position).alias("_first"))
    return (keyed.join(first, F.col(position) == F.col("_first"), "left")
            .select(*[keyed[c] for c in df.columns], F.col("_first").isNull().alias("is_duplicate")))


def drop_rare_species(atoms: DataFrame, min_atoms: int, structure: str = "structure_id",
                      species: str = "number") -> DataFrame:
    """Drop atoms whose species occurs fewer than ``min_atoms`` times in the structure."""
    counts = atoms.groupBy(structure, species).agg(F.count(F.lit(1)).alias("_n"))
    rare = counts.where(F.col("_n") < min_atoms).drop("_n")
    return lookup_join(atoms, rare, [structure, species], "left_anti", once=True)


def with_descriptor_or_nan(structures: DataFrame, descriptors: DataFrame, length: int,
                           key: str = "structure_id", value: str = "value") -> DataFrame:
    """Every structure keeps a row; one without a descriptor gets NaNs of fixed length."""
    return (structures.join(descriptors, key, "left")
            .withColumn(value, F.coalesce(F.col(value), nan_vector(length))))


def nan_if_thin(vector: Column, n_atoms: Column, min_atoms: int) -> Column:
    """NaN vector when there are ``min_atoms`` or fewer."""
    return F.when(n_atoms <= min_atoms, F.transform(vector, lambda _: F.lit(float("nan")))).otherwise(vector)


def zero_if_thin(vector: Column, n_atoms: Column, min_atoms: int, length: int) -> Column:
    """Zero vector when there are fewer than ``min_atoms``."""
    return F.when(n_atoms < min_atoms, zero_vector(length)).otherwise(vector)


def select_structure_atoms(atoms: DataFrame, structure_id: str, drop: Sequence[str]) -> DataFrame:
    return atoms.where(F.col("structure_id") == structure_id).drop(*drop)


def rocksalt_or_zincblende(second_atom: Column) -> Column:
    """0 when all fractional coordinates of atom 2 are below 0.375, else 1."""
    return F.when(F.forall(second_atom, lambda v: v < 0.375), 0).otherwise(1)


def rename_formula(formula: Column) -> Column:
    pairs = [F.lit(x) for pair in FORMULA_SPELLINGS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[formula], formula)


def missing_value_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: does it hold any missing value, and how many."""
    counts = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c)
                      for c in columns])
    return counts.select(F.explode(F.create_map(
        *[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column_name", "n_missing")
    ).withColumn("has_missing", F.col("n_missing") > 0)


def designed_classes(results: DataFrame, allowed: DataFrame, on: Sequence[str],
                     defects: Sequence[str] | None = None, defect: str = "defect",
                     periodic: str | None = None) -> DataFrame:
    """Rows whose (method, true class) the method was designed for."""
    if defects is not None:
        results = results.where(F.col(defect).isin(list(defects)))
    if periodic is not None:
        results = results.where(F.col(periodic))
    return lookup_join(results, allowed.select(*on).distinct(), list(on), "left_semi")


def without_blank_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def key_from_file_name(name: Column) -> Column:
    """Sixth ``_`` token from the end, up to the first dot, after ``spgroup``."""
    token = F.element_at(F.split(name, "_"), -5)
    return F.element_at(F.split(F.split(token, r"\.")[0], "spgroup"), -1)


def has_required_keys(record: Column, required: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in required])
    return F.size(F.array_except(wanted, F.map_keys(record))) == 0


def row_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` does not hold."""
    return left.subtract(right)


def stamped_union(parts: Mapping[str, DataFrame], column: str = "target") -> DataFrame:
    """Union of tables, each stamped with its constant class label."""
    out = None
    for label, part in parts.items():
        stamped = part.withColumn(column, F.lit(label))
        out = stamped if out is None else out.unionByName(stamped, allowMissingColumns=True)
    return out
