"""Element and compound features, feature algebra, formulas."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.functions.algebra import BINARY, SUM_COMPOSITES, UNARY, ratio

STRUCTURE = "structure_id"
WIDE_LIMIT = 300            # beyond this many features the table is long


# --- property joins ----------------------------------------------------------

def element_properties(atoms: DataFrame, elements: DataFrame, properties: Sequence[str],
                       on: str = "symbol") -> DataFrame:
    """Element properties for each atom; an unknown one is NaN."""
    joined = lookup_join(atoms, elements.select(on, *properties), on, "left")
    return joined.select(*atoms.columns, *[
        F.coalesce(F.col(p).cast("double"), F.lit(float("nan"))).alias(p) for p in properties])


def choose_features(atomic: DataFrame, binary: DataFrame, selected: Sequence[str],
                    derived: Mapping[str, Column] | None = None, key: str = "Mat") -> DataFrame:
    """Inner join of atomic and binary tables, derived columns, selected columns."""
    joined = atomic.join(binary, key)
    for name, column in (derived or {}).items():
        joined = joined.withColumn(name, column)
    return joined.select(key, *selected)


def species_of(atoms: DataFrame, species: str = "symbol", structure: str = STRUCTURE) -> DataFrame:
    return atoms.select(structure, species).distinct()


def atomic_feature_table(atoms: DataFrame, elements: DataFrame, features: Sequence[str], order_by: str,
                         species: str = "symbol", structure: str = STRUCTURE,
                         factors: Mapping[str, float] | None = None) -> DataFrame:
    """Features ``f(A)``, ``f(B)`` of the two species of a binary, ordered by one property.

    Elemental solids count their species twice; a third species is an error. The
    distinct species are formed first, so the size of a structure plays no role.
    """
    if len(features) < 2:
        raise ValueError("select at least two features")
    factors = factors or {}
    props = [order_by, *[f for f in features if f != order_by]]
    known = element_properties(species_of(atoms, species, structure), elements, props, species)
    # collected arrays hold at most the species of one structure
    pair = known.groupBy(structure).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order_by).alias("_o"), F.col(species).alias("_s"),
        *[(F.col(f) * F.lit(float(factors.get(f, 1.0)))).alias(f) for f in features]))).alias("_p"))
    pair = pair.withColumn("_p", F.when(F.size("_p") <= 2, F.col("_p")).otherwise(
        F.raise_error(F.concat(F.lit("more than two species in "), F.col(structure).cast("string")))
        .cast(pair.schema["_p"].dataType)))
    a, b = F.col("_p")[0], F.element_at("_p", -1)
    return pair.select(structure, F.concat(a["_s"], b["_s"]).alias("ordered_chemical_symbols"),
                       *[a[f].alias(f"{f}(A)") for f in features],
                       *[b[f].alias(f"{f}(B)") for f in features])


# --- formulas ----------------------------------------------------------------

def _carbon_hydrogen_first(symbol: Column) -> Column:
    return F.when(symbol == "C", 0).when(symbol == "H", 1).otherwise(2)


def binary_formula(atoms: DataFrame, species: str = "symbol", structure: str = STRUCTURE) -> DataFrame:
    """Distinct symbols in order (C, then H, first); ``2`` is appended for elements."""
    ranked = F.array_sort(F.collect_set(F.struct(
        _carbon_hydrogen_first(F.col(species)).alias("o"), F.col(species).alias("s"))))
    text = F.array_join(F.transform(F.col("_r"), lambda r: r["s"]), "")
    return (atoms.groupBy(structure).agg(ranked.alias("_r"))
            .select(structure, F.concat(text, F.when(F.size("_r") == 1, "2").otherwise("")).alias("formula")))


def hill_formula(atoms: DataFrame, species: str = "symbol", structure: str = STRUCTURE) -> DataFrame:
    """Hill order: with carbon, C then H then the rest by name; without, all by name."""
    counts = atoms.groupBy(structure, species).agg(F.count(F.lit(1)).alias("n"))
    parts = (counts.groupBy(structure)
             .agg(F.collect_list(F.struct(F.col(species).alias("s"), "n")).alias("_e")))
    carbon = F.exists("_e", lambda e: e["s"] == "C")
    order = F.array_sort(F.transform("_e", lambda e: F.struct(
        F.when(carbon, _carbon_hydrogen_first(e["s"])).otherwise(2).alias("o"), e["s"].alias("s"), e["n"].alias("n"))))
    text = F.transform(order, lambda e: F.concat(e["s"], F.when(e["n"] > 1, e["n"].cast("string")).otherwise("")))
    return parts.select(structure, F.array_join(text, "").alias("formula"))


def collection_species(atoms: DataFrame, species: str = "symbol", number: str = "number") -> DataFrame:
    """Sorted distinct species of a collection with their number of atoms."""
    return atoms.groupBy(species, number).agg(F.count(F.lit(1)).alias("n_atoms"))


def collection_summary(atoms: DataFrame, species: str = "symbol", number: str = "number") -> DataFrame:
    return atoms.agg(F.max(number).alias("largest_number"), F.count_distinct(species).alias("n_species"))


def longest_pair_list(pairs: DataFrame) -> DataFrame:
    """Longest list of distances of any species pair in any structure."""
    return (pairs.groupBy(STRUCTURE, "z1", "z2").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.max("n").alias("longest")))


def species_pairs(atoms: DataFrame, number: str = "number", structure: str = STRUCTURE,
                  periodic: bool = True) -> DataFrame:
    """Ordered species pairs of each structure (at most 118 x 118). ``usable`` is false
    for a like pair with a single atom in a non-periodic structure."""
    counts = atoms.groupBy(structure, number).agg(F.count(F.lit(1)).alias("n"))
    a = counts.select(structure, F.col(number).alias("z1"), F.col("n").alias("n1"))
    b = counts.select(structure, F.col(number).alias("z2"))
    usable = F.lit(True) if periodic else ~((F.col("z1") == F.col("z2")) & (F.col("n1") == 1))
    return a.join(b, structure).select(structure, "z1", "z2", usable.alias("usable"))


def mean_over_pairs(pairs: DataFrame, values: DataFrame, structure: str = STRUCTURE) -> DataFrame:
    """Mean of per-pair features ``values(structure, z1, z2, idx, value)`` over all
    species pairs; unusable pairs count as zeros."""
    n = pairs.groupBy(structure).agg(F.count(F.lit(1)).alias("_n"))
    used = values.join(pairs.where("usable"), [structure, "z1", "z2"], "left_semi")
    return (used.groupBy(structure, "idx").agg(F.sum("value").alias("_s")).join(n, structure)
            .select(structure, "idx", (F.col("_s") / F.col("_n")).alias("value")))


# --- combined feature space --------------------------------------------------

Feature = tuple[str, Column]


def _pairs(columns: Sequence[str], ops: set[str]) -> list[Feature]:
    out: list[Feature] = []
    names = {"+": "({}+{})", "-": "({}-{})", "|+|": "|{}+{}|", "|-|": "|{}-{}|", "/": "{}/{}"}
    for a, b in itertools.combinations(columns, 2):
        for op, pattern in names.items():
            if op in ops:
                out.append((pattern.format(a, b), BINARY[op](_c(a), _c(b))))
                if op in ("-", "/"):
                    out.append((pattern.format(b, a), BINARY[op](_c(b), _c(a))))
    return out


def _c(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def _singles(columns, ops, scaled: Callable[[str], Column]) -> list[Feature]:
    out: list[Feature] = []
    for a in columns:
        for power in ("^2", "^3"):
            if power in ops:
                out.append((f"{a}{power}", UNARY[power](_c(a))))
        if "exp" in ops:
            out.append((f"exp({a})", F.exp(scaled(a))))
    return out


def feature_space(classes: Mapping[str, str], ops: Sequence[str],
                  unit_factor: Mapping[str, float] | None = None) -> list[Feature]:
    """Feature names and expressions from primary columns grouped in unit classes.

    ``classes`` maps a column to ``a0`` .. ``a4``. Pairs are formed within a class
    (quotients in ``a0`` only); ``a0`` and ``a3`` also get powers and exponentials;
    then every ``a1``-``a3`` column or pair is divided by every power or
    exponential of ``a3``. Exponents are scaled by ``unit_factor``.
    """
    allowed, factors = set(ops), unit_factor or {}
    of = {k: [c for c, v in classes.items() if v == k] for k in ("a0", "a1", "a2", "a3", "a4")}
    scaled = lambda a: _c(a) * F.lit(float(factors.get(a, 1.0)))
    out: list[Feature] = [(c, _c(c)) for k in of for c in of[k]]
    out += _pairs(of["a0"], allowed) + _singles(of["a0"], allowed, _c)
    numerators: list[Feature] = [(c, _c(c)) for k in ("a1", "a2", "a3") for c in of[k]]
    for k in ("a1", "a2", "a3"):
        made = _pairs(of[k], allowed - {"/"})
        numerators += made
        out += made
    below = _singles(of["a3"], allowed, scaled)
    for power in ("^2", "^3"):
        if {"exp", power} <= allowed:
            below += [(f"exp({a}{power})", UNARY[f"exp{power}"](scaled(a))) for a in of["a3"]]
    for a, b in itertools.combinations(of["a3"], 2):
        for power in ("^2", "^3"):
            if power in allowed:
                below.append((f"({a}+{b}){power}", SUM_COMPOSITES[power](_c(a), _c(b))))
            if {"exp", power} <= allowed:
                below.append((f"exp(({a}+{b}){power})", SUM_COMPOSITES[f"exp{power}"](scaled(a), scaled(b))))
        if "exp" in allowed:
            below.append((f"exp({a}+{b})", SUM_COMPOSITES["exp"](scaled(a), scaled(b))))
    out += below
    if "/" in allowed:
        out += [(f"{n}/{d}", ratio(x, y)) for n, x in numerators for d, y in below]
    return out


def combine_features(df: DataFrame, key: str, space: Sequence[Feature]) -> DataFrame:
    """Wide feature table; use ``combine_features_long`` for large spaces."""
    if len(space) > WIDE_LIMIT:
        raise ValueError(f"{len(space)} features: use combine_features_long")
    return df.select(key, *[c.alias(n) for n, c in space])


def combine_features_long(df: DataFrame, key: str, space: Sequence[Feature], chunk: int = 100) -> DataFrame:
    """Long feature table ``(key, feature, value)`` in one pass over the rows.

    The expressions are cut into chunks so that each stays small enough for
    generated code; the chunks of a row are exploded one after the other.
    """
    parts = [F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in space[i:i + chunk]])
             for i in range(0, len(space), chunk)]
    return df.select(key, F.explode(F.concat(*parts)).alias("_f")).select(key, "_f.feature", "_f.value")


def unit_factors(columns: Sequence[str], units: Mapping[str, str], energy_factor: float,
                 length_factor: float) -> dict[str, float]:
    """Scale factor per column from the unit of its property (name before the bracket):
    J columns take the energy factor, m columns the length factor, others 1."""
    by_unit = {"J": energy_factor, "m": length_factor}
    return {c: by_unit.get(units.get(c.split("(", 1)[0], ""), 1.0) for c in columns}
