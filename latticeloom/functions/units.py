"""Units of measure as a lookup table, and conversions built on it."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Decimal prefixes, name, symbol, power of ten.
PREFIXES = [
    ("yocto", "y", -24), ("zepto", "z", -21), ("atto", "a", -18), ("femto", "f", -15), ("pico", "p", -12),
    ("nano", "n", -9), ("micro", "u", -6), ("milli", "m", -3), ("centi", "c", -2), ("deci", "d", -1),
    ("deca", "da", 1), ("hecto", "h", 2), ("kilo", "k", 3), ("mega", "M", 6), ("giga", "G", 9),
    ("tera", "T", 12), ("peta", "P", 15), ("exa", "E", 18), ("zetta", "Z", 21), ("yotta", "Y", 24),
]

# Dimensions: exponents of length, mass, time, current, temperature, substance, luminosity.
DIMENSIONS = ("length", "mass", "time", "current", "temperature", "substance", "luminosity")
_NONE = (0, 0, 0, 0, 0, 0, 0)
_LENGTH, _MASS, _TIME = (1, 0, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0, 0)
_CURRENT, _TEMPERATURE = (0, 0, 0, 1, 0, 0, 0), (0, 0, 0, 0, 1, 0, 0)
_SUBSTANCE, _LUMINOSITY = (0, 0, 0, 0, 0, 1, 0), (0, 0, 0, 0, 0, 0, 1)
_ENERGY, _FORCE, _PRESSURE = (2, 1, -2, 0, 0, 0, 0), (1, 1, -2, 0, 0, 0, 0), (-1, 1, -2, 0, 0, 0, 0)
_POWER, _CHARGE, _VOLTAGE = (2, 1, -3, 0, 0, 0, 0), (0, 0, 1, 1, 0, 0, 0), (2, 1, -3, -1, 0, 0, 0)
_FREQUENCY, _AREA = (0, 0, -1, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0)
_FLUX_DENSITY = (0, 1, -2, -1, 0, 0, 0)

# Names of a unit (symbols that take prefixes first), dimension, SI factor.
UNITS = [
    (("m", "meter", "metre"), _LENGTH, 1.0),
    (("s", "second", "sec"), _TIME, 1.0),
    (("A", "ampere", "amp"), _CURRENT, 1.0),
    (("cd", "candela", "candle"), _LUMINOSITY, 1.0),
    (("g", "gram"), _MASS, 1e-3),
    (("mol", "mole"), _SUBSTANCE, 1.0),
    (("K", "kelvin", "degK"), _TEMPERATURE, 1.0),
    (("rad", "radian"), _NONE, 1.0),
    (("deg", "degree", "arcdeg"), _NONE, math.pi / 180),
    (("Hz", "hertz"), _FREQUENCY, 1.0),
    (("N", "newton"), _FORCE, 1.0),
    (("dyn", "dyne"), _FORCE, 1e-5),
    (("J", "joule"), _ENERGY, 1.0),
    (("eV", "electronVolt"), _ENERGY, 1.60217653e-19),
    (("erg",), _ENERGY, 1e-7),
    (("cal", "calorie"), _ENERGY, 4.184),
    (("btu", "Btu"), _ENERGY, 1.05505585262e3),
    (("hartree", "Eh"), _ENERGY, 4.35974394e-18),
    (("rydberg",), _ENERGY, 6.62606957e-34 * 299792458 * 10973731.568539),
    (("inversecm",), _ENERGY, 1.9864475e-23),
    (("Wh", "wattHour"), _ENERGY, 3600.0),
    (("W", "watt"), _POWER, 1.0),
    (("Pa", "pascal"), _PRESSURE, 1.0),
    (("bar",), _PRESSURE, 1e5),
    (("atm", "atmosphere"), _PRESSURE, 101325.0),
    (("torr",), _PRESSURE, 101325.0 / 760),
    (("C", "coulomb"), _CHARGE, 1.0),
    (("e", "elementaryCharge"), _CHARGE, 1.602176487e-19),
    (("V", "volt"), _VOLTAGE, 1.0),
    (("T", "tesla"), _FLUX_DENSITY, 1.0),
    (("gauss",), _FLUX_DENSITY, 1e-4),
    (("angstrom",), _LENGTH, 1e-10),
    (("bohr",), _LENGTH, 0.52917721067e-10),
    (("inch",), _LENGTH, 0.0254),
    (("ft", "foot"), _LENGTH, 0.3048),
    (("mile",), _LENGTH, 1609.344),
    (("parsec", "pc"), _LENGTH, 3.08568025e16),
    (("au", "astronomicalUnit"), _LENGTH, 149597870691.0),
    (("are",), _AREA, 100.0),
    (("barn", "b"), _AREA, 1e-28),
    (("min", "minute"), _TIME, 60.0),
    (("hr", "hour"), _TIME, 3600.0),
    (("day",), _TIME, 86400.0),
    (("week",), _TIME, 604800.0),
    (("amu", "u", "dalton", "Da"), _MASS, 1.660538782e-27),
    (("lb", "pound"), _MASS, 0.45359237),
    (("oz", "ounce"), _MASS, 0.028349523125),
    (("t", "tonne", "metricTon"), _MASS, 1000.0),
    (("debye",), (1, 0, 1, 1, 0, 0, 0), 3.33564e-30),
]
# Constants used by the rules.
AVOGADRO = 6.02214129e23
ENERGY, LENGTH = _ENERGY, _LENGTH
ENERGY_PER_SUBSTANCE = tuple(a - b for a, b in zip(_ENERGY, _SUBSTANCE))
_SYMBOL_PREFIXED = {"m", "s", "A", "g", "mol", "K", "Hz", "N", "J", "eV", "cal", "W", "Pa", "bar", "C", "V", "T", "Wh",
                    "hartree", "Eh", "rydberg"}


def unit_table(extra: Mapping[str, tuple[str, float]] | None = None) -> dict[str, tuple[tuple, float]]:
    """All unit names with dimension and SI factor: names, then prefix x name.

    ``extra`` adds user-defined quantities ``usr*`` as ``(unit expression, value)``.
    """
    table: dict[str, tuple[tuple, float]] = {}
    for names, dim, factor in UNITS:
        for n in names:
            table.setdefault(n, (dim, factor))
    for (names, dim, factor), (word, mark, power) in itertools.product(UNITS, PREFIXES):
        for n in names:
            prefix = mark if n in _SYMBOL_PREFIXED else word
            table.setdefault(prefix + n, (dim, factor * 10.0 ** power))
            table.setdefault(word + n, (dim, factor * 10.0 ** power))
    for name, (units, value) in (extra or {}).items():
        if not re.fullmatch(r"usr[A-Za-z]*", name):
            raise ValueError("user-defined quantities start with usr and hold letters only")
        if "=" in units:
            raise ValueError("a unit holds no = sign")
        dim, factor = resolve(units, table)
        table[name] = (dim, factor * float(value))
    return table


def resolve(unit: str, table: Mapping[str, tuple[tuple, float]] | None = None) -> tuple[tuple, float]:
    """Dimension and SI factor of a unit such as ``kcal/mol`` or ``meter*second**-2``."""
    table = table or unit_table()
    dim, factor, sign = list(_NONE), 1.0, 1
    for mark, token in re.findall(r"([*/]?)\s*((?:[A-Za-z_]+|[0-9.]+(?:[eE][-+]?\d+)?)(?:\s*(?:\*\*|\^)\s*-?\d+)?)",
                                  unit.replace("**", "^")):
        sign = -1 if mark == "/" else 1
        name, _, power = token.replace(" ", "").partition("^")
        p = sign * int(power or 1)
        if name[0].isdigit():
            factor *= float(name) ** p
            continue
        if name not in table:
            raise KeyError(f"undefined unit {name!r}")
        d, f = table[name]
        factor *= f ** p
        dim = [a + p * b for a, b in zip(dim, d)]
    return tuple(dim), factor


def conversion_factor(unit: str, target: str | None = None,
                      extra: Mapping[str, tuple[str, float]] | None = None) -> float:
    """Factor from ``unit`` to ``target`` (SI base units if None)."""
    table = unit_table(extra)
    dim, factor = resolve(unit, table)
    if target is None:
        return factor
    to_dim, to_factor = resolve(target, table)
    if dim != to_dim:
        raise ValueError(f"the dimensions of {unit!r} and {target!r} differ")
    return factor / to_factor


def convert(value: Column, unit: str, target: str | None = None,
            extra: Mapping[str, tuple[str, float]] | None = None) -> Column:
    return value * F.lit(conversion_factor(unit, target, extra))


def units_frame(spark: SparkSession, extra: Mapping[str, tuple[str, float]] | None = None) -> DataFrame:
    """Unit dimension table ``(unit, dimension, factor)``."""
    rows = [(n, " ".join(f"{k}^{p}" for k, p in zip(DIMENSIONS, d) if p), f)
            for n, (d, f) in unit_table(extra).items()]
    return spark.createDataFrame(rows, "unit string, dimension string, factor double")


def convert_by_row(df: DataFrame, units: DataFrame, value: str, unit: str, target: str,
                   out: str = "converted") -> DataFrame:
    """Conversion when unit and target stand in the rows; rows of different dimension
    are an error, unknown units give NULL."""
    src = units.select(F.col("unit").alias(unit), F.col("dimension").alias("_d1"), F.col("factor").alias("_f1"))
    dst = units.select(F.col("unit").alias(target), F.col("dimension").alias("_d2"), F.col("factor").alias("_f2"))
    joined = df.join(F.broadcast(src), unit, "left").join(F.broadcast(dst), target, "left")
    wrong = F.raise_error(F.concat(F.lit("dimensions differ: "), F.col(unit), F.lit(" and "), F.col(target)))
    result = F.when(F.col("_d1") != F.col("_d2"), wrong.cast("double")).otherwise(
        F.col(value) * F.col("_f1") / F.col("_f2"))
    return joined.select(*df.columns, result.alias(out))


def convert_energy_or_length(value: Column, unit: str, energy_unit: str | None = None,
                             length_unit: str | None = None) -> Column:
    """Energies go to the energy unit (per mole if that is one), lengths to the length
    unit, anything else stays."""
    dim, _ = resolve(unit)
    if dim == ENERGY and energy_unit is not None:
        if resolve(energy_unit)[0] == ENERGY_PER_SUBSTANCE:
            return value * F.lit(AVOGADRO) * F.lit(conversion_factor(f"{unit}/mol", energy_unit))
        return value * F.lit(conversion_factor(unit, energy_unit))
    if dim == LENGTH and length_unit is not None:
        return value * F.lit(conversion_factor(unit, length_unit))
    return value
