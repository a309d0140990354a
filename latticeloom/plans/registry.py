"""Registered queries on the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(func):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = func
        if sql is not None:
            ORACLES[name] = sql
        return func
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def long(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


# --- driver tables in the shapes of this library, in Spark and in SQL ---------

def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


VECTORS = "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"


def points(spark: SparkSession, folder: str) -> DataFrame:
    """A structure per label; the first three components are a position."""
    e = F.col("embedding")
    number = (1 + F.col("vec_id") % 3).cast("int")
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("structure_id"), F.col("vec_id").alias("atom_id"),
        number.alias("number"), F.array(F.lit("H"), F.lit("C"), F.lit("O"))[number - 1].alias("symbol"),
        *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")])


POINTS = """points AS (
  SELECT CAST(label AS VARCHAR) AS structure_id, vec_id AS atom_id, CAST(1 + vec_id % 3 AS INTEGER) AS number,
         CASE 1 + vec_id % 3 WHEN 1 THEN 'H' WHEN 2 THEN 'C' ELSE 'O' END AS symbol,
         CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
  FROM embeddings)"""


def cells(atoms: DataFrame, a: float = 1.0, b: float = 1.0, c: float = 1.0, shear: float = 0.0,
          periodic: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """One cell for each structure of a point table."""
    rows = [[a, 0.0, 0.0], [shear, b, 0.0], [0.0, 0.0, c]]
    return atoms.select("structure_id").distinct().select(
        "structure_id", F.array(*[F.array(*[F.lit(v) for v in r]) for r in rows]).alias("cell"),
        F.array(*[F.lit(p) for p in periodic]).alias("pbc"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """16 predictions of 4 classes per vector: softmax of its 16 quarters."""
    from latticeloom.functions.vectors import softmax

    part = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: F.struct(
        s.alias("sample"), softmax(F.slice("vec", s * 4 + 1, 4)).alias("probs")))
    return vectors(spark, folder).select("id", "label", F.explode(part).alias("_s")).select("id", "label", "_s.*")


SAMPLES = """raw AS (
  SELECT vec_id AS id, label, s AS sample, c AS class_id, exp(CAST(embedding[4 * s + c + 1] AS DOUBLE)) AS e
  FROM embeddings, range(16) t(s), range(4) u(c)),
samples AS (SELECT id, label, sample, class_id, e / sum(e) OVER (PARTITION BY id, sample) AS p FROM raw)"""
