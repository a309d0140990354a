"""A corpus pipeline of five stages; each works on all rows that the one before it kept.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``documents``. ``run`` writes each result as Parquet below the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeloom.llm import language, mixing, neartexts, packing, quality
from latticeloom.llm.queries import FRACTION, TARGETS, TOPICS, fold
from latticeloom.session import scratch_path

#: What the operators read; other columns of the input travel with their row, whatever their names.
READ = ["doc_id", "text", "lang", "source"]


def on_rows(docs: DataFrame, chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` keeps of ``READ``, with all their columns as they were."""
    return chosen(docs.select(*READ, F.struct("*").alias("_row"))).select("_row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects (score below 0.5); null and empty texts have a score like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs.select("doc_id", "text"), labels, train=fold(3) != 1)
    return on_rows(docs, lambda rows: quality.score_quality(rows, model).where(F.col("predicted") == 1))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language: null, or without any letter. With nothing to learn from no text has one."""
    samples = language.training_samples(docs.select(*READ), fold(5) != 0)
    return on_rows(docs, lambda rows: language.identify_language(rows, samples).where(F.col("lang_pred") != language.UNKNOWN))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8), of equal rows one."""
    return on_rows(docs, neartexts.one_of_each_group)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by raked probabilities; rows with equal ids stay or go together."""
    return on_rows(docs, lambda rows: mixing.mix_sources(rows, TARGETS, mixing.topic_by_markers(TOPICS), FRACTION))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("language", keep_languages), ("near_duplicates", keep_one_of_each), ("mixing", mix),
          ("packing", pack)]

#: SQL cannot express the first stage; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
