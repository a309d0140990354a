"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeloom.llm import (chat, crosspolytope, forest, language, licences, mixing, negatives, packing, quality, sharding,
                             simhash, urls, variants)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(func):
    QUERIES[func.__name__] = func
    return func


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(folds: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def held_out(folds: int, remainder: int):
    """Whether a row is held out; a row without an id is in no fold, is not learned from and not held out."""
    return F.coalesce(fold(folds) == remainder, F.lit(False)).alias("held_out")


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned outside the held-out third."""
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"), train=fold(3) != 1)
    return quality.score_quality(docs, model).select("doc_id", held_out(3, 1), "score", "predicted")


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned outside the held-out fifth."""
    docs = table(spark, folder, "documents")
    samples = language.training_samples(docs, fold(5) != 0)
    return language.identify_language(docs, samples).select(
        "doc_id", held_out(5, 0), "lang_pred", "score", "entropy")


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document in sequences of at most 4096 tokens."""
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


TOPICS = {"licence": ["License", "CC BY", "rights reserved"], "table": [" | "], "marked": ["###", "$$$", "!!"]}
TARGETS = {"source": 0.7, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
           "topic": {"prose": 0.8, "table": 0.08, "licence": 0.06, "marked": 0.06}}
FRACTION = 0.5


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents sampled so that half of the tokens stay, raked to source, language and topic targets."""
    kept = mixing.mix_sources(table(spark, folder, "documents"), TARGETS, mixing.topic_by_markers(TOPICS), FRACTION)
    return kept.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
                       F.col("_tokens").alias("n_tokens"), F.round("_probability", 6).alias("probability"))


ORACLES["op4_mixing"] = mixing.mixing_sql(TARGETS, TOPICS, FRACTION)


@query
def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all formatted conversations, and of one that quotes the template's control strings."""
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(turns))


@query
def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and template matches in every document."""
    found = licences.scan_licences(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                        F.size("blocks").cast("long").alias("n_blocks"))


@query
def op9_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard among 40, its place there, and its shard among 41."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    records = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard(records, 40).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard",
        "virtual_slot", "slot_bytes")


@query
def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return forest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors of one label."""
    return crosspolytope.near_duplicate_vectors(table(spark, folder, "embeddings"))


@query
def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, a seventh of the labels moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.integer_rows(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op12_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Rule, template and verdict of every url."""
    return urls.judge_urls(table(spark, folder, "pages"), RULES)


ORACLES["op12_urls"] = urls.urls_sql(RULES)


@query
def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, their near words and the forms they lead to."""
    return variants.variants(variants.vocabulary(table(spark, folder, "documents")))
