"""Pipeline stages on odd tables: nulls, empty tables, repeated rows, and columns named like the operators' own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
CLASHING = {"score": "string", "entropy": "string", "predicted": "string", "lang_pred": "int", "_source": "string", "_lang": "int",
            "_topic": "string", "_tokens": "string", "_probability": "string", "_key": "string", "_h": "string", "_g": "string",
            "_row": "string", "node": "int", "a.b": "string"}
ROWS = [(None, None, None, None, None), (-1, None, "en", None, 0), (-2, "", None, "s", None), (-3, "", "en", "s", 0), (-3, "", "en", "s", 0),
        (-4, "Preis: 12 € | 15 € | 99 € | 100 € " * 6, "de", "s", 1), (-5, "🎉🎉 great news 🚀 everyone 🎈 " * 5, "en", "s", 1),
        (-6, "Το γρήγορο καφέ αλεπού πηδάει πάνω από το σκυλί " * 3, None, "s", 1), (-7, "price: 12 € or 15 € " * 9, "en", None, 1),
        (-8, "12 34 56 !!", "en", "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.unionByName(spark.createDataFrame(ROWS, docs.schema))
    for i, (name, kind) in enumerate(CLASHING.items()):
        rows = rows.withColumn(name, F.lit(str(i)).cast(kind))
    return rows.cache()


@pytest.mark.parametrize("name", ["quality", "language", "near_duplicates", "mixing"])
def test_columns_stay(spark, odd, name):
    out = STAGES[name](spark, odd, FOLDER)
    assert out.schema.simpleString() == odd.schema.simpleString()
    got = out.cache()
    assert got.exceptAll(odd).count() == 0 and got.count() > 20
    empty = STAGES[name](spark, odd.limit(0), FOLDER)
    assert empty.columns == odd.columns and empty.count() == 0


def test_packing(spark, odd):
    got = STAGES["packing"](spark, odd, FOLDER).select("doc_id", "length").collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in odd.select("doc_id").collect()}
    assert STAGES["packing"](spark, odd.limit(0), FOLDER).count() == 0


def test_language_keeps_texts_of_any_script(spark, odd):
    kept = {r["doc_id"] for r in STAGES["language"](spark, odd, FOLDER).select("doc_id").collect()}
    assert {-4, -5, -6, -7} <= kept and not kept & {None, -1, -2, -3, -8}
    had_letters = odd.where("doc_id >= 0").where(F.col("text").rlike("[A-Za-z]")).select("doc_id").collect()
    assert {r["doc_id"] for r in had_letters} <= kept


def test_one_of_repeated_rows(spark, odd):
    kept = [r["doc_id"] for r in STAGES["near_duplicates"](spark, odd, FOLDER).where("doc_id < 0 or doc_id is null").collect()]
    # texts without a word are one group: the null id comes first
    assert sorted(kept, key=lambda v: (v is not None, v)) == [None, -8, -7, -6, -5, -4]
