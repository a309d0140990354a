"""Registered queries run over the smallest tables; SQL where there is some; the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from latticeloom.llm import queries
from tools.check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        assert compare(got, con.execute(queries.ORACLES[name]).df()) == ""


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
            docs = out
        counts.append(out.count())
    assert counts[0] > counts[2] > counts[3] > 0
    assert out.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, FOLDER).count() == counts[-1]
