import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticeloom.distributed import hash_chosen, hash_rank, lookup_join, pseudo_random_order, quantile_list, quantiles, row_index
from latticeloom.operators.filters import split_duplicates
from latticeloom.operators.labels import split_rows


def skewed(spark, n=3000):
    """A third of the rows share one group."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("g"), F.col("id") % 17)).alias("g"), (F.col("id") * 7919 % 1009).alias("v"))


def test_row_index_is_dense_per_group(spark):
    df = skewed(spark)
    got = row_index(df, ["v", "id"], ["g"]).toPandas()
    want = df.toPandas().sort_values(["g", "v", "id"])
    want["row_index"] = want.groupby("g").cumcount()
    merged = got.merge(want, on="id")
    assert (merged["row_index_x"] == merged["row_index_y"]).all() and len(merged) == 3000


def test_row_index_spreads_a_hot_group(spark):
    df = spark.range(4000).withColumn("g", F.lit("hot"))
    tasks = df.repartitionByRange(4, "g", "id").select(F.spark_partition_id()).distinct().count()
    assert tasks > 1
    assert row_index(df, ["id"], ["g"]).where("row_index != id").count() == 0


def test_quantiles_both_ways(spark):
    df = skewed(spark)
    probs = [0.0, 0.2, 0.37, 0.5, 1.0]
    want = np.quantile(df.toPandas()["v"], probs)
    assert np.allclose(quantile_list(df, "v", probs), want)
    far = {r["prob"]: r["quantile"] for r in quantiles(df, "v", probs, local_counts=0).collect()}
    assert np.allclose([far[p] for p in probs], want)


def test_grouped_quantiles_both_ways(spark):
    df = skewed(spark)
    want = df.toPandas().groupby("g")["v"].quantile(0.3)
    for limit in (None, 0):
        got = quantiles(df, "v", [0.3], ["g"], local_counts=limit).toPandas().set_index("g")["quantile"]
        assert np.allclose(got.loc[want.index], want)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [1.0, 2.0, 9.0], "n": [5, 1, 4]}))
    want = np.quantile([1.0] * 5 + [2.0] + [9.0] * 4, 0.55)
    for limit in (None, 0):
        got = quantiles(df, "v", [0.55], weight="n", local_counts=limit).first()["quantile"]
        assert abs(got - want) < 1e-12


def test_lookup_join_without_broadcast_gives_the_same(spark):
    df, dim = skewed(spark), skewed(spark).select("g").distinct().withColumn("k", F.length("g"))
    a = lookup_join(df, dim, "g").select("id", "k").exceptAll(lookup_join(df, dim, "g", rows=2).select("id", "k"))
    assert a.count() == 0


def test_stratified_split_sizes(spark):
    out = split_rows(skewed(spark), "id", 0.2, "g").groupBy("g", "split").count().toPandas().pivot(
        index="g", columns="split", values="count")
    share = out["validation"] / out.sum(axis=1)
    assert out["validation"].sum() == 600 and (abs(share - 0.2) < 0.02).all()


def test_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "pos int, k string")
    got = {r["pos"]: r["is_duplicate"] for r in split_duplicates(df, "k", "pos").collect()}
    assert got[1] is False and got[3] is True and got[2] is False


def drawn_rows(spark):
    """Groups of 3,000, 7, 1 and (null) 40 rows; ids 0 to 4 of the large one stand there 100 times."""
    rows = [("big", i if i >= 500 else i % 5) for i in range(3000)] + [("few", i) for i in range(7)] + [("one", 1)] + [(None, i) for i in range(40)]
    return spark.createDataFrame(rows, "g string, id long"), rows


@pytest.mark.parametrize("digits", [1, 3])
def test_selection_by_digest(spark, digits):
    df, rows = drawn_rows(spark)
    digest = pseudo_random_order(F.col("id"), 3)
    order = lambda i: hashlib.md5(f"{i}#3".encode()).hexdigest()
    groups = {g: sorted(order(i) + f" {i:6d}" for h, i in rows if h == g) for g, _ in rows}
    for take, wanted in ((F.floor(F.col("_n") * 0.3), lambda n: int(n * 0.3)), (F.lit(0), lambda n: 0), (F.lit(5000), lambda n: n)):
        got = hash_chosen(df, digest, ["id"], take, ["g"], digits=digits).collect()
        assert len(got) == len(rows)
        for g, keys in groups.items():
            chosen = sorted(order(r["id"]) + f" {r['id']:6d}" for r in got if r["g"] == g and r["_chosen"])
            assert chosen == keys[:wanted(len(keys))]
    alone = hash_chosen(df.limit(0), digest, ["id"], F.lit(3), digits=digits)
    assert alone.columns == ["g", "id", "_chosen"] and alone.count() == 0
    ranked = hash_rank(df, digest, ["id"], ["g"], digits=digits).collect()
    for g, keys in groups.items():
        places = sorted((r["row_index"], order(r["id"]) + f" {r['id']:6d}") for r in ranked if r["g"] == g)
        assert places == list(enumerate(keys))
