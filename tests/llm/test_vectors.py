"""Vector operators against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticeloom.llm import crosspolytope, forest

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    points = [r.normal(size=16) for _ in range(300)]
    rows = [(i, [float(x) for x in p], i % 3) for i, p in enumerate(points)]
    rows += [(300 + i, [float(x) for x in points[i % 7] + 0.05 * r.normal(size=16)], (i % 7) % 3) for i in range(60)]
    rows += [(400 + i, rows[5][1], 2) for i in range(20)] + [(5, rows[5][1], 2)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [None] + [1.0] * 15, 1), (503, [float("nan")] + [1.0] * 15, 1),
           (504, [float("inf")] + [1.0] * 15, 1), (505, [1.0] * 15, 1), (506, rows[0][1], None), (None, rows[1][1], 1)]
    return spark.createDataFrame(rows + odd, SCHEMA)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_links_against_brute_force(vectors):
    rows = vectors.collect()
    good = [i for i, r in enumerate(rows) if usable(r.embedding) and r.label is not None]
    unit = {i: np.array(rows[i].embedding, float) / np.linalg.norm(rows[i].embedding) for i in good}
    linked = {(i, j) for i in good for j in good if i != j and rows[i].label == rows[j].label and len(unit[i]) == len(unit[j])
              and unit[i] @ unit[j] >= 0.93}
    root = {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in linked:
        root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r.vec_id)
    want = sorted(((r.vec_id, sum((i, j) in linked for j in good), least.get(find(i))) for i, r in enumerate(rows)), key=str)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in crosspolytope.near_duplicate_vectors(vectors).collect()), key=str)
    assert got == want
    assert crosspolytope.near_duplicate_vectors(vectors.limit(0)).count() == 0


def test_rotations_keep_lengths_and_tables_find_pairs():
    r = np.random.default_rng(1)
    u = crosspolytope.unit_rows(r.normal(size=(3000, 64)))
    z = r.normal(size=u.shape)
    z = crosspolytope.unit_rows(z - (z * u).sum(axis=1, keepdims=True) * u)
    v = 0.93 * u + np.sqrt(1 - 0.93 ** 2) * z
    assert np.allclose(np.linalg.norm(crosspolytope.rotated(u, 3), axis=1), 1)
    missed = np.ones(len(u), dtype=bool)
    for t in range(crosspolytope.TABLES):
        a, b = crosspolytope.keys(u, t), crosspolytope.keys(v, t)
        missed &= ~((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1))
    assert missed.mean() < 0.001
    differ = np.bitwise_count((crosspolytope.sign_bits(u) ^ crosspolytope.sign_bits(v)).view(np.uint64)).sum(axis=1)
    assert differ.max() <= crosspolytope.most_differing_signs(0.93)


def test_nearest_recall_and_edges(vectors):
    rows = vectors.collect()
    got = forest.nearest(vectors, F.col("vec_id") % 10 == 0, k=5, rows_per_shard=100, block_queries=7, least=60).collect()
    points = np.array([r.embedding for r in rows if usable(r.embedding) and len(r.embedding) == 16], float)
    hits = total = 0
    for q in {r.vec_id for r in rows if r.vec_id is not None and r.vec_id % 10 == 0 and usable(r.embedding)}:
        mine = sorted((r.rank, r.score) for r in got if r.query_id == q)
        vec = np.array(next(r.embedding for r in rows if r.vec_id == q), float)
        true = np.sort(np.sqrt(((points - vec) ** 2).sum(axis=1)))[1:6]
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += sum(m[1] <= true[-1] + 1e-12 for m in mine)
        total += 5
    assert hits / total >= 0.9
    assert not {r.vec_id for r in got} & {500, 501, 502, 503, 504, 505}
    few = forest.nearest(vectors.where("vec_id < 4"), F.col("vec_id") == 0, k=10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert forest.nearest(vectors.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("offset", [0.0, 3.0])
def test_recall_at_the_defaults(spark, offset):
    """Vectors without structure, with and without a mean direction, in three shards."""
    r = np.random.default_rng(int(offset))
    points = (r.normal(size=(20_000, 32)) + offset).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(points)), "embedding": pa.array(list(points))}))
    got = forest.nearest(rows, F.col("vec_id") % 500 == 0).toPandas()
    points, hits = points.astype(float), 0
    for q, part in got.groupby("query_id"):
        gap = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        gap[q] = np.inf
        assert list(part.sort_values("rank")["rank"]) == list(range(1, 11))
        assert np.allclose(part["score"], gap[part["vec_id"]]) and part.sort_values("rank")["score"].is_monotonic_increasing
        hits += (part["score"] <= np.partition(gap, 9)[9] + 1e-9).sum()
    assert len(got) == 400 and hits >= 0.9 * 400


def test_structure_ends_a_search_early():
    r = np.random.default_rng(6)
    points = r.normal(size=(200, 64))[r.integers(0, 200, 8000)] + 0.15 * r.normal(size=(8000, 64))
    shard = forest.Shard(np.arange(8000), pa.array(range(8000)), points, forest.TREES, forest.BITS)
    ranges, visited, hits = shard.forest.ranges(points[:50]), 0, 0
    for i in range(50):
        place, _ = forest.search(shard.forest, points, shard.rows, ranges[i], points[i], i, 10, 500, 1)
        gap = ((points - points[i]) ** 2).sum(axis=1)
        gap[i] = np.inf
        hits += len(set(place[:10].tolist()) & set(np.argsort(gap)[:10].tolist()))
        seen = 0
        for fresh in shard.forest.levels(ranges[i]):
            seen += len(fresh)
            if seen >= 1000:
                break
        visited += seen
    assert hits >= 0.95 * 500 and visited / 50 < 0.2 * 8000


def test_equal_rows_as_query_and_result(spark):
    """Many equal vectors: ties go to the smaller id, a repeated row is its own copy's neighbour, null ids come first."""
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(300, 0, -1)] + [(7, [1.0, 2.0, 3.0], 0), (None, [1.0, 2.0, 3.0], 0), (900, [1.0, 2.0, 9.0], 0)]
    got = forest.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id").isin(7, 900), k=4, block_queries=1).collect()
    mine = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 900)
    assert [m[2] for m in mine] == [None, 1, 2, 3] and len(got) == 12
    assert all(r["score"] == 0.0 for r in got if r["query_id"] == 7)
