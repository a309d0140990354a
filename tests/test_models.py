import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticeloom.functions import algebra, units
from latticeloom.functions import vectors as V
from latticeloom.operators import energies, features, fields, kernels, linear, ml, sparse_model, uncertainty
from latticeloom.operators import labels as L


def matrix(spark, x, **columns):
    pdf = pd.DataFrame({"id": range(len(x)), "vec": [[float(v) for v in r] for r in x], **columns})
    return spark.createDataFrame(pdf)


def collected(df, name="vec"):
    return np.array([r[name] for r in df.orderBy("id").select(name).collect()])


RANDOM = np.random.default_rng(42).uniform(size=(100, 5))


# --- linear ------------------------------------------------------------------

def test_standardise_modes(spark):
    x = RANDOM.copy()
    x[:, 3] = 2.0                                     # no spread: divided by one
    df = matrix(spark, x)
    z = collected(linear.standardise(df))
    assert np.allclose(z.mean(0), 0) and np.allclose(z.std(0)[[0, 1, 2, 4]], 1) and np.allclose(z[:, 3], 0)
    assert np.allclose(collected(linear.standardise(df, "mean")), x - x.mean(0))
    assert np.allclose(collected(linear.standardise(df, "none")), x)
    with pytest.raises(ValueError):
        linear.standardise(df, "median")


def test_gram_pca_svd(spark):
    df = matrix(spark, RANDOM)
    n, g = linear.gram_matrix(df)
    assert n == 100 and np.allclose(g, RANDOM.T @ RANDOM)
    out, share = linear.pca(df, 2, "mean-variance")
    z = (RANDOM - RANDOM.mean(0)) / RANDOM.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    got = collected(out, "coords")
    assert np.allclose(abs(got), abs(z @ vt[:2].T)) and share == pytest.approx((s[:2] ** 2).sum() / (s ** 2).sum())
    out, values = linear.truncated_svd(df, 2, "none")
    _, s, vt = np.linalg.svd(RANDOM, full_matrices=False)
    assert np.allclose(values, s[:2]) and np.allclose(abs(collected(out, "coords")), abs(RANDOM @ vt[:2].T))


def test_gram_of_many_columns(spark):
    x = np.random.default_rng(0).normal(size=(30, 210))
    _, g = linear.gram_matrix(matrix(spark, x))
    assert np.allclose(g, x.T @ x)


# --- similarity --------------------------------------------------------------

def test_similarities_of_equal_vectors_and_errors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0])], "id int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(*[V.similarity(a, b, m).alias(m) for m in ("cosine_sim", "euclidean", "minkowski")],
                  V.similarity(a, a, "tanimoto").alias("t")).first()
    assert np.allclose(list(r), 1.0)
    with pytest.raises(NotImplementedError):
        V.similarity(a, b, "hamming")


def test_kernel_blocks_give_the_whole_matrix(spark):
    df = matrix(spark, RANDOM)
    got = kernels.cross_similarity(df, df, "cosine_sim", block_rows=7).toPandas().pivot(
        index="row_id", columns="col_id", values="score").to_numpy()
    u = RANDOM / np.linalg.norm(RANDOM, axis=1)[:, None]
    assert got.shape == (100, 100) and np.allclose(got, u @ u.T)
    for rows in (13, 1024):
        sym = kernels.symmetric_kernel(df, block_rows=rows).toPandas()
        assert len(sym) == 10_000 and np.allclose(sym.pivot(index="row_id", columns="col_id", values="score"), RANDOM @ RANDOM.T)


def test_kernel_blocks_are_stored_once(spark):
    """No vector is shuffled for every block of the other set; several parts of blocks a side."""
    df = matrix(spark, RANDOM)
    for got in (kernels.rectangular_kernel(df, df, block_rows=3), kernels.symmetric_kernel(df, block_rows=3)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
        assert got.select("row_id", "col_id").distinct().count() == got.count() == 10_000
        assert np.allclose(got.toPandas().pivot(index="row_id", columns="col_id", values="score"), RANDOM @ RANDOM.T)


@pytest.mark.parametrize("metric", sorted(V.METRICS))
def test_block_measures_equal_the_columns(spark, metric):
    rows = [(i, v) for i, v in enumerate([[1.0, 2.0, -1.0], [0.0, 0.0, 0.0], None, [1.0, None, 2.0], [1.0, 2.0], [], [1.0, 2.0, -1.0], [0.5, 1e-9, 3.0]])]
    rows += [(7, [4.0, 4.0, 4.0])]                                     # an id twice
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    for power in (1.0, 2.0):
        got = kernels.cross_similarity(df, df, metric, power, block_rows=4)
        a, b = df.toDF("row_id", "a"), df.toDF("col_id", "b")
        want = a.crossJoin(b).select("row_id", "col_id", V.similarity(F.col("a"), F.col("b"), metric, power).alias("score"))
        key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0.0)
        x, y = sorted(map(tuple, got.collect()), key=key), sorted(map(tuple, want.collect()), key=key)
        assert [r[:2] for r in x] == [r[:2] for r in y] and len(x) == 81
        for p, q in zip(x, y, strict=True):
            # two empty vectors have nothing to compare
            assert (p[2] is None) == (q[2] is None) or p[:2] == (5, 5), (p, q)
            assert p[2] is None or q[2] is None or p[2] == pytest.approx(q[2], abs=1e-12)
    assert kernels.cross_similarity(df, df.limit(0), metric).count() == 0


def test_many_columns(spark):
    """10,000 columns, planted directions, no matrix of columns by columns."""
    d, n = 10_000, 120
    rng = np.random.default_rng(1)
    directions = np.linalg.qr(rng.normal(size=(d, 2)))[0]
    weights = rng.normal(size=(n, 2)) * [40.0, 20.0]
    x = weights @ directions.T + 0.01 * rng.normal(size=(n, d)) + 3.0
    df = spark.createDataFrame(pa.table({"id": list(range(n)), "vec": pa.array(list(x))}))
    out, share = linear.pca(df, 2, "mean")
    coords = np.stack(out.orderBy("id").toPandas()["coords"])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(coords), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    assert share == pytest.approx((s[:2] ** 2).sum() / (s ** 2).sum(), abs=1e-9)
    _, values = linear.truncated_svd(df, 3, "none")
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:3])


def test_directions_of_flat_spectra(spark):
    x = np.random.default_rng(2).normal(size=(300, 40))
    found, v = linear.top_directions(matrix(spark, x), 3, [0.0] * 40, [1.0] * 40)
    want = np.linalg.eigvalsh(x.T @ x)[::-1][:3]
    assert np.allclose(found, want) and np.allclose(v.T @ v, np.eye(3)) and np.allclose(np.linalg.norm(x @ v, axis=0) ** 2, want)


def test_planted_rings(spark):
    """Three rings inside each other: no single direction of space parts them."""
    rng = np.random.default_rng(8)
    points = []
    for ring, (r, n) in enumerate(((1.0, 40), (2.0, 70), (3.0, 100))):
        turn = 2 * np.pi * (np.arange(n) + rng.uniform(-0.2, 0.2, n)) / n
        points += [(ring, r * np.cos(t), r * np.sin(t)) for t in turn]
    place = np.array([p[1:] for p in points])
    apart = np.linalg.norm(place[:, None] - place[None], axis=2)
    edges = [(i, j, float(np.exp(-apart[i, j] ** 2 / 0.08))) for i in range(len(points)) for j in range(i) if apart[i, j] < 0.5]
    edges += [(0, 40, 1e-4), (41, 110, 1e-4)]                                   # faint bridges
    ids = spark.range(len(points) + 2)
    out = {r["id"]: r["cluster"] for r in ml.spectral_clusters(spark.createDataFrame(edges, "src long, dst long, weight double"), 3, ids).collect()}
    assert len(out) == len(points) + 2 and [out[len(points)], out[len(points) + 1]] == [None, None]
    groups = [{out[i] for i, p in enumerate(points) if p[0] == ring} for ring in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_vector_shapes(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 2.0, 2.0])], "id int, v array<double>")
    r = df.select(V.min_max(F.col("v")).alias("m"), V.argmax(F.col("v")).alias("a"), V.one_hot(F.lit(2), 3).alias("h"),
                  V.reshape_rows(F.col("v"), 2).alias("r"), V.format_probabilities(F.col("v")).alias("t"),
                  V.to_8bit(F.col("v")).alias("e")).first()
    assert r["m"] == [1.0, 0.0, 0.5, 0.5] and r["a"] == 0 and r["h"] == [0.0, 0.0, 1.0]
    assert r["r"] == [[3.0, 1.0], [2.0, 2.0]] and r["t"].startswith("p0:3.0000 p1:") and r["e"] == [255, 0, 127, 127]
    with pytest.raises(Exception, match="multiple of 3"):
        df.select(V.reshape_rows(F.col("v"), 3)).collect()


# --- sparse models -----------------------------------------------------------

@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8))
    y = 3 * x[:, 2] - 2 * x[:, 5] + 0.5 * x[:, 0] + 0.1 * rng.normal(size=400) + 4
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(8)]).assign(y=y, id=range(400))
    return spark.createDataFrame(pdf), pdf


def test_subset_search_matches_least_squares(table):
    df, pdf = table
    names = [f"f{i}" for i in range(8)]
    m = sparse_model.moments(df, names, "y")
    got = sparse_model.subset_errors(df, names, m, 3).toPandas()
    assert [tuple(s) for s in sorted(map(tuple, got["subset"]))] == list(itertools.combinations(range(8), 3))
    for s, mse in zip(got["subset"], got["mse"]):
        a = np.column_stack([pdf[names].to_numpy()[:, s], np.ones(400)])
        assert mse == pytest.approx(np.linalg.lstsq(a, pdf["y"], rcond=None)[1][0] / 400, rel=1e-8)
    models = sparse_model.fit_sparse_model(df, names, "y", 3, 5)
    assert models[0]["features"] == ["f2"] and set(models[2]["features"]) == {"f0", "f2", "f5"}
    assert models[2]["intercept"] == pytest.approx(4, abs=0.05)
    assert set(sparse_model.fit_by_screening(df, names, "y", 2, 2)[1]["features"]) == {"f2", "f5"}


def test_lasso_matches_the_library_solver(table):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df, pdf = table
    names = [f"f{i}" for i in range(8)]
    m = sparse_model.moments(df, names, "y")
    z = (pdf[names] - pdf[names].mean()) / pdf[names].std(ddof=0)
    top = np.abs(z.T @ pdf["y"]).max() / 400
    lam = top * 0.001 ** (9 / 99)                     # tenth penalty of the grid
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(
        df.sparkSession.createDataFrame(z.assign(y=pdf["y"])))
    fit = LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=lam, standardization=False, tol=1e-10).fit(ready)
    chosen = set(np.flatnonzero(np.abs(fit.coefficients.toArray()) > 1e-6).tolist())
    path = set()
    for k in range(1, 9):                             # features met up to that penalty
        got = set(sparse_model.lasso_screen(m, k))
        if len(got) == k and chosen >= got:
            path = got
    assert path and path <= chosen


def test_singular_subsets_are_left_out(spark):
    pdf = pd.DataFrame({"a": np.arange(20.0), "b": 2 * np.arange(20.0), "c": np.random.default_rng(0).normal(size=20)})
    pdf["y"] = pdf["a"] + pdf["c"]
    df = spark.createDataFrame(pdf)
    m = sparse_model.moments(df, ["a", "b", "c"], "y")
    assert sorted(map(tuple, sparse_model.subset_errors(df, ["a", "b", "c"], m, 2).toPandas()["subset"])) == [(0, 2), (1, 2)]


def test_input_checks(spark):
    df = spark.createDataFrame([(1.0, "x", 2.0, None)], "a double, s string, y double, g double")
    for args in ((["a"], "y"), (["a", "s"], "y"), (["a", "g"], "y"), (["a", "y"], "y", ["u"])):
        with pytest.raises(ValueError):
            sparse_model.check_inputs(df, *args)


def test_long_screening(spark, table):
    df, _ = table
    values = features.combine_features_long(df, "id", [(f"f{i}", F.col(f"f{i}")) for i in range(8)])
    assert sparse_model.screen_long(values, df, ["y"], 2) == ["f2", "f5"]
    rest = df.withColumn("r", F.col("y") - 3 * F.col("f2"))
    assert sparse_model.screen_long(values, rest, ["y", "r"], 1, known=["f2"]) == ["f5"]
    models = sparse_model.fit_by_long_screening(values, df.select("id", F.col("y").alias("target")), 3, 2, 2)
    assert [sorted(m["features"]) for m in models] == [["f2"], ["f2", "f5"], ["f0", "f2", "f5"]]
    w = dict(zip(models[2]["features"], models[2]["weights"], strict=True))
    assert w["f2"] == pytest.approx(3, abs=0.05) and w["f5"] == pytest.approx(-2, abs=0.05) and models[2]["intercept"] == pytest.approx(4, abs=0.05)
    assert models[0]["mse"] > models[1]["mse"] > models[2]["mse"]
    flat = values.withColumn("value", F.when(F.col("feature") == "f2", 1.0).otherwise(F.col("value")))
    assert sparse_model.screen_long(flat, df, ["y"], 8)[0] == "f5" and "f2" not in sparse_model.screen_long(flat, df, ["y"], 8)


# --- clustering and classification -------------------------------------------

def blobs(n=240, hot=False):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.25, (n // 3, 3)) for c in (0, 3, 6)])
    if hot:
        x[: n // 3] = rng.normal(0, 1e-3, (n // 3, 3))
        x[:10] = x[0]
    return np.vstack([x, [[20, 20, 20]]])


@pytest.mark.parametrize("hot", [False, True])
def test_dbscan_matches_brute_force(spark, hot):
    x = blobs(hot=hot)
    eps, m = 0.35, 8
    pdf = pd.DataFrame(x, columns=list("xyz")).assign(id=range(len(x)))
    got = ml.dbscan(spark.createDataFrame(pdf), eps, m).orderBy("id").toPandas()
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    label = np.where(core, np.arange(len(x)), -1)
    changed = True
    while changed:
        new = np.array([min([label[j] for j in np.flatnonzero(near[i] & core)], default=-1) if core[i] else -1
                        for i in range(len(x))])
        changed = (new != label).any()
        label = new
    for i in np.flatnonzero(~core):
        js = np.flatnonzero(near[i] & core)
        label[i] = label[js[0]] if len(js) else -1
    assert (got["is_core"].to_numpy() == core).all()
    assert (got["cluster"].to_numpy()[core] == label[core]).all()
    assert ((got["cluster"].to_numpy() == -1) == (label == -1)).all()


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 150], "a long, b long")
    got = ml.connected_components(edges).toPandas().set_index("id")["component"].sort_index()
    assert (got.loc[:150] == 0).all() and (got.loc[151:] == 151).all() and len(got) == n + 1


def test_cluster_methods(spark):
    from pyspark.ml.clustering import KMeans

    df = matrix(spark, blobs())
    k = ml.cluster(df, "kmeans", k=3).toPandas()
    assert k["cluster"].nunique() == 3
    g = ml.cluster(df, "gaussian_mixture", k=2).toPandas()
    assert np.allclose([sum(p) for p in g["cluster_probs"]], 1)
    assert ml.cluster(df, estimator=KMeans(k=2, seed=1, initMode="random")).toPandas()["cluster"].nunique() == 2
    with pytest.raises(NotImplementedError):
        ml.cluster(df, "ward")


def test_classifier_and_committee(spark):
    x = blobs()[:240]
    df = matrix(spark, x, label=np.repeat([0.0, 1.0, 2.0], 80))
    split = L.split_rows(df, "id", 0.25, "label")
    train, held = split.where("split = 'train'"), split.where("split = 'validation'")
    model, accuracy, layout = ml.train_classifier(train, held, [[4], [8]], max_iter=60)
    assert accuracy > 0.9 and layout in ((4,), (8,))
    probs = collected(ml.score(df, model), "probs")
    assert np.allclose(probs.sum(1), 1) and (probs >= 0).all()
    with pytest.raises(ValueError):
        ml.train_classifier(train.where("label < 2"), held, [[4]])
    models = ml.train_committee(train, 3, [4], 3, max_iter=30)
    out = uncertainty.committee_uncertainty(ml.committee_samples(held, models), 3).toPandas()
    assert (out["n_samples"] == 3).all() and (out["mutual_information"] > -1e-6).all()


def test_uncertainty_of_a_sure_and_a_torn_committee(spark):
    rows = [("sure", [1.0, 0.0])] * 4 + [("torn", [1.0, 0.0])] * 2 + [("torn", [0.0, 1.0])] * 2
    df = spark.createDataFrame(rows, "id string, probs array<double>")
    r = {x["id"]: x for x in uncertainty.committee_uncertainty(df, 2).collect()}
    assert r["sure"]["variation_ratio"] == 0 and r["torn"]["variation_ratio"] == 0.5
    assert r["torn"]["predictive_entropy"] == pytest.approx(1) and r["torn"]["mutual_information"] == pytest.approx(1, abs=1e-9)


def test_transition_blocks_must_fit(spark):
    df = spark.range(20).withColumn("v", F.col("id").cast("double"))
    out = uncertainty.transition_aggregate(df, "id", ["v"], 4, 4, 0.0, 0.3, 4).orderBy("step").toPandas()
    assert np.allclose(out["a_to_b_index"], [0, .1, .2, .3]) and out["v_mean"][0] == 5.5
    with pytest.raises(ValueError):
        uncertainty.transition_aggregate(df, "id", ["v"], 4, 4)


# --- hulls, energies, labels, units ------------------------------------------

def test_convex_hulls(spark):
    inner = np.random.default_rng(0).uniform(0.1, 0.9, (300, 2))
    pts = np.vstack([inner, [[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0]]])
    pdf = pd.DataFrame(pts, columns=["x", "y"]).assign(c="square")
    pdf = pd.concat([pdf, pd.DataFrame({"x": [1.0, 2.0, 7.0], "y": [1.0, 1.0, 7.0], "c": ["pair", "pair", "one"]})])
    got = fields.convex_hulls(spark.createDataFrame(pdf), "c").orderBy("c", "corner").toPandas()
    square = got[got["c"] == "square"][["x", "y"]].to_numpy()
    assert square.tolist() == [[0, 0], [1, 0], [1, 1], [0, 1]]
    assert (got["c"] == "pair").sum() == 2 and (got["c"] == "one").sum() == 0


@pytest.mark.parametrize("most", [7, 20_000])
def test_hulls_in_parts(spark, most):
    """Sides with many points are split; circles, lattices with corners on lines, and clouds."""
    rng = np.random.default_rng(4)
    turn = rng.uniform(0, 2 * np.pi, 200)
    sets = {"circle": np.column_stack([np.cos(turn), np.sin(turn)]), "cloud": rng.normal(size=(400, 2)),
            "lattice": np.array([(i, j) for i in range(7) for j in range(5)], dtype=float), "diamond": np.array(
                [(i, j) for i in range(-4, 5) for j in range(-4, 5) if abs(i) + abs(j) <= 4], dtype=float) / 3,
            "line": np.column_stack([np.arange(9.0), 2 * np.arange(9.0)]), "same": np.ones((5, 2))}
    rows = [(n, float(x), float(y)) for n, p in sets.items() for x, y in p] + [(None, 0.0, 0.0), (None, 1.0, 0.0), (None, 0.0, 1.0), ("cloud", None, 9.0)]
    got = fields.convex_hulls(spark.createDataFrame(rows, "c string, x double, y double"), "c", most=most).orderBy("c", "corner").toPandas()
    for name, p in sets.items():
        part = got[got["c"] == name]
        want = fields._hull([tuple(q) for q in p.tolist()])
        assert list(part["corner"]) == list(range(len(part)))
        assert [tuple(q) for q in part[["x", "y"]].to_numpy().tolist()] == (want if len(want) > 1 else []), name
    assert got["c"].isna().sum() == 3


def test_binary_energies_by_hand(spark):
    df = spark.createDataFrame([("SeZn", 225, 10.0), ("SeZn", 221, 8.0), ("SeZn", 227, 4.0), ("SeZn", 216, 5.0), ("LiF", 225, 3.0)],
                               "m string, sg int, e double")
    out = energies.binary_energy_differences(df, "m", "sg", "e", [(225, 221), (216, 227)]).toPandas()
    assert len(out) == 4 and (out["225_216"] == 2.0).all()         # (8 - 4) / 2; LiF has one phase only
    with pytest.raises(ValueError):
        energies.select_phase_pairs(energies.phase_differences(df, "m", "sg", "e"), [(1, 2)], "m", "rows")
    with pytest.raises(ValueError):
        energies.two_phase_difference(df.withColumn("l", F.lit(1)), "m", "l", "e", strict=True)


def test_quantile_labels_and_unique_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 1, 2, 3, 4]], "v double")
    with pytest.raises(ValueError):
        L.quantile_edges(df, "v", 4)
    out, edges = L.adaptive_quantile_bins(df, "v")
    assert len(set(edges)) == len(edges) and out.select(F.max("color_bin")).first()[0] == len(edges) - 2


def test_label_errors(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    with pytest.raises(KeyError, match="valid names"):
        L.extract_labels(df, "nope")
    with pytest.raises(ValueError):
        L.extract_labels(df, "id", False, "log")


def test_units():
    c = units.conversion_factor
    assert c("J", "eV") * c("eV", "J") == pytest.approx(1)
    assert c("kcal/mol", "kJ/mol") == pytest.approx(4.184) and c("angstrom", "nm") == pytest.approx(0.1)
    assert c("meter*second**-2", "cm/s^2") == pytest.approx(100) and c("hartree", "eV") == pytest.approx(27.2113845, rel=1e-6)
    assert c("kg") == pytest.approx(1) and c("usrEnergy", "eV", {"usrEnergy": ("eV", 2.5)}) == pytest.approx(2.5)
    with pytest.raises(ValueError):
        c("J", "m")
    with pytest.raises(KeyError):
        c("furlongs")
    with pytest.raises(ValueError):
        units.unit_table({"energy": ("eV", 1.0)})


def test_feature_space_size_and_direction(spark):
    space = features.feature_space({"a": "a3", "b": "a3", "g": "a0", "p": "a0"}, ["+", "-", "|-|", "/", "^2", "exp"], {"a": 10.0})
    names = [n for n, _ in space]
    assert len(names) == len(set(names)) and {"(a-b)", "(b-a)", "g/p", "p/g", "exp((a+b)^2)", "(b-a)/exp(a)"} <= set(names)
    df = spark.createDataFrame([(1, 0.5, 2.0, 3.0, 4.0)], "id int, a double, b double, g double, p double")
    r = features.combine_features(df, "id", space).first().asDict()
    assert r["(b-a)"] == 1.5 and r["p/g"] == pytest.approx(4 / 3) and r["exp(a)"] == pytest.approx(np.exp(5.0))
    with pytest.raises(ValueError):
        features.combine_features(df, "id", space * 10)


def test_zero_divisors_give_null(spark):
    df = spark.createDataFrame([(0.0,)], "a double")
    assert df.select(algebra.BINARY["/"](F.lit(1.0), F.col("a"))).first()[0] is None
    assert df.select(algebra.UNARY["^-2"](F.col("a"))).first()[0] is None


def test_half_up_rounds_like_spark(spark):
    rng = np.random.default_rng(4)
    odd = [0.0, -0.0, 5e-7, -5e-7, 1e-300, 1e300, 2.0 ** 52 + 0.5, 4e9 + 2.5e-6, float("inf"), float("-inf"), float("nan")]
    values = np.concatenate([rng.normal(size=3000), (2 * rng.integers(-10 ** 6, 10 ** 6, 3000) + 1) / 2e6, rng.normal(size=500) * 10 ** rng.uniform(-9, 18, 500), odd])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "v": values}))
    for digits in (6, 4):
        want = df.select("i", (F.round("v", digits) + F.lit(0.0)).alias("w")).toPandas().sort_values("i")["w"].to_numpy()
        got = kernels.half_up(values, digits)
        assert np.array_equal(got, want, equal_nan=True) and np.array_equal(np.signbit(got), np.signbit(want))


KERNEL_SCORES = {
    "J10_cross_similarity": (6, lambda x, y: x @ y / (x @ x + y @ y - x @ y)),
    "J11_symmetric_kernel": (4, lambda x, y: np.sqrt(abs(1 - (x @ y) ** 2 / (x @ x) / (y @ y) + 1e-10))),
    "J12_rectangular_kernel": (6, lambda x, y: (x @ y) ** 2),
}


@pytest.mark.parametrize("name", list(KERNEL_SCORES))
def test_kernel_scores_are_rounded_in_blocks(spark, tmp_path, name):
    """No decimal number is made of each score: the plan rounds no column."""
    from latticeloom.plans import load_queries

    rng = np.random.default_rng(6)
    x = rng.normal(size=(230, 64)).astype(np.float32)
    rows = [(i, i % 10, list(map(float, v))) for i, v in enumerate(x)] + [(230, 1, None), (231, 1, [1.0, None])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = load_queries().QUERIES[name](spark, str(tmp_path))
    assert "round(" not in out._jdf.queryExecution().optimizedPlan().toString()
    digits, score = KERNEL_SCORES[name]
    got = out.collect()
    unit = x.astype(float)
    for r in got[::97]:
        if max(r.row_id, r.col_id) > 229:
            assert r.score is None
        else:
            assert r.score == round(r.score, digits) and abs(r.score - score(unit[r.row_id], unit[r.col_id])) <= 0.6 * 10 ** -digits
    keys = {(r.row_id, r.col_id) for r in got}
    cols = {"J10_cross_similarity": range(1, 232, 2), "J11_symmetric_kernel": range(232), "J12_rectangular_kernel": [i for i in range(232) if i > 229 or i % 10 < 5]}[name]
    assert len(got) == len(keys) and keys == set(itertools.product(range(0, 232, 2) if name == "J10_cross_similarity" else range(232), cols))


def test_dense_cells_link_like_points(spark, monkeypatch):
    """Dense neighbouring cells are linked by boxes of their parts."""
    monkeypatch.setattr(ml, "DENSE_CELL", 4)
    test_dbscan_matches_brute_force(spark, False)
    rng = np.random.default_rng(3)
    a = np.column_stack([rng.uniform(0, 3, 400), rng.uniform(0, 0.1, 400), rng.uniform(0, 0.1, 400)])
    gap = np.vstack([a[(a[:, 0] < 1.2) | (a[:, 0] > 1.56)], [[1.2, 0, 0], [1.56, 0, 0]]])
    pdf = pd.DataFrame(gap, columns=list("xyz")).assign(id=range(len(gap)))
    for eps, n in ((0.35, 2), (0.37, 1)):
        got = ml.dbscan(spark.createDataFrame(pdf), eps, 5).toPandas()
        assert got["cluster"].nunique() == n and (got["cluster"] >= 0).all()


def test_spectral_clusters_keep_isolated_points(spark):
    from latticeloom.plans import load_queries

    points = spark.range(6)
    affinity = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    out = {r.id: r.cluster for r in ml.spectral_clusters(affinity, 2, points).collect()}
    assert sorted(out) == list(range(6)) and all((out[i] is None) == (i > 3) for i in out)
    none = ml.spectral_clusters(affinity.limit(0), 2, points).collect()
    assert len(none) == 6 and all(r.cluster is None for r in none)
    folder = "/root/testdata/sf0.01"
    rows = load_queries().QUERIES["E11_spectral_clusters"](spark, folder).collect()
    ids = [r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(r.id for r in rows) == sorted(ids)


def test_neighbour_sums_equal_those_of_pairs(spark):
    """Blocks of a few points, ids with several positions, far points and rows that have no place."""
    from latticeloom.operators.neighbors import neighbour_pairs
    from latticeloom.operators.neighborsums import NeighbourWeights

    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(60)] + [(i, *map(float, rng.normal(size=3))) for i in (3, 3, 40, 59)]
    rows += [rows[5], rows[5], (70, 50.0, 0.0, 0.0), (71, None, 0.0, 0.0), (72, float("nan"), 0.0, 0.0), (None, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    near = neighbour_pairs(points.select(F.lit("all").alias("structure_id"), F.col("id").alias("atom_id"), F.lit(1).alias("number"), "x", "y", "z"),
                           0.9, half=True).toPandas()
    want = np.zeros((80, 80))
    for a, b, r in zip(near["atom_id"], near["other_id"], near["r"]):
        want[a, b] = want[b, a] = max(want[a, b], np.exp(-5 * r))
    x = rng.normal(size=(80, 2))
    given = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, x array<double>")
    for size in (7, 1024):
        weights = NeighbourWeights(points, 0.9, 5.0, size)
        got = {r.id: r.y for r in weights.sums(given, 2).collect()}
        assert sorted(got) == [*range(60), 70] and all(np.allclose(got[i], (want @ x)[i]) for i in got)
        degrees = {r.id: r.d for r in weights.degrees.collect()}
        assert degrees.keys() == set(np.flatnonzero(want.sum(0)).tolist()) and all(np.isclose(d, want[i].sum()) for i, d in degrees.items())
    none = ml.spectral_clusters(NeighbourWeights(points.limit(0), 0.9, 5.0), 2, points.select("id")).collect()
    assert len(none) == len(rows) and all(r.cluster is None for r in none)


def test_spectral_rounds_go_on_from_what_is_left(spark, monkeypatch):
    """Three parts of a graph are told to the tolerance in three rounds of four products, after one for the degrees."""
    from latticeloom.operators.neighborsums import NeighbourWeights

    rng = np.random.default_rng(2)
    at = rng.normal(size=(240, 3)) * 0.12 + 5.0 * np.arange(240)[:, None] % 15
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(at)], "id long, x double, y double, z double")
    widths, product = [], NeighbourWeights.sums
    monkeypatch.setattr(NeighbourWeights, "sums", lambda self, rows, width: (widths.append(width), product(self, rows, width))[1])
    weights = NeighbourWeights(rows, 0.3, 5.0)
    found, values = ml.spectral_embedding(weights, 3)
    got = found.toPandas().set_index("id")["vec"]
    assert widths == [1] + [7] * 12 and np.allclose(values, 1.0, atol=1e-11)
    apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    near = np.where(apart <= 0.3, np.exp(-5 * apart), 0.0)
    np.fill_diagonal(near, 0.0)
    root = np.sqrt(near.sum(axis=0))[got.index]
    a = near[np.ix_(got.index, got.index)] / root[:, None] / root[None]
    x = np.stack(got.to_numpy())
    assert np.allclose(a @ x, x, atol=1e-5) and np.allclose(x.T @ x, np.eye(3), atol=1e-9)


@pytest.mark.parametrize("origin", [0.0, 1e4, 1e9])
def test_neighbours_in_blocks_are_those_of_differences(origin):
    """Distances of just the radius, equal places, and blocks that reach far or lie far from the origin."""
    from latticeloom.operators import neighborsums

    rng = np.random.default_rng(7)
    grid = rng.integers(-6, 7, size=(300, 3)) / 20
    for at, to in ((origin + grid[:170], origin + grid[130:]), (origin + grid, origin + grid[::-1] * [1, 1, 40]), (origin + grid[:5], origin + grid[:1])):
        for s, r, near in neighborsums._strips(at, to, 0.25):
            apart = np.square(at[s:s + len(r), None] - to[None])
            apart = np.sqrt(apart[..., 0] + apart[..., 1] + apart[..., 2])
            assert np.array_equal(near, apart <= 0.25) and np.allclose(r[near] * 0.25, apart[near], atol=1e-7, rtol=0)


def test_spectral_clusters_store_no_pairs(spark, tmp_path, monkeypatch):
    """What is written on the way grows with the points of a crowd, not with its pairs."""
    from latticeloom.operators import neighborsums
    from latticeloom.plans import load_queries

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"vec_id": range(150), "label": 0, "embedding": [list(map(float, v)) for v in rng.uniform(0, 0.1, (150, 3))]})
    spark.createDataFrame(pdf, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    written = []

    def counted(kept):
        def keep(df, *name):
            out = kept(df, *name)
            written.append(out.count())
            return out
        return keep

    for module, name in ((ml, "cut_lineage"), (ml, "stored"), (neighborsums, "cut_lineage")):
        monkeypatch.setattr(module, name, counted(getattr(module, name)), raising=False)
    rows = load_queries().QUERIES["E11_spectral_clusters"](spark, str(tmp_path)).collect()
    assert {r.id: r.least for r in rows} == {i: i % 3 for i in range(150)}
    assert written and max(written) <= 150
