"""Queries on vectors, images, volumes, kernels and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeloom.functions import vectors as V
from latticeloom.operators import fields, kernels, linear, ml, sparse_model
from latticeloom.plans.registry import VECTORS, long, points, query, rounded, table, vectors
from latticeloom.session import cut_lineage


def _halves(spark, d):
    """The two halves of each vector."""
    return vectors(spark, d).select("id", F.slice("vec", 1, 32).alias("a"), F.slice("vec", 33, 32).alias("b"))


_HALVES = f"{VECTORS}, h AS (SELECT id, vec[1:32] AS a, vec[33:64] AS b FROM vectors)"
_D = "list_dot_product"


# --- similarity --------------------------------------------------------------

@query("M1_cosine_similarity", f"""
WITH {_HALVES} SELECT id, round({_D}(a, b) / sqrt({_D}(a, a) * {_D}(b, b)), 6) + 0.0 AS score,
 round(pow({_D}(a, b), 2) / sqrt(pow({_D}(a, a), 2) * pow({_D}(b, b), 2)), 6) + 0.0 AS squared FROM h""")
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    return _halves(spark, d).select("id", rounded(V.similarity(a, b, "cosine_sim")).alias("score"),
                                    rounded(V.similarity(a, b, "cosine_sim", 2.0)).alias("squared"))


@query("M2_euclidean_similarity", f"""
WITH {_HALVES}, s AS (SELECT id, list_distance(list_transform(a, lambda x: x / sqrt({_D}(a, a))), list_transform(b, lambda x: x / sqrt({_D}(b, b)))) AS r FROM h)
SELECT id, round(1 - r, 6) + 0.0 AS score, round(1 - pow(r, 3), 6) + 0.0 AS cubed FROM s""")
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    return _halves(spark, d).select("id", rounded(V.similarity(a, b, "euclidean")).alias("score"),
                                    rounded(V.similarity(a, b, "euclidean", 3.0)).alias("cubed"))


@query("M3_minkowski_similarity", f"""
WITH {_HALVES}, n AS (SELECT id, a, b, pow(list_sum(list_transform(a, lambda x: pow(abs(x), 3))), 1 / 3.0) AS na,
  pow(list_sum(list_transform(b, lambda x: pow(abs(x), 3))), 1 / 3.0) AS nb FROM h)
SELECT id, round(1 - pow(list_sum(list_transform(range(1, 33), lambda i: pow(abs(a[i] / na - b[i] / nb), 3))), 1 / 3.0), 6) + 0.0 AS score FROM n""")
def _(spark, d):
    return _halves(spark, d).select("id", rounded(V.similarity(F.col("a"), F.col("b"), "minkowski")).alias("score"))


@query("M4_cross_correlation", f"WITH {_HALVES} SELECT id, round({_D}(a, b) / ({_D}(a, a) * {_D}(b, b)), 6) + 0.0 AS score FROM h")
def _(spark, d):
    return _halves(spark, d).select("id", rounded(V.similarity(F.col("a"), F.col("b"), "cross_correlation")).alias("score"))


@query("M5_tanimoto", f"""
WITH {_HALVES} SELECT id, round({_D}(a, b) / ({_D}(a, a) + {_D}(b, b) - {_D}(a, b)), 6) + 0.0 AS score FROM h""")
def _(spark, d):
    return _halves(spark, d).select("id", rounded(V.similarity(F.col("a"), F.col("b"), "tanimoto")).alias("score"))


@query("M7_dot_kernel", f"WITH {_HALVES} SELECT id, round(4 * pow({_D}(a, b), 2), 6) + 0.0 AS k FROM h")
def _(spark, d):
    return _halves(spark, d).select("id", rounded(V.dot_kernel(F.col("a"), F.col("b"), 2.0, 2.0)).alias("k"))


@query("M9_kernel_distance", f"""
WITH {_HALVES}, k AS (SELECT id, {_D}(a, b) / sqrt({_D}(a, a) * {_D}(b, b)) AS k FROM h)
SELECT id, round(sqrt(1 - k * k + 1e-10), 6) AS distance FROM k""")
def _(spark, d):
    k = V.similarity(F.col("a"), F.col("b"), "cosine_sim")
    return _halves(spark, d).select("id", rounded(V.kernel_distance(k)).alias("distance"))


_AVERAGE = f"""{VECTORS}, total AS (SELECT label, i, sum(vec[i]) AS s FROM vectors, range(1, 65) t(i) GROUP BY ALL),
avg_vec AS (SELECT label AS id, list(s ORDER BY i) AS v FROM total GROUP BY label),
unit AS (SELECT id, list_transform(v, lambda x: x / sqrt({_D}(v, v))) AS v FROM avg_vec)"""


def _averages(spark, d):
    return kernels.average_features(vectors(spark, d), 64, "label").withColumnRenamed("label", "id")


@query("M8_average_kernel", f"""
WITH {_AVERAGE} SELECT id, i - 1 AS component, round(v[i], 6) + 0.0 AS value FROM unit, range(1, 65) t(i)""")
def _(spark, d):
    return _averages(spark, d).select("id", F.posexplode("vec").alias("component", "value")).select(
        "id", long("component").alias("component"), rounded("value").alias("value"))


#: Several blocks a side at the sizes of the tests, too.
BLOCK = 192


def _parity(spark, d, odd):
    return vectors(spark, d).where(F.col("id") % 2 == odd)


@query("J10_cross_similarity", f"""
WITH {VECTORS} SELECT a.id AS row_id, b.id AS col_id, round({_D}(a.vec, b.vec) / ({_D}(a.vec, a.vec) + {_D}(b.vec, b.vec) - {_D}(a.vec, b.vec)), 6) + 0.0 AS score
FROM vectors a, vectors b WHERE a.id % 2 = 0 AND b.id % 2 = 1""")
def _(spark, d):
    return kernels.cross_similarity(_parity(spark, d, 0), _parity(spark, d, 1), "tanimoto", block_rows=BLOCK, digits=6)


@query("J10_pivoted_similarity", f"""
WITH {_AVERAGE} SELECT a.id AS row_id, {', '.join(f'round({_D}(a.v, (SELECT v FROM unit WHERE id = {i})), 6) + 0.0 AS col_{i}' for i in range(10))} FROM unit a""")
def _(spark, d):
    avg = cut_lineage(_averages(spark, d))
    wide = kernels.pivot_matrix(kernels.cross_similarity(avg, avg, "cosine_sim"), list(range(10)))
    return wide.select("row_id", *[rounded(f"col_{i}").alias(f"col_{i}") for i in range(10)])


@query("J11_symmetric_kernel", f"""
WITH {VECTORS}, u AS (SELECT id, list_transform(vec, lambda x: x / sqrt({_D}(vec, vec))) AS v FROM vectors)
SELECT a.id AS row_id, b.id AS col_id, round(sqrt(abs(1 - pow({_D}(a.v, b.v), 2) + 1e-10)), 4) AS score FROM u a, u b""")
def _(spark, d):
    unit = vectors(spark, d).select("id", V.normalised(F.col("vec")).alias("vec"))
    return kernels.symmetric_kernel(unit, distance=True, block_rows=BLOCK, digits=4)


@query("J12_rectangular_kernel", f"""
WITH {VECTORS} SELECT a.id AS row_id, b.id AS col_id, round(pow({_D}(a.vec, b.vec), 2), 6) + 0.0 AS score
FROM vectors a, vectors b WHERE b.label < 5""")
def _(spark, d):
    some = vectors(spark, d).where("label < 5")
    return kernels.rectangular_kernel(vectors(spark, d), some, xi=2.0, block_rows=BLOCK, digits=6)


# --- shape and scale ---------------------------------------------------------

@query("M10_one_hot", "SELECT vec_id, i AS class_id, CASE WHEN i = label THEN 1.0 ELSE 0.0 END::DOUBLE AS hot FROM embeddings, range(10) t(i)")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", V.one_hot(F.col("label"), 10).alias("h"))
    return rows.select("vec_id", F.posexplode("h").alias("class_id", "hot")).withColumn("class_id", long("class_id"))


@query("M11_reshape", f"WITH {VECTORS} SELECT id, i, j, vec[8 * i + j + 1] AS v FROM vectors, range(8) t(i), range(8) u(j)")
def _(spark, d):
    rows = vectors(spark, d).select("id", V.reshape_rows(F.col("vec"), 8).alias("m"))
    return rows.select("id", F.posexplode("m").alias("i", "r")).select("id", "i", F.posexplode("r").alias("j", "v")).select(
        "id", long("i").alias("i"), long("j").alias("j"), "v")


@query("A28_table_report", f"""
WITH {VECTORS} SELECT count(*) AS n_rows, CAST(min(len(vec)) AS BIGINT) AS min_dim, CAST(max(len(vec)) AS BIGINT) AS max_dim,
 CAST(sum(len(vec)) * 8 / 1e6 AS DOUBLE) AS megabytes FROM vectors""")
def _(spark, d):
    return linear.table_report(vectors(spark, d)).withColumn("min_dim", long("min_dim")).withColumn("max_dim", long("max_dim"))


@query("N1_standardised_columns", f"""
WITH {VECTORS}, l AS (SELECT id, i - 1 AS component, vec[i] AS v FROM vectors, range(1, 65) t(i))
SELECT id, component, round((v - avg(v) OVER (PARTITION BY component)) / stddev_pop(v) OVER (PARTITION BY component), 6) + 0.0 AS value FROM l""")
def _(spark, d):
    out = linear.standardise(vectors(spark, d))
    return out.select("id", F.posexplode("vec").alias("component", "value")).select(
        "id", long("component").alias("component"), rounded("value").alias("value"))


@query("N2_row_min_max", f"""
WITH {VECTORS} SELECT id, i - 1 AS component, round((vec[i] - list_min(vec)) / (list_max(vec) - list_min(vec)), 6) AS value FROM vectors, range(1, 65) t(i)""")
def _(spark, d):
    return vectors(spark, d).select("id", F.posexplode(V.min_max(F.col("vec"))).alias("component", "value")).select(
        "id", long("component").alias("component"), rounded("value").alias("value"))


@query("N3_8bit_image", f"""
WITH {VECTORS} SELECT id, i - 1 AS component, CAST(floor((vec[i] - list_min(vec)) / (list_max(vec) - list_min(vec)) * 255) AS BIGINT) AS value
FROM vectors, range(1, 65) t(i)""")
def _(spark, d):
    return vectors(spark, d).select("id", F.posexplode(V.to_8bit(F.col("vec"))).alias("component", "value")).select(
        "id", long("component").alias("component"), long("value").alias("value"))


# --- images and volumes ------------------------------------------------------

def _pixels(spark, d):
    """Each vector as an 8 x 8 image, one channel."""
    return vectors(spark, d).select("id", "label", F.posexplode("vec").alias("n", "v")).select(
        "id", "label", F.floor(F.col("n") / 8).alias("i"), (F.col("n") % 8).cast("long").alias("j"), "v")


_PIXELS = f"{VECTORS}, pixels AS (SELECT id, label, i, j, vec[8 * i + j + 1] AS v FROM vectors, range(8) t(i), range(8) u(j))"


@query("M28_radial_mask", f"""
WITH {_PIXELS} SELECT id, i, j, CASE WHEN (i - 3.5) * (i - 3.5) + (j - 3.5) * (j - 3.5) <= 2.25 OR (i - 3.5) * (i - 3.5) + (j - 3.5) * (j - 3.5) >= 16
 THEN 0.0 ELSE v END AS v FROM pixels""")
def _(spark, d):
    return _pixels(spark, d).select("id", "i", "j", fields.radial_mask(
        F.col("v"), [F.col("i"), F.col("j")], 8, 1.5, 4.0).alias("v"))


@query("M29_channel_sum", f"WITH {_PIXELS} SELECT label, i, j, round(sum(v), 6) + 0.0 AS v FROM pixels GROUP BY ALL")
def _(spark, d):
    return fields.channel_sum(_pixels(spark, d), ["label", "i", "j"]).withColumn("v", rounded("v"))


def _label_images(spark, d):
    """Summed image of the even and of the odd vectors of each label."""
    px = _pixels(spark, d)
    image = lambda odd: fields.channel_sum(px.where(F.col("id") % 2 == odd).withColumn("ch", F.col("label")), ["ch", "i", "j"])
    return image(0), image(1)


_IMAGES = f"""{_PIXELS}, a AS (SELECT label AS ch, i, j, sum(v) AS v FROM pixels WHERE id % 2 = 0 GROUP BY ALL),
b AS (SELECT label AS ch, i, j, sum(v) AS v FROM pixels WHERE id % 2 = 1 GROUP BY ALL),
diff AS (SELECT ch, i, j, (b.v - a.v) / (SELECT max(v) FROM a) * 100 AS percent FROM a JOIN b USING (ch, i, j))"""


@query("J17_image_difference", f"WITH {_IMAGES} SELECT ch, i, j, round(percent, 6) + 0.0 AS percent FROM diff")
def _(spark, d):
    return fields.image_difference(*_label_images(spark, d)).select("ch", "i", "j", rounded("percent").alias("percent"))


@query("J17_difference_bounds", f"""
WITH {_IMAGES} SELECT round(min(percent), 6) AS lowest, round(max(percent), 6) AS highest, round((abs(min(percent)) + abs(max(percent))) / 2, 6) AS bound FROM diff""")
def _(spark, d):
    out = fields.difference_bounds(fields.image_difference(*_label_images(spark, d)))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


def _voxels(spark, d):
    """Each vector as a 4 x 4 x 4 volume of absolute values."""
    n = F.col("n")
    return vectors(spark, d).select("id", F.posexplode("vec").alias("n", "v")).select(
        "id", F.floor(n / 16).cast("int").alias("ix"), (F.floor(n / 4) % 4).cast("int").alias("iy"), (n % 4).cast("int").alias("iz"), F.abs("v").alias("v"))


_VOXELS = f"""{VECTORS}, voxels AS (SELECT id, ix, iy, iz, abs(vec[16 * ix + 4 * iy + iz + 1]) AS v FROM vectors, range(4) t(ix), range(4) u(iy), range(4) w(iz)),
com AS (SELECT id, sum(v * ix) / sum(v) AS cx, sum(v * iy) / sum(v) AS cy, sum(v * iz) / sum(v) AS cz FROM voxels GROUP BY id)"""


@query("A25_centre_of_mass", f"WITH {_VOXELS} SELECT id, round(cx, 6) AS c_ix, round(cy, 6) AS c_iy, round(cz, 6) AS c_iz FROM com")
def _(spark, d):
    out = fields.centre_of_mass(_voxels(spark, d))
    return out.select("id", *[rounded(c).alias(c) for c in ("c_ix", "c_iy", "c_iz")])


@query("G11_spherical_shells", f"""
WITH {_VOXELS}, g AS (SELECT s, 0.5 + s * 0.5 AS r, p * 2 * pi() / 19 AS phi, q * pi() / 9 AS theta FROM range(3) t(s), range(20) u(p), range(10) w(q)),
k AS (SELECT DISTINCT id, s AS shell, CAST(round_even(cx + r * cos(phi) * sin(theta), 0) AS INTEGER) AS ix, CAST(round_even(cy + r * sin(phi) * sin(theta), 0) AS INTEGER) AS iy,
  CAST(round_even(cz + r * cos(theta), 0) AS INTEGER) AS iz FROM com, g)
SELECT id, shell, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, CAST(iz AS BIGINT) AS iz, round(v, 6) AS v,
  round(sqrt(pow(ix - 2, 2) + pow(iy - 2, 2) + pow(iz - 2, 2)), 6) AS r,
  round(degrees(acos(CASE WHEN ix = 2 AND iy = 2 AND iz = 2 THEN NULL ELSE (iz - 2) / sqrt(pow(ix - 2, 2) + pow(iy - 2, 2) + pow(iz - 2, 2)) END)), 4) AS theta,
  round(degrees(atan2(iy - 2, ix - 2)), 4) + 0.0 AS phi
FROM k JOIN voxels USING (id, ix, iy, iz) WHERE ix BETWEEN 0 AND 2 AND iy BETWEEN 0 AND 2 AND iz BETWEEN 0 AND 2""")
def _(spark, d):
    out = fields.spherical_shells(_voxels(spark, d), 4, r_min=0.5, r_max=1.5, dr=0.5, phi_bins=20, theta_bins=10)
    return out.select("id", long("shell").alias("shell"), *[long(c).alias(c) for c in ("ix", "iy", "iz")], rounded("v").alias("v"),
                      rounded("r").alias("r"), rounded("theta", 4).alias("theta"), rounded("phi", 4).alias("phi"))


@query("G10_harmonics", f"""
WITH {VECTORS}, f AS (SELECT id, k, sum(vec[n + 1] * cos(2 * pi() * k * 2 * n / 64)) AS re, sum(vec[n + 1] * sin(2 * pi() * k * 2 * n / 64)) AS im
 FROM vectors, range(64) t(n), range(1, 12) u(k) GROUP BY ALL)
SELECT id, k AS harmonic, round((re * re + im * im) / 4096, 8) AS value FROM f""")
def _(spark, d):
    return fields.harmonics(vectors(spark, d), n_harmonics=12, every=2).select(
        "id", long("harmonic").alias("harmonic"), rounded("value", 8).alias("value"))


@query("A26_convex_hulls", """
WITH p AS (SELECT DISTINCT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
e AS (SELECT a.label, a.x, a.y FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.label = a.label
  GROUP BY a.label, a.x, a.y, b.x, b.y HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0)
SELECT DISTINCT label, x, y FROM e""")
def _(spark, d):
    e = F.col("embedding")
    return fields.convex_hulls(table(spark, d, "embeddings").select("label", e[0].alias("x"), e[1].alias("y")), "label").drop("corner")


# --- fitted models -----------------------------------------------------------

FEATURES = ["size", "tax", "disc", "line", "supp"]


def _regression(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_quantity").alias("size"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"),
                     F.col("l_linenumber").cast("double").alias("line"), F.sqrt(F.col("l_suppkey").cast("double")).alias("supp"),
                     (F.col("l_extendedprice") / 1000).alias("price"))


_REGRESSION = "r AS (SELECT l_quantity AS a, l_tax AS b, l_discount AS c, CAST(l_linenumber AS DOUBLE) AS d, sqrt(CAST(l_suppkey AS DOUBLE)) AS e, l_extendedprice / 1000 AS y FROM lineitem)"


def _pair_error(i: str, j: str) -> str:
    r = f"corr({i}, {j})"
    return (f"var_pop(y) * (1 - (pow(corr({i}, y), 2) + pow(corr({j}, y), 2) - 2 * corr({i}, y) * corr({j}, y) * {r}) / (1 - pow({r}, 2)))")


_PAIRS = [(i, j) for k, i in enumerate("abcde") for j in "abcde"[k + 1:]]


@query("E4_pair_subsets", f"""
WITH {_REGRESSION}, m AS (SELECT {', '.join(f'{_pair_error(i, j)} AS {i}{j}' for i, j in _PAIRS)} FROM r)
""" + " UNION ALL ".join(f"SELECT '{'abcde'.index(i)},{'abcde'.index(j)}' AS subset, round({i}{j}, 4) AS mse FROM m" for i, j in _PAIRS))
def _(spark, d):
    rows = _regression(spark, d)
    out = sparse_model.subset_errors(rows, FEATURES, sparse_model.moments(rows, FEATURES, "price"), 2)
    return out.select(F.array_join("subset", ",").alias("subset"), rounded("mse", 4).alias("mse"))


@query("E4_single_subsets", f"WITH {_REGRESSION} " + " UNION ALL ".join(
    f"SELECT '{k}' AS subset, round(var_pop(y) * (1 - pow(corr({i}, y), 2)), 4) AS mse FROM r" for k, i in enumerate("abcde")))
def _(spark, d):
    rows = _regression(spark, d)
    out = sparse_model.subset_errors(rows, FEATURES, sparse_model.moments(rows, FEATURES, "price"), 1)
    return out.select(F.array_join("subset", ",").alias("subset"), rounded("mse", 4).alias("mse"))


def _model_rows(spark, models):
    return spark.createDataFrame([(k + 1, ",".join(m["features"]), float(m["mse"]), float(m["intercept"])) for k, m in enumerate(models)],
                                 "dimension int, features string, mse double, intercept double")


def _planted_line(spark, d):
    """Three of the five features make the target."""
    return _regression(spark, d).withColumn("price", 4 * F.col("size") + 2 * F.col("line") - 100 * F.col("disc"))


_PLANTED_LINE = f"{_REGRESSION.replace('r AS', 'r0 AS', 1)}, r AS (SELECT a, b, c, d, e, 4 * a + 2 * d - 100 * c AS y FROM r0)"


@query("E3_lasso_and_best_subset", f"""
WITH {_PLANTED_LINE}, one AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS features, var_pop(y) * (1 - pow(corr({i}, y), 2)) AS mse FROM r" for i, n in zip("abcde", FEATURES)) + """),
two AS (""" + " UNION ALL ".join(
    f"SELECT '{FEATURES['abcde'.index(i)]},{FEATURES['abcde'.index(j)]}' AS features, {_pair_error(i, j)} AS mse FROM r" for i, j in _PAIRS) + """)
SELECT CAST(1 AS BIGINT) AS dimension, arg_min(features, mse) AS features, round(min(mse), 4) AS mse FROM one
UNION ALL SELECT 2, arg_min(features, mse), round(min(mse), 4) FROM two UNION ALL SELECT 3, 'size,disc,line', 0.0""")
def _(spark, d):
    models = sparse_model.fit_sparse_model(_planted_line(spark, d), FEATURES, "price", 3, 3)
    return _model_rows(spark, models).select(long("dimension").alias("dimension"), "features", rounded("mse", 4).alias("mse"))


def _products(spark, d):
    """Long features: the components of a vector and the products of any two; the target is made of three of them."""
    at = lambda i: F.element_at("vec", i.cast("int") + 1)
    name = lambda i: F.concat(F.lit("x"), i.cast("string"))
    single = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(name(i).alias("feature"), at(i).alias("value")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: F.struct(
        F.concat(name(i), F.lit("*"), name(j)).alias("feature"), (at(i) * at(j)).alias("value")))))
    rows = vectors(spark, d)
    x = lambda i: F.col("vec")[i]
    targets = rows.select("id", (3 * x(1) * x(2) - 2 * x(5) * x(7) + 0.5 * x(9)).alias("target"))
    return rows.select("id", F.explode(F.concat(single, pairs)).alias("f")).select("id", "f.feature", "f.value"), targets


@query("E5_screened_model", f"""
WITH {VECTORS}, f AS (SELECT id, 'x' || i AS feature, vec[i + 1] AS value FROM vectors, range(64) t(i)
 UNION ALL SELECT id, 'x' || i || '*x' || j, vec[i + 1] * vec[j + 1] FROM vectors, range(64) t(i), range(64) u(j) WHERE i < j),
y AS (SELECT id, 3 * vec[2] * vec[3] - 2 * vec[6] * vec[8] + 0.5 * vec[10] AS y FROM vectors),
s1 AS (SELECT feature, abs(corr(value, y)) AS score, regr_slope(y, value) AS slope, regr_intercept(y, value) AS base, var_pop(y) * (1 - pow(corr(value, y), 2)) AS mse
 FROM f JOIN y USING (id) GROUP BY 1),
p1 AS (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS n FROM s1 QUALIFY n <= 10),
r AS (SELECT y.id, n, y - slope * value - base AS r FROM p1 JOIN f USING (feature) JOIN y USING (id) WHERE n <= 3),
s2 AS (SELECT feature, max(score) AS score FROM (SELECT feature, n, abs(corr(value, r)) AS score FROM f JOIN r USING (id) GROUP BY ALL) GROUP BY 1),
p2 AS (SELECT feature FROM s2 WHERE feature NOT IN (SELECT feature FROM p1) ORDER BY score DESC, feature LIMIT 10),
pool AS (SELECT feature FROM p1 UNION ALL SELECT feature FROM p2),
g AS (SELECT f.* FROM f JOIN pool USING (feature)),
m AS (SELECT a.feature AS a, b.feature AS b, var_pop(y) * (1 - (pow(corr(a.value, y), 2) + pow(corr(b.value, y), 2) - 2 * corr(a.value, y) * corr(b.value, y) * corr(a.value, b.value))
  / (1 - pow(corr(a.value, b.value), 2))) AS mse FROM g a JOIN g b ON a.id = b.id AND a.feature < b.feature JOIN y ON y.id = a.id GROUP BY ALL)
SELECT CAST(1 AS BIGINT) AS dimension, arg_min(feature, mse) AS features, round(min(mse), 8) AS mse FROM p1
UNION ALL SELECT 2, arg_min(a || ',' || b, mse), round(min(mse), 8) FROM m UNION ALL SELECT 3, 'x1*x2,x5*x7,x9', 0.0""")
def _(spark, d):
    models = sparse_model.fit_by_long_screening(*_products(spark, d), max_dim=3, per_step=10, residuals=3)
    rows = [(k + 1, ",".join(sorted(m["features"])), float(m["mse"])) for k, m in enumerate(models)]
    out = spark.createDataFrame(rows, "dimension long, features string, mse double")
    return out.withColumn("mse", rounded("mse", 8))


@query("E5_screened_columns", f"""
WITH {_REGRESSION}, m AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS features, var_pop(y) * (1 - pow(corr({i}, y), 2)) AS mse FROM r" for i, n in zip("abcde", FEATURES)) + """),
p AS (""" + " UNION ALL ".join(
    f"SELECT '{','.join(sorted((FEATURES['abcde'.index(i)], FEATURES['abcde'.index(j)])))}' AS features, {_pair_error(i, j)} AS mse FROM r" for i, j in _PAIRS) + """)
SELECT CAST(1 AS BIGINT) AS dimension, arg_min(features, mse) AS features, round(min(mse), 4) AS mse FROM m
UNION ALL SELECT 2, arg_min(features, mse), round(min(mse), 4) FROM p""")
def _(spark, d):
    models = sparse_model.fit_by_screening(_regression(spark, d), FEATURES, "price", 2, 5)
    rows = [(k + 1, ",".join(sorted(m["features"])), float(m["mse"])) for k, m in enumerate(models)]
    return spark.createDataFrame(rows, "dimension long, features string, mse double").withColumn("mse", rounded("mse", 4))


@query("E7_regression_inputs", f"WITH {_REGRESSION} SELECT count(*) AS n, CAST(5 AS BIGINT) AS n_features FROM r")
def _(spark, d):
    rows = _regression(spark, d)
    sparse_model.check_inputs(rows, FEATURES, "price", ["a", "b", "b", "c", "c"])
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("n_features", F.lit(len(FEATURES)).cast("long"))


@query("E21_sparse_model_results", f"""
WITH {_REGRESSION}, w AS (SELECT regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM r)
SELECT a AS coord_0, round(i + s * a, 4) + 0.0 AS y_pred, y AS y_true FROM r, w""")
def _(spark, d):
    rows = _regression(spark, d)
    best = sparse_model.best_subset(rows, ["size"], sparse_model.moments(rows, ["size"], "price"), 1)
    return sparse_model.result_table(rows, best, "price", viewer=True).withColumn("y_pred", rounded("y_pred", 4))


SQUARINGS = 13


def _leading_sql(source: str, prefix: str) -> str:
    """The leading eigenvector ``<prefix>e(i, e)`` and value ``<prefix>l(l)`` of a symmetric matrix ``(i, j, v)`` by repeated squaring."""
    steps, last = [], source
    for n in range(SQUARINGS):
        name = f"{prefix}{n}"
        steps.append(f"{name}u AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j), "
                     f"{name} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {name}u) AS v FROM {name}u)")
        last = name
    steps.append(f"""{prefix}c AS (SELECT i, v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j)),
{prefix}n AS (SELECT i, v / sqrt((SELECT sum(v * v) FROM {prefix}c)) AS e FROM {prefix}c),
{prefix}e AS MATERIALIZED (SELECT i, e * sign((SELECT arg_max(e, abs(e)) FROM {prefix}n)) AS e FROM {prefix}n),
{prefix}l AS MATERIALIZED (SELECT sum(a.e * m.v * b.e) AS l FROM {source} m JOIN {prefix}e a ON a.i = m.i JOIN {prefix}e b ON b.i = m.j)""")
    return ", ".join(steps)


def _two_directions_sql(rows: str) -> str:
    """Coordinates ``q(id, c0, c1)`` along the two leading directions of ``z(id, i, v)``."""
    return f"""{VECTORS}, x AS (SELECT id, i, vec[i] AS v FROM vectors, range(1, 65) t(i)), z AS MATERIALIZED ({rows}),
m AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM z a JOIN z b USING (id) GROUP BY a.i, b.i), {_leading_sql('m', 'f')},
d AS MATERIALIZED (SELECT m.i, m.j, m.v - (SELECT l FROM fl) * a.e * b.e AS v FROM m JOIN fe a ON a.i = m.i JOIN fe b ON b.i = m.j), {_leading_sql('d', 'g')},
q AS (SELECT id, sum(z.v * fe.e) AS c0, sum(z.v * ge.e) AS c1 FROM z JOIN fe ON fe.i = z.i JOIN ge ON ge.i = z.i GROUP BY id)"""


@query("N4_principal_components", f"""
WITH {_two_directions_sql("SELECT id, i, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM x WINDOW w AS (PARTITION BY i)")}
SELECT id, round(c0, 4) + 0.0 AS c0, round(c1, 4) + 0.0 AS c1, round(((SELECT l FROM fl) + (SELECT l FROM gl)) / (SELECT sum(v) FROM m WHERE i = j), 6) AS explained FROM q""")
def _(spark, d):
    out, share = linear.pca(vectors(spark, d), 2)
    return out.select("id", rounded(F.col("coords")[0], 4).alias("c0"), rounded(F.col("coords")[1], 4).alias("c1"),
                      F.lit(round(share, 6)).alias("explained"))


@query("N5_truncated_svd", f"""
WITH {_two_directions_sql("SELECT id, i, v FROM x")}
SELECT id, round(c0, 4) + 0.0 AS c0, round(c1, 4) + 0.0 AS c1, round(sqrt((SELECT l FROM fl)), 4) AS s0, round(sqrt((SELECT l FROM gl)), 4) AS s1 FROM q""")
def _(spark, d):
    out, values = linear.truncated_svd(vectors(spark, d), 2, "none")
    return out.select("id", rounded(F.col("coords")[0], 4).alias("c0"), rounded(F.col("coords")[1], 4).alias("c1"),
                      *[F.lit(round(float(v), 4)).alias(f"s{i}") for i, v in enumerate(values)])


def _groups(spark, d, n):
    """Whole vectors moved by 3 along one of n components, by id: groups far apart, ``group`` known."""
    group = (F.col("id") % n).cast("int")
    return vectors(spark, d).withColumn("group", group).withColumn("vec", F.transform(
        "vec", lambda x, i: x + F.when(i == F.col("group"), 3.0).otherwise(0.0)))


def _named(out):
    """Clusters named by their smallest id, as numbers of clusters are arbitrary."""
    return out.join(out.groupBy("cluster").agg(F.min("id").alias("least")), "cluster")


@query("E8_kmeans", "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY vec_id % 4) AS least FROM embeddings")
def _(spark, d):
    out = ml.cluster(_groups(spark, d, 4), "kmeans", mode="none", k=4, initSteps=5).select("id", "cluster")
    return _named(out).select("id", "least")


@query("E9_gaussian_mixture", "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY vec_id % 2) AS least, 1.0 AS p FROM embeddings")
def _(spark, d):
    # three sums that use every component, the two groups moved apart in each
    third = lambda k: F.aggregate(F.filter("vec", lambda x, i: i % 3 == k), F.lit(0.0), lambda a, x: a + x) + 9.0 * F.col("group")
    apart = _groups(spark, d, 2).withColumn("vec", F.array(*[third(k) for k in range(3)]))
    out = ml.cluster(apart, "gaussian_mixture", mode="none", k=2, maxIter=300, tol=1e-9)
    return _named(out).select("id", "least", rounded(F.array_max("cluster_probs"), 4).alias("p"))


_DBSCAN = """pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b FROM pts a, pts b WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.09),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 8)"""


@query("E10_dbscan", f"""
WITH RECURSIVE {_DBSCAN}, link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
walk AS (SELECT id AS root, id FROM core UNION SELECT w.root, l.b FROM walk w JOIN link l ON l.a = w.id),
comp AS (SELECT id, min(root) AS cluster FROM walk GROUP BY id),
border AS (SELECT n.a AS id, arg_min(c.cluster, n.b) AS cluster FROM near n JOIN comp c ON c.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a)
SELECT p.id, coalesce(c.cluster, b.cluster, -1) AS cluster, c.id IS NOT NULL AS is_core FROM pts p LEFT JOIN comp c ON c.id = p.id LEFT JOIN border b ON b.id = p.id""")
def _(spark, d):
    return ml.dbscan(points(spark, d).withColumnRenamed("atom_id", "id"), 0.09, 8)


@query("E11_spectral_clusters", """
WITH p AS (SELECT vec_id AS id, vec_id % 3 AS g, CAST(embedding[1] AS DOUBLE) + 5 * (vec_id % 3) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
n AS (SELECT DISTINCT a.id, a.g FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.3)
SELECT p.id, min(n.id) OVER (PARTITION BY n.g) AS least FROM p JOIN n USING (id) UNION ALL SELECT id, NULL FROM p WHERE id NOT IN (SELECT id FROM n)""")
def _(spark, d):
    from latticeloom.operators.neighborsums import NeighbourWeights

    rows = points(spark, d).withColumn("x", F.col("x") + 5 * (F.col("atom_id") % 3)).withColumnRenamed("atom_id", "id")
    out = cut_lineage(ml.spectral_clusters(NeighbourWeights(rows, 0.3, 5.0), 3, rows.select("id")))
    return _named(out.where("cluster IS NOT NULL")).select("id", "least").unionByName(
        out.where("cluster IS NULL").select("id", F.lit(None).cast("long").alias("least")))


def _labelled(spark, d):
    return _groups(spark, d, 3).withColumn("label", F.col("group").cast("double")).select("id", "vec", "label")


def _split_sql(test_size: float, classes: int, select: str) -> str:
    """A stratified split of the embeddings by id modulo ``classes``."""
    return f"""
WITH e AS (SELECT vec_id AS id, vec_id % {classes} AS label FROM embeddings),
n AS (SELECT count(*) AS total, CAST(round(count(*) * {test_size}) AS BIGINT) AS held FROM e),
c AS (SELECT label, floor(count(*) * held / CAST(total AS DOUBLE)) AS base, count(*) * held / CAST(total AS DOUBLE) - floor(count(*) * held / CAST(total AS DOUBLE)) AS rest
 FROM e, n GROUP BY label, held, total),
q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= (SELECT held FROM n) - (SELECT sum(base) FROM c) THEN 1 ELSE 0 END AS quota FROM c),
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '#42'), id) AS rn FROM e),
s AS (SELECT id, label, CASE WHEN rn <= quota THEN 'validation' ELSE 'train' END AS split FROM r JOIN q USING (label))
{select}"""


def _split(rows):
    from latticeloom.operators.labels import split_rows

    rows = cut_lineage(split_rows(rows, "id", 0.25, "label"))
    return rows, rows.where("split = 'train'"), rows.where("split = 'validation'")


@query("E12_trained_classifier", _split_sql(0.25, 3, "SELECT id, split, label AS target_pred_class, 1.0 AS accuracy, '(8,)' AS layout FROM s"))
def _(spark, d):
    rows, train, held = _split(_labelled(spark, d))
    model, accuracy, layout = ml.train_classifier(train, held, [[8], [16]], max_iter=40)
    return ml.score(rows, model).select("id", "split", long("target_pred_class").alias("target_pred_class"), F.lit(accuracy).alias("accuracy"),
                                        F.lit(str(layout)).alias("layout"))


@query("E13_classifier_scores", _split_sql(0.25, 3, "SELECT id, label AS target_pred_class, label = 0 AS is_first FROM s WHERE split = 'validation'"))
def _(spark, d):
    _, train, held = _split(_labelled(spark, d))
    model, _, _ = ml.train_classifier(train, held, [[8]], max_iter=40)
    return ml.score(held, model).select("id", long("target_pred_class").alias("target_pred_class"), (F.col("probs")[0] > 0.5).alias("is_first"))


@query("E14_committee_samples", _split_sql(0.25, 3, "SELECT id, CAST(3 AS BIGINT) AS n_samples, label AS winner, 0.0 AS variation_ratio, true AS agreed FROM s WHERE split = 'validation'"))
def _(spark, d):
    from latticeloom.operators.uncertainty import committee_uncertainty

    _, train, held = _split(_labelled(spark, d))
    models = ml.train_committee(train, 3, [8], 3, max_iter=30)
    out = committee_uncertainty(ml.committee_samples(held, models), 3)
    # members that agree for sure leave no mutual information
    return out.select("id", "n_samples", long(V.argmax(F.col("mean_probs"))).alias("winner"), rounded("variation_ratio", 4).alias("variation_ratio"),
                      ((F.col("mutual_information") < 0.3) & (F.col("predictive_entropy") < 0.6)).alias("agreed"))


@query("E23_class_names", """
SELECT vec_id AS id, 'class-' || label AS class_name FROM embeddings""")
def _(spark, d):
    rows = vectors(spark, d).select("id", F.col("label").alias("class_id"))
    names = rows.select("class_id").distinct().withColumn("class_name", F.concat(F.lit("class-"), "class_id"))
    return ml.class_names(rows, names).select("id", "class_name")
