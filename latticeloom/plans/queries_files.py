"""Queries on files written from the driver tables and read back, and on user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeloom.functions import vectors as V
from latticeloom.operators import features, filters, labels, ml, uncertainty
from latticeloom.plans.queries_vectors import _groups, _named, _split, _split_sql
from latticeloom.plans.registry import POINTS, SAMPLES, VECTORS, long, points, query, rounded, samples, table, vectors
from latticeloom.session import cut_lineage, scratch_path
from latticeloom.sources import readers as R
from latticeloom.sources import writers as W


# --- structure files ---------------------------------------------------------

def _geometry_lines(spark, d):
    """Lines of one geometry file per label: a cell of edge 2 and fractional atoms."""
    p = points(spark, d)
    atom = F.concat_ws(" ", F.lit("atom_frac"), *[(F.col(a) / 2).cast("string") for a in "xyz"], "symbol")
    cell = F.explode(F.array(*[F.lit(f"lattice_vector {' '.join('2.0' if i == k else '0.0' for k in range(3))}") for i in range(3)]))
    return (p.select("structure_id", "atom_id", atom.alias("value"))
            .unionByName(p.select("structure_id").distinct().select("structure_id", F.lit(-1).cast("long").alias("atom_id"), cell.alias("value"))))


@query("S2_geometry_files", f"""
WITH {POINTS} SELECT structure_id, symbol, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM points""")
def _(spark, d):
    path = scratch_path(spark, "geometry")
    (_geometry_lines(spark, d).repartition("structure_id").sortWithinPartitions("structure_id", "atom_id")
     .select("structure_id", "value").write.partitionBy("structure_id").text(path))
    atoms, _ = R.read_geometry(spark, path, ".txt")
    return atoms.select(F.regexp_extract("structure_id", "structure_id=([^/]+)/", 1).alias("structure_id"), "symbol",
                        *[rounded(a).alias(a) for a in "xyz"])


@query("S3_prototype_catalogue", f"""
WITH {POINTS}, n AS (SELECT structure_id, CASE WHEN structure_id < '5' THEN 'Binaries' ELSE 'Nanotubes' END AS kind, count(*) AS n FROM points GROUP BY ALL)
SELECT 'dataset=' || kind AS dataset, 'class=' || structure_id AS crystal_structure, periodic, n AS n_atoms FROM n, (SELECT unnest([true, false]) AS periodic)
WHERE NOT (kind = 'Nanotubes' AND periodic)""")
def _(spark, d):
    path = scratch_path(spark, "prototypes")
    kind = F.when(F.col("structure_id") < "5", "Binaries").otherwise("Nanotubes")
    (_geometry_lines(spark, d).withColumn("dataset", kind).withColumnRenamed("structure_id", "class").repartition("dataset", "class")
     .sortWithinPartitions("dataset", "class", "atom_id").select("dataset", "class", "value").write.partitionBy("dataset", "class").text(path))
    atoms, s = R.read_prototypes(spark, path, ["dataset=Binaries", "dataset=Nanotubes"], [True, False], ".txt")
    s = s.where((F.col("dataset") != "dataset=Nanotubes") | ~F.col("pbc")[0])
    n = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"))
    return s.join(n, "structure_id").select("dataset", "crystal_structure", F.col("pbc")[0].alias("periodic"), "n_atoms")


@query("S4_json_listing", "SELECT DISTINCT event_type FROM events")
def _(spark, d):
    path = scratch_path(spark, "listing")
    table(spark, d, "events").write.partitionBy("event_type").json(path)
    return R.list_files(spark, path).select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("event_type")).distinct()


@query("S5_structure_database", f"""
WITH {VECTORS} SELECT CAST(id AS VARCHAR) AS structure_id, CAST(i AS BIGINT) AS atom_id, 'H' AS symbol, round(vec[3 * i + 1], 6) + 0.0 AS x, round(vec[3 * i + 2], 6) + 0.0 AS y,
 round(vec[3 * i + 3], 6) + 0.0 AS z, CAST(label AS VARCHAR) AS target FROM vectors, range(21) t(i)""")
def _(spark, d):
    path = scratch_path(spark, "database")
    positions = V.reshape_rows(F.slice("vec", 1, 63), 3)
    info = F.struct(F.struct(F.col("label").cast("string").alias("target")).alias("data"))
    vectors(spark, d).select(F.col("id").cast("string").alias("structure_id"), F.array_repeat(F.lit("H"), 21).alias("symbols"),
                             positions.alias("positions"), info.alias("info")).write.json(path)
    s = R.read_structures(spark, path, multi_line=False)
    return R.explode_atoms(s).join(s.select("structure_id", "target"), "structure_id").select(
        "structure_id", long("atom_id").alias("atom_id"), "symbol", *[rounded(a).alias(a) for a in "xyz"], "target")


@query("S6_target_union", """
SELECT CAST(c_custkey AS VARCHAR) || 'c' AS filename, c_mktsegment AS target FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR) || 's', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def _(spark, d):
    a, b = scratch_path(spark, "targets"), scratch_path(spark, "targets")
    W.write_targets(table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("c")).alias("structure_id"),
                                                       F.col("c_mktsegment").alias("target")), a)
    W.write_targets(table(spark, d, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("s")).alias("structure_id"),
                                                       F.col("s_nationkey").alias("target")), b)
    good, _ = R.read_targets(spark, [f"{a}/*", f"{b}/*"])
    return good.select("filename", "target")


@query("S7_dataset_load", "SELECT event_id, event_type AS text_label, value FROM events")
def _(spark, d):
    ev, path = table(spark, d, "events"), scratch_path(spark, "dataset")
    W.write_dataset(labels.merge_labels(ev.select("event_id", "value"), ev, "event_id", "event_type"), path, "event_type")
    rows, _ = R.read_dataset(spark, path)
    return rows.select("event_id", "text_label", "value")


@query("S9_molecule_blocks", f"""
WITH {VECTORS} SELECT round(vec[1], 6) + 0.0 AS ae_pbe0, round(vec[14], 6) + 0.0 AS imax_zindo, round(vec[7] - vec[4], 6) + 0.0 AS homo_lumo_gap_gw,
 round(vec[8] - vec[5], 6) + 0.0 AS homo_lumo_gap_pbe0, CAST(2 AS BIGINT) AS n_atoms FROM vectors""")
def _(spark, d):
    path = scratch_path(spark, "molecules")
    numbers = F.array_join(F.transform(F.slice("vec", 1, 14), lambda v: v.cast("string")), " ")
    block = F.concat_ws("\n", F.lit("2"), numbers, F.lit("C 0 0 0"), F.lit("H 0 0 1"))
    vectors(spark, d).select(block.alias("value")).write.option("lineSep", "\n\n").text(path)
    out = R.read_molecules(spark, path)
    return out.select(*[rounded(c).alias(c) for c in ("ae_pbe0", "imax_zindo", "homo_lumo_gap_gw", "homo_lumo_gap_pbe0")],
                      long(F.size("atom_lines")).alias("n_atoms"))


@query("S10_resolved_records", f"""
WITH {VECTORS} SELECT CAST(id AS VARCHAR) AS label, id % 3 = 0 AS periodic, CASE WHEN id % 2 = 0 THEN '6' ELSE 'C1' END AS first_symbol,
 round(vec[1], 6) + 0.0 AS x, CASE WHEN id % 3 = 0 THEN 2.0 END::DOUBLE AS edge, round(vec[64], 6) + 0.0 AS energy_total FROM vectors""")
def _(spark, d):
    v = vectors(spark, d)
    flat = lambda a: F.struct(a.alias("flatData"))
    number = F.when(F.col("id") % 2 == 0, F.array(F.lit(6), F.lit(6)))
    doc = F.to_json(F.struct(
        flat(F.transform(F.slice("vec", 1, 6), lambda x: x * 1e-10)).alias("atom_positions"), number.alias("atom_species"),
        flat(F.array(F.lit("C1"), F.lit("C2"))).alias("atom_labels"),
        F.array(flat(F.array_repeat(F.col("id") % 3 == 0, 3))).alias("configuration_periodic_dimensions"),
        flat(F.transform(F.array(*[F.lit(2.0 if i % 4 == 0 else 0.0) for i in range(9)]), lambda x: x * 1e-10)).alias("simulation_cell")))
    uri = F.concat(F.lit("archive://"), F.col("id").cast("string"))
    records = v.select(uri.alias("uri"), doc.alias("json")).withColumn("path", F.explode(F.array(F.lit("0c"), F.lit("1c"))))
    s, _ = R.resolve_records(records, v.select(uri.alias("uri"), F.col("vec")[63].alias("energy_total")))
    return s.select("label", "periodic", F.col("symbols")[0].alias("first_symbol"), rounded(F.col("positions")[0][0]).alias("x"),
                    rounded(F.get(F.get("cell", F.lit(0)), F.lit(0))).alias("edge"), rounded("energy_total").alias("energy_total"))


@query("S12_manifest_read", "SELECT p_partkey || '_desc.json' AS path FROM part WHERE p_size % 2 = 0")
def _(spark, d):
    path = scratch_path(spark, "manifest")
    files = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.when(
        F.col("p_size") % 2 == 0, "_desc.json").otherwise("_target.json")).alias("path"))
    W.file_manifest(files).write.parquet(path)
    return R.manifest_files(spark.read.parquet(path), "desc_files")


@query("S13_document_list", """
SELECT CAST(row_number() OVER (ORDER BY n_nationkey || '/') - 1 AS BIGINT) AS position, n_name AS symbol, CAST(n_regionkey AS DOUBLE) AS x FROM nation""")
def _(spark, d):
    path = scratch_path(spark, "documents")
    frame = F.struct(F.array("n_name").alias("symbols"), F.array(F.array(F.col("n_regionkey").cast("double"))).alias("positions"))
    table(spark, d, "nation").select("n_nationkey", F.array(frame).alias("data")).repartition("n_nationkey").write.partitionBy("n_nationkey").json(path)
    docs = R.read_documents(spark, path)
    return docs.select(long(F.element_at(F.split("label", "_"), -1)).alias("position"), F.col("symbols")[0].alias("symbol"),
                       F.col("positions")[0][0].alias("x"))


@query("K5_provenance", "SELECT CAST(p_partkey AS VARCHAR) AS structure_id, p_name AS label, '4.0' AS cutoff FROM part")
def _(spark, d):
    path = scratch_path(spark, "provenance")
    W.write_provenance(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("structure_id"), F.col("p_name").alias("label")),
                       {"cutoff": 4.0}, path)
    cutoff = spark.read.json(f"{path}/parameters").first()["value"]
    return spark.read.parquet(f"{path}/labels").withColumn("cutoff", F.lit(cutoff))


@query("E20_record_files", "SELECT p_partkey, p_type, p_retailprice FROM part")
def _(spark, d):
    path = scratch_path(spark, "records")
    W.write_records(table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice"), path)
    return spark.read.schema("p_partkey long, p_type string, p_retailprice double").json(path)


@query("U1_file_union", "SELECT c_custkey AS key, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    a, b = scratch_path(spark, "union"), scratch_path(spark, "union")
    W.write_structures(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal")), a)
    W.write_structures(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal")), b)
    return spark.read.parquet(a, b)


@query("U2_feature_rows_union", """
SELECT c_custkey AS key, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


# --- predictions, one measure each -------------------------------------------

_MEAN = "m AS (SELECT id, class_id, avg(p) AS mp FROM samples GROUP BY ALL)"


@query("A13_predictive_entropy", f"""
WITH {SAMPLES}, {_MEAN} SELECT id, round(-sum(greatest(mp, 1e-12) * log2(greatest(mp, 1e-12))), 6) AS predictive_entropy FROM m GROUP BY id""")
def _(spark, d):
    return uncertainty.committee_uncertainty(samples(spark, d), 4).select("id", rounded("predictive_entropy").alias("predictive_entropy"))


@query("A14_mutual_information", f"""
WITH {SAMPLES}, {_MEAN}, h AS (SELECT id, -sum(mp * log2(mp)) AS h FROM m GROUP BY id), s AS (SELECT id, sum(p * log2(p)) / 16 AS s FROM samples GROUP BY id)
SELECT id, round(h + s, 6) + 0.0 AS mutual_information FROM h JOIN s USING (id)""")
def _(spark, d):
    return uncertainty.committee_uncertainty(samples(spark, d), 4).select("id", rounded("mutual_information").alias("mutual_information"))


@query("Q2_top_filters_per_label", f"""
WITH {VECTORS}, a AS (SELECT label AS img, i - 1 AS filter, sum(vec[i]) AS score FROM vectors, range(1, 65) t(i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, filter) AS rank FROM a) SELECT img, filter, rank FROM r WHERE rank <= 5""")
def _(spark, d):
    act = vectors(spark, d).select(F.col("label").alias("img"), F.posexplode("vec").alias("filter", "v"))
    return uncertainty.top_filters(act, 5).select("img", long("filter").alias("filter"), long("rank").alias("rank"))


# --- user functions ----------------------------------------------------------

@query("D2_user_descriptor", f"""
WITH {POINTS} SELECT structure_id, count(*) AS n, 'atom_count' AS descriptor_name FROM points GROUP BY 1""")
def _(spark, d):
    from latticeloom.plans.analysis import descriptor_table, make_descriptor, register_descriptor

    class AtomCount:
        name, params, length = "atom_count", {}, 1

        def calculate(self, atoms, structures):
            return atoms.groupBy("structure_id").agg(F.array(F.count(F.lit(1)).cast("double")).alias("value"))

    register_descriptor("atom_count", AtomCount)
    p = points(spark, d)
    out = descriptor_table(make_descriptor("atom_count"), p, p.select("structure_id").distinct())
    return out.select("structure_id", long(F.col("value")[0]).alias("n"), "descriptor_name")


@query("D3_row_function", "SELECT p_partkey, round(p_retailprice * p_size, 4) AS value FROM part")
def _(spark, d):
    def row_function(row):
        return row["p_retailprice"] * row["p_size"]
    part = table(spark, d, "part")
    return part.select("p_partkey", rounded(row_function({c: F.col(c) for c in part.columns}), 4).alias("value"))


@query("D4_user_key", """
SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) > 1 AS is_duplicate FROM documents""")
def _(spark, d):
    key = F.concat_ws("/", "lang", "source")
    return filters.split_duplicates(table(spark, d, "documents").select("doc_id", "lang", "source"), key, "doc_id").select("doc_id", "is_duplicate")


@query("D5_user_estimator", "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY vec_id % 3) AS least FROM embeddings")
def _(spark, d):
    from pyspark.ml.clustering import BisectingKMeans

    out = ml.cluster(_groups(spark, d, 3), mode="none", estimator=BisectingKMeans(k=3, seed=1)).select("id", "cluster")
    return _named(out).select("id", "least")


@query("D6_user_model_factory", _split_sql(0.25, 2, "SELECT id, label AS target_pred_class, label = 0 AS is_first FROM s WHERE split = 'validation'"))
def _(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    def factory(layers, label, **_):
        return Pipeline(stages=[LogisticRegression(labelCol=label, featuresCol="features", maxIter=20)])

    _, train, held = _split(_groups(spark, d, 2).withColumn("label", F.col("group").cast("double")).select("id", "vec", "label"))
    model, _, _ = ml.train_classifier(train, held, [[]], factory=factory)
    return ml.score(held, model).select("id", long("target_pred_class").alias("target_pred_class"), (F.col("probs")[0] > 0.5).alias("is_first"))


@query("P8_nan_for_empty_structures", """
WITH k AS (SELECT l_orderkey, l_returnflag, count(*) AS k FROM lineitem GROUP BY ALL), v AS (SELECT l_orderkey, sum(k) AS n FROM k WHERE k >= 2 GROUP BY 1)
SELECT o_orderkey AS l_orderkey, v.n IS NULL AS is_nan, CAST(v.n AS DOUBLE) AS n FROM orders LEFT JOIN v ON v.l_orderkey = o_orderkey""")
def _(spark, d):
    atoms = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    kept = filters.drop_rare_species(atoms, 2, "l_orderkey", "l_returnflag")
    values = kept.groupBy("l_orderkey").agg(F.array(F.count(F.lit(1)).cast("double")).alias("value"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    out = filters.with_descriptor_or_nan(orders, values, 1, "l_orderkey")
    v = F.col("value")[0]
    return out.select("l_orderkey", F.isnan(v).alias("is_nan"), F.when(~F.isnan(v), v).alias("n"))


@query("U4_species_list", f"WITH {POINTS} SELECT DISTINCT structure_id, symbol FROM points")
def _(spark, d):
    return features.species_of(points(spark, d))
