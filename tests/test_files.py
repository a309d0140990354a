import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeloom.functions import vectors as V
from latticeloom.operators.labels import merge_labels
from latticeloom.plans.analysis import descriptor_job, make_descriptor, per_item, register_descriptor
from latticeloom.sources import readers as R
from latticeloom.sources import writers as W
from latticeloom.streaming import apply_rowwise


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_xyz_headers_are_skipped_over_many_splits(spark, tmp_path):
    rows = [f"Cu {i}.5 0.25 -1e-3 29" for i in range(2000)]
    put(f"{tmp_path}/a.xyz", f"2000\nH 0 0 0\n" + "\n".join(rows) + "\n")      # a comment that looks like an atom
    put(f"{tmp_path}/b.xyz", "2\n\nFe 1 2 3\nO 4 5 6\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = R.read_xyz(spark, str(tmp_path), ["number"])
        assert out.rdd.getNumPartitions() > 4
        got = out.toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2002 and set(got["symbol"]) == {"Cu", "Fe", "O"}
    assert sorted(got[got["symbol"] == "Cu"]["x"]) == [i + 0.5 for i in range(2000)]
    small = R.read_small_xyz(spark, str(tmp_path)).where("symbol != 'Cu'").orderBy("line_no").collect()
    assert [r["line_no"] for r in small] == [2, 3]


def test_xyz_keeps_every_line_and_refuses_bad_numbers(spark, tmp_path):
    put(f"{tmp_path}/good/a.xyz", "4\nany\n26 0 0 0\nfe 1 2 3\n\nXx1a  4 5 -6e-1\r\nFe 7 8 9\n   \n")
    put(f"{tmp_path}/bad/a.xyz", "2\n\nFe 1 2 3\nFe 1 two 3\n")
    put(f"{tmp_path}/short/a.xyz", "2\n\nFe 1 2 3\nFe 1 2\n")
    for read in (R.read_xyz, R.read_small_xyz):
        rows = read(spark, f"{tmp_path}/good").orderBy("line_no").collect()
        assert [(r.symbol, r.x, r.y, r.z) for r in rows] == [("26", 0, 0, 0), ("fe", 1, 2, 3), ("Xx1a", 4, 5, -0.6), ("Fe", 7, 8, 9)]
        for folder in ("bad", "short"):
            with pytest.raises(Exception, match="not an atom line: Fe 1 "):
                read(spark, f"{tmp_path}/{folder}").collect()


def test_written_xyz_parts_are_complete_files(spark, tmp_path):
    atoms = spark.range(25).select("id", F.lit("Al").alias("symbol"), *[(F.col("id") * 0.5).alias(a) for a in "xyz"])
    W.write_xyz(atoms, f"{tmp_path}/out", ["id"], rows_per_part=10)
    parts = sorted(p for p in os.listdir(f"{tmp_path}/out") if p.startswith("part="))
    assert parts == ["part=0", "part=1", "part=2"]
    for part, n in zip(parts, (10, 10, 5)):
        files = [f for f in os.listdir(f"{tmp_path}/out/{part}") if f.endswith(".txt")]
        lines = open(f"{tmp_path}/out/{part}/{files[0]}").read().splitlines()
        assert len(files) == 1 and lines[0] == str(n) and lines[1] == "" and len(lines) == n + 2
    assert R.read_xyz(spark, f"{tmp_path}/out").count() == 25


CSCL = "lattice_vector 4.0 0.0 0.0\nlattice_vector 0.0 4.0 0.0\nlattice_vector 0.0 0.0 5.0\natom_frac 0.0 0.0 0.0 Cs\natom 2.0 2.0 2.5 Cl\natom_frac 0.5 0.25 0.5 Na\n"


def test_geometry_and_prototypes(spark, tmp_path):
    put(f"{tmp_path}/Binaries/CsCl/CsCl.in", CSCL)
    put(f"{tmp_path}/Nanotubes/n8/tube.in", "atom 0 0 0 C\natom 1 0 0 C\n")
    put(f"{tmp_path}/Other/x/skip.in", "atom 0 0 0 H\n")
    put(f"{tmp_path}/Binaries/CsCl/notes.txt", "atom 0 0 0 H\n")
    atoms, structures = R.read_geometry(spark, str(tmp_path))
    got = {(r["symbol"], r["x"], r["y"], r["z"]) for r in atoms.where("symbol in ('Cs', 'Cl', 'Na')").collect()}
    assert got == {("Cs", 0.0, 0.0, 0.0), ("Cl", 2.0, 2.0, 2.5), ("Na", 2.0, 1.0, 2.5)}
    flags = {r["label"]: r["pbc"] for r in structures.collect()}
    assert flags["CsCl"] == [True] * 3 and flags["tube"] == [False] * 3
    atoms, s = R.read_prototypes(spark, str(tmp_path), ["Binaries", "Nanotubes"], [True, False])
    assert sorted(r["label"] for r in s.collect()) == ["Binaries_CsCl_pbc_False", "Binaries_CsCl_pbc_True", "Nanotubes_tube_pbc_False"]
    assert atoms.count() == 5


def test_molecules(spark, tmp_path):
    block = "1\n" + " ".join(str(v) for v in range(14)) + "\nC 0 0 0\n"
    path = put(f"{tmp_path}/m.xyz", block + "\n" + block.replace("13", "26"))
    rows = R.read_molecules(spark, path).collect()
    assert len(rows) == 2 and rows[0]["homo_lumo_gap_gw"] == 3.0 and rows[0]["homo_lumo_gap_pbe0"] == 3.0
    assert {r["imax_zindo"] for r in rows} == {13.0, 26.0} and rows[0]["atom_lines"] == ["C 0 0 0"]


def test_listing_groups_and_manifest(spark, tmp_path):
    for n in ("a_desc.json", "sub/b_desc.json", "sub/c_target.json", "d.txt"):
        put(f"{tmp_path}/{n}", "{}")
    files = R.list_files(spark, str(tmp_path))
    assert files.count() == 3
    m = W.file_manifest(files.union(files))
    assert R.manifest_files(m, "desc_files").count() == 2 and m.count() == 3
    docs = spark.createDataFrame([("k1", [(["f1", "f2"],)]), ("k2", [(["f3"],)])],
                                 "key string, data array<struct<filtered_json_list:array<string>>>")
    paths = R.paths_of_keys(docs, ["k1"])
    assert {r["path"] for r in paths.collect()} == {"f1", "f2"}
    assert R.count_per_key(paths).first()["n_files"] == 2


def test_targets_with_broken_lines(spark, tmp_path):
    put(f"{tmp_path}/t/part.json", json.dumps({"data": [{"checksum": "c", "target": "225"}]}) + "\nnot json\n")
    good, bad = R.read_targets(spark, f"{tmp_path}/t")
    assert [r["target"] for r in good.collect()] == ["225"] and [r["line"] for r in bad.collect()] == ["not json"]


def test_structure_database_restores_info(spark, tmp_path):
    docs = [{"structure_id": "a", "symbols": ["H"], "positions": [[0, 0, 1]], "info": {"data": {"target": "x"}}},
            {"structure_id": "b", "symbols": ["H", "O"], "positions": [[0, 0, 1], [1, 0, 0]], "info": {"target": "y"}}]
    put(f"{tmp_path}/db.json", json.dumps(docs))
    s = R.read_structures(spark, f"{tmp_path}/db.json")
    assert {r["structure_id"]: r["target"] for r in s.collect()} == {"a": "x", "b": "y"}
    assert R.explode_atoms(s).count() == 3


def test_documents_get_labels_in_path_order(spark, tmp_path):
    for n, z in (("b", "Si"), ("a", "Ge")):
        put(f"{tmp_path}/{n}.json", json.dumps({"data": [{"symbols": [z]}, {"symbols": ["X"]}]}))
    got = {r["label"]: r["symbols"] for r in R.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a_0": ["Ge"], "b_1": ["Si"]}


def record(species=None, labels=None, periodic=True):
    r = {"atom_positions": {"flatData": [0, 0, 0, 1e-10, 0, 0], "shape": [2, 3]},
         "configuration_periodic_dimensions": [{"flatData": [periodic] * 3}],
         "simulation_cell": {"flatData": [2e-10, 0, 0, 0, 2e-10, 0, 0, 0, 2e-10], "shape": [3, 3]}}
    if species:
        r["atom_species"] = species
    if labels:
        r["atom_labels"] = {"flatData": labels}
    return json.dumps(r)


def test_records_fall_back_in_order(spark):
    rows = [("archive://x/one", "0c", record(labels=["C1", "C2"])), ("archive://x/one", "1c", record(species=[6, 6])),
            ("archive://x/two", "0c", record(labels=["O", "H"], periodic=False)), ("archive://x/three", "0c", "{}")]
    energies = spark.createDataFrame([("archive://x/one", -5.0)], "uri string, energy_total double")
    s, atoms = R.resolve_records(spark.createDataFrame(rows, "uri string, path string, json string"), energies)
    got = {r["label"]: r for r in s.collect()}
    assert set(got) == {"one", "two"} and got["one"]["symbols"] == ["6", "6"] and got["one"]["energy_total"] == -5.0
    assert got["two"]["symbols"] == ["O", "H"] and got["two"]["cell"] is None
    assert np.allclose(got["one"]["cell"], np.eye(3) * 2) and atoms.count() == 4
    assert atoms.agg(F.max("x")).first()[0] == pytest.approx(1.0)


def test_dataset_round_trip_and_provenance(spark, tmp_path):
    x = spark.range(60).select("id", F.array(F.col("id").cast("double")).alias("vec"), (F.col("id") % 3).alias("t"))
    rows = merge_labels(x.select("id", "vec"), x, "id", "t", one_hot_labels=True, test_size=12)
    W.write_dataset(rows, f"{tmp_path}/d", "t", "notes")
    back, summary = R.read_dataset(spark, f"{tmp_path}/d")
    s = summary.first()
    assert s["nb_classes"] == 3 and s["nb_rows"] == 60 and [c["label"] for c in s["classes"]] == ["0", "1", "2"]
    assert back.where("split = 'validation'").groupBy("class_id").count().toPandas()["count"].tolist() == [4, 4, 4]
    st = spark.createDataFrame([("a", "l1"), ("b", "l2")], "structure_id string, label string")
    W.write_provenance(st, {"cutoff": 4.0}, f"{tmp_path}/p")
    assert spark.read.json(f"{tmp_path}/p/parameters").first()["value"] == "4.0"
    assert spark.read.parquet(f"{tmp_path}/p/labels").count() == 2
    W.write_records(st, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2


def test_descriptor_catalogue(spark, tmp_path):
    put(f"{tmp_path}/c.json", json.dumps({"type": "x", "metaInfos": [{"name": "prdf", "file_ending": "_prdf.json"}]}))
    assert R.read_catalogue(spark, f"{tmp_path}/c.json").first()["name"] == "prdf"


def test_user_descriptor_and_operations(spark):
    class Count:
        name, params, length = "count", {}, 1

        def __str__(self):
            return "count()"

        def calculate(self, atoms, structures):
            return atoms.groupBy("structure_id").agg(F.array(F.count(F.lit(1)).cast("double")).alias("value"))

    register_descriptor("count", Count)
    atoms = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "structure_id string, atom_id int")
    s = atoms.select("structure_id").distinct()
    targets = spark.createDataFrame([("a", "t1"), ("b", "t2")], "structure_id string, target string")
    ops = [("keep", lambda a, t: (a, t), {}), ("first", lambda a, t, n: (a.where(F.col("atom_id") <= n), t), {"n": 1})]
    out = {r["structure_id"]: (r["value"][0], r["target"]) for r in descriptor_job(make_descriptor("count"), atoms, s, targets, ops).collect()}
    assert out == {"a#keep": (2.0, "t1"), "b#keep": (1.0, "t2"), "a#first": (1.0, "t1"), "b#first": (1.0, "t2")}
    with pytest.raises(KeyError):
        make_descriptor("none")


def test_failing_rows_carry_their_error(spark):
    df = spark.createDataFrame([(1, 0), (2, 4)], "id long, n int")
    rows = per_item(df, lambda r: {"id": r["id"], "q": 8 // r["n"]}, "id long, q long").collect()
    assert {(r["id"], r["q"]) for r in rows} == {(None, None), (2, 2)}
    assert any("ZeroDivisionError" in (r["error"] or "") for r in rows)


def test_row_functions_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], "id int, vec array<double>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, vec array<double>").parquet(f"{tmp_path}/in")
    out = apply_rowwise(stream, lambda df: df.withColumn("unit", V.min_max(F.col("vec"))), lambda df: df.where("id > 0"))
    q = out.writeStream.format("memory").queryName("rows").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rows").count() == 3
    with pytest.raises(ValueError):
        apply_rowwise(spark.range(1))
