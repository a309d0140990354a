"""Sources: structure files, records, datasets and manifests as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeloom.distributed import lookup_join, row_index

STRUCTURE = "structure_id"
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"

# Columns of the molecule benchmark, in file order.
MOLECULE_COLUMNS = [
    "ae_pbe0", "p_pbe0", "p_scs", "homo_gw", "homo_pbe0", "homo_zindo", "lumo_gw", "lumo_pbe0",
    "lumo_zindo", "ip_zindo", "ea_zindo", "e1_zindo", "emax_zindo", "imax_zindo",
]
# Keys of a structure record, by where the species stand.
RECORD_KEYS = {
    "atom_species": ["atom_positions", "atom_species", "configuration_periodic_dimensions"],
    "atom_labels": ["atom_positions", "atom_labels", "configuration_periodic_dimensions"],
}

_ARRAY = "struct<flatData:array<double>,shape:array<int>>"
SYSTEM_SCHEMA = (
    f"atom_positions {_ARRAY}, atom_species array<int>, atom_labels struct<flatData:array<string>>, "
    f"configuration_periodic_dimensions array<struct<flatData:array<boolean>>>, simulation_cell {_ARRAY}"
)
STRUCTURE_SCHEMA = (
    "structure_id string, label string, symbols array<string>, positions array<array<double>>, "
    "cell array<array<double>>, pbc array<boolean>, info struct<target:string,energy_total:double,"
    "data:struct<target:string,energy_total:double>>"
)
TARGET_SCHEMA = (
    "data array<struct<checksum:string,ase_db_file:string,chemical_formula:string,"
    "cell:array<array<double>>,filename:string,target:string,spacegroups:map<string,string>>>"
)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


# --- text structure files ----------------------------------------------------

def read_xyz(spark: SparkSession, path: str | Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Atoms of XYZ files: ``(source, line_no, symbol, x, y, z, *extra)``.

    The files stay splittable, so one huge file is read by many tasks. The two header
    lines are those with the smallest line ids in the block at offset 0 of a file:
    lines of one block are read in order by one task.

    Every line after the headers that is not blank is an atom: its first word is the symbol, whatever it is. A line without
    three finite numbers raises an error when its numbers are read.
    """
    lines = (spark.read.option("recursiveFileLookup", True).text(path if isinstance(path, str) else list(path))
             .select(F.col("_metadata.file_path").alias("source"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("line_no"), "value"))
    first = lines.where("_block = 0").groupBy("source").agg(F.min("line_no").alias("_first"))
    body = lookup_join(lines, first, "source", "left").where(
        F.col("_first").isNull() | (F.col("_block") > 0) | ~F.col("line_no").between(F.col("_first"), F.col("_first") + 1))
    return _atom_rows(body, extra)


def _atom_rows(body: DataFrame, extra: Sequence[str]) -> DataFrame:
    t = F.col("_t")
    bad = F.raise_error(F.concat(F.lit("not an atom line: "), F.col("value"), F.lit(" in "), F.col("source"))).cast("double")
    return body.where(F.col("value").rlike(r"\S")).withColumn("_t", _tokens(F.col("value"))).select(
        "source", "line_no", t[0].alias("symbol"),
        *[F.when(F.get(t, F.lit(i + 1)).rlike(f"^{_NUMBER}$"), F.get(t, F.lit(i + 1)).try_cast("double")).otherwise(bad).alias(a)
          for i, a in enumerate("xyz")],
        *[F.get(t, F.lit(4 + i)).alias(name) for i, name in enumerate(extra)])


def read_small_xyz(spark: SparkSession, path: str | Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Many small XYZ files: one row per file is split, so ``line_no`` is the position
    in the file."""
    files = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("source"),
                         F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return _atom_rows(lines.where(F.col("line_no") >= 2), extra)


def read_geometry(spark: SparkSession, folder: str, suffix: str = ".in") -> tuple[DataFrame, DataFrame]:
    """Geometry files below ``folder``: (atoms, structures).

    Lines are ``lattice_vector``, ``atom`` and ``atom_frac``; fractional positions are
    multiplied with the file's cell.
    """
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
             .text(folder, wholetext=True)
             .select(F.col("_metadata.file_path").alias("source"), "value"))
    # a file is one row, so its cell and its atoms come from one expression each and nothing is shuffled
    parsed = F.filter(F.transform(F.split("value", "\n"), lambda line, i: F.struct(i.alias("line_no"), _tokens(line).alias("t"))),
                      lambda x: F.get(x["t"], F.lit(0)).isin("lattice_vector", "atom", "atom_frac"))
    files = files.select("source", parsed.alias("p")).where(F.size("p") > 0)
    is_cell = lambda x: x["t"][0] == "lattice_vector"
    vector = lambda t: F.array(*[t[i].cast("double") for i in (1, 2, 3)])
    files = files.select("source", F.transform(F.filter("p", is_cell), lambda x: vector(x["t"])).alias("cell"),
                         F.filter("p", lambda x: ~is_cell(x)).alias("places"))
    structures = files.select(_stem(F.col("source")).alias("label"), F.col("source").alias(STRUCTURE), "cell",
                              F.array_repeat(F.size("cell") == 3, 3).alias("pbc"))
    rows = files.select("source", "cell", F.explode("places").alias("p")).select(
        "source", "cell", "p.line_no", F.col("p.t")[0].alias("kind"), vector(F.col("p.t")).alias("v"), F.get("p.t", F.lit(4)).alias("symbol"))
    xyz = [F.when(F.col("kind") == "atom", F.col("v")[k]).otherwise(
        sum((F.col("v")[i] * F.get(F.get("cell", F.lit(i)), F.lit(k)) for i in (1, 2)),
            F.col("v")[0] * F.get(F.get("cell", F.lit(0)), F.lit(k)))) for k in range(3)]
    atoms = rows.select(F.col("source").alias(STRUCTURE), F.col("line_no").alias("atom_id"), "symbol",
                        *[c.alias(a) for c, a in zip(xyz, "xyz")])
    return atoms, structures


def read_prototypes(spark: SparkSession, folder: str, datasets: Sequence[str], periodic: Sequence[bool] = (True,),
                    suffix: str = ".in") -> tuple[DataFrame, DataFrame]:
    """Catalogue laid out as ``<dataset>/<class>/<file>.in``: one structure per file and
    periodicity flag, with its class; nanotubes only without periodicity."""
    atoms, s = read_geometry(spark, folder, suffix)
    part = r"([^/]+)/([^/]+)/[^/]+$"
    s = (s.withColumn("dataset", F.regexp_extract(STRUCTURE, part, 1))
         .withColumn("crystal_structure", F.regexp_extract(STRUCTURE, part, 2))
         .where(F.col("dataset").isin(list(datasets)))
         .withColumn("periodic", F.explode(F.array(*[F.lit(bool(p)) for p in periodic])))
         .where(~(F.col("periodic") & (F.col("dataset") == "Nanotubes"))))
    flag = F.when(F.col("periodic"), "True").otherwise("False")
    s = s.select(STRUCTURE, F.concat(F.col("dataset"), F.lit("_"), F.col("label"), F.lit("_pbc_"), flag).alias("label"),
                 "dataset", "crystal_structure", "cell", F.array_repeat(F.col("periodic"), 3).alias("pbc"))
    chosen = s.select(STRUCTURE).distinct()
    return lookup_join(atoms, chosen, STRUCTURE, "left_semi"), s


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """Molecule blocks separated by blank lines: 14 properties from the second line of
    a block, and two gaps."""
    block = (spark.read.option("lineSep", "\n\n").text(path)
             .where(F.trim("value") != "").select(F.split(F.regexp_replace("value", r"^\n+", ""), "\n").alias("_l")))
    values = block.select("_l", _tokens(F.col("_l")[1]).alias("_t"))
    out = values.select(*[F.col("_t")[i].cast("double").alias(c) for i, c in enumerate(MOLECULE_COLUMNS)],
                        F.expr("filter(slice(_l, 3, size(_l)), x -> x != '')").alias("atom_lines"))
    return (out.withColumn("homo_lumo_gap_gw", F.col("lumo_gw") - F.col("homo_gw"))
            .withColumn("homo_lumo_gap_pbe0", F.col("lumo_pbe0") - F.col("homo_pbe0")))


# --- listings ----------------------------------------------------------------

def list_files(spark: SparkSession, folders: str | Sequence[str], glob: str = "*.json") -> DataFrame:
    """Paths below one or several folders; file contents are never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .load([folders] if isinstance(folders, str) else list(folders)).select("path"))


def group_files(files: DataFrame, key: Column) -> DataFrame:
    """Files with their derived key; one row each, so a popular key is no long list."""
    return files.select(key.alias("key"), "path")


def paths_of_keys(documents: DataFrame, accepted: Sequence[str], key: str = "key") -> DataFrame:
    """Files listed in ``data[0].filtered_json_list`` of the documents of accepted keys."""
    return (documents.where(F.col(key).isin(list(accepted)))
            .select(key, F.explode(F.get("data", F.lit(0))["filtered_json_list"]).alias("path")))


def count_per_key(paths: DataFrame, key: str = "key") -> DataFrame:
    return paths.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"))


def manifest_files(manifest: DataFrame, file_type: str) -> DataFrame:
    return manifest.where(F.col("file_type") == file_type).select("path")


# --- records -----------------------------------------------------------------

def read_structures(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Structure database in JSON form; nested ``info.data`` is restored to ``info``."""
    raw = spark.read.schema(STRUCTURE_SCHEMA).option("multiLine", multi_line).json(path)
    pick = lambda f: F.coalesce(F.col(f"info.data.{f}"), F.col(f"info.{f}")).alias(f)
    return raw.select(*[c for c in raw.columns if c != "info"], pick("target"), pick("energy_total"))


def explode_atoms(structures: DataFrame) -> DataFrame:
    """Atoms table from structures with ``symbols`` and ``positions``."""
    return structures.select(STRUCTURE, F.posexplode(F.arrays_zip("symbols", "positions")).alias("atom_id", "_a")).select(
        STRUCTURE, "atom_id", F.col("_a.symbols").alias("symbol"),
        *[F.col("_a.positions")[i].alias(a) for i, a in enumerate("xyz")])


def read_targets(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Target records, one line each: (first frames as columns, unreadable lines)."""
    schema = T.StructType.fromDDL(TARGET_SCHEMA).add("_bad", T.StringType())
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).where(F.trim("value") != "")
    raw = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = raw.where(F.col("r._bad").isNull() & F.col("r.data").isNotNull()).select(
        F.get("r.data", F.lit(0)).alias("_d")).select("_d.*")
    return good, raw.where(F.col("r._bad").isNotNull()).select(F.col("r._bad").alias("line"))


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """First frame of each JSON document, labelled ``<file stem>_<index in path order>``."""
    schema = ("data array<struct<symbols:array<string>,positions:array<array<double>>,cell:array<array<double>>,"
              "pbc:array<boolean>,spacegroups:map<string,string>>>")
    raw = spark.read.schema(schema).option("multiLine", True).json(paths).select(
        F.col("_metadata.file_path").alias("path"), F.get("data", F.lit(0)).alias("_d"))
    # the index counts documents, one row per file name, not their contents
    order = row_index(raw.select("path").distinct(), ["path"], name="_i")
    return lookup_join(raw, order, "path").select(
        F.concat_ws("_", _stem(F.col("path")), "_i").alias("label"), "path", "_d.*")


def resolve_records(records: DataFrame, energies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Downloaded records ``(uri, path, json)`` to (structures, atoms).

    Per uri the candidates are tried in order: species keys in either path, then label
    keys in either path; the first with all required keys is taken. Metres become
    angstrom; the cell is kept only when all axes are periodic; the label is the last
    part of the uri; ``energies(uri, energy_total)`` are attached.
    """
    sys = records.select("uri", "path", F.from_json("json", SYSTEM_SCHEMA).alias("r"))
    has = lambda keys: F.forall(F.array(*[F.col(f"r.{k}").isNotNull() for k in keys]), lambda b: b)
    rank = F.when(has(RECORD_KEYS["atom_species"]), 0).when(has(RECORD_KEYS["atom_labels"]), 1)
    best = (sys.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
            .groupBy("uri").agg(F.min_by(F.struct("r", "_rank"), F.struct("_rank", "path")).alias("_b"))
            .select("uri", "_b.*"))
    reshaped = lambda a: F.transform(
        F.sequence(F.lit(0), (F.size(a["flatData"]) / 3).cast("int") - 1),
        lambda i: F.transform(F.slice(a["flatData"], i * 3 + 1, 3), lambda v: v * 1e10))
    pbc = F.get(F.col("r.configuration_periodic_dimensions"), F.lit(0))["flatData"]
    periodic = F.forall(pbc, lambda p: p)
    species = F.when(F.col("_rank") == 0, F.transform("r.atom_species", lambda z: z.cast("string"))).otherwise(
        F.col("r.atom_labels.flatData"))
    s = best.select("uri", F.element_at(F.split("uri", "/"), -1).alias("label"), periodic.alias("periodic"),
                    F.when(periodic, reshaped(F.col("r.simulation_cell"))).alias("cell"),
                    species.alias("symbols"), reshaped(F.col("r.atom_positions")).alias("positions"))
    if energies is not None:
        s = s.join(energies, "uri", "left")
    return s, explode_atoms(s.withColumnRenamed("uri", STRUCTURE))


# --- datasets ----------------------------------------------------------------

def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Features with labels and split, and the one-row summary."""
    return spark.read.parquet(f"{folder}/rows"), spark.read.json(f"{folder}/summary")


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV feature, result or viewer table with a given schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Descriptor catalogue: name, description, file name and ending per descriptor."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("metaInfos").alias("m")).select("m.*")


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
