"""Sinks: records, datasets, manifests and structure files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import row_index

STRUCTURE = "structure_id"
# File types by name ending.
FILE_ENDINGS = {
    "desc_files": "_desc.json", "target_files": "_target.json", "ase_db_files": "_ase.db",
    "xray_img_files": "_xray.png", "xray_npy_files": "_xray.npy", "atomic_features_files": "_atomic_features.csv",
}


def write_targets(structures: DataFrame, path: str, target: str = "target", mode: str = "overwrite") -> None:
    """One JSON record per (structure, operation): ``{"data": [{...}]}``."""
    fields = [F.sha2(F.col(STRUCTURE), 224).alias("checksum"), F.col(STRUCTURE).alias("filename"),
              F.col(target).cast("string").alias("target")]
    fields += [F.col(c) for c in ("chemical_formula", "cell", "spacegroups") if c in structures.columns]
    op = F.col("op_id") if "op_id" in structures.columns else F.lit("0")
    (structures.select(op.alias("op_id"), F.array(F.struct(*fields)).alias("data"))
     .write.mode(mode).partitionBy("op_id").json(path))


def write_structures(structures: DataFrame, path: str, overwrite: bool = True) -> None:
    structures.write.mode("overwrite" if overwrite else "append").parquet(path)


def write_descriptors(descriptors: DataFrame, path: str, mode: str = "append") -> None:
    """Descriptors of the whole collection; all tasks write into one dataset."""
    descriptors.write.mode(mode).partitionBy("descriptor_name").parquet(path)


def file_manifest(files: DataFrame, endings: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct files with their type by name ending: ``(file_type, path)``, in order."""
    endings = FILE_ENDINGS if endings is None else endings
    kinds = F.filter(F.array(*[F.when(F.endswith("path", F.lit(e)), F.lit(t)) for t, e in endings.items()]),
                     lambda t: t.isNotNull())
    return files.select(F.explode(kinds).alias("file_type"), "path").distinct().orderBy("file_type", "path")


def write_provenance(structures: DataFrame, parameters: Mapping, path: str, label: str = "label") -> None:
    """Descriptor parameters as one record, the labels as a table beside it."""
    spark = structures.sparkSession
    spark.createDataFrame([(str(k), str(v)) for k, v in sorted(parameters.items())],
                          "parameter string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/parameters")
    structures.select(STRUCTURE, label).write.mode("overwrite").parquet(f"{path}/labels")


def write_dataset(rows: DataFrame, path: str, target: str, notes: str = "", text_label: str = "text_label",
                  class_id: str = "class_id") -> None:
    """Feature rows with labels, and a summary: classes in order with their counts."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows")
    classes = stored.groupBy(class_id, text_label).agg(F.count(F.lit(1)).alias("n"))
    # one entry per class
    summary = classes.agg(F.array_sort(F.collect_list(F.struct(
        F.col(class_id).alias("class_id"), F.col(text_label).cast("string").alias("label"), "n"))).alias("classes"),
        F.count(F.lit(1)).alias("nb_classes"), F.sum("n").alias("nb_rows"))
    (summary.select(F.lit(target).alias("target_name"), F.lit(notes).alias("notes"),
                    F.current_timestamp().alias("creation_date"), "*")
     .coalesce(1).write.mode("overwrite").json(f"{path}/summary"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def xyz_lines(atoms: DataFrame, order: Sequence[str], columns: Sequence[str | Column] = ("symbol", "x", "y", "z"),
              rows_per_part: int = 5_000_000) -> DataFrame:
    """Lines ``(part, line_no, value)`` of XYZ files: count, blank line, one line per atom.

    The atoms are cut in order into parts of a bounded size, each a complete file.
    """
    text = F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])
    body = row_index(atoms.select(*order, text.alias("value")), order, name="_i").select(
        F.floor(F.col("_i") / rows_per_part).alias("part"),
        (F.pmod(F.col("_i"), F.lit(rows_per_part)) + 2).alias("line_no"), "value")
    counts = body.groupBy("part").agg(F.count(F.lit(1)).cast("string").alias("n"))
    line = lambda i, v: F.struct(F.lit(i).cast("long").alias("line_no"), v.alias("value"))
    head = counts.select("part", F.explode(F.array(line(0, F.col("n")), line(1, F.lit("")))).alias("h")).select("part", "h.*")
    return head.unionByName(body)


def write_xyz(atoms: DataFrame, path: str, order: Sequence[str],
              columns: Sequence[str | Column] = ("symbol", "x", "y", "z"), rows_per_part: int = 5_000_000) -> None:
    """Write XYZ files ``part=<n>/...`` of at most ``rows_per_part`` atoms each."""
    (xyz_lines(atoms, order, columns, rows_per_part).repartition("part").sortWithinPartitions("part", "line_no")
     .select("part", "value").write.mode("overwrite").partitionBy("part").text(path))


def write_sparse(entries: DataFrame, path: str) -> None:
    """Sparse matrix as ``(row, col, value)``."""
    entries.select("row", "col", "value").write.mode("overwrite").parquet(path)


def write_facets(records: DataFrame, extra: DataFrame | None, path: str, key: str = STRUCTURE,
                 maps: Sequence[str] = ()) -> None:
    """Target records with map columns expanded and extra columns joined, as CSV."""
    from latticeloom.operators.labels import expand_map

    out = records if extra is None else records.join(extra, key)
    for m in maps:
        out = expand_map(out, m)
    write_table(out, path)
