"""Queries on labels, energies, features, filters and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeloom.distributed import row_index
from latticeloom.functions import algebra, units
from latticeloom.operators import energies, features, filters, labels, uncertainty
from latticeloom.operators import structures as st
from latticeloom.plans.registry import POINTS, SAMPLES, long, points, query, rounded, samples, table

# --- energies ----------------------------------------------------------------

LOW = """low AS (SELECT l_partkey, l_returnflag, min(l_extendedprice) AS e FROM lineitem GROUP BY ALL)"""


@query("A1_lowest_rows", """
SELECT DISTINCT l.l_partkey, l.l_returnflag, l.l_extendedprice FROM lineitem l JOIN
  (SELECT l_partkey, l_returnflag, min(l_extendedprice) AS e FROM lineitem GROUP BY ALL) m
  ON l.l_partkey = m.l_partkey AND l.l_returnflag = m.l_returnflag AND l.l_extendedprice = m.e""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice")
    return energies.lowest_rows(rows, "l_partkey", "l_returnflag", "l_extendedprice")


@query("A2_phase_differences", f"""
WITH {LOW} SELECT a.l_partkey, a.l_returnflag AS phase_a, b.l_returnflag AS phase_b,
  round(a.e - b.e, 4) + 0.0 AS difference
FROM low a JOIN low b ON a.l_partkey = b.l_partkey AND a.l_returnflag <> b.l_returnflag""")
def _(spark, d):
    return energies.phase_differences(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "l_extendedprice") \
        .withColumn("difference", rounded("difference", 4))


@query("A2_phase_table", """
SELECT l_partkey, min(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS "e_A",
  min(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS "e_N",
  min(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS "e_R" FROM lineitem GROUP BY l_partkey""")
def _(spark, d):
    return energies.phase_table(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "l_extendedprice", ["A", "N", "R"])


@query("A3_two_phase_difference", """
WITH p AS (SELECT o_custkey, min(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS e0,
                  min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS e1
           FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_custkey)
SELECT o_custkey, e0, e1, round((e1 - e0) / 2, 4) + 0.0 AS delta_e FROM p""")
def _(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "F")).withColumn(
        "phase", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return energies.two_phase_difference(rows, "o_custkey", "phase", "o_totalprice").withColumn("delta_e", rounded("delta_e", 4))


@query("A4_selected_phase_pairs", f"""
WITH {LOW}, w AS (SELECT l_partkey, max(e) FILTER (WHERE l_returnflag = 'A') AS a,
  max(e) FILTER (WHERE l_returnflag = 'N') AS n, max(e) FILTER (WHERE l_returnflag = 'R') AS r FROM low GROUP BY 1)
SELECT l_partkey, round(a - n, 4) + 0.0 AS "A_N", round(a - r, 4) + 0.0 AS "A_R" FROM w
WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL""")
def _(spark, d):
    diffs = energies.phase_differences(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "l_extendedprice")
    wide = energies.select_phase_pairs(diffs, [("A", "N"), ("A", "R")], "l_partkey", "rows")
    return wide.select("l_partkey", rounded("A_N", 4).alias("A_N"), rounded("A_R", 4).alias("A_R"))


@query("A5_binary_energy_differences", """
WITH h AS (SELECT o_orderkey, o_custkey, o_totalprice * 0.5 AS energy,
  CASE CAST(o_orderpriority[1] AS INTEGER) WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE CAST(o_orderpriority[1] AS INTEGER) END AS phase
  FROM orders),
m AS (SELECT o_custkey, phase, min(energy) AS e FROM h GROUP BY ALL),
w AS (SELECT o_custkey, count(*) AS n, min(e) FILTER (WHERE phase = 1) - min(e) FILTER (WHERE phase = 2) AS diff FROM m GROUP BY 1)
SELECT h.o_orderkey, h.o_custkey, h.phase, round(h.energy, 4) + 0.0 AS energy, round(w.diff, 4) + 0.0 AS "1_2"
FROM h JOIN w ON h.o_custkey = w.o_custkey WHERE w.n > 1""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("energy"),
                                            F.substring("o_orderpriority", 1, 1).cast("int").alias("phase"))
    out = energies.binary_energy_differences(rows, "o_custkey", "phase", "energy", [(1, 4), (2, 5)])
    return out.select("o_orderkey", "o_custkey", "phase", rounded("energy", 4).alias("energy"), rounded("1_2", 4).alias("1_2"))


@query("J2_differences_joined_to_energies", f"""
WITH {LOW}, diff AS (SELECT a.l_partkey, a.l_returnflag, b.l_returnflag AS phase_b, a.e - b.e AS difference
  FROM low a JOIN low b ON a.l_partkey = b.l_partkey AND a.l_returnflag <> b.l_returnflag)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_returnflag, l.l_extendedprice, phase_b,
  round(difference, 4) + 0.0 AS difference
FROM lineitem l JOIN diff USING (l_partkey, l_returnflag)""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    diffs = energies.phase_differences(rows, "l_partkey", "l_returnflag", "l_extendedprice").withColumnRenamed("phase_a", "l_returnflag")
    return rows.join(diffs, ["l_partkey", "l_returnflag"]).withColumn("difference", rounded("difference", 4))


@query("P13_lowest_energy_flag", """
WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F')),
p AS (SELECT o_custkey, least(min(o_totalprice) FILTER (WHERE o_orderstatus = 'O'),
                              min(o_totalprice) FILTER (WHERE o_orderstatus = 'F')) AS low FROM r GROUP BY 1)
SELECT o_orderkey, o_custkey, o_totalprice = low AS is_lowest FROM r JOIN p USING (o_custkey)""")
def _(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "F")).select(
        "o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("phase"))
    return energies.lowest_energy_flag(rows, "o_custkey", "phase", "o_totalprice").select("o_orderkey", "o_custkey", "is_lowest")


@query("Q4_first_after_sort", """
SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def _(spark, d):
    return energies.first_after_sort(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"],
                                     ["o_totalprice", "o_orderkey"], ["o_totalprice", "o_orderkey"])


# --- labels ------------------------------------------------------------------

@query("A6_class_populations", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return labels.class_populations(table(spark, d, "events"), "event_type")


@query("Q7_label_encoding", """
WITH c AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS class_id
           FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, p_type, class_id FROM part JOIN c USING (p_type)""")
def _(spark, d):
    return labels.encode_labels(table(spark, d, "part").select("p_partkey", "p_type"), "p_type")


@query("P14_relabel", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'visit' WHEN event_type = 'purchase' THEN 'sale'
  ELSE event_type END AS label FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", labels.relabel(
        F.col("event_type"), {"visit": ["click", "view"], "sale": ["purchase"]}).alias("label"))


@query("P15_rename_formula", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'LiF' WHEN 1 THEN 'ZnS' WHEN 2 THEN 'XyZ' ELSE 'NaCl' END AS formula FROM part""")
def _(spark, d):
    spelling = F.array(*[F.lit(s) for s in ("FLi", "SZn", "XyZ", "ClNa")])[F.col("p_size") % 4]
    return table(spark, d, "part").select("p_partkey", filters.rename_formula(spelling).alias("formula"))


@query("G4_uniform_bins", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 19 AS step FROM events),
e AS (SELECT i, CASE WHEN i = 19 THEN hi ELSE lo + i * step END AS edge FROM r, range(20) t(i))
SELECT event_id, CAST((SELECT count(*) FROM e WHERE edge <= value) AS BIGINT) AS bin FROM events""")
def _(spark, d):
    return labels.discretise_uniform(table(spark, d, "events"), "value", 20).select("event_id", long("bin").alias("bin"))


@query("G5_quantile_bins", """
WITH q AS (SELECT quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM events)
SELECT event_id, CAST(len(list_filter(edges, lambda e: e <= value)) AS BIGINT) AS bin FROM events, q""")
def _(spark, d):
    return labels.discretise_quantiles(table(spark, d, "events"), "value", 10).select("event_id", long("bin").alias("bin"))


@query("G6_bin_frequencies", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 12 AS step FROM events),
e AS (SELECT i, CASE WHEN i = 12 THEN hi ELSE lo + i * step END AS edge FROM r, range(13) t(i)),
b AS (SELECT least(12, (SELECT count(*) FROM e WHERE edge <= value)) AS bin FROM events)
SELECT l.i + 1 AS bin, round(l.edge, 6) AS left_edge, round(r.edge, 6) AS right_edge,
  (SELECT count(*) FROM b WHERE b.bin = l.i + 1) AS n
FROM e l JOIN e r ON r.i = l.i + 1""")
def _(spark, d):
    ev = table(spark, d, "events")
    lo, hi = labels.value_range(ev, "value")
    out = labels.bin_frequencies(ev, "value", labels.evenly_spaced(lo, hi, 13))
    return out.select(long("bin").alias("bin"), rounded("left_edge").alias("left_edge"),
                      rounded("right_edge").alias("right_edge"), long("n").alias("n"))


@query("G7_adaptive_colours", """
WITH q AS (SELECT quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8]) AS edges FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(len(list_filter(edges, lambda e: e < l_quantity)) AS BIGINT) AS color_bin FROM lineitem, q""")
def _(spark, d):
    out, _ = labels.adaptive_quantile_bins(table(spark, d, "lineitem"), "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", long("color_bin").alias("color_bin"))


@query("Q8_batches", """
SELECT event_id, CAST(floor((row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '#7'), event_id) - 1) / 64) AS BIGINT) AS batch
FROM events""")
def _(spark, d):
    return labels.batch_ids(table(spark, d, "events").select("event_id"), "event_id", 64, shuffle=True, seed=7)


@query("Q8_ordered_batches", """
SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS batch FROM orders""")
def _(spark, d):
    return labels.batch_ids(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("Q9_stratified_split", """
WITH n AS (SELECT count(*) AS total, CAST(round(count(*) * 0.2) AS BIGINT) AS held FROM events),
c AS (SELECT event_type, count(*) AS k, floor(count(*) * held / CAST(total AS DOUBLE)) AS base,
        count(*) * held / CAST(total AS DOUBLE) - floor(count(*) * held / CAST(total AS DOUBLE)) AS rest
      FROM events, n GROUP BY event_type, held, total),
q AS (SELECT event_type, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, event_type) <=
        (SELECT held FROM n) - (SELECT sum(base) FROM c) THEN 1 ELSE 0 END AS quota FROM c),
r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
        ORDER BY md5(CAST(event_id AS VARCHAR) || '#42'), event_id) AS rn FROM events)
SELECT event_id, event_type, CASE WHEN rn <= quota THEN 'validation' ELSE 'train' END AS split FROM r JOIN q USING (event_type)""")
def _(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type")
    return labels.split_rows(ev, "event_id", 0.2, "event_type").select("event_id", "event_type", "split")


@query("Q9_plain_split", """
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '#42'), event_id) <= 500
  THEN 'validation' ELSE 'train' END AS split FROM events""")
def _(spark, d):
    return labels.split_rows(table(spark, d, "events").select("event_id"), "event_id", 500)


@query("Q6_natural_order", """
SELECT 'struct-' || event_id AS label, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events""")
def _(spark, d):
    named = table(spark, d, "events").select(F.concat(F.lit("struct-"), "event_id").alias("label"))
    suffix = F.element_at(F.split("label", "struct-"), 2).cast("long")
    return row_index(named.withColumn("_s", suffix), ["_s"], name="position").select("label", "position")


@query("P3_default_labels", """
SELECT o_orderkey, 'struct-' || (row_number() OVER (ORDER BY o_orderkey) - 1) AS label FROM orders""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("label"))
    return labels.default_labels(rows, "label", ["o_orderkey"])


@query("M30_record_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", labels.record_field(ev, "props", "k").cast("long").alias("k"))


@query("P4_expand_map", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS spacegroup_0.001_qty, l_tax AS spacegroup_tax FROM lineitem"""
       .replace("spacegroup_0.001_qty", '"spacegroup_0.001_qty"'))
def _(spark, d):
    m = F.create_map(F.lit("(0.001, qty)"), F.col("l_quantity"), F.lit("tax"), F.col("l_tax"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", m.alias("spacegroup"))
    return labels.expand_map(rows, "spacegroup")


@query("P1_descriptor_field", "SELECT event_id, value AS descriptor_value FROM events")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct(
        F.lit("spectrum").alias("descriptor_name"), F.col("value").alias("v")).alias("descriptor"))
    return rows.select("event_id", filters.descriptor_field(rows, "v").alias("descriptor_value"))


@query("E19_extract_labels", """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75]) AS edges FROM orders),
b AS (SELECT o_orderkey, len(list_filter(edges, lambda e: e <= o_totalprice)) AS bin FROM orders, q),
n AS (SELECT o_orderkey, CASE WHEN bin IN (1, 2) THEN 'low' WHEN bin = 4 THEN 'top' ELSE CAST(bin AS VARCHAR) END AS text_label FROM b),
c AS (SELECT text_label, CAST(row_number() OVER (ORDER BY text_label) - 1 AS INTEGER) AS class_id FROM (SELECT DISTINCT text_label FROM n))
SELECT o_orderkey, text_label, class_id FROM n JOIN c USING (text_label)""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return labels.extract_labels(rows, "o_totalprice", False, "quantiles", 4, {"low": ["1", "2"], "top": ["4"]}).select(
        "o_orderkey", "text_label", "class_id")


@query("E18_merge_labels", """
WITH c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS class_id FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, p_retailprice, p_type AS text_label, class_id, CAST(1.0 AS DOUBLE) AS hot, CAST(1.0 AS DOUBLE) AS hot_sum FROM part JOIN c USING (p_type)""")
def _(spark, d):
    part = table(spark, d, "part")
    out = labels.merge_labels(part.select("p_partkey", "p_retailprice"), part, "p_partkey", "p_type", one_hot_labels=True)
    hot = F.col("one_hot")
    return out.select("p_partkey", "p_retailprice", "text_label", long("class_id").alias("class_id"),
                      hot[F.col("class_id")].alias("hot"), F.aggregate(hot, F.lit(0.0), lambda a, v: a + v).alias("hot_sum"))


# --- filters and sets --------------------------------------------------------

@query("P2_descriptor_check", "SELECT 'spectrum' AS descriptor_name, count(*) AS n FROM events")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("descriptor_name", F.lit("spectrum"))
    name = filters.check_descriptor(rows, "spectrum")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("descriptor_name"), "n")


def _symmetry():
    return F.create_map(F.lit("0.1"), F.col("l_returnflag"), F.lit("0.01"),
                        F.when(F.col("l_linestatus") == "O", F.lit("N")).otherwise(F.col("l_returnflag")))


@query("P5_symmetry_filter", """
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem
WHERE l_returnflag IN ('N', 'R') AND (l_linestatus <> 'O' OR l_returnflag = 'N')""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("spacegroup", _symmetry())
    return filters.filter_by_symmetry(rows, {"spacegroup": ["N", "R"]}).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("P5_symmetry_report", """
SELECT l_returnflag AS value, count(*) AS n FROM lineitem
WHERE l_returnflag IN ('N', 'R') AND (l_linestatus <> 'O' OR l_returnflag = 'N') GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("spacegroup", _symmetry())
    return filters.symmetry_report(filters.filter_by_symmetry(rows, {"spacegroup": ["N", "R"]}), "spacegroup")


@query("P6_allowed_species", """
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return filters.keep_allowed_species(rows, ["A", "N"], "l_orderkey", "l_returnflag")


@query("P7_duplicates", """
SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents""")
def _(spark, d):
    return filters.split_duplicates(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select(
        "doc_id", "is_duplicate")


@query("P8_rare_species", """
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM
 (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS k FROM lineitem) WHERE k >= 2""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return filters.drop_rare_species(rows, 2, "l_orderkey", "l_returnflag")


_THIN = "n AS (SELECT l_orderkey, count(*) AS n_atoms, sum(l_quantity) AS q FROM lineitem GROUP BY 1)"


def _order_vectors(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_atoms"), F.array(F.sum("l_quantity")).alias("vec"))


@query("P9_nan_if_thin", f"""
WITH {_THIN} SELECT l_orderkey, n_atoms, n_atoms <= 2 AS is_nan, CASE WHEN n_atoms > 2 THEN q END AS value FROM n""")
def _(spark, d):
    nans = filters.nan_if_thin(F.col("vec"), F.col("n_atoms"), 2)[0]
    return _order_vectors(spark, d).select("l_orderkey", "n_atoms", F.isnan(nans).alias("is_nan"),
                                           F.when(~F.isnan(nans), nans).alias("value"))


@query("P10_zero_if_thin", f"WITH {_THIN} SELECT l_orderkey, n_atoms, CASE WHEN n_atoms < 3 THEN 0.0 ELSE q END AS value FROM n")
def _(spark, d):
    return _order_vectors(spark, d).select("l_orderkey", "n_atoms", filters.zero_if_thin(
        F.col("vec"), F.col("n_atoms"), 3, 1)[0].alias("value"))


@query("P11_structure_atoms", f"WITH {POINTS} SELECT atom_id, x, y, z FROM points WHERE structure_id = '1'")
def _(spark, d):
    return filters.select_structure_atoms(points(spark, d), "1", ["structure_id", "number", "symbol"])


@query("P12_two_class_geometry", """
SELECT vec_id, CAST(CASE WHEN abs(embedding[1]) * 4 < 0.375 AND abs(embedding[2]) * 4 < 0.375 AND abs(embedding[3]) * 4 < 0.375
  THEN 0 ELSE 1 END AS BIGINT) AS label FROM embeddings""")
def _(spark, d):
    frac = F.transform(F.slice("embedding", 1, 3), lambda v: F.abs(v) * 4)
    return table(spark, d, "embeddings").select("vec_id", long(filters.rocksalt_or_zincblende(frac)).alias("label"))


@query("P16_missing_values", """
SELECT 'quality' AS column_name, count(*) FILTER (WHERE quality IS NULL) AS n_missing, count(*) FILTER (WHERE quality IS NULL) > 0 AS has_missing
FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL), count(*) FILTER (WHERE n_chars IS NULL) > 0 FROM documents""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return filters.missing_value_report(rows, ["quality", "n_chars"])


@query("P17_designed_classes", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O')) AND CAST(l_tax AS VARCHAR) IN ('0.01', '0.02', '0.04')""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("defect", F.col("l_tax").cast("string"))
    allowed = spark.createDataFrame([("A", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return filters.designed_classes(rows, allowed, ["l_returnflag", "l_linestatus"], ["0.01", "0.02", "0.04"]).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("P18_blank_names", 'SELECT p_partkey, p_type AS crystal_structure_type FROM part')
def _(spark, d):
    return filters.without_blank_names(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("crystal structure type")))


@query("P19_key_from_file_name", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS key FROM part")
def _(spark, d):
    name = F.concat(F.lit("run_a_b_spgroup"), F.col("p_size"), F.lit(".x_1_2_3_end.tar"))
    return table(spark, d, "part").select("p_partkey", filters.key_from_file_name(name).alias("key"))


@query("S11_grouped_files", """
SELECT CAST(p_size AS VARCHAR) AS key, count(*) AS n_files FROM part WHERE p_size IN (1, 7, 20) GROUP BY 1""")
def _(spark, d):
    from latticeloom.sources.readers import count_per_key, group_files

    files = table(spark, d, "part").select(F.concat(
        F.lit("run_a_b_spgroup"), F.col("p_size"), F.lit(".x_1_2_"), F.col("p_partkey"), F.lit("_end.tar")).alias("path"))
    return count_per_key(group_files(files, filters.key_from_file_name(F.col("path"))).where(F.col("key").isin("1", "7", "20")))


@query("K4_manifest", """
SELECT CASE WHEN p_size % 2 = 0 THEN 'desc_files' ELSE 'target_files' END AS file_type,
  p_partkey || CASE WHEN p_size % 2 = 0 THEN '_desc.json' ELSE '_target.json' END AS path FROM part""")
def _(spark, d):
    from latticeloom.sources.writers import file_manifest

    return file_manifest(table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.when(
        F.col("p_size") % 2 == 0, "_desc.json").otherwise("_target.json")).alias("path")))


@query("U3_row_difference", """
SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, d):
    return filters.row_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("key")),
                                  table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")))


@query("U4_distinct_members", "SELECT DISTINCT p_brand FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().orderBy("p_brand")


@query("U5_required_keys", """
SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS complete FROM events""")
def _(spark, d):
    record = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", filters.has_required_keys(record, ["k"]).alias("complete"))


@query("U6_stamped_union", """
SELECT 'customer' AS target, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def _(spark, d):
    parts = {"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v")),
             "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("v"))}
    return labels.class_populations(filters.stamped_union(parts), "target")


# --- features ----------------------------------------------------------------

@query("J5_element_properties", """
SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice, CAST(p_size AS DOUBLE) AS p_size
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def _(spark, d):
    atoms = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    elements = table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    return features.element_properties(atoms, elements, ["p_retailprice", "p_size"], "l_partkey")


@query("J1_choose_features", """
SELECT n_nationkey AS "Mat", c.bal AS atomic, s.bal AS binary_, round(abs(c.bal + s.bal - c.n + s.n), 4) + 0.0 AS r_sigma FROM nation
JOIN (SELECT c_nationkey, round(avg(c_acctbal), 2) AS bal, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
JOIN (SELECT s_nationkey, round(avg(s_acctbal), 2) AS bal, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def _(spark, d):
    side = lambda t, p: table(spark, d, t).groupBy(F.col(f"{p}_nationkey").alias("Mat")).agg(
        F.round(F.avg(f"{p}_acctbal"), 2).alias(f"{p}_bal"), F.count(F.lit(1)).alias(f"{p}_n"))
    atomic = side("customer", "c").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("Mat")), "Mat")
    out = features.choose_features(atomic, side("supplier", "s"), ["c_bal", "s_bal", "r_sigma"], {
        "r_sigma": algebra.r_sigma(F.col("c_bal"), F.col("s_bal"), F.col("c_n"), F.col("s_n"))})
    return out.select("Mat", F.col("c_bal").alias("atomic"), F.col("s_bal").alias("binary_"), rounded("r_sigma", 4).alias("r_sigma"))


@query("E1_atomic_feature_table", """
WITH el AS (SELECT l_linestatus AS s, avg(l_quantity) AS q, avg(l_extendedprice) AS e FROM lineitem GROUP BY 1),
sp AS (SELECT DISTINCT l_orderkey, l_linestatus AS s FROM lineitem),
r AS (SELECT l_orderkey, s, q, e, row_number() OVER (PARTITION BY l_orderkey ORDER BY e, s) AS lo,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY e DESC, s DESC) AS hi FROM sp JOIN el USING (s))
SELECT a.l_orderkey, a.s || b.s AS ordered_chemical_symbols, round(a.q, 4) AS "q(A)", round(a.e, 2) AS "e(A)",
  round(b.q, 4) AS "q(B)", round(b.e, 2) AS "e(B)"
FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.lo = 1 AND b.hi = 1""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    elements = li.groupBy("l_linestatus").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"))
    out = features.atomic_feature_table(li, elements, ["q", "e"], "e", "l_linestatus", "l_orderkey")
    return out.select("l_orderkey", "ordered_chemical_symbols", *[
        rounded(F.col(f"`{c}({s})`"), n).alias(f"{c}({s})") for s in "AB" for c, n in (("q", 4), ("e", 2))])


_FORMULA_ATOMS = """atoms AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'H' ELSE 'Ag' END AS symbol FROM lineitem)"""


def _formula_atoms(spark, d):
    symbol = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "N", "H").otherwise("Ag")
    return table(spark, d, "lineitem").select("l_orderkey", symbol.alias("symbol"))


@query("A20_binary_formula", f"""
WITH {_FORMULA_ATOMS}, u AS (SELECT DISTINCT l_orderkey, symbol, CASE symbol WHEN 'C' THEN 0 WHEN 'H' THEN 1 ELSE 2 END AS o FROM atoms)
SELECT l_orderkey, string_agg(symbol, '' ORDER BY o, symbol) || CASE WHEN count(*) = 1 THEN '2' ELSE '' END AS formula FROM u GROUP BY 1""")
def _(spark, d):
    return features.binary_formula(_formula_atoms(spark, d), structure="l_orderkey")


@query("A21_hill_formula", f"""
WITH {_FORMULA_ATOMS}, c AS (SELECT l_orderkey, symbol, count(*) AS n FROM atoms GROUP BY ALL),
o AS (SELECT *, CASE WHEN bool_or(symbol = 'C') OVER (PARTITION BY l_orderkey) AND symbol = 'C' THEN 0
  WHEN bool_or(symbol = 'C') OVER (PARTITION BY l_orderkey) AND symbol = 'H' THEN 1 ELSE 2 END AS o FROM c)
SELECT l_orderkey, string_agg(symbol || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY o, symbol) AS formula FROM o GROUP BY 1""")
def _(spark, d):
    return features.hill_formula(_formula_atoms(spark, d), structure="l_orderkey")


@query("A22_collection_species", f"""
WITH {POINTS} SELECT symbol, number, count(*) AS n_atoms FROM points GROUP BY ALL""")
def _(spark, d):
    return features.collection_species(points(spark, d))


@query("A22_collection_summary", f"""
WITH {POINTS} SELECT CAST(max(number) AS BIGINT) AS largest_number, count(DISTINCT symbol) AS n_species FROM points""")
def _(spark, d):
    return features.collection_summary(points(spark, d)).withColumn("largest_number", long("largest_number"))


@query("J14_species_pairs", f"""
WITH {POINTS}, c AS (SELECT structure_id, number, count(*) AS n FROM points GROUP BY ALL)
SELECT a.structure_id, a.number AS z1, b.number AS z2, NOT (a.number = b.number AND a.n = 1) AS usable
FROM c a JOIN c b USING (structure_id)""")
def _(spark, d):
    return features.species_pairs(points(spark, d), periodic=False)


@query("J14_mean_over_pairs", f"""
WITH {POINTS}, c AS (SELECT structure_id, number, count(*) AS n, sum(x) AS sx FROM points GROUP BY ALL)
SELECT a.structure_id, round(sum(CASE WHEN NOT (a.number = b.number AND a.n = 1) THEN a.sx * b.sx ELSE 0 END) / count(*), 6) + 0.0 AS value
FROM c a JOIN c b USING (structure_id) GROUP BY 1""")
def _(spark, d):
    p = points(spark, d)
    pairs = features.species_pairs(p, periodic=False)
    s = p.groupBy("structure_id", "number").agg(F.sum("x").alias("sx"))
    values = pairs.join(s.withColumnsRenamed({"number": "z1", "sx": "s1"}), ["structure_id", "z1"]).join(
        s.withColumnsRenamed({"number": "z2", "sx": "s2"}), ["structure_id", "z2"]).select(
        "structure_id", "z1", "z2", F.lit(0).alias("idx"), (F.col("s1") * F.col("s2")).alias("value"))
    return features.mean_over_pairs(pairs, values).select("structure_id", rounded("value").alias("value"))


_PARTS = "f AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS u, p_retailprice / 1000 AS v, (p_partkey % 7 + 1) / 7.0 AS w FROM part)"


def _part_features(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("double") / 50).alias("u"),
                                          (F.col("p_retailprice") / 1000).alias("v"), ((F.col("p_partkey") % 7 + 1) / 7.0).alias("w"))


@query("E2_combined_features", f"""
WITH {_PARTS} SELECT p_partkey, feature, round(value, 6) + 0.0 AS value FROM (
  SELECT p_partkey, unnest(['u', 'v', 'w', '(v+w)', 'v^2', 'w^2', 'exp(v)', 'exp(w)', 'exp(v^2)', 'exp(w^2)', '(v+w)^2', 'exp((v+w)^2)', 'exp(v+w)']) AS feature,
   unnest([u, v, w, v + w, v * v, w * w, exp(v), exp(w), exp(v * v), exp(w * w), (v + w) * (v + w), exp((v + w) * (v + w)), exp(v + w)]) AS value FROM f
  UNION ALL
  SELECT p_partkey, n.name || '/' || m.name, n.value / m.value FROM (
   SELECT p_partkey, unnest(['u', 'v', 'w', '(v+w)']) AS name, unnest([u, v, w, v + w]) AS value FROM f) n JOIN (
   SELECT p_partkey, unnest(['v^2', 'w^2', 'exp(v)', 'exp(w)', 'exp(v^2)', 'exp(w^2)', '(v+w)^2', 'exp((v+w)^2)', 'exp(v+w)']) AS name,
   unnest([v * v, w * w, exp(v), exp(w), exp(v * v), exp(w * w), (v + w) * (v + w), exp((v + w) * (v + w)), exp(v + w)]) AS value FROM f) m USING (p_partkey))""")
def _(spark, d):
    space = features.feature_space({"u": "a1", "v": "a3", "w": "a3"}, ["+", "/", "^2", "exp"])
    return features.combine_features_long(_part_features(spark, d), "p_partkey", space).withColumn("value", rounded("value"))


@query("E2_zero_order_features", f"""
WITH {_PARTS} SELECT p_partkey, u, v, round(u + v, 10) + 0.0 AS "(u+v)", round(u - v, 10) + 0.0 AS "(u-v)", round(v - u, 10) + 0.0 AS "(v-u)",
 round(abs(u + v), 10) + 0.0 AS "|u+v|", round(abs(u - v), 10) + 0.0 AS "|u-v|", round(u / v, 10) + 0.0 AS "u/v", round(v / u, 10) + 0.0 AS "v/u",
 round(u * u, 10) AS "u^2", round(v * v, 10) AS "v^2", round(u * u * u, 10) AS "u^3", round(v * v * v, 10) AS "v^3", round(exp(u), 10) AS "exp(u)", round(exp(v), 10) AS "exp(v)" FROM f""")
def _(spark, d):
    space = features.feature_space({"u": "a0", "v": "a0"}, ["+", "-", "|+|", "|-|", "/", "^2", "^3", "exp"])
    wide = features.combine_features(_part_features(spark, d), "p_partkey", space)
    return wide.select("p_partkey", *[F.col(n) if n in "uv" else rounded(F.col(f"`{n}`"), 10).alias(n) for n, _ in space])


@query("M14_feature_algebra", f"""
WITH {_PARTS} SELECT p_partkey, round(u + v, 6) + 0.0 AS s, round(u - v, 6) + 0.0 AS d, round(abs(u + v), 6) + 0.0 AS abs_s,
 round(abs(u - v), 6) + 0.0 AS abs_d, round(u / v, 6) + 0.0 AS q FROM f""")
def _(spark, d):
    u, v = F.col("u"), F.col("v")
    return _part_features(spark, d).select("p_partkey", *[rounded(algebra.BINARY[op](u, v)).alias(n) for op, n in (
        ("+", "s"), ("-", "d"), ("|+|", "abs_s"), ("|-|", "abs_d"), ("/", "q"))])


@query("M15_unary_algebra", f"""
WITH {_PARTS} SELECT p_partkey, round(v * v, 6) AS p2, round(v * v * v, 6) AS p3, round(1 / v, 6) AS m1, round(1 / (v * v), 6) AS m2,
 round(1 / (v * v * v), 6) AS m3, round(sqrt(abs(v)), 6) AS root, round(exp(v), 6) AS e, round(exp(v * v), 6) AS e2, round(exp(v * v * v), 6) AS e3 FROM f""")
def _(spark, d):
    names = {"^2": "p2", "^3": "p3", "^-1": "m1", "^-2": "m2", "^-3": "m3", "sqrt": "root", "exp": "e", "exp^2": "e2", "exp^3": "e3"}
    return _part_features(spark, d).select("p_partkey", *[
        rounded(algebra.UNARY[op](F.col("v"))).alias(n) for op, n in names.items()])


@query("M16_composite_algebra", f"""
WITH {_PARTS} SELECT p_partkey, round((u + w) * (u + w), 6) AS p2, round((u + w) * (u + w) * (u + w), 6) AS p3, round(exp(u + w), 6) AS e,
 round(exp((u + w) * (u + w)), 5) AS e2, round(exp((u + w) * (u + w) * (u + w)), 3) AS e3 FROM f""")
def _(spark, d):
    names = {"^2": ("p2", 6), "^3": ("p3", 6), "exp": ("e", 6), "exp^2": ("e2", 5), "exp^3": ("e3", 3)}
    return _part_features(spark, d).select("p_partkey", *[
        rounded(algebra.SUM_COMPOSITES[op](F.col("u"), F.col("w")), k).alias(n) for op, (n, k) in names.items()])


@query("M17_radius_combinations", f"""
WITH {_PARTS} SELECT p_partkey, round(abs(u + v - w + u), 6) + 0.0 AS r_sigma, round(abs(u - v) + abs(w - u), 6) + 0.0 AS r_pi FROM f""")
def _(spark, d):
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    return _part_features(spark, d).select("p_partkey", rounded(algebra.r_sigma(u, v, w, u)).alias("r_sigma"),
                                           rounded(algebra.r_pi(u, v, w, u)).alias("r_pi"))


@query("M18_energy_per_root_valence", """
SELECT p_partkey, round(p_retailprice / sqrt(CAST(p_size AS DOUBLE)), 6) AS value FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", rounded(
        algebra.energy_per_root_valence(F.col("p_retailprice"), F.col("p_size").cast("double"))).alias("value"))


@query("M19_unit_conversion", """
SELECT p_partkey, p_retailprice * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1e-3 ELSE 1e-10 END / 1e-9 AS raw,
  round(p_retailprice * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1e-3 ELSE 1e-10 END / 0.01, 6) AS centimeters FROM part"""
       .replace("p_retailprice * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1e-3 ELSE 1e-10 END / 1e-9 AS raw,",
                "CASE p_size % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'mm' ELSE 'angstrom' END AS unit,"))
def _(spark, d):
    unit = F.array(F.lit("m"), F.lit("mm"), F.lit("angstrom"))[F.col("p_size") % 3]
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice", unit.alias("unit"), F.lit("centimeter").alias("target"))
    out = units.convert_by_row(rows, units.units_frame(spark), "p_retailprice", "unit", "target")
    return out.select("p_partkey", "unit", rounded("converted").alias("centimeters"))


@query("M20_energy_substance_rule", """
SELECT p_partkey, round(p_retailprice * 1.60217653e-19 * 6.02214129e23 / 1000, 2) AS kj_mol, round(p_retailprice * 1e10, 0) AS angstrom,
 p_retailprice AS unchanged FROM part""")
def _(spark, d):
    v = F.col("p_retailprice")
    rule = units.convert_energy_or_length
    return table(spark, d, "part").select(
        "p_partkey", rounded(rule(v, "eV", "kJ/mol", "angstrom"), 2).alias("kj_mol"),
        rounded(rule(v, "m", "eV", "angstrom"), 0).alias("angstrom"), rule(v, "s", "eV", "angstrom").alias("unchanged"))


@query("M21_scale_factor_by_unit", """
SELECT p_partkey, round(p_retailprice / 1.60217653e-19 * 1e-19, 4) AS energy, round(p_retailprice * 10, 4) AS length, CAST(p_size AS DOUBLE) AS other FROM part""")
def _(spark, d):
    f = features.unit_factors(["ip(A)", "rs(B)", "group(A)"], {"ip": "J", "rs": "m"},
                              units.conversion_factor("J", "eV") * 1e-19, units.conversion_factor("nm", "angstrom"))
    part = table(spark, d, "part")
    return part.select("p_partkey", rounded(F.col("p_retailprice") * f["ip(A)"], 4).alias("energy"),
                       rounded(F.col("p_retailprice") * f["rs(B)"], 4).alias("length"),
                       (F.col("p_size") * F.lit(f["group(A)"])).alias("other"))


@query("M22_scientific_format", "SELECT p_partkey, upper(printf('%.3e', p_retailprice)) AS text, p_brand AS other FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", algebra.scientific(F.col("p_retailprice")).alias("text"),
                                          algebra.scientific(F.col("p_brand")).alias("other"))


@query("M23_interpolation", """
SELECT p_partkey, i, round(p_size + (p_retailprice - p_size) * i / 5.0, 6) AS value FROM part, range(6) t(i)""")
def _(spark, d):
    steps = algebra.interpolated([F.col("p_size").cast("double")], [F.col("p_retailprice")], 5)
    return table(spark, d, "part").select("p_partkey", F.explode(steps).alias("_s")).select(
        "p_partkey", long("_s.i").alias("i"), rounded(F.col("_s.values")[0]).alias("value"))


@query("M31_transition_path", """
SELECT CAST(o_orderkey AS BIGINT) AS segment, i, round((o_totalprice + (o_custkey - o_totalprice) * i / (o_orderkey % 3 + 1)) * 0.5, 4) + 0.0 AS value
FROM orders, range(4) t(i) WHERE i <= (o_orderkey % 3 + 1) - CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 0 ELSE 1 END""")
def _(spark, d):
    orders = table(spark, d, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    segments = orders.select(F.col("o_orderkey").alias("segment"), F.col("o_totalprice").alias("p0"), F.col("o_custkey").alias("p1"),
                             (F.col("o_orderkey") % 3 + 1).alias("n"), (F.col("o_orderkey") == last).alias("is_last"))
    return st.transition_path(segments, 0.5).select("segment", long("i").alias("i"), rounded("value", 4).alias("value"))


@query("J13_parameter_grid", """
SELECT p_partkey, a, c_a, 'A3_' || a || '_' || c_a || '_' || p_brand || '.aims' AS file_name
FROM part, (SELECT unnest([3.5, 4.0]::DOUBLE[]) AS a), (SELECT unnest([1.5, 1.6, 1.7]::DOUBLE[]) AS c_a)""")
def _(spark, d):
    base = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("element"))
    return st.parameter_grid(base, F.lit("A3"), {"a": [3.5, 4.0], "c_a": [1.5, 1.6, 1.7]}).select("p_partkey", "a", "c_a", "file_name")


@query("J19_order_parameter_sweep", """
SELECT CAST(label AS VARCHAR) AS structure_id, step, sample, round(step * 0.5 / 103, 6) AS ratio, step * 2 + sample AS seed
FROM (SELECT DISTINCT label FROM embeddings), range(104) t(step), range(2) u(sample)""")
def _(spark, d):
    s = points(spark, d).select("structure_id").distinct()
    return st.order_parameter_sweep(s, samples=2).select(
        "structure_id", long("step").alias("step"), long("sample").alias("sample"), rounded("ratio").alias("ratio"), long("seed").alias("seed"))


@query("E22_class_maps", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Pm-3m'
  WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'P4/mmm' END AS symmetry FROM lineitem""")
def _(spark, d):
    from latticeloom.distributed import lookup_join

    maps = spark.createDataFrame([("A", "F", "Pm-3m"), ("N", "O", "P4/mmm")], "l_returnflag string, l_linestatus string, symmetry string")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return lookup_join(rows, maps, ["l_returnflag", "l_linestatus"], "left").drop("l_returnflag", "l_linestatus")


@query("E20_feature_records", """
SELECT p_partkey, json_extract_string(doc, '$.p_type') AS p_type, CAST(json_extract(doc, '$.energy') AS DOUBLE) AS energy FROM (
 SELECT p_partkey, json_object('p_type', p_type, 'energy', p_retailprice) AS doc FROM part)""")
def _(spark, d):
    doc = F.to_json(F.struct("p_type", F.col("p_retailprice").alias("energy")))
    record = table(spark, d, "part").select("p_partkey", doc.alias("doc"))
    return record.select("p_partkey", F.get_json_object("doc", "$.p_type").alias("p_type"),
                         F.get_json_object("doc", "$.energy").cast("double").alias("energy"))


# --- predictions -------------------------------------------------------------

_MEAN = "m AS (SELECT id, class_id, avg(p) AS mp FROM samples GROUP BY ALL)"


@query("A11_predictive_mean", f"WITH {SAMPLES}, {_MEAN} SELECT id, class_id, round(mp, 6) AS mean_p FROM m")
def _(spark, d):
    long_form = samples(spark, d).select("id", "sample", F.posexplode("probs").alias("class_id", "p"))
    return uncertainty.predictive_mean(long_form).select("id", long("class_id").alias("class_id"), rounded("mean_p").alias("mean_p"))


@query("A12_committee_uncertainty", f"""
WITH {SAMPLES}, {_MEAN}, w AS (SELECT id, sample, arg_max(class_id, p) AS c FROM samples GROUP BY ALL),
v AS (SELECT id, max(n) AS mode FROM (SELECT id, c, count(*) AS n FROM w GROUP BY ALL) GROUP BY id),
h AS (SELECT id, -sum(greatest(mp, 1e-12) * log2(greatest(mp, 1e-12))) AS h FROM m GROUP BY id),
s AS (SELECT id, sum(greatest(p, 1e-12) * log2(greatest(p, 1e-12))) / 16 AS s FROM samples GROUP BY id)
SELECT id, CAST(16 AS BIGINT) AS n_samples, round(1 - mode / 16.0, 6) AS variation_ratio, round(h, 6) AS predictive_entropy,
  round(h + s, 6) + 0.0 AS mutual_information FROM v JOIN h USING (id) JOIN s USING (id)""")
def _(spark, d):
    out = uncertainty.committee_uncertainty(samples(spark, d), 4)
    return out.select("id", "n_samples", *[rounded(c).alias(c) for c in ("variation_ratio", "predictive_entropy", "mutual_information")])


@query("A15_predictive_variance", """
SELECT l_partkey, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 4) AS variance FROM lineitem GROUP BY 1""")
def _(spark, d):
    out = uncertainty.predictive_variance(table(spark, d, "lineitem"), "l_partkey", "l_quantity")
    return out.select("l_partkey", rounded("mean").alias("mean"), rounded("variance", 4).alias("variance"))


@query("Q1_top_classes", f"""
WITH {SAMPLES}, {_MEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mp DESC, class_id) AS rank FROM m)
SELECT id, rank, 'class-' || class_id AS class_name, round(mp, 6) AS p FROM r WHERE rank <= 3""")
def _(spark, d):
    mean = uncertainty.committee_uncertainty(samples(spark, d), 4).select("id", "mean_probs")
    names = spark.range(4).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("class-"), "id").alias("class_name"))
    return uncertainty.top_classes(mean, "mean_probs", 3, names).select("id", long("rank").alias("rank"), "class_name", rounded("p").alias("p"))


@query("Q3_argmax_class", """
SELECT vec_id AS id, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS BIGINT) AS target_pred_class FROM embeddings""")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 10).alias("p"))
    return uncertainty.predicted_class(rows, "p").select("id", long("target_pred_class").alias("target_pred_class"))


_PRED = "pred AS (SELECT vec_id, label, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS p1, CAST(list_position(embedding[11:20], list_max(embedding[11:20])) - 1 AS INTEGER) AS p2, CAST(list_position(embedding[21:30], list_max(embedding[21:30])) - 1 AS INTEGER) AS p3 FROM embeddings)"


def _predictions(spark, d):
    from latticeloom.functions.vectors import argmax

    return table(spark, d, "embeddings").select("vec_id", "label", *[
        argmax(F.slice("embedding", 1 + 10 * k, 10)).alias(f"p{k + 1}") for k in range(3)])


@query("A7_confusion_matrix", f"""
WITH {_PRED}, c AS (SELECT label, p1, count(*) AS n FROM pred GROUP BY ALL)
SELECT label, p1, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM c""")
def _(spark, d):
    return uncertainty.confusion_matrix(_predictions(spark, d), "label", "p1", True).withColumn("share", rounded("share"))


@query("A7_confusion_pivot", f"""
WITH {_PRED} SELECT label, {', '.join(f'count(*) FILTER (WHERE p1 = {c}) AS pred_{c}' for c in range(10))} FROM pred GROUP BY label""")
def _(spark, d):
    return uncertainty.confusion_pivot(_predictions(spark, d), "label", "p1", list(range(10)))


@query("A8_accuracy_by_configuration", f"""
WITH {_PRED} SELECT unnest(['a', 'b', 'c']) AS configuration, unnest([round(avg(CAST(label = p1 AS INTEGER)), 6),
 round(avg(CAST(label = p2 AS INTEGER)), 6), round(avg(CAST(label = p3 AS INTEGER)), 6)]) AS accuracy FROM pred""")
def _(spark, d):
    return uncertainty.accuracy_by_configuration(_predictions(spark, d), {
        "a": ("label", "p1"), "b": ("label", "p2"), "c": ("label", "p3")}).withColumn("accuracy", rounded("accuracy"))


@query("A8_correctly_identified", f"WITH {_PRED} SELECT vec_id, label FROM pred WHERE label = p2")
def _(spark, d):
    return uncertainty.correctly_identified(_predictions(spark, d), "label", "p2").select("vec_id", "label")


@query("A8_cross_counts", f"WITH {_PRED} SELECT label, p3, count(*) AS n FROM pred GROUP BY ALL")
def _(spark, d):
    return uncertainty.cross_counts(_predictions(spark, d), "label", "p3")


@query("A9_benchmark_accuracy", """
WITH r AS (SELECT l_returnflag AS method, l_linestatus AS defect, CAST(l_quantity AS BIGINT) % 3 AS truth,
  CAST(round(l_tax * 100) AS BIGINT) % 3 AS pred FROM lineitem)
SELECT method, defect, round(avg(CAST(truth = pred AS INTEGER)), 4) AS accuracy_all,
  round(avg(CAST(truth = pred AS INTEGER)) FILTER (WHERE truth <> 0), 4) AS accuracy_designed FROM r GROUP BY ALL""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("defect"), (F.col("l_quantity").cast("long") % 3).alias("truth"),
        (F.round(F.col("l_tax") * 100).cast("long") % 3).alias("pred"))
    return uncertainty.benchmark_accuracy(rows, "method", "defect", "truth", "pred", F.col("truth") != 0)


@query("A10_transition_aggregate", """
WITH n AS (SELECT count(*) AS total, count(*) % 10 AS cut, CAST(floor(count(*) / 10) AS BIGINT) AS k FROM events),
r AS (SELECT value, user_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
b AS (SELECT value, user_id, CAST(floor((i - cut) / k) AS BIGINT) AS step FROM r, n WHERE i >= cut)
SELECT step, round(step * 0.5 / 9, 6) AS a_to_b_index, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std,
  round(avg(user_id), 6) AS user_id_mean, round(stddev_samp(user_id), 6) AS user_id_std FROM b GROUP BY step""")
def _(spark, d):
    ev = table(spark, d, "events")
    n = ev.count()
    out = uncertainty.transition_aggregate(ev, "event_id", ["value", "user_id"], n // 10, 10, 0.0, 0.5, n % 10)
    return out.select("step", *[rounded(c).alias(c) for c in ("a_to_b_index", "value_mean", "value_std", "user_id_mean", "user_id_std")])


@query("J3_joined_aggregates", """
SELECT l_linenumber, round(avg(l_discount), 6) AS p_mean, round(avg(l_tax), 6) AS u_mean FROM lineitem GROUP BY 1""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    p = li.groupBy("l_linenumber").agg(rounded(F.avg("l_discount")).alias("p_mean"))
    u = li.groupBy("l_linenumber").agg(rounded(F.avg("l_tax")).alias("u_mean"))
    return p.join(u, "l_linenumber")


@query("J4_positions_with_predictions", f"""
WITH {POINTS}, {SAMPLES}, {_MEAN} SELECT atom_id, x, y, z, class_id, round(mp, 6) AS p FROM points JOIN m ON m.id = atom_id""")
def _(spark, d):
    mean = uncertainty.committee_uncertainty(samples(spark, d), 4).select(
        F.col("id").alias("atom_id"), F.posexplode("mean_probs").alias("class_id", "p"))
    return points(spark, d).select("atom_id", "x", "y", "z").join(mean, "atom_id").withColumn("p", rounded("p")).withColumn(
        "class_id", long("class_id"))


@query("K7_result_table", f"""
WITH {SAMPLES}, {_MEAN}, w AS (SELECT id, max(mp) FILTER (WHERE class_id = 0) AS c0, max(mp) FILTER (WHERE class_id = 1) AS c1,
 max(mp) FILTER (WHERE class_id = 2) AS c2, max(mp) FILTER (WHERE class_id = 3) AS c3, arg_max(class_id, mp) AS best,
 -sum(mp * log2(mp)) AS h FROM m GROUP BY id)
SELECT id, best AS target_pred_class, round(c0, 6) AS prob_predictions_0, round(c1, 6) AS prob_predictions_1, round(c2, 6) AS prob_predictions_2,
 round(c3, 6) AS prob_predictions_3, CAST(label AS BIGINT) AS num_labels, 'class-' || label AS class_labels, round(h, 6) AS uncertainty_predictive_entropy
FROM w JOIN embeddings ON vec_id = id""")
def _(spark, d):
    scored = uncertainty.committee_uncertainty(samples(spark, d), 4).join(
        table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").withColumn(
        "text", F.concat(F.lit("class-"), "label"))
    out = uncertainty.result_table(scored, "mean_probs", 4, "label", "text", {"predictive_entropy": "predictive_entropy"}, "id")
    return out.select("id", long("target_pred_class").alias("target_pred_class"), long("num_labels").alias("num_labels"), "class_labels", *[
        rounded(c).alias(c) for c in out.columns if c.startswith(("prob", "unc"))])


@query("M24_probability_text", f"""
WITH {SAMPLES}, {_MEAN} SELECT id, string_agg('p' || class_id || ':' || printf('%.4f', mp) || ' ', '' ORDER BY class_id) AS text FROM m GROUP BY id""")
def _(spark, d):
    from latticeloom.functions.vectors import format_probabilities

    return uncertainty.committee_uncertainty(samples(spark, d), 4).select("id", format_probabilities(F.col("mean_probs")).alias("text"))


@query("A23_top_filters", """
WITH a AS (SELECT vec_id AS img, CAST(floor((i - 1) / 8) AS BIGINT) AS filter, sum(CAST(embedding[i] AS DOUBLE)) AS score
           FROM embeddings, range(1, 65) t(i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, filter) AS rank FROM a)
SELECT img, filter, rank, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 3""")
def _(spark, d):
    act = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")) \
        .withColumn("filter", F.floor(F.col("i") / 8))
    return uncertainty.top_filters(act, 3).select("img", "filter", long("rank").alias("rank"), rounded("score").alias("score"))


@query("A24_absolute_error", """
SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_extendedprice - l_quantity * 2000), 4) + 0.0 AS abs_error FROM lineitem""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("pred", F.col("l_quantity") * 2000)
    return uncertainty.absolute_error(rows, "l_extendedprice", "pred").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded("abs_error", 4).alias("abs_error"))
