"""Queries on atoms in space: neighbours, length scales, boxes, transformations, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeloom.functions import algebra
from latticeloom.operators import boxes as B
from latticeloom.operators import boxgrid as G
from latticeloom.operators import features, fields
from latticeloom.operators import neighbors as N
from latticeloom.operators import structures as S
from latticeloom.plans.registry import POINTS, cells, long, points, query, rounded, table
from latticeloom.session import cut_lineage, scratch_path

SHEAR = 0.25
# the unit cell of the periodic queries: (1, 0, 0), (0.25, 1, 0), (0, 0, 1)
_WRAPPED = f"""{POINTS}, frac AS (SELECT *, x - {SHEAR} * y AS fa, y AS fb, z AS fc FROM points),
home AS (SELECT structure_id, atom_id, number, x - floor(fa + 1e-9) - {SHEAR} * floor(fb + 1e-9) AS x, y - floor(fb + 1e-9) AS y, z - floor(fc + 1e-9) AS z FROM frac),
image AS (SELECT h.*, i, j, k, h.x + i + {SHEAR} * j AS tx, h.y + j AS ty, h.z + k AS tz FROM home h, range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k))"""
_PERIODIC = f"""{_WRAPPED}, pairs AS (SELECT h.structure_id, h.atom_id, h.number, t.atom_id AS other_id, t.number AS other_number,
  t.tx - h.x AS dx, t.ty - h.y AS dy, t.tz - h.z AS dz, sqrt(pow(t.tx - h.x, 2) + pow(t.ty - h.y, 2) + pow(t.tz - h.z, 2)) AS r
 FROM home h JOIN image t ON h.structure_id = t.structure_id AND NOT (h.atom_id = t.atom_id AND i = 0 AND j = 0 AND k = 0))"""
_OPEN = f"""{POINTS}, pairs AS (SELECT a.structure_id, a.atom_id, a.number, b.atom_id AS other_id, b.number AS other_number,
  b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS r
 FROM points a JOIN points b ON a.structure_id = b.structure_id AND a.atom_id <> b.atom_id)"""


def _cells(p):
    return cells(p, shear=SHEAR)


# --- neighbours --------------------------------------------------------------

@query("J6_neighbour_list", f"""
WITH {_PERIODIC}, near AS (SELECT *, count(*) OVER (PARTITION BY structure_id, atom_id) AS k FROM pairs WHERE r <= 0.15)
SELECT structure_id, atom_id, other_id, count(*) AS n, round(min(r), 6) AS r FROM near
WHERE number = 1 AND other_number <> 1 AND k >= 2 AND other_number = 2 GROUP BY ALL""")
def _(spark, d):
    p = points(spark, d)
    pairs = N.neighbour_list(p, 0.15, _cells(p), centre_species=1, neighbour_species=2, min_neighbours=2)
    return pairs.groupBy("structure_id", "atom_id", "other_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.min("r")).alias("r"))


@query("J6_open_neighbour_pairs", f"""
WITH {_OPEN} SELECT structure_id, atom_id, other_id, round(r, 6) AS r FROM pairs WHERE r <= 0.12 AND atom_id < other_id""")
def _(spark, d):
    return N.neighbour_pairs(points(spark, d), 0.12, half=True).select("structure_id", "atom_id", "other_id", rounded("r").alias("r"))


_HALF = "half_pairs AS (SELECT structure_id, least(number, other_number) AS z1, greatest(number, other_number) AS z2, r FROM pairs WHERE r <= {0} AND atom_id <= other_id)"


@query("J7_periodic_pairs", f"""
WITH {_PERIODIC}, {_HALF.format(0.3)} SELECT structure_id, z1, z2, count(*) AS n, round(min(r), 6) AS r_min, round(sum(r), 4) AS r_sum FROM half_pairs GROUP BY ALL""")
def _(spark, d):
    p = points(spark, d)
    return N.pair_distances(p, _cells(p), 0.3).groupBy("structure_id", "z1", "z2").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.min("r")).alias("r_min"), rounded(F.sum("r"), 4).alias("r_sum"))


@query("G1_pair_distribution", f"""
WITH {_PERIODIC}, {_HALF.format(0.3)}, n AS (SELECT structure_id, count(*) AS n FROM points GROUP BY 1)
SELECT structure_id, z1, z2, count(*) AS n, round(sum(1 / (4 * pi() * n.n * r * r)), 4) AS weight FROM half_pairs JOIN n USING (structure_id)
GROUP BY structure_id, z1, z2""")
def _(spark, d):
    p = points(spark, d)
    return N.pair_distances(p, _cells(p), 0.3).groupBy("structure_id", "z1", "z2").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("weight"), 4).alias("weight"))


@query("G1_total_distribution", f"""
WITH {_PERIODIC}, {_HALF.format(0.3)} SELECT structure_id, CAST(0 AS BIGINT) AS z1, count(*) AS n, round(max(r), 6) AS r_max FROM half_pairs GROUP BY structure_id""")
def _(spark, d):
    p = points(spark, d)
    return N.pair_distances(p, _cells(p), 0.3, ignore_species=True).groupBy("structure_id", long("z1").alias("z1")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.max("r")).alias("r_max"))


@query("G2_pair_design_matrix", f"""
WITH {_PERIODIC}, {_HALF.format(0.3)}, e AS (SELECT b, pow(1.25, b / 20.0) - 1 AS lo, pow(1.25, (b + 1) / 20.0) - 1 AS hi FROM range(20) t(b)),
w AS (SELECT structure_id, z1, z2, b, any_value(hi - lo) AS width, sum(1 / (r * r)) AS w FROM half_pairs JOIN e ON r >= lo AND (r < hi OR (b = 19 AND r <= hi)) GROUP BY structure_id, z1, z2, b)
SELECT structure_id, CAST((z2 * 4 + z1) * 20 + b AS BIGINT) AS col, round(w / sum(w) OVER (PARTITION BY structure_id, z1, z2) / width, 6) AS value FROM w""")
def _(spark, d):
    p = points(spark, d)
    top = features.collection_summary(p).first()["largest_number"]
    m = N.pair_design_matrix(N.pair_distances(p, _cells(p), 0.3), top, 20, 1.25)
    return m.select("structure_id", "col", rounded("value").alias("value"))


@query("A22_longest_pair_list", f"""
WITH {_PERIODIC}, {_HALF.format(0.3)} SELECT max(n) AS longest FROM (SELECT count(*) AS n FROM half_pairs GROUP BY structure_id, z1, z2)""")
def _(spark, d):
    p = points(spark, d)
    return features.longest_pair_list(N.pair_distances(p, _cells(p), 0.3))


@query("A27_minimum_distance", f"""
WITH {_OPEN} SELECT structure_id, round(min(r), 6) AS min_distance FROM pairs GROUP BY 1""")
def _(spark, d):
    return N.minimum_distance(points(spark, d)).withColumn("min_distance", rounded("min_distance"))


def _scale_sql(nn: str) -> str:
    """Length scale from a table ``nn(structure_id, r)``; all widths are positive there."""
    return f"""b AS (SELECT structure_id, min(r) AS lo, max(r) AS hi FROM {nn} GROUP BY 1),
g AS (SELECT structure_id, lo, hi, CASE WHEN g0 < bins AND r >= lo + (g0 + 1) * (hi - lo) / bins AND g0 < bins - 1 THEN g0 + 1 WHEN r < lo + g0 * (hi - lo) / bins THEN g0 - 1 ELSE g0 END AS bin
 FROM (SELECT structure_id, r, lo, hi, 100 AS bins, least(CAST(floor((r - lo) / (hi - lo) * 100) AS INTEGER), 99) AS g0 FROM {nn} JOIN b USING (structure_id))),
c AS (SELECT structure_id, bin, lo, hi, count(*) AS n, count(*) / pow(lo + bin * (hi - lo) / 100, 2) AS score FROM g GROUP BY structure_id, bin, lo, hi),
best AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY score DESC, bin) AS rank FROM c)"""


@query("G3_length_scale", f"""
WITH {_OPEN}, nn AS (SELECT structure_id, atom_id, min(r) AS r FROM pairs WHERE r <= 0.4 GROUP BY ALL), {_scale_sql('nn')}
SELECT structure_id, round((2 * lo + (2 * bin + 1) * (hi - lo) / 100) / 2, 6) AS length_scale FROM best WHERE rank = 1""")
def _(spark, d):
    return N.length_scale(points(spark, d), 0.4).withColumn("length_scale", rounded("length_scale"))


@query("G3_periodic_length_scale", f"""
WITH {_PERIODIC}, nn AS (SELECT structure_id, atom_id, min(r) AS r FROM pairs WHERE r <= 0.4 GROUP BY ALL HAVING min(r) > 0.05), {_scale_sql('nn')}
SELECT structure_id, round((2 * lo + (2 * bin + 1) * (hi - lo) / 100) / 2, 6) AS length_scale FROM best WHERE rank = 1""")
def _(spark, d):
    p = points(spark, d)
    return N.length_scale(p, 0.4, structures=_cells(p), drop_below=0.05).withColumn("length_scale", rounded("length_scale"))


@query("G3_top_length_scales", f"""
WITH {_OPEN}, nn AS (SELECT structure_id, atom_id, min(r) AS r FROM pairs WHERE r <= 0.4 GROUP BY ALL), {_scale_sql('nn')}
SELECT structure_id, rank, round((2 * lo + (2 * bin + 1) * (hi - lo) / 100) / 2, 6) AS length_scale FROM best WHERE rank <= 3""")
def _(spark, d):
    return N.top_length_scales(points(spark, d), 0.4).select("structure_id", long("rank").alias("rank"), rounded("length_scale").alias("length_scale"))


@query("G3_average_length_scale", f"""
WITH {_OPEN}, nn AS (SELECT structure_id, atom_id, min(r) AS r, count(*) AS k FROM pairs WHERE r <= 0.4 GROUP BY ALL HAVING count(*) >= 5)
SELECT structure_id, round(avg(r), 6) AS length_scale FROM nn GROUP BY 1""")
def _(spark, d):
    return N.length_scale(points(spark, d), 0.4, "avg_nn", min_neighbours=5).withColumn("length_scale", rounded("length_scale"))


@query("G3_species_length_scale", f"""
WITH {_OPEN}, seen AS (SELECT structure_id, atom_id, min(r) FILTER (WHERE other_number = 2) AS r FROM pairs WHERE r <= 0.4 AND number = 1 GROUP BY ALL)
SELECT structure_id, CASE WHEN count(*) > count(r) THEN NULL ELSE round(avg(r), 6) END AS length_scale FROM seen GROUP BY 1""")
def _(spark, d):
    out = N.length_scale(points(spark, d), 0.4, "avg_nn", centre_species=1, neighbour_species=2)
    return out.withColumn("length_scale", rounded("length_scale"))


_FALLBACK = f"""WITH {_OPEN}, cut AS (SELECT 0 AS i, 0.07 AS c UNION ALL SELECT 1, 0.1 UNION ALL SELECT 2, 0.4),
nn AS (SELECT structure_id, atom_id, min(r) AS r FROM pairs GROUP BY ALL),
s AS (SELECT structure_id, i, avg(r) AS scale FROM nn JOIN cut ON r <= c GROUP BY ALL),
f AS (SELECT structure_id, arg_min(scale, i) AS factor FROM s WHERE scale > 0.072 AND scale < 1500 GROUP BY 1)"""


@query("J16_scale_factors", f"{_FALLBACK} SELECT structure_id, round(factor * 1.5, 6) AS scale_factor FROM f")
def _(spark, d):
    out = N.scale_factors(points(spark, d), [0.07, 0.1, 0.4], "avg_nn", min_scale=0.072, extrinsic=1.5)
    return out.withColumn("scale_factor", rounded("scale_factor"))


@query("V12_scaled_structures", f"""
{_FALLBACK} SELECT atom_id, round(x / factor, 5) + 0.0 AS x, round(y / factor, 5) + 0.0 AS y, round(z / factor, 5) + 0.0 AS z FROM points JOIN f USING (structure_id)""")
def _(spark, d):
    p = points(spark, d)
    out = N.scale_structure(p, N.scale_factors(p, [0.07, 0.1, 0.4], "avg_nn", min_scale=0.072))
    return out.select("atom_id", *[rounded(a, 5).alias(a) for a in "xyz"])


@query("J18_common_neighbours", f"""
WITH {_OPEN}, e AS (SELECT structure_id AS s, atom_id AS a, other_id AS b FROM pairs WHERE r <= 0.2),
c AS (SELECT e.s, e.a, e.b, x.b AS k FROM e JOIN e x ON x.s = e.s AND x.a = e.a JOIN e y ON y.s = e.s AND y.a = e.b AND y.b = x.b WHERE e.a < e.b),
n AS (SELECT s, a, b, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT c.s, c.a, c.b, count(*) AS n FROM c JOIN c d ON c.s = d.s AND c.a = d.a AND c.b = d.b AND c.k < d.k JOIN e ON e.s = c.s AND e.a = c.k AND e.b = d.k GROUP BY ALL)
SELECT e.s AS structure_id, e.a AS atom_id, e.b AS other_id, coalesce(n.n, 0) AS n_common, coalesce(m.n, 0) AS n_bonds
FROM e LEFT JOIN n USING (s, a, b) LEFT JOIN m USING (s, a, b) WHERE e.a < e.b""")
def _(spark, d):
    return N.common_neighbour_signatures(points(spark, d), 0.2)


@query("J18_signature_counts", f"""
WITH {_OPEN}, e AS (SELECT structure_id AS s, atom_id AS a, other_id AS b FROM pairs WHERE r <= 0.18),
c AS (SELECT e.s, e.a, e.b, x.b AS k FROM e JOIN e x ON x.s = e.s AND x.a = e.a JOIN e y ON y.s = e.s AND y.a = e.b AND y.b = x.b),
n AS (SELECT s, a, b, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT c.s, c.a, c.b, count(*) AS n FROM c JOIN c d ON c.s = d.s AND c.a = d.a AND c.b = d.b AND c.k < d.k JOIN e ON e.s = c.s AND e.a = c.k AND e.b = d.k GROUP BY ALL)
SELECT e.s AS structure_id, e.a AS atom_id, coalesce(n.n, 0) AS n_common, coalesce(m.n, 0) AS n_bonds, count(*) AS n
FROM e LEFT JOIN n USING (s, a, b) LEFT JOIN m USING (s, a, b) GROUP BY ALL""")
def _(spark, d):
    return N.signature_counts(N.common_neighbour_signatures(points(spark, d), 0.18))


_RADIAL = "exp(-pow(r - {c}, 2) / (2 * pow(0.15, 2))) * 0.5 * (cos(r * pi() / 0.3) + 1)"


@query("G9_environment_spectrum", f"""
WITH {_OPEN}, n AS (SELECT structure_id, atom_id, dx / r AS ux, dy / r AS uy, dz / r AS uz, {_RADIAL.format(c=0.075)} AS g0, {_RADIAL.format(c=0.225)} AS g1 FROM pairs WHERE r <= 0.3),
t AS (SELECT a.structure_id, a.atom_id, a.g0 AS a0, a.g1 AS a1, b.g0 AS b0, b.g1 AS b1, a.ux * b.ux + a.uy * b.uy + a.uz * b.uz AS c
      FROM n a JOIN n b ON a.structure_id = b.structure_id AND a.atom_id = b.atom_id),
q AS (SELECT structure_id, atom_id, [sum(a0 * b0), sum(a0 * b0 * c), sum(a0 * b0 * (3 * c * c - 1) / 2), sum(a0 * b1), sum(a0 * b1 * c), sum(a0 * b1 * (3 * c * c - 1) / 2),
  sum(a1 * b1), sum(a1 * b1 * c), sum(a1 * b1 * (3 * c * c - 1) / 2)] AS l FROM t GROUP BY structure_id, atom_id),
s AS (SELECT structure_id, unnest(l) AS v, unnest(range(9)) AS component FROM q),
m AS (SELECT structure_id, component, avg(v) AS v FROM s GROUP BY ALL)
SELECT structure_id, component, round(v / sqrt(sum(v * v) OVER (PARTITION BY structure_id)), 6) + 0.0 AS value FROM m""")
def _(spark, d):
    spectra = fields.environment_spectrum(N.neighbour_pairs(points(spark, d), 0.3), 0.3, 2, 2)
    out = fields.average_spectrum(spectra, len(fields.spectrum_index(2, 2)))
    return out.select("structure_id", F.posexplode("value").alias("component", "value")).select(
        "structure_id", long("component").alias("component"), rounded("value").alias("value"))


@query("G8_powder_pattern", f"""
WITH {POINTS}, s AS (SELECT structure_id, h, k, l, sum(number * cos(2 * pi() * (h * x / 4 + k * y / 4 + l * z / 4))) AS re, sum(number * sin(2 * pi() * (h * x / 4 + k * y / 4 + l * z / 4))) AS im
 FROM points, range(-1, 2) a(h), range(-1, 2) b(k), range(-1, 2) c(l) WHERE h <> 0 OR k <> 0 OR l <> 0 GROUP BY ALL)
SELECT structure_id, h, k, l, round(2 * degrees(asin(1.54184 / 2 * sqrt((h * h + k * k + l * l) / 16.0))), 4) AS two_theta,
 round((re * re + im * im) / max(re * re + im * im) OVER (PARTITION BY structure_id) * 100, 4) AS intensity FROM s""")
def _(spark, d):
    p = points(spark, d)
    out = fields.powder_pattern(p, cells(p, 4.0, 4.0, 4.0), "CuKa", 1)
    return out.select("structure_id", *[long(c).alias(c) for c in "hkl"], rounded("two_theta", 4).alias("two_theta"), rounded("intensity", 4).alias("intensity"))


# --- boxes -------------------------------------------------------------------

BOX, STRIDE, PAD = (0.25, 0.25, 0.3), (0.2, 0.2, 0.25), (0.5, 0.5, 0.0)


def _sources(spark, d):
    return points(spark, d).withColumnRenamed("structure_id", "source")


def _axis_sql(a: str, w: float, s: float, pad: float) -> str:
    lo, hi = f"(min({a}) - {pad * w})", f"(max({a}) + {pad * w})"
    return f"{lo} AS lo_{a}, {hi} AS hi_{a}, floor(({hi} - {lo}) / {s}) + 1 AS n0_{a}"


def _grid_sql(box=BOX, stride=STRIDE, pad=PAD) -> str:
    axes = list(zip("xyz", box, stride, pad))
    grow = ", ".join(f"n0_{a} + CASE WHEN hi_{a} > lo_{a} + (n0_{a} - 1) * {s} + {w} THEN ceil((hi_{a} - (lo_{a} + (n0_{a} - 1) * {s} + {w})) / {s}) ELSE 0 END AS n_{a}"
                     for a, w, s, _ in axes)
    shift = ", ".join(f"lo_{a} - greatest(lo_{a} + (n_{a} - 1) * {s} + {w} - hi_{a}, 0) / 2 AS start_{a}, CAST(n_{a} AS BIGINT) AS n_{a}"
                      for a, w, s, _ in axes)
    return f"""{POINTS}, g0 AS (SELECT structure_id AS source, {', '.join(_axis_sql(*x) for x in axes)} FROM points GROUP BY 1),
g1 AS (SELECT *, {grow} FROM g0), grid AS (SELECT source, {shift} FROM g1),
boxes AS (SELECT source, kz, iy, jx, start_x, start_y, start_z FROM grid, LATERAL (SELECT unnest(range(n_z)) AS kz), LATERAL (SELECT unnest(range(n_y)) AS iy), LATERAL (SELECT unnest(range(n_x)) AS jx)),
member AS (SELECT b.source, kz, iy, jx, atom_id, number FROM boxes b JOIN points p ON p.structure_id = b.source
 AND x BETWEEN start_x + jx * {stride[0]} AND start_x + jx * {stride[0]} + {box[0]} AND y BETWEEN start_y + iy * {stride[1]} AND start_y + iy * {stride[1]} + {box[1]}
 AND z BETWEEN start_z + kz * {stride[2]} AND start_z + kz * {stride[2]} + {box[2]}),
pops AS (SELECT b.source, b.kz, b.iy, b.jx, count(m.atom_id) AS n_atoms FROM boxes b LEFT JOIN member m USING (source, kz, iy, jx) GROUP BY ALL)"""


@query("J9_box_grid", f"""
WITH {_grid_sql()} SELECT source, round(start_x, 6) + 0.0 AS start_x, round(start_y, 6) + 0.0 AS start_y, round(start_z, 6) + 0.0 AS start_z, n_x, n_y, n_z FROM grid""")
def _(spark, d):
    g = B.box_grid(_sources(spark, d), BOX, STRIDE, PAD)
    return g.select("source", *[rounded(f"start_{a}").alias(f"start_{a}") for a in "xyz"], *[long(f"n_{a}").alias(f"n_{a}") for a in "xyz"])


@query("J8_atoms_in_boxes", f"WITH {_grid_sql()} SELECT source, kz, iy, jx, atom_id FROM member")
def _(spark, d):
    p = _sources(spark, d)
    m = B.assign_boxes(p, cut_lineage(B.box_grid(p, BOX, STRIDE, PAD)), BOX, STRIDE)
    return m.select("source", *[long(c).alias(c) for c in B.BOX], "atom_id")


@query("D8_box_structures", f"""
WITH {_grid_sql()} SELECT source || '_' || kz || '_' || iy || '_' || jx AS structure_id, 'Fe' AS symbol, count(*) AS n_atoms FROM member GROUP BY ALL""")
def _(spark, d):
    p = _sources(spark, d)
    m = B.assign_boxes(p, cut_lineage(B.box_grid(p, BOX, STRIDE, PAD)), BOX, STRIDE)
    return B.box_structures(m, species="Fe").groupBy("structure_id", "symbol").agg(F.count(F.lit(1)).alias("n_atoms"))


@query("M25_box_names", f"""
WITH {_grid_sql()} SELECT DISTINCT source || '_' || kz || '_' || iy || '_' || jx AS name FROM boxes""")
def _(spark, d):
    boxes = B.all_boxes(B.box_grid(_sources(spark, d), BOX, STRIDE, PAD))
    return boxes.select(algebra.box_name(F.col("source"), F.col("kz"), F.col("iy"), F.col("jx")).alias("name"))


@query("A16_box_populations", f"WITH {_grid_sql()} SELECT source, kz, iy, jx, n_atoms FROM pops")
def _(spark, d):
    return B.populations(_sources(spark, d), BOX, STRIDE, PAD).select("source", *[long(c).alias(c) for c in B.BOX], "n_atoms")


@query("A16_population_statistics", f"""
WITH {_grid_sql()} SELECT source, count(*) AS n_boxes, count(*) FILTER (WHERE n_atoms = 0) AS n_empty, max(n_atoms) AS max_atoms,
 round(avg(n_atoms), 6) AS mean_atoms, round(stddev_pop(n_atoms), 6) AS std_atoms FROM pops GROUP BY 1""")
def _(spark, d):
    out = B.population_statistics(B.populations(_sources(spark, d), BOX, STRIDE, PAD))
    return out.withColumn("mean_atoms", rounded("mean_atoms")).withColumn("std_atoms", rounded("std_atoms"))


@query("A17_typical_population", f"""
WITH {_grid_sql()}, c AS (SELECT source, quantile_cont(n_atoms, 0.2) AS cut FROM pops GROUP BY 1)
SELECT source, CAST(quantile_cont(n_atoms, 0.5) AS DOUBLE) AS n_typical FROM pops JOIN c USING (source) WHERE n_atoms > cut GROUP BY source""")
def _(spark, d):
    return B.typical_population(B.populations(_sources(spark, d), BOX, STRIDE, PAD))


def _grown_axis_sql(a: str) -> str:
    short = f"max({a}) - (min({a}) + (floor((max({a}) - min({a})) / 0.2)) * 0.2 + w)"
    n = f"(floor((max({a}) - min({a})) / 0.2) + 1 + CASE WHEN {short} > 0 THEN ceil(({short}) / 0.2) ELSE 0 END)"
    return f"min({a}) - greatest(min({a}) + ({n} - 1) * 0.2 + w - max({a}), 0) / 2 AS s_{a}, CAST({n} AS BIGINT) AS n_{a}"


def _tried_sizes_sql(sizes: str) -> str:
    """Counts ``c`` of every box of every size of every source."""
    return f"""{POINTS}, sizes AS ({sizes}),
g AS (SELECT structure_id AS source, i, w, {', '.join(_grown_axis_sql(a) for a in 'xyz')} FROM points, sizes GROUP BY 1, 2, 3),
b AS (SELECT source, i, w, s_x + jx * 0.2 AS bx, s_y + iy * 0.2 AS by_, s_z + kz * 0.2 AS bz FROM g, LATERAL (SELECT unnest(range(n_z)) AS kz), LATERAL (SELECT unnest(range(n_y)) AS iy), LATERAL (SELECT unnest(range(n_x)) AS jx)),
c AS (SELECT b.source, b.i, b.w, bx, by_, bz, count(atom_id) AS n FROM b LEFT JOIN points p ON p.structure_id = b.source AND x BETWEEN bx AND bx + w AND y BETWEEN by_ AND by_ + w AND z BETWEEN bz AND bz + w GROUP BY ALL)"""


@query("A17_optimal_box_size", f"""
WITH {_tried_sizes_sql("SELECT i, 0.3::DOUBLE + i * 0.02::DOUBLE AS w FROM range(-14, 40) t(i)")},
cut AS (SELECT source, i, w, quantile_cont(n, 0.2) AS cut FROM c GROUP BY ALL),
typical AS (SELECT cut.source, cut.i, cut.w, coalesce(CAST(quantile_cont(n, 0.5) FILTER (WHERE n > cut) AS DOUBLE), 0) AS t
 FROM cut JOIN c ON c.source = cut.source AND c.i = cut.i GROUP BY ALL),
judged AS (SELECT *, t - 1 <= 8 AND 8 <= t + 1 AS fits, t <= 8 AS grows FROM typical),
begun AS (SELECT source, fits AS fits0, grows AS up FROM judged WHERE i = 0),
walk AS (SELECT j.*, fits0, up, abs(i) AS far FROM judged j JOIN begun USING (source) WHERE i = 0 OR (NOT fits0 AND (i > 0) = up)),
ended AS (SELECT source, min(far) FILTER (WHERE fits) AS hit, min(far) FILTER (WHERE i <> 0 AND NOT fits AND grows <> up) AS turn FROM walk GROUP BY 1)
SELECT e.source, w.i AS size_id, round(w.w, 6) AS size, w.t AS n_typical FROM ended e LEFT JOIN walk w ON w.source = e.source AND w.far = e.hit AND (e.turn IS NULL OR e.hit < e.turn)""")
def _(spark, d):
    sizes = G.optimal_box_sizes(_sources(spark, d), (0.3, 0.3, 0.3), 8, 1, 1, 40, 0.02, (0.2, 0.2, 0.2))
    return sizes.select("source", long("size_id").alias("size_id"), rounded("width_x").alias("size"), "n_typical")


@query("A18_grown_box_size", f"""
WITH {_tried_sizes_sql("SELECT i, i * 0.05::DOUBLE AS w FROM range(1, 30) t(i)")},
m AS (SELECT source, i, w, quantile_cont(n, 0.5) FILTER (WHERE n > 0) AS median, stddev_pop(n) AS std FROM c GROUP BY ALL)
SELECT source, round(arg_min(w, i), 6) AS size, CAST(arg_min(median, i) AS DOUBLE) AS median, round(arg_min(std, i), 6) AS std FROM m
WHERE median >= 10 GROUP BY source""")
def _(spark, d):
    sizes = G.grown_box_sizes(_sources(spark, d), 10, 0.05, (0.2, 0.2, 0.2))
    return sizes.select("source", rounded("size").alias("size"), "median", rounded("std").alias("std"))


@query("A19_axis_padding", f"""
WITH {POINTS} SELECT structure_id AS source, CASE WHEN max(x) - min(x) <= 0.6 THEN 0.0 ELSE 1.0 END::DOUBLE AS pad_x, CASE WHEN max(y) - min(y) <= 0.55 THEN 0.0 ELSE 1.0 END::DOUBLE AS pad_y,
 CASE WHEN max(z) - min(z) <= 9 THEN 0.0 ELSE 1.0 END::DOUBLE AS pad_z FROM points GROUP BY 1""")
def _(spark, d):
    return B.axis_padding(_sources(spark, d), (0.6, 0.55, 9.0), (1.0, 1.0, 1.0))


@query("Q5_classification_map", f"""
WITH {_grid_sql()}, p AS (SELECT source, kz, iy, jx, c AS class_id, CASE WHEN c = 0 THEN n_atoms / 100.0 ELSE 1 - n_atoms / 100.0 END AS p FROM pops, range(2) t(c))
SELECT source, class_id, kz, iy, string_agg(printf('%.2f', p), ' ' ORDER BY jx) AS line FROM p GROUP BY ALL""")
def _(spark, d):
    pops = B.populations(_sources(spark, d), BOX, STRIDE, PAD)
    share = F.col("n_atoms") / 100.0
    m = B.map_rows(B.classification_map(pops.withColumn("probs", F.array(share, 1 - share)), "probs", 2))
    text = F.array_join(F.transform("line", lambda v: F.format_string("%.2f", v)), " ")
    return m.select("source", *[long(c).alias(c) for c in ("class_id", "kz", "iy")], text.alias("line"))


# --- transformations ---------------------------------------------------------

@query("V1_supercell", f"""
WITH {POINTS}, m AS (SELECT atom_id * 6 + (i * 2 + j) * 1 + k AS atom_id, atom_id AS site_id, (i * 2 + j) * 1 + k AS replica, x + i + {SHEAR} * j AS x, y + j AS y, z + k AS z FROM points, range(3) a(i), range(2) b(j), range(1) c(k)),
f AS (SELECT *, floor((x - {SHEAR} * y) / 3 + 1e-7) AS fa, floor(y / 2 + 1e-7) AS fb, floor(z + 1e-7) AS fc FROM m)
SELECT atom_id, site_id, replica, round(x - 3 * fa - 2 * {SHEAR} * fb, 6) + 0.0 AS x, round(y - 2 * fb, 6) + 0.0 AS y, round(z - fc, 6) + 0.0 AS z FROM f""")
def _(spark, d):
    p = points(spark, d)
    out, _ = S.supercell(p, _cells(p), (3, 2, 1))
    return out.select("atom_id", "site_id", "replica", *[rounded(a).alias(a) for a in "xyz"])


@query("V2_replicas_by_atoms", f"""
WITH RECURSIVE {POINTS}, b AS (SELECT structure_id, count(*) AS n, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM points GROUP BY 1),
w AS (SELECT structure_id, n, ex, ey, ez, 1 AS i, 1 AS j, 1 AS k FROM b UNION ALL
 SELECT structure_id, n, ex, ey, ez, CASE WHEN pick = 0 THEN i + 1 ELSE i END, CASE WHEN pick = 1 THEN j + 1 ELSE j END, CASE WHEN pick = 2 THEN k + 1 ELSE k END FROM (
  SELECT *, CASE WHEN lx <= ly AND lx <= lz THEN 0 WHEN ly <= lz THEN 1 ELSE 2 END AS pick FROM (
   SELECT *, ex + (i - 1) + {SHEAR} * (j - 1) AS lx, ey + (j - 1) AS ly, ez + (k - 1) AS lz FROM w WHERE n * i * j * k < 1000)))
SELECT structure_id, CAST(max(i) AS BIGINT) AS a, CAST(max(j) AS BIGINT) AS b, CAST(max(k) AS BIGINT) AS c, CAST(max(i * j * k * n) AS BIGINT) AS n_replicated FROM w GROUP BY 1""")
def _(spark, d):
    p = points(spark, d)
    r = S.replicas_by_atoms(p, _cells(p), 1000)
    return r.select("structure_id", *[long(F.col("replicas")[i]).alias(n) for i, n in enumerate("abc")], long("n_replicated").alias("n_replicated"))


@query("V3_replicas_by_radius", f"""
WITH {POINTS} SELECT structure_id, CAST(3 AS BIGINT) AS a, CAST(floor(2.9 / sqrt(1 + pow({SHEAR}, 2))) AS BIGINT) AS b, CAST(1 AS BIGINT) AS c,
 CAST(count(*) * 3 * floor(2.9 / sqrt(1 + pow({SHEAR}, 2))) AS BIGINT) AS n_replicated FROM points GROUP BY 1""")
def _(spark, d):
    p = points(spark, d)
    r = S.replicas_by_radius(p, _cells(p), (3.5, 2.9, 1.1), 10)
    return r.select("structure_id", *[long(F.col("replicas")[i]).alias(n) for i, n in enumerate("abc")], long("n_replicated").alias("n_replicated"))


@query("V5_smallest_replica_grid", """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, (SELECT min(k) FROM range(1, 200) t(k) WHERE k * k * k * n >= 100) AS cubic, (SELECT min(k) FROM range(1, 200) t(k) WHERE k * k * n >= 100) AS planar,
 CAST(3 AS BIGINT) AS n_cubic, CAST(9 AS BIGINT) AS n_planar FROM n""")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    cubic = S.smallest_replica_grid(F.col("n"), 100, F.lit(False))
    flat = S.smallest_replica_grid(F.col("n"), 100, F.lit(True))
    return n.select("l_orderkey", long(cubic[0][0]).alias("cubic"), long(flat[0][0]).alias("planar"),
                    long(F.size(cubic)).alias("n_cubic"), long(F.size(flat)).alias("n_planar"))


_RANKED = f"""{POINTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY md5(structure_id || '/' || atom_id || '#42'), atom_id) - 1 AS r,
 count(*) OVER (PARTITION BY structure_id) AS n FROM points)"""


@query("V6_vacancies", f"WITH {_RANKED} SELECT structure_id, atom_id FROM ranked WHERE r >= floor(n * 0.3)")
def _(spark, d):
    return S.create_vacancies(points(spark, d), 0.3).select("structure_id", "atom_id")


@query("V6_defect_error", """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT *, floor(n * 0.3) / n AS actual FROM n)
SELECT l_orderkey AS structure_id, n AS n_atoms, round(actual, 6) AS actual_ratio, round(abs(0.3 - actual) / 0.3, 6) AS rel_error, abs(0.3 - actual) / 0.3 > 0.25 AS exceeds FROM a""")
def _(spark, d):
    atoms = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("structure_id"))
    out = S.defect_error(atoms, 0.3)
    return out.withColumn("actual_ratio", rounded("actual_ratio")).withColumn("rel_error", rounded("rel_error"))


@query("Q11_random_subset", f"WITH {_RANKED} SELECT structure_id, atom_id FROM ranked WHERE r < floor(n * 0.4)")
def _(spark, d):
    return S.random_subset(points(spark, d), 0.4, "atom_id").select("structure_id", "atom_id")


def _hash_sql(text: str, modulus: int) -> str:
    return f"(CAST('0x' || md5({text})[1:8] AS BIGINT) % {modulus})"


@query("V7_substitution", f"""
WITH {_RANKED}, s AS (SELECT *, {_hash_sql("structure_id || '/' || atom_id || '#slot42'", 5)} AS slot FROM ranked)
SELECT structure_id, atom_id, CAST(CASE WHEN r < floor(n * 0.5) THEN 1 + {_hash_sql("structure_id || '/' || slot || '#pool42'", 94)} ELSE number END AS BIGINT) AS number FROM s""")
def _(spark, d):
    return S.substitute_atoms(points(spark, d), 0.5, 5).select("structure_id", "atom_id", long("number").alias("number"))


def _unit_sql(axis: str, part: str) -> str:
    return f"""((CAST('0x' || md5(structure_id || '/' || atom_id || '#{axis}{part}42')[1:8] AS BIGINT) + 0.5) / 4294967296.0)"""


@query("V8_uniform_displacement", f"WITH {POINTS} SELECT atom_id, " + ", ".join(
    f"round({a} + ({_unit_sql(a, 'u')} * 2 - 1) * 0.01, 6) + 0.0 AS {a}" for a in "xyz") + " FROM points")
def _(spark, d):
    return S.displace_atoms(points(spark, d), "uniform", 0.01).select("atom_id", *[rounded(a).alias(a) for a in "xyz"])


@query("V8_scaled_gaussian_displacement", f"WITH {_OPEN}, nn AS (SELECT structure_id, atom_id, min(r) AS r FROM pairs WHERE r <= 0.4 GROUP BY ALL), "
       "s AS (SELECT structure_id, avg(r) AS scale FROM nn GROUP BY 1) SELECT atom_id, " + ", ".join(
    f"round({a} + sqrt(-2 * ln({_unit_sql(a, 'r')})) * cos(2 * pi() * {_unit_sql(a, 'p')}) * 0.1 * scale, 6) + 0.0 AS {a}" for a in "xyz")
       + " FROM points JOIN s USING (structure_id)")
def _(spark, d):
    p = points(spark, d)
    out = S.displace_atoms(p, "gaussian_scaled", 0.1, N.length_scale(p, 0.4, "avg_nn"))
    return out.select("atom_id", *[rounded(a).alias(a) for a in "xyz"])


def _diamond(spark, d):
    """An eight-atom cubic diamond cell per label, its edge from the data."""
    s = points(spark, d).groupBy("structure_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    a = F.lit(3.0) + F.col("n") / 1000
    zero = F.lit(0.0)
    structures = s.select("structure_id", F.array(F.array(a, zero, zero), F.array(zero, a, zero), F.array(zero, zero, a)).alias("cell"),
                          F.array_repeat(F.lit(True), 3).alias("pbc"))
    sites = [(0, 0, 0), (0, .5, .5), (.5, 0, .5), (.5, .5, 0), (.25, .25, .25), (.25, .75, .75), (.75, .25, .75), (.75, .75, .25)]
    site = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("atom_id"), *[F.lit(float(v)).alias(x) for v, x in zip(f, "xyz")])
                               for i, f in enumerate(sites)])).alias("p")
    atoms = s.select("structure_id", a.alias("a"), site).select(
        "structure_id", "p.atom_id", F.lit(6).alias("number"), *[(F.col(f"p.{x}") * F.col("a")).alias(x) for x in "xyz"])
    return atoms, structures


@query("V9_partial_transition", """
WITH n AS (SELECT CAST(label AS VARCHAR) AS structure_id FROM embeddings GROUP BY 1),
a AS (SELECT structure_id, i * 8 + r AS atom_id, i AS site_id, r AS replica FROM n, range(8) t(i), range(8) u(r)),
k AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY md5(structure_id || '/' || atom_id || '#42'), atom_id) - 1 AS rn FROM a WHERE site_id >= 4)
SELECT structure_id, atom_id, site_id, replica FROM a WHERE site_id < 4 UNION ALL SELECT structure_id, atom_id, site_id, replica FROM k WHERE rn >= 16""")
def _(spark, d):
    atoms, structures = _diamond(spark, d)
    out = S.partial_transition(atoms, structures, "diamond", "fcc", 0.5, (2, 2, 2), max_rel_error=0.01)
    return out.select("structure_id", "atom_id", "site_id", "replica")


@query("V9_transition_error", """
WITH n AS (SELECT CAST(label AS VARCHAR) AS structure_id, 1 + label % 3 AS k FROM embeddings GROUP BY ALL), r AS (SELECT structure_id, 4 * k AS n_removable FROM n),
g AS (SELECT *, CAST(floor(n_removable * 0.3) AS BIGINT) AS n_removed FROM r)
SELECT structure_id, CAST(n_removable AS BIGINT) AS n_removable, n_removed, round(n_removed / n_removable, 6) AS actual_contribution,
 round(abs(0.3 - n_removed / n_removable) / 0.3, 6) AS rel_error, abs(0.3 - n_removed / n_removable) / 0.3 > 0.2 AS exceeds FROM g""")
def _(spark, d):
    atoms, structures = _diamond(spark, d)
    size = structures.select("structure_id", F.array((1 + F.col("structure_id").cast("int") % 3), F.lit(1), F.lit(1)).alias("replicas"))
    out = S.transition_error(atoms, structures, "diamond", "fcc", 0.3, size, 0.2)
    return out.select("structure_id", "n_removable", "n_removed", rounded("actual_contribution").alias("actual_contribution"),
                      rounded("rel_error").alias("rel_error"), "exceeds")


@query("J15_positions_only_in_one", """
SELECT CAST(label AS VARCHAR) AS structure_id, i AS atom_id FROM (SELECT DISTINCT label FROM embeddings), range(4, 8) t(i)""")
def _(spark, d):
    atoms, structures = _diamond(spark, d)
    return S.positions_only_in(atoms, S.removable_sites(atoms, structures, "diamond", "fcc")).select("structure_id", "atom_id")


_DOUBLED = f"""{POINTS}, big AS (SELECT structure_id, atom_id * 2 + i AS atom_id, number, x + i AS x, y, z FROM points, range(2) t(i)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY md5(structure_id || '/' || atom_id || '#42'), atom_id) - 1 AS r,
 count(*) OVER (PARTITION BY structure_id) AS n FROM big)"""


def _doubled(spark, d):
    p = points(spark, d)
    return S.supercell(p, _cells(p), (2, 1, 1), wrap=False)[0]


@query("V6_vacancies_of_supercell", f"WITH {_DOUBLED} SELECT structure_id, atom_id FROM drawn WHERE r >= floor(n * 0.3)")
def _(spark, d):
    return S.create_vacancies(_doubled(spark, d), 0.3).select("structure_id", "atom_id")


@query("V7_substitution_in_supercell", f"""
WITH {_DOUBLED}, s AS (SELECT *, {_hash_sql("structure_id || '/' || atom_id || '#slot42'", 5)} AS slot FROM drawn)
SELECT structure_id, atom_id, CAST(CASE WHEN r < floor(n * 0.5) THEN 1 + {_hash_sql("structure_id || '/' || slot || '#pool42'", 94)} ELSE number END AS BIGINT) AS number FROM s""")
def _(spark, d):
    return S.substitute_atoms(_doubled(spark, d), 0.5, 5).select("structure_id", "atom_id", long("number").alias("number"))


@query("V8_gaussian_displacement_of_supercell", f"WITH {_DOUBLED} SELECT structure_id, atom_id, " + ", ".join(
    f"round({a} + sqrt(-2 * ln({_unit_sql(a, 'r')})) * cos(2 * pi() * {_unit_sql(a, 'p')}) * 0.02, 6) + 0.0 AS {a}" for a in "xyz") + " FROM big")
def _(spark, d):
    return S.displace_atoms(_doubled(spark, d), "gaussian", 0.02).select("structure_id", "atom_id", *[rounded(a).alias(a) for a in "xyz"])


@query("V8_scaled_uniform_displacement", f"WITH {_OPEN}, nn AS (SELECT structure_id, atom_id, min(r) AS r FROM pairs WHERE r <= 0.4 GROUP BY ALL), "
       "s AS (SELECT structure_id, avg(r) AS scale FROM nn GROUP BY 1) SELECT atom_id, " + ", ".join(
    f"round({a} + ({_unit_sql(a, 'u')} * 2 - 1) * 0.1 * scale, 6) + 0.0 AS {a}" for a in "xyz")
       + " FROM points JOIN s USING (structure_id)")
def _(spark, d):
    p = points(spark, d)
    out = S.displace_atoms(p, "uniform_scaled", 0.1, N.length_scale(p, 0.4, "avg_nn"))
    return out.select("atom_id", *[rounded(a).alias(a) for a in "xyz"])


def _turn_sql() -> str:
    u = [f"((CAST('0x' || md5(structure_id || '#turn{p}42')[1:8] AS BIGINT) + 0.5) / 4294967296.0)" for p in "abc"]
    return f"""q AS (SELECT DISTINCT structure_id, sqrt(1 - {u[0]}) * sin(2 * pi() * {u[1]}) AS qx, sqrt(1 - {u[0]}) * cos(2 * pi() * {u[1]}) AS qy,
 sqrt({u[0]}) * sin(2 * pi() * {u[2]}) AS qz, sqrt({u[0]}) * cos(2 * pi() * {u[2]}) AS qw FROM points),
-- v + 2 w (q x v) + 2 q x (q x v)
c AS (SELECT p.*, qx, qy, qz, qw, qy * z - qz * y AS cx, qz * x - qx * z AS cy, qx * y - qy * x AS cz FROM points p JOIN q USING (structure_id))"""


@query("V1_random_rotation", f"""
WITH {POINTS}, {_turn_sql()} SELECT atom_id, round(x + 2 * qw * cx + 2 * (qy * cz - qz * cy), 6) + 0.0 AS x,
 round(y + 2 * qw * cy + 2 * (qz * cx - qx * cz), 6) + 0.0 AS y, round(z + 2 * qw * cz + 2 * (qx * cy - qy * cx), 6) + 0.0 AS z FROM c""")
def _(spark, d):
    p = points(spark, d)
    return S.random_rotation(p, _cells(p))[0].select("atom_id", *[rounded(a).alias(a) for a in "xyz"])


@query("V10_operation_fan_out", f"""
WITH {_RANKED} SELECT structure_id, 'copy' AS op_id, count(*) AS n_atoms, max(n) AS n_before FROM ranked GROUP BY structure_id
UNION ALL SELECT structure_id, 'double', count(*) * 2, max(n) FROM ranked GROUP BY structure_id
UNION ALL SELECT structure_id, 'holes', count(*) FILTER (WHERE r >= floor(n * 0.1)), max(n) FROM ranked GROUP BY structure_id""")
def _(spark, d):
    p = points(spark, d)
    ops = [("copy", lambda a, s: (a, s), {}), ("double", lambda a, s, n: S.supercell(a, s, n), {"n": (2, 1, 1)}),
           ("holes", lambda a, s, ratio: (S.create_vacancies(a, ratio), s), {"ratio": 0.1})]
    atoms, structures = S.apply_operations((p, _cells(p)), ops)
    before = p.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_before"))
    return (atoms.groupBy("structure_id", "op_id").agg(F.count(F.lit(1)).alias("n_atoms"))
            .join(structures.select("structure_id", "op_id"), ["structure_id", "op_id"]).join(before, "structure_id"))


@query("V11_centred_layers", f"""
WITH {POINTS} SELECT atom_id, x, y, round(z + abs(avg(z) OVER (PARTITION BY structure_id) - 23.0), 6) + 0.0 AS z, CAST(46.0 AS DOUBLE) AS height FROM points""")
def _(spark, d):
    p = points(spark, d)
    atoms, s = S.centre_layers(p, _cells(p), 46.0)
    return atoms.join(s.select("structure_id", F.col("cell")[2][2].alias("height")), "structure_id").select(
        "atom_id", "x", "y", rounded("z").alias("z"), "height")


@query("V13_zeroed_cells", f"""
SELECT CAST(label AS VARCHAR) AS structure_id, i AS axis, CASE WHEN i = 0 THEN 1.0 WHEN i = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS diagonal, CASE WHEN i = 1 THEN {SHEAR} ELSE 0.0 END::DOUBLE AS first
FROM (SELECT DISTINCT label FROM embeddings), range(3) t(i)""")
def _(spark, d):
    s = S.zero_open_cell_vectors(cells(points(spark, d), shear=SHEAR, periodic=(True, True, False)))
    rows = s.select("structure_id", F.posexplode("cell").alias("axis", "v"))
    first = F.when(F.col("axis") == 1, F.col("v")[0]).otherwise(0.0)
    return rows.select("structure_id", long("axis").alias("axis"), F.get("v", "axis").alias("diagonal"), first.alias("first"))


@query("M12_axis_rotation", f"""
WITH {POINTS} SELECT atom_id, round(cos(radians(30)) * y + sin(radians(30)) * z, 6) + 0.0 AS xy, round(cos(radians(40)) * x + sin(radians(40)) * z, 6) + 0.0 AS yx,
 round(cos(radians(50)) * y - sin(radians(50)) * x, 6) + 0.0 AS zy FROM points""")
def _(spark, d):
    v = (F.col("x"), F.col("y"), F.col("z"))
    return points(spark, d).select("atom_id", rounded(algebra.rotate_x(v, F.lit(30.0))[1]).alias("xy"),
                                   rounded(algebra.rotate_y(v, F.lit(40.0))[0]).alias("yx"), rounded(algebra.rotate_z(v, F.lit(50.0))[1]).alias("zy"))


@query("M13_euler_rotation", f"""
WITH {POINTS}, c AS (SELECT atom_id, x - {(1 + SHEAR) / 2} AS x, y - 0.5 AS y, z - 0.5 AS z FROM points),
a AS (SELECT atom_id, cos(radians(10)) * x + sin(radians(10)) * y AS x, cos(radians(10)) * y - sin(radians(10)) * x AS y, z FROM c),
b AS (SELECT atom_id, x, cos(radians(20)) * y + sin(radians(20)) * z AS y, cos(radians(20)) * z - sin(radians(20)) * y AS z FROM a)
SELECT atom_id, round(cos(radians(30)) * x + sin(radians(30)) * y + {(1 + SHEAR) / 2}, 6) + 0.0 AS x, round(cos(radians(30)) * y - sin(radians(30)) * x + 0.5, 6) + 0.0 AS y,
 round(z + 0.5, 6) + 0.0 AS z FROM b""")
def _(spark, d):
    p = points(spark, d)
    return S.euler_rotate(p, 10, 20, 30, _cells(p)).select("atom_id", *[rounded(a).alias(a) for a in "xyz"])


@query("D1_user_operation", f"WITH {POINTS} SELECT atom_id, round(x + 3, 6) AS x, round(y + 2.5, 6) AS y, round(z + 7, 6) AS z FROM points")
def _(spark, d):
    def translate(df, by):
        return df.select("atom_id", *[rounded(F.col(a) + v).alias(a) for a, v in zip("xyz", by)])
    return points(spark, d).transform(translate, by=(3.0, 2.5, 7.0))


# --- files -------------------------------------------------------------------

@query("S1_xyz_round_trip", f"""
WITH {POINTS} SELECT symbol, x, y, z, CAST(number AS BIGINT) AS number FROM points""")
def _(spark, d):
    from latticeloom.sources.readers import read_xyz
    from latticeloom.sources.writers import write_xyz

    path = scratch_path(spark, "xyz")
    write_xyz(points(spark, d), path, ["atom_id"], ["symbol", "x", "y", "z", "number"], rows_per_part=100)
    return read_xyz(spark, path, ["number"]).select("symbol", "x", "y", "z", long("number").alias("number"))


@query("K8_xyz_lines", f"""
WITH {POINTS}, f AS (SELECT *, row_number() OVER (ORDER BY atom_id) + 1 AS n FROM points WHERE structure_id = '1')
SELECT n AS line_no, symbol AS first FROM f UNION ALL SELECT 0, CAST(count(*) AS VARCHAR) FROM f UNION ALL SELECT 1, ''""")
def _(spark, d):
    from latticeloom.operators.filters import select_structure_atoms
    from latticeloom.sources.writers import xyz_lines

    lines = xyz_lines(select_structure_atoms(points(spark, d), "1", ["number"]), ["atom_id"])
    return lines.select("line_no", F.split("value", " ")[0].alias("first"))


@query("S8_csv_round_trip", "SELECT p_partkey, p_type, p_retailprice FROM part")
def _(spark, d):
    from latticeloom.sources.readers import read_table
    from latticeloom.sources.writers import write_table

    path = scratch_path(spark, "csv")
    write_table(table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice"), path)
    return read_table(spark, path, "p_partkey long, p_type string, p_retailprice double")


@query("K1_target_records", "SELECT CAST(event_id AS VARCHAR) AS filename, event_type AS target FROM events")
def _(spark, d):
    from latticeloom.sources.readers import read_targets
    from latticeloom.sources.writers import write_targets

    path = scratch_path(spark, "targets")
    write_targets(table(spark, d, "events").select(F.col("event_id").cast("string").alias("structure_id"), F.col("event_type").alias("target")), path)
    return read_targets(spark, path)[0].select("filename", "target")


@query("K2_structure_database", "SELECT CAST(vec_id AS VARCHAR) AS structure_id, CAST(label AS VARCHAR) AS target, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings")
def _(spark, d):
    from latticeloom.sources.writers import write_structures

    path = scratch_path(spark, "structures")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("structure_id"), F.col("label").cast("string").alias("target"),
                                                F.col("embedding")[0].cast("double").alias("x"))
    write_structures(rows.where("target < '5'"), path)
    write_structures(rows.where("target >= '5'"), path, overwrite=False)
    return spark.read.parquet(path)


@query("K3_descriptor_dataset", "SELECT 'vector' AS descriptor_name, label, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, d):
    from latticeloom.sources.writers import write_descriptors

    path = scratch_path(spark, "descriptors")
    write_descriptors(table(spark, d, "embeddings").withColumn("descriptor_name", F.lit("vector")), path)
    return spark.read.parquet(path).groupBy("descriptor_name", "label").agg(F.count(F.lit(1)).alias("n"))


@query("K6_dataset_round_trip", """
SELECT row_number() OVER (ORDER BY event_type) - 1 AS class_id, event_type AS label, count(*) AS n FROM events GROUP BY event_type""")
def _(spark, d):
    from latticeloom.operators.labels import merge_labels
    from latticeloom.sources.readers import read_dataset
    from latticeloom.sources.writers import write_dataset

    ev, path = table(spark, d, "events"), scratch_path(spark, "dataset")
    write_dataset(merge_labels(ev.select("event_id", "value"), ev, "event_id", "event_type", test_size=0.1), path, "event_type", "events")
    _, summary = read_dataset(spark, path)
    return summary.select(F.explode("classes").alias("c")).select(long("c.class_id").alias("class_id"), "c.label", "c.n")


@query("K10_sparse_matrix", "SELECT l_orderkey AS row, CAST(l_linenumber AS BIGINT) AS col, count(*) AS n, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY ALL")
def _(spark, d):
    from latticeloom.sources.readers import read_sparse
    from latticeloom.sources.writers import write_sparse

    path = scratch_path(spark, "sparse")
    write_sparse(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), long("l_linenumber").alias("col"), F.col("l_quantity").alias("value")), path)
    return read_sparse(spark, path).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("value"))


@query("K9_facet_table", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS symmetry_0.1, l_linestatus AS symmetry_0.01 FROM lineitem"
       .replace("symmetry_0.01", '"symmetry_0.01"').replace("symmetry_0.1 ", '"symmetry_0.1" ').replace('symmetry_0.1,', '"symmetry_0.1",'))
def _(spark, d):
    from latticeloom.sources.writers import write_facets

    path = scratch_path(spark, "facets")
    m = F.create_map(F.lit("0.1"), F.col("l_returnflag"), F.lit("(0.01)"), F.col("l_linestatus"))
    write_facets(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", m.alias("symmetry")), None, path, maps=["symmetry"])
    return spark.read.option("header", True).schema("l_orderkey long, l_linenumber int, l_partkey long, `symmetry_0.01` string, `symmetry_0.1` string").csv(path)


# --- whole analyses ----------------------------------------------------------

def _small_descriptor(**options):
    from latticeloom.plans.analysis import make_descriptor

    return make_descriptor("environment_spectrum", cutoff=2.5, n_max=2, l_max=2, scaling="avg_nn", scaling_radii=(0.4,), periodic=False, scale_limits=(0.01, 10.0), **options)


#: Weights of two linear two-class models on the nine components of the small descriptor, one list a model.
WEIGHTS = [[(i - 4) / 2 for i in range(9)], [(4 - i) / 3 + 0.5 for i in range(9)]]


class LinearModel:
    """A user's own model: the logistic function of a weighted sum of the features."""

    def __init__(self, weights):
        self.weights = weights

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector, vector_to_array

        x = vector_to_array("features")
        p = 1 / (1 + F.exp(-sum((x[i] * w for i, w in enumerate(self.weights)), F.lit(0.0))))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def _scored_sql(places: str) -> str:
    """Descriptor, class probabilities of both models and their uncertainty, as ``scored``, of structures ``(structure_id, atom_id, x, y, z)``."""
    radial = "exp(-pow(rr - {c}, 2) / (2 * pow(1.25, 2))) * 0.5 * (cos(rr * pi() / 2.5) + 1)"
    logits = ", ".join(f"1 / (1 + exp(-list_dot_product(v, {w}::DOUBLE[]))) AS p{t}" for t, w in enumerate(WEIGHTS))
    plogp = lambda x: f"greatest({x}, 1e-12) * log2(greatest({x}, 1e-12))"
    entropy = f"-({plogp('(1 - p0 + 1 - p1) / 2')} + {plogp('(p0 + p1) / 2')})"
    mean_plogp = f"({' + '.join(plogp(x) for x in ('1 - p0', 'p0', '1 - p1', 'p1'))}) / 2"
    return f"""near AS MATERIALIZED (SELECT a.structure_id, a.atom_id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS r
 FROM {places} a JOIN {places} b ON a.structure_id = b.structure_id AND a.atom_id <> b.atom_id),
nn AS (SELECT structure_id, atom_id, min(r) AS r FROM near WHERE r <= 0.4 GROUP BY ALL), sc AS (SELECT structure_id, avg(r) AS scale FROM nn GROUP BY 1),
nb AS (SELECT structure_id, atom_id, dx / r AS ux, dy / r AS uy, dz / r AS uz, r / scale AS rr FROM near JOIN sc USING (structure_id) WHERE r / scale <= 2.5),
n AS (SELECT *, {radial.format(c=0.625)} AS g0, {radial.format(c=1.875)} AS g1 FROM nb),
t AS (SELECT a.structure_id, a.atom_id, a.g0 AS a0, a.g1 AS a1, b.g0 AS b0, b.g1 AS b1, a.ux * b.ux + a.uy * b.uy + a.uz * b.uz AS c
      FROM n a JOIN n b ON a.structure_id = b.structure_id AND a.atom_id = b.atom_id),
q AS (SELECT structure_id, atom_id, [sum(a0 * b0), sum(a0 * b0 * c), sum(a0 * b0 * (3 * c * c - 1) / 2), sum(a0 * b1), sum(a0 * b1 * c), sum(a0 * b1 * (3 * c * c - 1) / 2),
  sum(a1 * b1), sum(a1 * b1 * c), sum(a1 * b1 * (3 * c * c - 1) / 2)] AS l FROM t GROUP BY structure_id, atom_id),
m AS (SELECT structure_id, component, avg(v) AS v FROM (SELECT structure_id, unnest(l) AS v, unnest(range(9)) AS component FROM q) GROUP BY ALL),
d AS (SELECT structure_id, list(v ORDER BY component) AS v FROM (SELECT structure_id, component, v / sqrt(sum(v * v) OVER (PARTITION BY structure_id)) AS v FROM m) GROUP BY 1),
p AS (SELECT structure_id, v, {logits} FROM d),
scored AS (SELECT structure_id, (p0 + p1) / 2 AS mean_p, CASE WHEN (p0 > 0.5) = (p1 > 0.5) THEN 0.0 ELSE 0.5 END AS variation_ratio,
 {entropy} AS predictive_entropy, {entropy} + {mean_plogp} AS mutual_information FROM p)"""


@query("E17_descriptor_job", f"""
WITH {POINTS}, s AS (SELECT structure_id, count(*) AS n FROM points GROUP BY 1)
SELECT structure_id || '#' || op AS structure_id, 'struct-' || (row_number() OVER (ORDER BY structure_id || '#' || op) - 1) AS label, n AS target,
 CAST(9 AS BIGINT) AS length, CAST(1.0 AS DOUBLE) AS norm FROM s, (SELECT unnest(['copy', 'holes']) AS op)""")
def _(spark, d):
    from latticeloom.plans.analysis import descriptor_job

    p = points(spark, d)
    targets = p.groupBy("structure_id").agg(F.count(F.lit(1)).alias("target"))
    ops = [("copy", lambda a, s: (a, s), {}), ("holes", lambda a, s, ratio: (S.create_vacancies(a, ratio), s), {"ratio": 0.1})]
    out = descriptor_job(_small_descriptor(), p, p.select("structure_id").distinct(), targets, ops)
    total = F.aggregate("value", F.lit(0.0), lambda acc, v: acc + v * v)
    return out.select("structure_id", "label", "target", long(F.size("value")).alias("length"), rounded(total, 4).alias("norm"))


@query("E15_global_analysis", f"""
WITH {POINTS}, {_scored_sql('points')} SELECT structure_id AS id, CAST(2 AS BIGINT) AS n_samples, round(1 - mean_p, 4) AS p0, round(mean_p, 4) AS p1, variation_ratio,
 round(predictive_entropy, 4) AS predictive_entropy, round(mutual_information, 4) + 0.0 AS mutual_information FROM scored""")
def _(spark, d):
    from latticeloom.plans.analysis import global_analysis

    p = points(spark, d)
    out = global_analysis(p, p.select("structure_id").distinct(), _small_descriptor(), [LinearModel(w) for w in WEIGHTS], 2)
    return out.select("id", "n_samples", *[rounded(F.col("mean_probs")[i], 4).alias(f"p{i}") for i in range(2)],
                      *[rounded(c, 4).alias(c) for c in ("variation_ratio", "predictive_entropy", "mutual_information")])


E16_BOX, E16_STRIDE = (0.4, 0.4, 0.4), (0.3, 0.3, 0.3)


@query("E16_local_analysis", f"""
WITH {_grid_sql(E16_BOX, E16_STRIDE, (0.0, 0.0, 0.0))},
place AS (SELECT m.source || '_' || m.kz || '_' || m.iy || '_' || m.jx AS structure_id, p.atom_id, x, y, z FROM member m JOIN points p ON p.structure_id = m.source AND p.atom_id = m.atom_id
 JOIN pops USING (source, kz, iy, jx) WHERE n_atoms > 3),
{_scored_sql('place')}
SELECT source, kz, iy, jx, n_atoms, class_id, round(CASE WHEN class_id = 1 THEN mean_p ELSE 1 - mean_p END, 3) + 0.0 AS p, variation_ratio,
 round(predictive_entropy, 3) + 0.0 AS predictive_entropy, round(mutual_information, 3) + 0.0 AS mutual_information
FROM pops CROSS JOIN range(2) c(class_id) LEFT JOIN scored ON structure_id = source || '_' || kz || '_' || iy || '_' || jx""")
def _(spark, d):
    from latticeloom.plans.analysis import local_analysis

    maps, table_ = local_analysis(_sources(spark, d), _small_descriptor(), [LinearModel(w) for w in WEIGHTS], 2, E16_BOX, E16_STRIDE, (0.0, 0.0, 0.0), 3)
    parts = ("variation_ratio", "predictive_entropy", "mutual_information")
    both = maps.join(table_.select("source", *B.BOX, "n_atoms", *parts), ["source", *B.BOX])
    return both.select("source", *[long(c).alias(c) for c in (*B.BOX, "n_atoms", "class_id")], rounded("p", 3).alias("p"), *[rounded(c, 3).alias(c) for c in parts])


@query("D7_per_item_errors", """
SELECT CASE WHEN p_size % 10 = 0 THEN -1 ELSE p_partkey END AS p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 100.0 / (p_size % 10) END AS share,
 CASE WHEN p_size % 10 = 0 THEN 'ZeroDivisionError' END AS error FROM part""")
def _(spark, d):
    from latticeloom.plans.analysis import per_item

    out = per_item(table(spark, d, "part").select("p_partkey", "p_size"),
                   lambda r: {"p_partkey": r["p_partkey"], "share": 100.0 / (r["p_size"] % 10)}, "p_partkey long, share double")
    return out.select(F.coalesce("p_partkey", F.lit(-1)).alias("p_partkey"), "share", F.split("error", ":")[0].alias("error"))
