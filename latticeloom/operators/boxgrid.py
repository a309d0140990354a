"""Populations of boxes of many sizes in one pass, by an integral grid.

Along one axis an atom lies in the boxes first..last of a grid. Its cell is that pair for each of the three axes, so atoms
are counted by cell before anything is shuffled, and never copied to each overlapping box. A cell adds its count to
all boxes of a cuboid of box indices: eight signed entries at the cuboid's corners, whose prefix sums along the three axes are
the populations. Boxes are worked on in blocks of ``BLOCK`` boxes a side; a cell's cuboid is clipped to each block it
reaches, so the prefix sums of a block need nothing from its neighbours, and a task holds one block.

What leaves a block is how many of its boxes hold how many atoms; boxes of blocks without an atom are counted from the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.operators.boxes import AXES, axis_grid, extents
from latticeloom.session import cut_lineage

BLOCK = 16


def first_box(value: Column, start: Column, width: Column, stride: float) -> Column:
    """Least index of a box (closed at both ends) whose upper end is not below ``value``, 0 at the least."""
    near = F.ceil((value - width - start) / stride)
    reaches = lambda j: value <= start + j * stride + width
    return F.greatest(F.when(reaches(near - 1), near - 1).when(reaches(near), near).otherwise(near + 1), F.lit(0)).cast("int")


def last_box(value: Column, start: Column, n: Column, stride: float) -> Column:
    """Greatest index of a box whose lower end is not above ``value``, n - 1 at the most."""
    near = F.floor((value - start) / stride)
    begins = lambda j: value >= start + j * stride
    return F.least(F.when(begins(near + 1), near + 1).when(begins(near), near).otherwise(near - 1), n - 1).cast("int")


def size_grids(ends: DataFrame, sizes: DataFrame, stride: Sequence[float], padding_ratio: Sequence[float] | None = None,
               source: str = "source") -> DataFrame:
    """Grid ``start_a, n_a`` of each row ``(source, size_id, width_x, width_y, width_z)`` of ``sizes``."""
    grid = ends.join(sizes, source)
    out = [F.col(source), F.col("size_id"), *[F.col(f"width_{a}") for a in AXES]]
    for a, s, r in zip(AXES, map(float, stride), padding_ratio or (0.0, 0.0, 0.0)):
        w = F.col(f"width_{a}")
        start, n = axis_grid(F.col(f"lo_{a}"), F.col(f"hi_{a}"), w, s, w * float(r))
        out += [start.alias(f"start_{a}"), n.cast("int").alias(f"n_{a}")]
    return grid.select(*out)


def _block_histogram(keys: tuple, cells: pa.Table) -> pa.Table:
    """Boxes of one block by population: rows ``(n_atoms, n)``."""
    first = np.stack([cells[f"f_{a}"].to_numpy() for a in AXES])
    last = np.stack([cells[f"l_{a}"].to_numpy() for a in AXES])
    sizes = [int(cells[f"b_{a}"][0].as_py()) for a in AXES]
    count = cells["c"].to_numpy()
    grid = np.zeros([s + 1 for s in sizes], dtype=np.int64)
    for corner in range(8):
        ends = [corner >> i & 1 for i in range(3)]
        at = tuple(np.where(e, last[i] + 1, first[i]) for i, e in enumerate(ends))
        np.add.at(grid, at, count if sum(ends) % 2 == 0 else -count)
    for axis in range(3):
        np.cumsum(grid, axis=axis, out=grid)
    found, boxes = np.unique(grid[:sizes[0], :sizes[1], :sizes[2]], return_counts=True)
    return pa.table({"source": pa.array([keys[0].as_py()] * len(found), pa.string()),
                     "size_id": pa.array([keys[1].as_py()] * len(found), pa.int32()),
                     "n_atoms": pa.array(found, pa.int64()), "n": pa.array(boxes, pa.int64())})


def population_histograms(atoms: DataFrame, sizes: DataFrame, stride: Sequence[float], padding_ratio: Sequence[float] | None = None,
                          source: str = "source", ends: DataFrame | None = None) -> DataFrame:
    """``(source, size_id, n_atoms, n)``: how many boxes of each size hold how many atoms, empty boxes included.

    ``sizes`` has rows ``(source, size_id int, width_x, width_y, width_z)``, a bounded number for each source. The atoms are
    read once, whatever the number of sizes, and counted by cell before the shuffle. Null coordinates lie in no box; a null
    source is none.
    """
    ends = cut_lineage(extents(atoms, source)) if ends is None else ends
    grids = cut_lineage(size_grids(ends, sizes, stride, padding_ratio, source)).withColumnRenamed(source, "source")
    located = atoms.select(F.col(source).cast("string").alias("source"), *AXES).dropna()
    placed = lookup_join(located, grids, "source")
    for a, s in zip(AXES, map(float, stride)):
        at, start = F.col(a), F.col(f"start_{a}")
        placed = (placed.withColumn(f"f_{a}", first_box(at, start, F.col(f"width_{a}"), s))
                  .withColumn(f"l_{a}", last_box(at, start, F.col(f"n_{a}"), s)))
    corners = [f"{e}_{a}" for a in AXES for e in "fl"]
    placed = placed.where(" AND ".join(f"f_{a} <= l_{a}" for a in AXES))
    cells = placed.groupBy("source", "size_id", *[f"n_{a}" for a in AXES], *corners).agg(F.count(F.lit(1)).alias("c"))
    for a in AXES:
        low, block = F.col(f"k_{a}") * BLOCK, F.explode(F.sequence(F.floor(F.col(f"f_{a}") / BLOCK).cast("int"), F.floor(F.col(f"l_{a}") / BLOCK).cast("int")))
        cells = (cells.withColumn(f"k_{a}", block)
                 .withColumn(f"f_{a}", (F.greatest(F.col(f"f_{a}"), low) - low).cast("int"))
                 .withColumn(f"l_{a}", (F.least(F.col(f"l_{a}"), low + BLOCK - 1) - low).cast("int"))
                 .withColumn(f"b_{a}", F.least(F.col(f"n_{a}") - low, F.lit(BLOCK)).cast("int")))
    block = [f"k_{a}" for a in AXES]
    # cells of one clipped cuboid are one row again, so a block has a bounded number of rows
    clipped = cells.groupBy("source", "size_id", *block, *corners, *[f"b_{a}" for a in AXES]).agg(F.sum("c").alias("c"))
    counted = (clipped.groupBy("source", "size_id", *block)
               .applyInArrow(_block_histogram, "source string, size_id int, n_atoms long, n long")
               .groupBy("source", "size_id", "n_atoms").agg(F.sum("n").alias("n")))
    counted = cut_lineage(counted)
    boxes = grids.select("source", "size_id", F.lit(0).cast("long").alias("n_atoms"),
                         (F.col("n_x").cast("long") * F.col("n_y") * F.col("n_z")).alias("n"))
    seen = counted.select("source", "size_id", F.lit(0).cast("long").alias("n_atoms"), (-F.col("n")).alias("n"))
    every = counted.unionByName(boxes).unionByName(seen)
    return (every.groupBy("source", "size_id", "n_atoms").agg(F.sum("n").alias("n")).where("n > 0")
            .withColumnRenamed("source", source))


def histogram_quantile(hist: DataFrame, prob: float, group: Sequence[str], name: str, value: str = "n_atoms", n: str = "n") -> DataFrame:
    """Quantile with linear interpolation of each group's values, of which ``hist`` has each once with its number.

    A group has one row per distinct value, so the window over it is short.
    """
    per = Window.partitionBy(*group)
    place = (F.sum(n).over(per) - 1) * float(prob)
    rows = hist.select(*group, F.col(value).alias("_v"), F.sum(n).over(per.orderBy(value)).alias("_end"), place.alias("_at"))
    low = F.min(F.when(F.col("_end") > F.floor("_at"), F.col("_v")))
    high = F.min(F.when(F.col("_end") > F.ceil("_at"), F.col("_v")))
    part = F.first(F.col("_at") - F.floor("_at"))
    return rows.groupBy(*group).agg((low + (high - low) * part).cast("double").alias(name))


def typical_populations(hist: DataFrame, cutoff_percentile: float = 20.0, source: str = "source") -> DataFrame:
    """``(source, size_id, n_typical)``: median population of the boxes above the cutoff percentile of their size."""
    group = [source, "size_id"]
    low = histogram_quantile(hist, cutoff_percentile / 100.0, group, "_cut")
    return histogram_quantile(hist.join(low, group).where(F.col("n_atoms") > F.col("_cut")), 0.5, group, "n_typical")


def _steps(rows: DataFrame, start: Sequence[float], step: float, lo: Column, hi: Column, source: str) -> DataFrame:
    """Sizes ``start`` + size_id * ``step`` for size_id from ``lo`` to ``hi``, as far as the widths are positive."""
    numbered = rows.where(lo <= hi).select(source, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("size_id"))
    widths = [F.lit(float(v)) + F.col("size_id") * float(step) for v in start]
    out = numbered.select(source, "size_id", *[w.alias(f"width_{a}") for a, w in zip(AXES, widths)])
    return out.where(" AND ".join(f"width_{a} > 0" for a in AXES))


def optimal_box_sizes(atoms: DataFrame, start: Sequence[float], target_atoms: int = 128, up_tolerance: int = 80,
                      down_tolerance: int = 30, max_iter: int = 100, step: float = 0.1, stride: Sequence[float] = (6.0, 6.0, 20.0),
                      cutoff_percentile: float = 20.0, padding_ratio: Sequence[float] | None = None,
                      source: str = "source") -> DataFrame:
    """``(source, size_id, width_x, width_y, width_z, n_typical)`` for every source: its box size, by growing or shrinking.

    From ``start`` a source's box grows or shrinks by ``step``, as its typical population is at most the target or above it,
    until n - up_tolerance <= target <= n + down_tolerance. A source whose steps lead back before that, or for which
    ``max_iter`` sizes are not enough, has nulls. All sizes of all sources are counted in two passes: the start sizes,
    then every size in the direction that these give.
    """
    ends = cut_lineage(extents(atoms, source))

    def tried(lo: Column, hi: Column, rows: DataFrame) -> DataFrame:
        sizes = _steps(rows, start, step, lo, hi, source)
        found = typical_populations(population_histograms(atoms, sizes, stride, padding_ratio, source, ends), cutoff_percentile, source)
        return sizes.join(found, [source, "size_id"], "left").withColumn("n_typical", F.coalesce("n_typical", F.lit(0.0)))

    n = F.col("n_typical")
    fits, grows = (n - up_tolerance <= target_atoms) & (F.lit(target_atoms) <= n + down_tolerance), n <= target_atoms
    first = cut_lineage(tried(F.lit(0), F.lit(0), ends).withColumn("_fits", fits).withColumn("_grows", grows))
    most = max_iter - 1
    rest = first.where(~F.col("_fits")).select(source, "_grows")
    lo, hi = (F.when(F.col("_grows"), g).otherwise(s) for g, s in ((F.lit(1), F.lit(-most)), (F.lit(most), F.lit(-1))))
    further = tried(lo, hi, rest).join(rest.withColumnRenamed("_grows", "_up"), source)
    far = F.abs("size_id")
    further = further.withColumn("_fits", fits).withColumn("_back", ~fits & (grows != F.col("_up")))
    ended = further.groupBy(source).agg(
        F.min(F.when(F.col("_fits"), F.struct(far.alias("far"), "size_id", *[f"width_{a}" for a in AXES], "n_typical"))).alias("_hit"),
        F.min(F.when(F.col("_back"), far)).alias("_turn"))
    hit = ended.where(F.col("_hit").isNotNull() & (F.col("_turn").isNull() | (F.col("_hit.far") < F.col("_turn"))))
    names = ["size_id", *[f"width_{a}" for a in AXES], "n_typical"]
    chosen = first.where("_fits").select(source, *names).unionByName(hit.select(source, *[F.col(f"_hit.{c}") for c in names]))
    return ends.select(source).join(chosen, source, "left")


def grown_box_sizes(atoms: DataFrame, min_atoms: int = 100, step: float = 1.0, stride: Sequence[float] = (4.0, 4.0, 4.0),
                    max_iter: int = 1000, source: str = "source") -> DataFrame:
    """``(source, size, median, std)``: the first size i * ``step`` at which the median of a source's non-empty boxes is
    ``min_atoms`` or more, that median, and the deviation of all its counts; nulls where no size up to ``max_iter`` steps is.

    Sizes beyond a source's extent are not tried but for one, as a single box then holds all atoms. The first pass tries
    sizes up to a little above the one at which a box of mean density holds ``min_atoms``, a second pass the rest for the
    sources that need it.
    """
    ends = cut_lineage(atoms.groupBy(source).agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))],
                                                 F.count(F.lit(1)).alias("_n")))
    spans = [F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES]
    most = F.least(F.lit(max_iter), F.ceil(F.greatest(*spans) / step).cast("int") + 1)
    dense = F.cbrt(spans[0] * spans[1] * spans[2] * min_atoms / F.col("_n"))
    guess = F.least(most, F.ceil(1.25 * dense / step).cast("int") + 1)
    bounds = cut_lineage(ends.select(source, most.alias("_most"), guess.alias("_guess")))

    def tried(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
        sizes = _steps(rows, (0.0, 0.0, 0.0), step, lo, hi, source)
        hist = cut_lineage(population_histograms(atoms, sizes, stride, None, source, ends.drop("_n")))
        median = histogram_quantile(hist.where("n_atoms > 0"), 0.5, [source, "size_id"], "median")
        mean = F.sum(F.col("n") * F.col("n_atoms")) / F.sum("n")
        spread = F.sqrt(F.sum(F.col("n") * F.col("n_atoms") * F.col("n_atoms")) / F.sum("n") - mean * mean)
        return (hist.groupBy(source, "size_id").agg(spread.alias("std")).join(median, [source, "size_id"]).where(F.col("median") >= min_atoms)
                .groupBy(source).agg(F.min(F.struct("size_id", "median", "std")).alias("_hit")))

    first = cut_lineage(tried(bounds, F.lit(1), F.col("_guess")))
    rest = bounds.join(first, source, "left_anti").where(F.col("_guess") < F.col("_most"))
    found = first.unionByName(tried(rest, F.col("_guess") + 1, F.col("_most")))
    return ends.select(source).join(found, source, "left").select(
        source, (F.col("_hit.size_id") * float(step)).alias("size"), F.col("_hit.median").alias("median"), F.col("_hit.std").alias("std"))


def optimal_box_size(atoms: DataFrame, start: Sequence[float], target_atoms: int = 128, up_tolerance: int = 80,
                     down_tolerance: int = 30, max_iter: int = 100, step: float = 0.1, stride: Sequence[float] = (6.0, 6.0, 20.0),
                     cutoff_percentile: float = 20.0, padding_ratio: Sequence[float] | None = None,
                     source: str = "source") -> list[float]:
    """The size that ``optimal_box_sizes`` finds for the one source of ``atoms``; an error if none fits."""
    row = optimal_box_sizes(atoms, start, target_atoms, up_tolerance, down_tolerance, max_iter, step, stride, cutoff_percentile,
                            padding_ratio, source).first()
    if row is None or row["size_id"] is None:
        raise ValueError(f"no box size fits {target_atoms} atoms within {max_iter} steps of {step} from {list(start)}")
    return [row[f"width_{a}"] for a in AXES]


def grown_box_size(atoms: DataFrame, min_atoms: int = 100, step: float = 1.0, stride: Sequence[float] = (4.0, 4.0, 4.0),
                   max_iter: int = 1000, source: str = "source") -> tuple[float, float, float]:
    """Size, median and deviation that ``grown_box_sizes`` finds for the one source of ``atoms``; an error if none fits."""
    row = grown_box_sizes(atoms, min_atoms, step, stride, max_iter, source).first()
    if row is None or row["size"] is None:
        raise ValueError(f"no box up to {max_iter * step} holds {min_atoms} atoms")
    return row["size"], row["median"], row["std"]
