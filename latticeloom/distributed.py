"""Ordering, ranking and quantiles without any single-task step.

Row numbers over a whole table, or over a group that may hold a third of it,
cannot go through ``row_number().over(partitionBy(group))``: that puts the group
into one task. Here the rows are range-partitioned on (group, order) so a large
group spreads over many tasks, each task numbers its own rows, and only the
per-task counts (one row per task and group) are summed to find the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeloom.session import cut_lineage

# Value counts of at most this many rows are handled on the driver.
LOCAL_COUNTS = 20_000
# A lookup table is broadcast only after its row count was seen to be below this.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(df: DataFrame, dim: DataFrame, on, how: str = "inner",
                rows: int = BROADCAST_ROWS, once: bool = False) -> DataFrame:
    """Join with a lookup table: broadcast when proven small, else a shuffle join
    whose hot keys the adaptive planner splits.

    ``once`` is for a lookup table that is costly to form (an aggregate over the
    rows): it is written out first, so the size check does not compute it again.
    """
    if once:
        dim = cut_lineage(dim)
    return df.join(F.broadcast(dim) if is_small(dim, rows) else dim, on, how)


def bounded_rows(df: DataFrame, rows: int, what: str) -> list:
    """Collect a table that must be small by definition; refuse it otherwise."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"{what}: more than {rows} rows")
    return got


def _range_sorted(df: DataFrame, group: Sequence[str], order: Sequence) -> DataFrame:
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    return cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )


def _offsets(stats: DataFrame, group: Sequence[str], amount: str) -> DataFrame:
    # one row per (task, group): the window below is over task counts, not rows
    before = (Window.partitionBy(*(group or [F.lit(0)])).orderBy("_task")
              .rowsBetween(Window.unboundedPreceding, -1))
    return stats.withColumn("_offset", F.coalesce(F.sum(amount).over(before), F.lit(0)))


def row_index(df: DataFrame, order: Sequence, group: Sequence[str] = (),
              name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in its group under ``order``.

    ``order`` must break all ties (end it with a unique key); null is a group of its own.
    """
    group = list(group)
    sorted_rows = _range_sorted(df, group, order)
    stats = sorted_rows.groupBy(*group, "_task").agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(stats, group, "_n").drop("_n")
    names = [*group, "_task"]
    offsets = offsets.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(names)], "_first", "_offset")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(names)]
    return (sorted_rows.join(offsets, same).drop(*[f"_of_{i}" for i in range(len(names))])
            .withColumn(name, F.col("_seq") - F.col("_first") + F.col("_offset"))
            .drop("_task", "_seq", "_first", "_offset"))


def _digested(rows: DataFrame, digest: Column, group: Sequence[str], digits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_digest``, ``_bucket`` (its first hex digits) and ``_group`` (never null), and ``(_group, _bucket, _c, _n, _upto)``."""
    head = F.conv(F.substring("_digest", 1, digits), 16, 10).cast("int")
    marked = rows.select("*", digest.alias("_digest")).select(
        "*", head.alias("_bucket"), (F.struct(*group) if group else F.struct(F.lit(0))).alias("_group"))
    per = Window.partitionBy("_group")
    counts = marked.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select("*", F.sum("_c").over(per).alias("_n"), F.sum("_c").over(per.orderBy("_bucket")).alias("_upto"))
    return marked, cut_lineage(counts)


def hash_chosen(rows: DataFrame, digest: Column, order: Sequence, take: Column | DataFrame, group: Sequence[str] = (),
                name: str = "_chosen", digits: int = 3) -> DataFrame:
    """Add ``name``: whether a row is among the first ``take`` of its group by (``digest``, ``order``), a selection without a sort.

    ``digest`` is a string of hex digits, evenly spread over the rows; ``take`` an expression over ``_n``, the rows of the
    group, or a table ``(_group struct of the group columns, _take)``. Rows are counted by the first ``digits`` of their digest,
    at most 16^digits counts a group. Where the running count passes ``take`` lies one bucket per group: rows of
    smaller buckets are chosen, of larger ones not, and only the rows of that bucket are ranked. No other row is moved. Null is a
    group of its own. ``rows`` is read three times, so it should be cheap to read and must not change between.
    """
    marked, counts = _digested(rows, digest, group, digits)
    counts = lookup_join(counts, take, "_group") if isinstance(take, DataFrame) else counts.withColumn("_take", take)
    wanted = F.least(F.col("_take"), F.col("_n")).cast("long")
    before = F.col("_upto") - F.col("_c")
    cuts = (counts.where((before < wanted) & (F.col("_upto") >= wanted))
            .select("_group", F.col("_bucket").alias("_cut"), (wanted - before).alias("_need")))
    marked = lookup_join(marked, cuts, "_group", "left", once=True)
    at_cut = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    plain = marked.where(~at_cut).withColumn(name, F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)))
    ranked = row_index(marked.where(at_cut), ["_digest", *order], ["_group"], "_r").withColumn(name, F.col("_r") < F.col("_need"))
    return plain.select(*rows.columns, name).unionByName(ranked.select(*rows.columns, name))


def hash_rank(rows: DataFrame, digest: Column, order: Sequence, group: Sequence[str] = (), name: str = "row_index",
              digits: int = 4) -> DataFrame:
    """Add the 0-based position of each row in its group under (``digest``, ``order``).

    ``digest`` is a string of hex digits. Each of its first ``digits`` is a bucket, whose first position follows from the counts of
    the buckets before it; rows are ranked within their bucket, 1 of 16^digits of a group, so even one group spreads over all
    tasks in a single shuffle.
    """
    marked, counts = _digested(rows, digest, group, digits)
    first = counts.select("_group", "_bucket", (F.col("_upto") - F.col("_c")).alias("_first"))
    within = Window.partitionBy("_group", "_bucket").orderBy("_digest", *order)
    return (lookup_join(marked, first, ["_group", "_bucket"])
            .select(*rows.columns, (F.col("_first") + F.row_number().over(within) - 1).cast("long").alias(name)))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (),
              weight: str | None = None, local_counts: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(*group, prob, quantile)``.

    Equal values are counted before the shuffle (``weight`` gives the count of a
    row), so a value held by a third of the rows is one row. A short table of counts
    is finished at once; otherwise the distinct values are range-sorted and only
    those around the wanted ranks survive.
    """
    group = list(group)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = (df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v"))
              .agg(amount.alias("_c")))
    limit = LOCAL_COUNTS if local_counts is None else local_counts
    counts = cut_lineage(counts)
    few = counts.limit(limit + 1).toPandas() if limit else None
    if few is not None and len(few) <= limit:
        return _quantiles_of_counts(df, few, probs, group)
    ranged = _range_sorted(counts, group, ["_v"])
    stats = ranged.groupBy(*group, "_task").agg(F.sum("_c").alias("_n"))
    offsets = _offsets(stats, group, "_n")
    totals = stats.groupBy(*group).agg(F.sum("_n").alias("_total")) if group else None
    within = (Window.partitionBy(*group, "_task").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, 0))
    placed = (ranged.withColumn("_run", F.sum("_c").over(within))
              .join(offsets.drop("_n"), [*group, "_task"])
              .withColumn("_hi", F.col("_offset") + F.col("_run"))
              .withColumn("_lo", F.col("_hi") - F.col("_c")))
    if group:
        placed = placed.join(totals, group)
    else:
        total = stats.agg(F.sum("_n")).first()[0] or 0
        placed = placed.withColumn("_total", F.lit(total))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    pos = (F.col("_total") - 1) * F.col("prob")
    at = placed.select(*group, "_v", "_lo", "_hi", "_total", wanted).withColumn("_pos", pos)
    low, high = F.floor("_pos"), F.ceil("_pos")
    holds = lambda r: (F.col("_lo") <= r) & (r < F.col("_hi"))
    return (at.where(holds(low) | holds(high)).groupBy(*group, "prob", "_pos")
            .agg(F.max(F.when(holds(low), F.col("_v"))).alias("_a"),
                 F.max(F.when(holds(high), F.col("_v"))).alias("_b"))
            .select(*group, "prob",
                    (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos")))
                    .cast("double").alias("quantile")))


def _quantiles_of_counts(df: DataFrame, counts: pd.DataFrame, probs: Sequence[float],
                         group: list[str]) -> DataFrame:
    rows = []
    for name, part in (counts.groupby(group) if group else [((), counts)]):
        if not len(part):
            continue
        part = part.sort_values("_v")
        values, ends = part["_v"].to_numpy(dtype=float), part["_c"].to_numpy(dtype="int64").cumsum()
        for p in probs:
            at = (int(ends[-1]) - 1) * float(p)
            a, b = (values[np.searchsorted(ends, r, side="right")] for r in (math.floor(at), math.ceil(at)))
            rows.append((*name, float(p), float(a + (b - a) * (at - math.floor(at)))))
    schema = T.StructType([*[df.schema[g] for g in group], T.StructField("prob", T.DoubleType()),
                           T.StructField("quantile", T.DoubleType())])
    plain = [tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows]
    return df.sparkSession.createDataFrame(plain, schema)


def quantile_list(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles of one column as Python numbers, one per entry of ``probs``."""
    got = {r["prob"]: r["quantile"] for r in quantiles(df, value, probs).collect()}
    return [got.get(float(p)) for p in probs]


def pseudo_random_order(key: Column, seed: int) -> Column:
    """Seeded shuffle key that any engine can recompute (hex digest of key and seed)."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
