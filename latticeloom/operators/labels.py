"""Labels: extraction, relabelling, encoding, discretisation, splits, batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import (
    bounded_rows, hash_chosen, hash_rank, lookup_join, pseudo_random_order, quantile_list, row_index)
from latticeloom.functions.vectors import one_hot

MAX_COLUMNS = 5_000


# --- reading labels out of records -------------------------------------------

def record_field(df: DataFrame, record: str, key: str) -> Column:
    """Field ``key`` of a JSON record column, with the valid names in the error."""
    if key not in df.columns and record not in df.columns:
        raise KeyError(f"no column {record!r}; valid names: {df.columns}")
    return F.get_json_object(F.col(record), f"$.{key}")


def first_frame_field(df: DataFrame, frames: str, key: str) -> Column:
    """``frames[0].key`` of an array of structs; an unknown key lists the valid ones."""
    names = df.schema[frames].dataType.elementType.fieldNames()
    if key not in names:
        raise KeyError(f"{key!r} is not a target; valid names: {names}")
    return F.get(F.col(frames), F.lit(0))[key]


def clean_name(column: str, key: str) -> str:
    """Column name for one map key: brackets and commas removed, blanks to ``_``."""
    for mark in "(),":
        key = key.replace(mark, "")
    return f"{column}_{key}".replace(" ", "_")


def expand_map(df: DataFrame, column: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Replace a map column by one column per key."""
    if keys is None:
        found = df.select(F.explode(F.map_keys(column)).alias("k")).distinct()
        keys = sorted(r["k"] for r in bounded_rows(found, MAX_COLUMNS, f"keys of {column}"))
    return df.select(*[c for c in df.columns if c != column],
                     *[F.col(column)[k].alias(clean_name(column, k)) for k in keys])


def relabel(label: Column, new_labels: Mapping[str, Sequence[str]]) -> Column:
    """Merge labels under new names, rule by rule in the given order."""
    out = label.cast("string")
    for name, members in new_labels.items():
        out = F.when(out.isin([str(m) for m in members]), F.lit(name)).otherwise(out)
    return out


def default_labels(structures: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """If any label is missing, all become ``struct-<position>``."""
    missing = structures.where(F.col(label).isNull()).limit(1).count() > 0
    if not missing:
        return structures
    return (row_index(structures, order, name="_i")
            .withColumn(label, F.concat(F.lit("struct-"), F.col("_i"))).drop("_i"))


# --- encoding ----------------------------------------------------------------

def class_populations(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_classes(df: DataFrame, label: str, code: str = "class_id") -> DataFrame:
    """Sorted distinct labels numbered from 0."""
    known = df.where(F.col(label).isNotNull()).select(label).distinct()
    return (row_index(known, [label], name=code)
            .withColumn(code, F.col(code).cast("int")))


def encode_labels(df: DataFrame, label: str, code: str = "class_id") -> DataFrame:
    return lookup_join(df, label_classes(df, label, code), label, "left", once=True)


# --- discretisation ----------------------------------------------------------

def value_range(df: DataFrame, value: str) -> tuple[float, float]:
    r = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    return r["lo"], r["hi"]


def evenly_spaced(lo: float, hi: float, count: int) -> list[float]:
    if count == 1:
        return [lo]
    step = (hi - lo) / (count - 1)
    return [lo + i * step for i in range(count - 1)] + [hi]


def edges_passed(value: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending ``edges`` are at or below ``value``; null for null."""
    fixed = F.array(*[F.lit(float(e)) for e in edges])
    return F.when(value.isNotNull(), F.size(F.filter(fixed, lambda e: e <= value)))


def uniform_bin(value: Column, lo: float, hi: float, n_edges: int) -> Column:
    """As ``edges_passed`` for evenly spaced edges, in closed form."""
    if n_edges == 1 or lo == hi:
        return F.when(value >= hi, F.lit(n_edges)).when(value.isNotNull(), F.lit(0))
    step = (hi - lo) / (n_edges - 1)
    edge = lambda i: F.lit(lo) + i * F.lit(step)
    guess = F.floor((value - F.lit(lo)) / F.lit(step))
    fixed = (guess - F.when(edge(guess) > value, 1).otherwise(0)
             + F.when(edge(guess + 1) <= value, 1).otherwise(0))
    return (F.when(value >= F.lit(hi), F.lit(n_edges))
            .when(value.isNotNull(), F.least(F.lit(n_edges - 1), fixed + 1)).cast("int"))


def discretise_uniform(df: DataFrame, value: str, n_bins: int, out: str = "bin") -> DataFrame:
    lo, hi = value_range(df, value)
    return df.withColumn(out, uniform_bin(F.col(value), lo, hi, n_bins))


def quantile_edges(df: DataFrame, value: str, n_bins: int) -> list[float]:
    edges = quantile_list(df, value, [i / n_bins for i in range(n_bins + 1)])
    if len(set(edges)) < len(edges):
        raise ValueError(f"{n_bins} quantile edges of {value} are not unique")
    return [*edges[:-1], edges[-1] + 1e-7]


def discretise_quantiles(df: DataFrame, value: str, n_bins: int, out: str = "bin") -> DataFrame:
    return df.withColumn(out, edges_passed(F.col(value), quantile_edges(df, value, n_bins)))


def bin_frequencies(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Count per bin between ``edges``; the last bin includes its right edge."""
    n = len(edges) - 1
    v = F.col(value)
    counted = (df.where(v.between(F.lit(float(edges[0])), F.lit(float(edges[-1]))))
               .groupBy(F.least(edges_passed(v, edges), F.lit(n)).alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    left, right = (F.array(*[F.lit(float(e)) for e in part]) for part in (edges[:-1], edges[1:]))
    every = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("bin"))
    return (every.join(F.broadcast(counted), "bin", "left")
            .select("bin", left[F.col("bin") - 1].alias("left_edge"),
                    right[F.col("bin") - 1].alias("right_edge"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def adaptive_quantile_bins(df: DataFrame, value: str, most: int = 5) -> tuple[DataFrame, list[float]]:
    """0-based quantile bin for colouring, with the largest count of quantiles
    (at most ``most``) whose edges are unique."""
    probs = sorted({i / k for k in range(1, most + 1) for i in range(k + 1)})
    at = dict(zip(probs, quantile_list(df, value, probs)))
    for k in range(most, 0, -1):
        edges = [at[i / k] for i in range(k + 1)]
        if len(set(edges)) == len(edges):
            inner = F.array(*[F.lit(e) for e in edges[1:-1]]) if k > 1 else F.array().cast("array<double>")
            # intervals are open on the left, except the first
            color = F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value))))
            return df.withColumn("color_bin", color), edges
    raise ValueError(f"{value} is constant: no quantile colours")


# --- splits and batches ------------------------------------------------------

def _holdout_size(n: int, test_size: float | int) -> int:
    return test_size if isinstance(test_size, int) else int(round(n * test_size))


def split_rows(df: DataFrame, key: str, test_size: float | int, label: str | None = None,
               seed: int = 42) -> DataFrame:
    """Add ``split`` = ``train`` / ``validation``; stratified when ``label`` is given.

    A class quota is its share of the held-out rows rounded down; the rows still
    missing go to the classes with the largest remainders. Rows without a class are a class of their own.
    """
    total = df.count()
    held = _holdout_size(total, test_size)
    shuffled = pseudo_random_order(F.col(key), seed)
    if label is None:
        chosen = hash_chosen(df, shuffled, [key], F.lit(held), name="_held")
    else:
        exact = F.col("n") * F.lit(held) / F.lit(float(total))
        # a struct is never null, so rows without a class find their quota too
        quota = (class_populations(df.withColumn("_group", F.struct(label)), "_group").withColumn("_floor", F.floor(exact))
                 .withColumn("_rest", -(exact - F.floor(exact))))
        short = held - (quota.agg(F.sum("_floor")).first()[0] or 0)
        quota = (row_index(quota, ["_rest", "_group"], name="_q")
                 .select("_group", (F.col("_floor") + F.when(F.col("_q") < short, 1).otherwise(0)).alias("_take")))
        chosen = hash_chosen(df, shuffled, [key], quota, [label], "_held")
    return chosen.withColumn("split", F.when(F.col("_held"), "validation").otherwise("train")).drop("_held")


def batch_ids(df: DataFrame, key: str, batch_size: int, shuffle: bool = False,
              seed: int = 42) -> DataFrame:
    """Fixed-size batches in key order or shuffled; the last one may be shorter."""
    if shuffle:
        ranked = hash_rank(df, pseudo_random_order(F.col(key), seed), [key], name="_r")
    else:
        ranked = row_index(df, [key], name="_r")
    return ranked.withColumn("batch", F.floor(F.col("_r") / batch_size)).drop("_r")


# --- labels end to end ---------------------------------------------------------

def extract_labels(df: DataFrame, target: str, categorical: bool = True, disc_type: str = "uniform",
                   n_bins: int = 100, new_labels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Add ``text_label`` and ``class_id`` for one target column."""
    if target not in df.columns:
        raise KeyError(f"{target!r} is not a target; valid names: {df.columns}")
    if categorical:
        named = df.withColumn("text_label", F.col(target).cast("string"))
    elif disc_type == "uniform":
        named = discretise_uniform(df, target, n_bins, "text_label")
    elif disc_type == "quantiles":
        named = discretise_quantiles(df, target, n_bins, "text_label")
    else:
        raise ValueError(f"disc_type {disc_type!r} is neither 'uniform' nor 'quantiles'")
    if new_labels:
        named = named.withColumn("text_label", relabel(F.col("text_label"), new_labels))
    return encode_labels(named, "text_label")


def merge_labels(features: DataFrame, targets: DataFrame, key: str, target: str, *,
                 one_hot_labels: bool = False, test_size: float | int | None = None,
                 stratified: bool = True, seed: int = 42, **label_options) -> DataFrame:
    """Feature rows with their labels; optionally one-hot and split."""
    labels = extract_labels(targets.select(key, target), target, **label_options)
    out = features.join(labels, key)
    if one_hot_labels:
        top = labels.agg(F.max("class_id")).first()[0]
        out = out.withColumn("one_hot", one_hot(F.col("class_id"), top + 1))
    if test_size is not None:
        out = split_rows(out, key, test_size, "class_id" if stratified else None, seed)
    return out
