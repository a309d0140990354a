"""Predictions: uncertainty over repeated samples, class scores, accuracy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join, row_index
from latticeloom.functions.algebra import linspace_value
from latticeloom.functions.vectors import argmax

TINY = 1e-12


def committee_uncertainty(samples: DataFrame, n_classes: int, key: str = "id",
                          probs: str = "probs") -> DataFrame:
    """Mean class probabilities and uncertainty of repeated predictions.

    ``samples`` has one row per (key, sample) with an array of class
    probabilities. All measures come from one aggregation with map-side partial
    sums, so a key with very many samples is no hot spot.
    """
    p = lambda c: F.col(probs)[c]
    plogp = lambda x: F.greatest(x, F.lit(TINY)) * F.log2(F.greatest(x, F.lit(TINY)))
    winner = argmax(F.col(probs))
    sums = samples.select(key, probs, winner.alias("_w")).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[F.avg(p(c)).alias(f"_m{c}") for c in range(n_classes)],
        *[F.count_if(F.col("_w") == c).alias(f"_v{c}") for c in range(n_classes)],
        F.sum(sum((plogp(p(c)) for c in range(1, n_classes)), plogp(p(0)))).alias("_plogp"),
    )
    mean = F.array(*[F.col(f"_m{c}") for c in range(n_classes)])
    mode = F.greatest(*[F.col(f"_v{c}") for c in range(n_classes)]) if n_classes > 1 else F.col("_v0")
    entropy = -sum((plogp(F.col(f"_m{c}")) for c in range(1, n_classes)), plogp(F.col("_m0")))
    return sums.select(
        key, "n_samples", mean.alias("mean_probs"),
        (1 - mode / F.col("n_samples")).alias("variation_ratio"),
        entropy.alias("predictive_entropy"),
        (entropy + F.col("_plogp") / F.col("n_samples")).alias("mutual_information"))


def predictive_mean(samples: DataFrame, key: str = "id", cls: str = "class_id",
                    p: str = "p") -> DataFrame:
    """Mean probability per row and class of a long (key, sample, class, p) table."""
    return samples.groupBy(key, cls).agg(F.avg(p).alias("mean_p"))


def predictive_variance(samples: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    return samples.groupBy(key).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def top_classes(df: DataFrame, probs: str, n: int = 3, classes: DataFrame | None = None) -> DataFrame:
    """The ``n`` most probable classes per row, best first (ties: lower class first).

    The probabilities of a row are already together in its array, so this needs
    no shuffle; class names come from a broadcast ``classes(class_id, class_name)``.
    """
    scored = F.transform(F.col(probs), lambda p, i: F.struct((-p).alias("neg"), i.alias("class_id")))
    best = F.slice(F.array_sort(scored), 1, n)
    out = df.select("*", F.posexplode(best).alias("_pos", "_best")).select(
        *df.columns, (F.col("_pos") + 1).alias("rank"), F.col("_best.class_id").alias("class_id"),
        (-F.col("_best.neg")).alias("p"))
    return out if classes is None else lookup_join(out, classes, "class_id", "left")


def predicted_class(df: DataFrame, probs: str, out: str = "target_pred_class") -> DataFrame:
    return df.withColumn(out, argmax(F.col(probs)))


def result_table(df: DataFrame, probs: str, n_classes: int, label: str, text_label: str,
                 uncertainties: Mapping[str, str], key: str | None = None) -> DataFrame:
    """Predicted class, one probability column per class, labels, uncertainties."""
    return df.select(
        *([key] if key else []), argmax(F.col(probs)).alias("target_pred_class"),
        *[F.col(probs)[c].alias(f"prob_predictions_{c}") for c in range(n_classes)],
        F.col(label).alias("num_labels"), F.col(text_label).alias("class_labels"),
        *[F.col(c).alias(f"uncertainty_{name}") for name, c in uncertainties.items()])


# --- accuracy ----------------------------------------------------------------

def confusion_matrix(df: DataFrame, truth: str, predicted: str, normalize: bool = False) -> DataFrame:
    """Long confusion matrix; ``normalize`` divides by the row total.

    The total per true class is found from the counts, not from the rows.
    """
    counts = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counts
    totals = counts.groupBy(truth).agg(F.sum("n").alias("_t"))
    return counts.join(totals, truth).select(truth, predicted, "n", (F.col("n") / F.col("_t")).alias("share"))


def confusion_pivot(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    return df.groupBy(truth).agg(*[F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in classes])


def accuracy_by_configuration(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One accuracy per named (truth, prediction) column pair, in one scan."""
    r = df.agg(*[F.avg((F.col(t) == F.col(p)).cast("double")).alias(n) for n, (t, p) in pairs.items()])
    return r.select(F.explode(F.create_map(*[x for n in pairs for x in (F.lit(n), F.col(n))]))
                    .alias("configuration", "accuracy"))


def cross_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def correctly_identified(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.where(F.col(truth) == F.col(predicted))


def benchmark_accuracy(df: DataFrame, method: str, defect: str, truth: str, predicted: str,
                       designed: Column) -> DataFrame:
    """Accuracy per method and defect level over all classes and over the designed ones."""
    ok = (F.col(truth) == F.col(predicted)).cast("double")
    return df.groupBy(method, defect).agg(
        F.round(F.avg(ok), 4).alias("accuracy_all"),
        F.round(F.avg(F.when(designed, ok)), 4).alias("accuracy_designed"))


def transition_aggregate(df: DataFrame, position: str, values: Sequence[str], nb_samples: int,
                         nb_steps: int, lowest: float = 0.0, highest: float = 1.0,
                         rows_to_cut: int = 0) -> DataFrame:
    """Mean and sample deviation of columns over consecutive blocks of rows.

    After ``rows_to_cut`` rows in ``position`` order, every ``nb_samples`` rows
    belong to the next of ``nb_steps`` evenly spaced order-parameter values. The
    rows must fill the blocks exactly.
    """
    placed = (row_index(df.select(position, *values), [position], name="_i")
              .where(F.col("_i") >= rows_to_cut))
    block = F.floor((F.col("_i") - rows_to_cut) / nb_samples)
    value = linspace_value(block, lowest, highest, nb_steps)
    spread = placed.groupBy(block.alias("step")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    n_steps, smallest = spread.agg(F.count(F.lit(1)), F.min("_n")).first()
    if n_steps != nb_steps or smallest != nb_samples:
        raise ValueError(f"{nb_steps} blocks of {nb_samples} rows needed, found {n_steps} blocks, "
                         f"the smallest with {smallest} rows")
    return spread.drop("_n").withColumn("a_to_b_index",
                                        linspace_value(F.col("step"), lowest, highest, nb_steps))


def top_filters(activations: DataFrame, n: int, image: str = "img", channel: str = "filter",
                value: str = "v") -> DataFrame:
    """The ``n`` filters of each image with the largest summed activation."""
    score = activations.groupBy(image, channel).agg(F.sum(value).alias("score"))
    # a row_number filter runs as a partial group limit in the map tasks, so at most
    # n rows per image and task are shuffled
    order = Window.partitionBy(image).orderBy(F.col("score").desc(), F.col(channel))
    return score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def absolute_error(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.withColumn("abs_error", F.abs(F.col(truth) - F.col(predicted)))
