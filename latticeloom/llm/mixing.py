"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells, one for each combination of source, language and topic that occurs. The token weights of the
cells are raked: in turn, for each margin, every cell is multiplied by (target share / present share) of its value. After
``rounds`` turns the margins agree with the targets as far as the occupied cells allow. A document's inclusion probability
is min(1, k * raked share / token share) of its cell, with the one k that makes the expected tokens ``fraction`` of all
tokens; a document stays if a hash of its id, as a number in [0, 1), is below it.

Only DataFrame functions are used. Cells are aggregated before anything else, so a source with a third of the rows is a few
rows; the tables of the fit have one row per cell.

Targets: for each margin, a mapping from value to weight, or a number t: then the weight of a value is (its tokens)^t.
Values that a mapping lacks weigh ``rest``. Weights are brought to the sum 1 over the values that occur.

Defined cases: null source, language or topic is the value ``(none)``. A null or empty text has no tokens, and its
document the probability of its cell; a cell without any token has probability 1. Rows with equal ids share their fate;
null ids count as the empty id. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeloom.session import cut_lineage

#: Cell tables of at most this many rows (each three short strings and a few numbers) are broadcast.
BROADCAST_CELLS = 50_000
NONE = "(none)"


def token_estimate(text: str = "text") -> Column:
    """Four UTF-8 bytes a token, rounded up."""
    return F.floor((F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 3) / 4).cast("long")


def topic_by_markers(rules: Mapping[str, list[str]], text: str = "text", default: str = "prose") -> Column:
    """The first topic of which the text holds a marker string."""
    held = lambda marks: reduce(lambda a, b: a | b, [F.col(text).contains(m) for m in marks])
    topic = F.lit(default)
    for name, marks in reversed(list(rules.items())):
        topic = F.when(held(marks), F.lit(name)).otherwise(topic)
    return topic


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash, which any engine can form."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _weights(cells: DataFrame, margin: str, target: Mapping[str, float] | float, rest: float) -> DataFrame:
    """Add the normalised target share of each cell's value of ``margin`` as ``_t_<margin>``."""
    if isinstance(target, Mapping):
        per_value = reduce(lambda a, kv: F.when(F.col(margin) == kv[0], F.lit(float(kv[1]))).otherwise(a),
                           target.items(), F.lit(float(rest)))
    else:
        per_value = F.pow(F.sum("tokens").over(Window.partitionBy(margin)).cast("double"), F.lit(float(target)))
    shared = per_value / F.count(F.lit(1)).over(Window.partitionBy(margin))
    named = cells.withColumn("_w", per_value).withColumn("_s", shared)
    total = named.agg(F.sum("_s")).first()[0] or 1.0
    return named.withColumn(f"_t_{margin}", F.col("_w") / F.lit(float(total))).drop("_w", "_s")


def raked_cells(cells: DataFrame, margins: list[str], targets: Mapping[str, Mapping[str, float] | float], rounds: int,
                rest: float) -> DataFrame:
    """``cells`` (margins and ``tokens`` > 0) with the raked share ``share``."""
    for margin in margins:
        cells = _weights(cells, margin, targets[margin], rest)
    cells = cells.withColumn("share", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for margin in margins:
            present = F.sum("share").over(Window.partitionBy(margin))
            cells = cells.withColumn("share", F.col("share") * F.col(f"_t_{margin}") / present)
        cells = cut_lineage(cells)
    return cells


def inclusion(cells: DataFrame, fraction: float) -> DataFrame:
    """Add ``probability`` = min(1, k * share / tokens); k fills ``fraction`` of the tokens."""
    rated = cells.withColumn("_rate", F.col("share") / F.col("tokens"))
    order = Window.orderBy(F.desc("_rate"))                     # one row per distinct rate
    rates = rated.groupBy("_rate").agg(F.sum("tokens").alias("_n"), F.sum("share").alias("_m"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = rates.agg(F.sum("_n"), F.sum("_m")).first()
    total, mass = float(sums[0] or 0), float(sums[1] or 0)
    # with all higher rates at probability 1, k = (budget - their tokens) / (share of the rest)
    k = ((F.lit(fraction * total) - F.coalesce(F.sum("_n").over(before), F.lit(0)))
         / (F.lit(mass) - F.coalesce(F.sum("_m").over(before), F.lit(0.0))))
    fits = rates.withColumn("_k", k).where(F.col("_k") * F.col("_rate") <= 1.0 + 1e-12)
    best = fits.agg(F.max_by("_k", "_rate")).first()[0]
    scale = F.lit(float(best)) * F.col("_rate") if best is not None else F.lit(1.0)
    return rated.withColumn("probability", F.least(F.lit(1.0), scale)).drop("_rate")


def mix_sources(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], topic: Column, fraction: float = 0.5,
                source: str = "source", lang: str = "lang", text: str = "text", id_col: str = "doc_id", rounds: int = 12,
                rest: float = 0.05, seed: int = 11) -> DataFrame:
    """The documents that stay, with ``_source``, ``_lang``, ``_topic``, ``_tokens`` and ``_probability`` added.

    ``targets`` has the keys ``source``, ``lang`` and ``topic``; ``topic`` is any expression over the columns.
    """
    margins = ["_source", "_lang", "_topic"]
    value = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    marked = docs.withColumns({"_source": value(F.col(source)), "_lang": value(F.col(lang)), "_topic": value(topic),
                               "_tokens": token_estimate(text)})
    cells = cut_lineage(marked.groupBy(*margins).agg(F.sum("_tokens").alias("tokens")))
    raked = raked_cells(cells.where(F.col("tokens") > 0), margins, {f"_{k}": v for k, v in targets.items()}, rounds, rest)
    chosen = inclusion(raked, fraction).select(*margins, F.col("probability").alias("_probability"))
    small = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    placed = marked.join(F.broadcast(chosen) if small else chosen, margins, "left")
    placed = placed.withColumn("_probability", F.coalesce("_probability", F.lit(1.0)))
    return placed.where(uniform(F.col(id_col), seed) < F.col("_probability"))


def margin_report(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], topic: Column, fraction: float = 0.5,
                  source: str = "source", lang: str = "lang", text: str = "text", rounds: int = 12, rest: float = 0.05) -> DataFrame:
    """How far the targets are reached: ``(margin, value, target, raked, expected, shortfall)``.

    ``raked`` is the share of a value in the raked weights, ``expected`` its share of the tokens that the inclusion probabilities
    keep on average, where no document can be kept more than once; ``shortfall`` is what that lacks of the target, 0 or more. A
    value that its cells cannot fill shows as a shortfall; a raked share off its target tells that the rounds were too few
    or that no weights of the occupied cells meet all targets.
    """
    margins = ["_source", "_lang", "_topic"]
    value = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    marked = docs.select(value(F.col(source)).alias("_source"), value(F.col(lang)).alias("_lang"), value(topic).alias("_topic"),
                         token_estimate(text).alias("_tokens"))
    cells = cut_lineage(marked.groupBy(*margins).agg(F.sum("_tokens").alias("tokens")).where("tokens > 0"))
    raked = inclusion(raked_cells(cells, margins, {f"_{k}": v for k, v in targets.items()}, rounds, rest), fraction)
    raked = cut_lineage(raked.withColumn("_kept", F.col("tokens") * F.col("probability")))
    out = None
    for margin in margins:
        part = raked.groupBy(F.col(margin).alias("value")).agg(F.first(f"_t_{margin}").alias("target"), F.sum("share").alias("_r"), F.sum("_kept").alias("_k"))
        whole = raked.agg(F.sum("share").alias("_ar"), F.sum("_kept").alias("_ak"))
        part = part.join(F.broadcast(whole)).select(                      # one row of totals
            F.lit(margin[1:]).alias("margin"), "value", "target", F.try_divide("_r", "_ar").alias("raked"), F.try_divide("_k", "_ak").alias("expected"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("shortfall", F.greatest(F.col("target") - F.col("expected"), F.lit(0.0)))


def mixing_sql(targets: Mapping[str, Mapping[str, float] | float], topic_rules: Mapping[str, list[str]], fraction: float,
               rounds: int = 12, rest: float = 0.05, seed: int = 11, documents: str = "documents",
               default: str = "prose") -> str:
    """The same as SQL: ``doc_id, source, lang, topic, n_tokens, probability`` of the documents that stay."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    topic = " ".join(f"WHEN {' OR '.join(f'contains(text, {text(m)})' for m in marks)} THEN {text(name)}"
                     for name, marks in topic_rules.items())
    parts = [f"""marked AS (SELECT *, coalesce(source, '{NONE}') AS s, coalesce(lang, '{NONE}') AS l,
        CASE {topic} ELSE {text(default)} END AS t, (strlen(coalesce(text, '')) + 3) // 4 AS n FROM {documents})""",
             "cells AS (SELECT s, l, t, CAST(sum(n) AS BIGINT) AS tokens FROM marked GROUP BY ALL HAVING sum(n) > 0)"]
    for margin, key in (("s", "source"), ("l", "lang"), ("t", "topic")):
        target = targets[key]
        weight = ("CASE " + " ".join(f"WHEN v = {text(k)} THEN {float(w)}" for k, w in target.items()) + f" ELSE {float(rest)} END"
                  if isinstance(target, Mapping) else f"pow(CAST(n AS DOUBLE), {float(target)})")
        parts.append(f"""w_{margin} AS (SELECT v, w / sum(w) OVER () AS g FROM (SELECT v, {weight} AS w FROM
            (SELECT {margin} AS v, sum(tokens) AS n FROM cells GROUP BY ALL)))""")
    parts.append("""r0 AS (SELECT cells.*, CAST(tokens AS DOUBLE) AS share, w_s.g AS g_s, w_l.g AS g_l, w_t.g AS g_t FROM cells
        JOIN w_s ON s = w_s.v JOIN w_l ON l = w_l.v JOIN w_t ON t = w_t.v)""")
    last = "r0"
    for i in range(rounds):
        for margin in "slt":
            name = f"r{i + 1}{margin}"
            parts.append(f"""{name} AS MATERIALIZED (SELECT * REPLACE (share * g_{margin} / sum(share) OVER (PARTITION BY {margin}) AS share)
                FROM {last})""")
            last = name
    parts.append(f"""rated AS (SELECT *, share / tokens AS rate FROM {last}),
        rates AS (SELECT rate, sum(tokens) AS n, sum(share) AS m FROM rated GROUP BY ALL),
        ks AS (SELECT rate, ({fraction} * sum(n) OVER () - coalesce(sum(n) OVER w, 0)) / (sum(m) OVER () - coalesce(sum(m) OVER w, 0)) AS k
               FROM rates WINDOW w AS (ORDER BY rate DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        best AS (SELECT max_by(k, rate) AS k FROM ks WHERE k * rate <= 1.0 + 1e-12),
        chosen AS (SELECT s, l, t, coalesce(least(1.0, (SELECT k FROM best) * rate), 1.0) AS p FROM rated)""")
    return f"""WITH {', '.join(parts)}
        SELECT doc_id, m.s AS source, m.l AS lang, m.t AS topic, CAST(n AS BIGINT) AS n_tokens, round(coalesce(p, 1.0), 6) AS probability
        FROM marked m LEFT JOIN chosen c ON m.s = c.s AND m.l = c.l AND m.t = c.t
        WHERE CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#{seed}'), 1, 13) AS BIGINT) / {float(1 << 52)}
            < coalesce(p, 1.0)"""
