"""URL filter: rules, and a tree of path templates per host learned from the urls that the rules decide.

A path's first ``depth`` segments are tokens: digits within a segment are one mark, a long segment or a long hexadecimal number is
another, and the segments behind are one token together. Urls of one host and one token list are one row from then on, with
the numbers of urls, of labelled bad and of labelled good ones. The tree of a host is then walked from its root, all nodes of a
level of all hosts at once:

* each branch of a node is held against the branches beside it, pooled, by the shares of its urls that are labelled bad,
  are labelled good, end there, or go on with a variable token. If every share is within the Hoeffding bound of both samples,
  the branch cannot be told from the others and joins the node's wildcard; else it stays a branch of its own;
* so rare segments become wildcards, as nothing is known of them, and branches that behave alike are merged without
  comparing them in pairs. A branch without siblings stays.

Each leaf is a template. Its purity is (bad + strength / 2) / (bad + good + strength) over labelled urls; a template of
``reject`` or more is blocked. Where nothing is labelled the purity is one half, so nothing is blocked without evidence.

Everything is DataFrame functions. Counts are summed before they are shuffled; joins on host and branch are salted, as one host
may hold a third of the urls. Rules are a parameter.

Defined cases: a null url, or one without ``://``, has an empty host and path; no rule fits an empty host, and its template is the
empty one. A segment that reads like a mark is taken as one. Of fitting rules of equal length the longer host wins, then
block. Repeated rows, with whatever keys, get a row each and count each. An empty table gives no rows. Only the key and the
url (and the columns of ``label``) are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.session import cut_lineage

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks of variable tokens, and the token of merged branches.
NUMBER, HEX, LONG, REST, ANY = "<n>", "<h>", "<long>", "<rest>", "*"
HEX_FORM = r"^[0-9a-f-]*[0-9][0-9a-f-]*$"
HEX_FROM, LONG_FROM = 12, 40
DEPTH, ALPHA, STRENGTH, REJECT = 4, 0.05, 2.0, 0.8
SALTS = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def ordered(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(action, host, path) of rules ``(action, host + path)``, the winning one first."""
    split = [(action, *text.partition("/")[::2]) for action, text in rules]
    return sorted(((a, h, f"/{p}") for a, h, p in split), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r))


def first_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, h, p in reversed(ordered(rules)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("verdict"))).otherwise(found)
    return found


def tokens(path: Column, depth: int = DEPTH) -> Column:
    """The first ``depth`` segments of a path with variable parts marked, and a mark for the rest."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    token = lambda s: (F.when(F.length(s) >= LONG_FROM, LONG)
                       .when((F.length(s) >= HEX_FROM) & s.rlike(HEX_FORM), HEX)
                       .otherwise(F.regexp_replace(s, "[0-9]+", NUMBER)))
    rest = F.when(F.size(segments) > depth, F.array(F.lit(REST))).otherwise(F.array().cast("array<string>"))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.concat(F.transform(F.slice(segments, 1, depth), token), rest))


def _salted(left: DataFrame, right: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Left join with a table that has one row a key, which is copied so that the rows of a hot key go to ``SALTS`` tasks."""
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(copies, [*on, "_salt"], "left").drop("_salt")


FEATURES = ["bad", "good", "ends", "goes_on"]


def templates(shapes: DataFrame, depth: int = DEPTH, alpha: float = ALPHA) -> DataFrame:
    """``(host, shape, template, bad, good)`` for ``(host, shape array, n, bad, good)``, one row per host and token list."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    level = cut_lineage(shapes.withColumn("node", F.lit("")))
    for at in range(depth + 1):
        here = F.get("shape", F.lit(at))
        then = F.get("shape", F.lit(at + 1))
        rows = level.withColumn("branch", here)
        inside = rows.where(F.col("branch").isNotNull())
        amount = {"ends": F.when(then.isNull(), F.col("n")), "goes_on": F.when(then.contains("<"), F.col("n"))}
        branches = inside.groupBy("host", "node", "branch").agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"),
            *[F.sum(F.coalesce(c, F.lit(0))).alias(name) for name, c in amount.items()])
        branches = cut_lineage(branches)
        nodes = branches.groupBy("host", "node").agg(*[F.sum(c).alias(f"all_{c}") for c in ["n", *FEATURES]])
        beside = F.col("all_n") - F.col("n")
        apart = F.lit(bound) * (1 / F.sqrt("n") + 1 / F.sqrt(beside))
        own = beside == 0
        for c in FEATURES:
            own = own | F.when(beside > 0, F.abs(F.col(c) / F.col("n") - (F.col(f"all_{c}") - F.col(c)) / beside) > apart)
        judged = _salted(branches, nodes, ["host", "node"], "branch").select("host", "node", "branch", own.alias("own"))
        token = F.when(F.col("own"), F.col("branch")).otherwise(F.lit(ANY))
        level = cut_lineage(_salted(rows, judged, ["host", "node", "branch"], "shape").select(
            "host", "shape", "n", "bad", "good",
            F.when(F.col("branch").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), token)).alias("node")))
    return level.select("host", "shape", F.col("node").alias("template"), "bad", "good")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", label: Column | None = None,
               depth: int = DEPTH, alpha: float = ALPHA, strength: float = STRENGTH, reject: float = REJECT) -> DataFrame:
    """``(key, host, path, rule, verdict, template, purity)`` for every row.

    ``label`` is a boolean column of ``pages``, true for urls known as bad, null for others; without it, urls that a rule
    decides are the labelled ones. ``verdict`` is the rule's where one fits, else the template's.
    """
    host, path = split_url(F.col(url))
    read = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"),
                        (F.lit(None).cast("boolean") if label is None else label).alias("label"))
    rows = read.withColumn("found", first_rule(rules, F.col("host"), F.col("path"))).withColumn("shape", tokens(F.col("path"), depth))
    if label is None:
        rows = rows.withColumn("label", F.col("found.verdict") == "block")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    shapes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), count(F.col("label"))("bad"), count(~F.col("label"))("good"))
    leaves = templates(shapes, depth, alpha)
    pure = leaves.groupBy("host", "template").agg(
        ((F.sum("bad") + strength / 2) / (F.sum("bad") + F.sum("good") + strength)).alias("purity"))
    known = cut_lineage(_salted(leaves, pure, ["host", "template"], "shape").select("host", "shape", "template", "purity"))
    judged = _salted(rows, known, ["host", "shape"], "key")
    learned = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return judged.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce("found.verdict", learned).alias("verdict"), "template", "purity")


def urls_sql(rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", table: str = "pages", depth: int = DEPTH,
             alpha: float = ALPHA, strength: float = STRENGTH, reject: float = REJECT) -> str:
    """The same in SQL, with urls that a rule decides as the labelled ones."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    fits = [f"WHEN (host = {text(h)} OR ends_with(host, {text('.' + h)})) AND starts_with(path, {text(p)}) THEN " for _, h, p in ordered(rules)]
    case = lambda of: "CASE " + " ".join(f + text(v) for f, v in zip(fits, of, strict=True)) + " END"
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    token = (f"CASE WHEN length(s) >= {LONG_FROM} THEN '{LONG}' WHEN length(s) >= {HEX_FROM} AND regexp_matches(s, '{HEX_FORM}') THEN '{HEX}' "
             f"ELSE regexp_replace(s, '[0-9]+', '{NUMBER}', 'g') END")
    sql = f"""WITH split AS (SELECT {key} AS key, translate(coalesce(regexp_extract({url}, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract({url}, '{URL}', 2), '') AS path FROM {table}),
rows AS (SELECT *, {case([h + p for _, h, p in ordered(rules)])} AS rule, {case([a for a, _, _ in ordered(rules)])} AS said,
  CASE WHEN path = '' THEN []::VARCHAR[] ELSE list_concat(
    list_transform(string_split(substr(path, 2), '/')[1:{depth}], lambda s: {token}),
    CASE WHEN len(string_split(substr(path, 2), '/')) > {depth} THEN ['{REST}'] ELSE []::VARCHAR[] END) END AS shape FROM split),
level0 AS (SELECT host, shape, count(*) AS n, sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS bad,
  sum(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) AS good, '' AS node FROM rows GROUP BY host, shape)"""
    for at in range(depth + 1):
        tests = " OR ".join(f"abs({c} / n - (all_{c} - {c}) / (all_n - n)) > {bound!r} * (1 / sqrt(n) + 1 / sqrt(all_n - n))" for c in FEATURES)
        sql += f""",
branch{at} AS (SELECT host, node, shape[{at + 1}] AS branch, sum(n) AS n, sum(bad) AS bad, sum(good) AS good,
  sum(CASE WHEN len(shape) = {at + 1} THEN n ELSE 0 END) AS ends, sum(CASE WHEN contains(shape[{at + 2}], '<') THEN n ELSE 0 END) AS goes_on
  FROM level{at} WHERE len(shape) > {at} GROUP BY ALL),
judged{at} AS (SELECT host, node, branch, all_n = n OR CASE WHEN all_n > n THEN {tests} END AS own FROM branch{at} JOIN
  (SELECT host, node, {', '.join(f'sum({c}) AS all_{c}' for c in ['n', *FEATURES])} FROM branch{at} GROUP BY ALL) USING (host, node)),
level{at + 1} AS (SELECT l.host, l.shape, l.n, l.bad, l.good,
  CASE WHEN len(l.shape) > {at} THEN l.node || '/' || CASE WHEN own THEN branch ELSE '{ANY}' END ELSE l.node END AS node
  FROM level{at} l LEFT JOIN judged{at} j ON l.host = j.host AND l.node = j.node AND l.shape[{at + 1}] = j.branch)"""
    return sql + f""",
pure AS (SELECT host, node, (sum(bad) + {strength / 2!r}) / (sum(bad) + sum(good) + {strength!r}) AS purity FROM level{depth + 1} GROUP BY ALL)
SELECT r.key AS {key}, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN purity >= {reject!r} THEN 'block' ELSE 'allow' END) AS verdict,
  l.node AS template, purity FROM rows r JOIN level{depth + 1} l ON r.host = l.host AND r.shape = l.shape
  JOIN pure p ON p.host = l.host AND p.node = l.node"""
