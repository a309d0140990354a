"""Near-duplicate texts by word shingles, found with softly decoded Golay codes.

``simhash`` links fingerprints within three bits; texts that share four fifths of their shingles differ in ten bits or so.
To find these, the 92 bits of a longer SimHash are four segments of 23, and each segment is decoded by its margins (how
far each bit's vote is from even) instead of its bits: of the 4096 codewords of the Golay code, those with the
largest inner product with the margins are the nearest. Strong votes then outweigh weak ones, so two texts with a Jaccard
similarity of 0.8 have one of ten likely codeword pairs in common, for some two of the four segments, with probability 0.97;
at 0.85 it is 0.99. A text is filed under these 60 keys of 24 bits each.

Texts under one key are compared by 64 fingerprint bits, a task streaming through its keys in order. A key with few texts
gives all its pairs within ``MOST_BITS``. A key with m texts gives the pair of each with the most central one and, where that is
not close, with its nearest one: 2 m at most, not m^2 / 2; sixty keys have different central texts. Fingerprints of a key
come in order, in parts of ``PART``; each part has a centre of its own, and the centres of a key's parts are compared in the same
way. So a key of any size takes a task bounded memory and time in proportion to its texts. The pairs are verified exactly:
shared shingles / all shingles >= ``similarity``. Equal texts are one node from the start.

The choice of centres loses nothing. A key of which not all pairs within the bits were given is read again once the links are known:
a text of it is open if another one within the bits is in another component, as when a family shares boilerplate and
no text is near the centre (of a key with more than ``PART`` texts in several components, all are open). Open texts meet in an
exact set-similarity join of their shingles (``rest_pairs``). More than ``MOST_BITS`` of 64 bits differ in a pair at the threshold
with a probability of about 0.001. Components of all verified links are the groups.

Defined cases: texts without a word (null, empty, blank) are one group. Texts of fewer words than a shingle are one shingle
and so are near only to texts with the same words. Of each group the row with the smallest id stays (null ids count as
smallest), one row even if it is repeated; the columns are those of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.llm.simhash import code_tables, shingles
from latticeloom.operators.ml import connected_components
from latticeloom.session import cut_lineage, free_unused

WIDTH, SEGMENTS = 23, 4
LIKELY = 4
#: Which of the likely codewords of two segments make a key, by rank.
RANKS = ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0), (0, 3), (3, 0), (1, 2), (2, 1))
#: Fingerprints of texts that are similar enough differ in 10 of 64 bits, with a standard deviation of 3.
MOST_BITS = 20
SURE_BITS = 10
#: Fingerprints of one key that are compared with each other at a time.
PART = 2_048
#: Up to ``FEW`` fingerprints of a key give all their pairs; of ``CROWD`` or more, each is paired under half of its keys.
FEW, CROWD = 4, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Open texts whose shingles are counted to put the common ones last, and how many common ones are told to the tasks. The order
#: decides how many pairs are tried, never which links are found.
COUNTED_TEXTS, COMMON_SHINGLES = 10_000, 1_000_000


@cache
def codewords() -> np.ndarray:
    """The 4096 codewords as rows of 1 and -1."""
    words = (np.arange(4096) << 11) | code_tables()[0]
    return np.where(words[:, None] >> np.arange(WIDTH) & 1, 1.0, -1.0).astype(np.float32)


def margins(text: bytes | None, words: int) -> np.ndarray:
    """Votes for minus votes against each of 128 bits, over the shingles of a text."""
    parts = shingles(text or b"", words)
    votes = np.zeros(128, dtype=np.int64)
    for at in range(0, len(parts), 65_536):
        digest = b"".join(map(xxhash.xxh3_128_digest, parts[at:at + 65_536]))
        bits = np.unpackbits(np.frombuffer(digest, dtype=np.uint8).reshape(-1, 16), axis=1)
        votes += 2 * bits.sum(axis=0, dtype=np.int64) - len(bits)
    return votes


def likely_codewords(votes: np.ndarray, rows: int = 256) -> np.ndarray:
    """[row, segment, rank]: indices of the ``LIKELY`` codewords that agree best with the votes; ``rows`` at a time."""
    out = np.empty((len(votes), SEGMENTS, LIKELY), dtype=np.int32)
    for at in range(0, len(votes), rows):
        for s in range(SEGMENTS):
            differ = votes[at:at + rows, s * WIDTH:(s + 1) * WIDTH].astype(np.float32) @ -codewords().T
            top = np.argpartition(differ, LIKELY, axis=1)[:, :LIKELY]
            order = np.argsort(np.take_along_axis(differ, top, axis=1), axis=1, kind="stable")
            out[at:at + rows, s] = np.take_along_axis(top, order, axis=1)
    return out


def keys_of(codes: np.ndarray) -> np.ndarray:
    """[row, key] from likely codewords: every pair of segments and of ``RANKS``."""
    pairs = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]
    return np.stack([(p << 24) | codes[:, i, a] << 12 | codes[:, j, b] for p, (i, j) in enumerate(pairs) for a, b in RANKS],
                    axis=1).astype(np.int32)


def _crossed(one: np.ndarray, block: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """Differing bits of some rows at a time with all."""
    for at in range(0, len(one), block):
        yield at, np.bitwise_count(one[at:at + block, None] ^ one[None, :])


def near_in_part(one: np.ndarray, key: int, most: int = MOST_BITS, sure: int = SURE_BITS) -> tuple[np.ndarray, np.uint64, bool]:
    """Pairs (rows of two) among distinct fingerprints, the most central one, and whether the pairs are all within ``most`` bits.

    Of few fingerprints all such pairs are given. Of many, each is paired with the central one, and if that is not within ``sure``
    bits, with the nearest one too; of ``CROWD`` or more, each is so under every second of its keys.
    """
    if len(one) < 2:
        return np.empty((0, 2), np.uint64), one[0], True
    if len(one) <= FEW:
        close = np.argwhere(np.triu(np.bitwise_count(one[:, None] ^ one[None, :]) <= most, 1))
        return one[close], one[0], True
    totals, closest, nearest, close = np.empty(len(one)), np.empty(len(one), np.uint8), np.empty(len(one), np.int64), 0
    for at, bits in _crossed(one):
        totals[at:at + len(bits)] = bits.sum(axis=1, dtype=np.int64)
        rows = np.arange(len(bits))
        bits[rows, at + rows] = 65
        close += int(np.count_nonzero(bits <= most))
        nearest[at:at + len(bits)] = bits.argmin(axis=1)
        closest[at:at + len(bits)] = bits[rows, nearest[at:at + len(bits)]]
    centre = one[totals.argmin()]
    away = np.bitwise_count(one ^ centre)
    here = ((one ^ np.uint64(key)) * _MIX >> np.uint64(63)).astype(bool) if len(one) >= CROWD else np.ones(len(one), dtype=bool)
    star = one[here & (away <= most) & (one != centre)]
    lone = here & (away > sure) & (closest <= most) & (one[nearest] != centre)
    both = np.concatenate([np.stack([star, np.full(len(star), centre)], axis=1), np.stack([one[lone], one[nearest[lone]]], axis=1)])
    pairs = np.unique(np.stack([both.min(axis=1), both.max(axis=1)], axis=1), axis=0)
    return pairs, centre, 2 * len(pairs) == close


class KeyPairs:
    """Pairs among the fingerprints of one key, which come in ascending order; no more than ``part`` of a level are held.

    ``whole`` tells whether every pair within the bits has been given so far.
    """

    def __init__(self, key: int = 0, part: int = PART):
        self.key, self.part, self.whole, self.levels = key, part, True, [np.empty(0, np.uint64)]

    def add(self, prints: np.ndarray, level: int = 0) -> Iterator[np.ndarray]:
        if level == len(self.levels):
            self.levels.append(np.empty(0, np.uint64))
        for at in range(0, len(prints), self.part):
            held = np.unique(np.concatenate([self.levels[level], prints[at:at + self.part]]))
            self.levels[level] = held
            if len(held) >= self.part:
                yield from self._close(level, held[:self.part], held[self.part:])

    def _close(self, level: int, held: np.ndarray, rest: np.ndarray) -> Iterator[np.ndarray]:
        found, centre, _ = near_in_part(held, self.key)
        self.whole = False                                       # parts meet by their centres only
        self.levels[level] = rest
        yield found
        yield from self.add(np.array([centre]), level + 1)

    def end(self) -> Iterator[np.ndarray]:
        """What is left, the centres of each level going to the next one until a level has only one."""
        level = 0
        while level < len(self.levels):
            held = self.levels[level]
            if level + 1 == len(self.levels):
                if len(held) > 1:
                    found, _, all_of_them = near_in_part(held, self.key)
                    self.whole &= all_of_them
                    yield found
            elif len(held):
                yield from self._close(level, held, held[:0])
            level += 1


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(null, a, b)``, and keys ``(key, null, null)`` of which not all pairs are given, from sorted rows (key, fingerprint)."""
    def told(found: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        got = np.unique(np.concatenate([np.empty((0, 2), np.uint64), *found]), axis=0).view(np.int64)
        ends = [pa.concat_arrays([pa.array(got[:, i]), pa.nulls(len(keys), pa.int64())]) for i in range(2)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(len(got), pa.int32()), pa.array(keys, pa.int32())]), *ends],
                                          names=["key", "a", "b"])

    open_key, pairs = None, KeyPairs()
    for batch in batches:
        keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        sizes = np.diff(np.append(first, len(keys)))
        whole = np.ones(len(first), dtype=bool)
        whole[-1] = False                                        # the last key may go on in the next batch
        whole[0] &= keys[0] != open_key
        two = first[whole & (sizes == 2)]
        fit = (prints[two] != prints[two + 1]) & (np.bitwise_count(prints[two] ^ prints[two + 1]) <= MOST_BITS)
        both = np.stack([prints[two], prints[two + 1]], axis=1)[fit]
        found, partly = [np.stack([both.min(axis=1), both.max(axis=1)], axis=1)], []
        for at, n in zip(first[(sizes > 2) | ~whole].tolist(), sizes[(sizes > 2) | ~whole].tolist()):
            if keys[at] != open_key:
                found += pairs.end()
                partly += [] if pairs.whole else [open_key]
                open_key, pairs = int(keys[at]), KeyPairs(int(keys[at]))
            found += pairs.add(prints[at:at + n])
        yield told(found, partly)
    last = list(pairs.end())
    yield told(last, [] if pairs.whole else [open_key])


def _still_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that have, under their key, another one within ``MOST_BITS`` in another component; rows (key, print, node, root) come sorted.

    Of a key with more than ``PART`` rows, which has more than one component, all are given.
    """
    def close(held: list[np.ndarray], many: bool) -> np.ndarray:
        prints, node, root = (np.concatenate([h[i] for h in held]) for i in range(3))
        if many:
            return node
        apart = np.zeros(len(node), dtype=bool)
        for at, bits in _crossed(prints.view(np.uint64)):
            apart[at:at + len(bits)] = ((bits <= MOST_BITS) & (root[at:at + len(bits), None] != root[None, :])).any(axis=1)
        return node[apart]

    def told(nodes: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.empty(0, np.int64), *nodes])))], names=["node"])

    open_key, held, size, many = None, [], 0, False
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        keys, out = columns[0], []
        if not len(keys):
            continue
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        for at, end in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
            if keys[at] != open_key:
                out += [close(held, many)] if held else []
                open_key, held, size, many = keys[at], [], 0, False
            held.append([c[at:end] for c in columns[1:]])
            size += end - at
            if size > PART:                                      # what is held goes on, so no key is held whole
                out.append(close(held, True))
                held, many = [], True
        yield told(out)
    yield told([close(held, many)] if held else [])


def shingle_set(text: bytes | None, words: int) -> bytes:
    """Sorted distinct 64-bit hashes of the shingles."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in shingles(text or b"", words)], dtype="<u8")).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    common = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - common
    return common / union if union else 1.0


def rarest_first(shingle_hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes in the global order: by count (0 for those not in ``common``, which is sorted), then by value."""
    if not len(common):
        return np.sort(shingle_hashes)
    at = np.minimum(np.searchsorted(common, shingle_hashes), len(common) - 1)
    return shingle_hashes[np.lexsort((shingle_hashes, np.where(common[at] == shingle_hashes, counts[at], 0)))]


def rest_pairs(held: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(x, y)`` of rows ``(node, root, s)`` with different roots; all pairs of sets with at least ``similarity`` are there.

    Of two sets, the smaller a and the larger b, ``need`` = similarity / (1 + similarity) (|a| + |b|) hashes are common. In any
    one order of all hashes, the first common one is then among the first |a| - need(a, a) + 1 of a and the first
    |b| - similarity |b| + 1 of b, and what is left from it on suffices in both for ``need``.
    """
    spark = held.sparkSession
    total = held.count()
    counted = held if total <= COUNTED_TEXTS else held.where(
        F.pmod(F.xxhash64("node"), F.lit(total)) < COUNTED_TEXTS)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s, dtype="<i8"))], names=["h"])

    often = (counted.select("s").mapInArrow(hashes, "h long").groupBy("h").count().where("count > 1")
             .orderBy(F.desc("count"), "h").limit(COMMON_SHINGLES).toArrow())
    keys, counts = often["h"].to_numpy().view(np.uint64), often["count"].to_numpy()
    order = np.argsort(keys)
    told = spark.sparkContext.broadcast((keys[order], counts[order]))
    share = 2 * similarity / (1 + similarity)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, s in zip(*(c.to_pylist() for c in batch.columns)):
                all_hashes = rarest_first(np.frombuffer(s, dtype="<u8"), *told.value)
                n = len(all_hashes)
                first = all_hashes[:n - math.ceil(similarity * n - 1e-9) + 1] if n else all_hashes
                at = np.arange(len(first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), *(pa.array(np.full(len(first), v, np.int64)) for v in (node, root, n)),
                     pa.array(at), pa.array(at <= n - math.ceil(share * n - 1e-9))],
                    names=["h", "node", "root", "n", "at", "lead"])

    filed = held.select("node", "root", "s").mapInArrow(entries, "h long, node long, root long, n long, at long, lead boolean")
    mixed = filed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    filed = cut_lineage(lookup_join(filed, mixed, "h", once=True))
    a, b = filed.where("lead").alias("a"), filed.alias("b")
    need = F.lit(similarity / (1 + similarity)) * (F.col("a.n") + F.col("b.n")) - 1e-9
    fit = ((F.col("a.h") == F.col("b.h")) & (F.col("a.root") != F.col("b.root"))
           & (F.struct("a.n", "a.node") < F.struct("b.n", "b.node")) & (F.col("a.n") >= F.lit(similarity) * F.col("b.n") - 1e-9)
           & (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= need))
    return a.join(b, fit).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()


def text_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``(_key, _h, _g, component)`` for every distinct text: its smallest id, two hashes, and the group's smallest id."""

    @F.pandas_udf("print long, codes array<int>")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        votes = np.stack([margins(t, words) for t in texts]) if len(texts) else np.zeros((0, 128), np.int64)
        prints = np.packbits(votes[:, 64:] > 0, axis=1).view("<i8")[:, 0]
        return pd.DataFrame({"print": prints, "codes": list(likely_codewords(votes).reshape(len(votes), -1))})

    @F.pandas_udf("array<int>")
    def keyed(codes: pd.Series) -> pd.Series:
        return pd.Series(list(keys_of(np.stack(codes.to_numpy()).reshape(len(codes), SEGMENTS, LIKELY))))

    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_set(t, words))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype=float)

    spark = docs.sparkSession
    marked = with_identity(docs, id_col, text)

    def distinct_texts() -> DataFrame:
        rows = marked.select("_key", "_h", "_g", hashed(F.col(text).cast("binary")).alias("x")).select("_key", "_h", "_g", "x.*")
        return cut_lineage(rows.groupBy("_h", "_g").agg(F.min("_key").alias("_key"), F.first("print").alias("print"),
                                                        F.first("codes").alias("codes")))

    nodes = distinct_texts().withColumn("node", F.monotonically_increasing_id())        # stable: the rows are stored
    heads = nodes.groupBy("print").agg(F.min("node").alias("head"))

    # each step is a function of its own, so its tables are out of scope, and their files can go, before the next one
    def near_candidates() -> tuple[DataFrame, DataFrame]:
        """Keys of which not all pairs are candidates, and the candidates ``(x, y)``."""
        filed = nodes.select(F.explode(keyed("codes")).alias("key"), "print")
        told = cut_lineage(filed.repartition("key").sortWithinPartitions("key", "print")
                           .mapInArrow(_candidates, "key int, a long, b long").distinct())
        found = told.where("key IS NULL").select("a", "b")
        return told.where("key IS NOT NULL").select("key"), cut_lineage(found.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select("x", "y")
                           .union(nodes.join(heads, "print").where("node != head").select("head", "node")))

    def with_sets(wanted: DataFrame) -> DataFrame:
        named = wanted.join(nodes.select("node", "_key", "_h", "_g"), "node")
        return cut_lineage(lookup_join(marked, cut_lineage(named), ["_key", "_h", "_g"]).dropDuplicates(["_key", "_h", "_g"])
                           .select(*wanted.columns, sets(F.col(text).cast("binary")).alias("s")))

    def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
        held = held.select("node", "s")
        return cut_lineage(pairs.join(held.toDF("x", "sx"), "x").join(held.toDF("y", "sy"), "y")
                           .where(alike("sx", "sy") >= similarity).select(F.col("x").alias("a"), F.col("y").alias("b")))

    def first_links() -> tuple[DataFrame, DataFrame]:
        partly, near = near_candidates()
        free_unused(spark)
        return partly, verified(near, with_sets(near.select("x").union(near.select("y")).toDF("node").distinct()))

    def open_texts(partly: DataFrame, links: DataFrame) -> DataFrame:
        """``(node, root)`` of texts that may be near one of another component: under a key of which not all pairs were compared, or
        whose fingerprint another text has, with one within ``MOST_BITS`` that is not in their component."""
        parts = connected_components(links)
        rooted = cut_lineage(nodes.join(parts, nodes["node"] == parts["id"], "left").select(
            "node", F.coalesce("component", "node").alias("root"), "print", "codes"))
        shared = rooted.groupBy("print").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("print")
        again = rooted.join(shared, "print", "left_semi").select(F.explode(keyed("codes")).alias("key"))
        filed = rooted.select(F.explode(keyed("codes")).alias("key"), "print", "node", "root")
        # keys told, and the components under every key, meet in one aggregate; few keys are both told and unsettled
        told = partly.union(again).select("key", F.lit(None).cast("long").alias("root"), F.lit(True).alias("told"))
        every = filed.select("key", "root", F.lit(False).alias("told")).unionByName(told)
        unsettled = (every.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("told").alias("told"))
                     .where("told AND lo < hi").select("key"))
        left = lookup_join(filed, unsettled, "key", once=True).repartition("key").sortWithinPartitions("key", "print")
        apart = left.mapInArrow(_still_apart, "node long").distinct()
        return cut_lineage(rooted.join(apart, "node", "left_semi").select("node", "root"))

    def last_links(partly: DataFrame, links: DataFrame) -> DataFrame:
        rest = with_sets(open_texts(partly, links))
        free_unused(spark)
        pairs = cut_lineage(rest_pairs(rest, similarity))
        free_unused(spark)
        return verified(pairs, rest)

    partly, links = first_links()
    free_unused(spark)
    links = links.union(last_links(partly, links))
    free_unused(spark)
    parts = connected_components(links)
    placed = nodes.join(parts, nodes["node"] == parts["id"], "left").select(
        "_key", "_h", "_g", F.coalesce("component", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min(F.struct("_key", "_h", "_g")).alias("first"))
    return placed.join(least, "root").select("_key", "_h", "_g", "first")


def with_identity(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``_key`` (the id; null ids are the smallest long) and two hashes of the text."""
    held = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_key": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64(held),
                             "_g": F.xxhash64(F.lit(1), held)})


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicate texts."""
    groups = text_groups(docs, words, similarity, id_col, text)
    kept = groups.where(F.struct("_key", "_h", "_g") == F.col("first")).select("_key", "_h", "_g")
    marked = with_identity(docs, id_col, text)
    return (marked.join(kept, ["_key", "_h", "_g"], "left_semi").dropDuplicates(["_key", "_h", "_g"])
            .select(*[marked[c] for c in docs.columns]))
