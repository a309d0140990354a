"""Approximate nearest neighbours with a hash-prefix forest.

The rows are dealt over shards of about ``rows_per_shard`` vectors. Each shard holds a forest: for every tree one array of
the rows' hash strings (``BITS`` signs of random projections of the vectors less the shard's mean), sorted. A query descends: in
every tree its place in the sorted array gives the rows with the longest common prefix. Then it ascends in all trees at once:
prefixes are shortened letter by letter, level by level over all trees, which about doubles the candidates each time.
Distances of new candidates are exact. A query ends when at least ``least`` candidates were seen and ``patience`` more levels, each
adding half as many as were there, brought no nearer one among its ``k``; vectors with structure end early, vectors without any (all
nearly at right angles) see most of the shard. The best ``k`` of each shard are merged.

Projections depend on the seed and the dimension alone, so a lost task builds the same forest again. A shard is shuffled once and
built once; the queries, which all shards get, stream past it in blocks of ``block_queries``, so a task holds one shard
and one block, whatever the number of rows and of queries.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part. Only vectors of one
length are compared. Equal distances are ordered by id; a repeated row is a candidate of its own. A null id is kept as such.
Fewer candidates than ``k`` are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeloom.llm.vectors import usable
from latticeloom.session import cut_lineage

TREES = 64
BITS = 32


class Forest:
    """Sorted arrays of hash strings over the rows of one shard."""

    def __init__(self, points: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 3):
        self.bits, self.trees, self.centre = bits, trees, points.mean(axis=0)
        self.planes = np.random.default_rng([seed, points.shape[1]]).normal(size=(trees, points.shape[1], bits))
        self.order, self.strings = [], []
        for tree in range(trees):
            strings = self.hashed(points, tree)
            order = np.argsort(strings, kind="stable").astype(np.int32)
            self.order.append(order)
            self.strings.append(strings[order])
        self.rows = len(points)

    def hashed(self, points: np.ndarray, tree: int) -> np.ndarray:
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return ((points - self.centre) @ self.planes[tree] > 0) @ weights

    def ranges(self, queries: np.ndarray) -> np.ndarray:
        """[query, tree, level, 0 or 1]: the rows of each tree that share the first ``bits - level`` letters with the query."""
        out = np.empty((len(queries), self.trees, self.bits + 1, 2), dtype=np.int32)
        for tree in range(self.trees):
            strings = self.hashed(queries, tree)
            for level in range(self.bits + 1):
                low = (strings >> level) << level
                out[:, tree, level, 0] = np.searchsorted(self.strings[tree], low, side="left")
                out[:, tree, level, 1] = np.searchsorted(self.strings[tree], low + (1 << level), side="left")
        return out

    def levels(self, ranges: np.ndarray) -> Iterator[np.ndarray]:
        """New rows of each level, ascending in all trees at once from the longest matching prefixes."""
        seen = np.zeros(self.rows, dtype=bool)
        sizes = ranges[:, :, 1] - ranges[:, :, 0]
        grown = np.diff(sizes, axis=1, prepend=0) > 0
        before = 0
        for level in np.flatnonzero(grown.any(axis=0)):
            met = [self.order[tree][ranges[tree, level, 0]:ranges[tree, level, 1]] for tree in np.flatnonzero(grown[:, level])]
            fresh = np.concatenate(met)
            fresh = np.unique(fresh[~seen[fresh]])
            seen[fresh] = True
            before += len(fresh)
            yield fresh
            if before == self.rows:
                return


def search(forest: Forest, points: np.ndarray, rows: np.ndarray, ranges: np.ndarray, query: np.ndarray, own: int, k: int, least: int,
           patience: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the shard of the nearest rows found, ties of the last one included, and their distances."""
    place, distance = np.empty(0, dtype=np.int64), np.empty(0)
    seen = since = calm = 0
    for fresh in forest.levels(ranges):
        fresh = fresh[rows[fresh] != own]
        gap = np.sqrt(((points[fresh] - query) ** 2).sum(axis=1))
        worst = distance[k - 1] if len(distance) >= k else np.inf
        better = bool((gap < worst).any())
        near = gap <= worst
        place, distance = np.concatenate([place, fresh[near]]), np.concatenate([distance, gap[near]])
        order = np.argsort(distance, kind="stable")
        place, distance = place[order], distance[order]
        if len(distance) > k:
            keep = np.searchsorted(distance, distance[k - 1], "right")
            place, distance = place[:keep], distance[:keep]
        before, seen = seen, seen + len(fresh)
        since = 0 if better else since + len(fresh)
        if better:
            calm = 0
        elif 2 * since >= before:
            calm, since = calm + 1, 0
        if seen >= least and calm >= patience:
            break
    return place, distance


class Shard:
    """The rows of one shard with their forest."""

    def __init__(self, rows: np.ndarray, ids: pa.Array, points: np.ndarray, trees: int, bits: int):
        self.rows, self.ids, self.points = rows, ids, points
        self.forest = Forest(points, trees, bits)
        order = pc.sort_indices(pa.table({"id": ids, "row": rows}), [("id", "ascending"), ("row", "ascending")], null_placement="at_start")
        self.rank = np.empty(len(rows), dtype=np.int64)
        self.rank[order.to_numpy()] = np.arange(len(rows))

    def nearest(self, asked: np.ndarray, asked_rows: np.ndarray, asked_ids: pa.Array, k: int, least: int, patience: int) -> pa.RecordBatch:
        """``(query_row, query_id, id, row, distance)`` of the ``k`` nearest candidates of each query, ties to the smaller id."""
        owner, place, distance = [], [], []
        for at in range(0, len(asked), 256):
            ranges = self.forest.ranges(asked[at:at + 256])
            for i in range(len(ranges)):
                found, gap = search(self.forest, self.points, self.rows, ranges[i], asked[at + i], asked_rows[at + i], k, least, patience)
                first = np.lexsort((self.rank[found], gap))[:k]
                found, gap = found[first], gap[first]
                owner.append(np.full(len(found), at + i))
                place.append(found)
                distance.append(gap)
        owner, place = np.concatenate(owner).astype(np.int64), np.concatenate(place).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(asked_rows[owner]), asked_ids.take(pa.array(owner)), self.ids.take(pa.array(place)), pa.array(self.rows[place]),
            pa.array(np.concatenate(distance))], names=["query_row", "query_id", "id", "row", "distance"])


def _shard_stream(k: int, least: int, trees: int, bits: int, block_queries: int, patience: int):
    """Rows (dim, shard, asked, row, id, vec) come sorted: a shard's rows, then its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard, waiting, count = None, [], None, [], 0

        def joined(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
            table = pa.Table.from_batches(parts).combine_chunks()
            vec = table["vec"].combine_chunks()
            return table["row"].to_numpy(), table["id"].combine_chunks(), np.asarray(vec.flatten()).reshape(len(vec), -1)

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal shard, held, waiting, count
            if waiting and held and shard is None:
                shard = Shard(*joined(held), trees, bits)
                held = held[:1]
            if waiting and shard is not None:
                rows, ids, points = joined(waiting)
                yield shard.nearest(points, rows, ids, k, least, patience)
            waiting, count = [], 0

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            first = np.flatnonzero(np.any(np.diff(keys, axis=0, prepend=keys[:1] - 1) != 0, axis=1))
            for at, end in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
                dim, number, asked = keys[at].tolist()
                if (dim, number) != key:
                    yield from answer()
                    key, held, shard = (dim, number), [], None
                part = batch.slice(at, end - at)
                if not asked:
                    held.append(part)
                    continue
                for start in range(0, part.num_rows, block_queries):
                    piece = part.slice(start, block_queries)
                    if count + piece.num_rows > block_queries:
                        yield from answer()
                    waiting.append(piece)
                    count += piece.num_rows
        yield from answer()
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            least: int = 500, rows_per_shard: int = 8_192, block_queries: int = 2_048, trees: int = TREES, bits: int = BITS,
            patience: int = 1) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest rows found for every row for which ``is_query`` holds."""
    valid = vectors.where(usable(F.col(vec_col)))
    data = cut_lineage(valid.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                                    F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row"))
                       .withColumn("dim", F.size("vec")))
    shards = math.ceil(data.count() / rows_per_shard) or 1
    index = data.select("dim", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asked"), "row", "id", "vec")
    asked = data.where("q").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asked"),
                                   "row", "id", "vec")
    kind = T.StructType([T.StructField("query_row", T.LongType()), T.StructField("query_id", data.schema["id"].dataType),
                         T.StructField("id", data.schema["id"].dataType), T.StructField("row", T.LongType()),
                         T.StructField("distance", T.DoubleType())])
    dealt = index.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asked", "row")
    best = dealt.mapInArrow(_shard_stream(k, least, trees, bits, block_queries, patience), kind)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy("distance", "id", "row"))   # k rows a shard at most
    return (best.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), F.col("distance").alias("score")))
