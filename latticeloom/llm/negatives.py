"""Hard negatives by a secondary sort.

For an anchor, rows of its own label that score highest are its positives, and each positive opens a window of scores in which
rows of other labels are hard negatives. Scores are integer inner products, so they are equal in every order of summation.

All anchors meet all rows in blocks: anchors in blocks of ``ANCHOR_BLOCK``, rows in blocks of ``ROW_BLOCK``, one matrix product
for each pair of blocks. That is a stated query set against all rows. From each product a task keeps, per anchor, only what may
be in the result: the first positives of its rows, and in a second pass, when the anchor's positives are known, the first
negatives of its rows under each of them. This combines before the shuffle and loses nothing, as the first of all are
among the first of each block.

What is kept goes through one secondary sort: a row is a packed binary key (anchor, descending score, positives before
negatives, id) whose byte order is the order wanted. Keys are dealt by anchor and sorted within partitions by the shuffle
(``repartition`` and ``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions, which sorts and spills
outside Python). A streaming iterator then opens a window at each positive, counts what it emits under each, and never holds
more of an anchor than its open windows.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Of
vectors of unequal length the shorter one is read as if it had zeros behind. Rows equal in id, label and vector are one row.
Rows that share an id but differ are rows of their own, and each is an anchor of its own if its id makes it one; a row
is never the positive of its own id. Ties go to the smaller id. Empty tables give no rows. Scores beyond 2**52 raise an error.
Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.session import cut_lineage

ANCHOR_BLOCK, ROW_BLOCK = 2048, 4096
POSITIVES, NEGATIVES = 5, 10
#: low * positive <= 100 * negative <= high * positive
LOW, HIGH = 30, 90
#: Scores up to here are exact in doubles, so the products can run as floating-point matrix products.
LARGEST = 2 ** 52

SIGN = np.uint64(1 << 63)
KEY_BYTES = 41


def integer_rows(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
                 scale: int = 256) -> DataFrame:
    """``(id, label, vector, anchor, uid)`` of the rows that take part; components are floor(scale * x)."""
    label = F.col(label) if isinstance(label, str) else label
    # components that no long can hold are past LARGEST as well; the blocks refuse them
    bound = lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST))
    out = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("x"),
                      F.coalesce(anchor, F.lit(False)).alias("anchor"))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    out = out.where(finite("x") & (F.size("x") > 0)).select(
        "id", "label", F.transform("x", lambda c: bound(c).cast("long")).alias("vector"), "anchor")
    return out.distinct().withColumn("uid", F.xxhash64("label", "vector"))


def finite(name: str) -> Column:
    return F.coalesce(F.forall(F.col(name), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, zeros behind short rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    values = np.asarray(column.flatten(), dtype=np.float64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _scores(left: pa.Table, right: pa.Table) -> np.ndarray:
    width = max(int(np.max(np.asarray(t["vector"].combine_chunks().value_lengths()))) for t in (left, right))
    a, b = _matrix(left["vector"], width), _matrix(right["vector"], width)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * width > LARGEST:
        raise OverflowError("inner products beyond 2**52")
    return (a @ b.T).astype(np.int64)


def _by_id(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("uid", "ascending")])


def packed(anchor: np.ndarray, anchor_uid: np.ndarray, score: np.ndarray, negative: bool, ids: np.ndarray, uid: np.ndarray) -> list[bytes]:
    """Keys whose byte order is (anchor, its uid, score descending, positives first, id, uid)."""
    fields = [(anchor, False), (anchor_uid, False), (score, True)], [(ids, False), (uid, False)]
    out = np.empty((len(anchor), KEY_BYTES), dtype=np.uint8)
    place = 0
    for part in fields:
        for values, descending in part:
            bits = values.astype(np.int64).view(np.uint64) ^ SIGN
            bits = ~bits if descending else bits
            out[:, place:place + 8] = bits.astype(">u8").view(np.uint8).reshape(-1, 8)
            place += 8
        if place == 24:
            out[:, place] = negative
            place += 1
    return [row.tobytes() for row in out]


def unpacked(key: bytes) -> tuple[int, int, int, bool, int, int]:
    word = lambda at: int.from_bytes(key[at:at + 8], "big") - (1 << 63)
    return word(0), word(8), -word(16) - 1, key[24] == 1, word(25), word(33)


KEYS = "part long, key binary"


def _key_table(parts: np.ndarray, keys: list[bytes]) -> pa.Table:
    return pa.table({"part": pa.array(parts, pa.int64()), "key": pa.array(keys, pa.binary())})


def _block_positives(anchors: pa.Table, rows: pa.Table, positives: int) -> pa.Table:
    """Keys of the first positives among a block's rows, per anchor."""
    if not anchors.num_rows or not rows.num_rows:
        return _key_table(np.array([], np.int64), [])
    rows = _by_id(rows)
    scores = _scores(anchors, rows)
    ids, uids, labels = (rows[c].to_numpy() for c in ("id", "uid", "label"))
    a_ids, a_uids, a_labels = (anchors[c].to_numpy() for c in ("id", "uid", "label"))
    chosen: list[tuple[int, np.ndarray]] = []
    for value in np.unique(a_labels):
        same = np.flatnonzero(labels == value)
        for i in np.flatnonzero(a_labels == value):
            mine = same[ids[same] != a_ids[i]]
            first = mine[np.argsort(-scores[i, mine], kind="stable")[:positives]]
            chosen.append((i, first))
    at = np.concatenate([np.full(len(f), i) for i, f in chosen]).astype(np.int64)
    col = np.concatenate([f for _, f in chosen]).astype(np.int64)
    return _key_table(a_uids[at], packed(a_ids[at], a_uids[at], scores[at, col], False, ids[col], uids[col]))


def _block_negatives(anchors: pa.Table, rows: pa.Table, negatives: int, low: int, high: int) -> pa.Table:
    """Keys of the first negatives among a block's rows, under each positive score of an anchor."""
    if not anchors.num_rows or not rows.num_rows:
        return _key_table(np.array([], np.int64), [])
    rows = _by_id(rows)
    scores = _scores(anchors, rows)
    ids, uids, labels = (rows[c].to_numpy() for c in ("id", "uid", "label"))
    a_ids, a_uids, a_labels = (anchors[c].to_numpy() for c in ("id", "uid", "label"))
    at, col = [], []
    for i, wanted in enumerate(anchors["positives"].to_pylist()):
        other = np.flatnonzero(labels != a_labels[i])
        mine = scores[i, other]
        order = np.argsort(-mine, kind="stable")
        less = -100 * mine[order]                                   # ascending
        kept: set[int] = set()
        for p in wanted:
            start, end = np.searchsorted(less, -high * p, "left"), np.searchsorted(less, -low * p, "right")
            kept.update(range(start, min(end, start + negatives)))
        places = other[order[sorted(kept)]]
        at.append(np.full(len(places), i))
        col.append(places)
    at, col = np.concatenate(at).astype(np.int64), np.concatenate(col).astype(np.int64)
    return _key_table(a_uids[at], packed(a_ids[at], a_uids[at], scores[at, col], True, ids[col], uids[col]))


def _in_blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, func) -> DataFrame:
    """Run ``func`` on every pair of an anchor block and a row block."""
    a_blocks, r_blocks = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id", "uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # new attributes, as both sides come from the same rows
    left = anchors.select(*[F.col(c).alias(f"_{c}") for c in anchors.columns]).toDF(*anchors.columns)
    left = left.withColumn("a", block(a_blocks)).withColumn("r", every(r_blocks))
    right = rows.withColumn("r", block(r_blocks)).withColumn("a", every(a_blocks))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(func, KEYS)


def _sorted(keys: DataFrame) -> DataFrame:
    return keys.repartition("part").sortWithinPartitions("key").select("key")


def _first_positives(positives: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, count = None, 0
        for batch in batches:
            kept = []
            for key in batch.column(0).to_pylist():
                if key[:16] != anchor:
                    anchor, count = key[:16], 0
                if count < positives:
                    count += 1
                    kept.append(key)
            split = [unpacked(k) for k in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.binary()), *(pa.array([s[i] for s in split], pa.int64()) for i in (0, 1, 2))],
                names=["key", "id", "uid", "score"])
    return run


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _windows(negatives: int, low: int, high: int):
    """Stream sorted keys: a positive opens a window, a negative is emitted under each window that holds it and has room."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                if key[:16] != anchor:
                    anchor, windows = key[:16], []
                anchor_id, _, score, negative, other, _ = unpacked(key)
                if not negative:
                    windows.append([other, score, 0])
                    continue
                for window in windows:
                    positive_id, positive_score, count = window
                    if count < negatives and low * positive_score <= 100 * score <= high * positive_score:
                        window[2] = count + 1
                        out.append((anchor_id, positive_id, count + 1, other, positive_score, score))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                             names=[f.split()[0] for f in MINED.split(", ")])
    return run


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``integer_rows``.

    Of each anchor's first ``positives`` rows of its label, the first ``negatives`` rows of other labels whose score is between
    ``low`` and ``high`` hundredths of the positive's.
    """
    rows = cut_lineage(rows)
    anchors = rows.where("anchor").drop("anchor")
    n_rows, n_anchors = (f.count() for f in (rows, anchors))
    rows = rows.drop("anchor")
    near = _in_blocks(anchors, rows, n_anchors, n_rows, lambda a, r: _block_positives(a, r, positives))
    schema = "key binary, id long, uid long, score long"
    chosen = cut_lineage(_sorted(near).mapInArrow(_first_positives(positives), schema))
    opened = lookup_join(anchors, chosen.groupBy("id", "uid").agg(F.collect_list("score").alias("positives")), ["id", "uid"], once=True)
    far = _in_blocks(opened, rows, n_anchors, n_rows, lambda a, r: _block_negatives(a, r, negatives, low, high))
    keys = chosen.select(F.col("uid").alias("part"), "key").unionByName(far)
    return _sorted(keys).mapInArrow(_windows(negatives, low, high), MINED)
