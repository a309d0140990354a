"""Near duplicates by SimHash and Golay-code fuzzy hashing.

A fingerprint has 64 bits; two fingerprints are linked when at most three differ. The bits are split into three segments
(22, 21 and 21). With three errors at most, some two segments have at most one error each: were it not so, two segments
would have two or more. Every segment, filled up to 23 bits, is decoded with the perfect binary Golay code [23, 12, 7]:

* every 23-bit word lies within 3 of exactly one codeword, whose 12 information bits are its index;
* so of two words that differ in at most one bit, the codeword nearest to the first is within 4 of the second.

A fingerprint is therefore filed under one key per pair of segments, (nearest codeword, nearest codeword), and looked up
under all codewords within 4 of both segments: 1 or 6 each, 36 keys a pair at most. No link can be missed, candidates are
verified in the join, and only true links leave it. Equal fingerprints are one row from the start, so copies make no pairs.

Defined cases: a text that is null, empty or blank has the fingerprint 0 and is linked like any other. Repeated rows have
equal fingerprints and one component. A null id counts as no id: such rows get a fingerprint and a component, but
do not name one unless the component has no other. Empty tables give empty results.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.operators.ml import connected_components
from latticeloom.session import cut_lineage

MAX_ERRORS = 3
#: Segments as (shift, width); each has at most 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101
REACH = 4


def shingles(text: bytes, words: int = 3) -> list[bytes]:
    """Word shingles with repeats: A-Z lowered, words split at ASCII white space; fewer words are one shingle."""
    found = text.lower().split()
    if len(found) < words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(words)))))


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """A bit is set if more than half of the shingles' XXH64 values have it; 0 without a word."""
    parts = shingles(text or b"", words)
    total, counts = len(parts), np.zeros(64, dtype=np.int64)
    for at in range(0, total, 65_536):                          # very long texts: 4 MB of bits at a time
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in parts[at:at + 65_536]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _parity(word: int) -> int:
    """The 11 check bits: the remainder of ``word`` * x^11 by the generator."""
    rest = word << 11
    for bit in range(22, 10, -1):
        if rest >> bit & 1:
            rest ^= GENERATOR << (bit - 11)
    return rest


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(check bits of each 12-bit index, nearest error of each syndrome, error patterns within ``REACH`` by syndrome)."""
    parity = np.array([_parity(i) for i in range(4096)], dtype=np.int32)
    syndrome = np.array([parity[b >> 11] ^ (b & 2047) for b in (1 << np.arange(23))], dtype=np.int32)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    level = [(0, 0, -1)]
    for _ in range(REACH + 1):
        for error, s, _last in level:
            patterns[s].append(error)
        level = [(e | 1 << b, s ^ int(syndrome[b]), b) for e, s, last in level for b in range(last + 1, 23)]
    nearest = np.array([p[0] for p in patterns], dtype=np.int32)
    return parity, nearest, [np.array(p, dtype=np.int32) for p in patterns]


def syndromes(words: np.ndarray) -> np.ndarray:
    return code_tables()[0][words >> 11] ^ (words & 2047)


def nearest_codewords(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within 3 of each 23-bit word."""
    return (words ^ code_tables()[1][syndromes(words)]) >> 11


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within ``REACH`` of each word: (owner, index)."""
    patterns = code_tables()[2]
    found = [patterns[s] for s in syndromes(words)]
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    return owner, (words[owner] ^ np.concatenate([np.empty(0, np.int32), *found])) >> 11


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    bits = prints.view(np.uint64)
    return [(bits >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int32) for shift, width in SEGMENTS]


def filed_keys(prints: np.ndarray) -> np.ndarray:
    """One key for each fingerprint (row) and pair of segments (column)."""
    near = [nearest_codewords(s).astype(np.int64) for s in _segments(prints)]
    return np.stack([(p << 24) | near[i] << 12 | near[j] for p, (i, j) in enumerate(PAIRS)], axis=1)


def lookup_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys under which each fingerprint is looked up: (owner, key)."""
    near = [near_codewords(s) for s in _segments(prints)]
    owners, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        a = pd.DataFrame({"o": near[i][0], "a": near[i][1].astype(np.int64)})
        b = pd.DataFrame({"o": near[j][0], "b": near[j][1].astype(np.int64)})
        both = a.merge(b, on="o")
        owners.append(both["o"].to_numpy())
        keys.append((p << 24) | both["a"].to_numpy() << 12 | both["b"].to_numpy())
    return np.concatenate(owners), np.concatenate(keys)


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3, name: str = "_print") -> DataFrame:
    """Add the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, prints(F.col(text).cast("binary")))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(prints: DataFrame, name: str = "_print", max_errors: int = MAX_ERRORS) -> DataFrame:
    """All pairs ``(a, b)`` with a < b of the distinct fingerprints in ``prints`` that differ in at most ``max_errors`` bits."""
    if not 0 <= max_errors <= MAX_ERRORS:
        raise ValueError(f"the keys find up to {MAX_ERRORS} differing bits")
    one = prints.select(F.col(name).alias("p")).distinct()

    @F.pandas_udf("array<int>")
    def filed(values: pd.Series) -> pd.Series:
        return pd.Series(list(filed_keys(values.to_numpy(dtype=np.int64)).astype(np.int32)))

    @F.pandas_udf("array<int>")
    def looked_up(values: pd.Series) -> pd.Series:
        owner, key = lookup_keys(values.to_numpy(dtype=np.int64))
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(1, len(values)))
        return pd.Series(np.split(key[order].astype(np.int32), ends))

    files = one.select(F.col("p").alias("a"), F.explode(filed("p")).alias("key"))
    looks = one.select(F.col("p").alias("b"), F.explode(looked_up("p")).alias("key"))
    near = (F.col("a") != F.col("b")) & (distance(F.col("a"), F.col("b")) <= max_errors)
    # the planner does not know that a fingerprint becomes some 80 rows here, and would broadcast them as a small table
    return (files.hint("merge").join(looks.hint("merge"), (files["key"] == looks["key"]) & near)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3,
                    max_errors: int = MAX_ERRORS) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row: 16 hex digits, and the smallest id that links reach."""
    rows = cut_lineage(with_fingerprint(docs.select(id_col, text), text, words).select(id_col, "_print"))
    nodes = cut_lineage(rows.groupBy("_print").agg(F.min(id_col).alias("_least")))
    parts = connected_components(fingerprint_links(nodes, "_print", max_errors))
    placed = cut_lineage(nodes.join(parts, nodes["_print"] == parts["id"], "left")
                         .select("_print", "_least", F.coalesce("component", "_print").alias("_root")))
    # one row for each fingerprint that is linked with others
    least = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    owner = placed.join(least, "_root").select("_print", "component_id")
    return rows.join(owner, "_print").select(
        id_col, F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")
