"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text knows every substring of that sample. A document
is parsed greedily: from each position the longest match is one phrase, and a byte that the sample lacks is a phrase of its
own. A phrase costs as many bits as it takes to point into the sample, so

    cost(language) = phrases * log2(bytes of the sample) / bytes of the document

and the language of the least cost wins; ties go to the smallest name. Text is normalised to lower-case UTF-8 bytes in which
each run of ASCII non-letters is one space. Long texts are cut into blocks of ``BLOCK`` bytes that are parsed side by side, each as
if a phrase began with it. Then the phrase that runs into a block is carried on from the block before, until one of its ends falls on
an end of the block's own parse, after which both are the same. So phrases cross the borders, and the count is that of
the whole text parsed from its first byte.

Automata are dense tables (states x distinct bytes), so any script takes the same space per byte of sample: at most
``2 * sample_bytes`` states. All documents of a batch advance together, one byte a step, in NumPy.

Defined cases: text that is null or has no letter gets ``und`` and score 0. Rows with a null ``lang`` are not learned from.
With nothing to learn from, every text is ``und``. Repeated rows get equal results. Other columns pass through;
``lang_pred``, ``score`` and ``entropy`` are replaced if present.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
UNKNOWN = "und"
#: Bytes that are parsed together.
STRIDE = 4_000_000
_KEPT = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))


def normalised(text: str | None) -> bytes:
    """Lower-case UTF-8 with one space for each run of ASCII non-letters; empty if there is no letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_KEPT).split())


class Automaton:
    """Suffix automaton of ``text``; ``table[state * width + code]`` is the next state, or -1."""

    def __init__(self, text: bytes):
        nexts, link, length, last = [{}], [-1], [0], 0
        for c in text:
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        known = sorted(set(text))
        self.width = len(known) + 1
        self.codes = np.zeros(256, dtype=np.int32)            # 0: a byte that the sample lacks
        self.codes[known] = np.arange(1, self.width)
        self.table = np.full(len(nexts) * self.width, -1, dtype=np.int32)
        places = [s * self.width + int(self.codes[c]) for s, t in enumerate(nexts) for c in t]
        self.table[places] = [v for t in nexts for v in t.values()]
        self.bits = float(np.log2(len(text) + 1))

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a phrase begins with this byte, and the state after it; -1 after a byte that the sample lacks."""
        after = self.table[np.maximum(state, 0) * self.width + code]
        begins = (state < 0) | (after < 0)
        return begins, np.where(begins, self.table[:self.width][code], after)

    def parse(self, lanes: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin in each lane (steps, lanes), and the last state of each; the first ``active[t]`` lanes have a
        byte at step t."""
        begins = np.zeros(lanes.shape, dtype=bool)
        state = np.full(lanes.shape[1], -1, dtype=np.int32)
        for t, n in enumerate(active):
            begins[t, :n], state[:n] = self.step(state[:n], self.codes[lanes[t, :n]])
        return begins, state

    def carried(self, lanes: np.ndarray, begins: np.ndarray, last: np.ndarray, held: np.ndarray, columns: np.ndarray,
                state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parse the lanes ``columns`` again from the states before them, as far as they differ from ``begins``: how many more
        phrases begin there (or fewer, below 0), and the last state of each."""
        more, state, open_ = np.zeros(len(columns), dtype=np.int64), state.copy(), np.arange(len(columns))
        t = 0
        while len(open_):
            at = columns[open_]
            starts, after = self.step(state[open_], self.codes[lanes[t, at]])
            met = starts & begins[t, at]
            more[open_] += np.where(met, 0, starts.astype(np.int64) - begins[t, at])
            state[open_] = np.where(met, last[at], after)
            t += 1
            open_ = open_[~met & (held[at] > t)]
        return more, state


def phrase_counts(texts: list[bytes], automata: list[Automaton], block: int = BLOCK) -> np.ndarray:
    """Phrases of each text (rows) under each automaton (columns)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    blocks = -(-sizes // block)
    owner = np.repeat(np.arange(len(texts)), blocks)
    counts = np.zeros((len(texts), len(automata)), dtype=np.int64)
    if not len(owner):
        return counts
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    held = np.minimum(sizes[owner] - nth * block, block)
    first = (np.cumsum(sizes) - sizes)[owner] + nth * block
    order = np.argsort(-held, kind="stable")
    owner, held, first = owner[order], held[order], first[order]
    data = np.frombuffer(b"".join(texts) + bytes(block), dtype=np.uint8)
    lanes = np.empty((held[0], len(owner)), dtype=np.uint8)
    for t in range(len(lanes)):
        lanes[t] = data[first + t]
    active = np.searchsorted(-held, -np.arange(held[0]), side="left")
    column = np.empty(len(owner), dtype=np.int64)                   # lane of each block in the order of the text
    column[order] = np.arange(len(owner))
    begin = np.cumsum(blocks) - blocks
    for k, automaton in enumerate(automata):
        begins, last = automaton.parse(lanes, active)
        counts[:, k] = np.bincount(owner, weights=begins.sum(axis=0), minlength=len(texts))
        long = np.flatnonzero(blocks > 1)
        state = last[column[begin[long]]]
        nth = 1
        while len(long):
            more, state = automaton.carried(lanes, begins, last, held, column[begin[long] + nth], state)
            counts[long, k] += more
            nth += 1
            goes_on = blocks[long] > nth
            long, state = long[goes_on], state[goes_on]
    return counts


def decide(texts: list[str | None], langs: list[str], automata: list[Automaton]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and entropy (bits a byte under that language) of each text.

    The score is 1 - least cost / second least cost, and 1 with a single language.
    """
    names, scores, entropy = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if not langs:
        return names, scores, entropy
    bits, at = np.array([a.bits for a in automata]), 0
    while at < len(texts):
        low, size = [], 0                                       # only what is parsed together is held normalised
        while at + len(low) < len(texts) and size < STRIDE:
            low.append(normalised(texts[at + len(low)]))
            size += len(low[-1])
        costs = phrase_counts(low, automata) * bits
        for i, t in enumerate(low):
            if t:
                best = int(np.argmin(costs[i]))
                second = np.min(np.delete(costs[i], best)) if len(langs) > 1 else np.inf
                names[at + i], scores[at + i], entropy[at + i] = langs[best], 1.0 - costs[i, best] / second, costs[i, best] / len(t)
        at += len(low)
    return names, scores, entropy


def training_samples(docs: DataFrame, train: Column | None = None, sample_bytes: int = 40_000,
                     docs_per_lang: int = 64) -> dict[str, bytes]:
    """Normalised sample text of each language: at most ``sample_bytes`` bytes from ``docs_per_lang`` texts.

    Texts are chosen by hash, each distinct text once, so a large group of copies cannot fill the sample. Only hashes are
    shuffled; the texts follow by a join with the chosen hashes, of which there are ``docs_per_lang`` per language.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(train) if train is not None else rows
    keyed = rows.select("lang", F.xxhash64("text").alias("_h"), "text")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    chosen = keyed.select("lang", "_h").distinct().withColumn("_n", nth).where(F.col("_n") <= docs_per_lang).drop("_n")
    got = (keyed.join(F.broadcast(chosen), ["lang", "_h"])
           .groupBy("lang", "_h").agg(F.min(F.substring("text", 1, sample_bytes)).alias("text"))
           .orderBy("lang", "_h").toPandas())
    samples = {}
    for lang, part in got.groupby("lang", sort=True):
        texts = [t for t in map(normalised, part["text"]) if t]
        share = sample_bytes // max(len(texts), 1)
        joined = b" ".join(sorted(texts, key=len)) if sum(map(len, texts)) <= sample_bytes else _balanced(texts, sample_bytes, share)
        if joined:
            samples[lang] = joined
    return samples


def _balanced(texts: list[bytes], total: int, share: int) -> bytes:
    """At least ``share`` bytes of each text that has them, the rest in order until ``total`` is reached."""
    parts, left = [], total
    for i, t in enumerate(sorted(texts, key=len)):
        part = t[:max(share, left // (len(texts) - i))]
        parts.append(part)
        left -= len(part)
    return b" ".join(parts)


def identify_language(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``entropy`` to every row; reads ``text`` only."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted(samples.items()))

    @F.pandas_udf("lang_pred string, score double, entropy double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        automata = [Automaton(text) for _, text in known]       # they go with the task: a worker serves later steps too
        for texts in batches:
            names, scores, entropy = decide(list(texts), [lang for lang, _ in known], automata)
            yield pd.DataFrame({"lang_pred": names, "score": scores, "entropy": entropy})

    found = docs.withColumn("_found", predict(F.col("text")))
    return found.withColumns({c: F.col(f"_found.{c}") for c in ("lang_pred", "score", "entropy")}).drop("_found")
