"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of words of one line or of the whole document across its line ends, or the whole line or document if it is
shorter. Windows have ``BLOCK_WORDS`` words, and for templates of more than half of that the next power of two that is at least
twice the template; they overlap by half, so every template lies whole in one of its windows, wrapped or not. A block matches a template if it holds at least ``threshold`` of the
template's distinct words. All matching blocks are found:

* the words of the templates are ordered by their document frequency over the whole corpus, rarest first;
* prefix filter: a match holds one of the template's first |T| - need + 1 words, where need = ceil(threshold |T|), so blocks
  meet templates in an inverted index over these words only (words of no template cannot match and are left out);
* length filter: the block has at least ``need`` template words;
* positional filter: what is still left in template and block after the first common word suffices for ``need``;
* the rest is verified by counting.

The templates and their index go to every task (they are a parameter, a few kilobytes); the corpus is never shuffled.

Base phrases are found apart from that, at every place where their words stand consecutively, also across lines.

Defined cases: a null or empty text has no words, no places and score 0. Repeated rows get equal results. Other columns
pass through; the columns added are replaced if present.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_WORDS = 64
#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and wording of usual license notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
)
_WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b == 0x0A
                    else 0x20 for b in range(256))


def lines_of(text: bytes | None) -> list[list[bytes]]:
    """Words of each line: A-Z lowered, words are runs of digits, letters and all characters beyond ASCII."""
    return [line.split() for line in (text or b"").translate(_WORD_BYTES).split(b"\n")]


def base_places(words: list[bytes], base: Mapping[str, str]) -> tuple[list[int], set[str]]:
    """Every word index at which a phrase starts, and the labels found."""
    joined, places, labels = b" " + b" ".join(words) + b" ", [], set()
    for phrase, label in base.items():
        wanted = b" " + phrase.encode() + b" "
        at, seen, counted = joined.find(wanted), 0, 0
        while at >= 0:
            counted += joined.count(b" ", seen, at)
            seen = at
            places.append(counted)
            labels.add(label)
            at = joined.find(wanted, at + 1)
    return places, labels


@dataclass(frozen=True)
class Index:
    """Templates as sorted ranks (rank: place in the global frequency order), and the prefix index."""

    ranks: dict[bytes, int]
    templates: list[tuple[str, list[int], int]]
    prefixes: dict[int, list[tuple[int, int]]]

    @classmethod
    def build(cls, templates, frequency: Mapping[bytes, int], threshold: float) -> Index:
        sets = [(label, {w for line in lines_of(text.encode()) for w in line}) for label, text in templates]
        vocabulary = sorted(set().union(*(s for _, s in sets)), key=lambda w: (frequency.get(w, 0), w))
        ranks = {w: i for i, w in enumerate(vocabulary)}
        rows, prefixes = [], {}
        for label, words in sets:
            if not words:
                continue
            sorted_ranks, need = sorted(ranks[w] for w in words), math.ceil(threshold * len(words) - 1e-9)
            for i, rank in enumerate(sorted_ranks[:len(words) - need + 1]):
                prefixes.setdefault(rank, []).append((len(rows), i))
            rows.append((label, sorted_ranks, need))
        return cls(ranks, rows, prefixes)

    def matches(self, block: list[int]) -> Iterator[tuple[int, float]]:
        """(template, containment) for a block given as its sorted distinct ranks."""
        tried = set()
        for j, rank in enumerate(block):
            for t, i in self.prefixes.get(rank, ()):
                if t in tried:
                    continue
                tried.add(t)                                   # this is the first common word of the two
                _, wanted, need = self.templates[t]
                if len(block) < need or 1 + min(len(wanted) - i - 1, len(block) - j - 1) < need:
                    continue
                common = len(set(wanted).intersection(block))
                if common >= need:
                    yield t, common / len(wanted)


def find_blocks(lines: list[list[bytes]], index: Index, block_words: int = BLOCK_WORDS) -> list[tuple[str, int, int, float]]:
    """(label, first word, words, containment) of every matching block and template."""
    found, base, half = [], 0, max(block_words // 2, 1)
    for words in lines:
        ranks = index.ranks
        known = [(p, ranks[w]) for p, w in enumerate(words) if w in ranks]
        starts = set()
        last = max(-(-max(len(words) - block_words, 0) // half), 0)      # number of the last window
        for p, rank in known:
            if rank in index.prefixes:
                starts.update(k * half for k in range(max(-(-(p - block_words + 1) // half), 0), min(p // half, last) + 1))
        for start in sorted(starts):
            size = min(block_words, len(words) - start)
            inside = known[bisect_left(known, (start, -1)):bisect_left(known, (start + size, -1))]
            found += [(index.templates[t][0], base + start, size, share) for t, share in
                      index.matches(sorted({r for _, r in inside}))]
        base += len(words)
    return found


def indexes_by_window(templates, frequency: Mapping[bytes, int], threshold: float, block_words: int = BLOCK_WORDS) -> list[tuple[int, Index]]:
    """Window size and index of the templates that need it; all share the frequency order of the corpus."""
    groups: dict[int, list[tuple[str, str]]] = {}
    for label, text in templates:
        size, words = block_words, sum(map(len, lines_of(text.encode())))
        while size < 2 * words:
            size *= 2
        groups.setdefault(size, []).append((label, text))
    return [(size, Index.build(group, frequency, threshold)) for size, group in sorted(groups.items())]


def document_blocks(lines: list[list[bytes]], indexes: list[tuple[int, Index]]) -> list[tuple[str, int, int, float]]:
    """The matching blocks of each line and of the whole document, in the order of their first words; equal windows once."""
    found = []
    for block_words, index in indexes:
        own = find_blocks(lines, index, block_words)
        if sum(map(bool, lines)) > 1:
            seen = {b[1:3] for b in own}
            across = find_blocks([[w for words in lines for w in words]], index, block_words)
            own += [b for b in across if b[1:3] not in seen]
        found += own
    return sorted(found, key=lambda b: b[1:3]) if len(indexes) > 1 or sum(map(bool, lines)) > 1 else found


def template_frequency(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[bytes, int]:
    """Documents that hold each word of the templates, over all rows; as many numbers as the templates have words."""
    vocabulary = frozenset(w for _, t in templates for line in lines_of(t.encode()) for w in line)

    @F.pandas_udf("array<binary>")
    def held(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(vocabulary.intersection((t or b"").translate(_WORD_BYTES).split())))

    counts = docs.select(F.explode(held(F.col(text).cast("binary"))).alias("w")).groupBy("w").count().collect()
    return {bytes(r["w"]): r["count"] for r in counts}


def scan_licences(docs: DataFrame, templates=TEMPLATES, base: Mapping[str, str] = BASE, threshold: float = 0.9,
                  block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """Add ``n_words, n_base, first_word, last_word, base_labels, labels, score`` and the matching ``blocks``.

    ``score`` is 1 with a base place, else the highest containment of a matching block, else 0.
    """
    indexes = indexes_by_window(templates, template_frequency(docs, templates, text), threshold, block_words)
    kind = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("blocks", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType()),
            T.StructField("containment", T.DoubleType())])))])

    @F.pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            lines = lines_of(t)
            words = [w for line in lines for w in line]
            places, labels = base_places(words, base)
            blocks = document_blocks(lines, indexes)
            score = 1.0 if places else max((b[3] for b in blocks), default=0.0)
            rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
                         ",".join(sorted(labels | {b[0] for b in blocks})), score,
                         [dict(zip(("label", "first", "words", "containment"), b)) for b in blocks]))
        out = pd.DataFrame(rows, columns=kind.names)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    found = docs.withColumn("_found", scan(F.col(text).cast("binary")))
    return found.withColumns({n: F.col(f"_found.{n}") for n in kind.names}).drop("_found")
