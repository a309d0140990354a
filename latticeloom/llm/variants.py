"""Spelling variants: words one edit apart, found by composing automata.

The vocabulary is a finite-state acceptor A. Its composition with a transducer T that makes exactly one edit (a symbol
inserted, deleted or replaced) and with A again accepts the pairs of near words. The composition is enumerated in parts, each
of which starts in one state of A:

* words of m symbols meet words of m and of m + 1 symbols in class m, so a word is in the classes m and m - 1;
* a part of class m is given by a range [a, b) of places for the edit and by what the words have before and behind that
  range. Both are the same for all near words whose first difference is in the range: T copies what stands before and behind, so
  the enumeration starts in the state that A reaches by the symbols before place a;
* first there are two ranges, the front and the back half. A part of more than ``PART_WORDS`` words is split into the halves of
  its range, again and again; a range of one place holds at most one word per symbol. No group is read whole, whatever the
  words have in common, and no pair is lost, as a pair is accepted where its first difference is.

A task streams through its parts in order. Of each it builds the minimal acceptors of its words of m and m + 1 symbols over
one register of states, and walks both along equal symbols; at each place in the range it takes an edit and goes on in the
intersection of the right languages. Equal states of the minimal acceptors have the same right language, which is then read
off without comparing. A task returns one row per word and part (number of near words, best of them), never a pair.

Defined cases: a null text has no words; a null key counts as an empty string where a mark is made from it. Repeated rows count
as often as they stand there. An empty table has no words. Columns other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeloom.distributed import lookup_join
from latticeloom.session import cut_lineage

#: Symbols of words; only A-Z are made lower-case.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A part with more words is split by the place of the edit.
PART_WORDS = 20_000
#: A word's form has at least this many times its occurrences, so chains of forms are short.
FORM_FACTOR = 2
SALTS = 16


def misspelt(doc: Column, word: Column, every: int = 97) -> Column:
    """The word, less one symbol where a checksum of document and word is a multiple of ``every``."""
    mark = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (mark % F.length(word)).cast("int")
    return F.when(mark % every == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3,
               noise_every: int | None = 97) -> DataFrame:
    """``(word, n)``: words of at least ``shortest`` symbols that occur at least ``least`` times in all texts."""
    # a run shorter than this is no word, with or without a symbol less
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))
    words = docs.select(F.col(key).alias("doc"), F.explode(runs).alias("run"))
    words = words.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    word = misspelt(F.col("doc"), F.col("run"), noise_every) if noise_every else F.col("run")
    words = words.select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def filed(words: DataFrame) -> DataFrame:
    """``(word, n, m, lo, hi)``: each word in its two classes, under the front and the back half of the places."""
    length = F.length("word")
    return (words.select("*", F.explode(F.array(length, length - 1)).alias("m"))
            .select("*", F.floor((F.col("m") + 1) / 2).cast("int").alias("half"))
            .select("*", F.explode(F.array(F.struct(F.lit(0).alias("lo"), F.col("half").alias("hi")),
                                           F.struct(F.col("half").alias("lo"), (F.col("m") + 1).alias("hi")))).alias("range"))
            .select("word", "n", "m", "range.lo", "range.hi"))


def with_part(rows: DataFrame) -> DataFrame:
    """Add ``part``: class, range, and the symbols before and behind the range."""
    # a word of m + 1 symbols has one more before what both words share
    behind = F.substr("word", F.col("hi") + F.length("word") - F.col("m") + 1)
    return rows.withColumn("part", F.concat_ws("\t", "m", "lo", "hi", F.substr("word", F.lit(1), F.col("lo")), behind))


def parts(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Words filed in parts of at most ``part_words`` words, or of one place."""
    whole, open_rows = None, with_part(filed(words))
    while True:
        large = cut_lineage(open_rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
                            .where(F.col("size") > part_words).select("part", F.lit(True).alias("large")))
        if large.isEmpty():
            return open_rows if whole is None else whole.unionByName(open_rows)
        marked = lookup_join(open_rows, large, "part", "left")
        split = F.col("large").isNotNull() & (F.col("hi") - F.col("lo") > 1)
        marked = cut_lineage(marked.withColumn("split", split).drop("large"))
        rest = marked.where(~F.col("split")).drop("split")
        whole = rest if whole is None else whole.unionByName(rest)
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("lo", half.alias("hi")), F.struct(half.alias("lo"), F.col("hi")))).alias("range")
        open_rows = with_part(marked.where("split").select("word", "n", "m", halves)
                              .select("word", "n", "m", "range.lo", "range.hi"))


class Acceptors:
    """Minimal acceptors over one register: states with the same right language are one state."""

    def __init__(self) -> None:
        self.register: dict = {}
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        self.meets: dict[tuple[int, int], list[str]] = {}

    def state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.words.append(final + sum(self.words[q] for q in arcs.values()))
        return found

    def add(self, words: list[str]) -> int:
        """Initial state of the minimal acceptor of sorted distinct words; states are closed as soon as no word can use them."""
        path: list[list] = [[False, {}]]
        last = ""
        for word in words:
            same = _common(last, word)
            self._close(path, last, same)
            path += [[False, {}] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        return self.state(*path[0])

    def _close(self, path: list[list], word: str, depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            path[-1][1][word[len(path) - 1]] = self.state(final, arcs)

    def meet(self, p: int, q: int) -> list[str]:
        """Strings that both states accept."""
        first = (p, q) if p < q else (q, p)
        stack = [first]
        while stack:
            key = p, q = stack[-1]
            if key in self.meets:
                stack.pop()
                continue
            ours, theirs = self.arcs[p], self.arcs[q]
            below = [(s, (ours[s], theirs[s]) if ours[s] < theirs[s] else (theirs[s], ours[s])) for s in ours.keys() & theirs.keys()]
            todo = [k for _, k in below if k not in self.meets]
            if todo:
                stack += todo
                continue
            found = [""] if self.final[p] and self.final[q] else []
            for s, k in below:
                found += [s + rest for rest in self.meets[k]]
            self.meets[key] = found
            stack.pop()
        return self.meets[first]


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def near_pairs(short: list[str], long: list[str], places: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart whose first difference is among the first ``places``: both of ``short``, or one of each.

    ``short`` holds strings of one length, ``long`` of one more.
    """
    every = short + long
    skip = _common(min(every), max(every))
    turned = [s[:skip - 1 if skip else None:-1] for s in every]
    tail = turned[0][:_common(min(turned), max(turned))][::-1]
    if skip >= places:
        return
    head, places = every[0][:skip], places - skip
    acceptors = Acceptors()
    first, other = (acceptors.add(sorted(s[skip:len(s) - len(tail)] for s in some)) if some else None for some in (short, long))
    arcs, meet = acceptors.arcs, acceptors.meet
    stack = [(first, other, "")]
    while stack:
        p, q, before = stack.pop()
        if len(before) >= places or (q is None and acceptors.words[p] < 2):
            continue
        ours = list(arcs[p].items())
        for i, (symbol, state) in enumerate(ours):
            for symbol2, state2 in ours[:i]:                                     # replaced
                for rest in meet(state, state2):
                    yield head + before + symbol2 + rest + tail, head + before + symbol + rest + tail
        if q is not None:
            for symbol, state in arcs[q].items():                                # inserted before another symbol
                for rest in meet(p, state):
                    # at the end of what differs, the first difference may be further on
                    behind = 0 if rest else len(tail) - len(tail.lstrip(symbol))
                    if rest[:1] != symbol and len(before) + behind < places:
                        yield head + before + rest + tail, head + before + symbol + rest + tail
        for symbol, state in ours:
            stack.append((state, None if q is None else arcs[q].get(symbol), before + symbol))


def _part_rows(rows: list[tuple[str, int]], m: int, lo: int, hi: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, occurrences of the best, the best) for the words of one part that have near words."""
    cut = m - hi if hi < m else 0                       # symbols behind the range
    middles: tuple[dict, dict] = ({}, {})
    for word, n in rows:
        middles[len(word) - m][word[lo:len(word) - cut]] = (word, n)
    if not middles[0]:
        return
    both = middles[0] | middles[1]
    best: dict[str, list] = {}
    for u, v in near_pairs(list(middles[0]), list(middles[1]), hi - lo):
        for a, b in ((u, v), (v, u)):
            word, n = both[b]
            held = best.get(a)
            if held is None:
                best[a] = [1, -n, word]
            else:
                held[0] += 1
                if (-n, word) < (held[1], held[2]):
                    held[1:] = -n, word
    for a, (count, n, word) in best.items():
        yield both[a][0], count, -n, word


NEAR = "word string, n_near long, best_n long, best string"


def near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted parts; one part is held at a time."""
    columns: tuple[list, ...] = ([], [], [], [])

    def flush() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                           names=["word", "n_near", "best_n", "best"])
        for c in columns:
            c.clear()
        return batch

    def close() -> None:
        if len(held) > 1:
            for row in _part_rows(held, *shape):
                for c, value in zip(columns, row, strict=True):
                    c.append(value)

    part, held, shape = None, [], (0, 0, 0)
    for batch in batches:
        for key, word, n, m, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("part", "word", "n", "m", "lo", "hi")),
                                           strict=True):
            if key != part:
                close()
                part, held, shape = key, [], (m, lo, hi)
                if len(columns[0]) >= 10_000:
                    yield flush()
            held.append((word, n))
    close()
    yield flush()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)`` rows without null: follow forms to a word that has none, doubling the steps."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")))
    while not at.where(~F.col("done")).isEmpty():
        # a form that many words share is one row on the right, in SALTS copies
        led_to = at.select(F.col("root").alias("word")).distinct()
        step = at.join(led_to, "word", "left_semi").select(
            F.col("word").alias("root"), F.col("root").alias("next"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = at.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        at = cut_lineage(salted.join(step, ["root", "salt"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("done")))
    return at.select("word", "root")


def variants(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for a vocabulary ``(word, n)`` of distinct words.

    ``form`` is the near word of most occurrences (ties: first in code-point order) if it has at least ``FORM_FACTOR`` times
    as many as the word, else null; ``root`` is the last word that forms lead to, the word itself where it has none.
    """
    words = cut_lineage(words)
    near = (parts(words, part_words).repartition("part").sortWithinPartitions("part").select("part", "word", "n", "m", "lo", "hi")
            .mapInArrow(near_rows, NEAR))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"),
                         F.lit(None).cast("string").alias("best"))
    rows = every.unionByName(near.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("top"))
    is_form = -F.col("top.less") >= FORM_FACTOR * F.col("n")
    found = cut_lineage(found.select("word", "n", "n_near", F.when(is_form, F.col("top.best")).alias("form"),
                                     F.when(is_form, -F.col("top.less")).alias("form_n")))
    led = roots(found.where(F.col("form").isNotNull()))
    return (found.join(led, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
