"""Spelling variants against brute force, with parts split down to single places."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from latticeloom.llm import variants


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute(words):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 2 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def found(spark, words, **more):
    got = variants.variants(spark.createDataFrame(sorted(words.items()), "word string, n long"), **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("part_words", [20_000, 3])
def test_brute_force(spark, part_words):
    draw = random.Random(3)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(5, 8))): draw.choice([3, 3, 4, 8, 17, 40]) for _ in range(300)}
    words |= {"a" * k: 2 ** (k - 3) for k in range(5, 30)}               # a chain of forms
    assert found(spark, words, part_words=part_words) == brute(words)


def test_walk():
    draw = random.Random(1)
    for _ in range(500):
        m, tail, head = draw.randint(1, 6), "a" * draw.randint(0, 3), "b" * draw.randint(0, 2)
        short, long = ([head + w + tail for w in {"".join(draw.choice("abc") for _ in range(size)) for _ in range(draw.randint(1, 12))}]
                       for size in (m, m + 1))
        places = draw.randint(1, m + 4)
        pairs = [*itertools.combinations(short, 2), *itertools.product(short, long)]
        want = sorted(tuple(sorted(p)) for p in pairs if one_edit(*p) and variants._common(*p) < places)
        assert sorted(tuple(sorted(p)) for p in variants.near_pairs(short, long, places)) == want


def test_very_long_words(spark):
    words = {"a" * 60_000: 9, "a" * 59_999: 3, "a" * 30_000 + "b" + "a" * 29_999: 4, "b" * 60_000: 5}
    assert found(spark, words) == brute(words)


def test_vocabulary(spark):
    texts = [(i, t) for i, t in enumerate(["Straße STRASSE straße Ähre", None, "", "naïve-naïve_naïve naïv", "x" * 9 + "1" + "y" * 4] * 300)]
    texts += [(None, "Straße größer"), (7, "größer größer")] * 50
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    count = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 5
    want = {w: n for w, n in count.items() if n >= 3}
    got = {r["word"]: r["n"] for r in variants.vocabulary(docs).collect()}
    assert got == want and "xxxxxxxxx" in got and any(len(w) == 5 for w in got)
    assert found(spark, got) == brute(want)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.vocabulary(docs)).collect() == []
