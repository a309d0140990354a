"""Text operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticeloom.llm import chat, language, licences, mixing, neartexts, packing, quality, queries, sharding, simhash

FOLDER = "/root/testdata/sf0.001"
WORDS = "red blue green stone river cloud paper light seven under above garden window yellow silver copper".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = prose(1, 120)
    rows = [(1, base), (2, base), (3, base + " extra"), (4, None), (5, ""), (6, "   \n "), (7, "word"), (8, prose(2, 30_000)),
            (None, prose(3, 50)), (9, prose(3, 50)), (9, prose(3, 50)), (10, "Ünïcode straße ΣΑΣ 中文 'tis 12's"), (11, "123 456")]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "src", 5) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_quality_held_out(spark):
    got = queries.op1_quality(spark, FOLDER).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    held = labels[got.loc[labels.doc_id, "held_out"].to_numpy()]
    assert (got.loc[held.doc_id, "predicted"].to_numpy() == held.quality.to_numpy()).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in got.held_out.items())


def test_dual_descent_separates_and_is_bounded():
    docs = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])]
    good = np.array([True, True, False, False])
    ratios = quality.log_count_ratios(docs, good, bits=2)
    assert ratios[0] > 0 > ratios[3] and abs(ratios[1]) < 1e-9
    weights, bias = quality.fit_hinge(docs, good, ratios)
    assert [float(weights[d] @ ratios[d]) + bias > 0 for d in docs] == good.tolist()


def test_quality_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(odd, quality.fit_quality(odd, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    out = quality.score_quality(odd.withColumn("score", odd.n_chars), quality.fit_quality(odd, one))
    assert all(r.predicted == 1 for r in out.collect()) and out.count() == odd.count()
    assert quality.score_quality(odd.limit(0), quality.fit_quality(odd, one)).count() == 0


def brute_phrases(text, sample):
    count = i = 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i:i + n + 1] in sample:
            n += 1
        i, count = i + max(n, 1), count + 1
    return count


def test_phrases_equal_brute_force():
    r = random.Random(5)
    samples = [bytes(r.choice(b"abc ") for _ in range(300)) for _ in range(2)]
    texts = [bytes(r.choice(b"abcd ") for _ in range(n)) for n in (0, 1, 7, 512, 513, 2000)]
    got = language.phrase_counts(texts, [language.Automaton(s) for s in samples])
    assert got.tolist() == [[brute_phrases(t, s) for s in samples] for t in texts]


def test_languages(spark, odd):
    got = queries.op5_language(spark, FOLDER).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    assert (got.loc[docs.doc_id, "lang_pred"].to_numpy() == docs.lang.to_numpy()).mean() > 0.97
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(odd, {"en": b"red blue", "de": b"rot blau"}).collect()}
    assert all(out[i] == ("und", 0.0) for i in (4, 5, 6, 11)) and out[7][0] in ("en", "de") and out[10][0] in ("en", "de")
    assert {r.lang_pred for r in language.identify_language(odd, {}).collect()} == {"und"}
    assert language.training_samples(odd.limit(0)) == {}


def test_golay_code():
    parity, nearest, patterns = simhash.code_tables()
    words = (np.arange(4096) << 11) | parity
    distances = np.bitwise_count(words[:, None] ^ words[None, :])
    assert distances[distances > 0].min() == 7
    some = np.random.default_rng(1).integers(0, 1 << 23, 300).astype(np.int32)
    far = np.bitwise_count(some[:, None] ^ words[None, :])
    assert (far.argmin(axis=1) == simhash.nearest_codewords(some)).all() and far.min(axis=1).max() <= 3
    owner, index = simhash.near_codewords(some)
    assert sorted(zip(owner.tolist(), index.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(far <= 4))))


def test_keys_meet_within_three_errors():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, 400, dtype=np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(63, 3, replace=False):
            b[i] ^= np.int64(1) << np.int64(bit)
    filed = simhash.filed_keys(a)
    owner, key = simhash.lookup_keys(b)
    assert all(set(filed[i]) & set(key[owner == i]) for i in range(len(a)))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_simhash_against_brute_force(spark, odd):
    docs = odd.unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").select(odd.columns))
    rows = docs.select("doc_id", "text").collect()
    prints = [simhash.fingerprint((r.text or "").encode()) for r in rows]
    root = components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = collections.defaultdict(lambda: 1 << 60)
    for r, k in zip(rows, root):
        least[k] = min(least[k], r.doc_id if r.doc_id is not None else 1 << 60)
    want = collections.Counter((r.doc_id, f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, root))
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_texts_against_brute_force(spark, odd):
    edited = [(100 + i, " ".join(w if k != 10 * i else "changed" for k, w in enumerate(prose(1, 120).split())), None, "s", 1)
              for i in range(1, 9)]
    docs = odd.unionByName(spark.createDataFrame(edited, odd.schema))
    rows = docs.select("doc_id", "text").collect()
    sets = [neartexts.shingle_set((r.text or "").encode(), 5) for r in rows]
    root = components(len(rows), lambda i, j: neartexts.jaccard(sets[i], sets[j]) >= 0.8)
    key = lambda i: -1 if rows[i].doc_id is None else rows[i].doc_id
    want = {min((key(i) for i in range(len(rows)) if root[i] == k)) for k in set(root)}
    got = neartexts.one_of_each_group(docs)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == sorted(want) and got.columns == docs.columns
    assert neartexts.one_of_each_group(docs.limit(0)).count() == 0


def test_boilerplate_family_against_brute_force(spark):
    """2,400 texts with similarity 0.75 through shared boilerplate; every third has one near copy, which is not its centre."""
    shared, rows = prose(70, 154), []
    for i in range(1800):
        tail = prose(1000 + i, 25).split()
        rows.append((2 * i, f"{shared} {' '.join(tail)}"))
        if i % 3 == 0:
            rows.append((2 * i + 1, f"{shared} {' '.join(tail[:12])} {prose(9000 + i, 13)}"))
    sets = [set(simhash.shingles(t.encode(), 5)) for _, t in rows]
    number = {s: i for i, s in enumerate(s for s, n in collections.Counter(s for x in sets for s in x).items() if n > 1)}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, x in enumerate(sets):
        has[i, [number[s] for s in x if s in number]] = 1
    common, size = has @ has.T, np.array([len(x) for x in sets])
    linked = common >= 0.8 * (size[:, None] + size[None, :] - common)
    root = components(len(rows), lambda i, j: linked[i, j])
    want = {min(rows[i][0] for i in range(len(rows)) if root[i] == k) for k in set(root)}
    assert len(rows) == 2400 and len(want) < 1900
    got = {r.doc_id for r in neartexts.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("texts,common", [(10_000, 1_000_000), (30, 1_000_000), (1, 1_000_000), (10_000, 0), (30, 5)])
def test_rest_pairs_are_all_found_whatever_is_counted(spark, monkeypatch, texts, common):
    """How many texts' shingles are counted, and how many counts are told, decides the order of shingles; every close pair of two roots is there."""
    monkeypatch.setattr(neartexts, "COUNTED_TEXTS", texts)
    monkeypatch.setattr(neartexts, "COMMON_SHINGLES", common)
    rng = np.random.default_rng(12)
    sets = [frozenset(rng.choice(60, size=rng.integers(1, 40), replace=False).tolist()) for _ in range(60)]
    for s in sets[:60]:
        some = sorted(s)
        sets += [frozenset(some[len(some) // k:]) for k in (5, 6, 9)] + [s | {100, 101}, s]    # some at just 0.8
    hashed = rng.integers(-2 ** 63, 2 ** 63 - 1, size=200, dtype=np.int64).astype("<u8")
    rows = [(i, i % 50, bytearray(np.sort(hashed[sorted(s)]).tobytes())) for i, s in enumerate(sets)] + [(1000, 1000, bytearray()), (1001, 1001, bytearray())]
    got = {tuple(sorted(r)) for r in neartexts.rest_pairs(spark.createDataFrame(rows, "node long, root long, s binary"), 0.8).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if i % 50 != j % 50 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(want) > 300 and want <= got


def test_many_texts_of_a_key_meet_their_centre(monkeypatch):
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 62)
    prints = np.array([centre] + [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.choice(60, (900, 2))], dtype=np.int64)
    one = np.unique(prints.view(np.uint64))
    pairs, middle, whole = neartexts.near_in_part(one, 5)
    other = neartexts.near_in_part(one, 6)[0]
    # under every second key each, and the key is told as not wholly compared
    assert middle == centre and not whole and 0.3 * len(one) < len(pairs) < 0.7 * len(one)
    assert set(map(tuple, pairs.tolist())) != set(map(tuple, other.tolist()))
    monkeypatch.setattr(neartexts, "CROWD", 10_000)
    pairs, middle, whole = neartexts.near_in_part(one, 5)
    assert middle == centre and set(one.tolist()) == set(pairs.ravel().tolist()) and len(pairs) <= 2 * len(one) and not whole
    few, _, whole = neartexts.near_in_part(one[:4], 5)
    assert whole and len(few) == 6


@pytest.mark.parametrize("part", [5, 2048])
@pytest.mark.parametrize("batch", [3, 5000])
def test_nodes_still_apart(monkeypatch, part, batch):
    """Texts with a near one of another component, whatever the batches; all of them where a key has too many."""
    monkeypatch.setattr(neartexts, "PART", part)
    r = np.random.default_rng(5)
    rows = []
    for key, n in enumerate([1, 2, 40, 3, 60]):
        centre = int(r.integers(0, 1 << 62))
        for i in range(n):
            bits = r.choice(60, 5 if i % 3 else 30, replace=False)
            rows.append((key, centre ^ int(sum(1 << int(b) for b in bits)), 100 * key + i, int(r.integers(0, 2))))
    rows.sort(key=lambda x: (x[0], x[1]))
    batches = (pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows[i:i + batch]], pa.int32() if c == 0 else pa.int64()) for c in range(4)],
                                          names=["key", "print", "node", "root"]) for i in range(0, len(rows), batch))
    got = {x["node"] for b in neartexts._still_apart(batches) for x in b.to_pylist()}
    close = {x[2] for x in rows for y in rows if x[0] == y[0] and x[3] != y[3] and (x[1] ^ y[1]).bit_count() <= neartexts.MOST_BITS}
    large = {x[2] for x in rows if sum(y[0] == x[0] for y in rows) > part}
    assert got == close | large and len(close) > 20


@pytest.mark.parametrize("batch", [1, 7, 5000])
@pytest.mark.parametrize("part", [2, 16, 4096])
def test_parts_of_a_key_stay_linked(monkeypatch, part, batch):
    """Near fingerprints of one key are one component, whatever the parts and batches; other keys stay apart. Keys of which not
    all near pairs are given are told."""
    monkeypatch.setattr(neartexts.KeyPairs.__init__, "__defaults__", (0, part))
    monkeypatch.setattr(neartexts, "CROWD", 10_000)
    r = np.random.default_rng(4)
    rows, groups = [], []
    for key, n in enumerate([1, 2, 3, 300, 2, 1]):
        centre = int(r.integers(0, 1 << 62))
        own = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.choice(60, (n, 2))})
        rows += [(key, p) for p in own for _ in range(2 if n == 300 else 1)]
        groups.append(set(own))
    batches = (pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i:i + batch]], pa.int32()),
                                           pa.array([p for _, p in rows[i:i + batch]], pa.int64())], names=["key", "print"])
               for i in range(0, len(rows), batch))
    out = [x for b in neartexts._candidates(batches) for x in b.to_pylist()]
    pairs = {(x["a"], x["b"]) for x in out if x["key"] is None}
    told = {x["key"] for x in out if x["key"] is not None}
    # keys in parts are always told; with parts of two, a key of two may be one
    assert told == {3} if part > 3 else {2, 3} <= told <= {1, 2, 3, 4}
    root = {p: p for g in groups for p in g}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p
    for a, b in pairs:
        root[top(a)] = top(b)
    found = {}
    for p in root:
        found.setdefault(top(p), set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(odd, run_tokens=6_000).toPandas()
    texts = odd.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, tuple(whole.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in texts)
    got = collections.Counter()
    at, parts = {}, []
    for p in pieces.to_dict("records"):
        assert p["length"] * 4 == len(p["ids"]) and p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
        parts = parts if p["start"] else []
        parts += np.frombuffer(p["ids"], dtype="<u4").tolist()
        if len(parts) == p["doc_tokens"]:
            got[(None if p["doc_id"] != p["doc_id"] else int(p["doc_id"]), tuple(parts))] += 1
    assert got == want and max(at.values()) <= 4096
    assert packing.pack(odd.limit(0)).count() == 0


def test_pieces_equal_whole_texts():
    coder, r = packing.Pieces(None), random.Random(4)
    parts = ["a", "B", "'s", "é", "́", " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "...", ",", "Σ", "中", "😀", "\x85", "the", ";"]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert np.frombuffer(coder.encode([t.encode()])[0], "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_latin_words_go_to_the_merges(monkeypatch):
    """Words of Latin-1 letters and signs at a word's end do not go through the whole tokenizer, and ids stay the same."""
    coder = packing.Pieces(None)
    texts = [t.encode() for t in ("schöne Wörter&&& Été, ÉTÉ. x#$%", "words&&& a`` b.\v c.\f 12ß3!! déjà-vu", "")]
    wanted = coder._full(texts)
    monkeypatch.setattr(coder, "_full", lambda pieces: pytest.fail(f"{pieces}"))
    assert coder.encode(texts[:2]) == wanted[:2] and wanted[2] == b""
    assert b"words" in coder.known and b"words&&&" not in coder.known


def test_cuts_cost_least():
    r = random.Random(6)
    for _ in range(60):
        cuts = np.cumsum([r.randrange(1, 9) for _ in range(12)])
        cost = np.array([r.choice([0.0, 2.0, 5.0]) for _ in cuts])
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        best = {0: 0.0}
        for j, p in zip(cuts.tolist(), cost):
            best[j] = min(v + pad(j - i) for i, v in best.items() if j - i <= 16) + p + 1.0
        ends = packing.choose_cuts(cuts, cost, 16, 1.0)
        lengths = np.diff(np.concatenate([[0], ends]))
        total = sum(pad(int(n)) for n in lengths) + sum(cost[np.searchsorted(cuts, ends)]) + len(ends)
        assert lengths.max() <= 16 and ends[-1] == cuts[-1] and abs(total - best[int(cuts[-1])]) < 1e-9


def test_raked_margins(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = mixing.mix_sources(docs, queries.TARGETS, mixing.topic_by_markers(queries.TOPICS), 0.5)
    assert 0.2 < kept.count() / docs.count() < 0.8 and set(docs.columns) < set(kept.columns)
    cells = spark.createDataFrame([("a", "x", "p", 90), ("a", "y", "p", 10), ("b", "x", "p", 20), ("b", "y", "q", 80)],
                                  "_source string, _lang string, _topic string, tokens long")
    rows = mixing.raked_cells(cells, ["_source", "_lang"], {"_source": {"a": 3, "b": 1}, "_lang": 1.0}, 30, 0.0).collect()
    assert abs(sum(r.share for r in rows if r._source == "a") - 0.75) < 1e-6
    assert abs(sum(r.share for r in rows if r._lang == "x") - 0.55) < 1e-6
    everything = mixing.mix_sources(odd, {"source": 1.0, "lang": 1.0, "topic": 1.0}, mixing.topic_by_markers({"t": ["1"]}), 1.0)
    assert everything.count() == odd.count()
    assert mixing.mix_sources(odd.limit(0), queries.TARGETS, mixing.topic_by_markers(queries.TOPICS)).count() == 0


def test_margin_report(spark):
    rows = [(i, "s" if i % 2 else "t", "en" if i % 4 else "de", ("rare " if i < 4 else "plain ") * 40) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    targets = {"source": {"s": 0.5, "t": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"rare": 0.3, "prose": 0.7}}
    got = {(r["margin"], r["value"]): r for r in mixing.margin_report(docs, targets, mixing.topic_by_markers({"rare": ["rare"]}), 0.5).collect()}
    assert len(got) == 6 and all(abs(r["raked"] - r["target"]) < 0.02 for r in got.values())
    # four documents of 200 cannot be three tenths of half of all tokens
    rare = got["topic", "rare"]
    assert rare["target"] == pytest.approx(0.3) and rare["expected"] == pytest.approx(rare["target"] - rare["shortfall"]) and rare["shortfall"] > 0.2
    assert got["topic", "prose"]["shortfall"] == 0.0
    assert mixing.margin_report(docs.limit(0), targets, mixing.topic_by_markers({"rare": ["rare"]})).count() == 0


def test_scores_against_plain_features(spark, odd):
    """Features by counting n-grams one by one, scores by summing their weights."""
    def plain(text):
        low = text.lower()
        words, found = low.split(), set()
        back = [next((k for k in range(1, quality.BACK + 1) if i >= k and words[i - k] == w), 0) for i, w in enumerate(words)]
        for kind, codes in ((0, [b + 1 for b in low]), (1, [d + 1 for d in back])):
            for n in range(1, quality.MAX_N + 1):
                for i in range(len(codes) - n + 1):
                    h = codes[i]
                    for c in codes[i + 1:i + n]:
                        h = (h * 0x9E3779B1 + c) & 0xFFFFFFFF
                    h = ((h ^ h >> 15) * 0x85EBCA6B + 16 * kind + n) & 0xFFFFFFFF
                    found.add((h ^ h >> 13) >> 32 - quality.BITS)
        return found

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars < 3000")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit_quality(docs, labels, train=queries.fold(3) != 1)
    rows = quality.score_quality(docs.select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text")), model).collect()
    for r in rows:
        text = (r["text"] or "").encode()
        if len(text) > 5000:
            continue
        found = plain(text)
        assert found == set(quality.features(text).tolist())
        size = math.sqrt(sum(float(model.ratios[f]) ** 2 for f in found))
        m = sum(float(model.weights[f]) * float(model.ratios[f]) for f in found) / size + model.bias if size else model.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-4 * m)), abs=1e-9) and r["predicted"] == (r["score"] >= 0.5)


@pytest.mark.parametrize("block", [4, 7, 512])
def test_phrases_cross_blocks(block):
    """Phrases of blocks equal those of a text parsed byte by byte from its start by looking for the longest match."""
    r = random.Random(block)
    sample = "".join(r.choice("abc ") for _ in range(400)).encode()
    texts = [b"", b"a", b"zz"] + ["".join(r.choice("abc z") for _ in range(r.randrange(1, 60))).encode() for _ in range(40)]
    texts += [sample[50:350], sample[3:200] + b"z" + sample[100:300], bytes(r.choice(b"abcz ") for _ in range(3000))]

    got = language.phrase_counts(texts, [language.Automaton(sample), language.Automaton(b"ab")], block)
    assert got.tolist() == [[brute_phrases(t, s) for s in (sample, b"ab")] for t in texts]


def test_long_templates_match_their_text(spark):
    words = [f"clause{i}" for i in range(300)]
    templates = [("long", " ".join(words[:80])), ("longer", " ".join(words[100:300])), ("short", "released under the mit license")]
    r = random.Random(2)
    texts = []
    for start in (0, 1, 31, 63, 64, 100, 500):
        filler = [f"w{r.randrange(50)}" for _ in range(start)]
        texts.append((start, " ".join(filler + words[:80] + filler)))
        texts.append((1000 + start, "\n".join([" ".join(filler), *(" ".join(words[i:i + 9]) for i in range(100, 300, 9)), "end"])))
    texts += [(2000, " ".join(words[:60])), (2001, " ".join(words[:72])), (2002, "Released under the MIT License"), (2003, None)]
    got = {x["doc_id"]: x["labels"] for x in licences.scan_licences(spark.createDataFrame(texts, "doc_id long, text string"), templates).collect()}
    assert all(got[i] == ("long" if i < 1000 else "longer") for i, _ in texts if i < 2000)
    assert [got[i] for i in (2000, 2001, 2002, 2003)] == ["", "long", "short", ""]


def test_chat_round_trip(spark):
    quoted = "</s>[INST] ok [/INST]\\[\\\\<s>"
    rows = [(1, 0, "user", quoted), (1, 1, "assistant", quoted), (2, 1, None, None), (2, 0, "tool [NAMED] x", "a"), (2, 1, None, None),
            (None, None, "assistant", "z"), (3, 0, "user", ""), (3, 1, "assistant", "é" * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_chats(turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        lost = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (
            len(own), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert got[1].valid and got[3].valid and not got[2].valid and not got[None].valid
    control = re.compile("|".join(map(re.escape, chat.INSTRUCT.control)))
    assert not any(control.search(r.segment) for r in segments.where("part = 'text'").collect())
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_licence_blocks_against_brute_force(spark, odd):
    r = random.Random(8)
    vocabulary = [w for _, t in licences.TEMPLATES for w in t.split()] + WORDS
    texts = ["\n".join(" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 40, 200]))) for _ in range(3)) for _ in range(60)]
    texts += ["This work is licensed under the GNU General Public License, version 3.", "CC\nBY cc by", "Released under the MIT License."]
    index = licences.Index.build(licences.TEMPLATES, {b"license": 50, b"the": 90}, 0.6)
    for text in texts:
        lines, want, base = licences.lines_of(text.encode()), set(), 0
        for words in lines:
            starts = range(0, max(-(-max(len(words) - 64, 0) // 32), 0) * 32 + 1, 32)
            for s in starts:
                block = set(words[s:s + 64])
                for label, t in licences.TEMPLATES:
                    wanted = {w.encode() for w in t.split()}
                    share = len(wanted & block) / len(wanted)
                    if share >= 0.6:
                        want.add((label, base + s, min(64, len(words) - s), share))
            base += len(words)
        assert set(licences.find_blocks(lines, index)) == want
    out = {r.doc_id: r for r in licences.scan_licences(odd).collect()}
    assert out[4].n_words == 0 and out[4].first_word is None and out[4].labels == "" and out[4].score == 0.0
    found = licences.base_places("cc by cc by x all rights reserved".encode().split(), licences.BASE)
    assert found == ([0, 2, 5], {"cc-by", "reserved"})
    assert licences.scan_licences(odd.limit(0)).count() == 0


def test_wrapped_licences(spark):
    """Notices wrapped over two lines, alone and inside a longer text, and blocks of lines and documents against brute force."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    around = "\n".join(prose(40 + i, 9) for i in range(30))
    rows = [(1, mit, "mit"), (2, bsd, "bsd"), (3, f"{around}\n{mit}\n\n{around}", "mit"), (4, f"{around}\r\n# {bsd}", "bsd"),
            (5, around, ""), (6, mit.replace("\n", " "), "mit")]
    out = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    assert {i: r.labels for i, r in out.items()} == {i: want for i, _, want in rows}
    assert all(out[i].score >= 0.9 for i in (1, 2, 3, 4, 6)) and len(out[6].blocks) == 1
    r = random.Random(9)
    vocabulary = [w for _, t in licences.TEMPLATES for w in t.split()] + WORDS
    index = licences.Index.build(licences.TEMPLATES, {}, 0.6)
    for _ in range(30):
        lines = [[r.choice(vocabulary).encode() for _ in range(r.choice([0, 5, 40, 100]))] for _ in range(6)]
        words, spans = [w for x in lines for w in x], set()
        for at, x in [*((sum(map(len, lines[:i])), x) for i, x in enumerate(lines)), (0, words)]:
            spans |= {(at + s, min(64, len(x) - s)) for s in range(0, max(-(-max(len(x) - 64, 0) // 32), 0) * 32 + 1, 32)}
        want = collections.Counter()
        for first, size in spans:
            block = set(words[first:first + size])
            for label, t in licences.TEMPLATES:
                wanted = {w.encode() for w in t.split()}
                if len(wanted & block) / len(wanted) >= 0.6:
                    want[label, first, size, len(wanted & block) / len(wanted)] += 1
        assert collections.Counter(licences.document_blocks(lines, [(64, index)])) == want


def test_shards(spark, odd):
    records = odd.selectExpr("doc_id", "octet_length(coalesce(text, '')) + 16 AS size", "1L AS text_crc32")
    rows = sharding.shard(records, 5).collect()
    assert len(rows) == odd.count() and all(r.grown_shard in (r.shard, 5) for r in rows)
    for s in {r.shard for r in rows}:
        own = [r.slot for r in rows if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    for n in (1, 7, 40):
        sizes = collections.Counter(sharding.slot_map(n))
        assert len(sizes) == n and max(sizes.values()) - min(sizes.values()) <= 1
    sizes = {i: 1 + i % 97 for i in range(sharding.SLOTS)}
    even = sharding.rebalanced(sharding.slot_map(40), sizes, 40)
    weight = collections.Counter()
    for slot, s in enumerate(even):
        weight[s] += sizes[slot]
    assert max(weight.values()) <= 1.03 * sum(weight.values()) / 40
    assert sharding.shard(records.limit(0), 5).count() == 0


def test_lookups_of_fingerprints_are_never_broadcast(spark):
    prints = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % 2 ** 63,) for i in range(50)] + [(1,), (3,)], "_print long")
    links = simhash.fingerprint_links(prints)
    assert {(1, 3)} <= {tuple(r) for r in links.collect()}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_few_pieces_are_remembered(monkeypatch):
    """Pieces met again stay when others are forgotten, and forgetting changes no id."""
    coder, whole = packing.Pieces(None), packing.Pieces(None)
    texts = [f"stay here {' '.join(f'w{chr(97 + i % 26)}{chr(97 + j)}' for j in range(20))}".encode() for i in range(30)]
    wanted = whole.encode(texts)
    monkeypatch.setattr(packing, "CACHE", 60)
    for text, ids in zip(texts, wanted):
        assert coder.encode([text]) == [ids]
        assert len(coder.known) + len(coder.older) <= 60 and b"stay" in coder.known
    assert np.array_equal(np.frombuffer(wanted[0], "<u4"), np.frombuffer(whole._full([texts[0]])[0], "<u4"))


def test_automata_go_with_their_task(spark, odd):
    samples = {"en": b"red blue green stone river", "de": b"rot blau gelb stein fluss"}
    language.identify_language(odd.coalesce(1), samples).collect()

    @F.udf("int")
    def held(_):
        import gc

        from latticeloom.llm import language as module
        return sum(isinstance(o, module.Automaton) for o in gc.get_objects())

    assert max(r[0] for r in spark.range(64).select(held("id")).collect()) == 0
