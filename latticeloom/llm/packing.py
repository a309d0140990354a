"""Order-preserving packing of documents into token sequences by dynamic programming.

The documents of a partition form one stream of token ids, each document closed by an end id. The stream is cut into windows
of at most ``capacity`` ids. With f(j) the least cost of the stream up to a possible cut j,

    f(j) = penalty(j) + sequence_cost + min over i in [j - capacity, j) of  f(i) + padding(j - i)

where padding(n) is ``capacity`` - n, or 0 if n is a power of two. Possible cuts are document ends (no penalty), sentence
ends (``sentence_cost``) and, only inside stretches without either, every quarter of the capacity (``word_cost``). Since
padding is linear, the minimum is a sliding-window minimum of f(i) + i: a monotone queue gives it in constant amortised
time, and the power-of-two windows are at most 13 further transitions.

Packing works within partitions: no shuffle, memory for ``run_tokens`` ids. The last window of a run is reopened and
carried into the next run, so only the end of a partition can leave a loosely filled sequence.

Tokenizing: where the vocabulary allows it, blank-separated pieces of text are tokenized one by one and remembered (up to
``CACHE`` pieces in a worker, of which those not met for long are forgotten; this changes nothing but speed).

Defined cases: a null or empty text is the end id alone. Repeated rows are packed as often as they occur. Every id of every
document lies in exactly one piece. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 4096
END_ID = 2
CACHE = 400_000
_APART = r"([a-z])([!-&(-/:;=-@\[-`{-~]+)([ \t\n\v\f\r]|$)"     # signs between a letter and a blank
_PLAIN = re.compile(r"[!-&(-;=-@\[-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")     # ASCII and Latin-1 letters without apostrophe and <
_RUNS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The sign that byte-level vocabularies have for each byte.
BYTE_SIGNS = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}
#: The normalizer and pre-tokenizer for which white space and such runs separate tokens.
BY_PIECE = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                                         {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed",
         "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]


class Pieces:
    """Token ids (little-endian uint32 bytes) of texts.

    A vocabulary that lowers case and splits text into runs of letters, single digits and runs of other signs is applied to
    blank-separated pieces, which are remembered and looked up once for all texts of a call; runs of printable ASCII and Latin-1
    letters go straight to its merges. Others see whole texts.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}                     # pieces met lately, and before them
        self.older: dict[bytes, bytes] = {}
        ends = [i for t, i in self.tokenizer.get_vocab().items() if re.fullmatch(r"[.!?]+[\"')\]]*(</w>)?", t)]
        self.sentence_end = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.sentence_end[ends] = True
        told = json.loads(self.tokenizer.to_str())
        self.merge = self.tokenizer.model.tokenize
        self.by_piece = [told["normalizer"], told["pre_tokenizer"]] == BY_PIECE

    def _plain(self, piece: str) -> bytes:
        runs = [piece] if piece.isalpha() else _RUNS.findall(piece)
        if not piece.isascii():
            runs = [r.encode().decode("latin-1").translate(BYTE_SIGNS) for r in runs]
        return np.array([t.id for r in runs for t in self.merge(r)], dtype="<u4").tobytes()

    def _full(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_piece:
            return self._full(texts)
        if not texts:
            return []
        # signs between a letter and a blank are runs of their own; the names of special ids keep their case
        told = pa.array(texts, pa.large_binary()).view(pa.large_string())
        told = pc.if_else(pc.match_substring(told, "<|"), told, pc.replace_substring_regex(pc.ascii_lower(told), _APART, r"\1 \2\3"))
        split = pc.ascii_split_whitespace(told)
        met = split.flatten().dictionary_encode()
        words = met.dictionary.view(pa.large_binary()).to_pylist()
        new = [p for p in words if p not in self.known]
        if len(self.known) + len(new) > CACHE // 2:
            self.known, self.older = {}, self.known
            new = words
        rest = []
        for p in new:
            if p in self.older:
                self.known[p] = self.older[p]
            elif _PLAIN.fullmatch(word := p.decode("utf-8", "replace").lower()) and (p.islower() or not p.isalpha()):
                self.known[p] = self._plain(word)
            else:
                rest.append(p)
        for at in range(0, len(rest), 20_000):
            self.known.update(zip(rest[at:at + 20_000], self._full(rest[at:at + 20_000])))
        ids = pa.array([self.known[p] for p in words], pa.large_binary()).take(met.indices)
        ends = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy()))[split.offsets.to_numpy()].tolist()
        data = b"".join(ids.buffers()[2:]) if len(ids) else b""
        return [data[a:b] for a, b in zip(ends, ends[1:])]


@cache
def loaded(path: str | None) -> Pieces:
    """One for each worker process. A function of the module, so that tasks do not bring a copy of their own."""
    return Pieces(path)


def choose_cuts(cuts: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY, sequence_cost: float = 32.0) -> np.ndarray:
    """Ends of the windows of least cost over ``[0, cuts[-1])``.

    ``cuts`` are the possible ends in rising order, no gap being longer than ``capacity``; the last one is always an end.
    """
    at = np.concatenate([[0], cuts])
    exact = []                                              # (later cut, earlier cut) a power of two apart
    for k in range(capacity.bit_length()):
        if 1 << k <= capacity:
            i = np.searchsorted(at, at - (1 << k))
            hit = np.flatnonzero((at >= 1 << k) & (at[i] == at - (1 << k)))
            exact.append(np.stack([hit, i[hit]], axis=1))
    exact = np.concatenate(exact)
    exact = exact[np.argsort(exact[:, 0], kind="stable")]
    starts = np.searchsorted(exact[:, 0], np.arange(len(at) + 1)).tolist()
    froms, places, costs = exact[:, 1].tolist(), at.tolist(), [0.0, *penalties.tolist()]
    best, came = [0.0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    for j in range(1, len(places)):
        here = places[j]
        while places[queue[0]] < here - capacity:
            queue.popleft()
        i = queue[0]
        low = best[i] + places[i] + capacity - here
        for x in range(starts[j], starts[j + 1]):
            if best[froms[x]] < low:
                i = froms[x]
                low = best[i]
        best[j], came[j] = low + costs[j] + sequence_cost, i
        level = best[j] + here
        while queue and best[queue[-1]] + places[queue[-1]] >= level:
            queue.pop()
        queue.append(j)
    ends, j = [], len(places) - 1
    while j:
        ends.append(places[j])
        j = came[j]
    return np.array(ends[::-1], dtype=np.int64)


def possible_cuts(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, capacity: int, sentence_cost: float,
                  word_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Possible window ends of a run and their penalties; ``ends`` are the document ends."""
    sentences = np.flatnonzero(sentence_end[np.minimum(ids, len(sentence_end) - 1)]) + 1
    penalty = np.full(len(ids) + 1, -1.0)
    penalty[sentences] = sentence_cost
    penalty[ends] = 0.0
    penalty[0] = 0.0
    cuts = np.flatnonzero(penalty >= 0)
    step = max(capacity // 4, 1)
    for i in np.flatnonzero(np.diff(cuts) > step):
        inner = np.arange(cuts[i] + step, cuts[i + 1], step)
        penalty[inner] = word_cost
    cuts = np.flatnonzero(penalty >= 0)[1:]
    return cuts, penalty[cuts]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, sentence_cost: float = 8.0, word_cost: float = 64.0, run_tokens: int = 400_000) -> DataFrame:
    """One row per piece: ``(id, start, length, ids, doc_tokens, sequence_id, offset)``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers. ``tokenizer`` is the path of a tokenizer
    file on the executors; by default the installed vocabulary ``word_bpe_49k.json``.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [
        T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()),
                                         ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))])
    closing = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(tokenizer)
        first = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []                           # (id, ids as bytes, ids before them, ids of the document)
        held = 0

        def packed(last: bool) -> pa.RecordBatch | None:
            nonlocal waiting, held, first
            data = b"".join(w[1] for w in waiting)
            ids = np.frombuffer(data, dtype="<u4")
            sizes = np.array([len(w[1]) // 4 for w in waiting], dtype=np.int64)
            ends = np.cumsum(sizes)
            windows = choose_cuts(*possible_cuts(ids, ends, coder.sentence_end, capacity, sentence_cost, word_cost), capacity)
            keep = len(windows) if last else len(windows) - 1
            stop = int(windows[keep - 1]) if keep else 0
            borders = np.unique(np.concatenate([[0], ends[ends <= stop], windows[:keep]]))
            start, length = borders[:-1], np.diff(borders)
            doc = np.searchsorted(ends, start, side="right")
            window = np.searchsorted(windows, start, side="right")
            opened = np.concatenate([[0], windows])[window]
            inside = start - (ends - sizes)[doc]
            out = pa.RecordBatch.from_arrays([
                pa.array([waiting[d][0] for d in doc], pa_schema[0].type),
                pa.array(inside + np.array([waiting[d][2] for d in doc], dtype=np.int64)), pa.array(length),
                pa.array([data[4 * a:4 * (a + n)] for a, n in zip(start.tolist(), length.tolist())], pa.binary()),
                pa.array(np.array([waiting[d][3] for d in doc], dtype=np.int64)), pa.array(first + window),
                pa.array(start - opened)], schema=pa_schema)
            first += keep
            rest = []                                       # what the reopened window holds
            for w, size, end in zip(waiting, sizes.tolist(), ends.tolist()):
                if end > stop:
                    cut = max(stop - (end - size), 0)
                    rest.append((w[0], w[1][4 * cut:], w[2] + cut, w[3]))
            waiting, held = rest, int(ends[-1]) - stop
            return out

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(names), 256):
                coded = coder.encode(texts.slice(at, 256).to_pylist())
                for name, ids in zip(names[at:at + 256], coded):
                    ids += closing
                    waiting.append((name, ids, 0, len(ids) // 4))
                    held += len(ids) // 4
                if held >= run_tokens:
                    yield packed(False)
        if waiting:
            yield packed(True)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(schema)
    return docs.select(id_col, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text")).mapInArrow(run, schema)
