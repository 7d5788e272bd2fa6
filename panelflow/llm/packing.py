"""Packing: order-preserving dynamic programming over document and sentence boundaries."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm import words

END_ID = 1  # closes every document
LENGTH = 2048  # longest sequence
SENTENCE_COST = 0.25  # a cut between two sentences of a document, in units of one padding token
WORD_COST = 4.0  # a cut inside a sentence
FINE_EVERY = 32  # inside a longer sentence a cut may lie after about every so many tokens
BLOCK_TOKENS = 1 << 19  # tokens planned together; the last open sequence moves on to the next block
KNOWN_WORDS = 800_000  # words remembered by a task

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan(ends: np.ndarray, costs: np.ndarray, length: int = LENGTH, final: bool = True) -> list[int]:
    """Cut positions of the cheapest windows of [0, ends[-1]), the first cut being 0.

    ends are the ascending positions where a cut may lie, costs what it costs there. A window costs its
    padding up to `length`, or nothing where its size is a power of two, plus the cost of its closing cut.
    f(j) = cost(j) + min(f(i) + length - (j - i)) over i >= j - length, or f(i) with j - i a power of two: since
    f(i) + i does not depend on j, the first minimum comes from a monotone queue, and
    every position enters and leaves it once. Gaps must not exceed `length`. Unless `final`, the plan
    stops at the cheapest cut within the last `length` positions, so an open sequence can be continued.
    """
    pos = [0, *ends.tolist()]
    cost = [0.0, *costs.tolist()]
    exact = _exact_windows(np.asarray(pos), length)
    f, back = [0.0] * len(pos), [0] * len(pos)
    g = [0.0] * len(pos)  # f(i) + i
    queue, head = [0], 0  # cuts whose g ascends; the first within reach has the least
    for j in range(1, len(pos)):
        at = pos[j]
        reach = at - length
        while pos[queue[head]] < reach:
            head += 1
        come = queue[head]
        best = g[come] + length - at
        if j in exact:
            for k in exact[j]:
                if f[k] < best:
                    best, come = f[k], k
        best += cost[j]
        f[j], back[j] = best, come
        g[j] = best = best + at
        while len(queue) > head and g[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    last = len(pos) - 1
    if final:
        tail = _powers_of_two(pos, f, back, last, length)
    else:
        tail = []
        reach = pos[-1] - length
        last = min((k for k in range(len(pos) - 1, 0, -1) if pos[k] >= reach), key=lambda k: f[k] + pos[k])
    cuts = []
    while last:
        cuts.append(pos[last])
        last = back[last]
    return [0, *reversed(cuts), *tail]


def _exact_windows(pos: np.ndarray, length: int) -> dict[int, list[int]]:
    """For each cut, the earlier cuts that lie a power of two (64 up to half a window) before it."""
    found: dict[int, list[int]] = {}
    size = 64
    while size < length:
        at = np.minimum(np.searchsorted(pos, pos - size), len(pos) - 1)
        for j in np.flatnonzero(pos[at] == pos - size).tolist():
            found.setdefault(j, []).append(int(at[j]))
        size *= 2
    return found


def _powers_of_two(pos, f, back, last, length) -> list[int]:
    """The end of a stream may be short of a window: its last window is cut to powers of two."""
    begin = pos[back[last]]
    rest, at, tail = pos[last] - begin, begin, []
    if rest == length or rest & (rest - 1) == 0:
        return []
    for k in range(rest.bit_length() - 1, -1, -1):
        if rest >> k & 1:
            at += 1 << k
            tail.append(at)
    pos[last] = tail.pop(0)  # the chain's last cut becomes the first of these
    return tail


_ALNUM, _MARK, _CAPITAL = (np.zeros(256, bool) for _ in range(3))
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _ALNUM[ord(_a):ord(_b) + 1] = True
_CAPITAL[ord("A"):ord("Z") + 1] = True
_MARK[0x21:0x7F] = ~_ALNUM[0x21:0x7F]
_MARK[[ord("'"), ord("|")]] = False  # contractions and special strings hold these


def _fragments(found: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words cut further where no token can reach across, in lower case; and which fragments end a word.

    Cuts lie between an ASCII letter or digit and an ASCII mark other than ' and |. A-Z are lowered unless a
    character outside ASCII follows, with which the letter might combine, or "<|" occurs, which may open a
    special string. The fragments have the same ids as the words, and fewer of them are distinct.
    """
    ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)
    data = np.frombuffer(found.buffers()[2], np.uint8, ends[-1])
    if not len(data):
        return found, np.zeros(0, bool)
    border = (_ALNUM[data[:-1]] & _MARK[data[1:]]) | (_MARK[data[:-1]] & _ALNUM[data[1:]])
    border[ends[1:-1] - 1] = True
    if b"<|" not in data.tobytes():
        low = _CAPITAL[data]
        low[:-1] &= (data[1:] < 0x80) | border
        data = data + low.astype(np.uint8) * 32
    edges = np.concatenate([[0], np.flatnonzero(border) + 1, [len(data)]]).astype(np.int32)
    closes = np.isin(edges[1:], ends[1:], assume_unique=True)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]), closes


class Encoder:
    """Token ids of texts by way of their distinct words, which the tokenizer meets once.

    The vocabulary's normaliser drops white space and no token crosses it, so the ids of a text are those of its
    words in order. Special strings hold no white space either. A worker process keeps its encoder.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.empty(1 << 20, np.uint32), np.zeros(KNOWN_WORDS + 1, np.int64)

    def number(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of the words among the known ones; new words are learned."""
        if len(self.known) + len(distinct) > KNOWN_WORDS:
            self.forget()
        known = self.known
        if len(distinct) > KNOWN_WORDS:  # one text of very many words
            self.ends = np.zeros(len(distinct) + 1, np.int64)
        got = np.fromiter(map(known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = [distinct[i] for i in np.flatnonzero(got < 0)]
        for at in range(0, len(new), 8192):
            some = new[at:at + 8192]
            coded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
            rows = [e.ids for e in coded]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            ids = np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum()))
            n = len(known)
            end = int(self.ends[n]) + len(ids)
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(end, len(self.flat)), np.uint32)])
            self.flat[end - len(ids):end] = ids
            self.ends[n + 1:n + 1 + len(rows)] = self.ends[n] + np.cumsum(sizes)
            known.update(zip(some, range(n, n + len(some))))
        if new:
            got[got < 0] = np.arange(len(known) - len(new), len(known))
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with END_ID after each; tokens per text; then where sentences and words end."""
        found, counts = words.split(texts)
        parts, closes = _fragments(found)
        distinct, codes = words.coded(parts)
        number = self.number(distinct)
        begins = self.ends[number]
        sizes = self.ends[number + 1] - begins
        per_part = sizes[codes]
        # a word ends with its last fragment, a sentence where that ends with a mark
        stops = np.fromiter((w[-1] in b".!?" for w in distinct), bool, len(distinct))[codes][closes]
        until = np.concatenate([[0], np.cumsum(per_part)])
        begin = np.concatenate([[0], until[1:][closes]])
        per_word = np.diff(begin)
        own = words.owners(counts)
        # a closing id follows each text: shift words by the texts before them
        to = begin[1:] + own
        ids = np.full(begin[-1] + len(counts), END_ID, np.uint32)
        place = np.arange(begin[-1]) + np.repeat(own, per_word)
        ids[place] = self.flat[np.repeat(begins[codes] - until[:-1], per_part) + np.arange(until[-1])]
        first = np.concatenate([[0], np.cumsum(counts)])
        tokens = begin[first[1:]] - begin[first[:-1]] + 1
        return ids, tokens, to[stops], to


def _boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, word_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may lie, and the cost of each."""
    total = int(doc_ends[-1]) if len(doc_ends) else 0
    some = np.unique(np.concatenate([[0], doc_ends, sentence_ends[sentence_ends < total]]))
    # inside a sentence: word ends, thinned to one in FINE_EVERY tokens
    cell = word_ends // FINE_EVERY
    fine = word_ends[np.flatnonzero(np.append(cell[1:] != cell[:-1], True))] if len(word_ends) else word_ends
    inside = np.searchsorted(some, fine)
    inside = np.clip(inside, 1, len(some) - 1) if len(some) > 1 else inside
    if len(some) > 1 and len(fine):
        gap = some[inside] - some[inside - 1]
        fine = fine[gap > 2 * FINE_EVERY]
    ends = np.unique(np.concatenate([some, fine[fine < total]]))[1:]
    # words longer than a sequence are cut anywhere
    gaps = np.diff(np.concatenate([[0], ends]))
    if len(ends) and gaps.max() > length:
        ends = np.unique(np.concatenate([ends, *(np.arange(e - g + length, e, length) for e, g in zip(ends[gaps > length], gaps[gaps > length]))]))
    cost = np.full(len(ends), WORD_COST)
    for some, price in ((sentence_ends, SENTENCE_COST), (doc_ends, 0.0)):  # all ascend
        if len(some):
            at = np.minimum(np.searchsorted(some, ends), len(some) - 1)
            cost[some[at] == ends] = price
    return ends, cost


class Packer:
    """Plans a stream of documents block by block and cuts it into pieces."""

    def __init__(self, encoder: Encoder, prefix: int, length: int):
        self.encoder, self.length, self.sequence = encoder, length, prefix
        self.pending: list[tuple] = []  # arrays of blocks not yet planned
        self.size = 0
        self.done = 0  # tokens of the first pending document that are already packed
        self.first = 0  # ids of that document before what is pending

    def add(self, names: pa.Array, texts: pa.Array) -> Iterator[dict]:
        ids, tokens, sentences, ends = self.encoder.encode(texts)
        self.pending.append((names, ids, tokens, tokens.copy(), np.zeros(len(tokens), np.int64), sentences, ends))
        self.size += len(ids)
        if self.size >= BLOCK_TOKENS:
            yield self.flush(False)

    def flush(self, final: bool) -> dict | None:
        if not self.pending:
            return None
        names = pa.concat_arrays([p[0] for p in self.pending])
        ids = np.concatenate([p[1] for p in self.pending])
        left = np.concatenate([p[2] for p in self.pending])  # tokens of each document in this block
        whole = np.concatenate([p[3] for p in self.pending])  # tokens of the whole document
        before = np.concatenate([p[4] for p in self.pending])  # tokens of it packed earlier
        shift = np.cumsum([0] + [len(p[1]) for p in self.pending])
        sentences = np.concatenate([p[5] + s for p, s in zip(self.pending, shift)])
        ends = np.concatenate([p[6] + s for p, s in zip(self.pending, shift)])
        doc_ends = np.cumsum(left)
        cuts = np.asarray(plan(*_boundaries(doc_ends, sentences, ends, self.length), self.length, final), np.int64)
        stop = int(cuts[-1])

        edges = np.unique(np.concatenate([cuts, doc_ends[doc_ends < stop]]))
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_ends, a, side="right")
        window = np.searchsorted(cuts, a, side="right") - 1
        raw = memoryview(ids.astype("<u4")).cast("B")
        out = {
            "name": names.take(pa.array(doc)), "start": a - (doc_ends - left)[doc] + before[doc], "length": b - a,
            "crc": np.fromiter((zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist())), np.int64, len(a)),
            "tokens": whole[doc], "sequence": self.sequence + window, "offset": a - cuts[window],
        }
        self.sequence += len(cuts) - 1
        self.pending, self.size = [], 0
        if stop < len(ids):
            k = int(np.searchsorted(doc_ends, stop, side="right"))
            used = stop - int(doc_ends[k] - left[k])
            keep, gone = left[k:].copy(), before[k:].copy()
            keep[0] -= used
            gone[0] += used
            self.pending.append((names.slice(k), ids[stop:], keep, whole[k:], gone, sentences[sentences > stop] - stop, ends[ends > stop] - stop))
            self.size = len(ids) - stop
        return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs the rows it reads in their order, without a shuffle: documents are token ids closed by
    END_ID, and `plan` chooses the cuts. Blocks of BLOCK_TOKENS are planned together and the last open sequence
    moves on, so memory is bounded by a block and the longest document, and only the end of a task's rows
    is cut to powers of two. Sequence ids are task number * 2 ** 32 + number in the task: a task
    that runs again after a lost executor yields the same pieces.

    Null and empty texts are one piece of one id. Repeated rows and ids are packed each, null ids pass
    through, an empty table gives an empty table. The tokenizer file is read at `tokenizer_path` on
    the executors.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(Encoder.of(tokenizer_path), TaskContext.get().partitionId() << 32, length)
        for batch in batches:
            for part in words.pieces(batch, limit=2 << 20):
                for out in packer.add(part.column(0), part.column(1)):
                    yield _batch(out, id_col)
        while packer.pending:
            yield _batch(packer.flush(True), id_col)

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {SCHEMA}")


def _batch(out: dict, id_col: str) -> pa.RecordBatch:
    columns = [out["name"], *(pa.array(out[k].astype(np.int64)) for k in ("start", "length", "crc", "tokens", "sequence", "offset"))]
    return pa.RecordBatch.from_arrays(columns, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
