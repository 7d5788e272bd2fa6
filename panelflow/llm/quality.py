"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm import labelled, words

BITS = 18  # features are hashed into 2 ** BITS weights
SAMPLE = 20_000  # labelled rows used for fitting, at most
SHARDS = 4  # models fitted side by side and averaged

_TAIL = re.compile(r"[^\w]+$")
_HEAD = re.compile(r"^[^\w]+")


def shape(word: bytes) -> bytes:
    """Outer form of a word: letter case, digits, length class and the marks around it."""
    s = word.decode("utf-8", "replace")
    tail, head = _TAIL.search(s), _HEAD.search(s)
    if tail and tail.start() == 0:
        return b"marks " + s[:3].encode()
    core = s[len(head[0]) if head else 0:tail.start() if tail else len(s)]
    case = "U" if len(core) > 1 and core.isupper() else "T" if core[:1].isupper() else "l"
    digit = "d" if any(c.isdigit() for c in core) else ""
    return f"{case}{digit}{min(len(core) // 8, 3)} {head[0][:2] if head else ''} {tail[0][:3] if tail else ''}".encode()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, the text each belongs to, and its value: 1 / (features of its stream in that text).

    Streams: word 1- and 2-grams, 1- to 3-grams of word shapes, and 1- and 2-grams of marks telling that a
    word equals the one before or that its 3-gram came earlier in the text. N-grams stay inside a text.
    """
    found, counts = words.split(texts)
    distinct, codes = words.coded(found)
    of = xxhash.xxh3_64_intdigest
    n = len(distinct)
    word = np.fromiter((of(w.lower()) for w in distinct), np.uint64, n)[codes]
    form = np.fromiter((of(shape(w)) for w in distinct), np.uint64, n)[codes]
    own = words.owners(counts)

    same = np.zeros(len(word), np.uint64)
    same[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    three = words.grams(word, 3)
    seen = np.zeros(len(word), np.uint64)
    if len(three):
        whole = np.flatnonzero(own[:-2] == own[2:])
        key = words.mixed(three[whole] + own[whole].astype(np.uint64), 7)
        order = np.argsort(key, kind="stable")
        repeat = np.zeros(len(key), bool)
        repeat[order[1:]] = key[order[1:]] == key[order[:-1]]
        seen[whole] = repeat
    mark = same + np.uint64(2) * seen

    numbers, belongs, values = [], [], []
    for seed, (stream, n_max) in enumerate(((word, 2), (form, 3), (mark, 2))):
        for k in range(1, n_max + 1):
            h = words.grams(stream, k, 16 * seed + k)
            whole = own[:len(h)] == own[k - 1:k - 1 + len(h)] if k > 1 else slice(None)
            numbers.append((h[whole] >> np.uint64(64 - BITS)).astype(np.int32))
            belongs.append(own[:len(h)][whole])
            per = np.bincount(belongs[-1], minlength=len(counts))
            values.append((1.0 / np.maximum(per, 1))[belongs[-1]].astype(np.float32))
    return np.concatenate(numbers), np.concatenate(belongs), np.concatenate(values)


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01

    def __post_init__(self):
        self.z, self.n = np.zeros(1 + (1 << BITS)), np.zeros(1 + (1 << BITS))

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (sigmoid(w @ x) - y) * x
        grown = self.n[i] + g * g
        self.z[i] += g - (np.sqrt(grown) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] = grown


def sigmoid(v):
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))


SCALE = 8.0  # values are rates; scaled so that a single update moves them


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.pieces(batch):
            number, own, value = features(part.column(1))
            key = own.astype(np.int64) << BITS | number
            distinct, back = np.unique(key, return_inverse=True)
            summed = np.bincount(back, value, len(distinct)).astype(np.float32)
            cut = np.searchsorted(distinct >> BITS, np.arange(1, part.num_rows))
            index, rate = np.split((distinct & ((1 << BITS) - 1)).astype(np.int32), cut), np.split(summed, cut)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(list(index), pa.list_(pa.int32())), pa.array(list(rate), pa.list_(pa.float32()))],
                ["id", "y", "i", "x"])


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model, rows = Ftrl(), list(frames)
    rows = pd.concat(rows).sort_values("order") if rows else []
    for _ in range(3 if len(rows) else 0):
        for i, x, y in zip(rows["i"], rows["x"], rows["y"]):
            model.update(np.append(np.asarray(i), 1 << BITS), np.append(np.asarray(x) * SCALE, 1.0), int(y))
    if len(rows):
        w = model.weights()
        at = np.flatnonzero(w)
        yield pd.DataFrame({"i": at, "w": w[at]})


def fit(examples: DataFrame) -> np.ndarray:
    """Weights (the last one is the bias), from a bounded sample: id, text, y.

    Feature extraction runs where the texts are read. SHARDS models are fitted in tasks of their own, each
    over its rows in the order of their id's hash, and averaged; only the averaged weights, of which there
    are at most 2 ** BITS + 1, reach the driver. Without labelled rows all weights are 0 (score 0.5).
    """
    kind = examples.schema["id"].dataType.simpleString()
    rows = examples.mapInArrow(_examples, f"id {kind}, y int, i array<int>, x array<float>")
    rows = rows.withColumn("order", F.xxhash64("id")).repartition(SHARDS, F.pmod("order", F.lit(SHARDS)))
    per_shard = rows.select("order", "y", "i", "x").mapInPandas(_fit, "i int, w double")
    got = per_shard.groupBy("i").agg((F.sum("w") / SHARDS).alias("w")).toPandas()
    weights = np.zeros(1 + (1 << BITS))
    weights[got["i"].to_numpy(np.int64)] = got["w"].to_numpy(float)
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), as a sparse dot product with the weights.

    Null and empty texts have no features and get the bias alone. Repeated rows are scored each, null ids
    pass through, an empty table gives an empty table. The weights (2 MB) are broadcast once.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in words.pieces(batch):
                number, own, value = features(part.column(1))
                total = w[-1] + SCALE * np.bincount(own, w[number] * value, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(total))], [id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns, in the pass that scores them."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in words.pieces(batch, at):
                number, own, value = features(part.column(at))
                total = w[-1] + SCALE * np.bincount(own, w[number] * value, part.num_rows)
                yield part.filter(pa.array(sigmoid(total) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE,
             threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on labels outside the held-out fold, score every row: id, held_out, score, predicted."""
    weights = fit(labelled.sample(docs, labels, "quality", folds, held_out, sample, id_col, text_col))
    return score(docs, weights, id_col, text_col).select(
        id_col, (labelled.remainder(F.col(id_col), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
